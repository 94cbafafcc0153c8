"""Vectorised word and shingle hashes over a batch of texts.

One batch is one byte string; words, word hashes and shingle hashes come from
array arithmetic, so no Python loop runs per word.  A word is a run of bytes
other than ASCII white space; A-Z are lower-cased first.  UTF-8 continuation
bytes are never white space, so byte words are the words of the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SHINGLE_WORDS = 5
#: Texts of more bytes are hashed in parts, so that arrays of 8 bytes a byte are made of one part at a time.
LONG = 1 << 20

#: The multipliers of a published 64-bit finaliser.
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S = np.uint64(33)
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LANE = _rng.integers(0, 1 << 63, SHINGLE_WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _S)
    x = x * _M1
    x ^= x >> _S
    x *= _M2
    x ^= x >> _S
    return x


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, by doubling."""
    out = np.ones(max(n, 1), np.uint64)
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done : done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
        done += step
    return out[:n]


_cache: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """A cached table of powers, grown when a longer batch comes."""
    table = _cache.get(base)
    if table is None or len(table) < n:
        table = _cache[base] = _powers(base, max(n, 1 << 16))
    return table[:n]


def word_hashes(raw: bytes, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each piece raw[bounds[i]:bounds[i+1]], and how many each piece has.

    No word spans two pieces.  Equal words have equal hashes wherever they stand.
    """
    n_docs = len(bounds) - 1
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(n_docs, np.int64)
    data = np.frombuffer(raw, np.uint8)
    solid = ~_SPACE[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = solid[:-1]
    heads = bounds[:-1]
    before[heads[heads < n]] = False
    starts = np.flatnonzero(solid & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = solid[1:]
    tails = bounds[1:] - 1
    after[tails[tails >= 0]] = False
    ends = np.flatnonzero(solid & ~after) + 1
    prefix = np.empty(n + 1, np.uint64)
    prefix[0] = 0
    np.cumsum(_BYTE[_LOWER[data]] * powers(_P, n), out=prefix[1:])
    words = mix((prefix[ends] - prefix[starts]) * powers(_P_INV, n)[starts] + (ends - starts).astype(np.uint64))
    counts = np.diff(np.searchsorted(starts, bounds))
    return words, counts


def shingle_hashes(words: np.ndarray, counts: np.ndarray, k: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each document, in order and with repeats, and their numbers.

    A document of 1 to k-1 words has one shingle, the whole sequence; one without words has none.
    """
    many = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    total = int(many.sum())
    if total == 0:
        return np.zeros(0, np.uint64), many
    first_word = np.cumsum(counts) - counts
    first_out = np.cumsum(many) - many
    at = np.arange(total) + np.repeat(first_word - first_out, many)
    short = np.repeat(counts < k, many)
    padded = np.concatenate([words, np.zeros(k, np.uint64)])
    out = np.zeros(total, np.uint64)
    left = np.repeat(np.where(counts < k, counts, k), many)
    for lane in range(k):
        part = padded[at + lane] * _LANE[lane]
        if short.any():
            part = np.where(lane < left, part, np.uint64(0))
        out += part
    return mix(out + left.astype(np.uint64)), many


def encode_batch(texts) -> tuple[bytes, np.ndarray]:
    """UTF-8 of all texts (None: empty) in one byte string, and the bounds of each."""
    parts = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    bounds = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=bounds[1:])
    return b"".join(parts), bounds


def segments(raw: bytes, most: int = LONG) -> Iterator[bytes]:
    """The bytes in parts of about `most` that end between words; a longer word makes its part longer."""
    at = 0
    while at < len(raw):
        to = at + most
        if to < len(raw):
            space = np.flatnonzero(_SPACE[np.frombuffer(raw, np.uint8, most, at)])
            while not len(space) and to < len(raw):
                space = np.flatnonzero(_SPACE[np.frombuffer(raw, np.uint8, min(most, len(raw) - to), to)])
                if len(space):
                    space = space[:1] + (to - at)
                else:
                    to += most
            to = at + int(space[-1]) + 1 if len(space) else len(raw)
        yield raw[at:to]
        at = to


def long_shingles(raw: bytes, k: int = SHINGLE_WORDS) -> Iterator[np.ndarray]:
    """Shingle hashes of one long text in order, part by part; the last k - 1 words are carried over."""
    held, some = np.zeros(0, np.uint64), False
    for part in segments(raw):
        words, _ = word_hashes(part, np.array([0, len(part)]))
        held = np.concatenate([held, words])
        if len(held) >= k:
            yield shingle_hashes(held, np.array([len(held)]), k)[0]
            held, some = held[1 - k :], True
    if len(held) and not some:
        yield shingle_hashes(held, np.array([len(held)]), k)[0]


def document_shingles(texts) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes and their numbers for a batch of texts; long ones are taken part by part."""
    values, counts, short = [], [], []

    def flush() -> None:
        if short:
            v, n = shingle_hashes(*word_hashes(*encode_batch(short)))
            values.append(v)
            counts.append(n)
            short.clear()

    for t in texts:
        if t is not None and len(t) > LONG:
            flush()
            own = list(long_shingles(t.encode("utf-8", "surrogatepass")))
            values += own
            counts.append(np.array([sum(map(len, own))]))
        else:
            short.append(t)
    flush()
    return (np.concatenate(values), np.concatenate(counts)) if counts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def distinct_sets(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's hashes sorted and without repeats, and their numbers."""
    out = np.empty_like(values)
    sizes = np.zeros(len(counts), np.int64)
    at = done = 0
    for i, c in enumerate(counts.tolist()):
        if c:
            one = np.sort(values[at : at + c])
            keep = one[np.concatenate([[True], one[1:] != one[:-1]])] if c > 1 else one
            out[done : done + len(keep)] = keep
            done += len(keep)
            sizes[i] = len(keep)
            at += c
    return out[:done], sizes


def raw_text(column) -> tuple[bytes, np.ndarray]:
    """The UTF-8 bytes of an Arrow string column (null: empty) and the bounds of each row."""
    column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = data[int(offsets[0]) : int(offsets[-1])].to_pybytes() if data is not None else b""
    return raw, offsets - offsets[0]


def document_sets_of(column) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each row of an Arrow string column, and their numbers."""
    raw, bounds = raw_text(column)
    if len(bounds) == 2 and len(raw) > LONG:
        one = np.zeros(0, np.uint64)
        for values in long_shingles(raw):
            one = np.union1d(one, values)
        return one, np.array([len(one)])
    return distinct_sets(*shingle_hashes(*word_hashes(raw, bounds)))
