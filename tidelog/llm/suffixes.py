"""Removal of repeated passages by suffix arrays built with Lyndon grouping.

suffix_array() sorts suffixes in two phases.  The first keeps the suffixes in
groups by a Lyndon prefix and takes the groups in descending order: every suffix
of the group at hand looks for the nearest suffix before it in a lower group
(its previous-smaller pointer, found along pointers that are known already), and
those found move to a new group behind their own, since their prefix now grows
by that of the group at hand, once for each time they are found.  The second
phase walks the order from the least suffix on and puts the suffixes before it,
along the same pointers, into the next free places of their groups.  Nothing is
renamed and nothing is sorted again.

No text of the corpus' size is ever sorted.  A string of LENGTH bytes holds an
anchor: the leftmost least hash of its GRAM-byte strings, the same wherever the
string stands.

1. Documents are dealt into slices of bounded bytes; each slice sends its anchors'
   hashes, once with their numbers of documents.  Those of one document are out.
2. The slices meet the hashes left, cut out the context
   of each anchor (the bytes of all strings that it anchors), and send each
   context once for a slice.
3. Contexts of one anchor are joined to one text; its suffix array tells which of
   their strings occur in a smaller document.  Equal contexts are one context to
   the sorter, with the smallest document as its owner: a slice finds its own by
   hash and compares their bytes, and so does a part.  Strings that one document
   alone has are dropped by their hashes before the sorter.  An anchor of more than
   HOT_DOCS documents is sent string by string instead, each string a key of its own.
4. The slices remove what has been found.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .hashing import _BYTE, _P, _P_INV, mix, powers

LENGTH, GRAM = 50, 20
STRIDE = LENGTH - GRAM + 1
SLICE_BYTES = 2 << 20
PART_BYTES = 64 << 20
#: Bytes of contexts that a task holds unpacked.
PASS_BYTES = 16 << 20
#: Bytes of contexts whose strings are hashed at once.
SUM_BYTES = 1 << 20
HOT_DOCS = 2_000
HOT = np.uint64(1 << 63)


def suffix_array(text: list[int]) -> list[int]:
    """Starts of the suffixes of a sequence of whole numbers in ascending order, in linear time."""
    n = len(text)
    if not n:
        return []
    order = sorted(set(text))
    rank = {c: i for i, c in enumerate(order)}
    size = [0] * (len(order) + 1)
    for c in text:
        size[rank[c] + 1] += 1
    for i in range(len(order)):
        size[i + 1] += size[i]
    # An end mark lies below all; it is suffix n at place 0.
    group = [size[rank[c]] + 1 for c in text] + [0]
    count = [0] * (n + 2)
    place, members = [0] * (n + 1), [0] * (n + 1)
    members[0] = n
    count[0] = 1
    for i in range(n):
        g = group[i]
        place[i] = g + count[g]
        members[place[i]] = i
        count[g] += 1
    smaller = [-1] * (n + 1)
    end = n + 1
    while end > 1:
        start = group[members[end - 1]]
        found: dict[int, int] = {}
        own = members[start:end]
        if end - start > 1:
            own.sort()
        for i in own:
            j = i - 1
            while j >= 0 and group[j] >= start:
                j = smaller[j]
            smaller[i] = j
            if j >= 0:
                found[j] = found.get(j, 0) + 1
        if found:
            if len(found) == 1:
                levels = [list(found)]
            else:
                by: dict[int, list[int]] = {}
                for j, k in found.items():
                    by.setdefault(k, []).append(j)
                levels = [by[k] for k in sorted(by, reverse=True)]
            for level in levels:
                fresh: dict[int, int] = {}
                for j in level:
                    g = group[j]
                    last = g + count[g] - 1
                    at, other = place[j], members[last]
                    members[at], members[last] = other, j
                    place[other], place[j] = at, last
                    count[g] -= 1
                    fresh[g] = fresh.get(g, 0) + 1
                for g, k in fresh.items():
                    new = g + count[g]
                    if new != g:
                        count[new] = k
                        for q in range(new, new + k):
                            group[members[q]] = new
                    else:
                        count[g] = k
        end = start
    out, free, placed = [n] + [0] * n, list(range(n + 1)), [False] * n
    for q in range(n + 1):
        j = out[q] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            placed[j] = True
            j = smaller[j]
    return out[1:]


def common_prefixes(text: list[int], order: list[int]) -> list[int]:
    """Length of the common prefix of each suffix in order and the one before it (0 for the first)."""
    n = len(text)
    rank, out, h = [0] * n, [0] * n, 0
    for i, s in enumerate(order):
        rank[s] = i
    for s in range(n):
        if rank[s]:
            t = order[rank[s] - 1]
            while s + h < n and t + h < n and text[s + h] == text[t + h]:
                h += 1
            out[rank[s]] = h
            h = max(0, h - 1)
        else:
            h = 0
    return out


def least_owner(contexts: list[bytes], owners: list[int]) -> list[list[int]]:
    """For each string of LENGTH bytes in each context the least owner of a context that holds it."""
    text: list[int] = []
    home: list[int] = []
    base = len(contexts)
    for c, raw in enumerate(contexts):
        text += [b + base for b in raw]
        text.append(c)
        home += [c] * (len(raw) + 1)
    starts = [0]
    for raw in contexts:
        starts.append(starts[-1] + len(raw) + 1)
    order = suffix_array(text)
    shared = common_prefixes(text, order)
    out = [[owners[c]] * (len(raw) - LENGTH + 1) for c, raw in enumerate(contexts)]
    n, q = len(order), 0
    while q < n:
        e = q + 1
        while e < n and shared[e] >= LENGTH:
            e += 1
        if e - q > 1:
            least = min(owners[home[s]] for s in order[q:e])
            for s in order[q:e]:
                out[home[s]][s - starts[home[s]]] = least
        q = e
    return out


def slide(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` neighbours."""
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[: len(x) - span], x[span:])
        span *= 2
    rest = width - span
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


class Anchors:
    """Anchors of a batch of texts: hash (48 bits), place, document, and the first and last string of each."""

    def __init__(self, raw: bytes, bounds: np.ndarray):
        n = len(raw)
        self.raw, self.bounds = raw, bounds
        empty = np.zeros(0, np.int64)
        self.at = self.first = self.last = self.doc = empty
        self.hash = np.zeros(0, np.uint64)
        if n < LENGTH:
            return
        data = np.frombuffer(raw, np.uint8)
        self.prefix = np.empty(n + 1, np.uint64)
        self.prefix[0] = 0
        np.cumsum(_BYTE[data] * powers(_P, n), out=self.prefix[1:])
        h = mix((self.prefix[GRAM:] - self.prefix[:-GRAM]) * powers(_P_INV, n)[: n - GRAM + 1])
        bits = np.uint64(max(24, n.bit_length()))
        key = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64)
        where = (slide(key, STRIDE) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        sizes = np.diff(bounds)
        many = np.maximum(sizes - LENGTH + 1, 0)
        if not many.sum():
            return
        doc = np.repeat(np.arange(len(sizes)), many)
        string = np.arange(int(many.sum())) + np.repeat(bounds[:-1] - (np.cumsum(many) - many), many)
        place = where[string]
        head = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])]))
        tail = np.append(head[1:], len(place)) - 1
        self.at, self.doc, self.first, self.last = place[head], doc[head], string[head], string[tail]
        self.hash = h[self.at] >> np.uint64(16)

    def hash_of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Hashes of the bytes from start to stop, wherever they stand."""
        return mix((self.prefix[stop] - self.prefix[start]) * powers(_P_INV, len(self.raw))[start] + (stop - start).astype(np.uint64))


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal rows begins."""
    new = np.zeros(len(columns[0]), bool)
    if len(new):
        new[0] = True
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


_HASHES = pa.schema([("part", pa.int32()), ("slice", pa.int32()), ("hashes", pa.binary()), ("docs", pa.binary())])


def _pack(x: np.ndarray, width: int) -> bytes:
    """The low `width` bytes of each number, all first bytes first: bytes that are zero throughout compress away."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unpack(raw: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, -1).T
    return out.view("<u8").reshape(-1)


def _squeeze(raw: bytes) -> bytes:
    """The bytes compressed more closely than the shuffle would, after their number."""
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _expand(held: bytes) -> bytes:
    size = int.from_bytes(held[:8], "little")
    return pa.decompress(held[8:], decompressed_size=size, codec="zstd", asbytes=True) if size else b""


def hash_bytes(total_bytes: int) -> int:
    """Bytes of an anchor's hash to send: about one in 256 anchors or fewer agrees with another by chance."""
    return min(6, -(-(max(total_bytes, 1).bit_length() + 4) // 8))


def _anchor_hashes(parts: int, width: int):
    """The hashes of a slice, each once with the number of its documents there, packed by part."""
    low = np.uint64((1 << 8 * width) - 1)

    def run(docs: pa.Table) -> pa.Table:
        number = docs.column("slice")[0].as_py()
        texts = [t.encode("utf-8", "surrogatepass") for t in docs.column("text").to_pylist()]
        found = Anchors(b"".join(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64))
        if not len(found.at):
            return _HASHES.empty_table()
        o = np.lexsort((found.doc, found.hash & low))
        h, d = found.hash[o] & low, found.doc[o]
        h = h[_starts(h, d)]
        at = _starts(h)
        # More than HOT_DOCS is all that matters; one document is packed as 0.
        n = np.minimum(np.diff(np.append(at, len(h))), HOT_DOCS + 1) - 1
        h = h[at]
        part = (h % np.uint64(parts)).astype(np.int32)
        o = np.argsort(part, kind="stable")
        h, n, part = h[o], n[o], part[o]
        at = [*_starts(part).tolist(), len(part)]
        rows = [(int(part[a]), number, _pack(h[a:b], width), _pack(n[a:b], 2)) for a, b in zip(at[:-1], at[1:], strict=True)]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _HASHES, strict=True)], schema=_HASHES)

    return run


def _parts(batches, columns: list[str]):
    """Lists of the values of some columns, for each run of equal parts."""
    held: list[tuple] = []
    at = None
    for batch in batches:
        for p, *values in zip(batch.column(0).to_pylist(), *(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns), strict=True):
            if p != at and held:
                yield list(zip(*held, strict=True))
                held = []
            at = p
            held.append(tuple(values))
    if held:
        yield list(zip(*held, strict=True))


def _repeated(width: int):
    """Hashes of two or more documents, packed for each slice that holds them; bit 63 marks those of more than HOT_DOCS."""

    def run(batches):
        for slices, hashes, docs in _parts(batches, ["slice", "hashes", "docs"]):
            h, m = np.concatenate([_unpack(x, width) for x in hashes]), np.concatenate([_unpack(x, 2) for x in docs]).astype(np.int64) + 1
            s = np.repeat(np.array(slices, np.int64), [len(x) // width for x in hashes])
            o = np.argsort(h, kind="stable")
            h, s, m = h[o], s[o], m[o]
            a = _starts(h)
            many = np.repeat(np.add.reduceat(m, a), np.diff(np.append(a, len(h))))
            keep = many > 1
            h, s, hot = h[keep], s[keep], many[keep] > HOT_DOCS
            h = np.where(hot, h | HOT, h)
            o = np.lexsort((h, s))
            h, s = h[o], s[o]
            at = [*_starts(s).tolist(), len(s)]
            if len(s):
                rows = [(int(s[x]), h[x:y].astype("<u8").tobytes()) for x, y in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["slice", "blob"])

    return run


#: Fields of an entry and their bytes: key, document, its number in its slice, slice, first byte, bytes before the anchor, number of strings.
_ENTRY = {"key": 6, "doc": 8, "row": 4, "slice": 4, "first": 4, "before": 1, "many": 1}
#: One removal: the document's number in its slice, first byte and end.
_REMOVAL = np.dtype([("row", "<u4"), ("start", "<u4"), ("stop", "<u4")])


def _documents(given: pa.Table) -> tuple[np.ndarray, list[bytes]]:
    """Ids and texts of a slice in one order, however its rows come."""
    rows = sorted(zip(given.column("doc_id").to_pylist(), (t.encode("utf-8", "surrogatepass") for t in given.column("text").to_pylist()), strict=True))
    return np.array([r[0] for r in rows], np.int64), [r[1] for r in rows]


_SENT = pa.schema([("part", pa.int32()), ("slice", pa.int32()), ("blob", pa.binary()), ("contexts", pa.binary())])


def _contexts(parts: int, width: int):
    low = np.uint64((1 << 8 * width) - 1)

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows or not answers.num_rows:
            return _SENT.empty_table()
        number = docs.column("slice")[0].as_py()
        known = np.unique(np.frombuffer(b"".join(answers.column("blob").to_pylist()), "<u8"))
        ids, texts = _documents(docs)
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        found = Anchors(b"".join(texts), bounds)
        if not len(found.at):
            return _SENT.empty_table()
        plain = known & ~HOT
        o = np.argsort(plain, kind="stable")
        plain, hot_of = plain[o], (known & HOT)[o] > 0
        sought = found.hash & low
        at = np.minimum(np.searchsorted(plain, sought), len(plain) - 1)
        kept = plain[at] == sought
        hot = hot_of[at][kept]
        doc, first, last, place, key = (x[kept] for x in (found.doc, found.first, found.last, found.at, found.hash))
        # A hot anchor's strings become entries of one string each.
        many = np.where(hot, last - first + 1, 1)
        rep = np.repeat(np.arange(len(doc)), many)
        step = np.arange(len(rep)) - np.repeat(np.cumsum(many) - many, many)
        split = hot[rep]
        f = first[rep] + np.where(split, step, 0)
        end = np.where(split, f, last[rep])
        d, p = doc[rep], np.where(split, f, place[rep])
        stop = end + LENGTH
        whole = found.hash_of(f, stop)
        k = np.where(split, whole, key[rep]) & np.uint64((1 << 48) - 1)
        # Documents stand in ascending order: the first row of equal contexts has the smallest document.
        o = np.lexsort((d, p - f, whole, k))
        d, p, f, end, stop, k, whole = (x[o] for x in (d, p, f, end, stop, k, whole))
        a = _starts(k, whole, p - f)
        lead = np.repeat(a, np.diff(np.append(a, len(d))))
        base = bounds[:-1][d]
        later = ids[d] > ids[d[lead]]
        # Equal hashes only propose: the bytes decide. What differs goes on as a context of its own.
        later[later] = [found.raw[u:v] == found.raw[x:y] for u, v, x, y in zip(f[later].tolist(), stop[later].tolist(), f[lead[later]].tolist(), stop[lead[later]].tolist(), strict=True)]
        gone = _removals(d[later], (f - base)[later], (stop - base)[later])
        rows = [(int(number) % parts, number, gone.tobytes(), None)] if len(gone) else []
        d, p, f, end, stop, k, base = (x[~later] for x in (d, p, f, end, stop, k, base))
        part = (mix(k) % np.uint64(parts)).astype(np.int32)
        o = np.argsort(part, kind="stable")
        d, p, f, end, stop, k, base, part = (x[o] for x in (d, p, f, end, stop, k, base, part))
        fields = {"key": k, "doc": ids[d], "row": d, "slice": np.full(len(d), number), "first": f - base, "before": p - f, "many": end - f + 1}
        cuts = [*_starts(part).tolist(), len(part)]
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            packed = b"".join(_pack(v[x:y], _ENTRY[c]) for c, v in fields.items())
            rows.append((int(part[x]), None, packed, _squeeze(b"".join(found.raw[u:v] for u, v in zip(f[x:y].tolist(), stop[x:y].tolist(), strict=True)))))
        return pa.Table.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _SENT, strict=True)], schema=_SENT) if rows else _SENT.empty_table()

    return run


def _removals(row: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    gone = np.zeros(len(row), _REMOVAL)
    gone["row"], gone["start"], gone["stop"] = row, start, stop
    return _merged(gone)


def _entries(blob: bytes) -> dict[str, np.ndarray]:
    n, at, out = len(blob) // sum(_ENTRY.values()), 0, {}
    for name, width in _ENTRY.items():
        out[name] = _unpack(blob[at : at + n * width], width).view(np.int64)
        at += n * width
    return out


def _merged(gone: np.ndarray) -> np.ndarray:
    """Removals with those of one document that touch made one."""
    gone = gone[np.lexsort((gone["start"], gone["row"]))]
    if not len(gone):
        return gone
    shift = gone["row"].astype(np.int64) << 32
    reach = np.maximum.accumulate(gone["stop"].astype(np.int64) + shift)
    new = np.ones(len(gone), bool)
    new[1:] = gone["start"][1:].astype(np.int64) + shift[1:] > reach[:-1]
    at = np.flatnonzero(new)
    out = gone[at]
    out["stop"] = np.maximum.reduceat(gone["stop"], at)
    return out


def _sums(data: np.ndarray, head: np.ndarray, tail: np.ndarray):
    """Contexts x to y at a time (SUM_BYTES of bytes, a longer one alone), where they begin, and running sums of their hashed bytes."""
    x = 0
    while x < len(head):
        y = max(x + 1, int(np.searchsorted(tail, head[x] + SUM_BYTES, side="right")))
        piece = data[head[x] : tail[y - 1]]
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(_BYTE[piece] * powers(_P, len(piece)), out=sums[1:])
        yield x, y, int(head[x]), sums
        x = y


def _hash_between(sums: np.ndarray, start: np.ndarray, stop: np.ndarray, seed: np.ndarray) -> np.ndarray:
    return mix((sums[stop] - sums[start]) * powers(_P_INV, len(sums))[start] + seed)


def _steps(many: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of many."""
    return np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)


def shared_parts(data: np.ndarray, head: np.ndarray, many: np.ndarray, key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The contexts that have a string in common with another document's of their key, and their first and last such string.

    Equal strings have equal hashes, so none is lost; a string too many, by chance, is one more for the sorter.
    """
    h = np.empty(int(many.sum()), np.uint64)
    ends = np.cumsum(many)
    seed = mix(key.view(np.uint64))
    for x, y, at, sums in _sums(data, head, head + many + LENGTH - 1):
        start = np.repeat(head[x:y] - at, many[x:y]) + _steps(many[x:y])
        h[ends[x] - many[x] : ends[y - 1]] = _hash_between(sums, start, start + LENGTH, np.repeat(seed[x:y], many[x:y]))
    o = np.argsort(h)
    h = h[o]
    twice = np.zeros(len(h) + 1, bool)
    twice[1:-1] = h[1:] == h[:-1]
    twice = twice[1:] | twice[:-1]
    o, h = o[twice], h[twice]
    of = np.searchsorted(ends, o, side="right")
    a, d = _starts(h), doc[of]
    if len(a):
        o = np.sort(o[np.repeat(np.minimum.reduceat(d, a) < np.maximum.reduceat(d, a), np.diff(np.append(a, len(h))))])
    of = np.searchsorted(ends, o, side="right")
    a = _starts(of)
    c, z = of[a], np.searchsorted(of, of[a], side="right") - 1
    base = ends[c] - many[c]
    return c, o[a] - base, o[z] - base


_FOUND = pa.schema([("slice", pa.int32()), ("blob", pa.binary())])


def _turns(blobs: list[bytes], texts: list[bytes], parts: int):
    """The entries of a part and their contexts, some keys at a time: PASS_BYTES of contexts a turn, on average.

    Blobs stay packed and compressed between turns; all entries of a key come in one turn.
    """
    turns = max(1, -(-sum(int.from_bytes(t[:8], "little") for t in texts) // PASS_BYTES))
    for turn in range(turns):
        each, raw = [], []
        for b, t in zip(blobs, texts, strict=True):
            e, held = _entries(b), _expand(t)
            if turns > 1:
                keep = (mix(e["key"].view(np.uint64)) // np.uint64(parts)) % np.uint64(turns) == turn
                held = np.frombuffer(held, np.uint8)[np.repeat(keep, e["many"] + LENGTH - 1)].tobytes()
                e = {c: v[keep] for c, v in e.items()}
            each.append(e)
            raw.append(held)
        yield {c: np.concatenate([e[c] for e in each]) for c in _ENTRY}, b"".join(raw)


def _settle(parts: int):
    """What the entries of each part remove, by slice; removals that slices have found themselves pass through."""

    def run(batches):
        for numbers, blobs, texts in _parts(batches, ["slice", "blob", "contexts"]):
            passed = [(n, b) for n, b in zip(numbers, blobs, strict=True) if n is not None]
            if passed:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*passed, strict=True), _FOUND, strict=True)], schema=_FOUND)
            packed = [(b, t) for n, b, t in zip(numbers, blobs, texts, strict=True) if n is None]
            if packed:
                for entry, contexts in _turns(*map(list, zip(*packed, strict=True)), parts):
                    yield from _removed(entry, contexts)

    return run


def _below(lowest: list[int], own: int) -> list[tuple[int, int]]:
    """First and last of each run of numbers below own."""
    out, at = [], None
    for i, v in enumerate(lowest):
        if v < own:
            at = i if at is None else at
        elif at is not None:
            out.append((at, i - 1))
            at = None
    return out if at is None else [*out, (at, len(lowest) - 1)]


def _removed(entry: dict[str, np.ndarray], contexts: bytes):
    """What some entries remove, by slice."""
    tail = np.cumsum(entry["many"] + LENGTH - 1)
    o = np.argsort(entry["key"], kind="stable")
    n = np.diff(np.append(_starts(entry["key"][o]), len(o)))
    live = np.sort(o[np.repeat(n > 1, n)])
    if not len(live):
        return
    key, doc, before, many, tail = (x[live] for x in (entry["key"], entry["doc"], entry["before"], entry["many"], tail))
    head = tail - many - (LENGTH - 1)
    data = np.frombuffer(contexts, np.uint8)
    whole = np.empty(len(live), np.uint64)
    for x, y, at, sums in _sums(data, head, tail):
        whole[x:y] = _hash_between(sums, head[x:y] - at, tail[x:y] - at, many[x:y].view(np.uint64))
    o = np.lexsort((doc, before, whole, key))
    a = _starts(key[o], whole[o], before[o])
    lead = np.arange(len(live))
    lead[o] = np.repeat(o[a], np.diff(np.append(a, len(o))))
    # Equal hashes only propose: the bytes decide. What differs goes on as a context of its own.
    c = np.flatnonzero(lead != np.arange(len(live)))
    differ = [contexts[u:v] != contexts[x:y] for u, v, x, y in zip(head[c].tolist(), tail[c].tolist(), head[lead[c]].tolist(), tail[lead[c]].tolist(), strict=True)]
    lead[c[differ]] = c[differ]
    c = np.flatnonzero(doc > doc[lead])
    out = [np.array([c, np.zeros(len(c), np.int64), many[c] - 1])]
    c = np.flatnonzero(lead == np.arange(len(live)))
    at, first, last = shared_parts(data, head[c], many[c], key[c], doc[c])
    c = c[at]
    o = np.argsort(key[c], kind="stable")
    c, first, last = c[o], first[o], last[o]
    cuts = [*_starts(key[c]).tolist(), len(c)]
    docs, texts = doc[c].tolist(), [contexts[u:v] for u, v in zip((head[c] + first).tolist(), (head[c] + last + LENGTH).tolist(), strict=True)]
    found: list[tuple[int, int, int]] = []
    for x, y in zip(cuts[:-1], cuts[1:], strict=True):
        by: dict[bytes, list[int]] = {}
        for k in range(x, y):
            by.setdefault(texts[k], []).append(k)
        owners = [min(docs[k] for k in same) for same in by.values()]
        least = least_owner(list(by), owners) if len(by) > 1 else [[owners[0]] * (len(texts[x]) - LENGTH + 1)]
        for same, lowest in zip(by.values(), least, strict=True):
            top = max(lowest)
            for k in same:
                found += [(k, 0, len(lowest) - 1)] if top < docs[k] else [(k, i, j) for i, j in _below(lowest, docs[k])]
    if found:
        k, i, j = np.array(found).T
        more = np.array([c[k], first[k] + i, first[k] + j])
        out.append(more)
        # A document that has a context twice loses the same of both.
        twin = np.flatnonzero((lead != np.arange(len(live))) & (doc == doc[lead]))
        if len(twin):
            more = more[:, np.argsort(more[0], kind="stable")]
            u, v = np.searchsorted(more[0], lead[twin]), np.searchsorted(more[0], lead[twin], side="right")
            more = more[:, np.repeat(u, v - u) + _steps(v - u)]
            out.append(np.array([np.repeat(twin, v - u), more[1], more[2]]))
    r, i, j = np.concatenate(out, axis=1)
    if not len(r):
        return
    r = live[r]
    number = entry["slice"][r]
    o = np.argsort(number, kind="stable")
    r, i, j, number = r[o], i[o], j[o], number[o]
    start = entry["first"][r]
    cuts = [*_starts(number).tolist(), len(number)]
    rows = [(int(number[x]), _removals(entry["row"][r[x:y]], (start + i)[x:y], (start + j + LENGTH)[x:y]).tobytes()) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _FOUND, strict=True)], schema=_FOUND)


def _remove(digests: bool):
    last = ("kept_sha256", pa.string()) if digests else ("kept", pa.binary())
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), last])

    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        ids, texts = _documents(docs)
        gone = _merged(np.frombuffer(b"".join(found.column("blob").to_pylist()), _REMOVAL))
        edge = np.searchsorted(gone["row"], np.arange(len(texts) + 1))
        rows = []
        for n, (i, t) in enumerate(zip(ids.tolist(), texts, strict=True)):
            spans, at, kept = gone[edge[n] : edge[n + 1]], 0, []
            for u, v in zip(spans["start"].tolist(), spans["stop"].tolist(), strict=True):
                kept.append(t[at:u])
                at = v
            left = b"".join([*kept, t[at:]])
            rows.append((i, len(t), len(t) - len(left), len(spans), hashlib.sha256(left).hexdigest() if digests else left))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema) if rows else schema.empty_table()

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) for each document; with digests, the SHA-256 of kept instead.

    A byte goes if a string of LENGTH bytes that covers it also starts in a
    document with a smaller id.  Null texts are empty; texts under LENGTH bytes
    lose nothing.  Documents with a null id neither lose bytes nor count as
    smaller.  Rows with one id are one another's equals: none is smaller.  Other
    columns are not read; an empty table stays empty.  A very long text makes its
    slice longer: a worker holds about 60 bytes for each of its bytes.

    Texts are dealt into slices once: all three steps read the same exchange.
    The parts in which hashes and contexts meet stand for PART_BYTES of text each or less.
    """
    spark = docs.sparkSession
    every = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    given = every.where("doc_id is not null")
    total = int(given.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    slices = max(1, min(-(-total // SLICE_BYTES), (1 << 31) - 1))
    parts, width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_BYTES)), hash_bytes(total)
    placed = given.select(F.pmod(F.xxhash64("doc_id"), F.lit(slices)).cast("int").alias("slice"), "doc_id", "text")
    sent = placed.groupBy("slice").applyInArrow(_anchor_hashes(parts, width), "part int, slice int, hashes binary, docs binary")
    known = sent.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_repeated(width), "slice int, blob binary")
    cuts = placed.groupBy("slice").cogroup(known.groupBy("slice")).applyInArrow(_contexts(parts, width), "part int, slice int, blob binary, contexts binary")
    found = cuts.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_settle(parts), "slice int, blob binary")
    last = "kept_sha256 string" if digests else "kept binary"
    out = placed.groupBy("slice").cogroup(found.groupBy("slice")).applyInArrow(_remove(digests), f"doc_id long, n_bytes long, n_removed long, n_spans long, {last}")
    left = F.sha2("text", 256).alias("kept_sha256") if digests else F.col("text").cast("binary").alias("kept")
    nameless = every.where("doc_id is null").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), left)
    return out.unionByName(nameless)


def op8_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), digests=True)
