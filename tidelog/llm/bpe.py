"""Byte-level BPE as a bounded-lookahead streaming transducer, and its inverse.

Sufficient lookahead.  Whether a merge r = (u, v) happens at a place depends on
the text to its right only through a merge r' = (x, y) of higher priority that
takes the right end of v first, so x lies on v's right spine; whether r' happens
depends on the text after y in the same way.  Priorities rise strictly along
such a chain, so the farthest reach of every merge follows from the merges
before it in one pass over the list.  A merge across the end of a token t starts
with a token u on t's right spine; the farthest reach of these merges is t's
wait.  With that many bytes after it, the end of t never changes, and so
nothing before it does.

A text goes through windows: pieces whose end is certain leave the splitter, and
each piece goes through the transducer, which emits tokens whose end is certain,
drops their bytes and takes more.  Memory does not grow with the piece or, but
for the text itself, with the text.  (A boundary of the final segmentation
splits the work into independent halves, so the transducer may restart at one.)
Short pieces that come again are remembered.

Decoding keeps only the bytes of an unfinished UTF-8 sequence between tokens.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, pieces, table

#: Fixed values of the byte-level pre-tokenizer: the published split pattern; L, N, S stand for the Unicode
#: properties Letter, Number and White_Space, written out as ranges (the re module is faster with these).
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d| ?[L]+| ?[N]+| ?[^SLN]+|[S]+(?![^S])|[S]+"
REMEMBERED = 150_000
SHORT = 48
#: Characters of a text that are split at a time; a piece's end is certain with MARGIN characters after it in the window.
WINDOW, MARGIN = 1 << 15, 3
#: Bytes that the transducer takes at a time.
STEP = 256


def byte_alphabet() -> list[str]:
    """The character that stands for each byte in vocabulary files: itself if printable, else the next from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def _ranges(name: str) -> str:
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    return "".join(f"\\U{ord(r[0]):08x}-\\U{ord(r[-1]):08x}" for run in regex.findall(rf"\p{{{name}}}+", every) for r in _consecutive(run))


def _consecutive(run: str) -> list[str]:
    """The string cut where its code points leave the surrogate gap."""
    at = next((i for i in range(1, len(run)) if ord(run[i]) != ord(run[i - 1]) + 1), None)
    return [run] if at is None else [run[:at], run[at:]]


def split_pattern() -> str:
    sets = {"L": _ranges("L"), "N": _ranges("N"), "S": _ranges("White_Space")}
    return "".join(sets.get(c, c) for c in SPLIT)


class Transducer:
    """Encoder and decoder for one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = {c: b for b, c in enumerate(byte_alphabet())}
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        self.start = [vocab[c] for c in byte_alphabet()]
        self.merge = {}
        for rank, (a, b) in enumerate(merges):
            self.merge.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.rank = {pair: rank for pair, (rank, _) in self.merge.items()}
        self.made, self.none = [vocab[a + b] for a, b in merges], len(merges)
        raw = {i: bytes(to_byte[c] for c in t) for t, i in vocab.items() if all(c in to_byte for c in t)}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        raw |= {i: t.encode() for t, i in self.special.items()}
        self.bytes = [raw.get(i, b"") for i in range(max(raw) + 1)]
        self.wait = self._waits()
        self.lookahead = max(self.wait, default=0)
        splitter = re.compile(split_pattern())
        self._pieces, self._piece = splitter.findall, splitter.match
        self._cut = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))) if self.special else None
        self._known: dict[str, tuple] = {}  # two generations of at most REMEMBERED pieces each
        self._older: dict[str, tuple] = {}

    def _waits(self) -> list[int]:
        """For each token the bytes after its end from which on that end is certain."""
        size = {i: len(b) for i, b in enumerate(self.bytes)}
        spine: dict[int, tuple] = {i: (i,) for i in self.start}
        best: dict[int, int] = {}
        for (a, b), (_, new) in sorted(self.merge.items(), key=lambda m: m[1][0]):
            on = spine.get(b, (b,))
            reach = size[b] + max((best.get(x, 0) for x in on), default=0)
            spine[new] = tuple(dict.fromkeys((*spine.get(new, ()), new, *on)))
            best[a] = max(best.get(a, 0), reach)
        return [max((best.get(x, 0) for x in spine.get(i, (i,))), default=0) for i in range(len(self.bytes))]

    def _merge_short(self, ids: list[int]) -> list[int]:
        get, none = self.rank.get, self.none
        ranks = [get(pair, none) for pair in zip(ids, ids[1:])]  # noqa: B905
        while ranks:
            least = min(ranks)
            if least == none:
                break
            at = ranks.index(least)
            ids[at] = self.made[least]
            del ids[at + 1], ranks[at]
            if at:
                ranks[at - 1] = get((ids[at - 1], ids[at]), none)
            if at < len(ranks):
                ranks[at] = get((ids[at], ids[at + 1]), none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        n, get = len(ids), self.merge.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, m[1], ids[i], ids[i + 1]) for i in range(n - 1) if (m := get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if m := get((new, ids[k])):
                    heapq.heappush(heap, (m[0], i, m[1], new, ids[k]))
            h = before[i]
            if h >= 0 and (m := get((ids[h], new))):
                heapq.heappush(heap, (m[0], h, m[1], ids[h], new))
        return [x for x in ids if x >= 0]

    def _whole(self, raw: bytes) -> list[int]:
        start = self.start
        ids = [start[b] for b in raw]
        return self._merge_short(ids) if len(ids) <= SHORT else self._merge_long(ids)

    def stream(self, chunks: Iterable[bytes]) -> Iterator[int]:
        """Token ids of one piece that comes in chunks, each as soon as its end is certain.

        Holds lookahead + two steps of bytes at most, besides a chunk.  All tokens before a certain end are certain.
        """
        wait, size, held, goal = self.wait, self.bytes, b"", STEP
        for chunk in chunks:
            for at in range(0, len(chunk), STEP):
                held += chunk[at : at + STEP]
                if len(held) < goal:
                    continue
                ids = self._whole(held)
                done = count = end = 0
                for k, t in enumerate(ids, 1):
                    end += len(size[t])
                    if end + wait[t] <= len(held):
                        done, count = end, k
                yield from ids[:count]
                held = held[done:]
                goal = len(held) + STEP
        yield from self._whole(held)

    def encode_piece(self, piece: str) -> list[int]:
        return list(self.stream((piece.encode("utf-8"),)))

    def encode_stream(self, text: str) -> Iterator[array]:
        """Ids of a text, window by window; strings of special tokens in it become their ids.

        What ends within MARGIN characters of a window's end may go on beyond it and waits for the next window; a piece
        that fills a window goes to the transducer in chunks.
        """
        for start, stop, token in self._parts(text):
            at = start
            while at < stop:
                to = min(stop, at + WINDOW)
                found = self._pieces(text[at:to])
                held = 0
                while to < stop and found and held < MARGIN:
                    held += len(found.pop())
                if found:
                    yield self._ids(found)
                    at = to - held
                else:
                    end = self._piece(text, at, stop).end()
                    ids = self.stream(text[k : min(end, k + WINDOW)].encode("utf-8") for k in range(at, end, WINDOW))
                    while some := array("I", islice(ids, WINDOW)):
                        yield some
                    at = end
            if token is not None:
                yield array("I", [token])

    def _ids(self, found: list[str]) -> array:
        out: list[int] = []
        known = self._known
        for piece in found:
            ids = known.get(piece)
            if ids is None:
                ids = self._older.get(piece) or tuple(self.encode_piece(piece))
                if len(piece) <= SHORT:
                    if len(known) >= REMEMBERED:
                        self._older, self._known = known, {}
                        known = self._known
                    known[piece] = ids
            out += ids
        return array("I", out)

    def encode(self, text: str) -> array:
        out = array("I")
        for ids in self.encode_stream(text):
            out += ids
        return out

    def _parts(self, text: str) -> Iterator[tuple[int, int, int | None]]:
        at = 0
        if self._cut is not None:
            for m in self._cut.finditer(text):
                yield at, m.start(), self.special[m[0]]
                at = m.end()
        yield at, len(text), None

    def decoder(self) -> Decoder:
        return Decoder(self.bytes)

    def decode_stream(self, ids: Iterable[int], batch: int = 4096) -> Iterator[str]:
        """Text as it becomes certain; malformed bytes become U+FFFD. Ids outside the vocabulary give nothing."""
        machine, ids = self.decoder(), iter(ids)
        while some := list(islice(ids, batch)):
            yield machine.feed(some)
        yield machine.end()

    def decode(self, ids: Iterable[int]) -> str:
        return "".join(self.decode_stream(ids))


class Decoder:
    """Ids to text; between calls it holds the bytes of an unfinished character only."""

    def __init__(self, names: list[bytes]):
        self.names, self.top = names, len(names)
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        names, top = self.names, self.top
        return self.machine.decode(b"".join([names[i] for i in ids if 0 <= i < top]))

    def end(self) -> str:
        return self.machine.decode(b"", final=True)


_loaded: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """One transducer for each file and process."""
    if path not in _loaded:
        _loaded[path] = Transducer(path)
    return _loaded[path]


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


SCHEMA = "doc_id long, ids array<int>, decoded string"
DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _texts(batches):
    for batch in batches:
        for piece in pieces(batch, "text"):
            yield piece.column(0), piece.column(1).to_pylist()


def _given(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    bound_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def tokenize(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded): the whole text's ids, and the text that they decode to.

    Null texts are empty and give no ids; rows with null or repeated ids are
    kept as they are; other columns are not read; an empty table stays empty.  A
    very long text is held once, and its ids and decoded text as they leave.
    """
    path = path or tokenizer_path()

    def run(batches):
        t = transducer(path)
        for ids, texts in _texts(batches):
            made = [t.encode(x) for x in texts]
            yield pa.RecordBatch.from_arrays([ids, pa.array([m.tolist() for m in made], pa.list_(pa.int32())), pa.array([t.decode(m) for m in made])], names=["doc_id", "ids", "decoded"])

    return _given(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def tokenize_digests(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As tokenize, with SHA-256 digests of the ids (little-endian, 32 bits each) and of the decoded text.

    Ids and decoded text go into the digests window by window: a very long text is held, its ids are not.
    """
    path = path or tokenizer_path()

    def run(batches):
        t = transducer(path)
        for ids, texts in _texts(batches):
            counts, id_hash, text_hash = [], [], []
            for x in texts:
                n, id_sum, text_sum, machine = 0, hashlib.sha256(), hashlib.sha256(), t.decoder()
                for made in t.encode_stream(x):
                    n += len(made)
                    id_sum.update(little_endian(made))
                    text_sum.update(machine.feed(made).encode("utf-8"))
                text_sum.update(machine.end().encode("utf-8"))
                counts.append(n)
                id_hash.append(id_sum.hexdigest())
                text_hash.append(text_sum.hexdigest())
            yield pa.RecordBatch.from_arrays([ids, pa.array(counts, pa.int64()), pa.array(id_hash, pa.string()), pa.array(text_hash, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _given(docs, id_col, text_col).mapInArrow(run, DIGEST)


def little_endian(ids: array) -> bytes:
    if array("H", [1]).tobytes() == b"\x01\x00":
        return ids.tobytes()
    copy = array(ids.typecode, ids)
    copy.byteswap()
    return copy.tobytes()


def op2_bpe(spark, sf_dir: str) -> DataFrame:
    return tokenize_digests(table(spark, sf_dir, "documents"))
