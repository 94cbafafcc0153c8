"""Document fingerprints: one-permutation MinHash with optimal densification.

Every five-word shingle is hashed once; the low bits of the hash choose one of
BINS bins, which keeps its least remainder.  An empty bin copies the first full
bin that a 2-universal hash of (bin, attempt) names, so two sketches fill alike
bins alike and the estimate stays unbiased.  Only BITS bits of each bin are
stored, packed and in hexadecimal.  Likeness corrects for chance agreement of
those bits: (share - 2**-BITS) / (1 - 2**-BITS), not below 0.

The edited text of a document takes its next document in descending id order;
neighbours are found by dealing rows into id ranges of equal numbers, with the
first row of each range copied to the range before it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, pieces, table
from .hashing import document_shingles, mix

BINS, BITS = 256, 4
#: Hashes that are placed at a time; bytes of text for each id range, and how many ranges there are at most (texts
#: stream through a range, so a larger one takes longer and no more memory).
STEP = 1 << 20
RANGE_BYTES = 128 << 20
MOST_RANGES = 50_000
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def _probes() -> np.ndarray:
    """Row a: the bin that each bin asks in its attempt a."""
    cells = np.arange(64 * BINS, dtype=np.uint64)
    return (mix(cells * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x51ED270B)) % np.uint64(BINS)).astype(np.int64).reshape(64, BINS)


_PROBES = _probes()
_LANE = np.arange(BINS, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)


def densify(bins: np.ndarray) -> np.ndarray:
    """Fill the empty bins of each row; rows without any full bin stay as they are."""
    empty = bins == EMPTY
    rows, cols = np.nonzero(empty & ~empty.all(axis=1)[:, None])
    out = bins.copy()
    attempt = 0
    while len(rows):
        if attempt < len(_PROBES):
            ask = _PROBES[attempt][cols]
        else:  # a row with one full bin of 256 may need more attempts than the table holds
            ask = (mix((cols + BINS * attempt).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x51ED270B)) % np.uint64(BINS)).astype(np.int64)
        hit = ~empty[rows, ask]
        out[rows[hit], cols[hit]] = bins[rows[hit], ask[hit]]
        rows, cols = rows[~hit], cols[~hit]
        attempt += 1
    return out


def fingerprints(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Packed fingerprints (BINS * BITS / 8 bytes a row); a document without words has zero bytes throughout."""
    n = len(counts)
    bins = np.full(n * BINS, EMPTY, np.uint64)
    owner = np.repeat(np.arange(n), counts)
    for a in range(0, len(values), STEP):
        part = values[a : a + STEP]
        np.minimum.at(bins, owner[a : a + STEP] * BINS + (part & np.uint64(BINS - 1)).astype(np.int64), part >> np.uint64(8))
    full = densify(bins.reshape(n, BINS))
    # The bin is hashed along: copies of one value then agree by chance in each bin on its own.
    low = (mix(full + _LANE) & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    low[counts == 0] = 0
    return (low[:, 0::2] << 4) | low[:, 1::2]


def likeness(a: np.ndarray, b: np.ndarray, none_a: np.ndarray, none_b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard likeness of rows of packed fingerprints; 1 for two wordless texts, 0 for one."""
    x = a ^ b
    same = ((x >> 4) == 0).sum(axis=1) + ((x & 15) == 0).sum(axis=1)
    chance = 2.0**-BITS
    out = np.clip((same / BINS - chance) / (1 - chance), 0.0, 1.0)
    out[none_a ^ none_b] = 0.0
    out[none_a & none_b] = 1.0
    return out


def fingerprint_text(text: str | None) -> str:
    return fingerprints(*document_shingles([text]))[0].tobytes().hex()


_SPEC = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _finish(ids: list, texts: list[str]) -> pa.RecordBatch:
    """Rows of all texts but the last, which is only the neighbour of the one before it."""
    edited = [_edited(a, b) for a, b in zip(texts[:-1], texts[1:], strict=True)]
    values, counts = document_shingles([*texts, *edited])
    prints = fingerprints(values, counts)
    none = counts == 0
    n = len(edited)
    own, nxt, alt = prints[:n], prints[1 : n + 1], prints[n + 1 :]
    hexes = lambda p: [r.tobytes().hex() for r in p]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids[:n], pa.int64()),
            pa.array([len(t) for t in texts[:n]], pa.int64()),
            pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited]),
            pa.array(hexes(own)),
            pa.array(hexes(alt)),
            pa.array(likeness(own, alt, none[:n], none[n + 1 :])),
            pa.array(likeness(own, nxt, none[:n], none[1 : n + 1])),
        ],
        schema=pa.schema(_SPEC),
    )


def _chain(batches):
    """Rows come sorted by range and then order; the first copied row closes its range, later copies repeat its id."""
    ids, texts, held, at, closed = [], [], 0, None, False
    for batch in batches:
        for piece in pieces(batch, "text"):
            for cell, copy, i, t in zip(*(piece.column(c).to_pylist() for c in range(4)), strict=True):
                if cell != at:
                    if len(ids) > 1:
                        yield _finish(ids, texts)
                    ids, texts, held, at, closed = [], [], 0, cell, False
                if closed:
                    continue
                closed = bool(copy)
                ids.append(i)
                texts.append(t)
                held += len(t)
                if held > 1 << 20 and len(ids) > 1:
                    yield _finish(ids, texts)
                    ids, texts, held = ids[-1:], texts[-1:], len(t)
    if len(ids) > 1:
        yield _finish(ids, texts)


def fingerprint_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness, and that to the next text.

    Order: id descending, nulls last, equal ids by the text's hash.  A single
    row is its own next document.  Null texts are empty.  Repeated rows stand
    next to each other.  Other columns are not read; an empty table gives an
    empty result.  A worker holds a very long text and its edited one, and
    hashes of 8 bytes a word.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    rank = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)).cast("long"))
    keyed = docs.select(rank.alias("k"))
    total = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    cells = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), min(total // RANGE_BYTES, MOST_RANGES))
    shares = [i / cells for i in range(1, cells)]
    found = np.array(keyed.agg(F.percentile_approx("k", shares, F.lit(20 * cells)).alias("c")).first()["c"] or [], np.int64)
    if not len(found):
        return spark.createDataFrame([], SCHEMA)
    cuts, many = np.unique(found, return_counts=True)
    before = np.concatenate([[0], np.cumsum(many)])

    @F.pandas_udf("int")
    def cell_of(k: pd.Series, tie: pd.Series) -> pd.Series:
        """Ranges of descending order; an id (or the null ids) that several cuts fall on is split by the hash of its texts."""
        at = np.searchsorted(cuts, k.to_numpy(), side="left")
        own = np.minimum(at, len(cuts) - 1)
        hot = np.where((at < len(cuts)) & (cuts[own] == k.to_numpy()), many[own], 1)
        part = np.minimum(np.floor((tie.to_numpy().astype(np.float64) / 2.0**64 + 0.5) * hot), hot - 1)
        return pd.Series((before[-1] - before[at] - part).astype(np.int32))

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # Without an id of that many rows the texts need not be read to find the ranges.
    hashed = F.xxhash64(text) if (many > 1).any() else F.lit(0).cast("long")
    mark = F.struct("k", "mark")
    marked = docs.select(rank.alias("k"), hashed.alias("mark")).withColumn("cell", cell_of("k", "mark"))
    # The last row of each range in ascending order, a row a range, tells whose copy closes the range before; the first range closes the last.
    tops = {r["cell"]: r["top"] for r in marked.groupBy("cell").agg(F.max(mark).alias("top")).collect()}
    order = sorted(tops)
    first = spark.createDataFrame([(tops[c]["k"], tops[c]["mark"], order[i - 1]) for i, c in enumerate(order)], "k long, mark long, prior int")
    placed = docs.select(F.col(id_col).cast("long").alias("doc_id"), rank.alias("k"), text.alias("text"), hashed.alias("mark")).withColumn("cell", cell_of("k", "mark"))
    own = F.struct(F.col("cell").alias("cell"), F.lit(0).alias("copy"))
    closing = F.struct(F.col("prior").alias("cell"), F.lit(1).alias("copy"))
    to = F.when(F.col("prior").isNull(), F.array(own)).otherwise(F.array(own, closing))
    # One row for each range.
    sent = placed.join(F.broadcast(first), ["k", "mark"], "left").select("doc_id", "k", "text", F.explode(to).alias("to")).select("to.*", "doc_id", "k", "text")
    dealt = sent.withColumn("tie", F.xxhash64("text")).repartition("cell").sortWithinPartitions("cell", "copy", F.desc("k"), F.desc("tie"))
    return dealt.select("cell", "copy", "doc_id", "text").mapInArrow(_chain, SCHEMA)


def op9_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprint_neighbours(table(spark, sf_dir, "documents"))
