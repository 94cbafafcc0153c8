"""Near-duplicate documents: fast similarity sketches, banding, exact verification.

The sketch fills its bins in rounds.  In round i < t every shingle falls into a
hashed bin with the value (i, hash); in round t + j all of them fall into bin j;
a bin keeps its least value and the rounds end when no bin is empty.  A set of
n shingles so costs about n + t log t steps, and each coordinate of two sketches
is equal with probability J.

1. One pass over the texts gives each document its set, a 128-bit digest of the
   set and the band keys.  Equal digests are one class; its smallest id stands for it.
2. Documents that share a band key with a class hang on the key's smallest id
   (an aggregate and a join); their components are the candidate clusters.
3. A cluster is compared on the full sets, and only a spanning forest of the true
   links leaves a task.  Large clusters go in blocks of bounded bytes: rows that
   link with one of a few leaders of the cluster are settled at once, and what
   is left meets in pairs of blocks, each pair once.
4. Components of those forests, carried back to the copies.

Bands: 32 of 4 rows.  A pair at exactly 0.75 is missed with probability
(1 - 0.75**4)**32 < 6e-6.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Forest, by_pieces, cut, hint_small, runs, table
from .components import components
from .hashing import document_sets_of, mix

BANDS, ROWS = 32, 4
NUMERATOR, DENOMINATOR = 75, 100
#: Hashes that are worked on at a time, and bytes of text.
STEP = 1 << 18
PIECE_BYTES = 1 << 18
BLOCK_HASHES = 150_000
BLOCK_ROWS = 300
LEADERS = 12
BROADCAST_ROWS = 200_000

_LANES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def sketches(values: np.ndarray, sizes: np.ndarray, bins: int = BANDS * ROWS) -> np.ndarray:
    """One row of `bins` values for each set; values holds the sets one after the other.

    Rows of empty sets keep the filler.  bins is a power of two of at most 128.
    """
    n = len(sizes)
    out = np.full(n * bins, _FULL, np.uint64)
    owner = np.repeat(np.arange(n), sizes)
    live = values
    for turn in range(2 * bins):
        if not len(live):
            break
        for a in range(0, len(live), STEP):
            h = mix(live[a : a + STEP] + np.uint64((turn * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64)))
            place = (h & np.uint64(bins - 1)).astype(np.int64) if turn < bins else turn - bins
            np.minimum.at(out, owner[a : a + STEP] * bins + place, (np.uint64(turn) << np.uint64(55)) | (h >> np.uint64(9)))
        left = (out.reshape(n, bins) == _FULL).any(axis=1)
        keep = left[owner]
        live, owner = live[keep], owner[keep]
    return out.reshape(n, bins)


def band_keys(sketch: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key for each band; the band's number is part of what is hashed."""
    parts = sketch.reshape(len(sketch), bands, rows)
    acc = np.zeros(parts.shape[:2], np.uint64)
    for r in range(rows):
        acc = mix(acc * _LANES[r] + parts[:, :, r])
    return mix(acc + np.arange(bands, dtype=np.uint64) * _LANES[0]).view(np.int64)


def _segment_sums(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


_FIRST = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("keys", pa.list_(pa.int64())), ("hashes", pa.binary())])


def _first(batch: pa.RecordBatch) -> pa.RecordBatch:
    values, sizes = document_sets_of(batch.column(1))
    keys = band_keys(sketches(values, sizes))
    d1 = mix(_segment_sums(mix(values ^ _LANES[1]), sizes) + sizes.astype(np.uint64)).view(np.int64)
    d2 = mix(_segment_sums(mix(values ^ _LANES[2]), sizes)).view(np.int64)
    full = sizes > 0
    offsets = np.concatenate([[0], np.cumsum(np.where(full, BANDS, 0))]).astype(np.int32)
    ends = np.concatenate([[0], np.cumsum(sizes * 8)]).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [
            batch.column(0),
            pa.array(sizes, pa.int64()),
            pa.array(d1),
            pa.array(d2),
            pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys[full].reshape(-1))),
            pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(values.tobytes())]),
        ],
        schema=_FIRST,
    )


def linked_pairs(sets: list[np.ndarray], side: np.ndarray, trees: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of sets with 100 * |both| >= 75 * |either|.

    With two values in side, pairs across them are compared; with one, all pairs.
    Sets with one number in trees are known to be joined, and are neither compared
    nor joined again.  All intersections are exact.
    """
    order = np.argsort(side, kind="stable")
    first = int((side == side[order[0]]).sum())
    across = first < len(sets)
    sizes = np.array([len(sets[k]) for k in order])
    _, inverse = np.unique(np.concatenate([sets[k] for k in order]), return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    flags = np.zeros(int(inverse.max()) + 1, np.uint8)
    root = np.arange(len(sets)) if trees is None else np.unique(trees[order], return_inverse=True)[1]
    forest, edges = Forest(len(sets)), []
    for i in range(first if across else len(sets) - 1):
        at = first if across else i + 1
        other = root[at:] != root[i]
        if not other.any():
            continue
        own = inverse[starts[i] : starts[i] + sizes[i]]
        flags[own] = 1
        shared = np.add.reduceat(flags[inverse[starts[at] :]], starts[at:] - starts[at], dtype=np.int64)
        flags[own] = 0
        good = (DENOMINATOR * shared >= NUMERATOR * (sizes[i] + sizes[at:] - shared)) & other
        for j in (np.flatnonzero(good) + at).tolist():
            a, b = int(root[i]), int(root[j])
            if forest.root(a) != forest.root(b):
                forest.join(a, b)
                edges.append((int(order[i]), int(order[j])))
    return edges


def _verify(keys: list[str]):
    def run(batches):
        for group in runs(batches, keys):
            if group.num_rows < 2:
                continue
            ids = group.column("doc_id").to_numpy()
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("hashes").combine_chunks()]
            edges = linked_pairs(sets, group.column("block").to_numpy(), group.column("tree").to_numpy())
            if edges:
                a, b = np.array(edges).T
                yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], names=["u", "v"])

    return run


def _compared(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(u, v): the forests of the groups of (keys, block, tree, doc_id, hashes)."""
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_verify(keys), "u long, v long")


def _pieces_of(rows: Column, hashes: Column) -> Column:
    return F.greatest(F.ceil(hashes / BLOCK_HASHES), F.ceil(rows / BLOCK_ROWS)).cast("int")


def cluster_links(held: DataFrame) -> DataFrame:
    """(u, v): a forest of all links between the rows of each cluster; held: (cluster, doc_id, row, n_shingles, hashes), cut.

    A cluster of one block is compared in one task.  A larger one first meets
    some LEADERS of its own rows, block by block: near copies of one text all
    join one tree so, in time linear in their number.  Then only rows of
    different trees are compared: trees that fill blocks get blocks of their
    own, which never meet one another, all other rows share blocks, and each
    pair of blocks meets once.
    """
    sized = cut(held.groupBy("cluster").agg(_pieces_of(F.count("*"), F.sum("n_shingles")).alias("blocks"), F.count("*").alias("n")))
    dealt = held.join(hint_small(sized, BROADCAST_ROWS), "cluster")
    one = dealt.where("blocks = 1").select("cluster", F.lit(0).alias("block"), F.col("row").alias("tree"), "doc_id", "hashes")
    found = cut(_compared(one, ["cluster"]))
    if sized.where("blocks > 1").isEmpty():
        return found
    large = dealt.where("blocks > 1").withColumn("at", F.pmod(F.xxhash64("row"), F.lit(1 << 30)))
    leaders = large.where(F.col("at") / float(1 << 30) * F.col("n") < LEADERS).select("cluster", "blocks", "row", "doc_id", "hashes")
    met = large.select("cluster", F.pmod("at", "blocks").cast("int").alias("part"), F.lit(1).alias("block"), F.col("row").alias("tree"), "doc_id", "hashes").unionByName(
        leaders.select("cluster", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"), F.lit(0).alias("block"), F.col("row").alias("tree"), "doc_id", "hashes")
    )
    begun = cut(_compared(met, ["cluster", "part"]))
    trees = cut(components(begun).withColumnsRenamed({"node": "doc_id", "component": "tree"}))
    rest = large.join(hint_small(trees, BROADCAST_ROWS), "doc_id", "left").withColumn("tree", F.coalesce("tree", "doc_id"))
    rest = cut(rest.select("cluster", "row", "doc_id", "n_shingles", "hashes", "tree"))
    kinds = rest.groupBy("cluster", "tree").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("total"))
    kinds = kinds.withColumn("full", F.col("n") >= BLOCK_ROWS).groupBy("cluster", "full", F.when(F.col("full"), F.col("tree")).alias("of")).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    kinds = cut(kinds.select("cluster", "full", "of", _pieces_of(F.col("n"), F.col("total")).alias("blocks")))
    # The blocks of a cluster: a few hundred rows each, so far fewer than rows.
    line = cut(kinds.select("cluster", "of", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("k")).groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("of", "k"))).alias("line")))
    line = line.where((F.size("line") > 1) & F.exists("line", lambda x: ~x["of"].eqNullSafe(F.col("line")[0]["of"]) | x["of"].isNull()))
    full = kinds.where("full").select("cluster", F.col("of").alias("tree"), F.col("blocks").alias("own"))
    loose = kinds.where("not full").select("cluster", F.col("blocks").alias("shared"))
    placed = rest.join(hint_small(full, BROADCAST_ROWS), ["cluster", "tree"], "left").join(hint_small(loose, BROADCAST_ROWS), "cluster", "left").join(hint_small(cut(line), BROADCAST_ROWS // 100), "cluster")
    of = F.when(F.col("own").isNotNull(), F.col("tree"))
    placed = placed.withColumn("of", of).withColumn("block", (F.array_position("line", F.struct(F.col("of"), F.pmod(F.xxhash64("row"), F.coalesce("own", "shared")).cast("int").alias("k"))) - 1).cast("int"))
    others = F.array_compact(F.transform("line", lambda x, i: F.when(x["of"].isNull() | ~x["of"].eqNullSafe(F.col("of")), i)))
    paired = placed.withColumn("other", F.explode(others)).select("cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "tree", "doc_id", "hashes")
    return cut(found.unionByName(begun).unionByName(_compared(paired, ["cluster", "i", "j"])))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every document.

    Words are runs of non-space characters, A-Z lower-cased; a set holds the
    distinct five-word shingles, or the whole sequence when there are fewer
    words.  Null or wordless texts have an empty set and link with nothing.
    Rows with a null id are left out of groups: they come back with a null
    component and kept = true.  Ids are the nodes: rows that share an id have
    one component, that of all links of all their texts.  Texts are compared
    class by class (a class: all rows of one set), so no link of any of them is
    lost.  Other columns are not read; an empty table gives an empty result.  A
    worker holds about 8 bytes for each word of the longest text, three times.
    """
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, n_shingles long, d1 long, d2 long, keys array<long>, hashes binary"
    first = cut(given.mapInArrow(by_pieces(_first, "text", PIECE_BYTES), schema))
    alive = first.where("n_shingles > 0 and doc_id is not null")
    several = cut(first.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    copies = cut(alive.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).where("n > 1").drop("n"))
    few = hint_small(copies, BROADCAST_ROWS)
    single = alive.join(few, ["d1", "d2"], "left").where("rep is null or rep = doc_id").drop("rep")
    repeated = not several.isEmpty()
    if repeated:
        again = hint_small(several, BROADCAST_ROWS)
        single = cut(single.join(again, "doc_id", "left_anti").unionByName(single.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "d1", "d2"])))
    banded = single.select("doc_id", F.posexplode("keys").alias("band", "key"))
    heads = cut(banded.groupBy("band", "key").agg(F.min("doc_id").alias("head"), F.count("*").alias("n")).where("n > 1").drop("n"))
    stars = banded.join(hint_small(heads, BROADCAST_ROWS), ["band", "key"]).select(F.col("doc_id").alias("u"), F.col("head").alias("v"))
    clusters = cut(components(stars.where("u <> v")).withColumnsRenamed({"node": "doc_id", "component": "cluster"}))
    held = cut(single.join(hint_small(clusters, BROADCAST_ROWS), "doc_id").select("cluster", "doc_id", F.col("d1").alias("row"), "n_shingles", "hashes"))
    links = cluster_links(held)
    if repeated:
        mine = alive.join(again, "doc_id", "left_semi").join(few, ["d1", "d2"]).where("rep <> doc_id")
        links = cut(links.unionByName(mine.select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))))
    found = cut(components(links).withColumnsRenamed({"node": "rep", "component": "least"}))
    named = first.select("doc_id", "n_shingles", "d1", "d2").join(few, ["d1", "d2"], "left")
    named = named.withColumn("rep", F.when(F.col("n_shingles") > 0, F.coalesce("rep", "doc_id")).otherwise(F.col("doc_id")))
    out = named.join(hint_small(found, BROADCAST_ROWS), "rep", "left").withColumn("component_id", F.coalesce("least", "rep"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op3_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
