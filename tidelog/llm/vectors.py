"""Embedding near-duplicates by a pivot-permutation index.

A vector is described by its PREFIX nearest reference points in order of
nearness.  Reference points ("pivots") are a bounded sample of the vectors
themselves, between one and two times the square root of the rows (MAX_PIVOTS at
most), drawn by hash and thinned so that no two have a
cosine above APART: a large group of near copies gives one pivot and not most.
Two vectors are candidates when they have the same nearest pivot (their home)
or share at least SHARED pivots.  Two vectors that link with one pivot have it
as their home, since all others are farther, so such a pair is never missed.
Every pair that shares SHARED pivots must meet in one of the
PREFIX - SHARED + 1 rarest pivots of either (a common order by list length), so
only those are posted to the inverted lists, and the home to a list of its own.
A list is dealt into blocks; each pair of blocks is one group, counted at the
home where that is the same and else where the pair's rarest shared posting is,
so a pair is verified once and never leaves the task: what leaves is each
vector's number of links and a spanning forest.

Rows whose length of vector has no pivots of its own share one list, compared
in blocks without an index.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Forest, cut, hint_small, runs, table
from .components import components

THRESHOLD = 0.98
#: Pivots grow with the square root of the rows, so that lists grow with it too and not with the rows; bytes bound them.
MAX_PIVOTS = 1 << 15
PIVOT_BYTES = 64 << 20
LEAST_SAMPLE = 2048
#: Scores that are held at a time.
SCORES = 1 << 20
#: Twice the angle of THRESHOLD is less than the angle of APART.
APART = 0.9
PREFIX, SHARED = 8, 4
POSTED = PREFIX - SHARED + 1
BLOCK_ROWS = 256
BROADCAST_ROWS = 500_000


def normalised(column: pa.ListArray) -> list[np.ndarray | None]:
    """Unit vectors in double precision; None for null, empty, zero or not finite ones, or with null components."""
    out = []
    for x in column:
        v = x.as_py()
        v = None if not v or any(y is None for y in v) else np.array(v, np.float64)
        if v is not None:
            top = np.abs(v).max()
            v = None if not np.isfinite(v).all() or top == 0 else v / top
            v = None if v is None else v / np.sqrt(v @ v)
        out.append(v)
    return out


def choose_pivots(vectors: DataFrame, count: int) -> dict[int, np.ndarray]:
    """Pivots by length of vector: of some more than `count` rows of least id hash the first `count` that are not close to an earlier one."""
    longest = vectors.agg(F.max(F.size("embedding"))).first()[0] or 1
    most = max(LEAST_SAMPLE, min(count + count // 2, PIVOT_BYTES // (8 * max(longest, 1))))
    rows = vectors.where("embedding is not null").select("embedding", F.xxhash64("vec_id").alias("h")).orderBy("h").limit(most).collect()
    by: dict[int, list] = {}
    for v in normalised(pa.array([r["embedding"] for r in rows], pa.list_(pa.float64()))):
        if v is not None:
            by.setdefault(len(v), []).append(v)
    apart = {d: thinned(np.array(x), count) for d, x in by.items()}
    return {d: x for d, x in apart.items() if len(x) >= PREFIX}


def thinned(units: np.ndarray, count: int) -> np.ndarray:
    """The first `count` unit vectors whose cosine with each one taken before is at most APART."""
    free, taken = np.ones(len(units), bool), []
    for i in range(len(units)):
        if free[i] and len(taken) < count:
            taken.append(i)
            free &= units @ units[i] <= APART
    return units[taken]


def nearest(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """For each unit vector its PREFIX nearest pivots, nearest first (ties: lower number first)."""
    out = np.empty((len(vectors), PREFIX), np.int32)
    step = max(1, SCORES // len(pivots))
    for a in range(0, len(vectors), step):
        scores = vectors[a : a + step] @ pivots.T
        # What is no farther than the PREFIX-th nearest, ties included, in order.
        last = np.partition(scores, len(pivots) - PREFIX, axis=1)[:, len(pivots) - PREFIX]
        for r, (row, least) in enumerate(zip(scores, last, strict=True)):
            close = np.flatnonzero(row >= least)
            out[a + r] = close[np.argsort(-row[close], kind="stable")[:PREFIX]]
    return out


_DESCRIBED = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("dim", pa.int32()), ("unit", pa.binary()), ("near", pa.list_(pa.int32()))])


def _describer(pivots: dict[int, np.ndarray]):
    def run(batches):
        for batch in batches:
            units = normalised(batch.column(1))
            near: list = [None] * len(units)
            for dim in {len(v) for v in units if v is not None} & set(pivots):
                at = [i for i, v in enumerate(units) if v is not None and len(v) == dim]
                for i, row in zip(at, nearest(np.array([units[i] for i in at]), pivots[dim]), strict=True):
                    near[i] = row
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(2),
                    pa.array([None if v is None else len(v) for v in units], pa.int32()),
                    pa.array([None if v is None else v.tobytes() for v in units], pa.binary()),
                    pa.array(near, pa.list_(pa.int32())),
                ],
                schema=_DESCRIBED,
            )

    return run


def count_links(units: np.ndarray, weight: np.ndarray, side: np.ndarray, within: bool, near: np.ndarray | None, posts: np.ndarray | None, pivot: int):
    """Links of each row to the others of its group, as sums of weights, and a spanning forest of them.

    near, posts: pivot numbers and, of these, the posted ones, in rarest-first order; None compares all pairs.
    A pair of one home (first pivot of near) counts in the list of that home alone, any other only if it shares
    SHARED pivots and if `pivot` is its rarest shared posting.
    """
    n = len(units)
    sums, forest, edges = np.zeros(n, np.int64), Forest(n), []
    step = 256
    for a in range(0, n, step):
        good = units[a : a + step] @ units[a:].T >= THRESHOLD
        good &= np.arange(a, n)[None, :] > np.arange(a, min(a + step, n))[:, None]
        if not within:
            good &= side[a : a + step, None] != side[None, a:]
        i, j = np.nonzero(good)
        i, j = i + a, j + a
        if near is not None and len(i):
            apart = near[i, 0] != near[j, 0]
            i, j = i[apart], j[apart]
            shared = (near[i][:, :, None] == near[j][:, None, :]).any(axis=2).sum(axis=1) >= SHARED
            i, j = i[shared], j[shared]
            both = (posts[i][:, :, None] == posts[j][:, None, :]).any(axis=2)
            own = posts[i, both.argmax(axis=1)] == pivot
            i, j = i[own], j[own]
        np.add.at(sums, i, weight[j])
        np.add.at(sums, j, weight[i])
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            if forest.root(x) != forest.root(y):
                forest.join(x, y)
                edges.append((x, y))
    return sums, edges


def _verify(batches):
    for group in runs(batches, ["label", "dim", "pivot", "i", "j"]):
        if group.num_rows < 2:
            continue
        i, j, pivot = (group.column(c)[0].as_py() for c in ("i", "j", "pivot"))
        ids = group.column("vec_id").to_numpy()
        units = np.frombuffer(b"".join(group.column("unit").to_pylist()), np.float64).reshape(len(ids), -1)
        # Below 0 all pairs count: -1 for vectors without pivots, -2 and less for homes.
        lists = None if pivot < 0 else [np.array(group.column(c).to_pylist()) for c in ("near", "posts")]
        sums, edges = count_links(units, group.column("weight").to_numpy(), group.column("block").to_numpy(), i == j, *(lists or (None, None)), pivot)
        linked = np.flatnonzero(sums)
        if len(linked):
            a, b = np.array(edges).T
            marks = group.column("row").to_numpy()[linked]
            columns = [np.concatenate([ids[linked], ids[a]]), [None] * len(linked) + ids[b].tolist(), [*marks.tolist(), *[None] * len(edges)], np.concatenate([sums[linked], np.zeros(len(edges), np.int64)])]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["u", "v", "row", "links"])


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", pivots: int | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Only rows with equal labels that are not null, and vectors of one length,
    are compared; null, empty, zero and not finite vectors and those with null
    components link with nothing.  Equal vectors of one label are one class:
    they link with each other and share their other links.  Ids are the nodes
    of components: rows that share an id have one component, that of all links
    of all their vectors, and each row counts the links of its own vector.  Null
    ids link with nothing (component null, kept true).  Other columns are not
    read; an empty table gives an empty result.
    """
    given = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"), F.col(label_col).cast("long").alias("label"))
    total = given.count()
    sample = choose_pivots(given, min(MAX_PIVOTS, pivots or max(64, 1 << int(total**0.5).bit_length())))
    told = cut(given.mapInArrow(_describer(sample), "vec_id long, label long, dim int, unit binary, near array<int>"))
    usable = told.where("vec_id is not null and label is not null and unit is not null")
    several = cut(told.where("vec_id is not null").groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1").select("vec_id"))
    # One row for each class; an id may stand for several, which row tells apart.
    mark = F.xxhash64("label", "unit").alias("row")
    classes = usable.groupBy("label", "unit").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("weight"), F.first("dim").alias("dim"), F.first("near").alias("near"))
    single = cut(classes.select("*", mark))
    copies = cut(single.where("weight > 1").select("label", "unit", F.col("vec_id").alias("rep"), "weight"))
    # One row for each pivot: the common order of a dimension's pivots, rarest first.
    lists: dict[int, list] = {}
    for r in single.select("dim", F.explode("near").alias("pivot")).groupBy("dim", "pivot").agg(F.count("*").alias("n")).collect():
        lists.setdefault(r["dim"], []).append((r["n"], r["pivot"]))
    orders = []
    for dim, held in lists.items():
        rank = [0] * len(sample[dim])
        for k, (_, p) in enumerate(sorted(held)):
            rank[p] = k
        orders.append((dim, rank))
    ranks = single.sparkSession.createDataFrame(orders, "dim int, rank array<int>")
    rarest = F.slice(F.transform(F.array_sort(F.transform("near", lambda p: F.struct(F.get("rank", p).alias("rank"), p.alias("pivot")))), lambda r: r["pivot"]), 1, POSTED)
    posted = single.join(F.broadcast(ranks), "dim", "left").withColumn("posts", F.when(F.col("near").isNotNull(), rarest))
    posted = posted.withColumn("pivot", F.explode(F.coalesce(F.concat("posts", F.array(-2 - F.col("near")[0])), F.array(F.lit(-1))))).drop("rank")
    sizes = cut(posted.groupBy("label", "dim", "pivot").agg(F.count("*").alias("n")).where("n > 1").select("label", "dim", "pivot", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("blocks")))
    dealt = posted.join(hint_small(sizes, BROADCAST_ROWS), ["label", "dim", "pivot"]).withColumn("block", F.pmod(F.xxhash64("vec_id", "row"), F.col("blocks")).cast("int"))
    paired = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "label", "dim", "pivot", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "vec_id", "row", "weight", "unit", "near", "posts"
    )
    keys = ["label", "dim", "pivot", "i", "j"]
    seen = cut(paired.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_verify, "u long, v long, row long, links long"))
    links = cut(seen.where("v is null").groupBy(F.col("u").alias("rep"), "row").agg(F.sum("links").alias("links")))
    edges = seen.where("v is not null").select("u", "v")
    few = hint_small(copies, BROADCAST_ROWS)
    if not several.isEmpty():
        # The classes of one id meet in it.
        mine = usable.join(hint_small(several, BROADCAST_ROWS), "vec_id", "left_semi").join(few, ["label", "unit"])
        edges = edges.unionByName(mine.select(F.col("vec_id").alias("u"), F.col("rep").alias("v")))
    found = cut(components(edges).withColumnsRenamed({"node": "rep", "component": "least"}))
    named = told.join(few, ["label", "unit"], "left").withColumn("row", F.when(F.col("label").isNotNull() & F.col("unit").isNotNull(), F.xxhash64("label", "unit")))
    named = named.select("vec_id", "row", F.when(F.col("vec_id").isNotNull(), F.coalesce("rep", "vec_id")).alias("rep"), F.when(F.col("vec_id").isNotNull(), F.col("weight") - 1).alias("own"))
    out = named.join(hint_small(links, BROADCAST_ROWS), ["rep", "row"], "left").join(hint_small(found, BROADCAST_ROWS), "rep", "left")
    component = F.coalesce("least", "rep")
    many = F.coalesce("own", F.lit(0)) + F.coalesce("links", F.lit(0))
    return out.select("vec_id", many.cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op6_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
