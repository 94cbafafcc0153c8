"""Connected components by alternating large-star and small-star rounds.

Every round is two steps, each an aggregate with map-side combining and a join
on plain (node, node) rows: no neighbour list is ever built.  What is joined has
been cut, so the join is a broadcast up to a counted size and beyond it a join
of plain reads, in which a hub with a third of all nodes can be split.  What
tells whether a round changed anything is observed while it is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, hint_small

#: Rows of (node, node) that a join may broadcast.
BROADCAST_NODES = 200_000


def _large(edges: DataFrame) -> DataFrame:
    """Each node hands its larger neighbours to its smallest one, itself included."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    return both.where("v > u").join(hint_small(least, BROADCAST_NODES), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    """Each node hands its smaller neighbours and itself to the smallest of them; edges go from the larger end."""
    least = cut(edges.groupBy("u").agg(F.min("v").alias("m")))
    own, other = F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))
    return edges.join(hint_small(least, BROADCAST_NODES), "u").select(F.explode(F.array(own, other)).alias("e")).select("e.*")


def _kept(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The distinct edges that join two nodes, cut, and what tells them from others."""
    u, v = F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    return cut(edges.where("u <> v").select(u, v).distinct(), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))


def components(edges: DataFrame, a: str = "u", b: str = "v") -> DataFrame:
    """(node, component) for every node of an edge table; component is the smallest node reachable.

    Nulls and self-links are ignored; repeated edges don't matter; nodes without
    edges are not in the result.  An empty edge table gives an empty result.
    """
    given = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u is not null and v is not null")
    now, state = _kept(given)
    while state[0]:
        grown, _ = _kept(_large(now))
        now, after = _kept(_small(grown))
        if after == state:
            break
        state = after
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
