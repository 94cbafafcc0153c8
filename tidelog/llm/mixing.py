"""Mixing sources to target weights by hash-threshold histograms.

A document's 64-bit hash is a fixed point on a line.  A source whose target is
q whole copies and a remainder takes every document q times, and once more those
whose hash lies below the source's threshold.  Thresholds for growing budgets
are nested, so a larger target never drops a document.

The threshold comes from sums of words by (source, hash bucket): the bucket in
which the running sum passes the budget is cut into finer buckets, and again,
until single hashes are left.  Only the rows of that one bucket are read at each
finer level, and no row is sorted.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, SPACE_FREE, count_runs, cut, hint_small, table, unused

SHARES = (1.0, 2.0, 3.0)
MOST = 3.0
LEVEL_BITS = 10
LEVELS = 3
SEED = 17
BROADCAST_SOURCES = 300_000


def point(doc_id: Column) -> Column:
    """The document's place on the line: a hash of its id, 0 to 2**62 - 1."""
    return F.shiftrightunsigned(F.xxhash64(doc_id, F.lit(SEED)), 2)


def ranked(sources: DataFrame) -> DataFrame:
    """The sources with their number in code point order (null last), from 0: sorted in ranges, whose sizes are summed up."""
    ordered = cut(sources.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last()).withColumn("place", F.monotonically_increasing_id()))
    part, within = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    # One row for each range.
    sizes = ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()
    starts = dict(zip([r["part"] for r in sizes], np.cumsum([0, *[r["n"] for r in sizes]]).tolist(), strict=False))
    if not starts:
        return ordered.withColumn("number", F.lit(0).cast("long")).drop("place")
    first = F.create_map(*[F.lit(x).cast("long") for p, at in starts.items() for x in (p, at)])
    return ordered.withColumn("number", first[part] + within).drop("place")


def targets(sources: DataFrame, shares: tuple = SHARES, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row a source.

    Sources in code point order, null last, weigh `shares` in turn.  The targets
    are least(most * size, level * weight) for the one level at which they sum to
    all words.  The level rises from all words over all weights: sources at their
    cap leave, the rest share what is left, until none is above.  Each turn is
    one aggregate over the sources, so their number doesn't matter.
    """
    weight = F.lit(list(shares))[F.pmod("number", F.lit(len(shares))).cast("int")]
    rows = ranked(sources).withColumn("weight", weight).withColumn("cap", F.lit(most) * F.col("source_size"))
    over, level = F.lit(False), 0.0
    while True:
        # A source's cap is reached where level * weight is no less.
        r = rows.agg(F.sum("source_size").alias("all"), F.sum(F.when(over, F.col("cap"))).alias("capped"), F.sum(F.when(~over, F.col("weight"))).alias("weight")).first()
        if not r["weight"]:
            break
        now = (r["all"] - (r["capped"] or 0.0)) / r["weight"]
        if now <= level:
            break
        level = now
        over = F.col("cap") <= F.lit(level) * F.col("weight")
    return rows.select("source", "source_size", F.least(F.col("cap"), F.lit(level) * F.col("weight")).alias("target"))


def thresholds(sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, below): documents of the source with point < below hold about `budget` words, to the nearest one.

    sized: (source, point, size); budgets: (source, budget) of the sources with a budget over 0.
    """
    shift = 62
    state = budgets.select("source", F.col("budget"), F.lit(0).cast("long").alias("base"))
    for level in range(LEVELS + 1):
        last = level == LEVELS
        inside = F.col("point") >= F.col("base") if level == 0 else (F.col("point") >= F.col("base")) & (F.col("point") < F.col("base") + F.lit(1 << shift))
        shift_now = 0 if last else shift - LEVEL_BITS
        bucket = F.shiftright(F.col("point"), shift_now)
        rows = sized.withColumnRenamed("source", "s").join(state, F.col("s").eqNullSafe(F.col("source")) & inside)
        sums = rows.groupBy("source", "budget", bucket.alias("bucket")).agg(F.sum("size").alias("words"))
        line = Window.partitionBy("source").orderBy("bucket")
        running = sums.withColumn("through", F.sum("words").over(line)).withColumn("before", F.col("through") - F.col("words"))
        passed = running.where("through > budget").groupBy("source").agg(F.min(F.struct("bucket", "budget", "before", "words")).alias("b"))
        if last:
            nearer = F.when(2 * (F.col("b.budget") - F.col("b.before")) >= F.col("b.words"), F.col("b.bucket") + 1).otherwise(F.col("b.bucket"))
            return passed.select("source", nearer.alias("below"))
        state = cut(passed.select("source", (F.col("b.budget") - F.col("b.before")).alias("budget"), F.shiftleft(F.col("b.bucket"), shift_now).alias("base")))
        shift = shift_now
    raise AssertionError


def plan_of(sized: DataFrame) -> DataFrame:
    """(of, source_size, target, copies, below), one row a source: whole copies first, then the rest as the threshold's budget."""
    sums = cut(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    ratio = F.col("target") / F.col("source_size")
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(ratio + F.lit(1e-12)), F.lit(int(MOST)))).otherwise(F.lit(0)).cast("long")
    plan = cut(targets(sums).withColumn("copies", whole).withColumn("budget", F.col("target") - F.col("copies") * F.col("source_size")))
    below = thresholds(sized.select("source", point(F.col("doc_id")).alias("point"), "size"), plan.where("budget > 0.5").select("source", "budget"))
    full = plan.join(below.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left")
    return cut(full.select(F.col("source").alias("of"), "source_size", F.col("target").cast("double").alias("target"), "copies", F.coalesce("below", F.lit(0)).alias("below")))


def sized_rows(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(doc_id, source, size), cut: one pass over the texts."""
    size = count_runs(F.col(text_col).cast("string"), SPACE)
    return cut(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size")))


def times(doc_id: Column, copies: Column, below: Column) -> Column:
    """How often the mix takes a document."""
    return F.least(copies + (point(doc_id) < below).cast("long"), F.lit(int(MOST)))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every document.

    Size: runs of non-space characters, null text 0.  Null sources are one
    source, the last.  taken is size times the copies taken, 0 to 3.  Repeated
    ids share a point, so they are taken together.  Other columns are not read;
    an empty table stays empty, and words are never split off a document.
    """
    sized = sized_rows(docs, id_col, text_col, source_col)
    joined = sized.join(hint_small(plan_of(sized), BROADCAST_SOURCES), F.col("source").eqNullSafe(F.col("of")))
    taken = F.col("size") * times(F.col("doc_id"), F.col("copies"), F.col("below"))
    return joined.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def repeat_documents(docs: DataFrame) -> DataFrame:
    """The documents as the mix takes them: none, one or more rows of each, in the columns of docs.

    Each source's threshold meets the documents where they lie: no text is
    shuffled and none is sorted.  Null, empty and wordless texts have no words
    and are not taken; null sources are one source, the last; repeated rows and
    ids share a point, so all or none of them are taken; columns of any name
    stay; an empty table stays empty.
    """
    of, copies, below, copy = unused(docs, "_of", "_copies", "_below", "_copy")
    plan = plan_of(sized_rows(docs, "doc_id", "text", "source")).select(F.col("of").alias(of), F.col("copies").alias(copies), F.col("below").alias(below))
    met = docs.where(F.col("text").rlike(SPACE_FREE)).join(hint_small(plan, BROADCAST_SOURCES), F.col("source").cast("string").eqNullSafe(F.col(of)))
    many = times(F.col("doc_id").cast("long"), F.col(copies), F.col(below)).cast("int")
    return met.where(many > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), many))).select(*docs.columns)


def op5_source_mixing(spark, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))
