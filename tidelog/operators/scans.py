"""Scans of an offset-ordered log: bounds, positions by time, holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bounded(log: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Records of [start_off, end_off) of each range; end_off of 0 or less is unbounded. An equi-join on keys carries the range test."""
    inside = (F.col("off") >= F.col("start_off")) & ((F.col("end_off") <= 0) | (F.col("off") < F.col("end_off")))
    return ranges.join(log, keys).where(inside)


def bounded_sums(log: DataFrame, ranges: DataFrame, groups: list[str], keys: list[str], value: str) -> DataFrame:
    """Number and sum of the records of each range in each group, without meeting a record twice.

    Running totals by offset make a range's sum the difference of two of them: its
    ends are put into the log as marks, one for each distinct end, and a frame over
    the ordered offsets gives the totals before them.  Work is that of a sort of
    log and ends, however long or many the ranges are.  An end of 0 or less is the log's.
    """
    top = F.lit((1 << 63) - 1)
    end = F.when(F.col("end_off") <= 0, top).otherwise(F.greatest("end_off", "start_off"))
    bounds = ranges.select(*keys, "range_id", F.col("start_off").alias("a"), end.alias("b"))
    marks = bounds.select(*keys, F.explode(F.array("a", "b")).alias("off")).distinct()
    # A mark stands before the record of its offset; each group has all marks of its keys.
    of = log.select(*groups, *keys).distinct()
    line = log.select(*groups, *keys, "off", F.lit(1).alias("n"), F.col(value).alias("x")).unionByName(marks.join(of, keys).select(*groups, *keys, "off", F.lit(0).alias("n"), F.lit(0).cast("long").alias("x")))
    upto = Window.partitionBy(*groups, *keys).orderBy("off", "n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = line.withColumns({"count": F.sum("n").over(upto), "sum": F.sum("x").over(upto)}).where("n = 0").select(*groups, *keys, "off", "count", "sum")
    first = bounds.join(totals.withColumnsRenamed({"off": "a", "count": "c0", "sum": "s0"}), [*keys, "a"])
    both = first.join(totals.withColumnsRenamed({"off": "b", "count": "c1", "sum": "s1"}), [*groups, *keys, "b"])
    return both.select("range_id", *groups, (F.col("c1") - F.col("c0")).alias("n"), (F.col("s1") - F.col("s0")).alias("total")).where("n > 0")


def watermarks(log: DataFrame) -> DataFrame:
    return log.groupBy("topic", "part").agg(F.min("off").alias("low"), (F.max("off") + 1).alias("high"))


def offsets_for_times(log: DataFrame, start_ms: int, end_ms: int) -> DataFrame:
    """First offset at or after each time; the end falls back to the high watermark, the start to the end."""
    if not 0 <= start_ms <= end_ms:
        raise ValueError("times must satisfy 0 <= start <= end")
    at = lambda t: F.min(F.when(F.col("ts_ms") >= t, F.col("off")))
    found = log.groupBy("topic", "part").agg(at(start_ms).alias("s"), F.coalesce(at(end_ms), F.max("off") + 1).alias("end_off"))
    return found.select("topic", "part", F.coalesce("s", "end_off").alias("start_off"), "end_off")


def released(log: DataFrame, delay_ms: int, now_ms: int) -> DataFrame:
    """Records whose hold is over and before which none is held."""
    latest = F.max("ts_ms").over(Window.partitionBy("topic", "part").orderBy("off"))
    return log.withColumn("latest", latest).where(F.col("latest") + delay_ms <= now_ms).drop("latest")


def post_commits(jobs: DataFrame, now_ms: int, within_ms: int = 3_600_000) -> DataFrame:
    """Canceled jobs whose range is empty but not at 0, of groups that ended no longer ago than that: their end is committed."""
    return jobs.where((F.col("start_off") == F.col("end_off")) & (F.col("end_off") > 0) & (F.col("state") == "CANCELED") & (F.lit(now_ms) - F.col("end_ms") <= within_ms))


def numbered(df: DataFrame, order: str, result: str) -> DataFrame:
    """Rows numbered from 0 in one order: sorted in ranges, each numbered by itself after the sizes of those before it.

    The sorted rows are kept, so that both passes see the same ranges.
    """
    held = df.repartitionByRange(order).sortWithinPartitions(order).withColumn("_place", F.monotonically_increasing_id()).persist()
    part = F.shiftright("_place", 33)
    # One row for each range.
    sizes = sorted((r["part"], r["n"]) for r in held.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    starts, total = [], 0
    for p, n in sizes:
        starts += [F.lit(p).cast("long"), F.lit(total).cast("long")]
        total += n
    first = F.create_map(*starts)[part] if starts else F.lit(0).cast("long")
    return held.withColumn(result, first + F.col("_place").bitwiseAND((1 << 33) - 1)).drop("_place")
