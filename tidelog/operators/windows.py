"""Windowed statistics: sliding buckets, bounded histograms, rates, latencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ring(df: DataFrame, keys: list[str], ts: str, width_ms: int, buckets: int, value: str, how: str) -> DataFrame:
    """Aggregate of the last `buckets` aligned buckets, for every bucket with rows: buckets are aggregated before the frame runs."""
    b = df.groupBy(*keys, F.expr(f"{ts} div {width_ms}").alias("bucket")).agg(F.max(value).alias("mx"), F.min(value).alias("mn"), F.sum(value).alias("sm"), F.count(value).alias("ct"))
    w = Window.partitionBy(*keys).orderBy("bucket").rangeBetween(-(buckets - 1), 0)
    made = {"max": F.max("mx").over(w), "min": F.min("mn").over(w), "avg": F.sum("sm").over(w) / F.sum("ct").over(w)}
    return b.select(*keys, "bucket", made[how].alias(how))


def histogram_bucket(value: Column, low: Column, high: Column, buckets: int) -> Column:
    """clamp(ceil((v - low) / width), 0, n - 1); everything is in bucket 0 when the bounds meet."""
    width = (high - low) / buckets
    return F.when(high <= low, F.lit(0)).otherwise(F.least(F.lit(buckets - 1), F.greatest(F.lit(0), F.ceil((value - low) / width)))).cast("int")


def histogram_percentile(df: DataFrame, keys: list[str], value: str, low: float, high: float, p: float, buckets: int = 100) -> DataFrame:
    """Lower edge of the first bucket whose running count reaches int(p * n); with a pivot of 0 the lower bound."""
    counts = df.groupBy(*keys, histogram_bucket(F.col(value), F.lit(low), F.lit(high), buckets).alias("b")).agg(F.count("*").alias("c"))
    every = Window.partitionBy(*keys)
    run = counts.withColumn("cum", F.sum("c").over(every.orderBy("b"))).withColumn("pivot", F.floor(F.lit(p) * F.sum("c").over(every)))
    first = run.where("cum >= pivot").groupBy(*keys).agg(F.min("b").alias("b"), F.min("pivot").alias("pivot"))
    edge = F.lit(low) + F.col("b") * F.lit((high - low) / buckets)
    return first.select(*keys, F.when(F.col("pivot") <= 0, F.lit(float(low))).otherwise(edge).alias("percentile"))


def ewma(df: DataFrame, keys: list[str], ts: str, tick_ms: int = 5_000, minute_ms: int = 60_000) -> DataFrame:
    """One-minute moving average of events a second at each key's last tick, in closed form.

    The first tick seeds the rate; every later one moves it by alpha towards its own
    rate, ticks without events towards 0. So the sum of (1-alpha)^age counts, with
    alpha on all but the first tick, is the same number.
    """
    import math

    alpha = 1 - math.exp(-tick_ms / minute_ms)
    ticks = df.groupBy(*keys, F.expr(f"{ts} div {tick_ms}").alias("tick")).agg(F.count("*").alias("n"))
    ends = ticks.groupBy(*keys).agg(F.min("tick").alias("t0"), F.max("tick").alias("t1"))
    rate = F.col("n") / (tick_ms / 1000.0)
    weight = F.when(F.col("tick") == F.col("t0"), F.lit(1.0)).otherwise(F.lit(alpha)) * F.pow(F.lit(1 - alpha), F.col("t1") - F.col("tick"))
    return ticks.join(ends, keys).groupBy(*keys).agg(F.sum(rate * weight).alias("rate"))


def reflected(df: DataFrame, keys: list[str], order: list[str], change: str, result: str) -> DataFrame:
    """A balance before each row that starts at 0, moves by `change` and never falls below 0.

    It is the running sum less its lowest value so far (0 at most): two frames over
    one order, so nothing is folded row by row.
    """
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    plain = df.withColumn("_sum", F.sum(change).over(w))
    least = plain.withColumn("_low", F.least(F.lit(0), F.min("_sum").over(w))).withColumn("_after", F.col("_sum") - F.col("_low"))
    return least.withColumn(result, F.coalesce(F.lag("_after").over(Window.partitionBy(*keys).orderBy(*order)), F.lit(0))).drop("_sum", "_low", "_after")


def recent(df: DataFrame, keys: list[str], ts: str, span: int, marked: Column, result: str) -> DataFrame:
    """Whether a marked row of the key lies at or up to `span` before each row.

    Rows are dealt by key and span-long bucket, and marks are copied to the bucket
    after their own, so a busy key is as many tasks as it has buckets.
    """
    rows = df.withColumn("_bucket", F.expr(f"{ts} div {span}")).withColumn("_mark", F.when(marked, F.col(ts))).withColumn("_own", F.lit(True))
    later = rows.where(F.col("_mark").isNotNull()).withColumn("_bucket", F.col("_bucket") + 1).withColumn("_own", F.lit(False))
    w = Window.partitionBy(*keys, "_bucket").orderBy(ts).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    seen = rows.unionByName(later).withColumn("_last", F.max("_mark").over(w)).where("_own")
    return seen.withColumn(result, F.coalesce(F.col("_last") >= F.col(ts) - span, F.lit(False))).drop("_bucket", "_mark", "_own", "_last")


def turns(df: DataFrame, keys: list[str], line: str, order: list[str], result: str) -> DataFrame:
    """The place of each row when the lines of a key take turns, lines in order of their number.

    Rows are numbered within their line alone; how many rows of the other lines come
    before is a sum over the lines' lengths, one array a key.
    """
    own = Window.partitionBy(*keys, line).orderBy(*order)
    lengths = df.groupBy(*keys, line).agg(F.count("*").alias("_n")).groupBy(*keys).agg(F.collect_list(F.struct(F.col(line).alias("line"), F.col("_n").alias("n"))).alias("_lines"))
    before = lambda x: F.least(x["n"], F.col("_r") - 1) + ((x["n"] >= F.col("_r")) & (x["line"] <= F.col(line))).cast("long")
    placed = df.withColumn("_r", F.row_number().over(own).cast("long")).join(lengths, keys)
    return placed.withColumn(result, F.aggregate(F.transform("_lines", before), F.lit(0).cast("long"), lambda a, b: a + b)).drop("_r", "_lines")
