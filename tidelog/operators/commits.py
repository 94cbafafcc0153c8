"""Acknowledgement tracking per partition without per-record state.

Offsets are tracked in order; a position is committed when everything received
before it is acknowledged. With the rank of each acknowledgement in time, the
moment at which a prefix is complete is the running maximum of the ranks, so
every step of the queue follows from window functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["topic", "part"]


def commit_watermark(acks: DataFrame) -> DataFrame:
    """The first offset that is not acknowledged, else one past the last; gaps in what was received don't block."""
    return acks.groupBy(*KEYS).agg(F.coalesce(F.min(F.when(F.col("status") != "ACKED", F.col("off"))), F.max("off") + 1).alias("commit_off"))


def statistics(acks: DataFrame, *more: str) -> DataFrame:
    is_ = lambda s: F.col("status") == s
    open_ = ~F.col("status").isin("ACKED", "CANCELED")
    count = lambda c: F.count(F.when(c, 1))
    return acks.groupBy(*KEYS, *more).agg(
        F.count("*").alias("size"),
        count(is_("ACKED")).alias("acked"),
        count(is_("CANCELED")).alias("canceled"),
        F.min("off").alias("head"),
        F.max("off").alias("tail"),
        F.min(F.when(open_, F.col("off"))).alias("lowest_cancelable"),
        F.max(F.when(is_("ACKED"), F.col("off"))).alias("highest_acked"),
    )


def load_factor(stats: DataFrame, capacity: int, without_canceled: bool) -> DataFrame:
    used = F.col("size") - F.col("canceled") if without_canceled else F.col("size")
    return stats.withColumn("load", used / F.lit(float(capacity)) if capacity else F.lit(0.0))


def head_blocking(stats: DataFrame, capacity: int, load: float = 0.9, acked: float = 0.98) -> DataFrame:
    """Partitions whose head blocks: a nearly full queue that is nearly all acknowledged, with something left to cancel."""
    loaded = load_factor(stats, capacity, True)
    return loaded.where((F.col("load") > load) & (F.col("acked") / F.col("size") > acked) & F.col("lowest_cancelable").isNotNull())


def progress(acks: DataFrame, order: str) -> DataFrame:
    """What each acknowledgement returns, in the order of column `order`: the new commit position, or -3 while an earlier one is open.

    All offsets have been received before; only rows with status ACKED acknowledge.
    """
    never = F.lit((1 << 62))
    when = F.when(F.col("status") == "ACKED", F.col(order)).otherwise(never)
    whole = Window.partitionBy(*KEYS).orderBy("off").rowsBetween(Window.unboundedPreceding, 0)
    x = acks.withColumn("done", F.max(when).over(whole))
    # Prefix completions never fall along offsets: the last offset with the same completion is what the ack at that time commits.
    upto = F.max("off").over(Window.partitionBy(*KEYS, "done"))
    return x.withColumn("upto", upto).where("status = 'ACKED'").withColumn("returned", F.when(F.col("done") == F.col(order), F.col("upto") + 1).otherwise(F.lit(-3)))


def transitions(states: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Each change of state with whether the state graph allows it."""
    before = F.coalesce(F.lag("state").over(Window.partitionBy(*keys).orderBy(order)), F.lit("UNSET"))
    graph = ["UNSET>NACKED", "UNSET>CANCELED", "UNSET>ACKED", "NACKED>CANCELED", "NACKED>ACKED", "CANCELED>ACKED"]
    x = states.withColumn("before", before).where("before <> state")
    return x.withColumn("allowed", F.concat_ws(">", "before", "state").isin(graph))
