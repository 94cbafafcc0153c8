"""Envelopes, filters and the routing of messages to retry, dead-letter and rescue topics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.decisions import settled_code


def decode(messages: DataFrame) -> DataFrame:
    """Logical coordinates and counters from `envelope`, or from the record itself where it is null."""
    none = F.col("envelope").isNull()
    return messages.withColumns(
        {
            "logical_topic": F.when(none, F.col("physical")).otherwise(F.col("envelope.topic")),
            "logical_off": F.when(none, F.col("off")).otherwise(F.col("envelope.offset")),
            "retries": F.when(none, F.lit(0)).otherwise(F.col("envelope.retry_count")),
            "timeouts": F.when(none, F.lit(0)).otherwise(F.col("envelope.timeout_count")),
        }
    )


def encode(messages: DataFrame) -> DataFrame:
    """The envelope for the next topic: coordinates, raised retry count, timeouts, and `data` (null stays null)."""
    fields = [F.col("topic").alias("topic"), F.col("part").alias("partition"), F.col("off").alias("offset"), (F.col("retry_count") + 1).alias("retry_count"), F.col("timeout_count").alias("timeout_count"), F.col("data").alias("data")]
    return messages.withColumn("envelope", F.struct(*fields))


def headers(messages: DataFrame) -> DataFrame:
    """Call headers as a map; tracing-info only where the physical topic differs."""
    plain = {"topic": F.col("topic"), "partition": F.col("part"), "offset": F.col("off"), "retrycount": F.col("retry_count")}
    base = F.create_map(*[x for k, c in plain.items() for x in (F.lit(k), c.cast("string"))])
    trace = F.concat(F.lit("physical-topic="), "physical", F.lit(",physical-partition="), F.col("part").cast("string"), F.lit(",physical-offset="), F.col("off").cast("string"))
    return messages.withColumn("headers", F.when(F.col("physical") != F.col("topic"), F.map_concat(base, F.create_map(F.lit("tracing-info"), trace))).otherwise(base))


def same_cluster(origin: Column, own: str) -> Column:
    """True for messages without an origin or from the own cluster, in any case."""
    return (F.coalesce(origin, F.lit("")) == "") | (F.lower(origin) == own.lower())


def reserved_name(name: Column) -> Column:
    """True for header names that begin with the reserved word, in any case."""
    return F.lower(name).startswith("kafka")


def all_of(*tests: Column) -> Column:
    """Conjunction; without tests everything passes."""
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def filtered(messages: DataFrame, filters: list) -> DataFrame:
    """A chain of filters before the call: column functions of no argument that return a status or null; the first status stops the message.

    `blocked` is that status, null where the call is made.
    """
    return messages.withColumn("blocked", F.coalesce(*[f() for f in filters], F.lit(None).cast("string")))


def mapped_errors(error: Column, filters: list) -> Column:
    """An error's status by the chain's last filter that knows it, as on the way back; the error itself if none does."""
    return F.coalesce(*[f(error) for f in reversed(filters)], error)


def translated(messages: DataFrame, stage) -> DataFrame:
    """A stage that maps messages (a function from DataFrame to DataFrame) and hands them on, as many as came."""
    return messages.transform(stage)


def book(messages: DataFrame) -> DataFrame:
    """Counters after an outcome: attempts rise unless acknowledged, retries where the message moves on."""
    done, moved = F.col("code").isin("SKIP", "COMMIT"), F.col("code").isin("RETRY", "RESQ", "DLQ")
    return messages.withColumns({"attempts": F.when(done, 0).otherwise(1), "retries": F.col("retry_count") + moved.cast("long"), "acked": done, "code": settled_code(F.col("code"))})


def tiers(messages: DataFrame, table: DataFrame) -> DataFrame:
    """The first tier by delay whose summed retries reach n; null past the last.

    The tier table is configuration of a few rows; it becomes one array, so messages don't shuffle.
    """
    line = table.withColumn("upto", F.sum("max_retry").over(Window.orderBy("delay_ms", "tier")))
    packed = line.agg(F.array_sort(F.collect_list(F.struct("upto", "tier"))).alias("_tiers"))
    return messages.join(F.broadcast(packed)).withColumn("tier", F.get(F.filter("_tiers", lambda t: t["upto"] >= F.col("n")), F.lit(0))["tier"]).withColumn("last_tier", F.element_at("_tiers", -1)["tier"]).drop("_tiers")


def destination(messages: DataFrame, table: DataFrame) -> DataFrame:
    """Topic to produce to: a dead letter without its topic falls through to retry; past the tiers comes the dead-letter topic or else the last tier."""
    has = lambda c: F.col(c) != ""
    x = tiers(messages, table)
    retry = F.coalesce(F.col("tier"), F.when(has("dlq_topic"), F.col("dlq_topic")).otherwise(F.col("last_tier")))
    to = F.when((F.col("code") == "DLQ") & has("dlq_topic"), F.col("dlq_topic")).when(F.col("code").isin("DLQ", "RETRY") & has("retry_topic"), retry).when((F.col("code") == "RESQ") & has("resq_topic"), F.col("resq_topic"))
    return x.withColumn("destination", to)
