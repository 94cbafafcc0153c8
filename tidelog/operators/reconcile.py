"""Expected against actual: full outer and anti joins that give commands and state changes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def commands(expected: DataFrame, actual: DataFrame, key: str = "job_id") -> DataFrame:
    """RUN, UPDATE or CANCEL for each key that needs one. `changed` on actual: it differs in more than the start offset."""
    e = expected.select(key, F.col("state").alias("want"))
    a = actual.select(key, F.col("state").alias("have"), "changed")
    on, running = e.join(a, key, "full"), lambda c: F.coalesce(F.col(c) == "RUNNING", F.lit(False))
    what = F.when(running("want") & ~running("have"), "RUN").when(running("want") & F.col("changed"), "UPDATE").when(~running("want") & running("have"), "CANCEL")
    return on.select(key, what.alias("command")).where("command is not null")


def changes(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that came and went."""
    added = after.select(*keys).join(before.select(*keys), keys, "left_anti").withColumn("change", F.lit("ADDED"))
    removed = before.select(*keys).join(after.select(*keys), keys, "left_anti").withColumn("change", F.lit("REMOVED"))
    return added.unionByName(removed)


def valid_worker(jobs: DataFrame, workers: DataFrame) -> DataFrame:
    """Worker ids outside the live set become 0."""
    live = workers.select("worker_id", F.lit(True).alias("_live"))
    return jobs.join(live, "worker_id", "left").withColumn("worker_id", F.when(F.col("_live"), F.col("worker_id")).otherwise(F.lit(0))).drop("_live")


def derived(jobs: DataFrame, templates: DataFrame, keys: list[str], own: list[str]) -> DataFrame:
    """The jobs with `derived`: whether all columns but a job's own are those of its template (a struct column `template`)."""
    shared = [c for c in jobs.columns if c not in own]
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col("template")[c]) for c in shared], F.lit(True))
    return jobs.join(templates, keys).withColumn("derived", same).drop("template")
