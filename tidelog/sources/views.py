"""The domain's views over the driver tables, and readers of message logs."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The names of call statuses in code order.
STATUSES = "OK CANCELLED UNKNOWN INVALID_ARGUMENT DEADLINE_EXCEEDED NOT_FOUND ALREADY_EXISTS PERMISSION_DENIED RESOURCE_EXHAUSTED FAILED_PRECONDITION ABORTED OUT_OF_RANGE UNIMPLEMENTED INTERNAL UNAVAILABLE DATA_LOSS UNAUTHENTICATED".split()
#: Retry tiers: name, delay in ms, retries.
TIERS = [("t1", 1000, 2), ("t2", 5000, 2), ("t3", 30000, 1)]
MILLIS = "timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01', cast(ts as timestamp_ntz))"


def half_up(x: str, places: int) -> str:
    """The double x rounded as the SQL's engine does: scaled, to the next whole number, back. Spark's own round of a double goes by its shortest decimal, which is another number at ties."""
    return f"(round(({x}) * {10**places}D) / {10**places}D)"


class Views:
    """DataFrames of the domain over one folder of tables; each is built when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def log(self) -> DataFrame:
        e = self.table("events").selectExpr(
            "event_type as topic", "user_id % 8 as part", f"{MILLIS} as ts_ms", "cast(length(props) as bigint) as vbytes", "user_id as key", "event_id % 7 as retry_count", "event_id % 4 as timeout_count", "event_id", "value"
        )
        return e.withColumn("off", F.row_number().over(Window.partitionBy("topic", "part").orderBy("event_id")).cast("long") - 1)

    @cached_property
    def resp(self) -> DataFrame:
        names = ",".join(f"'{s}'" for s in STATUSES)
        return self.log.selectExpr(
            "*",
            f"element_at(array({names}), cast(event_id % 17 as int) + 1) as status",
            "case event_id % 11 when 1 then 'Retry' when 2 then 'Stash' when 3 then 'Skip' when 4 then 'Other' end as action",
            "event_id % 2 = 0 as overdue",
            "case event_id % 6 when 3 then topic || '__retry' when 4 then topic || '__dlq' when 5 then topic || '__resq' else topic end as physical",
            "case when event_id % 3 <> 0 then topic || '__dlq' else '' end as dlq_topic",
            "case when event_id % 4 <> 0 then topic || '__retry' else '' end as retry_topic",
            "case when event_id % 5 <> 0 then topic || '__resq' else '' end as resq_topic",
        )

    @cached_property
    def acks(self) -> DataFrame:
        return self.log.withColumn("status", F.expr("case when event_id % 97 = 0 then 'CANCELED' when event_id % 5 = 0 then 'NACKED' else 'ACKED' end"))

    @cached_property
    def tiers(self) -> DataFrame:
        return self.spark.createDataFrame(TIERS, "tier string, delay_ms long, max_retry long")

    @cached_property
    def workers(self) -> DataFrame:
        return self.table("supplier").selectExpr("s_suppkey + 1 as worker_id", "s_nationkey % 4 as pod", "case when s_suppkey % 10 = 0 then 'REGISTERING' else 'WORKING' end as state")

    @cached_property
    def jobs(self) -> DataFrame:
        return self.table("customer").selectExpr(
            "c_custkey + 1 as job_id", "c_nationkey as group_id", "c_mktsegment as uri", f"{half_up('abs(c_acctbal) / 5000', 4)} as scale", "c_custkey % 120 as worker_id", "case c_custkey % 10 when 0 then 'CANCELED' when 1 then 'FAILED' else 'RUNNING' end as state"
        )

    @cached_property
    def groups(self) -> DataFrame:
        n = F.count("*")
        return self.jobs.groupBy("group_id").agg((100.0 * n).alias("msgs"), (65536.0 * n).alias("bytes"), (10 * n).alias("inflight"), n.alias("n_jobs")).withColumn("state", F.expr("case when group_id % 6 = 0 then 'CANCELED' else 'RUNNING' end"))

    @cached_property
    def actual(self) -> DataFrame:
        own = self.jobs.where("job_id % 3 <> 0").selectExpr("job_id", "worker_id", "'RUNNING' as state", "job_id % 7 = 0 as changed")
        return own.unionByName(self.jobs.where("job_id % 50 = 0").selectExpr("job_id + 1000000 as job_id", "worker_id", "'RUNNING' as state", "false as changed"))

    @cached_property
    def status(self) -> DataFrame:
        return self.table("events").selectExpr("user_id + 1 as job_id", "value * 10 as msgs", "value * 4096 as bytes", "value / 100 as cpu", f"{MILLIS} as ts_ms", "event_id")

    @cached_property
    def ranges(self) -> DataFrame:
        return self.table("orders").selectExpr("o_orderkey as range_id", "o_orderkey % 16 as part", "o_orderkey % 100 as start_off", "o_orderkey % 100 + o_custkey % 50 as end_off")
