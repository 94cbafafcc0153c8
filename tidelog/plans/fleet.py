"""Queries on the fleet: roll-ups, scaling, reconciliation and placement."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions import decisions as d
from tidelog.operators import folds, placement, reconcile, scans, windows
from tidelog.operators.scaling import ScaleState
from tidelog.plans.registry import query
from tidelog.sources.views import Views


@query("SELECT w.worker_id, coalesce(j.n, 0) AS n_jobs, coalesce(j.s, 0.0) AS scale, coalesce(j.u, '') AS uri FROM workers w LEFT JOIN (SELECT worker_id, count(*) AS n, round(sum(scale), 4) AS s, min_by(uri, job_id) AS u FROM jobs GROUP BY worker_id) j ON j.worker_id = w.worker_id")
def worker_table(v: Views) -> DataFrame:
    by = v.jobs.groupBy("worker_id").agg(F.count("*").alias("n"), F.round(F.sum("scale"), 4).alias("s"), F.min_by("uri", "job_id").alias("u"))
    return v.workers.join(by, "worker_id", "left").select("worker_id", F.coalesce("n", F.lit(0)).alias("n_jobs"), F.coalesce("s", F.lit(0.0)).alias("scale"), F.coalesce("u", F.lit("")).alias("uri"))


@query("SELECT j.job_id, j.group_id, g.state AS group_state, length(j.uri) AS uri_length FROM jobs j JOIN groups g ON g.group_id = j.group_id")
def job_table(v: Views) -> DataFrame:
    return v.jobs.join(v.groups.select("group_id", F.col("state").alias("group_state")), "group_id").select("job_id", "group_id", "group_state", F.length("uri").alias("uri_length"))


@query("SELECT j.group_id, j.job_id, s.n AS n_status FROM jobs j LEFT JOIN (SELECT job_id, count(*) AS n FROM status GROUP BY job_id) s ON s.job_id = j.job_id")
def job_status_table(v: Views) -> DataFrame:
    """A job without a status still has a row."""
    s = v.status.groupBy("job_id").agg(F.count("*").alias("n_status"))
    return v.jobs.join(s, "job_id", "left").select("group_id", "job_id", "n_status")


@query("SELECT w.worker_id, j.job_id FROM workers w JOIN jobs j ON j.worker_id = w.worker_id")
def worker_job_table(v: Views) -> DataFrame:
    nested = v.jobs.groupBy("worker_id").agg(F.collect_list("job_id").alias("ids"))
    return v.workers.join(nested, "worker_id").select("worker_id", F.explode("ids").alias("job_id"))


@query("SELECT 'job' AS what, state, count(*) AS n FROM jobs GROUP BY state UNION ALL SELECT 'worker', state, count(*) FROM workers GROUP BY state")
def state_counts(v: Views) -> DataFrame:
    n = F.count("*").alias("n")
    return v.jobs.groupBy(F.lit("job").alias("what"), "state").agg(n).unionByName(v.workers.groupBy(F.lit("worker").alias("what"), "state").agg(n))


@query("SELECT count(*) AS running, CAST((SELECT count(*) FROM workers WHERE state = 'WORKING') AS BIGINT) AS workers, (SELECT count(*) FROM workers WHERE state = 'WORKING') * 4000.0 AS allowed, sum(bytes) AS used_bytes, sum(least(msgs, 4000.0)) AS used_msgs FROM groups WHERE state = 'RUNNING'")
def cluster_scale_status(v: Views) -> DataFrame:
    """Messages are capped by a worker's capacity for each group, bytes are not."""
    n = v.workers.where("state = 'WORKING'").count()
    g = v.groups.where("state = 'RUNNING'").agg(F.count("*").alias("running"), F.sum("bytes").alias("used_bytes"), F.sum(F.least("msgs", F.lit(4000.0))).alias("used_msgs"))
    return g.select("running", F.lit(n).cast("long").alias("workers"), F.lit(n * 4000.0).alias("allowed"), "used_bytes", "used_msgs")


WORKLOAD = "SELECT j.group_id, sum(s.m) AS msgs, sum(s.b) AS bytes, sum(s.c) AS cpu, count(*) AS live FROM (SELECT job_id, max_by(msgs, event_id) AS m, max_by(bytes, event_id) AS b, max_by(cpu, event_id) AS c, max(ts_ms) AS t FROM status GROUP BY job_id) s JOIN jobs j ON j.job_id = s.job_id WHERE s.t >= (SELECT max(ts_ms) FROM status) - 86400000 GROUP BY j.group_id"


def _workload(v: Views) -> DataFrame:
    now = v.status.agg(F.max("ts_ms")).first()[0] or 0
    last = v.status.groupBy("job_id").agg(F.max_by(F.struct("msgs", "bytes", "cpu"), "event_id").alias("x"), F.max("ts_ms").alias("t")).where(F.col("t") >= now - 86_400_000)
    return v.jobs.join(last, "job_id").groupBy("group_id").agg(F.sum("x.msgs").alias("msgs"), F.sum("x.bytes").alias("bytes"), F.sum("x.cpu").alias("cpu"), F.count("*").alias("live"))


@query(f"SELECT group_id, round(msgs, 4) AS msgs, round(bytes, 2) AS bytes, live FROM ({WORKLOAD})")
def group_workload(v: Views) -> DataFrame:
    """The latest live workload of each job, summed by group."""
    return _workload(v).select("group_id", F.round("msgs", 4).alias("msgs"), F.round("bytes", 2).alias("bytes"), "live")


@query(f"SELECT group_id, round(greatest(msgs / 4000.0, bytes / 16777216.0), 6) AS scale FROM ({WORKLOAD})")
def scale_throughput(v: Views) -> DataFrame:
    return _workload(v).select("group_id", F.round(d.throughput_scale(F.col("msgs"), F.col("bytes")), 6).alias("scale"))


@query(f"SELECT group_id, round(CASE WHEN msgs = 0 THEN 0 ELSE cpu / 3.0 END, 6) AS scale FROM ({WORKLOAD})")
def scale_cpu(v: Views) -> DataFrame:
    return _workload(v).select("group_id", F.round(d.cpu_scale(F.col("msgs"), F.col("cpu")), 6).alias("scale"))


@query("SELECT group_id, round(q, 6) AS scale, round(q * 4000.0, 4) AS msgs, round(q * 16777216.0, 2) AS bytes FROM (SELECT group_id, greatest(msgs / 4000.0, bytes / 16777216.0) AS q FROM groups)")
def quota_scale(v: Views) -> DataFrame:
    """The quota's scale, and the throughput that this scale stands for."""
    q = d.throughput_scale(F.col("msgs"), F.col("bytes"))
    return v.groups.select("group_id", F.round(q, 6).alias("scale"), F.round(q * 4000.0, 4).alias("msgs"), F.round(q * 16777216.0, 2).alias("bytes"))


PROPOSAL = """SELECT job_id, percentile, now AS scale, CASE WHEN percentile BETWEEN now * 1.2 AND now * 2.0 THEN 'UP' WHEN percentile BETWEEN now * 0.5 AND now * 0.8 THEN 'DOWN' ELSE 'KEEP' END AS proposal FROM (SELECT p.job_id, p.percentile, 50.0 AS now FROM
 (WITH b AS (SELECT job_id, CAST(least(99, greatest(0, ceil(x / 2.0))) AS INT) AS b, count(*) AS c FROM (SELECT job_id, cpu * 100 AS x FROM status) GROUP BY ALL), r AS (SELECT *, sum(c) OVER (PARTITION BY job_id ORDER BY b) AS cum, floor(0.5 * sum(c) OVER (PARTITION BY job_id)) AS piv FROM b)
 SELECT job_id, CASE WHEN min(piv) <= 0 THEN 0.0 ELSE min(b) * 2.0 END AS percentile FROM r WHERE cum >= piv GROUP BY job_id) p)"""


@query(PROPOSAL)
def scale_proposal(v: Views) -> DataFrame:
    """The median of a window against the bounds of its scale."""
    p = windows.histogram_percentile(v.status.withColumn("x", F.col("cpu") * 100), ["job_id"], "x", 0.0, 200.0, 0.5)
    now = F.lit(50.0)
    what = F.when(F.col("percentile").between(now * 1.2, now * 2.0), "UP").when(F.col("percentile").between(now * 0.5, now * 0.8), "DOWN").otherwise("KEEP")
    return p.select("job_id", "percentile", now.alias("scale"), what.alias("proposal"))


def _bucket_sql(value: str, low: str, width: str) -> str:
    return f"CAST(least(99, greatest(0, ceil(({value} - {low}) / {width}))) AS INT)"


def _edge_sql(held: str, p: float, low: str, width: str) -> str:
    """The percentile of a list of buckets: the one at which the running count reaches int(p * n)."""
    at = f"CAST(floor({p} * len({held})) AS BIGINT)"
    return f"({low} + CASE WHEN {at} <= 0 THEN 0 ELSE list_sort({held})[{at}] END * {width})"


# Windows are lists of buckets with their begin; m: mode (C, R, H), s: scale, c: begin of calibration, z: scale of the sleep window.
_UP_W, _DN_W, _HB_W = "((s * 2.0 - s * 1.0) / 100)", "((s * 1.0 - s * 0.5) / 100)", "((z * 1.0 - z * 0.0) / 100)"
REPLAY = f"""WITH RECURSIVE e AS (SELECT job_id, event_id, ts_ms AS t, msgs / 4000.0 AS x, row_number() OVER (PARTITION BY job_id ORDER BY ts_ms, event_id) AS k FROM status),
 r AS (SELECT job_id, CAST(0 AS BIGINT) AS event_id, CAST(0 AS BIGINT) AS k, CASE job_id % 3 WHEN 0 THEN 'C' WHEN 1 THEN 'R' ELSE 'H' END AS m, CASE WHEN job_id % 3 = 2 THEN CAST(0 AS DOUBLE) ELSE 0.05::DOUBLE END AS s, t AS c, 0.05::DOUBLE AS z,
   t AS ut, CAST([] AS INT[]) AS uv, t AS dt, CAST([] AS INT[]) AS dv, t AS ht, CAST([] AS INT[]) AS hv, t AS wt, CAST([] AS INT[]) AS wv FROM e WHERE k = 1
 UNION ALL
 SELECT job_id, event_id, k, CASE WHEN moved THEN CASE WHEN m = 'C' AND t - c <= 1800000 THEN 'C' ELSE 'R' END WHEN slept THEN 'H' WHEN woke THEN 'R' ELSE m END,
   CASE WHEN uo THEN up WHEN do_ THEN dp WHEN slept THEN 0 WHEN woke THEN wp ELSE s END, c, CASE WHEN m = 'C' AND moved AND t - c > 1800000 THEN CASE WHEN uo THEN up ELSE dp END WHEN woke THEN wp ELSE z END,
   CASE WHEN moved OR woke OR um THEN t ELSE ut END, CASE WHEN moved OR woke OR um THEN [] ELSE uv END,
   CASE WHEN moved OR woke OR dm THEN t ELSE dt END, CASE WHEN moved OR woke OR dm THEN [] ELSE dv END,
   CASE WHEN (m = 'C' AND moved) OR woke OR hm THEN t ELSE ht END, CASE WHEN (m = 'C' AND moved) OR woke OR hm THEN [] ELSE hv END,
   CASE WHEN slept OR wm THEN t ELSE wt END, CASE WHEN slept OR wm THEN [] ELSE wv END
 FROM (SELECT *, uo OR do_ AS moved, hm AND hp = 0 AS slept, coalesce(wm AND wp >= 1e-7 AND wp <= 1.0, FALSE) AS woke FROM (SELECT *, coalesce(hv_seen AND len(hv) >= 10 AND t - ht > 259200000, FALSE) AS hm, {_edge_sql("hv", 0.99, "z * 0.0", _HB_W)} AS hp
 FROM (SELECT * REPLACE (CASE WHEN m = 'R' AND NOT uo AND NOT do_ THEN list_append(hv, {_bucket_sql("x", "z * 0.0", _HB_W)}) ELSE hv END AS hv), m = 'R' AND NOT uo AND NOT do_ AS hv_seen
 FROM (SELECT *, coalesce(dm AND dp >= s * 0.5 AND dp <= s * 0.8, FALSE) AS do_ FROM (SELECT *, coalesce(d_seen AND len(dv) >= 10 AND t - dt > CASE m WHEN 'C' THEN 300000 ELSE 86400000 END, FALSE) AS dm, {_edge_sql("dv", 0.99, "s * 0.5", _DN_W)} AS dp
 FROM (SELECT * REPLACE (CASE WHEN m <> 'H' AND NOT uo AND s > 1e-7 THEN list_append(dv, {_bucket_sql("x", "s * 0.5", _DN_W)}) ELSE dv END AS dv), m <> 'H' AND NOT uo AND s > 1e-7 AS d_seen
 FROM (SELECT *, coalesce(um AND up >= s * 1.2 AND up <= s * 2.0, FALSE) AS uo FROM (SELECT *, coalesce(m <> 'H' AND len(uv) >= 10 AND t - ut > 300000, FALSE) AS um, {_edge_sql("uv", 0.5, "s * 1.0", _UP_W)} AS up, coalesce(m = 'H' AND len(wv) >= 10 AND t - wt > 300000, FALSE) AS wm, {_edge_sql("wv", 0.5, "0.0", "0.01")} AS wp
 FROM (SELECT r.job_id, e.event_id, e.k, e.t, e.x, m, s, c, z, ut, CASE WHEN m <> 'H' THEN list_append(uv, {_bucket_sql("x", "s * 1.0", _UP_W)}) ELSE uv END AS uv, dt, dv, ht, hv, wt, CASE WHEN m = 'H' THEN list_append(wv, {_bucket_sql("x", "0.0", "0.01")}) ELSE wv END AS wv
  FROM r JOIN e ON e.job_id = r.job_id AND e.k = r.k + 1))))))))))
 SELECT job_id, event_id, round(s, 6) AS scale FROM r WHERE k > 0"""


@query(REPLAY.replace("SELECT job_id, event_id, round(s, 6) AS scale FROM r WHERE k > 0", """SELECT job_id, round(s, 6) AS scale, CASE m WHEN 'C' THEN 'CALIBRATING' WHEN 'R' THEN 'RUNNING' ELSE 'HIBERNATE' END AS mode,
 CASE m WHEN 'H' THEN CAST(len(wv) AS VARCHAR) WHEN 'C' THEN concat(len(uv), ',', len(dv)) ELSE concat(len(uv), ',', len(dv), ',', len(hv)) END AS samples FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY k DESC) AS last FROM r) WHERE last = 1"""))
def scale_snapshot(v: Views) -> DataFrame:
    """State of each job's machine after its last sample: mode, scale, and how many samples each of its windows holds."""

    def step(held: dict, r: dict) -> str:
        if not held:
            held["state"] = ScaleState(r["ts_ms"], 0.0 if r["job_id"] % 3 == 2 else 0.05, r["job_id"] % 3 == 0)
        held["state"].sample(r["ts_ms"], r["msgs"] / 4000.0)
        mode, scale, samples = held["state"].snapshot()
        return f"{mode};{scale!r};{','.join(map(str, samples))}"

    out = folds.ordered_fold(v.status, ["job_id"], ["ts_ms", "event_id"], ["job_id", "event_id", "ts_ms", "msgs"], dict, step, "state", "string")
    last = F.split(F.max_by("state", F.struct("ts_ms", "event_id")), ";")
    return out.groupBy("job_id").agg(last.alias("x")).select("job_id", F.round(F.col("x")[1].cast("double"), 6).alias("scale"), F.col("x")[0].alias("mode"), F.col("x")[2].alias("samples"))


@query(REPLAY)
def scale_replay(v: Views) -> DataFrame:
    """The state machine over all samples of each job, by time: a third starts from a quota, a third from a known scale, a third asleep."""

    def step(held: dict, r: dict) -> float:
        if not held:
            held["state"] = ScaleState(r["ts_ms"], 0.0 if r["job_id"] % 3 == 2 else 0.05, r["job_id"] % 3 == 0)
        return float(held["state"].sample(r["ts_ms"], r["msgs"] / 4000.0))

    out = folds.ordered_fold(v.status, ["job_id"], ["ts_ms", "event_id"], ["job_id", "event_id", "ts_ms", "msgs"], dict, step, "scale", "double")
    return out.select("job_id", "event_id", F.round("scale", 6).alias("scale"))


@query("SELECT event_id, job_id FROM (SELECT *, lag(q) OVER (PARTITION BY job_id ORDER BY event_id) AS p FROM (SELECT event_id, job_id, event_id // 500 % 2 AS q FROM status)) WHERE p IS NOT NULL AND p <> q")
def quota_changes(v: Views) -> DataFrame:
    q = v.status.selectExpr("event_id", "job_id", "event_id div 500 % 2 as q").withColumn("p", F.lag("q").over(Window.partitionBy("job_id").orderBy("event_id")))
    return q.where("p is not null and p <> q").select("event_id", "job_id")


@query("SELECT group_id, new_scale FROM (SELECT group_id, round(msgs / 4000.0, 6) AS old_scale, round(least(msgs, 5000.0) / 4000.0, 6) AS new_scale FROM groups WHERE state = 'RUNNING') WHERE old_scale <> new_scale")
def apply_scale(v: Views) -> DataFrame:
    """Running groups whose scale changes; the others are not written."""
    g = v.groups.where("state = 'RUNNING'").selectExpr("group_id", "round(msgs / 4000.0, 6) as old_scale", "round(least(msgs, 5000.0) / 4000.0, 6) as new_scale")
    return g.where("old_scale <> new_scale").select("group_id", "new_scale")


PREDICTION = "SELECT group_id, job_id, 60 - job_id % 50 AS seconds, scale AS now, round(scale * (CASE job_id % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 1.5 ELSE 0.7 END), 4) AS next FROM jobs WHERE scale > 0.2"


def _prediction(v: Views) -> DataFrame:
    return v.jobs.where("scale > 0.2").selectExpr("group_id", "job_id", "60 - job_id % 50 as seconds", "scale as now", "round(scale * (case job_id % 3 when 0 then 0.5 when 1 then 1.5 else 0.7 end), 4) as next")


@query(f"SELECT group_id, min(seconds * 1000000 + job_id) % 1000000 AS job_id, min(seconds * 1000000 + job_id) // 1000000 AS seconds FROM ({PREDICTION}) GROUP BY group_id")
def scale_prediction(v: Views) -> DataFrame:
    """The soonest prediction of each group."""
    return _prediction(v).groupBy("group_id").agg(F.min(F.struct("seconds", "job_id")).alias("x")).select("group_id", "x.job_id", "x.seconds")


@query(f"""WITH p AS (SELECT * FROM ({PREDICTION}) WHERE seconds > 0 AND next - now < 0), t AS (SELECT sum(scale) / 1.1 - sum(scale) AS target FROM jobs), r AS (SELECT seconds, job_id, sum(next - now) OVER (ORDER BY seconds, job_id) AS cum FROM p)
 SELECT coalesce((SELECT min(seconds) FROM r, t WHERE cum < target), (SELECT max(seconds) FROM r), 0) AS shortened""")
def reactive_window(v: Views) -> DataFrame:
    """By how much the down-scale window shrinks at a load of 1.1: the countdown at which enough scale is gone."""
    p = _prediction(v).where("seconds > 0 and next - now < 0").groupBy("seconds").agg(F.sum(F.col("next") - F.col("now")).alias("diff"))
    total = v.jobs.agg(F.sum("scale")).first()[0] or 0.0
    cum = p.withColumn("cum", F.sum("diff").over(Window.orderBy("seconds")))  # one row a second of countdown
    return cum.agg(F.coalesce(F.min(F.when(F.col("cum") < total / 1.1 - total, F.col("seconds"))), F.max("seconds"), F.lit(0)).alias("shortened"))


@query("SELECT event_id, round(greatest(msgs / 4000, bytes / 16777216), 9) AS scale FROM status")
def requested_scale(v: Views) -> DataFrame:
    """The scale that a request's totals stand for, whatever scale it names."""
    return v.status.select("event_id", F.round(d.throughput_scale(F.col("msgs"), F.col("bytes")), 9).alias("scale"))


@query(f"SELECT group_id, job_id, seconds FROM ({PREDICTION}) WHERE seconds > 0 AND next - now < 0")
def down_scales(v: Views) -> DataFrame:
    """Predictions of less scale that lie ahead."""
    return _down_scales(v).select("group_id", "job_id", "seconds")


def _down_scales(v: Views) -> DataFrame:
    return _prediction(v).withColumn("diff", F.col("next") - F.col("now")).where("seconds > 0 and diff < 0")


@query(f"""WITH p AS (SELECT group_id, seconds, sum(CAST(round((next - now) * 10000) AS BIGINT)) AS diff FROM ({PREDICTION}) WHERE seconds > 0 AND next - now < 0 GROUP BY group_id, seconds),
 c AS (SELECT *, sum(diff) OVER (PARTITION BY group_id ORDER BY seconds) AS cum FROM p) SELECT group_id, min(seconds) FILTER (cum < -20000) AS seconds FROM c GROUP BY group_id""")
def first_below(v: Views) -> DataFrame:
    """For each group the countdown at which two workers' scale or more is gone: the first prefix sum below the target, null without one."""
    p = _down_scales(v).groupBy("group_id", "seconds").agg(F.sum(F.round(F.col("diff") * 10_000).cast("long")).alias("diff"))
    cum = p.withColumn("cum", F.sum("diff").over(Window.partitionBy("group_id").orderBy("seconds")))
    return cum.groupBy("group_id").agg(F.min(F.when(F.col("cum") < -20_000, F.col("seconds"))).alias("seconds"))


@query("SELECT job_id, greatest(100.0, least(600.0, greatest(scale * 150.0, least(scale * 450.0, 300.0)))) AS win FROM jobs")
def window_clamp(v: Views) -> DataFrame:
    """Within half of the old value either way, then within the bounds."""
    old = F.col("scale") * 300.0
    return v.jobs.select("job_id", d.clamp(d.clamp(F.lit(300.0), old * 0.5, old * 1.5), F.lit(100.0), F.lit(600.0)).alias("win"))


@query("SELECT round(CASE WHEN (SELECT count(*) FROM workers) = 0 THEN 0 ELSE sum(least(scale, 1.0)) / (SELECT count(*) FROM workers) END, 6) AS load FROM jobs WHERE state = 'RUNNING'")
def system_load(v: Views) -> DataFrame:
    n = v.workers.count()
    return v.jobs.where("state = 'RUNNING'").agg(F.round(F.sum(F.least("scale", F.lit(1.0))) / n if n else F.lit(0.0), 6).alias("load"))


@query("SELECT group_id, round(msgs / 4000.0, 6) AS load FROM groups")
def default_load(v: Views) -> DataFrame:
    return v.groups.select("group_id", F.round(F.col("msgs") / 4000.0, 6).alias("load"))


@query("SELECT group_id, count(*) AS n, string_agg(job_id || '=' || state, ',' ORDER BY job_id) AS jobs FROM jobs GROUP BY group_id")
def snapshot(v: Views) -> DataFrame:
    x = v.jobs.groupBy("group_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("job_id", "state"))).alias("j"))
    return x.select("group_id", "n", F.array_join(F.transform("j", lambda s: F.concat(s["job_id"].cast("string"), F.lit("="), s["state"])), ",").alias("jobs"))


@query("""SELECT job_id, command FROM (SELECT coalesce(j.job_id, a.job_id) AS job_id, CASE WHEN j.state = 'RUNNING' AND a.job_id IS NULL THEN 'RUN' WHEN j.state = 'RUNNING' AND a.changed THEN 'UPDATE' WHEN (j.state IS NULL OR j.state <> 'RUNNING') AND a.job_id IS NOT NULL THEN 'CANCEL' END AS command FROM jobs j FULL OUTER JOIN actual a ON a.job_id = j.job_id) WHERE command IS NOT NULL""")
def command_list(v: Views) -> DataFrame:
    return reconcile.commands(v.jobs, v.actual)


@query("SELECT job_id FROM jobs WHERE worker_id = 7")
def assigned_jobs(v: Views) -> DataFrame:
    return v.jobs.where("worker_id = 7").select("job_id")


@query("SELECT job_id, 'ADDED' AS change FROM jobs WHERE job_id NOT IN (SELECT job_id FROM actual) UNION ALL SELECT job_id, 'REMOVED' FROM actual WHERE job_id NOT IN (SELECT job_id FROM jobs)")
def assignment_diff(v: Views) -> DataFrame:
    return reconcile.changes(v.actual, v.jobs, ["job_id"])


@query("SELECT job_id FROM (SELECT job_id, row_number() OVER (PARTITION BY group_id, job_id % 16 ORDER BY job_id) AS r FROM jobs) WHERE r > 1")
def duplicate_jobs(v: Views) -> DataFrame:
    """Of the jobs on one partition the first is kept."""
    w = Window.partitionBy("group_id", F.col("job_id") % 16).orderBy("job_id")
    return v.jobs.withColumn("r", F.row_number().over(w)).where("r > 1").select("job_id")


@query("SELECT j.group_id, s.event_id FROM status s JOIN jobs j ON j.job_id = s.job_id")
def group_status(v: Views) -> DataFrame:
    return v.status.join(v.jobs.select("job_id", "group_id"), "job_id").select("group_id", "event_id")


@query("SELECT j.job_id, CASE WHEN w.worker_id IS NULL THEN 0 ELSE j.worker_id END AS worker_id FROM jobs j LEFT JOIN workers w ON w.worker_id = j.worker_id")
def invalid_workers(v: Views) -> DataFrame:
    return reconcile.valid_worker(v.jobs, v.workers).select("job_id", "worker_id")


@query("SELECT j.job_id, g.state FROM jobs j JOIN groups g ON g.group_id = j.group_id WHERE j.state <> g.state")
def state_sync_default(v: Views) -> DataFrame:
    g = v.groups.select("group_id", F.col("state").alias("want"))
    return v.jobs.join(g, "group_id").where("state <> want").select("job_id", F.col("want").alias("state"))


@query("SELECT j.job_id, g.state FROM jobs j JOIN groups g ON g.group_id = j.group_id WHERE j.state <> g.state AND j.state <> 'CANCELED'")
def state_sync_streaming(v: Views) -> DataFrame:
    """Canceled jobs stay canceled."""
    g = v.groups.select("group_id", F.col("state").alias("want"))
    return v.jobs.join(g, "group_id").where("state <> want and state <> 'CANCELED'").select("job_id", F.col("want").alias("state"))


@query("""WITH s AS (SELECT j.group_id, j.job_id, CASE WHEN g.group_id % 9 = 1 OR r.end_off <= 40 THEN 'CANCELED' ELSE g.state END AS state FROM jobs j JOIN groups g ON g.group_id = j.group_id LEFT JOIN ranges r ON r.range_id = j.job_id)
 SELECT group_id, job_id, state, bool_and(state = 'CANCELED') OVER (PARTITION BY group_id) AS group_done FROM s""")
def state_sync_batch(v: Views) -> DataFrame:
    """A job whose end is committed is canceled; a group with all jobs canceled is done."""
    x = v.jobs.drop("state").join(v.groups.select("group_id", "state"), "group_id").join(v.ranges.select(F.col("range_id").alias("job_id"), "end_off"), "job_id", "left")
    s = x.withColumn("state", F.when((F.col("group_id") % 9 == 1) | F.coalesce(F.col("end_off") <= 40, F.lit(False)), "CANCELED").otherwise(F.col("state")))
    done = s.groupBy("group_id").agg(F.bool_and(F.col("state") == "CANCELED").alias("group_done"))
    return s.join(done, "group_id").select("group_id", "job_id", "state", "group_done")


@query("""WITH r AS (SELECT range_id, part, start_off, end_off, range_id * 1000 AS end_ms, CASE range_id % 3 WHEN 0 THEN 'CANCELED' ELSE 'RUNNING' END AS state FROM ranges)
 SELECT range_id, part, end_off FROM r WHERE start_off = end_off AND end_off > 0 AND state = 'CANCELED' AND (SELECT max(end_ms) FROM r) - end_ms <= 3600000""")
def post_commit(v: Views) -> DataFrame:
    """Canceled jobs that read nothing, of groups that ended within the hour, commit their end; each range is a group that ends a second after the one before."""
    ended = v.ranges.selectExpr("range_id", "part", "start_off", "end_off", "range_id * 1000 as end_ms", "case range_id % 3 when 0 then 'CANCELED' else 'RUNNING' end as state")
    return scans.post_commits(ended, ended.agg(F.max("end_ms")).first()[0] or 0).select("range_id", "part", "end_off")


@query("SELECT group_id, bool_and(state = 'CANCELED') OR count(*) FILTER (state = 'RUNNING') < 40 AS collect FROM jobs GROUP BY group_id")
def pipeline_gc(v: Views) -> DataFrame:
    return v.jobs.groupBy("group_id").agg((F.bool_and(F.col("state") == "CANCELED") | (F.count(F.when(F.col("state") == "RUNNING", 1)) < 40)).alias("collect"))


@query("SELECT x.group_id FROM (SELECT unnest(range(0, 40, 3)) AS group_id) x WHERE x.group_id NOT IN (SELECT group_id FROM groups)")
def add_group(v: Views) -> DataFrame:
    """Adding is idempotent: only groups that are not there yet."""
    return v.spark.range(0, 40, 3).withColumnRenamed("id", "group_id").join(v.groups, "group_id", "left_anti").select("group_id")


@query("SELECT j.job_id FROM jobs j LEFT JOIN workers w ON w.worker_id = j.worker_id WHERE w.worker_id IS NULL")
def stale_jobs(v: Views) -> DataFrame:
    """Jobs to place anew: their worker is gone."""
    return v.jobs.join(v.workers, "worker_id", "left_anti").select("job_id")


@query("""WITH live AS (SELECT worker_id, row_number() OVER (ORDER BY worker_id) - 1 AS k, count(*) OVER () AS n FROM workers WHERE state = 'WORKING')
 SELECT j.job_id, l.worker_id FROM (SELECT job_id, (job_id * 2654435761 % 4294967296) // 65536 AS h FROM jobs WHERE worker_id NOT IN (SELECT worker_id FROM workers)) j JOIN live l ON l.k = j.h % l.n""")
def default_placement(v: Views) -> DataFrame:
    """A live worker for each job without one, by a multiplicative hash in place of chance."""
    live = v.workers.where("state = 'WORKING'").select("worker_id", (F.row_number().over(Window.orderBy("worker_id")) - 1).alias("k"))  # the fleet
    n = live.count()
    lost = v.jobs.join(v.workers.select("worker_id"), "worker_id", "left_anti").select("job_id", F.expr(f"((job_id * 2654435761) % 4294967296 div 65536) % {max(n, 1)}").alias("k"))
    return lost.join(live, "k").select("job_id", "worker_id")


@query("SELECT job_id, scale < 0.05 AS hibernating FROM jobs")
def hibernating_split(v: Views) -> DataFrame:
    return v.jobs.select("job_id", (F.col("scale") < 0.05).alias("hibernating"))


@query("""WITH RECURSIVE e AS (SELECT worker_id, job_id, scale, row_number() OVER (PARTITION BY worker_id ORDER BY job_id) AS r FROM jobs), f AS (SELECT worker_id, job_id, r, scale AS total, FALSE AS leaves FROM e WHERE r = 1
 UNION ALL SELECT e.worker_id, e.job_id, e.r, CASE WHEN total + scale < 3.0 THEN total + scale ELSE total END, NOT (total + scale < 3.0) FROM f JOIN e ON e.worker_id = f.worker_id AND e.r = f.r + 1) SELECT worker_id, job_id, leaves FROM f""")
def overloaded_jobs(v: Views) -> DataFrame:
    """The sum goes on past a job that does not fit, so it is a fold and no running sum."""

    def step(s: dict, r: dict) -> bool:
        stays = "total" not in s or s["total"] + r["scale"] < 3.0
        s["total"] = s.get("total", 0.0) + (r["scale"] if stays else 0.0)
        return not stays

    return folds.ordered_fold(v.jobs, ["worker_id"], ["job_id"], ["worker_id", "job_id", "scale"], dict, step, "leaves", "boolean").select("worker_id", "job_id", "leaves")


@query("SELECT group_id % 4 AS part, count(*) FILTER (scale >= 1.0) AS dedicated, CAST(ceil(count(*) FILTER (scale < 1.0) / 500.0) AS BIGINT) AS shared FROM jobs GROUP BY group_id % 4")
def workers_needed_by_count(v: Views) -> DataFrame:
    return v.jobs.groupBy((F.col("group_id") % 4).alias("part")).agg(F.count(F.when(F.col("scale") >= 1, 1)).alias("dedicated"), F.ceil(F.count(F.when(F.col("scale") < 1, 1)) / 500.0).cast("long").alias("shared"))


def _part(v: Views) -> DataFrame:
    name = F.concat(F.lit("group-"), F.col("group_id").cast("string"))
    return v.jobs.withColumn("part", d.virtual_partition(name, F.lit(4)))


#: The string hash of "group-" and a number, by steps; it ends in the virtual partition.
PART_SQL = """g AS (SELECT DISTINCT group_id, 'group-' || group_id AS name FROM jobs), hs AS (SELECT group_id, name, 0 AS i, CAST(0 AS BIGINT) AS h FROM g UNION ALL SELECT group_id, name, i + 1, (h * 31 + ascii(substr(name, i + 1, 1))) % 4294967296 FROM hs WHERE i < length(name)),
 parts AS (SELECT group_id, abs(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END % 10000) % 4 AS part FROM hs WHERE i = length(name))"""


@query(f"""WITH RECURSIVE {PART_SQL}, e AS (SELECT part, scale, row_number() OVER (PARTITION BY part ORDER BY scale DESC) AS k FROM jobs JOIN parts USING (group_id) WHERE scale < 1.0),
 f AS (SELECT DISTINCT part, CAST(0 AS BIGINT) AS k, CAST([] AS DOUBLE[]) AS bins FROM parts UNION ALL SELECT f.part, e.k, list_sort(CASE WHEN len(bins) > 0 AND bins[1] + e.scale <= 1.0 THEN list_append(bins[2:], bins[1] + e.scale) ELSE list_append(bins, e.scale) END) FROM f JOIN e ON e.part = f.part AND e.k = f.k + 1)
 SELECT f.part, CAST(ceil(round(greatest(len(max_by(bins, k)), ceil(max(k) / 500.0)) * 1.13, 9)) AS BIGINT) + (SELECT count(*) FROM jobs JOIN parts USING (group_id) WHERE part = f.part AND scale >= 1.0) AS needed FROM f GROUP BY f.part""")
def packing_count(v: Views) -> DataFrame:
    """Workers each virtual partition needs, by packing."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": [int(pdf.part.iloc[0])], "needed": [placement.workers_needed(pdf.scale.tolist())]})

    return _part(v).select("part", "scale").groupBy("part").applyInPandas(one, "part long, needed long")


def _pod_jobs(v: Views) -> DataFrame:
    return v.jobs.where("state = 'RUNNING'").withColumn("pod", F.col("group_id") % 4)


@query()
def uri_placement(v: Views) -> DataFrame:
    """Running jobs of each pod on its workers, URI by URI, with the spare workers shared."""
    return placement.place_by_pod(_pod_jobs(v), v.workers, 3.0)


@query()
def shadow_rebalance(v: Views) -> DataFrame:
    """The same placement on a copy: what is stored stays, the shadow's result stands beside it."""
    shadow = placement.place_by_pod(_pod_jobs(v), v.workers, 3.0).withColumnRenamed("placed_on", "shadow_id")
    return v.jobs.select("job_id", "worker_id").join(shadow, "job_id", "left")


@query("""WITH RECURSIVE stale AS (SELECT job_id, scale, group_id % 4 AS part, row_number() OVER (PARTITION BY group_id % 4 ORDER BY scale DESC, job_id DESC) AS k FROM jobs WHERE worker_id NOT IN (SELECT worker_id FROM workers)),
 w AS (SELECT (r - 1) % 4 AS part, list({'l': CAST(0 AS DOUBLE), 'n': 0, 'w': worker_id} ORDER BY worker_id) AS heap FROM (SELECT worker_id, row_number() OVER (ORDER BY worker_id) AS r FROM workers) GROUP BY (r - 1) % 4),
 f AS (SELECT part, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS job_id, CAST(NULL AS BIGINT) AS worker_id, heap FROM w
 UNION ALL SELECT f.part, s.k, s.job_id, heap[1].w, list_sort(list_append(heap[2:], {'l': heap[1].l + s.scale, 'n': heap[1].n + 1, 'w': heap[1].w})) FROM f JOIN stale s ON s.part = f.part AND s.k = f.k + 1)
 SELECT job_id, worker_id FROM f WHERE k > 0""")
def stale_replacement(v: Views) -> DataFrame:
    """Jobs of lost workers on the workers of their partition."""
    fleet = v.workers.select("worker_id", F.pmod(F.row_number().over(Window.orderBy("worker_id")) - 1, F.lit(4)).cast("long").alias("part"))

    def one(jobs: pd.DataFrame, workers: pd.DataFrame) -> pd.DataFrame:
        made = placement.replace_stale(list(zip(jobs.job_id, jobs.scale, strict=True)), sorted(workers.worker_id.tolist()))
        return pd.DataFrame({"job_id": list(made), "worker_id": list(made.values())}, dtype="int64")

    stale = v.jobs.join(v.workers.select("worker_id"), "worker_id", "left_anti").select("job_id", "scale", (F.col("group_id") % 4).alias("part"))
    return stale.groupBy("part").cogroup(fleet.groupBy("part")).applyInPandas(one, "job_id long, worker_id long")


NEEDED = "SELECT p AS part, CAST(ceil((SELECT count(*) FROM workers) * (p + 1) / 10.0) AS BIGINT) AS needed FROM (SELECT unnest(range(4)) AS p)"
HELD = "SELECT j.worker_id, min_by(group_id % 4, group_id * 1000000 + job_id) AS part, round(sum(scale), 4) AS load, count(*) AS jobs FROM jobs j JOIN workers w ON w.worker_id = j.worker_id GROUP BY j.worker_id"


@query(f"""WITH held AS ({HELD}), need AS (SELECT n.part, n.needed, count(h.worker_id) AS n FROM ({NEEDED}) n LEFT JOIN held h ON h.part = n.part GROUP BY n.part, n.needed),
 give AS (SELECT *, CASE WHEN n - needed >= 2 THEN least(n, greatest(2, CAST(floor((n - needed) * 0.1) AS BIGINT))) ELSE 0 END AS give, greatest(0, needed - n) AS short FROM need),
 ranked AS (SELECT h.worker_id, h.part, g.give, row_number() OVER (PARTITION BY h.part ORDER BY load, jobs, worker_id) AS r FROM held h JOIN give g ON g.part = h.part),
 line AS (SELECT worker_id, row_number() OVER (ORDER BY f, a) AS k FROM (SELECT worker_id, -1 AS f, worker_id AS a FROM workers WHERE worker_id NOT IN (SELECT worker_id FROM held) UNION ALL SELECT worker_id, part, r FROM ranked WHERE r <= give)),
 slots AS (SELECT part, row_number() OVER (ORDER BY turn, part) AS k FROM (SELECT part, unnest(range(1, short + 1)) AS turn FROM give))
 SELECT worker_id, part FROM ranked WHERE r > give UNION ALL SELECT line.worker_id, slots.part FROM line LEFT JOIN slots ON slots.k = line.k""")
def round_robin_workers(v: Views) -> DataFrame:
    """Workers go from partitions with too many, and from none, to those that are short."""
    total = v.workers.count()
    needed = v.spark.range(4).select(F.col("id").alias("part"), F.ceil(F.lit(total) * (F.col("id") + 1) / F.lit(10.0)).cast("long").alias("needed"))
    held = v.jobs.join(v.workers.select("worker_id"), "worker_id").groupBy("worker_id").agg(F.min_by(F.col("group_id") % 4, F.struct("group_id", "job_id")).alias("part"), F.round(F.sum("scale"), 4).alias("load"), F.count("*").alias("jobs"))
    return placement.spread_workers(held, v.workers.select("worker_id").join(held.select("worker_id"), "worker_id", "left_anti"), needed)


@query()
def load_balancing(v: Views) -> DataFrame:
    """Workers of each pod trade jobs until none is over the limit or nothing fits."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        held = {int(w): list(zip(g.job_id.tolist(), g.scale.tolist(), strict=True)) for w, g in pdf.groupby("worker_id")}
        made = placement.balance(held, 12.0)
        return pd.DataFrame({"job_id": list(made), "worker_id": list(made.values())}, dtype="int64")

    return v.jobs.join(v.workers.select("worker_id", "pod"), "worker_id").select("pod", "worker_id", "job_id", "scale").groupBy("pod").applyInPandas(one, "job_id long, worker_id long")


DISPERSION = "SELECT pod, worker_id, coalesce(l, 0.0) AS l FROM workers LEFT JOIN (SELECT worker_id AS w, sum(scale) AS l FROM jobs GROUP BY worker_id) x ON x.w = worker_id"


@query(f"SELECT d.pod, round(min(l), 4) AS min_load, round(max(l), 4) AS max_load, round(avg(l), 4) AS avg_load, round(sum(CASE WHEN l > 0 THEN (l - m) * (l - m) END) / count(*) FILTER (l > 0), 4) AS spread FROM ({DISPERSION}) d JOIN (SELECT pod, avg(l) AS m FROM ({DISPERSION}) GROUP BY pod) a ON a.pod = d.pod GROUP BY d.pod")
def load_dispersion(v: Views) -> DataFrame:
    """The spread has no square root, and only workers with load count in it."""
    load = v.jobs.groupBy("worker_id").agg(F.sum("scale").alias("l"))
    x = v.workers.join(load, "worker_id", "left").select("pod", F.coalesce("l", F.lit(0.0)).alias("l"))
    mean = x.groupBy("pod").agg(F.avg("l").alias("m"))
    has = F.col("l") > 0
    square = F.when(has, (F.col("l") - F.col("m")) * (F.col("l") - F.col("m")))
    r = lambda c, n: F.round(c, 4).alias(n)
    return x.join(mean, "pod").groupBy("pod").agg(r(F.min("l"), "min_load"), r(F.max("l"), "max_load"), r(F.avg("l"), "avg_load"), r(F.sum(square) / F.count(F.when(has, 1)), "spread"))


@query("SELECT i, 32 // 3 + CASE WHEN i >= 3 - 32 % 3 THEN 1 ELSE 0 END AS share FROM (SELECT unnest(range(3)) AS i)")
def hibernating_plan(v: Views) -> DataFrame:
    """32 groups over ten workers, 15 at most on each."""
    n = min(10, -(-32 // 15))
    return v.spark.range(n).select(F.col("id").alias("i"), (F.lit(32 // n) + (F.col("id") >= n - 32 % n).cast("long")).alias("share"))


@query("""WITH g AS (SELECT j.job_id AS group_id, w.worker_id, coalesce(w.pod, j.job_id % 4) AS pod FROM jobs j LEFT JOIN workers w ON w.worker_id = j.worker_id WHERE scale < 0.1),
 size AS (SELECT pod, count(*) AS g FROM g GROUP BY pod), fl AS (SELECT w.pod, w.worker_id, count(x.group_id) AS n, any_value(s.g) AS g FROM workers w JOIN size s ON s.pod = w.pod LEFT JOIN g x ON x.worker_id = w.worker_id GROUP BY w.pod, w.worker_id),
 rk AS (SELECT *, row_number() OVER (PARTITION BY pod ORDER BY n, worker_id) AS r, count(*) OVER (PARTITION BY pod) AS w FROM fl), pl AS (SELECT *, least(w, CAST(ceil(g / 2.0) AS BIGINT)) AS p, r - (w - least(w, CAST(ceil(g / 2.0) AS BIGINT))) - 1 AS i FROM rk),
 sh AS (SELECT *, CASE WHEN i < 0 THEN 0 ELSE g // p + CASE WHEN i >= p - g % p THEN 1 ELSE 0 END END AS share FROM pl), de AS (SELECT *, greatest(0, share - n) AS short, sum(greatest(0, share - n)) OVER (PARTITION BY pod ORDER BY r) AS upto FROM sh),
 own AS (SELECT x.*, d.r AS rank, d.i, d.share, row_number() OVER (PARTITION BY x.pod, x.worker_id ORDER BY x.group_id) AS q FROM g x LEFT JOIN de d ON d.pod = x.pod AND d.worker_id = x.worker_id),
 free AS (SELECT *, row_number() OVER (PARTITION BY pod ORDER BY CASE WHEN i < 0 THEN 0 WHEN worker_id IS NULL THEN 1 ELSE 2 END, coalesce(rank, 0), group_id) AS k FROM own WHERE NOT coalesce(q <= share, FALSE))
 SELECT group_id, worker_id FROM own WHERE q <= share UNION ALL SELECT f.group_id, d.worker_id FROM free f LEFT JOIN de d ON d.pod = f.pod AND d.short > 0 AND f.k > d.upto - d.short AND f.k <= d.upto""")
def hibernating_balance(v: Views) -> DataFrame:
    """Hibernating jobs, each a group, two at most on a worker: what is over its share moves to where some is missing."""
    groups = v.jobs.where("scale < 0.1").join(v.workers.select("worker_id", F.col("pod").cast("long").alias("pod"), F.lit(True).alias("known")), "worker_id", "left")
    groups = groups.select(F.col("job_id").alias("group_id"), F.when(F.col("known"), F.col("worker_id")).alias("worker_id"), F.coalesce("pod", F.col("job_id") % 4).alias("pod"))
    return placement.balance_hibernating(groups, v.workers.select(F.col("pod").cast("long").alias("pod"), "worker_id"), 2)


@query("""WITH g AS (SELECT job_id AS group_id, job_id % 6 AS pod FROM jobs), s AS (SELECT pod, count(*) AS n FROM workers GROUP BY pod), l AS (SELECT group_id, row_number() OVER (ORDER BY group_id) AS k FROM g WHERE pod NOT IN (SELECT pod FROM s)),
 t AS (SELECT pod, CAST(floor(n / (SELECT CAST(count(*) AS DOUBLE) FROM workers) * (SELECT count(*) FROM l) + 0.5) AS BIGINT) AS takes FROM s), r AS (SELECT pod, takes, sum(takes) OVER (ORDER BY pod) AS upto FROM t)
 SELECT group_id, pod FROM g WHERE pod IN (SELECT pod FROM s) UNION ALL SELECT l.group_id, r.pod FROM l LEFT JOIN r ON l.k > r.upto - r.takes AND l.k <= r.upto""")
def pod_fallback(v: Views) -> DataFrame:
    """Groups of two pods that have no workers go to the other four."""
    return placement.fallback_pods(v.jobs.select(F.col("job_id").alias("group_id"), (F.col("job_id") % 6).alias("pod")), v.workers.select(F.col("pod").cast("long").alias("pod"), "worker_id"))


@query("SELECT g.pod, count(*) AS groups, bool_or(w.pod IS NOT NULL) AS has_workers FROM (SELECT group_id, group_id % 6 AS pod FROM groups) g LEFT JOIN (SELECT DISTINCT pod FROM workers) w ON w.pod = g.pod GROUP BY g.pod")
def pod_groups(v: Views) -> DataFrame:
    pods = v.workers.select("pod").distinct().withColumn("has", F.lit(True))
    return v.groups.selectExpr("group_id", "cast(group_id % 6 as int) as pod").join(pods, "pod", "left").groupBy("pod").agg(F.count("*").alias("groups"), F.bool_or(F.col("has").isNotNull()).alias("has_workers"))


@query("SELECT group_id, CAST(greatest(5, ceil((n + ceil(n * 13 / 100.0)) / 5.0) * 5) AS BIGINT) AS target FROM (SELECT group_id, count(DISTINCT worker_id) AS n FROM jobs GROUP BY group_id)")
def worker_target(v: Views) -> DataFrame:
    """Spare workers are added, then whole units of five, five at least."""
    n = v.jobs.groupBy("group_id").agg(F.countDistinct("worker_id").alias("n"))
    return n.select("group_id", F.greatest(F.lit(5), F.ceil((F.col("n") + F.ceil(F.col("n") * 13 / F.lit(100.0))) / F.lit(5.0)) * 5).cast("long").alias("target"))


@query("SELECT worker_id, CASE pod WHEN 0 THEN 8 WHEN 2 THEN 2 ELSE 4 END AS partitions, CASE pod WHEN 0 THEN 0.5 WHEN 2 THEN 1.0 ELSE 1.0 END AS ratio FROM workers")
def pod_parameters(v: Views) -> DataFrame:
    given = v.spark.createDataFrame([(0, 8, 0.5), (2, 2, 1.0)], "pod int, p int, r double")
    return v.workers.join(F.broadcast(given), "pod", "left").select("worker_id", F.coalesce("p", F.lit(4)).alias("partitions"), F.coalesce("r", F.lit(1.0)).alias("ratio"))
