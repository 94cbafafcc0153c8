"""Queries on acknowledgement state, limits and windowed statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions import decisions as d
from tidelog.operators import commits, folds, windows
from tidelog.plans.messages import CANCEL_SQL, CODE_SQL, ROLE_SQL, _code, _role
from tidelog.plans.registry import query
from tidelog.sources.views import Views

STATS_SQL = """SELECT topic, part, {more} count(*) AS size, count(*) FILTER (status = 'ACKED') AS acked, count(*) FILTER (status = 'CANCELED') AS canceled, min(off) AS head, max(off) AS tail,
 min(off) FILTER (status NOT IN ('ACKED','CANCELED')) AS lowest_cancelable, max(off) FILTER (status = 'ACKED') AS highest_acked FROM acks GROUP BY topic, part{by}"""
PLAIN_STATS = STATS_SQL.format(more="", by="")


@query("SELECT topic, part, coalesce(min(off) FILTER (status <> 'ACKED'), max(off) + 1) AS commit_off FROM acks GROUP BY topic, part")
def commit_watermark(v: Views) -> DataFrame:
    return commits.commit_watermark(v.acks)


@query("""WITH a AS (SELECT *, row_number() OVER (PARTITION BY topic, part ORDER BY event_id * 7919 % 10007, event_id) AS t FROM acks), m AS (SELECT *, max(CASE WHEN status = 'ACKED' THEN t ELSE 4611686018427387904 END) OVER (PARTITION BY topic, part ORDER BY off) AS done FROM a)
 SELECT topic, part, off, CASE WHEN done = t THEN (SELECT max(off) FROM m x WHERE x.topic = m.topic AND x.part = m.part AND x.done <= m.t) + 1 ELSE -3 END AS returned FROM m WHERE status = 'ACKED'""")
def commit_progress(v: Views) -> DataFrame:
    """Acknowledgements come in a scrambled order."""
    w = Window.partitionBy("topic", "part").orderBy(F.col("event_id") * 7919 % 10007, "event_id")
    return commits.progress(v.acks.withColumn("t", F.row_number().over(w).cast("long")), "t").select("topic", "part", "off", "returned")


@query("""WITH a AS (SELECT *, row_number() OVER (PARTITION BY topic, part ORDER BY event_id * 7919 % 10007, off) AS t FROM acks), m AS (SELECT *, max(CASE WHEN status = 'ACKED' THEN t ELSE 4611686018427387904 END) OVER (PARTITION BY topic, part ORDER BY off) AS done FROM a)
 SELECT topic, part, off, 'RECEIVE' AS action, CAST(1 AS BIGINT) AS returned FROM acks UNION ALL
 SELECT topic, part, off, status, CASE WHEN status <> 'ACKED' THEN 1 WHEN done = t THEN (SELECT max(off) FROM m x WHERE x.topic = m.topic AND x.part = m.part AND x.done <= m.t) + 1 ELSE -3 END FROM m""")
def ack_replay(v: Views) -> DataFrame:
    """The queue step by step over receives and scrambled acknowledgements, as an ordered fold."""
    received = v.acks.selectExpr("topic", "part", "off", "0 as turn", "off as at", "'RECEIVE' as action")
    done = v.acks.selectExpr("topic", "part", "off", "1 as turn", "event_id * 7919 % 10007 as at", "status as action")

    def step(q: folds.Queue, r: dict) -> int:
        if r["action"] == "RECEIVE":
            return int(q.receive(r["off"]))
        if r["action"] == "ACKED":
            return q.ack(r["off"] + 1)
        return int(q.nack(r["off"]) if r["action"] == "NACKED" else q.cancel(r["off"]))

    return folds.ordered_fold(received.unionByName(done), ["topic", "part"], ["turn", "at", "off"], ["topic", "part", "off", "action"], folds.Queue, step, "returned", "long")


@query("""WITH s AS (SELECT key, event_id, CASE event_id % 3 WHEN 0 THEN 'NACKED' WHEN 1 THEN 'CANCELED' ELSE 'ACKED' END AS state FROM log), c AS (SELECT *, coalesce(lag(state) OVER (PARTITION BY key ORDER BY event_id), 'UNSET') AS before FROM s)
 SELECT event_id, before, state, (before, state) IN (('UNSET','NACKED'),('UNSET','CANCELED'),('UNSET','ACKED'),('NACKED','CANCELED'),('NACKED','ACKED'),('CANCELED','ACKED')) AS allowed FROM c WHERE before <> state""")
def ack_transitions(v: Views) -> DataFrame:
    s = v.log.selectExpr("key", "event_id", "case event_id % 3 when 0 then 'NACKED' when 1 then 'CANCELED' else 'ACKED' end as state")
    return commits.transitions(s, ["key"], "event_id").select("event_id", "before", "state", "allowed")


@query(PLAIN_STATS)
def ack_stats(v: Views) -> DataFrame:
    return commits.statistics(v.acks)


@query(STATS_SQL.format(more="key % 3 AS attr,", by=", key % 3"))
def ack_stats_by_attr(v: Views) -> DataFrame:
    return commits.statistics(v.acks.withColumn("attr", F.col("key") % 3), "attr")


@query(f"SELECT topic, part, round((size - canceled) / 300.0, 6) AS load FROM ({PLAIN_STATS})")
def load_factor(v: Views) -> DataFrame:
    return commits.load_factor(commits.statistics(v.acks), 300, True).select("topic", "part", F.round("load", 6).alias("load"))


@query(f"SELECT topic, part, lowest_cancelable FROM ({PLAIN_STATS}) WHERE (size - canceled) / 250.0 > 0.9 AND acked / size > 0.78 AND lowest_cancelable IS NOT NULL")
def head_blocking(v: Views) -> DataFrame:
    """With limits that some of these partitions meet."""
    return commits.head_blocking(commits.statistics(v.acks), 250, 0.9, 0.78).select("topic", "part", "lowest_cancelable")


@query("SELECT topic, part, count(*) AS live FROM acks WHERE status <> 'ACKED' GROUP BY topic, part")
def live_messages(v: Views) -> DataFrame:
    """Received less acknowledged."""
    done = v.acks.where("status = 'ACKED'").select("event_id")
    return v.log.join(done, "event_id", "left_anti").groupBy("topic", "part").agg(F.count("*").alias("live"))


@query("""SELECT topic, second, n, bytes, n > 1 AS messages_over, bytes > 9 AS bytes_over FROM (SELECT topic, ts_ms // 1000 AS second, count(*) AS n, sum(vbytes)::BIGINT AS bytes FROM log GROUP BY topic, ts_ms // 1000) WHERE n > 1 OR bytes > 9""")
def rate_limited_seconds(v: Views) -> DataFrame:
    """Seconds over the quota of one message or nine bytes."""
    by = v.log.groupBy("topic", F.expr("ts_ms div 1000").alias("second")).agg(F.count("*").alias("n"), F.sum("vbytes").alias("bytes"))
    return by.where("n > 1 or bytes > 9").select("*", (F.col("n") > 1).alias("messages_over"), (F.col("bytes") > 9).alias("bytes_over"))


@query("SELECT group_id, CASE WHEN sum(m) <= 0 THEN 1 ELSE round(sum(m), 4) END AS msgs, count(*) AS n FROM (SELECT group_id, scale * 100 AS m FROM jobs WHERE state = 'RUNNING') GROUP BY group_id")
def pipeline_quota(v: Views) -> DataFrame:
    m = F.sum(F.col("scale") * 100)
    return v.jobs.where("state = 'RUNNING'").groupBy("group_id").agg(F.when(m <= 0, F.lit(1.0)).otherwise(F.round(m, 4)).alias("msgs"), F.count("*").alias("n"))


@query("SELECT j.job_id, round(g.msgs / greatest(g.n_jobs, 1), 6) AS msgs, round(g.bytes / greatest(g.n_jobs, 1), 6) AS bytes FROM jobs j JOIN groups g ON j.group_id = g.group_id")
def quota_split(v: Views) -> DataFrame:
    g = v.groups.selectExpr("group_id", "msgs / greatest(n_jobs, 1) as m", "bytes / greatest(n_jobs, 1) as b")
    return v.jobs.join(g, "group_id").select("job_id", F.round("m", 6).alias("msgs"), F.round("b", 6).alias("bytes"))


POD_RATIO = "CASE pod WHEN 0 THEN 0.5 WHEN 1 THEN 0.25 ELSE 1.0 END"


@query(f"SELECT job_id, round(g.msgs * {POD_RATIO} / n, 6) AS msgs FROM (SELECT *, job_id % 4 AS pod, count(*) OVER (PARTITION BY group_id, job_id % 4) AS n FROM jobs) j JOIN groups g ON j.group_id = g.group_id")
def quota_split_pod(v: Views) -> DataFrame:
    """The group's quota times the pod's ratio over the group's jobs in the pod."""
    j = v.jobs.withColumn("pod", F.col("job_id") % 4)
    n = j.groupBy("group_id", "pod").agg(F.count("*").alias("n"))
    return j.join(n, ["group_id", "pod"]).join(v.groups.select("group_id", "msgs"), "group_id").select("job_id", F.round(F.col("msgs") * F.expr(POD_RATIO) / F.col("n"), 6).alias("msgs"))


@query("""WITH RECURSIVE e AS (SELECT topic, part, off, event_id % 4 = 0 AS credit FROM log), r AS (SELECT topic, part, off, CASE WHEN credit THEN 2 ELSE 0 END AS bal, FALSE AS granted FROM e WHERE off = 0
 UNION ALL SELECT e.topic, e.part, e.off, CASE WHEN e.credit THEN bal + 2 WHEN bal >= 1 THEN bal - 1 ELSE bal END, NOT e.credit AND bal >= 1 FROM r JOIN e ON e.topic = r.topic AND e.part = r.part AND e.off = r.off + 1) SELECT topic, part, off, granted FROM r""")
def token_bucket(v: Views) -> DataFrame:
    """Every fourth event credits two tokens, the others ask for one; a balance that stops at 0 is a running minimum away from a sum."""
    events = v.log.select("topic", "part", "off", (F.col("event_id") % 4 == 0).alias("credit")).withColumn("change", F.when(F.col("credit"), 2).otherwise(-1))
    held = windows.reflected(events, ["topic", "part"], ["off"], "change", "held")
    return held.select("topic", "part", "off", (~F.col("credit") & (F.col("held") >= 1)).alias("granted"))


#: Credits and debits that have not expired, as a list: what is left of it is the balance.
HELD_SQL = "list_filter(held, lambda x: x.t > {now} - {window})"


@query(f"""WITH RECURSIVE e AS (SELECT topic, part, off, ts_ms, event_id % 4 = 0 AS credit, row_number() OVER (PARTITION BY topic, part ORDER BY ts_ms, off) AS k FROM log),
 r AS (SELECT DISTINCT topic, part, CAST(NULL AS BIGINT) AS off, CAST(0 AS BIGINT) AS k, FALSE AS granted, CAST([] AS STRUCT(t BIGINT, d INT)[]) AS held FROM e
 UNION ALL SELECT topic, part, off, k, NOT credit AND left_ >= 1, CASE WHEN credit THEN list_append(held, {{'t': ts_ms, 'd': 2}}) WHEN left_ >= 1 THEN list_append(held, {{'t': ts_ms, 'd': -1}}) ELSE held END
 FROM (SELECT *, coalesce(list_sum(list_transform(held, lambda x: x.d)), 0) + 1 AS left_ FROM (SELECT e.topic, e.part, e.off, e.k, e.credit, e.ts_ms, {HELD_SQL.format(now="e.ts_ms", window=21_600_000)} AS held FROM r JOIN e ON e.topic = r.topic AND e.part = r.part AND e.k = r.k + 1)))
 SELECT topic, part, off, granted FROM r WHERE k > 0""")
def token_bucket_window(v: Views) -> DataFrame:
    """As token_bucket with one free token, and credits and debits that expire after six hours."""

    def step(t: folds.Tokens, r: dict) -> bool:
        if r["event_id"] % 4 == 0:
            t.credit(r["ts_ms"], 2)
            return False
        return t.acquire(r["ts_ms"])

    return folds.ordered_fold(v.log, ["topic", "part"], ["ts_ms", "off"], ["topic", "part", "off", "event_id", "ts_ms"], lambda: folds.Tokens(21_600_000, 1), step, "granted", "boolean").drop("event_id", "ts_ms")


@query(f"""WITH RECURSIVE e AS (SELECT topic, part, event_id, ts_ms, code, role, timeout_count, row_number() OVER (PARTITION BY topic, part ORDER BY ts_ms, off) AS k FROM (SELECT *, {CODE_SQL} AS code, {ROLE_SQL} AS role FROM resp)),
 r AS (SELECT DISTINCT topic, part, CAST(NULL AS BIGINT) AS event_id, CAST(0 AS BIGINT) AS k, '' AS result, CAST([] AS STRUCT(t BIGINT, d INT)[]) AS held FROM e
 UNION ALL SELECT topic, part, event_id, k, CASE WHEN code <> 'BACKOFF' THEN code WHEN role = 'DLQ' THEN 'DLQ' WHEN role = 'RESQ' THEN 'INVALID' WHEN timeout_count >= 2 AND left_ >= 1 THEN 'DLQ' ELSE 'RETRY' END,
 CASE WHEN code IN ('SKIP', 'COMMIT') THEN list_append(held, {{'t': ts_ms, 'd': 1}}) WHEN code = 'BACKOFF' AND role NOT IN ('DLQ', 'RESQ') AND timeout_count >= 2 AND left_ >= 1 THEN list_append(held, {{'t': ts_ms, 'd': -1}}) ELSE held END
 FROM (SELECT *, coalesce(list_sum(list_transform(held, lambda x: x.d)), 0) + 1 AS left_ FROM (SELECT e.*, {HELD_SQL.format(now="e.ts_ms", window=300_000)} AS held FROM r JOIN e ON e.topic = r.topic AND e.part = r.part AND e.k = r.k + 1)))
 SELECT event_id, result FROM r WHERE k > 0""")
def timeout_escalate_tokens(v: Views) -> DataFrame:
    """Timeouts beyond the limit go to the dead letters only while tokens last; commits and skips credit one."""
    x = v.resp.withColumn("code", _code()).withColumn("role", _role())

    def step(t: folds.Tokens, r: dict) -> str:
        if r["code"] in ("SKIP", "COMMIT"):
            t.credit(r["ts_ms"])
            return r["code"]
        if r["code"] != "BACKOFF":
            return r["code"]
        if r["role"] in ("DLQ", "RESQ"):
            return "DLQ" if r["role"] == "DLQ" else "INVALID"
        return "DLQ" if r["timeout_count"] >= 2 and t.acquire(r["ts_ms"]) else "RETRY"

    return folds.ordered_fold(x, ["topic", "part"], ["ts_ms", "off"], ["event_id", "code", "role", "timeout_count", "ts_ms"], lambda: folds.Tokens(300_000, 1), step, "result", "string").select("event_id", "result")


@query("""WITH RECURSIVE e AS (SELECT topic, part, off, event_id % 3 = 0 AS rel FROM log), r AS (SELECT topic, part, off, CASE WHEN rel THEN 0 ELSE 1 END AS used, NOT rel AS granted FROM e WHERE off = 0
 UNION ALL SELECT e.topic, e.part, e.off, CASE WHEN e.rel THEN greatest(used - 1, 0) WHEN used <= 4 THEN used + 1 ELSE used END, NOT e.rel AND used <= 4 FROM r JOIN e ON e.topic = r.topic AND e.part = r.part AND e.off = r.off + 1) SELECT topic, part, off, granted FROM r""")
def inflight_limit(v: Views) -> DataFrame:
    """At most five in flight; every third event releases one."""
    return _inflight(v, lambda: folds.Inflight(5))


BOOTSTRAP = """WITH RECURSIVE e AS (SELECT topic, part, off, event_id % 3 = 0 AS rel FROM log), r AS (SELECT DISTINCT topic, part, CAST(-1 AS BIGINT) AS off, 0 AS used, 0 AS done, FALSE AS granted FROM log
 UNION ALL SELECT topic, part, off, CASE WHEN rel THEN greatest(used - 1, 0) WHEN used < most THEN used + 1 ELSE used END, CASE WHEN rel THEN done + 1 ELSE done END, NOT rel AND used < most
 FROM (SELECT e.topic, e.part, e.off, e.rel, used, done, CASE WHEN done <= 20 THEN 3 ELSE {most} END AS most FROM r JOIN e ON e.topic = r.topic AND e.part = r.part AND e.off = r.off + 1)) SELECT topic, part, off, granted FROM r WHERE off >= 0"""


@query(BOOTSTRAP.format(most=10))
def bootstrap_limit(v: Views) -> DataFrame:
    """At most ten in flight, three until more than twenty have succeeded."""
    return _inflight(v, lambda: folds.Inflight(10, 3, 20))


@query(BOOTSTRAP.format(most=2_000_000_000))
def bootstrap_unlimited(v: Views) -> DataFrame:
    """Without a limit of its own, yet three at first."""
    return _inflight(v, lambda: folds.Inflight(0, 3, 20))


@query("""WITH RECURSIVE e AS (SELECT topic, part, off, vbytes, event_id % 3 = 0 AS rel FROM log), r AS (SELECT DISTINCT topic, part, CAST(-1 AS BIGINT) AS off, CAST([] AS STRUCT(off BIGINT, b BIGINT, own BOOLEAN)[]) AS held, '' AS result FROM log
 UNION ALL SELECT topic, part, off, CASE WHEN rel THEN held[2:] WHEN result IN ('OWN', 'POOL') THEN list_append(held, {'off': off, 'b': vbytes, 'own': result = 'OWN'}) ELSE held END, CASE WHEN rel THEN 'DONE' ELSE result END
 FROM (SELECT *, CASE WHEN vbytes <= 0 THEN 'EMPTY' WHEN len(held) >= 6 THEN 'FULL' WHEN coalesce(list_sum(list_transform(list_filter(held, lambda x: x.own), lambda x: x.b)), 0) + vbytes <= 20 THEN 'OWN' WHEN coalesce(list_sum(list_transform(list_filter(held, lambda x: NOT x.own), lambda x: x.b)), 0) + vbytes <= 30 THEN 'POOL' ELSE 'FULL' END AS result
 FROM (SELECT e.topic, e.part, e.off, e.vbytes, e.rel, held FROM r JOIN e ON e.topic = r.topic AND e.part = r.part AND e.off = r.off + 1))) SELECT topic, part, off, result FROM r WHERE off >= 0""")
def inbound_acquire(v: Views) -> DataFrame:
    """Two partitions' worth of three messages and ten bytes, thirty bytes in the pool; every third event ends the oldest message in hand."""

    def step(x: folds.Inbound, r: dict) -> str:
        if r["event_id"] % 3 == 0:
            if x.held:
                x.done(next(iter(x.held)))
            return "DONE"
        return x.receive(r["off"], r["vbytes"])

    return folds.ordered_fold(v.log, ["topic", "part"], ["off"], ["topic", "part", "off", "event_id", "vbytes"], lambda: folds.Inbound(2, 3, 10_000, 10, 30), step, "result", "string").drop("event_id", "vbytes")


@query("""WITH RECURSIVE ev AS (SELECT topic, part, off, 2 * off AS tick, 'RECEIVE' AS action FROM log UNION ALL SELECT topic, part, off, 2 * (off + event_id % 7) + 1, 'ACK' FROM log), e AS (SELECT *, row_number() OVER (PARTITION BY topic, part ORDER BY tick, off) AS k FROM ev),
 r AS (SELECT DISTINCT topic, part, CAST(NULL AS BIGINT) AS off, '' AS action, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(o BIGINT, a BOOLEAN)[]) AS q, CAST([] AS BIGINT[]) AS live, CAST(0 AS BIGINT) AS returned FROM log
 UNION ALL SELECT topic, part, off, action, k, CASE WHEN action = 'RECEIVE' THEN CASE WHEN res = 1 THEN list_append(q, {'o': off, 'a': FALSE}) ELSE q END WHEN res > 0 THEN marked[first:] ELSE marked END,
  CASE WHEN action = 'RECEIVE' THEN CASE WHEN res = 1 THEN list_append(live, off) ELSE live END ELSE list_filter(live, lambda x: x <> off) END, res
 FROM (SELECT *, CASE WHEN action = 'RECEIVE' THEN CASE WHEN len(q) >= 5 THEN -2 WHEN len(live) >= 4 THEN -1 ELSE 1 END WHEN NOT list_contains(list_transform(q, lambda x: x.o), off) THEN -1 WHEN q[1].o <> off THEN -3 ELSE marked[first - 1].o + 1 END AS res
 FROM (SELECT *, coalesce(list_position(list_transform(marked, lambda x: x.a), FALSE), len(marked) + 1) AS first FROM (SELECT e.topic, e.part, e.off, e.action, e.k, q, live, list_transform(q, lambda x: {'o': x.o, 'a': x.a OR (e.action = 'ACK' AND x.o = e.off)}) AS marked FROM r JOIN e ON e.topic = r.topic AND e.part = r.part AND e.k = r.k + 1))))
 SELECT topic, part, off, action, returned FROM r WHERE k > 0""")
def ack_manager(v: Views) -> DataFrame:
    """Limits of four messages in hand and five in the queue: what is received while either is full is not taken, and its acknowledgement finds nothing."""
    received = v.log.selectExpr("topic", "part", "off", "2 * off as at", "'RECEIVE' as action")
    done = v.log.selectExpr("topic", "part", "off", "2 * (off + event_id % 7) + 1 as at", "'ACK' as action")

    def step(m: folds.AckManager, r: dict) -> int:
        return m.receive(r["off"], 1) if r["action"] == "RECEIVE" else m.ack(r["off"])

    return folds.ordered_fold(received.unionByName(done), ["topic", "part"], ["at", "off"], ["topic", "part", "off", "action"], lambda: folds.AckManager(folds.Inbound(1, 4), 5), step, "returned", "long")


def _inflight(v: Views, start) -> DataFrame:
    def step(f: folds.Inflight, r: dict) -> bool:
        if r["event_id"] % 3 == 0:
            f.release()
            return False
        return f.acquire()

    return folds.ordered_fold(v.log, ["topic", "part"], ["off"], ["topic", "part", "off", "event_id"], start, step, "granted", "boolean").drop("event_id")


@query(f"""WITH RECURSIVE e AS (SELECT topic, part, event_id, outcome, cost, event_id % 5 = 0 AS closed, CASE WHEN rule IS NULL THEN 'JOB_NOT_SUPPORTED' WHEN NOT list_contains(string_split(reasons, ','), reason) THEN 'REASON_NOT_MATCH' END AS no, rule, row_number() OVER (PARTITION BY topic, part ORDER BY off) AS k
  FROM (SELECT *, {CODE_SQL} AS outcome, if(event_id % 2 = 0, 'BLOCKING', 'SATURATION') AS reason, {CANCEL_SQL} FROM (SELECT *, {ROLE_SQL} AS role FROM resp))),
 r AS (SELECT DISTINCT topic, part, CAST(NULL AS BIGINT) AS event_id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS bal, '' AS result FROM e
 UNION ALL SELECT topic, part, event_id, k, CASE WHEN no IS NOT NULL OR bal < cost OR closed THEN bal ELSE bal - cost END, CASE WHEN no IS NOT NULL THEN no WHEN bal < cost THEN 'RATE_LIMITED' WHEN closed THEN 'CLOSED' ELSE rule END
 FROM (SELECT e.*, r.bal + CASE WHEN e.outcome = 'COMMIT' THEN 1 ELSE 0 END AS bal FROM r JOIN e ON e.topic = r.topic AND e.part = r.part AND e.k = r.k + 1)) SELECT event_id, result FROM r WHERE k > 0""")
def cancel_result(v: Views) -> DataFrame:
    """Attempts to cancel a blocked head: rule, reason, tokens (one is earned by each commit)."""
    rule = d.cancel_rule(_role(), F.col("retry_topic"), F.col("resq_topic"))
    x = v.resp.select("topic", "part", "off", "event_id", _code().alias("outcome"), rule["code"].alias("code"), rule["cost"].alias("cost"), rule["reasons"].alias("reasons"), F.expr("if(event_id % 2 = 0, 'BLOCKING', 'SATURATION')").alias("reason"))

    def step(t: folds.Tokens, r: dict) -> str:
        if r["outcome"] == "COMMIT":
            t.credit(0)
        if r["code"] is None:
            return "JOB_NOT_SUPPORTED"
        if r["reason"] not in r["reasons"].split(","):
            return "REASON_NOT_MATCH"
        if not t.acquire(0, r["cost"]):
            return "RATE_LIMITED"
        if r["event_id"] % 5 == 0:  # the message is closed: its tokens come back
            t.credit(0, r["cost"])
            return "CLOSED"
        return r["code"]

    return folds.ordered_fold(x, ["topic", "part"], ["off"], ["event_id", "outcome", "code", "cost", "reasons", "reason"], lambda: folds.Tokens(None), step, "result", "string").select("event_id", "result")


@query("""WITH a AS (SELECT *, row_number() OVER (PARTITION BY topic, part ORDER BY event_id * 7919 % 10007, off) AS t FROM acks WHERE status = 'ACKED'), m AS (SELECT x.topic, x.part, x.off, t, max(coalesce(a.t, 4611686018427387904)) OVER (PARTITION BY x.topic, x.part ORDER BY x.off) AS done FROM acks x LEFT JOIN a ON a.event_id = x.event_id)
 SELECT topic, part, off, part < 6 AS assigned, CASE WHEN part >= 6 THEN -1 WHEN done = t THEN (SELECT max(off) FROM m y WHERE y.topic = m.topic AND y.part = m.part AND y.done <= m.t) + 1 ELSE -3 END AS returned FROM m WHERE t IS NOT NULL""")
def ack_status(v: Views) -> DataFrame:
    """One queue for each partition that a job has; what comes from others was refused when received, so its acknowledgement returns -1."""
    jobs = v.jobs.selectExpr("job_id % 6 as part").distinct().withColumn("known", F.lit(True))
    met = v.acks.where("status = 'ACKED'").join(F.broadcast(jobs.limit(6)), "part", "left")  # six partitions at most
    lost = met.where("known is null").select("topic", "part", "off", F.lit(False).alias("assigned"), F.lit(-1).cast("long").alias("returned"))
    w = Window.partitionBy("topic", "part").orderBy(F.col("event_id") * 7919 % 10007, "off")
    held = v.acks.join(F.broadcast(jobs.limit(6)), "part").withColumn("t", F.row_number().over(w).cast("long"))
    return commits.progress(held, "t").select("topic", "part", "off", F.lit(True).alias("assigned"), "returned").unionByName(lost)


@query("SELECT event_id, max(CASE WHEN event_id % 50 = 0 THEN ts_ms END) OVER (PARTITION BY topic ORDER BY ts_ms RANGE BETWEEN 1800000 PRECEDING AND CURRENT ROW) IS NOT NULL AS adaptive FROM log")
def limiter_mode(v: Views) -> DataFrame:
    """Adaptive while a drop lies within the last 30 minutes."""
    return windows.recent(v.log.select("topic", "ts_ms", "event_id"), ["topic"], "ts_ms", 1_800_000, F.col("event_id") % 50 == 0, "adaptive").select("event_id", "adaptive")


@query("SELECT group_id, least(10000, n * 1000) AS messages, n * 10485760 AS bytes, greatest(0, n * 10485760 - 536870912) AS beyond_pool FROM (SELECT group_id, count(*) AS n FROM jobs GROUP BY group_id)")
def inbound_limits(v: Views) -> DataFrame:
    return v.jobs.groupBy("group_id").agg(F.count("*").alias("n")).selectExpr("group_id", "least(10000, n * 1000) as messages", "n * 10485760 as bytes", "greatest(0, n * 10485760 - 536870912) as beyond_pool")


@query("SELECT topic, part, off, row_number() OVER (PARTITION BY topic ORDER BY rn, part) AS turn FROM (SELECT *, row_number() OVER (PARTITION BY topic, part ORDER BY off) AS rn FROM acks WHERE status = 'NACKED')")
def fair_order(v: Views) -> DataFrame:
    """Waiting partitions take turns, each by offset."""
    return windows.turns(v.acks.where("status = 'NACKED'").select("topic", "part", "off"), ["topic"], "part", ["off"], "turn")


RING = "SELECT topic, bucket, {f} AS {n} FROM (SELECT topic, ts_ms // 3600000 AS bucket, max(value) AS mx, min(value) AS mn, sum(value) AS sm, count(*) AS ct FROM log GROUP BY topic, ts_ms // 3600000) WINDOW w AS (PARTITION BY topic ORDER BY bucket RANGE BETWEEN 9 PRECEDING AND CURRENT ROW)"


@query(RING.format(f="max(mx) OVER w", n="max"))
def ring_max(v: Views) -> DataFrame:
    return windows.ring(v.log, ["topic"], "ts_ms", 3_600_000, 10, "value", "max")


@query(RING.format(f="min(mn) OVER w", n="min"))
def ring_min(v: Views) -> DataFrame:
    return windows.ring(v.log, ["topic"], "ts_ms", 3_600_000, 10, "value", "min")


@query(RING.format(f="floor(sum(sm) OVER w / sum(ct) OVER w * 1000 + 0.0005) / 1000", n="avg"))
def ring_avg(v: Views) -> DataFrame:
    return windows.ring(v.log, ["topic"], "ts_ms", 3_600_000, 10, "value", "avg").withColumn("avg", F.floor(F.col("avg") * 1000 + 0.0005) / 1000)


@query("SELECT topic, minute, max(vbytes) AS max_inflight, 0 AS min_inflight, CAST(sum(vbytes) // count(*) AS BIGINT) AS avg_inflight FROM (SELECT topic, ts_ms // 60000 AS minute, vbytes FROM log) GROUP BY topic, minute")
def inflight_minute(v: Views) -> DataFrame:
    """Minimum folds from 0, so it is 0; the average truncates."""
    return v.log.groupBy("topic", F.expr("ts_ms div 60000").alias("minute")).agg(F.max("vbytes").alias("max_inflight"), F.lit(0).alias("min_inflight"), F.expr("sum(vbytes) div count(*)").alias("avg_inflight"))


@query("""WITH t AS (SELECT topic, ts_ms // 5000 AS tick, count(*) AS n FROM log GROUP BY topic, ts_ms // 5000), e AS (SELECT topic, min(tick) AS t0, max(tick) AS t1 FROM t GROUP BY topic)
 SELECT t.topic, round(sum(n / 5.0 * CASE WHEN tick = t0 THEN 1.0 ELSE 1 - exp(-5.0 / 60) END * pow(exp(-5.0 / 60), t1 - tick)), 6) AS rate FROM t JOIN e ON t.topic = e.topic GROUP BY t.topic""")
def ewma_rate(v: Views) -> DataFrame:
    return windows.ewma(v.log, ["topic"], "ts_ms").select("topic", F.round("rate", 6).alias("rate"))


LATENCY = "SELECT topic, median(value) AS med, max(value) AS mx, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY event_id DESC) AS r FROM log WHERE value > 0) WHERE r <= 10000 GROUP BY topic"


#: Fixed value: spans that a reservoir holds, and needs to be mature.
RESERVOIR = 10_000


def _latency(v: Views) -> DataFrame:
    last = Window.partitionBy("topic").orderBy(F.desc("event_id"))
    return v.log.where("value > 0").withColumn("r", F.row_number().over(last)).where(F.col("r") <= RESERVOIR).groupBy("topic").agg(F.percentile("value", 0.5).alias("med"), F.max("value").alias("mx"), F.count("*").alias("n"))


@query(f"SELECT topic, round(med, 6) AS median, round(mx, 6) AS max, n = 10000 AS mature FROM ({LATENCY})")
def latency_stats(v: Views) -> DataFrame:
    """Over the last spans only, as the reservoir holds them; the limit is the feature."""
    return _latency(v).select("topic", F.round("med", 6).alias("median"), F.round("mx", 6).alias("max"), (F.col("n") == RESERVOIR).alias("mature"))


@query(f"SELECT topic, CASE WHEN n < 10000 THEN NULL WHEN med > 50.0 THEN 'median-latency' WHEN mx > 100.0 THEN 'max-latency' END AS issue FROM ({LATENCY})")
def latency_issue(v: Views) -> DataFrame:
    """Ceilings are inbound limit and commit skew over the rate; the median is tried first, on mature samples."""
    return _latency(v).select("topic", F.when(F.col("n") < RESERVOIR, None).when(F.col("med") > 1000 / 20.0, "median-latency").when(F.col("mx") > 2000 / 20.0, "max-latency").alias("issue"))


@query("""WITH b AS (SELECT topic, CAST(least(99, greatest(0, ceil((value - 0) / 2.0))) AS INT) AS b, count(*) AS c FROM log GROUP BY ALL), r AS (SELECT *, sum(c) OVER (PARTITION BY topic ORDER BY b) AS cum, floor(0.9 * sum(c) OVER (PARTITION BY topic)) AS piv FROM b)
 SELECT topic, CASE WHEN min(piv) <= 0 THEN 0.0 ELSE min(b) * 2.0 END AS percentile FROM r WHERE cum >= piv GROUP BY topic""")
def hist_percentile(v: Views) -> DataFrame:
    return windows.histogram_percentile(v.log, ["topic"], "value", 0.0, 200.0, 0.9)


@query("SELECT job_id, count(*) >= 10 AND max(ts_ms) - min(ts_ms) > 2400000000 AS mature FROM status GROUP BY job_id")
def window_mature(v: Views) -> DataFrame:
    return v.status.groupBy("job_id").agg(((F.count("*") >= 10) & (F.max("ts_ms") - F.min("ts_ms") > 2_400_000_000)).alias("mature"))


#: Fixed values for the example: upper bounds in ms.
LATENCY_BOUNDS = [0, 100, 1_000, 60_000, 3_600_000, 86_400_000, 604_800_000]


@query(f"SELECT topic, bucket, count(*) AS n FROM (SELECT topic, {' + '.join(f'CAST(now - ts_ms > {b} AS INT)' for b in LATENCY_BOUNDS)} AS bucket FROM (SELECT *, {CODE_SQL} AS code FROM resp), (SELECT max(ts_ms) AS now FROM log) WHERE code = 'COMMIT') GROUP BY topic, bucket")
def latency_histogram(v: Views) -> DataFrame:
    """End-to-end latency of commits in duration buckets."""
    now = v.log.agg(F.max("ts_ms")).first()[0] or 0
    age = F.lit(now) - F.col("ts_ms")
    bucket = sum(((age > b).cast("int") for b in LATENCY_BOUNDS), F.lit(0))
    return v.resp.where(_code() == "COMMIT").groupBy("topic", bucket.alias("bucket")).agg(F.count("*").alias("n"))


@query(f"SELECT code, list_position(['DLQ','RETRY','RESQ','BACKOFF','DROPPED','INVALID','SKIP','COMMIT'], code) - 1 AS ordinal, count(*) AS n FROM (SELECT {CODE_SQL} AS code FROM resp) GROUP BY code")
def response_distribution(v: Views) -> DataFrame:
    return v.resp.groupBy(_code().alias("code")).agg(F.count("*").alias("n")).select("code", (F.array_position(F.lit(d.OUTCOMES), F.col("code")) - 1).alias("ordinal"), "n")


@query("""WITH i AS (SELECT DISTINCT topic, ts_ms // 86400000 AS day, CASE WHEN action IS NOT NULL THEN NULL WHEN status IN ('UNAVAILABLE','UNKNOWN','UNIMPLEMENTED','INTERNAL') THEN 'invalid-response' WHEN status IN ('PERMISSION_DENIED','UNAUTHENTICATED') THEN 'permission-denied' END AS issue FROM resp),
 d AS (SELECT DISTINCT topic, day FROM i) SELECT d.topic, d.day, count(DISTINCT i.issue) AS issues FROM d LEFT JOIN i ON i.topic = d.topic AND i.day BETWEEN d.day - 2 AND d.day GROUP BY d.topic, d.day""")
def health_window(v: Views) -> DataFrame:
    """Distinct issues of the last three fixed windows."""
    daily = v.resp.groupBy("topic", F.expr("ts_ms div 86400000").alias("day")).agg(F.collect_set(d.health_issue(F.col("action"), F.col("status"))).alias("s"))
    w = Window.partitionBy("topic").orderBy("day").rangeBetween(-2, 0)
    return daily.select("topic", "day", F.size(F.array_distinct(F.flatten(F.collect_list("s").over(w)))).cast("long").alias("issues"))


@query("""WITH RECURSIVE e AS (SELECT topic, ts_ms, event_id, vbytes, row_number() OVER (PARTITION BY topic ORDER BY ts_ms, event_id) AS k FROM log),
 s AS (SELECT topic, k, ts_ms, vbytes FROM e WHERE k = 1 UNION ALL SELECT n.topic, n.k, n.ts_ms, n.vbytes FROM (SELECT s.topic, min(e.k) AS k FROM s JOIN e ON e.topic = s.topic AND e.ts_ms >= s.ts_ms + 3600000 GROUP BY s.topic) m JOIN e n ON n.topic = m.topic AND n.k = m.k),
 d AS (SELECT *, lead(k, 1, 4611686018427387904) OVER (PARTITION BY topic ORDER BY k) AS upto FROM s) SELECT e.event_id, d.vbytes AS sample FROM e JOIN d ON d.topic = e.topic AND e.k >= d.k AND e.k < d.upto""")
def linger_sampler(v: Views) -> DataFrame:
    """A sample is taken anew when an hour has passed since the last, else the cached one is returned."""

    def step(state: dict, r: dict) -> int:
        if not state or r["ts_ms"] - state["at"] >= 3_600_000:
            state.update(at=r["ts_ms"], value=r["vbytes"])
        return state["value"]

    return folds.ordered_fold(v.log, ["topic"], ["ts_ms", "event_id"], ["event_id", "vbytes", "ts_ms"], dict, step, "sample", "long").select("event_id", "sample")


@query("SELECT job_id, round(CASE WHEN sum(cpu) OVER () = 0 THEN 0 ELSE cpu / sum(cpu) OVER () END, 9) AS share FROM (SELECT job_id, sum(cpu) AS cpu FROM status GROUP BY job_id)")
def cpu_share(v: Views) -> DataFrame:
    by = v.status.groupBy("job_id").agg(F.sum("cpu").alias("cpu"))
    total = v.status.agg(F.sum("cpu")).first()[0] or 0.0
    return by.select("job_id", F.round(F.col("cpu") / total if total else F.lit(0.0), 9).alias("share"))


@query("SELECT j.group_id, round(sum(s.cpu) / greatest(count(DISTINCT j.job_id), 1), 6) AS cpu_per_job FROM jobs j JOIN status s ON s.job_id = j.job_id GROUP BY j.group_id")
def cpu_per_job(v: Views) -> DataFrame:
    by = v.status.groupBy("job_id").agg(F.sum("cpu").alias("cpu"))
    return v.jobs.join(by, "job_id").groupBy("group_id").agg(F.round(F.sum("cpu") / F.count("*"), 6).alias("cpu_per_job"))
