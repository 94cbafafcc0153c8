"""Queries on sources, sinks, projections and decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions import decisions as d
from tidelog.operators import folds, reconcile, routing, scans
from tidelog.plans.registry import query
from tidelog.sources.views import Views

STATUS_SQL = """CASE WHEN status = 'OK' THEN 'COMMIT' WHEN status = 'ALREADY_EXISTS' THEN 'SKIP' WHEN status = 'RESOURCE_EXHAUSTED' THEN 'RETRY'
 WHEN status IN ('NOT_FOUND','INVALID_ARGUMENT','FAILED_PRECONDITION','ABORTED','OUT_OF_RANGE','DATA_LOSS') THEN 'DLQ'
 WHEN status = 'UNAVAILABLE' THEN CASE WHEN overdue THEN 'BACKOFF' ELSE 'INVALID' END WHEN status = 'DEADLINE_EXCEEDED' THEN 'BACKOFF' ELSE 'INVALID' END"""
ACTION_SQL = "CASE WHEN action = 'Retry' THEN 'RETRY' WHEN action = 'Stash' THEN 'DLQ' WHEN action = 'Skip' THEN 'SKIP' WHEN action IS NOT NULL THEN 'INVALID' END"
CODE_SQL = f"coalesce({ACTION_SQL}, {STATUS_SQL})"
ROLE_SQL = "CASE WHEN physical LIKE '%\\_\\_retry' ESCAPE '\\' THEN 'RETRY' WHEN physical LIKE '%\\_\\_dlq' ESCAPE '\\' THEN 'DLQ' WHEN physical LIKE '%\\_\\_resq' ESCAPE '\\' THEN 'RESQ' ELSE 'ORIGINAL' END"
BOUNDS_SQL = "SELECT range_id, start_off AS wanted, range_id % 7 * 10 AS earliest, 40 + range_id % 11 * 5 AS latest, CASE range_id % 3 WHEN 0 THEN 'EARLIEST' WHEN 1 THEN 'LATEST' ELSE 'NONE' END AS policy FROM ranges"


def _code():
    return d.outcome(F.col("action"), F.col("status"), F.col("overdue"))


def _role():
    return d.topic_role(F.col("physical"))


def _bounds(v: Views) -> DataFrame:
    return v.ranges.selectExpr("range_id", "start_off as wanted", "range_id % 7 * 10 as earliest", "40 + range_id % 11 * 5 as latest", "case range_id % 3 when 0 then 'EARLIEST' when 1 then 'LATEST' else 'NONE' end as policy")


@query(f"SELECT role, count(*) AS n FROM (SELECT {ROLE_SQL} AS role FROM resp) GROUP BY role")
def topic_role(v: Views) -> DataFrame:
    return v.resp.select(_role().alias("role")).groupBy("role").agg(F.count("*").alias("n"))


@query(f"SELECT range_id, CASE WHEN (wanted < earliest OR wanted > latest) AND policy = 'EARLIEST' THEN earliest WHEN (wanted < earliest OR wanted > latest) AND policy = 'LATEST' THEN latest ELSE wanted END AS seek FROM ({BOUNDS_SQL})")
def seek_original(v: Views) -> DataFrame:
    return _bounds(v).select("range_id", d.seek_original(*map(F.col, ("wanted", "earliest", "latest", "policy"))).alias("seek"))


@query("SELECT range_id, 'DO_NOT_SEEK' AS seek FROM ranges")
def seek_retry(v: Views) -> DataFrame:
    return v.ranges.select("range_id", F.lit("DO_NOT_SEEK").alias("seek"))


@query(f"SELECT range_id, CASE WHEN wanted < earliest THEN earliest WHEN wanted > latest THEN latest END AS seek FROM ({BOUNDS_SQL})")
def seek_dlq(v: Views) -> DataFrame:
    return _bounds(v).select("range_id", d.seek_dead_letter(*map(F.col, ("wanted", "earliest", "latest"))).alias("seek"))


@query(f"SELECT range_id, coalesce(CASE WHEN wanted < earliest THEN earliest WHEN wanted > latest THEN latest END, CASE WHEN range_id % 5 <> 0 THEN wanted END, wanted) AS position FROM ({BOUNDS_SQL})")
def seek_applied(v: Views) -> DataFrame:
    """Without a seek the committed offset, if there is one, becomes the position."""
    committed = F.when(F.col("range_id") % 5 != 0, F.col("wanted"))
    return _bounds(v).select("range_id", F.coalesce(d.seek_dead_letter(*map(F.col, ("wanted", "earliest", "latest"))), committed, F.col("wanted")).alias("position"))


@query("""SELECT range_id, topic, n, bytes FROM ranges JOIN (SELECT r.part, r.start_off, r.end_off, l.topic, count(*) AS n, sum(l.vbytes)::BIGINT AS bytes FROM (SELECT DISTINCT part, start_off, end_off FROM ranges) r
 JOIN log l ON l.part = r.part AND l.off >= r.start_off AND (r.end_off <= 0 OR l.off < r.end_off) GROUP BY r.part, r.start_off, r.end_off, l.topic) USING (part, start_off, end_off)""")
def bounded_scan(v: Views) -> DataFrame:
    """Records and bytes of [start, end) for each range and topic."""
    return scans.bounded_sums(v.log, v.ranges, ["topic"], ["part"], "vbytes").select("range_id", "topic", "n", F.col("total").alias("bytes"))


@query("SELECT range_id, part, end_off AS commit_off FROM ranges WHERE start_off = end_off AND end_off > 0")
def purge_offsets(v: Views) -> DataFrame:
    """Empty ranges read nothing, yet their end is committed."""
    return v.ranges.where("start_off = end_off and end_off > 0").selectExpr("range_id", "part", "end_off as commit_off")


@query("""WITH b AS (SELECT min(ts_ms) + 864000000 AS t0, min(ts_ms) + 1728000000 AS t1 FROM log), e AS (SELECT topic, part, coalesce(min(CASE WHEN ts_ms >= t1 THEN off END), max(off) + 1) AS end_off, min(CASE WHEN ts_ms >= t0 THEN off END) AS s FROM log, b GROUP BY topic, part)
 SELECT topic, part, coalesce(s, end_off) AS start_off, end_off FROM e""")
def offsets_for_times(v: Views) -> DataFrame:
    low = v.log.agg(F.min("ts_ms").alias("t")).first()["t"] or 0
    return scans.offsets_for_times(v.log, low + 864_000_000, low + 1_728_000_000)


@query("""SELECT p.topic, p.part, coalesce(min_by(r.start_off, r.range_id), 0) AS start_off, coalesce(min_by(r.end_off, r.range_id), 0) AS end_off FROM (SELECT DISTINCT topic, part FROM log) p LEFT JOIN (SELECT * FROM ranges WHERE part < 5) r ON r.part = p.part GROUP BY p.topic, p.part""")
def partition_ranges(v: Views) -> DataFrame:
    """The first range given for a partition, (0, 0) without one."""
    first = v.ranges.where("part < 5").groupBy("part").agg(F.min_by(F.struct("start_off", "end_off"), "range_id").alias("r"))
    return v.log.select("topic", "part").distinct().join(first, "part", "left").selectExpr("topic", "part", "coalesce(r.start_off, 0) as start_off", "coalesce(r.end_off, 0) as end_off")


@query("SELECT range_id, CASE WHEN end_off > 0 AND start_off >= end_off THEN 'CANCELED' ELSE 'RUNNING' END AS state FROM ranges UNION ALL SELECT -1, 'RUNNING'")
def batch_job_state(v: Views) -> DataFrame:
    """Jobs with nothing to read start canceled; a streaming job (-1, 0) takes its group's state."""
    stream = v.spark.createDataFrame([(-1, -1, 0)], "range_id long, start_off long, end_off long")
    both = v.ranges.select("range_id", "start_off", "end_off").unionByName(stream)
    return both.selectExpr("range_id", "case when start_off >= end_off and end_off > 0 then 'CANCELED' else 'RUNNING' end as state")


@query("""WITH want AS (SELECT group_id, p AS part, state FROM groups, (SELECT unnest(range(8)) AS p) x), have AS (SELECT DISTINCT group_id, job_id % 10 AS part FROM jobs WHERE job_id % 4 <> 0)
 SELECT coalesce(w.group_id, h.group_id) AS group_id, coalesce(w.part, h.part) AS part, CASE WHEN h.part IS NULL THEN 'ADD' WHEN w.part IS NULL THEN 'REMOVE' ELSE 'KEEP' END AS change FROM want w FULL OUTER JOIN have h ON w.group_id = h.group_id AND w.part = h.part""")
def partition_expansion(v: Views) -> DataFrame:
    """One job a partition: missing ones are added, extra ones removed."""
    want = v.groups.select("group_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))).alias("part"), F.lit(True).alias("w"))
    have = v.jobs.where("job_id % 4 <> 0").selectExpr("group_id", "job_id % 10 as part").distinct().withColumn("h", F.lit(True))
    return want.join(have, ["group_id", "part"], "full").selectExpr("group_id", "part", "case when h is null then 'ADD' when w is null then 'REMOVE' else 'KEEP' end as change")


@query("""SELECT w.uri AS topic FROM (SELECT DISTINCT uri FROM jobs UNION SELECT 'ghost') w ANTI JOIN (SELECT DISTINCT uri FROM jobs WHERE group_id < 5) h ON w.uri = h.uri""")
def missing_topics(v: Views) -> DataFrame:
    """Topics wanted that no cluster has."""
    want = v.jobs.select("uri").union(v.spark.createDataFrame([("ghost",)], "uri string")).distinct()
    return want.join(v.jobs.where("group_id < 5").select("uri"), "uri", "left_anti").withColumnRenamed("uri", "topic")


@query("SELECT topic, part, min(off) AS low, max(off) + 1 AS high FROM log GROUP BY topic, part")
def partition_watermarks(v: Views) -> DataFrame:
    return scans.watermarks(v.log)


@query("SELECT g.group_id, g.n_jobs AS version, j.job_id, j.state FROM groups g JOIN jobs j ON g.group_id = j.group_id")
def jobs_flatten(v: Views) -> DataFrame:
    """Groups with nested jobs, flattened with the group's version."""
    nested = v.jobs.groupBy("group_id").agg(F.count("*").alias("version"), F.collect_list(F.struct("job_id", "state")).alias("jobs"))
    return nested.select("group_id", "version", F.inline("jobs"))


@query("SELECT job_id, uri FROM jobs WHERE state = 'RUNNING' AND group_id = 3")
def store_select(v: Views) -> DataFrame:
    return v.jobs.where("state = 'RUNNING' and group_id = 3").select("job_id", "uri")


@query("""WITH n AS (SELECT max(ts_ms) AS now FROM log) SELECT topic, part, count(*) AS released, max(off) AS last_off FROM (SELECT *, max(ts_ms) OVER (PARTITION BY topic, part ORDER BY off) AS m FROM log) l, n WHERE m + 432000000 <= now GROUP BY topic, part""")
def delay_release(v: Views) -> DataFrame:
    """The prefix of each partition whose hold is over: a record that is not due holds all behind it."""
    return scans.released(v.log, 432_000_000, v.log.agg(F.max("ts_ms")).first()[0] or 0).groupBy("topic", "part").agg(F.count("*").alias("released"), F.max("off").alias("last_off"))


@query("SELECT l.topic, l.part, count(*) AS n FROM log l ANTI JOIN (SELECT DISTINCT job_id % 6 AS part FROM jobs) a ON l.part = a.part GROUP BY l.topic, l.part")
def unassigned_records(v: Views) -> DataFrame:
    return v.log.join(v.jobs.selectExpr("job_id % 6 as part").distinct(), "part", "left_anti").groupBy("topic", "part").agg(F.count("*").alias("n"))


@query("SELECT job_id AS old_id, (SELECT max(job_id) FROM jobs) + row_number() OVER (ORDER BY job_id) AS new_id FROM jobs WHERE worker_id = 0")
def assign_ids(v: Views) -> DataFrame:
    """Next ids in order for the jobs that lack one."""
    top = v.jobs.agg(F.max("job_id")).first()[0] or 0
    lack = scans.numbered(v.jobs.where("worker_id = 0").select(F.col("job_id").alias("old_id")), "old_id", "k")
    return lack.select("old_id", (F.col("k") + F.lit(top + 1)).alias("new_id"))


@query("SELECT event_id, CAST(least(1000.0, least(1000, greatest(1, vbytes * 10)) * pow(2.0, timeout_count)) AS BIGINT) AS timeout_ms FROM log")
def rpc_timeout(v: Views) -> DataFrame:
    return v.log.select("event_id", d.rpc_timeout(F.col("vbytes") * 10, F.col("timeout_count"), 1, 1000).alias("timeout_ms"))


@query("SELECT event_id, CASE WHEN off > 0 AND off >= retry_count * 10 THEN off END AS to_commit FROM log")
def offset_to_commit(v: Views) -> DataFrame:
    return v.log.select("event_id", d.offset_to_commit(F.col("off"), F.col("retry_count") * 10).alias("to_commit"))


@query("SELECT event_id, off > 0 AND (off <> coalesce(lag(off) OVER w, -1) OR ts_ms - lag(ts_ms) OVER w > 60000) AS eligible FROM (SELECT event_id, topic, part, off // 3 AS off, ts_ms FROM log) WINDOW w AS (PARTITION BY topic, part ORDER BY event_id)")
def commit_eligible(v: Views) -> DataFrame:
    w = Window.partitionBy("topic", "part").orderBy("event_id")
    x = v.log.selectExpr("event_id", "topic", "part", "off div 3 as off", "ts_ms").withColumns({"po": F.lag("off").over(w), "pt": F.lag("ts_ms").over(w)})
    return x.select("event_id", d.commit_eligible(F.col("off"), F.col("po"), F.col("ts_ms") - F.col("pt")).alias("eligible"))


@query("SELECT event_id, max(CASE WHEN event_id % 5 = 0 THEN -3 ELSE off * 7 % 41 END) OVER (PARTITION BY topic, part ORDER BY off) AS committed FROM log")
def commit_running_max(v: Views) -> DataFrame:
    """Committed offsets never fall, whatever acknowledgements return."""
    back = F.when(F.col("event_id") % 5 == 0, F.lit(-3)).otherwise(F.col("off") * 7 % 41)
    return v.log.select("event_id", F.max(back).over(Window.partitionBy("topic", "part").orderBy("off")).alias("committed"))


@query("SELECT job_id, max_by(msgs, event_id) AS msgs, max(event_id) AS version FROM status GROUP BY job_id")
def latest_per_key(v: Views) -> DataFrame:
    """The last write of each key wins."""
    return v.status.groupBy("job_id").agg(F.max_by("msgs", "event_id").alias("msgs"), F.max("event_id").alias("version"))


@query("""WITH RECURSIVE e AS (SELECT key, event_id, CASE WHEN event_id % 7 = 0 THEN 'REMOVE' WHEN event_id % 5 = 0 THEN 'CREATE' ELSE 'PUT' END AS op, event_id % 3 AS wanted, row_number() OVER (PARTITION BY key ORDER BY event_id) AS k FROM log),
 r AS (SELECT DISTINCT key, CAST(NULL AS BIGINT) AS event_id, CAST(0 AS BIGINT) AS k, CAST(-1 AS BIGINT) AS version, TRUE AS done FROM e
 UNION ALL SELECT e.key, e.event_id, e.k, CASE op WHEN 'REMOVE' THEN -1 WHEN 'CREATE' THEN version + 1 ELSE CASE WHEN version >= 0 AND version = wanted THEN version + 1 ELSE version END END, op <> 'PUT' OR (version >= 0 AND version = wanted) FROM r JOIN e ON e.key = r.key AND e.k = r.k + 1)
 SELECT event_id, version, done FROM r WHERE k > 0""")
def store_writes(v: Views) -> DataFrame:
    """Writes of each key in order: a put needs the version it names, a create does not, a removal may find nothing."""
    op = F.expr("case when event_id % 7 = 0 then 'REMOVE' when event_id % 5 = 0 then 'CREATE' else 'PUT' end")

    def step(s: folds.Versions, r: dict) -> int:
        return s.write(r["op"], r["wanted"])

    writes = v.log.select("key", "event_id", op.alias("op"), (F.col("event_id") % 3).alias("wanted"))
    out = folds.ordered_fold(writes, ["key"], ["event_id"], ["event_id", "op", "wanted"], folds.Versions, step, "state", "long")
    # Twice the version, and one more where the write was refused.
    return out.select("event_id", F.floor(F.col("state") / 2).cast("long").alias("version"), (F.pmod("state", F.lit(2)) == 0).alias("done"))


@query("SELECT job_id, t AS last_ms FROM (SELECT job_id, max(ts_ms) AS t FROM status GROUP BY job_id) WHERE t >= (SELECT max(ts_ms) FROM status) - 43200000")
def ttl_live(v: Views) -> DataFrame:
    now = v.status.agg(F.max("ts_ms")).first()[0] or 0
    return v.status.groupBy("job_id").agg(F.max("ts_ms").alias("last_ms")).where(F.col("last_ms") >= now - 43_200_000)


@query("SELECT event_id, job_id FROM (SELECT *, lag(s) OVER (PARTITION BY job_id ORDER BY event_id) AS p FROM (SELECT event_id, job_id, event_id % 3 AS s FROM status)) WHERE p IS NULL OR p <> s")
def status_changes(v: Views) -> DataFrame:
    """Rows that differ from the stored one, the first included."""
    s = v.status.selectExpr("event_id", "job_id", "event_id % 3 as s").withColumn("p", F.lag("s").over(Window.partitionBy("job_id").orderBy("event_id")))
    return s.where(~F.col("p").eqNullSafe(F.col("s"))).select("event_id", "job_id")


@query("""SELECT worker_id, '{"worker_id":' || worker_id || ',"pod":' || pod || ',"state":"' || state || '"}' AS json FROM workers""")
def management_json(v: Views) -> DataFrame:
    return v.workers.select("worker_id", F.to_json(F.struct("worker_id", "pod", "state")).alias("json"))


DECODED = f"SELECT event_id, CASE WHEN {ROLE_SQL} = 'ORIGINAL' THEN physical ELSE topic END AS logical_topic, CASE WHEN {ROLE_SQL} = 'ORIGINAL' THEN off ELSE off * 2 END AS logical_off, CASE WHEN {ROLE_SQL} = 'ORIGINAL' THEN 0 ELSE retry_count END AS retries, CASE WHEN {ROLE_SQL} = 'ORIGINAL' THEN 0 ELSE timeout_count END AS timeouts FROM resp"


@query(DECODED)
def envelope_decode(v: Views) -> DataFrame:
    """Logical coordinates and counters: from the envelope on retry, dead-letter and rescue topics, else as read."""
    envelope = F.struct(F.col("topic").alias("topic"), (F.col("off") * 2).alias("offset"), F.col("retry_count"), F.col("timeout_count"))
    return routing.decode(v.resp.withColumn("envelope", F.when(_role() != "ORIGINAL", envelope))).select("event_id", "logical_topic", "logical_off", "retries", "timeouts")


@query("SELECT event_id, topic || ':' || part || ':' || off || ':' || (retry_count + 1) || ':' || timeout_count || ':' || coalesce(CAST(CASE WHEN key % 3 = 0 THEN NULL ELSE key END AS VARCHAR), '-') AS envelope FROM log")
def envelope_encode(v: Views) -> DataFrame:
    """Coordinates, counters and the original key, without data where the key is null."""
    keyed = v.log.withColumn("data", F.when(F.col("key") % 3 != 0, F.col("key").cast("string")))
    e = routing.encode(keyed)
    return e.select("event_id", F.concat_ws(":", "envelope.topic", F.col("envelope.partition").cast("string"), F.col("envelope.offset").cast("string"), F.col("envelope.retry_count").cast("string"), F.col("envelope.timeout_count").cast("string"), F.coalesce("envelope.data", F.lit("-"))).alias("envelope"))


@query("SELECT event_id, CASE WHEN physical <> topic THEN 'physical-topic=' || physical || ',physical-partition=' || part || ',physical-offset=' || off END AS tracing, 'topic=' || topic || ';partition=' || part || ';offset=' || off || ';retrycount=' || retry_count AS headers FROM resp")
def rpc_headers(v: Views) -> DataFrame:
    m = routing.headers(v.resp)
    text = F.concat_ws(";", *[F.concat(F.lit(f"{k}="), F.col("headers")[k]) for k in ("topic", "partition", "offset", "retrycount")])
    return m.select("event_id", F.col("headers")["tracing-info"].alias("tracing"), text.alias("headers"))


@query("SELECT key AS msg, event_id % 4 AS header, min_by(off, event_id) AS first_value FROM log GROUP BY key, event_id % 4")
def header_dedup(v: Views) -> DataFrame:
    """The first value of each header name."""
    return v.log.groupBy(F.col("key").alias("msg"), (F.col("event_id") % 4).alias("header")).agg(F.min_by("off", "event_id").alias("first_value"))


CLUSTER = "CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'East' ELSE 'west' END"


@query(f"SELECT event_id, coalesce({CLUSTER}, '') = '' OR lower({CLUSTER}) = 'east' AS dispatch FROM log")
def cluster_filter(v: Views) -> DataFrame:
    """Rows of other clusters are acknowledged, not dispatched: split, not dropped."""
    return v.log.select("event_id", routing.same_cluster(F.expr(CLUSTER), "EAST").alias("dispatch"))


@query(f"SELECT event_id FROM log WHERE (coalesce({CLUSTER}, '') = '' OR lower({CLUSTER}) = 'east') AND vbytes > 5 AND retry_count < 5")
def composite_filter(v: Views) -> DataFrame:
    return v.log.where(routing.all_of(routing.same_cluster(F.expr(CLUSTER), "EAST"), F.col("vbytes") > 5, F.col("retry_count") < 5)).select("event_id")


URI = "CASE job_id % 4 WHEN 0 THEN 'grpc://' || lower(uri) || ':90' || job_id % 10 || '?x=1' WHEN 1 THEN 'dns:///' || lower(uri) || '.svc' WHEN 2 THEN uri ELSE 'muttley://' || lower(uri) || ' tail' END"


@query("SELECT job_id, CASE job_id % 4 WHEN 0 THEN lower(uri) || ':90' || job_id % 10 WHEN 1 THEN lower(uri) || '.svc' WHEN 2 THEN 'unknown' ELSE lower(uri) END AS address FROM jobs")
def uri_address(v: Views) -> DataFrame:
    return v.jobs.select("job_id", d.address_of(F.expr(URI)).alias("address"))


@query("""WITH RECURSIVE u AS (SELECT DISTINCT uri FROM jobs), r AS (SELECT uri, 0 AS i, CAST(0 AS BIGINT) AS h FROM u UNION ALL SELECT uri, i + 1, (h * 31 + ascii(substr(uri, i + 1, 1))) % 4294967296 FROM r WHERE i < length(uri)),
 e AS (SELECT uri, (h + 31) % 4294967296 AS h FROM r WHERE i = length(uri)) SELECT uri, ((CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END) % 10000 + 10000) % 10000 AS bucket FROM e""")
def uri_bucket(v: Views) -> DataFrame:
    return v.jobs.select("uri").distinct().select("uri", d.uri_bucket(F.col("uri")).alias("bucket"))


@query(f"SELECT event_id, {ROLE_SQL} = 'RETRY' AS is_retry, {ROLE_SQL} = 'DLQ' AS is_dlq, {ROLE_SQL} = 'RESQ' AS is_resq, retry_topic <> '' AS has_retry, resq_topic <> '' AS has_resq FROM resp")
def topic_predicates(v: Views) -> DataFrame:
    r = _role()
    return v.resp.select("event_id", (r == "RETRY").alias("is_retry"), (r == "DLQ").alias("is_dlq"), (r == "RESQ").alias("is_resq"), (F.col("retry_topic") != "").alias("has_retry"), (F.col("resq_topic") != "").alias("has_resq"))


@query("SELECT range_id, part <> range_id % 8 AS differs FROM ranges")
def job_diff(v: Views) -> DataFrame:
    """Jobs are compared without their start offset."""
    own = F.struct("part", "start_off", "end_off")
    other = F.struct((F.col("range_id") % 8).alias("part"), (F.col("start_off") + 1).alias("start_off"), "end_off")
    return v.ranges.select("range_id", (own.dropFields("start_off") != other.dropFields("start_off")).alias("differs"))


@query("""WITH j AS (SELECT job_id, group_id, uri, state, worker_id % 10 AS part FROM jobs), t AS (SELECT group_id, min_by(uri, job_id) AS uri, min_by(state, job_id) AS state FROM j GROUP BY group_id)
 SELECT job_id, j.uri = t.uri AND j.state = t.state AS derived FROM j JOIN t ON t.group_id = j.group_id""")
def derived_jobs(v: Views) -> DataFrame:
    """Whether a job, its per-partition fields cleared, is its group's template (that of its first job)."""
    jobs = v.jobs.select("job_id", "group_id", "uri", "state", (F.col("worker_id") % 10).alias("part"))
    template = jobs.groupBy("group_id").agg(F.min_by(F.struct("uri", "state"), "job_id").alias("template"))
    return reconcile.derived(jobs, template, ["group_id"], ["job_id", "group_id", "part"]).select("job_id", "derived")


@query("SELECT g.group_id, bool_and(j.state = 'CANCELED') AS jobs_canceled, bool_and(j.state = 'CANCELED') AND g.state = 'CANCELED' AS all_canceled FROM groups g JOIN jobs j ON g.group_id = j.group_id GROUP BY g.group_id, g.state")
def group_canceled(v: Views) -> DataFrame:
    j = v.jobs.groupBy("group_id").agg(F.bool_and(F.col("state") == "CANCELED").alias("jobs_canceled"))
    return v.groups.join(j, "group_id").select("group_id", "jobs_canceled", (F.col("jobs_canceled") & (F.col("state") == "CANCELED")).alias("all_canceled"))


@query("SELECT j.job_id, g.msgs, g.state AS state, j.worker_id FROM jobs j JOIN groups g ON j.group_id = g.group_id")
def config_merge(v: Views) -> DataFrame:
    """Flow control and state from the group, identity from the job."""
    return v.jobs.drop("state").join(v.groups.select("group_id", "msgs", "state"), "group_id").select("job_id", "msgs", "state", "worker_id")


@query("SELECT job_id FROM (SELECT job_id, scale - 0.5 AS m, scale - 0.2 AS b FROM jobs) WHERE m <= 0 OR b <= 0")
def invalid_flow(v: Views) -> DataFrame:
    return v.jobs.where("scale - 0.5 <= 0 or scale - 0.2 <= 0").select("job_id")


@query("SELECT job_id, CASE job_id % 3 WHEN 0 THEN 'pod' || job_id % 4 WHEN 1 THEN 'a::b' ELSE '' END AS pod FROM jobs")
def pod_of(v: Views) -> DataFrame:
    name = F.expr("case job_id % 3 when 0 then 'pod' || job_id % 4 || '::' || uri when 1 then 'a::b::' || uri else uri end")
    return v.jobs.select("job_id", d.pod_of(name).alias("pod"))


@query("SELECT event_id, event_id % 3 = 0 AS rejected FROM log")
def header_guard(v: Views) -> DataFrame:
    """Custom header names may not begin with the reserved word, in any case."""
    name = F.expr("case event_id % 3 when 0 then 'KafkaX' when 1 then 'my-kafka' else 'trace' end")
    return v.log.select("event_id", routing.reserved_name(name).alias("rejected"))


@query("""SELECT event_id, CASE WHEN vbytes <= 0 THEN 'INVALID_ARGUMENT' WHEN retry_count > 5 THEN 'RESOURCE_EXHAUSTED' END AS blocked, CASE status WHEN 'DATA_LOSS' THEN 'ABORTED' WHEN 'INTERNAL' THEN 'UNAVAILABLE' WHEN 'UNKNOWN' THEN 'UNAVAILABLE' ELSE status END AS answer FROM resp""")
def filter_chain(v: Views) -> DataFrame:
    """Two filters before the call, and three that map errors, asked from the last to the first."""
    before = [lambda: F.when(F.col("vbytes") <= 0, "INVALID_ARGUMENT"), lambda: F.when(F.col("retry_count") > 5, "RESOURCE_EXHAUSTED")]
    errors = [lambda e: F.when(e.isin("INTERNAL", "DATA_LOSS"), "UNKNOWN"), lambda e: F.when(e == "DATA_LOSS", "ABORTED"), lambda e: F.when(e.isin("INTERNAL", "UNKNOWN"), "UNAVAILABLE")]
    return routing.filtered(v.resp, before).select("event_id", "blocked", routing.mapped_errors(F.col("status"), errors).alias("answer"))


@query("SELECT event_id, upper(topic) AS topic, vbytes * 2 AS size FROM log")
def translate_stage(v: Views) -> DataFrame:
    """Messages mapped by a stage of their own and handed on."""
    return routing.translated(v.log, lambda m: m.select("event_id", F.upper("topic").alias("topic"), (F.col("vbytes") * 2).alias("size")))


@query(f"SELECT event_id, {ACTION_SQL} AS code FROM resp")
def action_code(v: Views) -> DataFrame:
    return v.resp.select("event_id", d.action_code(F.col("action")).alias("code"))


@query(f"SELECT event_id, {STATUS_SQL} AS code FROM resp")
def status_code(v: Views) -> DataFrame:
    return v.resp.select("event_id", d.status_code(F.col("status"), F.col("overdue")).alias("code"))


@query("SELECT event_id, CASE WHEN action IS NOT NULL THEN NULL WHEN status IN ('UNAVAILABLE','UNKNOWN','UNIMPLEMENTED','INTERNAL') THEN 'invalid-response' WHEN status IN ('PERMISSION_DENIED','UNAUTHENTICATED') THEN 'permission-denied' END AS issue FROM resp")
def health_issue(v: Views) -> DataFrame:
    return v.resp.select("event_id", d.health_issue(F.col("action"), F.col("status")).alias("issue"))


@query(f"SELECT event_id, CASE WHEN code <> 'BACKOFF' THEN code WHEN role = 'DLQ' THEN 'DLQ' WHEN role = 'RESQ' THEN 'INVALID' WHEN timeout_count >= 2 THEN 'DLQ' ELSE 'RETRY' END AS code, timeout_count + CASE WHEN code = 'BACKOFF' THEN 1 ELSE 0 END AS timeouts FROM (SELECT *, {CODE_SQL} AS code, {ROLE_SQL} AS role FROM resp)")
def timeout_escalate(v: Views) -> DataFrame:
    x = v.resp.withColumn("code", _code()).withColumn("role", _role())
    return x.select("event_id", d.timeout_escalation(F.col("code"), F.col("role"), F.col("timeout_count"), 2, F.lit(True)).alias("code"), (F.col("timeout_count") + (F.col("code") == "BACKOFF").cast("long")).alias("timeouts"))


@query(f"SELECT event_id, CASE WHEN code IN ('SKIP','COMMIT') THEN 'COMMIT' WHEN code IN ('RETRY','RESQ','DLQ') THEN code ELSE 'INVALID' END AS code, CASE WHEN code IN ('SKIP','COMMIT') THEN 0 ELSE 1 END AS attempts, retry_count + CASE WHEN code IN ('RETRY','RESQ','DLQ') THEN 1 ELSE 0 END AS retries, code IN ('SKIP','COMMIT') AS acked FROM (SELECT *, {CODE_SQL} AS code FROM resp)")
def outcome_counters(v: Views) -> DataFrame:
    return routing.book(v.resp.withColumn("code", _code())).select("event_id", "code", "attempts", "retries", "acked")


STOP_SQL = "CASE WHEN code IN ('SKIP','COMMIT') THEN TRUE WHEN code = 'DLQ' THEN dlq_topic <> '' OR retry_topic <> '' WHEN code = 'RETRY' THEN retry_topic <> '' WHEN code = 'RESQ' THEN resq_topic <> '' ELSE FALSE END"


@query(f"SELECT event_id, {STOP_SQL} AS stops FROM (SELECT *, {CODE_SQL} AS code FROM resp)")
def retry_in_place(v: Views) -> DataFrame:
    return v.resp.withColumn("code", _code()).select("event_id", d.stops_in_place(*map(F.col, ("code", "dlq_topic", "retry_topic", "resq_topic"))).alias("stops"))


TIER_SQL = "CASE WHEN n <= 2 THEN 't1' WHEN n <= 4 THEN 't2' WHEN n <= 5 THEN 't3' ELSE"


@query(f"SELECT event_id, CASE WHEN code = 'DLQ' AND dlq_topic <> '' THEN dlq_topic WHEN code IN ('DLQ','RETRY') AND retry_topic <> '' THEN {TIER_SQL} CASE WHEN dlq_topic <> '' THEN dlq_topic ELSE 't3' END END WHEN code = 'RESQ' AND resq_topic <> '' THEN resq_topic END AS destination FROM (SELECT *, {CODE_SQL} AS code, retry_count + 1 AS n FROM resp)")
def destination_topic(v: Views) -> DataFrame:
    """Where a message is produced to; null: nowhere."""
    x = v.resp.withColumn("code", _code()).withColumn("n", F.col("retry_count") + 1)
    return routing.destination(x, v.tiers).select("event_id", "destination")


@query(f"SELECT event_id, {TIER_SQL} 'dlq' END AS tier FROM (SELECT event_id, retry_count AS n FROM log)")
def tier_route(v: Views) -> DataFrame:
    return routing.tiers(v.log.withColumn("n", F.col("retry_count")), v.tiers).select("event_id", F.coalesce("tier", F.lit("dlq")).alias("tier"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 1000 WHEN 1 THEN 5000 WHEN 2 THEN 30000 ELSE -1 END AS delay_ms FROM log")
def tier_delay(v: Views) -> DataFrame:
    """The delay of the tier that a retry source reads, -1 for other topics."""
    x = v.log.select("event_id", F.expr("element_at(array('t1', 't2', 't3', 'other'), cast(event_id % 4 as int) + 1)").alias("tier"))
    return x.join(F.broadcast(v.tiers), "tier", "left").select("event_id", F.coalesce("delay_ms", F.lit(-1)).alias("delay_ms"))


@query(f"SELECT event_id, CASE WHEN event_id % 13 = 0 THEN 'COMPLETED' WHEN code IN ('INVALID','BACKOFF') THEN 'FAILED' WHEN code = 'DROPPED' THEN 'DROPPED' ELSE 'SUCCEEDED' END AS result FROM (SELECT event_id, {CODE_SQL} AS code FROM resp)")
def permit_result(v: Views) -> DataFrame:
    return v.resp.select("event_id", d.permit_result(_code(), F.col("event_id") % 13 == 0).alias("result"))


@query(f"SELECT event_id, CASE code WHEN 'COMMIT' THEN 'OK' WHEN 'RETRY' THEN 'RESOURCE_EXHAUSTED' WHEN 'DLQ' THEN 'FAILED_PRECONDITION' WHEN 'SKIP' THEN 'ALREADY_EXISTS' ELSE 'UNKNOWN' END AS answer FROM (SELECT event_id, {CODE_SQL} AS code FROM resp)")
def consumer_response(v: Views) -> DataFrame:
    return v.resp.select("event_id", d.response_status(_code()).alias("answer"))


_FIRST, _SECOND = "role NOT IN ('DLQ','RESQ') AND resq_topic <> ''", "role NOT IN ('DLQ','RETRY','RESQ') AND retry_topic <> ''"
#: rule, cost and reasons of the rule that cancels a blocked head, null without one.
CANCEL_SQL = ", ".join(f"CASE WHEN {_FIRST} THEN {a} WHEN {_SECOND} THEN {b} END AS {name}" for name, a, b in (("rule", "'RESQ'", "'RETRY'"), ("cost", 2, 50), ("reasons", "'BLOCKING,SATURATION'", "'BLOCKING'")))


@query(f"SELECT event_id, rule AS code, cost FROM (SELECT *, {CANCEL_SQL} FROM (SELECT *, {ROLE_SQL} AS role FROM resp))")
def cancel_rule(v: Views) -> DataFrame:
    rule = d.cancel_rule(_role(), F.col("retry_topic"), F.col("resq_topic"))
    return v.resp.select("event_id", rule["code"].alias("code"), rule["cost"].alias("cost"))
