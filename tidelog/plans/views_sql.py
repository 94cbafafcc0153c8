"""The domain's views over the driver tables, for an independent engine; sources/views.py has the same for Spark."""

VIEWS = {
    "log": """SELECT event_type AS topic, user_id % 8 AS part, row_number() OVER (PARTITION BY event_type, user_id % 8 ORDER BY event_id) - 1 AS off,
        epoch_us(ts) // 1000 AS ts_ms, length(props) AS vbytes, user_id AS key, event_id % 7 AS retry_count, event_id % 4 AS timeout_count, event_id, value FROM events""",
    "resp": """SELECT *, list_extract(['OK','CANCELLED','UNKNOWN','INVALID_ARGUMENT','DEADLINE_EXCEEDED','NOT_FOUND','ALREADY_EXISTS','PERMISSION_DENIED','RESOURCE_EXHAUSTED','FAILED_PRECONDITION','ABORTED','OUT_OF_RANGE','UNIMPLEMENTED','INTERNAL','UNAVAILABLE','DATA_LOSS','UNAUTHENTICATED'], CAST(event_id % 17 + 1 AS INT)) AS status,
        CASE event_id % 11 WHEN 1 THEN 'Retry' WHEN 2 THEN 'Stash' WHEN 3 THEN 'Skip' WHEN 4 THEN 'Other' END AS action, event_id % 2 = 0 AS overdue,
        CASE event_id % 6 WHEN 3 THEN topic || '__retry' WHEN 4 THEN topic || '__dlq' WHEN 5 THEN topic || '__resq' ELSE topic END AS physical,
        CASE WHEN event_id % 3 <> 0 THEN topic || '__dlq' ELSE '' END AS dlq_topic, CASE WHEN event_id % 4 <> 0 THEN topic || '__retry' ELSE '' END AS retry_topic, CASE WHEN event_id % 5 <> 0 THEN topic || '__resq' ELSE '' END AS resq_topic FROM log""",
    "acks": """SELECT *, CASE WHEN event_id % 97 = 0 THEN 'CANCELED' WHEN event_id % 5 = 0 THEN 'NACKED' ELSE 'ACKED' END AS status FROM log""",
    "tiers": """SELECT * FROM (VALUES ('t1', 1000, 2), ('t2', 5000, 2), ('t3', 30000, 1)) AS t(tier, delay_ms, max_retry)""",
    "workers": """SELECT s_suppkey + 1 AS worker_id, s_nationkey % 4 AS pod, CASE WHEN s_suppkey % 10 = 0 THEN 'REGISTERING' ELSE 'WORKING' END AS state FROM supplier""",
    "jobs": """SELECT c_custkey + 1 AS job_id, c_nationkey AS group_id, c_mktsegment AS uri, round(abs(c_acctbal) / 5000, 4) AS scale, c_custkey % 120 AS worker_id,
        CASE c_custkey % 10 WHEN 0 THEN 'CANCELED' WHEN 1 THEN 'FAILED' ELSE 'RUNNING' END AS state FROM customer""",
    "groups": """SELECT group_id, CASE WHEN group_id % 6 = 0 THEN 'CANCELED' ELSE 'RUNNING' END AS state, 100.0 * count(*) AS msgs, 65536.0 * count(*) AS bytes, 10 * count(*) AS inflight, count(*) AS n_jobs FROM jobs GROUP BY group_id""",
    "actual": """SELECT job_id, worker_id, 'RUNNING' AS state, job_id % 7 = 0 AS changed FROM jobs WHERE job_id % 3 <> 0
        UNION ALL SELECT job_id + 1000000, worker_id, 'RUNNING', FALSE FROM jobs WHERE job_id % 50 = 0""",
    "status": """SELECT user_id + 1 AS job_id, value * 10 AS msgs, value * 4096 AS bytes, value / 100 AS cpu, epoch_us(ts) // 1000 AS ts_ms, event_id FROM events""",
    "ranges": """SELECT o_orderkey AS range_id, o_orderkey % 16 AS part, o_orderkey % 100 AS start_off, o_orderkey % 100 + o_custkey % 50 AS end_off FROM orders""",
}
