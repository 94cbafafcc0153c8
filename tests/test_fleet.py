"""Fleet queries on hand-made tables."""

import time

import duckdb
import pytest

from tidelog.operators import placement
from tidelog.plans import catalog


def test_scales_at_ties_are_rounded_as_in_sql(spark, tmp_path):
    # 0.75 / 5000 is 0.00015 as a decimal, but less than 1.5 when scaled: 0.0001, so the job stays below 3.
    duck = duckdb.connect()
    duck.execute(f"COPY (SELECT 120 * k AS c_custkey, 1 AS c_nationkey, 'u' AS c_mktsegment, b AS c_acctbal FROM (VALUES (0, 14999.0::DOUBLE), (1, -0.75::DOUBLE), (2, 7.25::DOUBLE), (3, 0.25::DOUBLE)) AS t(k, b)) TO '{tmp_path}/customer.parquet'")
    duck.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet'")
    got = catalog.QUERIES["overloaded_jobs"](spark, str(tmp_path)).select("worker_id", "job_id", "leaves").collect()
    assert sorted(map(tuple, got)) == sorted(duck.execute(f"SELECT worker_id, job_id, leaves FROM ({catalog.SQL['overloaded_jobs']})").fetchall())


class Worker(int):
    """A worker's id that counts how often it is looked up or compared."""

    looks = 0

    def __hash__(self):
        Worker.looks += 1
        return int.__hash__(self)

    def __eq__(self, other):
        Worker.looks += 1
        return int.__eq__(self, other)


CASES = {
    "jobs without a worker, one each": lambda n: [(j, "u", 0.9, None) for j in range(n)],
    "nothing merges": lambda n: [(j, "u", 0.6, Worker(j)) for j in range(n)],
    "most merge": lambda n: [(j, "u", 0.01, Worker(j)) for j in range(n)],
    "an idle worker and many with one job": lambda n: [(j, "u", 1.0 if j else 0.0, Worker(j)) for j in range(n)],
    "many URIs": lambda n: [(j, f"u{j}", 0.6, Worker(j)) for j in range(n)],
}


@pytest.mark.parametrize("case", CASES)
def test_placement_grows_with_the_jobs(case):
    def looks(n):
        jobs, workers = CASES[case](n), [Worker(w) for w in range(n)]
        Worker.looks = 0
        assert len(placement.place(jobs, workers)) == n
        return Worker.looks

    # Four times the jobs and workers: 16 times the looks if each job meets each worker.
    assert looks(1200) < 6 * looks(300)


def test_shadow_of_a_large_pod_is_whole_and_soon_there(spark, tmp_path):
    # 40,000 jobs of one pod, 32,000 of them running, all without a worker and one to a worker: they meet half the workers each if the least loaded is sought anew.
    n = 40_000
    duckdb.execute(f"COPY (SELECT range AS c_custkey, 4 AS c_nationkey, 'u' AS c_mktsegment, 9999.0 AS c_acctbal FROM range({n})) TO '{tmp_path}/customer.parquet'")
    duckdb.execute(f"COPY (SELECT range + 1000 AS s_suppkey, 0 AS s_nationkey FROM range({n})) TO '{tmp_path}/supplier.parquet'")
    began = time.perf_counter()
    got = catalog.QUERIES["shadow_rebalance"](spark, str(tmp_path)).collect()
    assert time.perf_counter() - began < 30
    assert sorted((r.job_id, r.worker_id) for r in got) == [(j + 1, j % 120) for j in range(n)]
    run = {r.job_id: r.shadow_id for r in got if r.shadow_id is not None}
    assert sorted(run) == [j + 1 for j in range(n) if j % 10 > 1]
    assert len(set(run.values())) == len(run)
