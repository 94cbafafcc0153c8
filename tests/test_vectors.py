"""Hand-made cases for operators and the state objects behind the folds."""

import random

import pytest
from pyspark.sql import functions as F

from tidelog.functions import decisions as d
from tidelog.operators import commits, folds, placement, reconcile, routing, windows
from tidelog.operators.scaling import ScaleState


@pytest.mark.parametrize(
    "received, acked, returned",
    [
        ([100, 101, 102], [101, 102, 103], [101, 102, 103]),
        ([100, 101, 102], [103, 102, 101], [-3, -3, 103]),
        ([100, 105], [101, 106], [101, 106]),
        ([100, 101], [102, 102], [-3, -2]),
        ([100], [101, 101], [101, -1]),
    ],
)
def test_queue(received, acked, returned):
    q = folds.Queue()
    assert all(q.receive(x) for x in received)
    assert [q.ack(x) for x in acked] == returned


def test_queue_states():
    q = folds.Queue()
    assert q.receive(5) and not q.receive(5) and not q.receive(4)
    assert q.nack(5) and not q.nack(5) and q.cancel(5) and not q.cancel(5)
    assert q.receive(6) and q.ack(7) == -3 and not q.cancel(6) and q.ack(6) == 7


def test_progress_is_the_queue(spark):
    rng = random.Random(12345)
    rows = []
    for part in range(5):
        offs, off = [], rng.randint(0, 9)
        for _ in range(40):
            off += 1 + (rng.random() < 0.2) * rng.randint(1, 9)
            offs.append(off)
        order = offs[:]
        rng.shuffle(order)
        rows += [("t", part, o, order.index(o) + 1, "ACKED" if rng.random() < 0.9 else "NACKED") for o in offs]
    df = spark.createDataFrame(rows, "topic string, part long, off long, t long, status string")
    got = {(r.part, r.off): r.returned for r in commits.progress(df, "t").collect()}
    for part in range(5):
        q = folds.Queue()
        own = [r for r in rows if r[1] == part]
        for r in own:
            q.receive(r[2])
        want = {(part, r[2]): q.ack(r[2] + 1) for r in sorted(own, key=lambda r: r[3]) if r[4] == "ACKED"}
        assert want == {k: v for k, v in got.items() if k[0] == part}


def test_tiers(spark):
    table = spark.createDataFrame([("t2", 5000, 2), ("t1", 1000, 2)], "tier string, delay_ms long, max_retry long")
    msgs = spark.createDataFrame([(n, "RETRY", dlq, "r", "") for n in range(1, 6) for dlq in ("dead", "")], "n long, code string, dlq_topic string, retry_topic string, resq_topic string")
    got = {(r.n, r.dlq_topic): r.destination for r in routing.destination(msgs, table).collect()}
    assert [got[n, "dead"] for n in range(1, 6)] == ["t1", "t1", "t2", "t2", "dead"]
    assert got[5, ""] == "t2"


def test_timeouts(spark):
    got = spark.range(5).select(d.rpc_timeout(F.lit(100), F.col("id"), 1, 1000).alias("x")).orderBy("id").collect()
    assert [r.x for r in got] == [100, 200, 400, 800, 1000]


def test_strings(spark):
    rows = spark.createDataFrame([("a::b::c",), ("plain",), (None,)], "s string").select(d.pod_of(F.col("s")).alias("p")).collect()
    assert [r.p for r in rows] == ["a::b", "", ""]

    def h(s):
        x = 0
        for c in s:
            x = (x * 31 + ord(c)) & 0xFFFFFFFF
        return x - (1 << 32) if x >= 1 << 31 else x

    words = ["", "a", "grpc://host:90", "polygenelubricants"]
    got = spark.createDataFrame([(w,) for w in words], "s string").select("s", d.string_hash(F.col("s")).alias("h"), d.uri_bucket(F.col("s")).alias("b")).collect()
    for r in got:
        assert r.h == h(r.s)
        assert r.b == (((31 + h(r.s)) + (1 << 31)) % (1 << 32) - (1 << 31)) % 10000
    uris = spark.createDataFrame([("grpc://a.b:1?x",), ("dns:///a.b",), ("none",)], "s string").select(d.address_of(F.col("s")).alias("a")).collect()
    assert [r.a for r in uris] == ["a.b:1", "a.b", "unknown"]


def test_commands(spark):
    e = spark.createDataFrame([(1, "RUNNING"), (2, "RUNNING"), (3, "RUNNING"), (4, "CANCELED")], "job_id long, state string")
    a = spark.createDataFrame([(2, "RUNNING", False), (3, "RUNNING", True), (4, "RUNNING", False), (5, "RUNNING", False)], "job_id long, state string, changed boolean")
    assert {r.job_id: r.command for r in reconcile.commands(e, a).collect()} == {1: "RUN", 3: "UPDATE", 4: "CANCEL", 5: "CANCEL"}


def test_histogram(spark):
    df = spark.createDataFrame([("k", float(x)) for x in range(70, 101)], "k string, v double")
    got = lambda p, lo=70.0, hi=100.0: windows.histogram_percentile(df, ["k"], "v", lo, hi, p).first().percentile
    assert got(0.0) == 70.0
    assert abs(got(0.5) - 84.0) < 0.5 and got(0.5) <= got(0.99)
    assert got(0.9, 80.0, 80.0) == 80.0


def test_tokens_and_limits():
    t = folds.Tokens(100, 1)
    assert t.acquire(0) and not t.acquire(1) and t.acquire(101)
    t.credit(150, 2)
    assert t.acquire(160) and t.acquire(160) and not t.acquire(160)
    f = folds.Inflight(2)
    assert f.acquire() and f.acquire() and not f.acquire()
    f.release()
    assert f.acquire()
    assert folds.Inflight(0).acquire(99)
    b = folds.Inflight(10, 1, 1)
    assert b.acquire() and not b.acquire()
    b.release()
    b.release()
    assert b.acquire() and b.acquire()


def test_placement():
    assert placement.bins_needed([0.6, 0.6, 0.4, 0.4]) == 2
    assert placement.overloaded([5.0, 0.1, 0.1], 1.0) == [False, True, True]
    assert placement.overloaded([0.5, 0.6, 0.3], 1.0) == [False, True, False]
    assert placement.replace_stale([(1, 1.0), (2, 3.0), (3, 1.0)], [7, 8]) == {2: 7, 3: 8, 1: 8}
    assert placement.balance({1: [(1, 2.0), (2, 2.0)], 2: []}, 3.0) == {2: 1, 1: 2}
    assert placement.hibernating_plan(32, 10) == [10, 11, 11]


def test_jobs_go_to_the_least_loaded_then_to_the_newest_spare_worker():
    # Two workers a URI, taken from the newest on; the third job fits no longer and takes a spare one.
    assert placement.place([(1, "u", 0.6, None), (2, "u", 0.6, None), (3, "u", 0.6, None)], [1, 2, 3, 4]) == {1: 3, 2: 4, 3: 2}
    # Without a spare one the least loaded takes more than it should, and unloading gives back what has no better place.
    assert placement.place([(1, "u", 0.6, None), (2, "u", 0.6, None), (3, "u", 0.6, None)], [3, 4]) == {1: 3, 2: 4, 3: 3}
    # Lost workers' jobs are placed anew, others stay.
    assert placement.place([(1, "u", 0.2, 9), (2, "u", 0.2, 1), (3, "u", 0.2, 1)], [1, 2]) == {1: 2, 2: 1, 3: 1}
    assert placement.place([(1, "u", 0.2, None)], []) == {}


def test_workers_merge_beyond_what_a_uri_needs():
    jobs = [(1, "u", 0.1, 1), (2, "u", 0.2, 2), (3, "u", 0.3, 3)]
    # All merge on 3, so the pool's second worker is idle: worker 3 gives up its jobs, and they are dealt to the least loaded.
    assert placement.place(jobs, [1, 2, 3]) == {1: 2, 2: 3, 3: 2}
    fleet = placement.Fleet(jobs, [1, 2, 3], 1.0, 2)
    fleet.minimise()
    assert fleet.at == {1: 3, 2: 3, 3: 3}
    full = placement.Fleet([(1, "u", 0.6, 1), (2, "u", 0.6, 2), (3, "u", 0.6, 3)], [1, 2, 3], 1.0, 2)
    full.minimise()
    assert full.at == {1: 1, 2: 2, 3: 3}


def test_idle_workers_are_fed():
    fleet = placement.Fleet([(1, "u", 0.3, 1), (2, "u", 0.3, 1)], [1, 2], 1.0, 2)
    assert fleet.feed() == {1: 1, 2: 1} and fleet.at == {1: None, 2: None}
    assert placement.place([(1, "u", 0.3, 1), (2, "u", 0.3, 1)], [1, 2]) == {1: 1, 2: 2}
    # One job alone stays; then nothing more is tried, not even for other URIs.
    alone = placement.Fleet([(1, "a", 0.3, 1), (2, "b", 0.3, 3), (3, "b", 0.3, 3)], [1, 2, 3, 4], 1.0, 2)
    assert alone.feed() == {}


def test_overloaded_jobs_go_back_where_no_place_is_better():
    fleet = placement.Fleet([(1, "u", 0.7, 1), (2, "u", 0.7, 1), (3, "u", 0.7, 2)], [1, 2], 1.0, 2)
    assert fleet.unload() == {2: 1}
    fleet.assign({2: 1})
    assert fleet.at == {1: 1, 2: 1, 3: 2}


def test_workers_move_between_partitions(spark):
    held = spark.createDataFrame([(w, 0, float(w), 1) for w in range(1, 7)] + [(10, 1, 1.0, 1)], "worker_id long, part int, load double, jobs int")
    free = spark.createDataFrame([(20,)], "worker_id long")
    needed = spark.createDataFrame([(0, 2), (1, 3), (2, 1)], "part int, needed long")
    got = {r.worker_id: r.part for r in placement.spread_workers(held, free, needed).collect()}
    # Partition 0 gives up two; 20, 1 and 2 go to partitions 1, 2, 1 in turns.
    assert got == {3: 0, 4: 0, 5: 0, 6: 0, 10: 1, 20: 1, 1: 2, 2: 1}
    only = placement.spread_workers(held.where("part = 0"), free, needed.where("part = 0"))
    assert {r.part for r in only.collect()} == {0} and only.count() == 7


def test_hibernating_groups_fill_few_workers(spark):
    workers = spark.createDataFrame([(0, w) for w in (1, 2, 3)] + [(1, 9)], "pod long, worker_id long")
    rows = [(0, g, 1) for g in (1, 2, 3, 4)] + [(0, 5, 2), (0, 6, None), (2, 7, None)]
    got = {r.group_id: r.worker_id for r in placement.balance_hibernating(spark.createDataFrame(rows, "pod long, group_id long, worker_id long"), workers, 3).collect()}
    # Six groups on two workers, three each: 2 and 1 are used, 4 moves, 6 is placed.
    assert got == {1: 1, 2: 1, 3: 1, 4: 2, 5: 2, 6: 2, 7: None}


def test_groups_without_workers_go_to_other_pods(spark):
    groups = spark.createDataFrame([(g, 9) for g in range(4)] + [(10, 0)], "group_id long, pod long")
    workers = spark.createDataFrame([(0, 1), (0, 2), (0, 3), (1, 4)], "pod long, worker_id long")
    assert {r.group_id: r.pod for r in placement.fallback_pods(groups, workers).collect()} == {0: 0, 1: 0, 2: 0, 3: 1, 10: 0}


def minutes(state, values, start=0):
    return [state.sample(start + 60_000 * (i + 1), v) for i, v in enumerate(values)]


def test_scale_goes_up_within_its_window():
    s = ScaleState(0, 1.0)
    assert s.mode == "RUNNING"
    out = minutes(s, [1.5] * 10)
    # Ten samples and more than five minutes: the lower edge of the bucket that holds half of them.
    assert out[:9] == [1.0] * 9 and out[9] == pytest.approx(1.5) and s.mode == "RUNNING"


def test_scale_goes_down_only_after_a_day():
    s = ScaleState(0, 1.0)
    assert set(minutes(s, [0.6] * 1440)) == {1.0}
    assert minutes(s, [0.6], 1440 * 60_000)[0] == pytest.approx(0.6)


def test_calibration_is_fast_and_ends():
    s = ScaleState(0, 1.0, from_quota=True)
    assert s.mode == "CALIBRATING"
    assert minutes(s, [0.6] * 10)[-1] == pytest.approx(0.6) and s.mode == "CALIBRATING"
    out = minutes(s, [0.6] * 40, 600_000)
    assert set(out) == {s.scale} and s.mode == "CALIBRATING"
    minutes(s, [s.scale * 1.5] * 20, 3_000_000)
    assert s.mode == "RUNNING"


def test_sleep_needs_three_days_and_survives_changes_of_scale():
    s = ScaleState(0, 1.0)
    hour = 3_600_000
    for h in range(1, 30):
        s.sample(h * hour, 0.0)
    # Down by the least factor once a day is over, yet the window for sleep goes on.
    assert s.scale == pytest.approx(0.5) and s.mode == "RUNNING"
    for h in range(30, 73):
        s.sample(h * hour, 0.0)
    assert s.mode == "RUNNING"
    s.sample(73 * hour, 0.0)
    s.sample(74 * hour, 0.0)
    assert s.mode == "HIBERNATE" and s.scale == 0.0
    never = ScaleState(0, 1.0, sleeps=False)
    for h in range(1, 200):
        never.sample(h * hour, 0.0)
    assert never.mode == "RUNNING"


def test_waking_is_bounded():
    s = ScaleState(0, 0.0)
    assert s.mode == "HIBERNATE"
    minutes(s, [0.0] * 20)
    assert s.mode == "HIBERNATE"
    minutes(s, [7.0] * 10, 1_200_000)
    if s.mode == "HIBERNATE":
        minutes(s, [7.0], 1_800_000)
    assert s.mode == "RUNNING" and 0 < s.scale <= 1.0


def test_tiny_scales_do_not_go_down():
    s = ScaleState(0, 1e-8)
    assert len(s.movers) == 1


def test_bootstrap_holds_without_a_limit():
    f = folds.Inflight(0, 2, 1)
    assert f.acquire() and f.acquire() and not f.acquire()
    f.release()
    f.release()
    assert all(f.acquire() for _ in range(50))


def test_inbound_limits():
    x = folds.Inbound(1, 3, 10_000, 10, 25)
    assert [x.receive(k, b) for k, b in ((1, 6), (2, 6), (3, 0), (4, 4), (5, 1))] == ["OWN", "POOL", "EMPTY", "OWN", "FULL"]
    x.done(2)
    assert x.receive(6, 20) == "POOL" and x.pool.used == 20
    x.done(6)
    assert x.receive(7, 30) == "FULL" and x.count.used == 2


def test_ack_manager():
    m = folds.AckManager(folds.Inbound(1, 2), 3)
    assert m.receive(1, 5) == 1 and m.receive(2, 5) == 1 and m.receive(3, 5) == -1
    assert m.ack(2) == -3 and m.receive(3, 5) == 1 and m.live == {1, 3}
    assert m.receive(4, 5) == -2
    assert m.ack(1) == 3 and m.receive(4, 5) == 1 and m.ack(9) == -1
