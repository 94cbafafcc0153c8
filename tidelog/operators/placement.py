"""Placement of jobs on workers: greedy by nature, so it runs per pod or virtual partition.

Where the outcome depends on an order that is not defined, ascending ids are
used. A group is one pod's or one partition's jobs, which are bounded by the
fleet that serves it, not by the messages.  What has a closed form is made of
window functions over the fleet.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

JOBS_PER_WORKER = 500


def bins_needed(loads: list[float], most: float = 1.0) -> int:
    """Loads in descending order, each to the least loaded bin if it fits there, else to a new one."""
    heap: list[float] = []
    for x in sorted(loads, reverse=True):
        if heap and heap[0] + x <= most:
            heapq.heapreplace(heap, heap[0] + x)
        else:
            heapq.heappush(heap, x)
    return len(heap)


def workers_needed(loads: list[float], spare: float = 0.13) -> int:
    """Bins for shared jobs or as their number asks, with spare ones, and one worker for each job of scale 1 or more."""
    shared = [x for x in loads if x < 1.0]
    least = max(bins_needed(shared), math.ceil(len(shared) / JOBS_PER_WORKER))
    return math.ceil(round(least * (1 + spare), 9)) + len(loads) - len(shared)


def overloaded(loads: list[float], cap: float) -> list[bool]:
    """Which jobs leave a worker: the first stays; a later one stays while the sum of those that stay is below the cap."""
    out, total = [], 0.0
    for i, x in enumerate(loads):
        stays = i == 0 or total + x < cap
        total += x if stays else 0.0
        out.append(not stays)
    return out


class Room:
    """Loads in a row; the last one that takes x more is found in a walk down a tree of least loads."""

    def __init__(self, loads: list[float], cap: float):
        self.cap, self.n = cap, 1 << max(len(loads) - 1, 0).bit_length()
        self.least = [math.inf] * self.n + loads + [math.inf] * (self.n - len(loads))
        for i in range(self.n - 1, 0, -1):
            self.least[i] = min(self.least[2 * i], self.least[2 * i + 1])

    def last(self, x: float) -> int:
        if not self.least[1] + x < self.cap:
            return -1
        i = 1
        while i < self.n:
            i = 2 * i + (self.least[2 * i + 1] + x < self.cap)
        return i - self.n

    def add(self, at: int, x: float) -> None:
        i = at + self.n
        self.least[i] += x
        while i > 1:
            i //= 2
            self.least[i] = min(self.least[2 * i], self.least[2 * i + 1])


class Fleet:
    """Where the jobs of several URIs run: one worker each, or none.

    Each step is in time with the jobs and workers, times the logarithm of the workers.
    """

    def __init__(self, jobs: Iterable[tuple[int, str, float, int | None]], workers: list[int], cap: float, per_uri: int):
        self.cap, self.per_uri = cap, per_uri
        self.workers = set(workers)
        self.job: dict[int, tuple[str, float]] = {}
        # A job on a worker that is gone has none.
        self.at: dict[int, int | None] = {}
        for j, uri, load, w in sorted(jobs, key=lambda x: x[0]):
            self.job[j] = (uri, load)
            self.at[j] = w if w in self.workers else None

    def loads(self) -> dict[str, dict[int | None, float]]:
        """Load of each URI on each worker, URIs in order."""
        out: dict[str, dict[int | None, float]] = {}
        for j, (uri, load) in self.job.items():
            own = out.setdefault(uri, {})
            own[self.at[j]] = own.get(self.at[j], 0.0) + load
        return dict(sorted(out.items()))

    def minimise(self) -> None:
        """Where a URI has more workers than it needs, the least loaded merge into the most loaded that has room.

        Jobs without a worker count as one, so they may draw others to be placed anew with them.
        """
        # A worker that has merged gets no jobs again: its jobs are where it points to.
        merged: dict[int | None, int | None] = {}

        def now(w: int | None) -> int | None:
            path = []
            while w in merged:
                path.append(w)
                w = merged[w]
            for x in path:
                merged[x] = w
            return w

        own: dict[str, list[int]] = {}
        for j, (uri, _) in self.job.items():
            own.setdefault(uri, []).append(j)
        for _, jobs in sorted(own.items()):
            load: dict[int | None, float] = {}
            for j in jobs:
                w = now(self.at[j])
                load[w] = load.get(w, 0.0) + self.job[j][1]
            if len(load) <= self.per_uri:
                continue
            rising = sorted(load, key=lambda w: (load[w], -1 if w is None else w))
            room = Room([load[w] for w in rising], self.cap)
            for i, this in enumerate(rising):
                x = room.least[i + room.n]
                to = room.last(x)
                if to > i:
                    merged[this] = rising[to]
                    room.add(to, x)
        if merged:
            for j, w in self.at.items():
                self.at[j] = now(w)

    def pools(self) -> dict[str, dict[int, float]]:
        """Workers of each URI with its load on them, topped up to per_uri from the spare ones, newest first."""
        out = {uri: {w: x for w, x in load.items() if w is not None} for uri, load in self.loads().items()}
        spare = self.spare(out)
        for pool in out.values():
            while len(pool) < self.per_uri and spare:
                pool[spare.pop()] = 0.0
        return out

    def spare(self, pools: dict[str, dict[int, float]]) -> list[int]:
        """Workers of no pool; the newest is the last."""
        return sorted(self.workers.difference(*pools.values()))

    def assign(self, original: dict[int, int]) -> None:
        """Jobs without a worker: the least loaded of the pool if there is room or it is idle, a spare one, the original one, the least loaded."""
        pools = self.pools()
        spare = self.spare(pools)
        heaps = {uri: [(x, w) for w, x in pool.items()] for uri, pool in pools.items()}
        for heap in heaps.values():
            heapq.heapify(heap)
        for j, (uri, load) in self.job.items():
            if self.at[j] is not None:
                continue
            pool, heap = pools[uri], heaps[uri]
            # A worker that has got more since then has another entry.
            while heap and heap[0][0] < pool[heap[0][1]]:
                heapq.heappop(heap)
            least = heap[0][1] if heap else None
            if least is not None and (pool[least] + load < self.cap or pool[least] == 0.0):
                to = least
            elif spare:
                to = spare.pop()
            elif j in original:
                to = original[j] if original[j] in pool else None
            else:
                to = least
            if to is not None:
                pool[to] = pool.get(to, 0.0) + load
                heapq.heappush(heap, (pool[to], to))
                self.at[j] = to

    def feed(self) -> dict[int, int]:
        """A URI with an idle worker gives up all jobs of its most loaded worker that has not just one; without such a one, nothing more is tried."""
        held: dict[int | None, list[int]] = {}
        for j, w in self.at.items():
            held.setdefault(w, []).append(j)
        freed: dict[int, int] = {}
        for pool in self.pools().values():
            if not pool or min(pool.values()) != 0.0:
                continue
            busy = [w for w in sorted(pool, key=lambda w: (pool[w], w), reverse=True) if pool[w] != 0.0]
            give = next((w for w in busy if len(held.get(w, ())) != 1), None)
            if give is None:
                return freed
            for j in held.pop(give, ()):
                self.at[j] = None
                freed[j] = give
        return freed

    def unload(self) -> dict[int, int]:
        """Jobs beyond their worker's capacity; its first job always stays."""
        total: dict[int, float] = {}
        freed: dict[int, int] = {}
        for j, (_, load) in self.job.items():
            w = self.at[j]
            if w is None:
                continue
            if w not in total or total[w] + load < self.cap:
                total[w] = total.get(w, 0.0) + load
            else:
                freed[j] = w
        for j in freed:
            self.at[j] = None
        return freed


def place(jobs: Iterable[tuple[int, str, float, int | None]], workers: list[int], cap: float = 1.0, per_uri: int = 2) -> dict[int, int]:
    """Worker of each (job, uri, load, worker now): merge, assign, feed idle workers, unload overloaded ones, assign again."""
    fleet = Fleet(jobs, workers, cap, per_uri)
    fleet.minimise()
    fleet.assign({})
    original = fleet.feed()
    original |= fleet.unload()
    fleet.assign(original)
    return {j: w for j, w in fleet.at.items() if w is not None}


def place_by_pod(jobs: DataFrame, workers: DataFrame, cap: float = 1.0) -> DataFrame:
    """(job_id, placed_on): jobs (pod, job_id, uri, scale, worker_id) of each pod on its workers (pod, worker_id)."""

    def one(own: pd.DataFrame, fleet: pd.DataFrame) -> pd.DataFrame:
        made = place(zip(own.job_id.tolist(), own.uri.tolist(), own.scale.tolist(), own.worker_id.tolist(), strict=True), fleet.worker_id.tolist(), cap)
        return pd.DataFrame({"job_id": list(made), "placed_on": list(made.values())}, dtype="int64")

    left = jobs.select(F.col("pod").cast("long").alias("pod"), "job_id", "uri", "scale", "worker_id")
    right = workers.select(F.col("pod").cast("long").alias("pod"), "worker_id")
    return left.groupBy("pod").cogroup(right.groupBy("pod")).applyInPandas(one, "job_id long, placed_on long")


def replace_stale(jobs: list[tuple[int, float]], workers: list[int]) -> dict[int, int]:
    """Jobs by descending load (ties: descending id), each to the least loaded worker (ties: fewer jobs, then lower id)."""
    heap = [(0.0, 0, w) for w in sorted(workers)]
    out = {}
    for job, load in sorted(jobs, key=lambda x: (-x[1], -x[0])):
        if not heap:
            break
        total, n, w = heap[0]
        out[job] = w
        heapq.heapreplace(heap, (total + load, n + 1, w))
    return out


def balance(held: dict[int, list[tuple[int, float]]], limit: float, most_jobs: int = JOBS_PER_WORKER) -> dict[int, int]:
    """From the most loaded worker on, jobs move to the first lighter worker that fits while it is over a limit; a single job stays."""
    load = {w: sum(x for _, x in own) for w, own in held.items()}
    for w in sorted(held, key=lambda w: (-load[w], w)):
        for job, x in sorted(held[w], key=lambda j: (j[1], j[0])):
            if len(held[w]) < 2 or (load[w] <= limit and len(held[w]) <= most_jobs):
                break
            to = next((o for o in sorted(held, key=lambda o: (load[o], o)) if o != w and load[o] + x <= limit and load[o] < load[w] and len(held[o]) < most_jobs), None)
            if to is None:
                continue
            held[w].remove((job, x))
            held[to].append((job, x))
            load[w] -= x
            load[to] += x
    return {job: w for w, own in held.items() for job, _ in own}


def spread_workers(held: DataFrame, free: DataFrame, needed: DataFrame, share: float = 0.1, least: int = 2) -> DataFrame:
    """(worker_id, part) after workers have moved between partitions; part is null for those left over.

    held: (worker_id, part, load, jobs); free: (worker_id); needed: (part, needed),
    one row a partition.  A partition with `least` or more too many gives up a share
    of the surplus, `least` at least, from the least loaded on.  Free workers, in
    order, and then those given up are dealt to the short partitions in turns.  One
    partition alone gives up none and takes all.
    """
    alone = F.lit(needed.count() <= 1)
    size = needed.join(held.groupBy("part").agg(F.count("*").alias("n")), "part", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    surplus = F.col("n") - F.col("needed")
    give = F.when(~alone & (surplus >= least), F.least(F.col("n"), F.greatest(F.lit(least), F.floor(surplus * share)))).otherwise(F.lit(0))
    size = size.withColumn("give", give).withColumn("short", F.when(alone, F.lit((1 << 31) - 1)).otherwise(F.greatest(F.lit(0), -surplus)).cast("long"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy("load", "jobs", "worker_id"))
    ranked = held.join(size.select("part", "give"), "part").withColumn("rank", rank)
    # The fleet: workers in line, and one slot for each place in each turn.
    line = free.select("worker_id", F.lit(-1).alias("from"), F.col("worker_id").alias("at")).unionByName(ranked.where("rank <= give").select("worker_id", F.col("part").cast("int").alias("from"), F.col("rank").cast("long").alias("at")))
    line = line.withColumn("k", F.row_number().over(Window.orderBy("from", "at")))
    most = line.count()
    slots = size.where("short > 0").select("part", F.explode(F.sequence(F.lit(1), F.least(F.col("short"), F.lit(most)).cast("int"))).alias("turn")) if most else size.limit(0).select("part", F.lit(1).alias("turn"))
    slots = slots.withColumn("k", F.row_number().over(Window.orderBy("turn", "part")))
    moved = line.select("worker_id", "k").join(slots.select("k", "part"), "k", "left").select("worker_id", "part")
    return ranked.where("rank > give").select("worker_id", "part").unionByName(moved)


def balance_hibernating(groups: DataFrame, workers: DataFrame, per_worker: int = 15) -> DataFrame:
    """(group_id, worker_id): hibernating groups of each pod spread evenly over as few workers as hold them; null without workers.

    groups: (pod, group_id, worker_id or null); workers: (pod, worker_id).  The
    workers with the most groups are used, and keep groups up to their share;
    what is over, after that of workers no longer used and groups without one,
    fills the workers that are short, in order.
    """
    pod = Window.partitionBy("pod")
    held = groups.groupBy("pod", "worker_id").agg(F.count("*").alias("n"))
    many = groups.groupBy("pod").agg(F.count("*").alias("groups"))
    fleet = workers.join(held, ["pod", "worker_id"], "left").withColumn("n", F.coalesce("n", F.lit(0))).join(many, "pod")
    fleet = fleet.withColumn("rank", F.row_number().over(pod.orderBy("n", "worker_id"))).withColumn("workers", F.count("*").over(pod))
    used = F.least(F.col("workers"), F.ceil(F.col("groups") / F.lit(float(per_worker))))
    fleet = fleet.withColumn("used", used).withColumn("i", F.col("rank") - (F.col("workers") - F.col("used")) - 1)
    low = F.floor(F.col("groups") / F.col("used"))
    share = F.when(F.col("i") >= 0, low + (F.col("i") >= F.col("used") - F.col("groups") % F.col("used")).cast("long")).otherwise(F.lit(0))
    fleet = fleet.withColumn("share", share).withColumn("short", F.greatest(F.lit(0), F.col("share") - F.col("n")))
    fleet = fleet.withColumn("upto", F.sum("short").over(pod.orderBy("rank")))
    placed = groups.join(fleet.select("pod", "worker_id", "rank", "i", "share"), ["pod", "worker_id"], "left")
    placed = placed.withColumn("r", F.row_number().over(Window.partitionBy("pod", "worker_id").orderBy("group_id")))
    stays = F.coalesce(F.col("r") <= F.col("share"), F.lit(False))
    place_ = F.when(F.col("i") < 0, 0).when(F.col("worker_id").isNull() | F.col("i").isNull(), 1).otherwise(2)
    free = placed.where(~stays).withColumn("k", F.row_number().over(pod.orderBy(place_, F.coalesce("rank", F.lit(0)), "group_id")))
    room = fleet.where("short > 0").select(F.col("pod").alias("p"), F.col("worker_id").alias("to"), (F.col("upto") - F.col("short")).alias("after"), "upto")
    moved = free.join(room, (F.col("pod") == F.col("p")) & (F.col("k") > F.col("after")) & (F.col("k") <= F.col("upto")), "left").select("group_id", F.col("to").alias("worker_id"))
    return placed.where(stays).select("group_id", "worker_id").unionByName(moved)


def fallback_pods(groups: DataFrame, workers: DataFrame) -> DataFrame:
    """(group_id, pod): groups of pods without workers go to the others in proportion to their workers, rounded, in order; null if none is left for them."""
    share = workers.groupBy("pod").agg(F.count("*").alias("n"))
    total, lost = workers.count(), groups.join(share.select("pod"), "pod", "left_anti")
    many = lost.count()
    takes = F.floor(F.col("n") / F.lit(float(max(total, 1))) * F.lit(many) + F.lit(0.5)).cast("long")
    # One row a pod.
    room = share.withColumn("takes", takes).withColumn("upto", F.sum("takes").over(Window.orderBy("pod"))).select(F.col("pod").alias("to"), (F.col("upto") - F.col("takes")).alias("after"), "upto")
    line = lost.withColumn("k", F.row_number().over(Window.orderBy("group_id")))
    moved = line.join(F.broadcast(room), (F.col("k") > F.col("after")) & (F.col("k") <= F.col("upto")), "left").select("group_id", F.col("to").alias("pod"))
    return groups.join(share.select("pod"), "pod").select("group_id", "pod").unionByName(moved)


def hibernating_plan(groups: int, workers: int, per_worker: int = 15) -> list[int]:
    """Even split over min(workers, ceil(groups / per_worker)) workers, smaller shares first."""
    n = min(workers, -(-groups // per_worker))
    return [] if n == 0 else [groups // n] * (n - groups % n) + [groups // n + 1] * (groups % n)
