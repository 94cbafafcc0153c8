"""Ordered folds: a state per key that sees its rows in order, in constant memory.

Rows are dealt by key and sorted within partitions, and one pass runs over the
Arrow batches; a key's rows are never gathered, so its length doesn't matter.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], columns: list[str], start: Callable[[], object], step: Callable[[object, dict], object], result: str, kind: str) -> DataFrame:
    """Add a column to `columns` with what `step(state, row)` returns; `start` makes the state of a key."""
    types = {"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}
    names = list(dict.fromkeys([*keys, *order, *columns]))

    def run(batches):
        key, state = object(), None
        for batch in batches:
            rows = batch.to_pylist()
            out = []
            for r in rows:
                now = tuple(r[k] for k in keys)
                if now != key:
                    key, state = now, start()
                out.append(step(state, r))
            yield pa.RecordBatch.from_arrays([*(batch.column(names.index(c)) for c in columns), pa.array(out, types[kind])], names=[*columns, result])

    schema = ", ".join(f"{c} {dict(df.dtypes)[c]}" for c in columns) + f", {result} {kind}"
    return df.select(*names).repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


class Tokens:
    """Credits and debits that expire after `window_ms` (None: never), on top of `free` tokens."""

    def __init__(self, window_ms: int | None, free: int = 0):
        self.window, self.free, self.sum, self.held = window_ms, free, 0, deque()

    def _drop(self, now: int) -> None:
        while self.window is not None and self.held and self.held[0][0] <= now - self.window:
            self.sum -= self.held.popleft()[1]

    def _add(self, now: int, n: int) -> None:
        self.sum += n
        if self.window is not None:
            if self.held and self.held[-1][0] == now:
                self.held[-1] = (now, self.held[-1][1] + n)
            else:
                self.held.append((now, n))

    def credit(self, now: int, n: int = 1) -> None:
        self._drop(now)
        self._add(now, n)

    def acquire(self, now: int, n: int = 1) -> bool:
        self._drop(now)
        if self.sum + self.free < n:
            return False
        self._add(now, -n)
        return True


class Inflight:
    """Fixed limit on what is in flight; with a bootstrap, a lower one until more than so many have succeeded.

    A limit of 0 is none, but the bootstrap's holds all the same.
    """

    def __init__(self, limit: int, bootstrap: int = 0, successes: int = 0):
        self.limit, self.bootstrap, self.need, self.used, self.done = limit, bootstrap, successes, 0, 0

    def acquire(self, n: int = 1) -> bool:
        if n < 0:
            return True
        limits = [x for x in (self.limit, self.bootstrap if self.done <= self.need else 0) if x]
        if limits and self.used > min(limits) - n:
            return False
        self.used += n
        return True

    def release(self, n: int = 1, succeeded: bool = True) -> None:
        self.used = max(0, self.used - n)
        self.done += succeeded


class Inbound:
    """Limits on messages received and not yet done: their number, and their bytes with what is over taken from a shared pool.

    Limits grow with the partitions; messages without bytes ask for nothing.
    """

    def __init__(self, partitions: int, messages: int = 1_000, most: int = 10_000, size: int = 10 << 20, pool: int = 512 << 20):
        self.count = Inflight(min(most, partitions * messages))
        self.bytes, self.pool = Inflight(partitions * size), Inflight(pool)
        self.held: dict[object, tuple[Inflight, int]] = {}

    def receive(self, key: object, size: int) -> str:
        """OWN or POOL by where the bytes come from, FULL if they have to wait, EMPTY without any."""
        if size <= 0:
            return "EMPTY"
        if not self.count.acquire():
            return "FULL"
        for name, where in (("OWN", self.bytes), ("POOL", self.pool)):
            if where.acquire(size):
                self.held[key] = (where, size)
                return name
        self.count.release()
        return "FULL"

    def done(self, key: object) -> None:
        where, size = self.held.pop(key, (None, 0))
        if where is not None:
            where.release(size)
            self.count.release()


class Queue:
    """Acknowledgement queue of a partition, step by step: receive, ack, nack and cancel; full at its capacity (0: none)."""

    UNSET, NACKED, CANCELED, ACKED = range(4)

    def __init__(self, capacity: int = 0):
        self.capacity = capacity
        self.states: dict[int, int] = {}
        self.order: deque[int] = deque()
        self.top = self.committed = None

    @property
    def full(self) -> bool:
        return 0 < self.capacity <= len(self.order)

    def receive(self, offset: int) -> bool:
        if self.full or self.top is not None and offset <= self.top:
            return False
        if self.top is None:
            self.committed = offset
        self.top = offset
        self.states[offset] = self.UNSET
        self.order.append(offset)
        return True

    def ack(self, position: int) -> int:
        """Takes the offset plus one; the new position, or -1 out of range, -2 repeated, -3 held back."""
        offset = position - 1
        if self.top is None or offset not in self.states:
            return -1
        if self.states[offset] == self.ACKED:
            return -2
        self.states[offset] = self.ACKED
        if self.order[0] != offset:
            return -3
        while self.order and self.states[self.order[0]] == self.ACKED:
            last = self.order.popleft()
            del self.states[last]
            self.committed = last + 1
        return self.committed

    def nack(self, offset: int) -> bool:
        if self.states.get(offset) != self.UNSET:
            return False
        self.states[offset] = self.NACKED
        return True

    def cancel(self, offset: int) -> bool:
        if self.states.get(offset) not in (self.UNSET, self.NACKED):
            return False
        self.states[offset] = self.CANCELED
        return True


class AckManager:
    """What a partition has in hand: the inbound limits, then the live messages, then the queue; acknowledged in the order queue, limits, messages."""

    def __init__(self, limits: Inbound, capacity: int = 0):
        self.limits, self.live, self.queue = limits, set(), Queue(capacity)

    def receive(self, offset: int, size: int) -> int:
        """1 if taken; 0 if it was before; -1 if the limits, -2 if the queue is full: the caller waits, nothing is kept."""
        if self.queue.full:
            return -2
        if self.limits.receive(offset, size) == "FULL":
            return -1
        taken = self.queue.receive(offset)
        if taken:
            self.live.add(offset)
        return int(taken)

    def ack(self, offset: int) -> int:
        position = self.queue.ack(offset + 1)
        self.limits.done(offset)
        self.live.discard(offset)
        return position

    def nack(self, offset: int) -> bool:
        return self.queue.nack(offset)


class Versions:
    """One key of a store whose puts compare and set its version; -1 without a value."""

    def __init__(self):
        self.version = -1

    def write(self, op: str, wanted: int) -> int:
        """Twice the version after the write, and one more if it was refused."""
        refused = op == "PUT" and (self.version < 0 or self.version != wanted)
        if op == "REMOVE":
            self.version = -1
        elif not refused:
            self.version += 1
        return 2 * self.version + refused
