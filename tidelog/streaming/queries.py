"""Structured Streaming forms of the batch operators, over any stream of log records.

Streams come from read_files() or from any source with the same columns, so a
broker's connector needs no change here.  Event time must be a TIMESTAMP.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LOG = "topic string, part long, off long, ts timestamp, value double, status string"


def read_files(spark: SparkSession, path: str, schema: str = LOG, files: int = 1) -> DataFrame:
    """A stream of Parquet files, so many a trigger (the back-pressure of this source)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def read_broker(spark: SparkSession, servers: str, assign: str, starting: str, ending: str | None = None) -> DataFrame:
    """Records of assigned partitions from a broker; needs the connector on the class path."""
    if ending is None:
        return spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("assign", assign).option("startingOffsets", starting).load()
    return spark.read.format("kafka").option("kafka.bootstrap.servers", servers).option("assign", assign).option("startingOffsets", starting).option("endingOffsets", ending).load()


def tumbling(stream: DataFrame, width: str, late: str = "10 minutes") -> DataFrame:
    """Count, sum and maximum of each topic and window; state goes when the watermark passes."""
    w = stream.withWatermark("ts", late).groupBy(F.window("ts", width), "topic").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max("value").alias("top"))
    return w.select("topic", F.col("window.start").alias("start"), "n", "total", "top")


def sliding(stream: DataFrame, width: str, slide: str, late: str = "10 minutes") -> DataFrame:
    w = stream.withWatermark("ts", late).groupBy(F.window("ts", width, slide), "topic").agg(F.max("value").alias("top"))
    return w.select("topic", F.col("window.start").alias("start"), "top")


def latest(stream: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """The last value of each key; in update mode a row for each change."""
    return stream.groupBy(*keys).agg(F.max_by(value, order).alias(value), F.max(order).alias(order))


def commit_positions(stream: DataFrame) -> DataFrame:
    """(topic, part, commit_off) after each batch; state holds the open offsets of a partition and the highest received.

    A record may come again with a later status; once acknowledged it stays so.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        opened, top = state.get if state.exists else ([], -1)
        still, first = set(opened), top
        for rows in batches:
            for off, status in zip(rows.off.tolist(), rows.status.tolist(), strict=True):
                if status == "ACKED":
                    still.discard(off)
                elif off > first:
                    still.add(off)
                top = max(top, off)
            acked = set(rows.off[rows.status == "ACKED"].tolist())
            still -= acked
        state.update((sorted(still), top))
        yield pd.DataFrame({"topic": [key[0]], "part": [key[1]], "commit_off": [min(still) if still else top + 1]})

    return stream.groupBy("topic", "part").applyInPandasWithState(step, "topic string, part long, commit_off long", "opened array<long>, top long", "update", GroupStateTimeout.NoTimeout)


def folded(stream: DataFrame, keys: list[str], order: list[str], columns: list[str], start: Callable[[], object], step: Callable[[object, dict], object], result: str, kind: str) -> DataFrame:
    """The streaming form of an ordered fold: a key's state lives on from batch to batch.

    Scale machines, token buckets, limits and queues are all folds of this kind.
    Rows of a key are taken in order within a batch; batches come in order of arrival.
    """
    names = list(dict.fromkeys([*keys, *order, *columns]))
    types = dict(stream.dtypes)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = pickle.loads(state.get[0]) if state.exists else start()
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")
        rows[result] = [step(held, r) for r in rows[names].to_dict("records")]
        state.update((pickle.dumps(held),))
        yield rows[[*columns, result]]

    schema = ", ".join(f"{c} {types[c]}" for c in columns) + f", {result} {kind}"
    return stream.select(*names).groupBy(*keys).applyInPandasWithState(run, schema, "held binary", "append", GroupStateTimeout.NoTimeout)


def released(stream: DataFrame, delay_ms: int, late: str = "0 seconds") -> DataFrame:
    """(topic, part, off) of records whose hold is over, in order of offsets: the first that is not due holds its partition.

    Time is the watermark; a timer at the head's due time wakes a partition that gets no more records.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        offs, due = (list(x) for x in state.get) if state.exists else ([], [])
        if not state.hasTimedOut:
            for rows in batches:
                offs += rows.off.tolist()
                due += [int(t.timestamp() * 1000) + delay_ms for t in rows.ts]
        line = sorted(zip(offs, due, strict=True))
        now = state.getCurrentWatermarkMs()
        n = next((i for i, (_, t) in enumerate(line) if t > now), len(line))
        rest = line[n:]
        if rest:
            state.update(([o for o, _ in rest], [t for _, t in rest]))
            state.setTimeoutTimestamp(max(rest[0][1], now + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"topic": [key[0]] * n, "part": [key[1]] * n, "off": [o for o, _ in line[:n]]})

    marked = stream.withWatermark("ts", late).select("topic", "part", "off", "ts")
    return marked.groupBy("topic", "part").applyInPandasWithState(run, "topic string, part long, off long", "offs array<long>, due array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def workload(stream: DataFrame, key: str, value: str, ttl_ms: int, late: str = "0 seconds") -> DataFrame:
    """(key, value, live): the last value of each key after each batch, and a row with live = false once it has not been renewed for its time to live."""
    kind = dict(stream.dtypes)[key]

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last = state.get[1]
            state.remove()
            yield pd.DataFrame({key: [k[0]], value: [last], "live": [False]})
            return
        at, last = state.get if state.exists else (-1, 0.0)
        for rows in batches:
            for t, x in zip(rows.ts, rows[value], strict=True):
                ms = int(t.timestamp() * 1000)
                if ms >= at:
                    at, last = ms, float(x)
        state.update((at, last))
        state.setTimeoutTimestamp(max(at + ttl_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [k[0]], value: [last], "live": [True]})

    marked = stream.withWatermark("ts", late).select(key, "ts", value)
    return marked.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, {value} double, live boolean", "at long, last double", "append", GroupStateTimeout.EventTimeTimeout)


def write_broker(stream: DataFrame, servers: str, checkpoint: str, topic: str = "destination"):
    """Write the envelopes of each record to the topic it names; needs the connector on the class path."""
    packed = stream.where(F.col(topic).isNotNull()).select(F.col(topic).alias("topic"), F.to_json(F.struct(*[c for c in stream.columns if c != topic])).cast("binary").alias("value"))
    return packed.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("checkpointLocation", checkpoint)


def route_to(stream: DataFrame, folder: str, checkpoint: str, column: str = "destination"):
    """Write each batch to a folder per destination; rows without one are done. Batches are written under their number, so a retried one replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.where(F.col(column).isNotNull()).write.mode("overwrite").partitionBy(column).parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
