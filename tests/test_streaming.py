"""Streams give what the batch operators give over the same rows."""

from pyspark.sql import functions as F

from tidelog.operators import commits, folds, scans
from tidelog.operators.scaling import ScaleState
from tidelog.streaming import queries


def rows(spark):
    return spark.range(200).selectExpr(
        "'t' || id % 2 as topic", "id % 3 as part", "id div 6 as off", "timestamp_seconds(1700000000 + id * 30) as ts", "cast(id % 17 as double) as value", "if(id % 11 = 0, 'NACKED', 'ACKED') as status"
    )


def test_windows_and_positions(spark, tmp_path):
    rows(spark).orderBy("ts").coalesce(1).write.option("maxRecordsPerFile", 50).parquet(str(tmp_path / "in"))
    stream = queries.read_files(spark, str(tmp_path / "in"))
    q = queries.tumbling(stream, "10 minutes").writeStream.format("memory").queryName("tumble").outputMode("complete").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    batch = rows(spark).groupBy(F.window("ts", "10 minutes"), "topic").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("topic", F.col("window.start").alias("start"), "n", "total")
    assert sorted(map(tuple, spark.table("tumble").select("topic", "start", "n", "total").collect())) == sorted(map(tuple, batch.collect()))
    q = queries.commit_positions(stream).writeStream.format("memory").queryName("positions").outputMode("update").option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    last = {(r.topic, r.part): r.c for r in spark.table("positions").groupBy("topic", "part").agg(F.max("commit_off").alias("c")).collect()}
    assert last == {(r.topic, r.part): r.commit_off for r in commits.commit_watermark(rows(spark)).collect()}


def test_routes(spark, tmp_path):
    rows(spark).withColumn("destination", F.when(F.col("status") != "ACKED", "dlq")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = queries.read_files(spark, str(tmp_path / "in"), queries.LOG + ", destination string")
    q = queries.route_to(stream, str(tmp_path / "out"), str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == rows(spark).where("status <> 'ACKED'").count()


def drain(stream, tmp_path, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
    q.processAllAvailable()
    q.stop()
    return stream.sparkSession.table(name)


def test_folds_go_on_from_batch_to_batch(spark, tmp_path):
    rows(spark).orderBy("ts").coalesce(1).write.option("maxRecordsPerFile", 60).parquet(str(tmp_path / "in"))
    stream = queries.read_files(spark, str(tmp_path / "in"))

    def tokens(t, r):
        return t.acquire(0) if r["off"] % 3 else bool(t.credit(0, 2))

    def scale(held, r):
        ms = r["off"] * 60_000
        state = held.setdefault("s", ScaleState(ms, 1.0))
        return float(state.sample(ms, r["value"] / 8))

    for name, start, step, kind in (("tokens", lambda: folds.Tokens(None), tokens, "boolean"), ("scales", dict, scale, "double")):
        args = ["topic", "part"], ["off"], ["topic", "part", "off", "value"], start, step, "x", kind
        got = drain(queries.folded(stream, *args), tmp_path, name)
        want = folds.ordered_fold(rows(spark), *args)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 200


def test_hold_releases_prefixes(spark, tmp_path):
    all_rows = rows(spark).withColumn("ts", F.expr("if(off = 20, ts + interval 30 minutes, ts)"))
    all_rows.orderBy("off").coalesce(1).write.option("maxRecordsPerFile", 40).parquet(str(tmp_path / "in"))
    got = drain(queries.released(queries.read_files(spark, str(tmp_path / "in")), 600_000), tmp_path, "held").collect()
    log = all_rows.withColumn("ts_ms", F.unix_millis("ts"))
    mark = log.agg(F.max("ts_ms")).first()[0]
    want = scans.released(log, 600_000, mark).select("topic", "part", "off").collect()
    assert len(got) == len(set(got)) and set(map(tuple, got)) == set(map(tuple, want)) and len(want) < 200


def test_workload_ends_with_its_time_to_live(spark, tmp_path):
    some = spark.createDataFrame([("a", 0, 1.0), ("a", 60, 2.0), ("b", 0, 5.0), ("c", 1000, 7.0), ("c", 2000, 8.0)], "topic string, s long, value double")
    some = some.selectExpr("topic", "0L as part", "s as off", "timestamp_seconds(1700000000 + s) as ts", "value", "'' as status")
    some.orderBy("ts").coalesce(1).write.option("maxRecordsPerFile", 2).parquet(str(tmp_path / "in"))
    got = drain(queries.workload(queries.read_files(spark, str(tmp_path / "in")), "topic", "value", 300_000), tmp_path, "load")
    assert {(r.topic, r.value) for r in got.where("not live").collect()} == {("a", 2.0), ("b", 5.0)}
    assert {r.topic for r in got.where("live").collect()} == {"a", "b", "c"}
