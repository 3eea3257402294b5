"""The streams, run to the end of what is there."""

import datetime

import pytest
from pyspark.sql import functions as F

from fotoquarry.sources.catalog import Catalog
from fotoquarry.streaming import changes


@pytest.fixture()
def events(spark, sf_dir, tmp_path):
    df = spark.read.parquet(f"{sf_dir}/events.parquet").orderBy("ts")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    return df, changes.with_time(stream.withColumnRenamed("user_id", "root"), "10 minutes")


def finish(df, tmp_path, mode="append"):
    name = f"out{abs(hash(str(tmp_path))) % 10**9}"
    df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.table(name)


def test_debounced_stream(events, tmp_path):
    batch, stream = events
    got = {tuple(r) for r in finish(changes.debounced(stream, "30 minutes"), tmp_path).collect()}
    want = {tuple(r) for r in changes.debounced(changes.with_time(batch.withColumnRenamed("user_id", "root")), "30 minutes").collect()}
    # Sessions that ended before the watermark, ten minutes behind the last event, are all there, and no others.
    mark = batch.agg(F.max("ts").cast("timestamp")).first()[0] - datetime.timedelta(minutes=10)
    assert got == {r for r in want if r[2] <= mark} and len(got) > 100


def test_windows_of_a_stream(events, tmp_path):
    batch, stream = events
    got = {tuple(r) for r in finish(changes.tumbling(stream), tmp_path).collect()}
    want = {tuple(r) for r in changes.tumbling(changes.with_time(batch.withColumnRenamed("user_id", "root"))).collect()}
    mark = batch.agg(F.max("ts").cast("timestamp")).first()[0] - datetime.timedelta(minutes=10)
    assert got == {r for r in want if r[1] + datetime.timedelta(hours=1) <= mark} and len(got) > 100


def test_routed_stream_keeps_repeated_events(spark, tmp_path):
    rows = spark.createDataFrame([("D:\\A\\x", 1), ("D:\\A\\x", 1), ("D:\\B\\y", 2), ("E:\\z", 3)], "path string, size int")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    roots = spark.createDataFrame([("D:\\",), ("d:\\a\\",), (None,), ("D:\\",)], "root string")
    got = sorted(tuple(r) for r in finish(changes.routed(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), roots), tmp_path).collect())
    assert got == sorted(tuple(r) for r in changes.routed(rows, roots).collect()) == [("D:\\A\\x", 1, "d:\\a\\"), ("D:\\A\\x", 1, "d:\\a\\"), ("D:\\B\\y", 2, "D:\\")]


def test_repeated_requests_go(spark, tmp_path):
    rows = spark.createDataFrame([("a", True, "2024-01-01 00:00:00"), ("a", True, "2024-01-01 00:00:05"), ("b", False, "2024-01-01 00:00:06")], "folder string, force boolean, ts string")
    rows.coalesce(1).write.json(str(tmp_path / "in"))
    stream = changes.with_time(spark.readStream.schema("folder string, force boolean, ts string").json(str(tmp_path / "in")), "1 hour")
    assert finish(changes.distinct_requests(stream), tmp_path).count() == 2


def test_latest_answers_of_a_stream(spark, tmp_path):
    rows = [(1, 7, "yes", "2024-01-01 00:00:00", 1), (1, 7, "no", "2024-01-01 00:01:00", 2), (1, 8, "yes", "2024-01-01 00:00:00", 3), (1, 7, "yes", "2024-01-01 00:00:30", 4)]
    kind = "tag_id int, photo_id long, answer string, ts string, seq long"
    spark.createDataFrame(rows, kind).coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(kind).json(str(tmp_path / "in")).withColumn("ts", F.to_timestamp("ts"))
    got = {(r["photo_id"], r["answer"]) for r in finish(changes.latest_answers_stream(stream), tmp_path, "update").collect()}
    assert got == {(7, "no"), (8, "yes")}


def test_ingest_stream(spark, sf_dir, tmp_path):
    cat, seen = Catalog(spark, sf_dir), []
    cat.scan.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(cat.scan.schema).parquet(str(tmp_path / "in"))
    writer = changes.ingest(stream, lambda: cat.photos, lambda df, epoch: seen.append({r["action"]: r["count"] for r in df.groupBy("action").count().collect()}), 2027)
    writer.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert set(seen[0]) == {"added", "read", "unchanged", "mtime_only"}


def test_deltas(spark, sf_dir):
    cat = Catalog(spark, sf_dir)
    from fotoquarry.operators.maintenance import index_diff

    d = changes.deltas(index_diff(cat.scan, cat.photos, 2027), cat.photos, spark.createDataFrame([("old",)], "key string"), cat.photo_embeddings)
    assert {k: v.count() > 0 for k, v in d.items()} == {"read": True, "artefacts": True, "vectors": True}
