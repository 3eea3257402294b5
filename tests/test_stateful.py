"""Snapshot streams and streams with state: restarts, timers, bounded state."""

import datetime
import time

import pytest

from fotoquarry.operators.maintenance import index_diff
from fotoquarry.sources import snapshots
from fotoquarry.sources.catalog import Catalog
from fotoquarry.streaming import stateful


def run(df, tmp_path, mode="append", name="out"):
    """Everything that is there, into Parquet or memory; the checkpoint stays for the next run."""
    query = df.writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / "cp"))
    if mode == "append":
        query.trigger(availableNow=True).format("parquet").option("path", str(tmp_path / name)).start().awaitTermination(120)
        return df.sparkSession.read.schema(df.schema).parquet(str(tmp_path / name))
    # Streams with timers never run out of batches; one batch takes all that is there.
    seen = []
    query.trigger(once=True).foreachBatch(lambda b, epoch: seen.extend(b.collect())).start().awaitTermination(120)
    return seen


def test_each_change_once_over_restarts(spark, tmp_path):
    folder, kind = str(tmp_path / "lists"), "path string, size long, mtime double"
    lists = [[("a", 1, 1.0), ("b", 1, 1.0), (None, 9, 9.0)], [("a", 1, 1.0), ("b", 2, 1.0), ("c", 1, None)], [("b", 2, 1.0), ("c", 1, None), ("c", 1, None)], [], [("b", 2, 1.0)]]
    want = [
        {("a", "added", 1, 1.0, None, None, 1), ("b", "added", 1, 1.0, None, None, 1)}, {("b", "changed", 2, 1.0, 1, 1.0, 2), ("c", "added", 1, None, None, None, 2)}, {("a", "removed", None, None, 1, 1.0, 3)},
        {("b", "removed", None, None, 2, 1.0, 4), ("c", "removed", None, None, 1, None, 4)}, {("b", "added", 2, 1.0, None, None, 5)},
    ]
    seen = set()
    for rows, new in zip(lists, want):
        snapshots.take_snapshot(spark.createDataFrame(rows, kind), folder, 3)
        got = [tuple(r) for r in run(snapshots.listing_changes(spark, folder, 3), tmp_path).collect()]
        assert len(got) == len(set(got)) and set(got) - seen == new
        seen = set(got)
    # Without news a restart brings nothing; several snapshots at once are one change.
    assert {tuple(r) for r in run(snapshots.listing_changes(spark, folder, 3), tmp_path).collect()} == seen
    assert [tuple(r)[:3] for r in run(snapshots.listing_changes(spark, folder, 3), tmp_path / "new").collect()] == [("b", "added", 2)]


def test_unfinished_snapshots_do_not_count(spark, tmp_path):
    folder = str(tmp_path / "lists")
    assert snapshots.snapshots(folder) == []
    snapshots.take_snapshot(spark.createDataFrame([("a", 1, 1.0)], "path string, size long, mtime double"), folder)
    (tmp_path / "lists" / "snapshot-000000002" / "bucket=0").mkdir(parents=True)
    assert snapshots.snapshots(folder) == [1] == snapshots.snapshots(f"file:{folder}")
    assert snapshots.take_snapshot(spark.createDataFrame([("b", 1, 1.0)], "path string, size long, mtime double"), folder) == 2


def test_changes_equal_the_index_diff(spark, sf_dir, tmp_path):
    cat, folder = Catalog(spark, sf_dir), str(tmp_path / "lists")
    snapshots.take_snapshot(cat.photos.selectExpr("path", "filesize AS size", "mtime"), folder)
    run(snapshots.listing_changes(spark, folder), tmp_path)
    snapshots.take_snapshot(cat.scan, folder)
    got = {(r["path"], r["change"]) for r in run(snapshots.listing_changes(spark, folder), tmp_path).where("snapshot = 2").collect()}
    names = {"added": "added", "read": "changed", "mtime_only": "changed"}
    want = {(r["path"], names[r["action"]]) for r in index_diff(cat.scan, cat.photos, 9999).where("action <> 'unchanged'").collect()}
    want |= {(r["path"], "removed") for r in cat.photos.join(cat.scan, "path", "left_anti").select("path").collect()}
    assert got == want and {c for _, c in want} == {"added", "changed", "removed"}


@pytest.fixture()
def incoming(spark, tmp_path):
    """A folder of JSON files as a stream, and how to put more into it."""

    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / name))

    def stream(name, schema):
        return spark.readStream.schema(schema).json(str(tmp_path / name))

    return put, stream


def test_debounce_fires_by_timer(spark, tmp_path, incoming):
    put, stream = incoming
    kind = "root string, ts timestamp"
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    put("in", [("a", at(0)), ("a", at(5)), ("b", at(1)), (None, at(2)), ("b", None)], kind)
    put("in", [("a", at(3))], kind)
    fired = []
    query = (
        stateful.debounced_by_timer(stream("in", kind), 2.0).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="500 milliseconds")
        .foreachBatch(lambda b, epoch: fired.extend((r["root"], r["first"], r["last"], r["n"]) for r in b.collect())).start()
    )
    try:
        until = time.time() + 90
        while len(fired) < 3 and time.time() < until:
            time.sleep(0.3)
        # No event came after the first file, and each root fired once.
        assert sorted(fired, key=repr) == sorted([("a", at(0), at(5), 3), ("b", at(1), at(1), 2), (None, at(2), at(2), 1)], key=repr)
        put("in", [("a", at(60))], kind)
        while len(fired) < 4 and time.time() < until:
            time.sleep(0.3)
        assert fired[3] == ("a", at(60), at(60), 1)
        while query.lastProgress["stateOperators"][0]["numRowsTotal"] and time.time() < until:
            time.sleep(0.3)
        assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 0  # nothing waits, nothing is kept
    finally:
        query.stop()


def test_pending_requests_over_batches(spark, tmp_path, incoming):
    put, stream = incoming
    kind, got = "folder string, force boolean, done boolean, seq long", []
    for rows in ([("x", False, False, 1), ("x", False, False, 2), ("y", True, False, 3)], [("x", True, False, 4), ("y", False, False, 5), ("y", True, False, 6)], [("x", None, True, 7), ("x", False, None, 8), ("y", True, False, 9), ("z", True, None, None)]):
        put("in", rows, kind)
        got += [tuple(r) for r in run(stateful.pending_requests(stream("in", kind)), tmp_path, "update")]
    assert sorted(got) == [("x", False, 1), ("x", False, 8), ("x", True, 4), ("y", True, 3)]


def test_answers_over_batches(spark, tmp_path, incoming):
    put, stream = incoming
    kind = "tag_id int, photo_id long, answer string, ts timestamp, seq long"
    at = lambda s: datetime.datetime(2024, 1, 1, 0, s)
    batches = [
        [(1, 7, "yes", at(0), 1), (1, 7, "no", at(2), 2), (1, 8, "yes", at(0), 3), (2, 7, "no", at(0), 4), (1, 7, "yes", None, 9)],
        [(1, 7, "yes", at(1), 5), (1, 8, "no", at(3), 6)],  # the first is late
        [(1, 7, "yes", at(2), 7)],  # same time, later number
    ]
    want = [{(1, 7, "no", None), (1, 8, "yes", None), (2, 7, "no", None)}, {(1, 8, "no", "yes")}, {(1, 7, "yes", "no")}]
    for rows, new in zip(batches, want):
        put("in", rows, kind)
        assert {tuple(r)[:4] for r in run(stateful.answers_that_hold(stream("in", kind)), tmp_path, "update")} == new


def test_answers_run_out(spark, tmp_path, incoming):
    put, stream = incoming
    kind = "tag_id int, photo_id long, answer string, ts timestamp, seq long"
    old, later = datetime.datetime(2024, 1, 1), datetime.datetime(2023, 1, 1)
    put("in", [(1, k, "yes", old, k) for k in range(50)], kind)
    assert len(run(stateful.answers_that_hold(stream("in", kind), 1.0), tmp_path, "update")) == 50
    time.sleep(2)
    put("in", [(1, 3, "no", later, 99)], kind)
    # What ran out is forgotten: the older answer is the first of its pair.
    assert [tuple(r)[:4] for r in run(stateful.answers_that_hold(stream("in", kind), 1.0), tmp_path, "update")] == [(1, 3, "no", None)]
