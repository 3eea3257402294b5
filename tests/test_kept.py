"""Kept counts against recounts after random changes, and pages, places and positions by ranges."""

import random

import pytest
from pyspark.sql import functions as F

from fotoquarry.operators import aggregates, gallery, kept, orderstats
from fotoquarry.sources.catalog import Catalog

PHOTO = "id long, folder string, year int, month int"
PAIR = "photo_id long, tag_id int"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def recount(spark, photos, pairs):
    p, t = spark.createDataFrame(list(photos.values()), PHOTO), spark.createDataFrame(sorted(pairs), PAIR)
    return [aggregates.timeline(p), aggregates.folder_tree(p), aggregates.root_counts(p), aggregates.tag_counts(t)]


def test_random_changes_equal_a_recount(spark, tmp_path):
    rng = random.Random(5)
    folders = ["C:\\", "C:\\a\\", "C:\\a\\b\\", "D:\\x\\", "\\\\nas\\share\\", "\\\\nas\\share\\q\\"]
    photo = lambda i: (i, rng.choice(folders), rng.choice([None, 1999, 2000]), rng.choice([None, 1, 12]))
    photos = {i: photo(i) for i in range(60)}
    pairs = {(rng.randrange(60), rng.randrange(4)) for _ in range(80)}
    counts = kept.KeptCounts(spark, str(tmp_path / "kept"))
    frame = lambda rows, schema: spark.createDataFrame(sorted(rows, key=str), schema)
    counts.apply(0, kept.signed(None, frame(photos.values(), PHOTO)), kept.signed(None, frame(pairs, PAIR)))
    for version in range(1, 7):
        before, after = [], []
        for i in rng.sample(sorted(photos), 12):
            before.append(photos.pop(i))
            if rng.random() < 0.6:
                photos[i] = photo(i)
                after.append(photos[i])
        new = [photo(100 * version + k) for k in range(4)]
        photos |= {p[0]: p for p in new}
        lost = {p for p in pairs if p[0] not in photos or rng.random() < 0.1}
        gained = {(rng.choice(sorted(photos)), rng.randrange(5)) for _ in range(9)} - pairs
        pairs = (pairs - lost) | gained
        counts.apply(version, kept.signed(frame(before, PHOTO), frame(after + new, PHOTO)), kept.signed(frame(lost, PAIR), frame(gained, PAIR)))
    got = counts.read()
    made = [kept.timeline(got), kept.folder_tree(got), kept.root_counts(got), kept.tag_counts(got)]
    for have, want in zip(made, recount(spark, photos, pairs)):
        assert rows_of(have.select(*want.columns)) == rows_of(want)
    assert counts.versions() == [5, 6]


def test_repeated_lost_and_wrong_versions(spark, tmp_path):
    counts = kept.KeptCounts(spark, str(tmp_path / "kept"))
    one = kept.signed(None, spark.createDataFrame([(1, "C:\\a\\", 1999, 1), (2, None, None, None)], PHOTO))
    with pytest.raises(FileNotFoundError):
        counts.read()
    with pytest.raises(ValueError):
        counts.apply(3, one)
    (tmp_path / "kept" / f"v{0:012d}").mkdir(parents=True)  # left by a lost job
    assert counts.versions() == []
    first = rows_of(counts.apply(0, one))
    assert rows_of(counts.apply(0, one)) == first and ("month", None, None, None, 1) in first
    with pytest.raises(ValueError):
        counts.apply(1)
    gone = kept.signed(spark.createDataFrame([(1, "C:\\a\\", 1999, 1), (2, None, None, None)], PHOTO), None)
    assert counts.apply(1, gone).count() == 0
    assert counts.apply(2, kept.signed(None, spark.createDataFrame([], PHOTO))).count() == 0


def test_a_change_reads_no_unchanged_photo(spark, sf_dir, tmp_path):
    cat = Catalog(spark, sf_dir)
    counts = kept.KeptCounts(spark, str(tmp_path / "kept"))
    counts.apply(0, kept.signed(None, cat.photos))
    cat.photos.where("id % 100 = 3").write.parquet(str(tmp_path / "changed"))
    before = spark.read.parquet(str(tmp_path / "changed"))
    new = kept.deltas(kept.signed(before, before.withColumn("year", F.lit(2001))))
    assert all(str(tmp_path / "changed") in f for f in new.inputFiles())
    after = counts.apply(1, kept.signed(before, before.withColumn("year", F.lit(2001))))
    want = aggregates.timeline(cat.photos.withColumn("year", F.when(F.col("id") % 100 == 3, 2001).otherwise(F.col("year"))))
    assert rows_of(kept.timeline(after)) == rows_of(want)


def scanned(df):
    """(rows collected, rows that the scans of photos gave)."""
    got = df.collect()
    plan, total, todo = df._jdf.queryExecution().executedPlan(), 0, []
    todo.append(plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan)
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "FileSourceScanExec":
            total += node.metrics().apply("numOutputRows").value()
        if name.endswith("QueryStageExec"):
            todo.append(node.plan())
        children = node.children()
        todo += [children.apply(k) for k in range(children.size())]
    return got, total


@pytest.mark.parametrize("field", gallery.ORDERS)
def test_pages_by_ranges_read_little(spark, sf_dir, tmp_path, field):
    cat = Catalog(spark, sf_dir)
    laid = orderstats.build(cat.photos, field, str(tmp_path / "t"), (), 12)
    total = laid.total()
    assert laid.sizes.count() > 80 and total == cat.photos.count()
    for ascending in (True, False):
        want = [r["id"] for r in gallery.page(cat.photos, field, ascending).select("id").collect()]
        for limit, offset in ((5, 0), (5, total // 2), (20, total - 7), (5, total), (1, 17), (-1, total - 40)):
            page, read = scanned(laid.page(ascending, limit, offset))
            assert [r["id"] for r in page] == want[offset : None if limit < 0 else offset + limit]
            assert limit < 0 or limit > 5 or read <= 0.05 * total
        keys = cat.photos.where(F.col("id") == want[33]).first().asDict()
        assert laid.place(keys, ascending) == 34
    assert laid.place({**keys, "id": -5}, True) is None


def test_positions_by_ranges(spark, sf_dir, tmp_path):
    cat = Catalog(spark, sf_dir)
    laid = orderstats.build(cat.photos, "date", str(tmp_path / "t"), (), 30)
    for year in (None, 1990, 1992, 1995, 1998, 2040):
        for month in (None, "none", 1, 6, 12):
            for ascending in (True, False):
                n = laid.position(year, month, ascending)
                assert n.first()["n"] == gallery.position(cat.photos, year, month, ascending).first()["n"]
    with pytest.raises(ValueError):
        orderstats.build(cat.photos, "added", str(tmp_path / "u")).position(1995, 1, True)


def test_empty_table(spark, tmp_path):
    none = spark.createDataFrame([], "id long, filename string, filesize long")
    laid = orderstats.build(none, "filename", str(tmp_path / "t"))
    assert laid.total() == 0 and laid.page(True, 10).count() == 0 and laid.place({"id": 1, "filename": "a"}, True) is None
