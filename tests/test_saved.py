"""Saved queries as rows against one query at a time."""

import random

from fotoquarry.operators import gallery, saved
from fotoquarry.sources.catalog import Catalog


def some_queries(n, seed=4):
    rng, out = random.Random(seed), {}
    pick = lambda *values: rng.choice(values)
    for k in range(n):
        q = {}
        for name, make in {
            "tag_ids": lambda: tuple(rng.sample([1, 2, 3, 5, 8, 13, 21, 99], rng.randrange(1, 3))), "match_any": lambda: True, "exclude_tag_ids": lambda: (rng.randrange(1, 26),), "search": lambda: pick("IMG", "nota", "1996", "w%p"), "media_type": lambda: pick("image", "video"),
            "year_from": lambda: pick(1990, 1995, 1999, 2050), "year_to": lambda: pick(1993, 1997, 2030), "min_megapixels": lambda: pick(2, 11.5), "orientation": lambda: pick("landscape", "portrait", "square"), "min_duration": lambda: 30.0, "max_duration": lambda: 300.0, "min_rating": lambda: pick(1, 3, 5),
            "favorites_only": lambda: True, "untagged_only": lambda: True, "with_note": lambda: True, "folder": lambda: pick("G:/Fotos/1996", "D:\\Fotos\\", "\\\\nas\\fotos"), "not_rejected_for": lambda: rng.randrange(1, 26), "rejected_for": lambda: rng.randrange(1, 26),
        }.items():
            if rng.random() < 0.12:
                q[name] = make()
        out[f"q{k}"] = gallery.GalleryQuery(**q)
    return out


def test_rows_equal_one_at_a_time(spark, sf_dir):
    cat, own = Catalog(spark, sf_dir), some_queries(150)
    rows = spark.createDataFrame([(name, q.to_json()) for name, q in own.items()], "name string, query string")
    for shown in (False, True):
        want = {r["name"]: r["n"] for r in gallery.count_queries(cat, own, shown).collect()}
        assert {r["name"]: r["n"] for r in saved.count_saved(cat, rows, shown).collect()} == want
    assert sum(n > 0 for n in want.values()) > 50


def test_ten_thousand_queries(spark, sf_dir):
    """The plan is as large as for one, and counts equal those of a sample one at a time."""
    cat, own = Catalog(spark, sf_dir), some_queries(10_000, 9)
    rows = spark.createDataFrame([(name, q.to_json()) for name, q in own.items()], "name string, query string")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("\n")
    got = saved.count_saved(cat, rows)
    assert plan(got) == plan(saved.count_saved(cat, spark.createDataFrame([("q7", own["q7"].to_json())], rows.schema)))
    counts = {r["name"]: r["n"] for r in got.collect()}
    some = dict(random.Random(1).sample(sorted(own.items()), 60))
    assert len(counts) == 10_000 and {k: counts[k] for k in some} == {r["name"]: r["n"] for r in gallery.count_queries(cat, some).collect()}


def test_odd_rows(spark, sf_dir):
    cat = Catalog(spark, sf_dir)
    every = cat.photos.count()
    rows = [("all", "{}"), ("broken", "no json"), ("unknown", '{"colour": "red"}'), ("gone", '{"tag_ids": [999]}'), ("empty", '{"year_from": 2100}'), (None, "{}"), ("twice", '{"min_rating": 5}'), ("twice", '{"min_rating": 9}')]
    got = {r["name"]: r["n"] for r in saved.count_saved(cat, spark.createDataFrame(rows, "name string, query string"), True).collect()}
    assert got == {"all": every, "broken": every, "unknown": every, "gone": every, "empty": 0, "twice": cat.photos.where("rating >= 5").count()}
    assert saved.count_saved(cat, spark.createDataFrame([], "name string, query string")).count() == 0
