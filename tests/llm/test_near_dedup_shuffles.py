"""Near-dedup sends texts once to those they are compared with, whatever repeats."""

from fotoquarry.llm import dedup

LONG = " ".join(f"w{k}" for k in range(60))


def test_texts_are_shuffled_once(spark, monkeypatch):
    monkeypatch.setattr(dedup, "BLOCK", 2)
    texts = spark.createDataFrame([(1, LONG), (2, LONG + " end"), (3, "other words are here for once"), (4, LONG + " fin"), (5, LONG + " last")], "sid long, text string").select("sid", "text")
    texts = texts.withColumn("text", texts.text.cast("binary"))
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 4), (1, 5), (2, 4)], "a long, b long")
    got = dedup._verified(pairs, texts, 5)
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted(map(tuple, got.collect())) == [(1, 2), (1, 4), (1, 5), (2, 4)]


def test_one_row_of_each_kept_id(spark):
    data = [(1, LONG, "a"), (1, LONG, "b"), (2, LONG + " end", "c"), (3, "x y", "d"), (3, "z", "e"), (None, LONG, "f"), (None, LONG, "f"), (4, None, "g"), (5, "", "h")]
    got = dedup.keep_first_similar(spark.createDataFrame(data, "doc_id long, text string, k string")).collect()
    assert sorted(r["doc_id"] for r in got if r["doc_id"] is not None) == [1, 3, 4]
    assert [r["k"] for r in got if r["doc_id"] is None] == ["f", "f"]
