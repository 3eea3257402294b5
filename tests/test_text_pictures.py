"""Grey pictures of texts: what a row sends and what a picture holds."""

import hashlib

from fotoquarry.operators import perceptual


def test_pictures_of_texts(spark):
    data = [(1, "One two, TWO! a1-b2"), (2, None), (3, " ... "), (4, "x " * 40), (5, "one"), (5, "one two"), (5, None), (None, "seven")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    got = {r["id"]: [int(v) for v in r["grey"]] for r in perceptual.text_pictures(docs).collect()}

    def grey(*words):
        cells = [0] * 1024
        for w in words:
            cells[int(hashlib.md5(w.encode()).hexdigest()[:3], 16) >> 2] += 16
        return [min(255, c) for c in cells]

    want = {1: grey("one", "two", "two", "a1", "b2"), 2: grey(), 3: grey(), 4: grey(*["x"] * 40), 5: grey("one", "one", "two"), None: grey("seven")}
    assert got == want


def test_no_row_a_word(spark):
    """Words do not cross a shuffle one by one: the plan has no generator, and one exchange."""
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    plan = perceptual.text_pictures(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("Exchange hashpartitioning") == 1
