"""The pipeline against the stages' brute-force versions on the small table."""

import zlib

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from fotoquarry.llm import langid, quality
from fotoquarry.llm.common import table, written
from test_text_operators import brute_jaccard, brute_removed


def kept_by_dense_kernel(rows):
    """Ids of texts with evidence of a language, by kernel ridge regression on all learned texts without landmarks."""
    known = sorted((r["lang"], zlib.crc32(str(r["doc_id"]).encode()), langid.grams(r["text"].encode())) for r in rows if r["lang"] and r["doc_id"] is not None and any(c.isalpha() for c in r["text"] or "") and zlib.crc32(str(r["doc_id"]).encode()) % 5)
    own, names = [g for *_, g in known], sorted({lang for lang, *_ in known})
    w = np.array([1 / sum(lang == x for x, *_ in known) for lang, *_ in known])
    k = langid.kernel(own, own)
    fit = np.linalg.solve(k + langid.RIDGE * len(own) * np.diag(w.mean() / w), np.array([[float(lang == n) for n in names] for lang, *_ in known]))
    usual = np.array([np.quantile((k @ fit)[[lang == n for lang, *_ in known], c], 0.05) for c, n in enumerate(names)])
    asked = [r for r in rows if any(c.isalpha() for c in r["text"] or "")]
    grams = [langid.grams(r["text"].encode()) for r in asked]
    short = np.sqrt(np.minimum(1, np.array([len(g) for g in grams]) / langid.FEW))
    good = (langid.kernel(grams, own) @ fit >= langid.EVIDENCE * usual * short[:, None]).any(1)
    return {r["doc_id"] for r, ok in zip(asked, good) if ok}


NASTY = ["d", "r", "a", "s", "n", "raw", "spans", "short", "kept", "_d", "_r", "_raw", "_spans", "_kept", "_own_text", "_own_doc_id", "own_text", "own_lang", "letter", "x0", "x1", "x2", "key", "sid", "a.b", "text.", "`q`", "Doc_Id2", "score", "_letter", "_raw_text", "least", "many", "component_id"]


def test_stages_keep_clashing_columns_and_odd_rows(spark, sf_dir):
    """Null ids and texts, repeated rows and ids, empty texts, and columns called what the stages use inside."""
    docs = table(spark, sf_dir, "documents").limit(60)
    long = " ".join(f"wort{k}" for k in range(90))
    known = next(r["text"] for r in docs.orderBy("doc_id").collect() if r["lang"] and len(r["text"] or "") > 800)
    odd = spark.createDataFrame([(None, known, "de", "s", 1), (10**6, None, None, None, None), (10**6 + 1, "", "de", "s", 0), (10**6 + 2, long, "de", "s", 5), (10**6 + 2, long, "de", "s", 5), (10**6 + 3, "vor " + long, "de", "s", 5)], docs.schema)
    both = docs.unionByName(odd)
    both = both.select("*", *[F.concat(F.lit(f"{k}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(n) for k, n in enumerate(NASTY)])
    both = both.toDF(*both.columns[:5], *NASTY)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for df in (both, both.limit(0)):
            out = stage(spark, df, sf_dir)
            assert out.columns == both.columns, name
            rows = written(out.toDF(*[f"c{k}" for k in range(len(out.columns))])).collect()
            for r in rows:
                i = "-" if r["c0"] is None else str(r["c0"])
                assert [r[f"c{5 + k}"] for k in range(len(NASTY))] == [f"{k}:{i}" for k in range(len(NASTY))], name
        assert not rows
    ids = lambda n, df=both: sorted(r[0] for r in corpus_pipeline.STAGES[n][1](spark, df, sf_dir).select(F.coalesce("doc_id", F.lit(-1))).collect())
    assert -1 in ids(0) and 10**6 not in ids(0) and 10**6 + 1 not in ids(0)
    near = ids(2)
    assert near.count(10**6) == 1 and 10**6 + 1 not in near and near.count(10**6 + 2) == 1 and 10**6 + 3 not in near and -1 in near
    cut = {(r["doc_id"], r["text"]) for r in corpus_pipeline.STAGES[3][1](spark, both, sf_dir).where("doc_id >= 1000000").collect()}
    assert cut == {(10**6, None), (10**6 + 1, ""), (10**6 + 2, long), (10**6 + 3, "vor")}
    assert corpus_pipeline.STAGES[4][1](spark, both, sf_dir).where("doc_id >= 1000000").count() == 5 and corpus_pipeline.STAGES[4][1](spark, both.limit(0), sf_dir).count() == 0


def test_stages_one_by_one(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("score", F.lit("clash"))
    names, stages = docs.columns, corpus_pipeline.STAGES
    assert [n for n, _ in stages] == ["language ID", "quality classifier", "SimHash near-dedup", "substring dedup", "best-fit packing"]

    one = written(stages[0][1](spark, docs, sf_dir))
    pred = kept_by_dense_kernel(docs.collect())
    got = {r["doc_id"] for r in one.collect()}
    assert len(got ^ pred) <= 0.01 * len(pred) and one.columns == names
    pred = got

    two = written(stages[1][1](spark, one, sf_dir))
    good = {r["doc_id"] for r in quality.score(one, table(spark, sf_dir, "labels")).where("keep").collect()}
    assert {r["doc_id"] for r in two.collect()} == good and two.columns == names
    truth = {r["doc_id"]: r["quality"] for r in table(spark, sf_dir, "labels").collect()}
    assert all(i in good for i, q in truth.items() if q == 1 and i in pred)

    three = written(stages[2][1](spark, two, sf_dir))
    rows = sorted((r["doc_id"], r["text"]) for r in two.collect())
    want = {rows[k][0] for k in brute_jaccard([t for _, t in rows])}
    assert {r["doc_id"] for r in three.collect()} == want and three.columns == names

    four = written(stages[3][1](spark, three, sf_dir))
    rows = sorted((r["doc_id"], r["text"]) for r in three.collect())
    kept = {i: (k if g else t) for (i, t), (_, _, g, k) in zip(rows, brute_removed(rows))}
    assert {r["doc_id"]: r["text"] for r in four.collect()} == kept and four.columns == names

    five = stages[4][1](spark, four, sf_dir).toPandas()
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {i: np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4") for i, x in kept.items()}
    assert {(r.doc_id, r.piece): r.ids_crc32 for r in five.itertuples()} == {(i, k // 2048): zlib.crc32(v[k : k + 2048].tobytes()) for i, v in ids.items() for k in range(0, len(v), 2048)}


def test_run_equals_its_stages(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir).select("doc_id", "piece", "ids_crc32").collect()
    docs = table(spark, sf_dir, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    want = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).select("doc_id", "piece", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
