"""Buckets of many blocks: the same neighbours, and no candidates that cannot count."""

import numpy as np
import pyarrow as pa

from fotoquarry.llm import ann


def test_rank_keeps_nothing_below_the_kth_best():
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(3, 8)), rng.normal(size=(50, 8))
    a = pa.table({"id": [100, 101, 102], "vector": x.tolist(), "least": [-np.inf, 2.0, 1e9]})
    b = pa.table({"id": list(range(50)), "vector": y.tolist()})
    got = ann._rank(5, a, b).to_pylist()
    s = x @ y.T
    assert [r["vec_id"] for r in got if r["query_id"] == 100] == np.argsort(-s[0])[:5].tolist()
    assert [r["vec_id"] for r in got if r["query_id"] == 101] == [i for i in np.argsort(-s[1])[:5].tolist() if s[1][i] >= 2]
    assert not [r for r in got if r["query_id"] == 102]


def test_blocks_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(5, 16))
    rows = [(i, (centres[i % 5] + rng.normal(size=16) * 0.2).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    found = []
    for block in (8, 100_000):
        monkeypatch.setattr(ann, "BLOCK", block)
        found.append([tuple(r) for r in ann.nearest(df, df.where("id % 20 = 0"), 10).orderBy("query_id", "rank").collect()])
    assert found[0] == found[1] and len(found[0]) == 200
