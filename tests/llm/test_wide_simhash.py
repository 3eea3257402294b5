"""The wide SimHash of the near-duplicate stage against plain definitions."""

import numpy as np
from pyspark.sql import functions as F

from fotoquarry.llm import dedup


def test_bits_are_majorities_and_near_sets_differ_little():
    rng = np.random.default_rng(3)
    own = rng.integers(0, 1 << 63, 5000, dtype=np.uint64)
    bits = lambda s: np.unpackbits(dedup.wide_simhash(s).view(np.uint8))
    apart = np.mean(bits(own) != bits(np.concatenate([own[:4500], rng.integers(0, 1 << 63, 500, dtype=np.uint64)])))
    # Nine tenths in common: a Jaccard similarity of 0.82 and a cosine of 0.9, so 14 % of the bits.
    assert 0.09 < apart < 0.20 and 0.4 < np.mean(bits(own) != bits(rng.integers(0, 1 << 63, 5000, dtype=np.uint64))) < 0.6
    keys = dedup.table_keys(np.stack([dedup.wide_simhash(own)] * 2), 11)
    assert keys.shape == (2, dedup.TABLES) and (keys[0] == keys[1]).all() and len(set(keys[0])) == dedup.TABLES and (keys[0] % (1 << 40) < 1 << 11).all()


def test_meetings_name_the_first_and_the_last_near_one():
    rng = np.random.default_rng(5)
    key = np.sort(rng.integers(0, 40, 300))
    f = rng.integers(0, 1 << 63, (4, 2), dtype=np.uint64)[rng.integers(0, 4, 300)]
    lo, hi = dedup.meetings(key, f[:, 0], f[:, 1])
    for j in range(300):
        mates = [i for i in range(300) if i != j and key[i] == key[j] and sum(int(x).bit_count() for x in f[i] ^ f[j]) <= dedup.APART]
        before = [i for i in mates if i < j]
        assert (lo[j], hi[j]) == ((before[0], before[-1]) if before else (-1, -1) if mates else (-2, -2))


def test_stage_gets_its_rows_through_the_tables(spark, monkeypatch):
    """Without the candidates of the tables nothing is linked but equal sets."""
    text = " ".join(f"w{k}" for k in range(300))
    df = spark.createDataFrame([(0, text), (1, text + " end"), (2, text)], "doc_id long, text string")
    ids = lambda: sorted(r["doc_id"] for r in dedup.keep_first_similar(df).select(F.col("doc_id")).collect())
    assert ids() == [0]
    monkeypatch.setattr(dedup, "_verified", lambda pairs, texts, width: pairs.limit(0))
    assert ids() == [0, 1]
