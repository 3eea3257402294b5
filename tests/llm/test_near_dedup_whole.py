"""Near-dedup finds every pair of 0.8 or more, also those that the tables of the wide SimHash miss."""

import numpy as np
from pyspark.sql import functions as F

from fotoquarry.llm import dedup


def test_rarest_fifths_meet_and_may_be_similar():
    rng = np.random.default_rng(17)
    counts = rng.integers(0, 9, dedup.COUNTERS).astype("<u2")
    for size in (*range(4, 40), 200, 1001):
        own = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2))
        most = size // 9 * 2 + 2
        gone, new = (rng.integers(0, most + 1) for _ in range(2))
        other = np.unique(np.concatenate([rng.permutation(own)[gone:], rng.integers(0, 1 << 63, new, dtype=np.uint64)]))
        common = len(np.intersect1d(own, other))
        if 5 * common < 4 * (len(own) + len(other) - common):
            own, other = own, own[: size - size // 5]  # a similarity of 0.8, or just above
        x, y = (dedup.rare_first(s, counts) for s in (own, other))
        key = next(k for k in x if k in y)
        assert not np.isin(x[: list(x).index(key)], other).any()
        place = np.array([(len(s) << 32) + list(f).index(key) for s, f in ((own, x), (other, y))], np.uint64)
        odd = np.array([dedup.parities(s) for s in (own, other)], np.uint64)
        assert int(odd[0] ^ odd[1]).bit_count() <= len(np.setxor1d(own, other))
        assert dedup.may_be_similar(place, odd)(np.array([0]), np.array([1])).all()


def test_every_pair_of_short_texts_is_found(spark):
    """Sets of four and of five shingles: of 1000 pairs at 0.8 the tables alone miss some."""
    rows = []
    for k in range(1000):
        words = [f"p{k}w{j}" for j in range(9)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[:8]))]
    got = dedup.keep_first_similar(spark.createDataFrame(rows, "doc_id long, text string")).select(F.col("doc_id")).collect()
    assert sorted(r[0] for r in got) == list(range(0, 2000, 2))


def test_components_equal_all_pairs(spark):
    rng = np.random.default_rng(23)
    rows = []
    for k in range(60):
        words = [f"v{x}" for x in rng.integers(0, 400, rng.integers(6, 60))]
        for _ in range(4):
            own = list(words)
            for at in rng.choice(len(own), rng.integers(0, 3), replace=False):
                own[at] = f"v{rng.integers(0, 400)}"
            rows.append((len(rows), " ".join(own[: len(own) - rng.integers(0, 3)])))
    rows += [(900, None), (901, ""), (902, "one two"), (903, "ONE two"), (904, "one two three")]
    sets = [set(dedup.shingle_hashes((t or "").encode(), 5).tolist()) for _, t in rows]
    root = {i: i for i, _ in rows}
    for a, (i, _) in enumerate(rows):
        for b, (j, _) in enumerate(rows[:a]):
            if root[i] != root[j] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((root[i], root[j]))
                root = {k: x if r == y else r for k, r in root.items()}
    got = dedup.similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == root and len(set(root.values())) < len(rows) - 30
