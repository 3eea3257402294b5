"""Near-dedup over groups of texts that are alike but not linked: no pair of texts a row, and every link."""

import numpy as np
from pyspark.sql import functions as F

from fotoquarry.llm import dedup


def _sets(rng, n, changed):
    base = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    return [np.unique(np.concatenate([rng.permutation(base)[c:], rng.integers(0, 1 << 63, c, dtype=np.uint64)])) for c in rng.integers(*changed, n)]


def _roots(n, pairs):
    root = list(range(n))
    for a, b in pairs:
        x, y = root[a], root[b]
        root = [min(x, y) if r in (x, y) else r for r in root]
    return root


def _brute(sets):
    alike = lambda x, y: 5 * len(x & y) >= 4 * len(x | y)
    own = [set(s.tolist() if hasattr(s, "tolist") else s) for s in sets]
    return [(a, b) for a in range(len(own)) for b in range(a) if alike(own[a], own[b])]


def test_bridging_joins_what_all_pairs_join():
    rng = np.random.default_rng(7)
    for changed in ((8, 30), (60, 90), (1, 9)):
        sets = _sets(rng, 60, changed) + [rng.integers(0, 1 << 63, 50, dtype=np.uint64)]
        comps = [k // 2 * 2 for k in range(len(sets))]
        own = [(k, comps[k], np.unique(s)) for k, s in enumerate(sets)]
        found = dedup.bridging(own, own)
        given = [(k, comps[k]) for k in range(len(sets))]
        links = _brute(sets)
        assert _roots(len(sets), given + found) == _roots(len(sets), given + links) and set(map(tuple, map(sorted, found))) <= set(map(tuple, map(sorted, links)))
        assert len(found) < len(set(comps))


def test_groups_are_reached_over_near_ones():
    rng = np.random.default_rng(5)
    key = np.sort(rng.integers(0, 20, 300))
    f = rng.integers(0, 1 << 63, (6, 2), dtype=np.uint64)[rng.integers(0, 6, 300)]
    f[:, 0] ^= rng.integers(0, 1 << 24, 300, dtype=np.uint64)
    f[:, 1] ^= rng.integers(0, 1 << 50, 300, dtype=np.uint64)
    near = [(i, j) for j in range(300) for i in range(j) if key[i] == key[j] and sum(int(x).bit_count() for x in f[i] ^ f[j]) <= dedup.APART]
    assert 50 < len(near) and dedup.gathered(key, f[:, 0], f[:, 1])[2].tolist() == _roots(300, near)


def test_texts_that_are_alike_but_not_linked_give_no_row_a_pair(spark, monkeypatch):
    """Each text has eight words of its own in 150, so that few of a group are linked; blocks are made small."""
    rng = np.random.default_rng(11)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for i in range(120):
        words = list(base)
        for k in rng.choice(150, rng.integers(2, 9), replace=False):
            words[k] = f"own{i}x{k}"
        rows.append((i, " ".join(words)))
    sets = [set(dedup.shingle_hashes(t.encode(), 5).tolist()) for _, t in rows]
    links = _brute(sets)
    want = _roots(120, links)
    assert 20 < len(set(want)) < 120
    asked, plain = [], dedup._verified

    def counted(pairs, texts, width):
        asked.append(pairs.count())
        return plain(pairs, texts, width)

    monkeypatch.setattr(dedup, "_verified", counted)
    for size in ({}, {"BLOCK_BYTES": 20_000, "BLOCK_TEXTS": 25}):
        for name, value in size.items():
            monkeypatch.setattr(dedup, name, value)
        asked.clear()
        got = dedup.similar_components(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").select(F.col("component_id")).collect()
        assert [r[0] for r in got] == want and sum(asked) <= 4 * 120
