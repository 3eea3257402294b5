"""Hashes that meet in blocks: pairs and leaders against brute force, whatever is cut."""

import random

import pytest
from test_fingerprints import sequential

from fotoquarry.operators import duplicates


def clustered(n, seed=5):
    """Hashes around a few centres, so that keys are hot; some ids share a hash."""
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(4)]
    items = []
    for i in range(n):
        h = rng.choice(centres)
        for _ in range(rng.randrange(12)):
            h ^= 1 << rng.randrange(64)
        items.append((i * 3 + 1, h - (1 << 64) if h >> 63 else h))
    return items + [(10_000 + i, items[i][1]) for i in range(5)] + [(20_000, 0), (20_001, None)]


def unsigned(h):
    return h & (1 << 64) - 1


@pytest.mark.parametrize("distance, block, at_once", [(8, 8192, 1 << 17), (8, 16, 40), (3, 16, 1), (0, 8192, 64), (1, 7, 64)])
def test_meeting(spark, monkeypatch, distance, block, at_once):
    monkeypatch.setattr(duplicates, "HASH_BLOCK", block)
    monkeypatch.setattr(duplicates, "AT_ONCE", at_once)
    items = clustered(150)
    first = {}
    for i, h in items:
        if h:
            first[h] = min(i, first.get(h, i))
    want = sorted((min(first[g], first[h]), max(first[g], first[h]), (unsigned(g) ^ unsigned(h)).bit_count()) for g in first for h in first if g < h and (unsigned(g) ^ unsigned(h)).bit_count() <= distance)
    assert sorted(map(tuple, duplicates._meeting(spark.createDataFrame(items, "id long, h long"), distance).collect())) == want


@pytest.mark.parametrize("block, stretch", [(8192, 40), (16, 25), (8192, 1000)])
def test_leaders_by_stretches(spark, monkeypatch, block, stretch):
    monkeypatch.setattr(duplicates, "HASH_BLOCK", block)
    monkeypatch.setattr(duplicates, "STRETCH", stretch)
    items = clustered(150)
    got = duplicates.leader_groups(spark.createDataFrame(items, "id long, h long"), 8)
    want = sequential([(i, unsigned(h)) for i, h in items if h], 8)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_no_row_a_comparison(spark):
    """Hashes are compared in arrays: no join makes a row for each two that share a band."""
    df = spark.createDataFrame(clustered(20), "id long, h long")
    plan = duplicates._meeting(df, 8)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "bit_count" not in plan
