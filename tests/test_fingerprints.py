"""Perceptual fingerprints, components and leader groups against brute force."""

import random
import time
from collections import Counter

import numpy as np
import pytest

from fotoquarry.operators import duplicates, graph, perceptual


def slow_fingerprint(grey):
    """The definition, coefficient by coefficient."""
    x = np.array(grey, float).reshape(32, 32)
    if x.std() < 4.0:
        return 0
    low = [sum(x[b, a] * np.cos(np.pi * (2 * b + 1) * v / 64) * np.cos(np.pi * (2 * a + 1) * u / 64) for a in range(32) for b in range(32)) for v in range(8) for u in range(8)]
    low = np.round(low, 6)
    value = int("".join("1" if c > np.median(low[1:]) else "0" for c in low), 2)
    return (value - (1 << 64) if value >= 1 << 63 else value) or 1


def test_fingerprint_of_pictures(spark):
    rng = np.random.default_rng(3)
    pictures = [(rng.integers(0, 256, 1024)).astype(float).tolist() for _ in range(4)]
    pictures += [(128 + 0.5 * rng.normal(size=1024)).tolist(), [7.0] * 1024, np.tile(np.arange(32.0) * 8, 32).tolist(), [255.0 * (k % 2) for k in range(1024)]]
    data = list(enumerate(pictures)) + [(20, None), (21, []), (22, [1.0] * 1023), (23, [None] + [1.0] * 1023), (24, [float("nan")] * 1024), (None, pictures[0]), (1, pictures[1])]
    got = perceptual.perceptual_hashes(spark.createDataFrame(data, "id long, grey array<double>")).collect()
    want = [(i, slow_fingerprint(g) if g and len(g) == 1024 and None not in g and g[0] == g[0] else None) for i, g in data]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    # A brighter copy, or one with a little noise, is near; another picture is not.
    near = perceptual.fingerprints(np.array([pictures[0], np.array(pictures[0]) * 0.8 + 10, np.array(pictures[0]) + rng.normal(size=1024), pictures[1]]))
    assert [bin(int(a) & (1 << 64) - 1 ^ int(near[0]) & (1 << 64) - 1).count("1") <= 6 for a in near] == [True, True, True, False]


def test_worklist_and_setting(spark):
    photos = spark.createDataFrame([(1, None, False), (2, None, True), (3, 5, False)], "id long, phash long, hidden boolean")
    assert [r["id"] for r in perceptual.needs_fingerprint(photos).collect()] == [1]
    assert {r["id"] for r in perceptual.needs_fingerprint(photos, True).collect()} == {1, 2}
    new = spark.createDataFrame([(1, 9), (1, 8), (3, None), (4, 1), (2, 0)], "id long, h long")
    assert sorted(map(tuple, perceptual.with_fingerprints(photos, new).select("id", "phash").collect())) == [(1, 8), (2, 0), (3, 5)]


def test_components(spark):
    rng = random.Random(7)
    edges = [(a, a + 1) for a in range(1000, 1700)] + [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(5, 5), (9000, 8000), (8000, 9000)]
    root = {n: n for e in edges for n in e if e[0] != e[1]}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        if a != b:
            x, y = sorted((top(a), top(b)))
            root[y] = x
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "x long, y long")).collect()}
    assert got == {n: top(n) for n in root}
    assert graph.components(spark.createDataFrame([], "x long, y long")).count() == 0


def sequential(items, distance):
    centres, lead = [], {}
    for i, h in sorted(items):
        near = [c for c, g in centres if (h ^ g).bit_count() <= distance]
        lead[i] = near[0] if near else i
        if not near:
            centres.append((i, h))
    many = Counter(lead.values())
    return {(i, c) for i, c in lead.items() if many[c] > 1}


@pytest.mark.parametrize("bound", [500_000, 30])
def test_leaders_of_chains(spark, monkeypatch, bound):
    """Neighbours in a Gray code differ by one bit: long chains in id order, decided in one task or, over the bound, in rounds."""
    monkeypatch.setattr(graph, "IN_ONE_TASK", bound)
    rng = random.Random(2)
    items = [(i, (i ^ i >> 1) | 1 << 50) for i in range(150)] + [(1000 + i, rng.getrandbits(62) | 1) for i in range(50)]
    items += [(2000 + i, h ^ 1 << rng.randrange(40)) for i, (_, h) in enumerate(items[150:])] + [(3000, 0), (3001, items[160][1])]
    got = duplicates.leader_groups(spark.createDataFrame(items, "id long, h long"), 1)
    assert {tuple(r) for r in got.collect()} == sequential([x for x in items if x[1]], 1)


def test_long_chain_in_time(spark):
    items = [(i, (i ^ i >> 1) | 1 << 50) for i in range(10_000)]
    began = time.time()
    got = duplicates.leader_groups(spark.createDataFrame(items, "id long, h long"), 1)
    assert {tuple(r) for r in got.limit(10_001).collect()} and time.time() - began < 60
