"""The tour of the tag tree against a plain walk and the closure."""

import random

import pytest

from fotoquarry.operators import hierarchy, tour
from fotoquarry.sources.catalog import Catalog


def walk(rows):
    """{id: (entry, exit, depth)} of what a walk from the roots reaches."""
    ids, children, out = {i for i, *_ in rows}, {}, {}
    for i, name, p in rows:
        children.setdefault(p if p in ids else None, []).append((name.lower(), i))
    stack, at = [(i, 0, False) for _, i in sorted(children.get(None, []), reverse=True)], 0
    while stack:
        i, depth, left = stack.pop()
        out[i] = (out[i][0], at, depth) if left else (at, None, depth)
        if not left:
            stack.append((i, depth, True))
            stack += [(c, depth + 1, False) for _, c in sorted(children.get(i, []), reverse=True)]
        at += 1
    return out


def rows_of(kind):
    rng = random.Random(kind)
    if kind == "chain":
        return [(i, f"n{i}", i - 1 if i > 1 else None) for i in range(1, 600)]
    if kind == "star":
        return [(0, "top", None)] + [(i, f"N{rng.randrange(40)}", 0) for i in range(1, 3000)]
    if kind == "forest":
        return [(i, f"t{rng.randrange(99)}", rng.choice([None, 5000, *range(max(0, i - 9), i)]) if i else None) for i in range(400)]
    # Two cycles, a tag that is its own parent, and tags below a cycle, beside a tree.
    return [(1, "a", None), (2, "b", 1), (3, "c", 1), (10, "x", 12), (11, "y", 10), (12, "z", 11), (13, "below", 12), (20, "p", 21), (21, "q", 20), (30, "self", 30), (31, "under", 30)]


@pytest.mark.parametrize("kind", ["chain", "star", "forest", "cycles"])
def test_tour_equals_a_walk(spark, kind):
    rows = rows_of(kind)
    got = {r["id"]: r for r in tour.euler_tour(spark.createDataFrame(rows, "id int, name string, parent_id int")).collect()}
    want = walk(rows)
    assert len(got) == len(rows)
    assert {i: (r["entry"], r["exit"], r["depth"]) for i, r in got.items() if r["cycle"] is None} == want
    lost = {i: r["cycle"] for i, r in got.items() if r["cycle"] is not None}
    assert lost == ({10: 10, 11: 10, 12: 10, 13: 10, 20: 20, 21: 20, 30: 30, 31: 30} if kind == "cycles" else {})


def test_ranges_equal_the_closure(spark, sf_dir):
    tags = Catalog(spark, sf_dir).tags
    walked = tour.euler_tour(tags)
    assert {tuple(r) for r in tour.below(walked, tags).collect()} == {tuple(r) for r in hierarchy.with_self(tags).collect()}
    long = spark.createDataFrame(rows_of("chain"), "id int, name string, parent_id int")
    assert tour.below(tour.euler_tour(long), long.where("id IN (1, 300)")).count() == 599 + 300
    assert tour.euler_tour(tags.limit(0)).count() == 0
