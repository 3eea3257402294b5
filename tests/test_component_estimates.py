"""Rounds of joins must not multiply Spark's estimate of a table's size: its digits are held by the driver."""

import random

import pytest
from pyspark.sql import functions as F

from fotoquarry.llm import common
from fotoquarry.operators import graph


@pytest.mark.parametrize("build, names", [(common.components, ("a", "b")), (graph.components, ("x", "y"))])
def test_estimates_do_not_grow_with_the_rounds(spark, build, names):
    """Chains of 30 and 300 nodes in any order; 30 gave an estimate of some 25 000 digits, 300 did not end."""
    for n in (30, 300):
        ids = list(range(n))
        random.Random(n).shuffle(ids)
        got = build(spark.createDataFrame([(ids[k], ids[k + 1]) for k in range(n - 1)], f"{names[0]} long, {names[1]} long"))
        size = got._jdf.queryExecution().optimizedPlan().stats().simpleString()
        assert "E+" not in size or int(size.split("E+")[1].split(" ")[0]) < 100, size
        assert {r["node"]: r["root"] for r in got.where(F.col("node") > 0).collect()} == {k: 0 for k in range(1, n)}
