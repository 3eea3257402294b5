"""Connected components by contraction, and first come, first served among linked ids."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.session import durable, durable_afresh


def _jumped(up: DataFrame) -> DataFrame:
    """(node, root) from (node, up): pointers are doubled until all end at a root, which points at nothing."""
    while True:
        over = up.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        up = durable_afresh(up.join(over, F.col("root") == F.col("_n"), "left").select("node", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("_moved")))
        if not up.where("_moved").limit(1).count():
            return up.select("node", "root")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (x, y): root is the smallest node that can be reached.

    Every node points at its smallest smaller neighbour; doubling the pointers gives trees, whose
    roots are the nodes of the next, contracted graph. Depth goes down by doubling and the number
    of roots by half at least in each round, so a chain of n nodes takes about log n joins.
    """
    live = durable_afresh(edges.where("x <> y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct())
    nodes = live.select(F.col("x").alias("node")).unionByName(live.select(F.col("y").alias("node"))).distinct()
    found = durable_afresh(nodes.select("node", F.col("node").alias("root")))
    while live.limit(1).count():
        tree = _jumped(durable_afresh(live.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("root"))))
        to = tree.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        found = durable_afresh(found.join(to, F.col("root") == F.col("_n"), "left").select("node", F.coalesce("_r", "root").alias("root")))
        ends = live.join(to, F.col("x") == F.col("_n"), "left").select(F.coalesce("_r", "x").alias("x"), "y")
        ends = ends.join(to, F.col("y") == F.col("_n"), "left").select("x", F.coalesce("_r", "y").alias("y"))
        live = durable_afresh(ends.where("x <> y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct())
    return found


#: Rounds over all undecided ids before components are told apart, and between two such tests.
ROUNDS = 3
#: Links of a component that one task decides by the sequential rule; larger ones go on in rounds.
IN_ONE_TASK = 500_000


def _round(both: DataFrame, open_ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(links between undecided ids, newly chosen ids, ids that are still undecided)."""
    live = both.join(open_ids.select(F.col("id").alias("x")), "x", "left_semi").join(open_ids.select(F.col("id").alias("y")), "y", "left_semi")
    waits = live.where("y < x").select(F.col("x").alias("id")).distinct()
    new = durable(open_ids.join(waits, "id", "left_anti"))
    covered = live.join(new.select(F.col("id").alias("y")), "y", "left_semi").select(F.col("x").alias("id"))
    left = durable(open_ids.join(new.unionByName(covered).distinct(), "id", "left_anti"))
    rest = left.select(F.col("id").alias("_l"))
    return durable(live.join(rest, F.col("x") == F.col("_l"), "left_semi").join(rest, F.col("y") == F.col("_l"), "left_semi")), new, left


def _sequential(links: pa.Table) -> pa.Table:
    """The chosen ids of a component: in order, each unless a smaller neighbour is chosen."""
    x, y = links.column("x").to_numpy(), links.column("y").to_numpy()
    ids, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    fx, fy = at[: len(x)], at[len(x) :]
    back = fy < fx
    order = np.argsort(fx[back], kind="stable")
    first, near = np.searchsorted(fx[back][order], np.arange(len(ids) + 1)), fy[back][order]
    centre = np.zeros(len(ids), bool)
    for k in range(len(ids)):
        centre[k] = not centre[near[first[k] : first[k + 1]]].any()
    return pa.table({"id": pa.array(ids[centre], pa.int64())})


def both_ways(pairs: DataFrame) -> DataFrame:
    """(x, y) and (y, x) of each pair (a, b)."""
    return pairs.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(pairs.select(F.col("b").alias("x"), F.col("a").alias("y")))


def first_come(both: DataFrame) -> DataFrame:
    """(id): of the ids of the links (x, y; each both ways) those that are chosen: in id order, each unless a smaller neighbour is.

    In a round, an undecided id with no smaller undecided neighbour is chosen and its neighbours
    are not; that decides most ids at once. Links that are left after some rounds are long chains:
    their components are told apart, and each of up to ``IN_ONE_TASK`` links is decided in one
    task. Larger components go on in rounds, which take their ids away, until none is left.
    """
    open_ids = durable(both.select(F.col("x").alias("id")).distinct())
    live, chosen, n = both, open_ids.limit(0), 0
    while open_ids.limit(1).count():
        live, new, open_ids = _round(live, open_ids)
        chosen, n = durable(chosen.unionByName(new)), n + 1
        if n % ROUNDS == 0 and live.limit(1).count():
            linked = live.join(components(live), F.col("x") == F.col("node")).select("root", "x", "y")
            small = linked.groupBy("root").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") <= IN_ONE_TASK).select("root")
            whole = durable(linked.join(small, "root", "left_semi"))
            chosen = durable(chosen.unionByName(whole.groupBy("root").applyInArrow(_sequential, "id long")))
            open_ids = durable(open_ids.join(whole.select(F.col("x").alias("id")).distinct(), "id", "left_anti"))
    return chosen
