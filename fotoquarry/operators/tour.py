"""The tag tree as numbers: an Euler tour by list ranking, so that what lies below a tag is a range."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.session import durable
from .graph import components
from .ranking import ranked


def euler_tour(tags: DataFrame) -> DataFrame:
    """(id, entry, exit, depth, cycle) of every tag (id, name, parent_id).

    A walk through the tree enters and leaves each tag once, siblings by name, then id; ``entry``
    and ``exit`` are the steps at which it does, from 0. A tag is below another if its entry lies
    between the other's entry and exit. Tags without a parent in the table are roots. The steps
    are a linked list; it is ranked by doubling its links, so a tree of n tags takes about log 2n
    joins however deep it is, and nothing is collected. Tags on a cycle or below one are never
    reached from a root: they have no numbers, and ``cycle`` is the smallest id they are linked with.
    Ids are unique and not null.
    """
    known = tags.select(F.col("id").cast("long").alias("id"), F.lower("name").alias("name"), F.col("parent_id").cast("long").alias("parent"))
    there = known.select(F.col("id").alias("_p"))
    own = known.join(there, F.col("parent") == F.col("_p"), "left").select("id", "name", F.col("_p").alias("parent"))
    placed = durable(ranked(own, [F.col("parent").asc_nulls_first(), F.col("name"), F.col("id")]).select("id", "parent", "rank"))
    after = placed.select((F.col("rank") - 1).alias("_r"), F.col("id").alias("_next"), F.col("parent").alias("_np"))
    sibling = placed.join(after, (F.col("rank") == F.col("_r")) & F.col("parent").eqNullSafe(F.col("_np")), "left").select("id", "parent", "_next")
    child = placed.where("parent IS NOT NULL").groupBy(F.col("parent").alias("_up")).agg(F.min_by("id", "rank").alias("_child"))
    links = sibling.join(child, F.col("id") == F.col("_up"), "left")
    # The step into a tag has twice its id, the step out of it one more.
    down, up = (lambda c: F.col(c) * 2), (lambda c: F.col(c) * 2 + 1)
    step = F.explode(
        F.array(
            F.struct(down("id").alias("e"), F.coalesce(down("_child"), up("id")).alias("to"), F.lit(1).cast("long").alias("level")),
            F.struct(up("id").alias("e"), F.coalesce(down("_next"), up("parent")).alias("to"), F.lit(-1).cast("long").alias("level")),
        )
    )
    steps = durable(links.select(step.alias("s")).select("s.e", "s.to", F.lit(1).cast("long").alias("left"), "s.level"))
    for _ in range(math.ceil(math.log2(max(2, steps.count()))) + 1):
        ahead = steps.select(F.col("e").alias("_e"), F.col("to").alias("_to"), F.col("left").alias("_left"), F.col("level").alias("_level"))
        # left and level: steps and levels from here up to the step that ``to`` names, that one not counted.
        on = steps.join(ahead, F.col("to") == F.col("_e"), "left")
        steps = durable(on.select("e", F.col("_to").alias("to"), (F.col("left") + F.coalesce("_left", F.lit(0))).alias("left"), (F.col("level") + F.coalesce("_level", F.lit(0))).alias("level")))
    ended = steps.where("to IS NULL")
    total = ended.agg(F.max("left").alias("_total"))  # one row
    at = ended.join(F.broadcast(total)).select("e", (F.col("_total") - F.col("left")).alias("at"), (-F.col("level")).alias("depth"))
    into, out = at.where("e % 2 = 0"), at.where("pmod(e, 2) = 1").select(((F.col("e") - 1) / 2).cast("long").alias("_o"), F.col("at").alias("exit"))
    walked = into.select((F.col("e") / 2).cast("long").alias("_i"), F.col("at").alias("entry"), "depth").join(out, F.col("_i") == F.col("_o"))
    lost = durable(placed.select("id", "parent").join(walked.select("_i"), F.col("id") == F.col("_i"), "left_anti"))
    roots = components(lost.select(F.col("id").alias("x"), F.col("parent").alias("y")))
    named = placed.select("id").join(walked.drop("_o"), F.col("id") == F.col("_i"), "left").drop("_i")
    # A tag that is its own parent is a cycle by itself.
    alone = lost.select(F.col("id").alias("_l")).join(roots, F.col("_l") == F.col("node"), "left").select("_l", F.coalesce("root", "_l").alias("cycle"))
    return named.join(alone, F.col("id") == F.col("_l"), "left").select("id", "entry", "exit", "depth", "cycle")


def below(tour: DataFrame, tops: DataFrame) -> DataFrame:
    """(ancestor, tag) of every given tag (id) with itself and what lies below it, by the ranges of the tour.

    The tour is cut into blocks of steps. A range takes whole blocks by their number and compares
    single steps only in the block it begins and the one it ends in, so a large subtree is dealt out.
    """
    size = 1024
    own = tour.where("entry IS NOT NULL").select(F.col("id").alias("tag"), "entry", F.floor(F.col("entry") / size).alias("_b"))
    ends = tour.join(tops.select(F.col("id").cast("long").alias("_t")).distinct(), F.col("id") == F.col("_t")).where("entry IS NOT NULL")
    blocks = F.explode(F.sequence(F.floor(F.col("entry") / size), F.floor(F.col("exit") / size))).alias("_a")
    wanted = ends.select(F.col("id").alias("ancestor"), F.col("entry").alias("_from"), F.col("exit").alias("_until"), blocks)
    return own.join(wanted, F.col("_b") == F.col("_a")).where("entry BETWEEN _from AND _until").select("ancestor", "tag")
