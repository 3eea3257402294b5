"""The tag tree: closure, paths, checks and changes that keep it consistent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tags of which the tree is kept by the driver; larger tables are an error there, not a cut.
MOST_TAGS = 1_000_000


def parents(tags: DataFrame) -> DataFrame:
    return tags.where("parent_id IS NOT NULL").select("id", "parent_id")


class Tree:
    """The children of every tag, read once: a bounded table that gallery queries expand their tags with."""

    def __init__(self, rows) -> None:
        self.children: dict[int, list[int]] = {}
        self.ids = {i for i, _ in rows}
        for i, p in rows:
            if p is not None:
                self.children.setdefault(p, []).append(i)

    def expanded(self, ids) -> dict[int, list[int]]:
        """The listed tags that exist, each with itself and its descendants at any depth; safe on cycles."""
        out = {}
        for top in dict.fromkeys(ids):
            if top in self.ids:
                seen, new = {top}, [top]
                while new:
                    new = [c for t in new for c in self.children.get(t, ()) if c not in seen]
                    seen.update(new)
                out[top] = sorted(seen)
        return out


def tree(tags: DataFrame) -> Tree:
    """The tree of a tag table; read once for each DataFrame."""
    known = getattr(tags, "_tag_tree", None)
    if known is None:
        rows = tags.select("id", "parent_id").limit(MOST_TAGS + 1).collect()
        if len(rows) > MOST_TAGS:
            raise ValueError(f"over {MOST_TAGS} tags")
        known = Tree([(r["id"], r["parent_id"]) for r in rows])
        tags._tag_tree = known
    return known


def descendants(tags: DataFrame) -> DataFrame:
    """(ancestor, tag, depth) without the tag itself; depth is the shortest way, cycles are followed once.

    Ways of up to 1, 2, 4, … levels are joined until no pair is new, so that trees of any depth are whole.
    """
    from ..plans.session import durable

    least = lambda df: df.groupBy("ancestor", "tag").agg(F.min("depth").alias("depth"))
    known = durable(least(tags.where("parent_id IS NOT NULL AND parent_id <> id").select(F.col("parent_id").alias("ancestor"), F.col("id").alias("tag"), F.lit(1).alias("depth"))))
    size = known.agg(F.count(F.lit(1)), F.sum("depth")).first()
    while True:
        below = known.select(F.col("ancestor").alias("via"), F.col("tag").alias("to"), F.col("depth").alias("more"))
        longer = known.join(below, F.col("tag") == F.col("via")).where("ancestor <> to").select("ancestor", F.col("to").alias("tag"), (F.col("depth") + F.col("more")).alias("depth"))
        known = durable(least(known.unionByName(longer)))
        now = known.agg(F.count(F.lit(1)), F.sum("depth")).first()
        if now == size:
            return known
        size = now


def with_self(tags: DataFrame) -> DataFrame:
    """(ancestor, tag): every tag also under itself."""
    return descendants(tags).select("ancestor", "tag").unionByName(tags.select(F.col("id").alias("ancestor"), F.col("id").alias("tag")))


def expand(tags: DataFrame, ids: list[int]) -> DataFrame:
    """(grp, tag): the listed tags that exist, each with itself and its descendants."""
    rows = [(g, t) for g, below in tree(tags).expanded(ids).items() for t in below]
    return tags.sparkSession.createDataFrame(rows, "grp int, tag int")


def tag_paths(tags: DataFrame) -> DataFrame:
    """(id, depth, path): names from the root down; orphans are roots."""
    up = descendants(tags).join(tags.select(F.col("id").alias("a"), F.col("name").alias("above")), F.col("ancestor") == F.col("a"))
    above = up.groupBy("tag").agg(F.array_sort(F.collect_list(F.struct((-F.col("depth")).alias("d"), "above"))).alias("up"))
    joined = tags.select("id", "name").join(above, F.col("id") == F.col("tag"), "left")
    names = F.concat(F.coalesce(F.transform("up", lambda x: x["above"]), F.array().cast("array<string>")), F.array("name"))
    return joined.select("id", (F.size(names) - 1).alias("depth"), names.alias("names"), F.array_join(names, " › ").alias("path"))


def tree_order(tags: DataFrame) -> DataFrame:
    """(id, depth, path) in reading order: parents before their children, siblings by name."""
    return tag_paths(tags).orderBy(F.transform("names", F.lower)).select("id", "depth", "path")


def search_text(tags: DataFrame, aliases: DataFrame) -> DataFrame:
    """(id, text): names on the path and aliases, lower case."""
    own = aliases.groupBy("tag_id").agg(F.array_sort(F.collect_list("alias")).alias("al"))
    return tag_paths(tags).join(own, F.col("id") == F.col("tag_id"), "left").select(
        "id", F.lower(F.concat_ws(" ", F.array_join("names", " "), F.array_join("al", " "))).alias("text")
    )


def reparent_check(tags: DataFrame, proposed: DataFrame) -> DataFrame:
    """(tag, parent, allowed) of each proposed (tag, parent): a tag goes under neither itself nor its descendants."""
    below = descendants(tags).select(F.col("ancestor").alias("x"), F.col("tag").alias("y"))
    joined = proposed.join(below, (F.col("tag") == F.col("x")) & (F.col("parent") == F.col("y")), "left")
    return joined.select("tag", "parent", (F.col("x").isNull() & (F.col("tag") != F.col("parent"))).alias("allowed"))


def resolve_names(wanted: DataFrame, tags: DataFrame, aliases: DataFrame) -> DataFrame:
    """(name, tag_id) of each wanted name: a tag's own name first, then an alias; null if neither."""
    known = tags.select(F.lower(F.trim("name")).alias("n"), F.lit(0).alias("rank"), F.col("id").alias("t"))
    known = known.unionByName(aliases.select(F.lower(F.trim("alias")).alias("n"), F.lit(1).alias("rank"), F.col("tag_id").alias("t")))
    best = known.groupBy("n").agg(F.min_by("t", F.struct("rank", "t")).alias("tag_id"))
    return wanted.join(best, F.lower(F.trim("name")) == F.col("n"), "left").select("name", "tag_id")


def name_conflicts(tags: DataFrame, aliases: DataFrame) -> DataFrame:
    """(name, n): names that tags and aliases use more than once."""
    every = tags.select(F.lower(F.trim("name")).alias("name")).unionByName(aliases.select(F.lower(F.trim("alias")).alias("name")))
    return every.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def merge_tags(tags: DataFrame, photo_tags: DataFrame, aliases: DataFrame, source: int, target: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tags, photo_tags, aliases) after ``source`` has gone into ``target``.

    Photos, children and aliases move; the old name becomes an alias. A target below the
    source takes the source's parent, so that no cycle arises.
    """
    gone = tags.where(F.col("id") == source)
    below = descendants(tags).where((F.col("ancestor") == source) & (F.col("tag") == target)).select(F.col("tag").alias("below"))
    above = gone.select(F.col("parent_id").alias("above"), F.lit(target).alias("at"))
    moved = tags.where(F.col("id") != source).join(below, F.col("id") == F.col("below"), "left").join(above, F.col("id") == F.col("at"), "left")
    parent = F.when(F.col("below").isNotNull(), F.col("above")).when((F.col("parent_id") == source) & (F.col("id") != target), F.lit(target)).otherwise(F.when(F.col("parent_id") != source, F.col("parent_id")))
    new_tags = moved.select(*[c for c in tags.columns if c != "parent_id"], parent.cast("int").alias("parent_id"))
    to = lambda c: F.when(F.col(c) == source, F.lit(target)).otherwise(F.col(c)).alias(c)
    new_pairs = photo_tags.select("photo_id", to("tag_id")).distinct()
    new_aliases = aliases.select("alias", to("tag_id")).unionByName(gone.select(F.col("name").alias("alias"), F.lit(target).alias("tag_id"))).distinct()
    return new_tags, new_pairs, new_aliases


def merge_in_queries(saved: DataFrame, source: int, target: int) -> DataFrame:
    """Saved queries (name, tag_ids) with the merged tag replaced; an id stays once."""
    return saved.withColumn("tag_ids", F.array_distinct(F.transform("tag_ids", lambda t: F.when(t == source, F.lit(target)).otherwise(t))))


def delete_tag(tags: DataFrame, photo_tags: DataFrame, tag: int) -> tuple[DataFrame, DataFrame]:
    """(tags, photo_tags) without the tag; its children become roots."""
    left = tags.where(F.col("id") != tag).withColumn("parent_id", F.when(F.col("parent_id") != tag, F.col("parent_id")))
    return left, photo_tags.where(F.col("tag_id") != tag)


def create_category(categories: DataFrame, name: str) -> DataFrame:
    """categories (name) with one more, unless it is there in any letter case."""
    one = categories.sparkSession.createDataFrame([(name,)], "name string")
    new = one.join(categories.select(F.lower("name").alias("_k")), F.lower("name") == F.col("_k"), "left_anti")
    return categories.select("name").unionByName(new)


def rename_category(tags: DataFrame, categories: DataFrame, old: str, new: str) -> tuple[DataFrame, DataFrame]:
    """(tags, categories) after a category got a new name, trimmed and in lower case; an empty or the same name changes nothing."""
    new = new.strip().lower()
    if not new or new == old:
        return tags, categories
    return delete_category(tags, categories, old, new)


def delete_category(tags: DataFrame, categories: DataFrame, name: str, move_to: str = "general") -> tuple[DataFrame, DataFrame]:
    """(tags, categories) without the category; its tags go to another one, which is made if need be."""
    moved = tags.withColumn("category", F.when(F.col("category") == name, F.lit(move_to)).otherwise(F.col("category")))
    return moved, create_category(categories, move_to).where(F.lower("name") != name.lower())
