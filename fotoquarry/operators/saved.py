"""Saved gallery queries as rows: any number of them counted over all photos by joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .gallery import with_hidden
from .hierarchy import with_self

QUERY = """tag_ids array<int>, match_any boolean, exclude_tag_ids array<int>, search string, media_type string, year_from int, year_to int, min_megapixels double, orientation string, min_duration double, max_duration double,
  min_rating int, favorites_only boolean, untagged_only boolean, with_note boolean, folder string, not_rejected_for int, rejected_for int"""
#: Parts that the photos of a key are dealt into, so that a key of very many photos is no single task.
PARTS = 16


def parsed(saved: DataFrame, tags: DataFrame) -> DataFrame:
    """(name, q, groups, none) of saved queries (name, query as JSON).

    ``groups``: sets of tags of each of which a photo must have one; ``none``: tags it must not
    have. Tags are taken with their descendants, ids that do not exist are ignored. Unknown keys
    are dropped, missing ones are no condition; of rows that repeat a name the first by text counts.
    """
    rows = saved.where("name IS NOT NULL").groupBy("name").agg(F.min("query").alias("query")).select("name", F.from_json("query", QUERY).alias("q"))
    grown = with_self(tags).groupBy("ancestor").agg(F.collect_set(F.col("tag").cast("int")).alias("below"))

    def sets(field: str) -> DataFrame:
        own = rows.select("name", F.explode(F.array_distinct(F.col(f"q.{field}"))).alias("t"))
        return own.join(grown, F.col("t") == F.col("ancestor")).groupBy("name").agg(F.collect_list("below").alias(field))

    with_groups = rows.join(sets("tag_ids"), "name", "left").join(sets("exclude_tag_ids"), "name", "left")
    none = F.array_distinct(F.flatten(F.coalesce("exclude_tag_ids", F.array().cast("array<array<int>>"))))
    groups = F.coalesce("tag_ids", F.array().cast("array<array<int>>"))
    either = F.when(F.size(groups) == 0, groups).otherwise(F.array(F.array_distinct(F.flatten(groups))))
    return with_groups.select("name", "q", F.when(F.coalesce(F.col("q.match_any"), F.lit(False)), either).otherwise(groups).alias("groups"), none.alias("none"))


def _keyed(queries: DataFrame, photos: DataFrame, photo_tags: DataFrame, rejections: DataFrame) -> DataFrame:
    """The queries with the keys of their rarest condition: kind, key and, for tags, the group the keys are of.

    How many photos a condition leaves is counted from the data: those of a group's tags together,
    of the years of a range, of a rejected tag; a query without any of these meets all photos.
    """
    q = queries
    per_tag = photo_tags.groupBy(F.col("tag_id").alias("t")).agg(F.count(F.lit(1)).alias("n"))
    per_no = rejections.groupBy(F.col("tag_id").alias("t")).agg(F.count(F.lit(1)).alias("n"))
    per_year = photos.where("year IS NOT NULL").groupBy(F.col("year").alias("t")).agg(F.count(F.lit(1)).alias("n"))
    ends = per_year.agg(F.min("t").alias("_first"), F.max("t").alias("_last"))  # one row
    conditions = F.transform("groups", lambda g: F.struct(F.lit("tag").alias("kind"), g.alias("keys")))
    years = F.sequence(F.greatest("q.year_from", "_first"), F.least("q.year_to", "_last"))
    dated = F.when(F.coalesce("q.year_from", "q.year_to").isNotNull() & (F.greatest("q.year_from", "_first") <= F.least("q.year_to", "_last")), F.struct(F.lit("year").alias("kind"), years.alias("keys")))
    # A range without a year of the photos matches none of them.
    nothing = F.when(F.greatest("q.year_from", "_first") > F.least("q.year_to", "_last"), F.struct(F.lit("year").alias("kind"), F.array().cast("array<int>").alias("keys")))
    no = F.when(F.col("q.rejected_for").isNotNull(), F.struct(F.lit("rejected").alias("kind"), F.array("q.rejected_for").alias("keys")))
    offers = q.join(F.broadcast(ends)).select("name", F.explode(F.concat(conditions, F.array_compact(F.array(dated, nothing, no)))).alias("c")).select("name", "c.kind", "c.keys")
    counted = per_tag.withColumn("kind", F.lit("tag")).unionByName(per_no.withColumn("kind", F.lit("rejected"))).unionByName(per_year.withColumn("kind", F.lit("year")))
    counted = counted.select(F.col("kind").alias("_k"), "t", "n")
    priced = offers.select("name", "kind", "keys", F.explode_outer("keys").alias("key")).join(counted, (F.col("kind") == F.col("_k")) & (F.col("key") == F.col("t")), "left")
    cost = priced.groupBy("name", "kind", "keys").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("cost"))
    best = cost.groupBy("name").agg(F.min_by(F.struct("kind", "keys"), F.struct("cost", "kind", "keys")).alias("c"))
    every = F.struct(F.lit("all").alias("kind"), F.array(F.lit(0)).alias("keys"))
    return q.join(best, "name", "left").withColumn("c", F.coalesce("c", every)).select(*q.columns, F.col("c.kind").alias("kind"), F.col("c.keys").alias("keys"), F.explode("c.keys").alias("key"))


def _holds() -> Column:
    """Whether a photo passes all conditions of a query; nulls of a photo pass no condition on them."""
    q = lambda n: F.col(f"q.{n}")
    unset = lambda n: F.coalesce(q(n), F.lit("")) == ""
    flag = lambda n: F.coalesce(q(n), F.lit(False))
    pixels = (F.coalesce(q("min_megapixels"), F.lit(0.0)) * 1_000_000).cast("bigint")
    shape = F.when(q("orientation") == "landscape", S.has_shape(F.col("width"), F.col("height"), "landscape"))
    for name in ("portrait", "square"):
        shape = shape.when(q("orientation") == name, S.has_shape(F.col("width"), F.col("height"), name))
    folder = F.lower(F.regexp_replace(F.replace(q("folder"), F.lit("/"), F.lit("\\")), r"\\+$", ""))
    pattern = "concat('%', replace(q.search, chr(92), concat(chr(92), chr(92))), '%')"
    found = F.expr(f"filename ILIKE {pattern} OR coalesce(note ILIKE {pattern}, false)")
    timed = q("min_duration").isNotNull() | q("max_duration").isNotNull()
    conditions = [
        unset("search") | found, unset("media_type") | (F.col("media_type") == q("media_type")), q("year_from").isNull() | (F.col("year") >= q("year_from")), q("year_to").isNull() | (F.col("year") <= q("year_to")),
        (pixels == 0) | (S.pixels(F.col("width"), F.col("height")) >= pixels), unset("orientation") | shape.otherwise(F.lit(True)), ~timed | (F.col("media_type") == "video"), q("min_duration").isNull() | (F.col("duration") >= q("min_duration")),
        q("max_duration").isNull() | (F.col("duration") < q("max_duration")), (F.coalesce(q("min_rating"), F.lit(0)) == 0) | (F.col("rating") >= q("min_rating")), ~flag("favorites_only") | F.col("favorite"),
        ~flag("with_note") | (F.col("note") != ""), unset("folder") | F.startswith(F.lower("path"), F.concat(folder, F.lit("\\"))), ~flag("untagged_only") | (F.size("own") == 0),
        q("rejected_for").isNull() | F.array_contains("no", q("rejected_for")), q("not_rejected_for").isNull() | ~F.array_contains("no", q("not_rejected_for")),
        F.forall("groups", lambda g: F.arrays_overlap(F.col("own"), g)), ~F.arrays_overlap("own", "none"),
    ]
    return S.all_of([F.coalesce(c, F.lit(False)) for c in conditions])


def count_saved(catalog, saved: DataFrame, show_hidden: bool = False, parts: int = PARTS) -> DataFrame:
    """(name, n) of saved queries (name, query as JSON, see ``parsed``); those that match nothing count 0.

    Photos and queries meet by the keys of each query's rarest condition, so the plan and the work
    do not grow with queries times photos but with what the rarest conditions leave. A photo that
    has several tags of a group counts at the smallest of them.
    """
    queries = parsed(saved, catalog.tags)
    own = catalog.photo_tags.groupBy("photo_id").agg(F.collect_set("tag_id").alias("own")).withColumnRenamed("photo_id", "_t")
    no = catalog.tag_rejections.groupBy("photo_id").agg(F.collect_set("tag_id").alias("no")).withColumnRenamed("photo_id", "_n")
    photos = with_hidden(catalog.photos, catalog.tags, catalog.photo_tags)
    if not show_hidden:
        photos = photos.where("NOT hidden")
    empty = F.array().cast("array<int>")
    p = photos.join(own, F.col("id") == F.col("_t"), "left").join(no, F.col("id") == F.col("_n"), "left").withColumns({"own": F.coalesce("own", empty), "no": F.coalesce("no", empty)})
    key = lambda kind, k: F.struct(F.lit(kind).alias("kind"), k.cast("int").alias("key"))
    keys = F.concat(F.transform("own", lambda t: key("tag", t)), F.transform("no", lambda t: key("rejected", t)), F.array(key("all", F.lit(0))), F.when(F.col("year").isNotNull(), F.array(key("year", F.col("year")))).otherwise(F.array().cast("array<struct<kind:string,key:int>>")))
    used = ["id", "path", "filename", "note", "media_type", "year", "width", "height", "duration", "rating", "favorite", "own", "no"]
    postings = p.select(*used, F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"), F.explode(keys).alias("_k")).select(*used, "part", F.col("_k.kind").alias("pk"), F.col("_k.key").alias("pkey"))
    asked = _keyed(queries, photos, catalog.photo_tags, catalog.tag_rejections).withColumn("qpart", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    met = postings.join(asked, (F.col("pk") == F.col("kind")) & (F.col("pkey") == F.col("key")) & (F.col("part") == F.col("qpart")))
    once = (F.col("kind") != "tag") | (F.array_min(F.array_intersect("own", "keys")) == F.col("key"))
    n = met.where(once & _holds()).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    return queries.select("name").join(n, "name", "left").select("name", F.coalesce("n", F.lit(0)).alias("n"))
