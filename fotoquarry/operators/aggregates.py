"""Counts, histograms, trees and summaries of the catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S


def timeline(photos: DataFrame) -> DataFrame:
    """(year, month, n), newest first, undated last."""
    return photos.groupBy("year", "month").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc_nulls_last("year"), F.desc_nulls_last("month"))


def timeline_with_years(photos: DataFrame) -> DataFrame:
    """(year, month, level, n): level 0 a month, 1 a year, 3 all; so that a null year is no subtotal."""
    return photos.rollup("year", "month").agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n"))


def folder_column(photos: DataFrame) -> Column:
    """The stored folder, or else that of the path."""
    return F.col("folder") if "folder" in photos.columns else S.folder_of(F.col("path"))


def folder_counts(photos: DataFrame) -> DataFrame:
    return photos.groupBy(folder_column(photos).alias("folder")).agg(F.count(F.lit(1)).alias("n"))


def root_counts(photos: DataFrame) -> DataFrame:
    """(root, n): folders are counted first, so that roots are cut from few paths."""
    return folder_counts(photos).groupBy(S.root_of(F.col("folder")).alias("root")).agg(F.sum("n").alias("n"))


def ancestor_folders(folder: Column) -> Column:
    """The folder and all folders above it, from its root on; a server with its share is one root."""
    root = S.root_of(folder)
    rest = F.substring(folder, F.length(root) + 1, F.length(folder))
    parts = F.filter(F.split(rest, r"\\"), lambda x: x != "")
    below = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda k: F.concat(root, F.array_join(F.slice(parts, F.lit(1), k), "\\"), F.lit("\\")))
    return F.when(F.size(parts) > 0, F.concat(F.array(root), below)).otherwise(F.array(root))


def folder_tree(photos: DataFrame) -> DataFrame:
    """(folder, own, total): photos in each folder and, with all below, of every folder above them."""
    counts = folder_counts(photos)
    up = counts.select("folder", "n", F.explode(ancestor_folders(F.col("folder"))).alias("above"))
    return up.groupBy(F.col("above").alias("folder")).agg(F.sum(F.when(F.col("above") == F.col("folder"), F.col("n")).otherwise(0)).alias("own"), F.sum("n").alias("total"))


def stats(photos: DataFrame) -> DataFrame:
    """(kind, year, month, media_type, n) in one pass: by year, by month, by type, and all."""
    p = photos.select("year", "month", F.coalesce("media_type", F.lit("image")).alias("media_type"))
    sets = p.groupingSets([[F.col("year")], [F.col("year"), F.col("month")], [F.col("media_type")], []], "year", "month", "media_type").agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"))
    kind = F.when(F.col("g") == 3, "year").when(F.col("g") == 1, "month").when(F.col("g") == 6, "type").otherwise("all")
    return sets.select(kind.alias("kind"), "year", "month", "media_type", "n")


def tag_counts(photo_tags: DataFrame) -> DataFrame:
    return photo_tags.groupBy("tag_id").agg(F.count(F.lit(1)).alias("n"))


def top_tags(photo_tags: DataFrame, tags: DataFrame, most: int = 10) -> DataFrame:
    named = tag_counts(photo_tags).join(tags, F.col("tag_id") == F.col("id"))
    return named.orderBy(F.desc("n"), "name").limit(most).select("name", "n")


def count_tagged(photos: DataFrame, photo_tags: DataFrame) -> DataFrame:
    """(n): how many of the photos have any tag."""
    return photo_tags.join(photos.select(F.col("id").alias("photo_id")), "photo_id", "left_semi").agg(F.count_distinct("photo_id").alias("n"))


def common_tags(photos: DataFrame, photo_tags: DataFrame) -> DataFrame:
    """(tag_id): tags that all of the photos have."""
    own = photos.select(F.col("id").alias("photo_id")).distinct()
    total = own.agg(F.count(F.lit(1)).alias("total"))
    counts = photo_tags.join(own, "photo_id", "left_semi").groupBy("tag_id").agg(F.count_distinct("photo_id").alias("n"))
    return counts.join(F.broadcast(total), F.col("n") == F.col("total")).select("tag_id")  # one row is broadcast


def folder_tag_stats(photos: DataFrame, photo_tags: DataFrame) -> DataFrame:
    """(folder, tag_id, n, total)."""
    f = photos.select(F.col("id").alias("photo_id"), folder_column(photos).alias("folder"))
    totals = f.groupBy("folder").agg(F.count(F.lit(1)).alias("total"))
    return f.join(photo_tags, "photo_id").groupBy("folder", "tag_id").agg(F.count(F.lit(1)).alias("n")).join(totals, "folder")


def trash_batches(trash: DataFrame) -> DataFrame:
    """(batch_id, reason, deleted_at, n, tagged), one row a batch."""
    return trash.groupBy("batch_id", "reason").agg(F.min("deleted_at").alias("deleted_at"), F.count(F.lit(1)).alias("n"), F.count_if("tagged").alias("tagged"))


def review_stats(photos: DataFrame, tag_photos: DataFrame, rejected: DataFrame) -> DataFrame:
    """(total, tagged, rejected, pending) in one pass; a rejection counts while the photo has not the tag.

    ``tag_photos`` and ``rejected`` are (photo_id) frames; descendants of the tag are the caller's choice.
    """
    t, r = tag_photos.select(F.col("photo_id").alias("_t")).distinct(), rejected.select(F.col("photo_id").alias("_r")).distinct()
    p = photos.join(t, F.col("id") == F.col("_t"), "left").join(r, F.col("id") == F.col("_r"), "left")
    tagged, no = F.col("_t").isNotNull(), F.col("_r").isNotNull() & F.col("_t").isNull()
    sums = p.agg(F.count(F.lit(1)).alias("total"), F.count_if(tagged).alias("tagged"), F.count_if(no).alias("rejected"))
    return sums.withColumn("pending", F.greatest(F.lit(0), F.col("total") - F.col("tagged") - F.col("rejected")))


def favourite_toggle(photos: DataFrame) -> DataFrame:
    """(n, favourites, set_to): all become favourites unless all are."""
    return photos.agg(F.count(F.lit(1)).alias("n"), F.count_if("favorite").alias("favourites")).withColumn("set_to", F.col("favourites") < F.col("n"))


#: From so many files on, a root whose files are all missing is more likely another disk.
SUSPICIOUS = 20


def missing_by_root(photos: DataFrame, present: DataFrame, reachable: DataFrame) -> DataFrame:
    """(root, total, missing, verdict): ``present`` has the paths on disk, ``reachable`` the roots that answer."""
    here = present.select(F.col("path").alias("_p")).distinct()
    p = photos.select("id", "path", S.root_of(F.col("path")).alias("root")).join(here, F.col("path") == F.col("_p"), "left")
    sums = p.groupBy("root").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("_p").isNull()).alias("missing"))
    up = reachable.select(F.col("root").alias("_r")).distinct()
    verdict = F.when(F.col("_r").isNull(), "unavailable").when((F.col("missing") == F.col("total")) & (F.col("total") >= SUSPICIOUS), "all missing").otherwise("report")
    return sums.join(up, F.col("root") == F.col("_r"), "left").select("root", "total", "missing", verdict.alias("verdict"))


def missing_ids(photos: DataFrame, present: DataFrame, reachable: DataFrame) -> DataFrame:
    """(id) of missing photos below roots that can be trusted."""
    good = missing_by_root(photos, present, reachable).where("verdict = 'report'").select(F.col("root").alias("_g"))
    gone = photos.join(present.select("path").distinct(), "path", "left_anti").withColumn("_root", S.root_of(F.col("path")))
    return gone.join(good, F.col("_root") == F.col("_g"), "left_semi").select("id")


def facets(photos: DataFrame) -> DataFrame:
    """(facet, n): counts of the preset buckets in one pass."""
    mp, video = S.pixels(F.col("width"), F.col("height")), F.col("media_type") == "video"
    cases = {f"resolution >= {m} MP": mp >= m * 1_000_000 for m in (2, 8, 12, 24)}
    cases |= {"video < 30 s": video & (F.col("duration") < 30), "video 30 s - 5 min": video & (F.col("duration") >= 30) & (F.col("duration") < 300), "video >= 5 min": video & (F.col("duration") >= 300)}
    cases |= {f"rating >= {k}": F.col("rating") >= k for k in range(1, 6)}
    out = F.array(*[F.struct(F.lit(k).alias("facet"), F.count_if(c).alias("n")) for k, c in cases.items()])
    return photos.agg(out.alias("a")).select(F.explode("a").alias("x")).select("x.facet", "x.n")


def tag_flags(tags: DataFrame) -> DataFrame:
    return tags.agg(F.count_if("hidden").alias("hidden"), F.count_if("sidebar_hidden").alias("sidebar_hidden"), F.count_if(F.col("hidden") | F.col("sidebar_hidden")).alias("either"))


def tags_by_category(tags: DataFrame) -> DataFrame:
    return tags.groupBy("category").agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("names"))
