"""Tag suggestions from folders, and what the quick tagger repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .aggregates import folder_column, folder_tag_stats
from .ranking import ranked

MIN_SHARE, MIN_COUNT, PARENT_WEIGHT, NAME_SCORE = 0.2, 2, 0.5, 0.9


def _folder_offers(folders: DataFrame, photos: DataFrame, photo_tags: DataFrame, tags: DataFrame, aliases: DataFrame) -> DataFrame:
    """(folder, tag_id, score, reason) of each folder: its own tags, those of the folder above, and names in the last two parts; of equal scores the first of these counts."""
    stats = folder_tag_stats(photos, photo_tags).where((F.col("n") >= MIN_COUNT) & (F.col("n") / F.col("total") >= MIN_SHARE)).select(F.col("folder").alias("f"), "tag_id", (F.col("n") / F.col("total")).alias("share"), "n", "total")
    said = lambda where: F.concat(F.lit("La tienen "), F.col("n").cast("string"), F.lit(" de "), F.col("total").cast("string"), F.lit(f" fotos de {where}")).alias("reason")
    own = folders.join(stats, F.col("folder") == F.col("f")).select("folder", "tag_id", F.col("share").alias("score"), said("esta carpeta"), F.lit(0).alias("turn"))
    up = folders.withColumn("above", S.parent_folder(F.col("folder"))).where("above <> ''").join(stats, F.col("above") == F.col("f")).select("folder", "tag_id", (F.col("share") * PARENT_WEIGHT).alias("score"), said("la carpeta de arriba"), F.lit(1).alias("turn"))
    words = tags.select(F.col("id").alias("tag_id"), F.col("name").alias("word"), S.normal_text(F.col("name")).alias("w"), F.lit(0).alias("kind")).unionByName(aliases.select("tag_id", F.col("alias").alias("word"), S.normal_text(F.col("alias")).alias("w"), F.lit(1).alias("kind"))).where("w <> ''")
    parts = F.filter(F.slice(F.split(F.regexp_replace("folder", r"\\+$", ""), r"\\"), F.lit(2), F.length("folder")), lambda x: x != "")
    last = F.transform(F.slice(parts, F.greatest(F.lit(1), F.size(parts) - 1), F.lit(2)), lambda x: F.concat(F.lit(" "), S.normal_text(x), F.lit(" ")))
    # Names by their word runs, so that tags meet folders by equality.
    named = folders.select("folder", F.explode(last).alias("part")).withColumn("ws", F.split(F.trim("part"), " "))
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.size("ws")), lambda i: F.transform(F.sequence(i, F.size("ws")), lambda j: F.array_join(F.slice("ws", i, j - i + 1), " "))))
    hits = named.select("folder", F.explode(F.array_distinct(runs)).alias("w")).join(words, "w").groupBy("folder", "tag_id").agg(F.min_by("word", F.struct("kind", "word")).alias("word"))
    hits = hits.select("folder", "tag_id", F.lit(NAME_SCORE).alias("score"), F.concat(F.lit("«"), F.col("word"), F.lit("» aparece en el nombre de la carpeta")).alias("reason"), F.lit(2).alias("turn"))
    return own.unionByName(up).unionByName(hits).groupBy("folder", "tag_id").agg(F.max("score").alias("score"), F.max_by("reason", F.struct("score", -F.col("turn"))).alias("reason"))


def folder_suggestions(photos: DataFrame, photo_tags: DataFrame, tags: DataFrame, aliases: DataFrame, most: int = 6) -> DataFrame:
    """(photo_id, tag_id, score, reason): the best suggestions for every photo; none that it has, none that is hidden.

    Offers are put in order once a folder; a photo takes the first that it has not.
    """
    shown = tags.where("NOT hidden")
    where = folder_column(photos)
    offers = _folder_offers(photos.select(where.alias("folder")).distinct(), photos, photo_tags, shown, aliases)
    offers = offers.join(shown.select(F.col("id").alias("tag_id"), "name"), "tag_id")
    ordered = offers.groupBy("folder").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "name", "tag_id", "reason"))).alias("offers"))  # at most the tags there are
    own = photo_tags.groupBy("photo_id").agg(F.collect_set("tag_id").alias("own"))
    p = photos.select(F.col("id").alias("photo_id"), where.alias("folder")).join(ordered, "folder").join(own, "photo_id", "left")
    open_ = F.filter("offers", lambda o: ~F.coalesce(F.array_contains(F.col("own"), o["tag_id"]), F.lit(False)))
    return p.select("photo_id", F.explode(F.slice(open_, 1, most)).alias("o")).select("photo_id", "o.tag_id", F.round(-F.col("o.s"), 3).alias("score"), "o.reason")


def selection_suggestions(chosen: DataFrame, photos: DataFrame, photo_tags: DataFrame, tags: DataFrame, aliases: DataFrame, most: int = 6) -> DataFrame:
    """(tag_id, name, score, reason): the best suggestions for a selection of photos; none that all of them have."""
    from .aggregates import common_tags

    shown = tags.where("NOT hidden")
    offers = _folder_offers(chosen.select(S.folder_of(F.col("path")).alias("folder")).distinct(), photos, photo_tags, shown, aliases)
    best = offers.groupBy("tag_id").agg(F.max("score").alias("score"), F.max_by("reason", F.struct("score", F.col("folder"))).alias("reason")).join(common_tags(chosen, photo_tags), "tag_id", "left_anti")
    named = best.join(shown.select(F.col("id").alias("tag_id"), "name"), "tag_id")
    return named.orderBy(F.desc("score"), "name").limit(most).select("tag_id", "name", F.round("score", 3).alias("score"), "reason")


def repeat_previous(photos: DataFrame, photo_tags: DataFrame) -> DataFrame:
    """(id, add): the tags of the photo before, in the folder's order, that the photo has not.

    Photos are numbered in one order of all folders, and meet the one before by its number, so
    that a folder of very many photos is no single task.
    """
    own = photo_tags.groupBy("photo_id").agg(F.array_sort(F.collect_list("tag_id")).alias("own"))
    rows = ranked(photos.select("id", "filename", folder_column(photos).alias("folder")), [F.col("folder"), F.col("filename"), F.col("id")])
    p = rows.join(own, F.col("id") == F.col("photo_id"), "left").select("id", "folder", "rank", F.coalesce("own", F.array().cast("array<int>")).alias("own"))
    before = p.select((F.col("rank") + 1).alias("rank"), F.col("folder").alias("folder2"), F.col("own").alias("before"))
    return p.join(before, "rank").where("folder = folder2").select("id", F.array_join(F.array_except("before", "own"), ",").alias("add"))
