"""Changes of the catalogue as functions from tables to tables; callers write a new snapshot."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from functools import cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..plans.session import durable
from .graph import both_ways, first_come
from .hierarchy import descendants, resolve_names
from .ranking import ranked


class Parts(Mapping):
    """Tables by name; each is made when it is first asked for, so that nobody waits for what is not read."""

    def __init__(self, **make: Callable[[], DataFrame]) -> None:
        self.make = {name: cache(own) for name, own in make.items()}

    def __getitem__(self, name: str) -> DataFrame:
        return self.make[name]()

    def __iter__(self) -> Iterator[str]:
        return iter(self.make)

    def __len__(self) -> int:
        return len(self.make)


def merge_rating(a: Column, b: Column) -> Column:
    return F.greatest(F.coalesce(a, F.lit(0)), F.coalesce(b, F.lit(0)))


def merge_favorite(a: Column, b: Column) -> Column:
    return F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False))


def merge_note(a: Column, b: Column) -> Column:
    """The first unless it is empty."""
    return F.when(a.isNotNull() & (a != ""), a).otherwise(b)


def index_diff(scan: DataFrame, photos: DataFrame, max_year: int, force: bool = False) -> DataFrame:
    """(path, action) of every scanned file: added, read, mtime_only or unchanged.

    A file is read again if its size or time changed or its year cannot be; a file of the same
    size whose time was never noted only has the time noted.
    """
    old = photos.select(F.col("path").alias("_p"), F.col("filesize").alias("_s"), F.col("mtime").alias("_m"), F.col("year").alias("_y"))
    j = scan.join(old, F.col("path") == F.col("_p"), "left")
    implausible = F.coalesce(F.col("_y") > max_year, F.lit(False)) | F.lit(force)
    action = (
        F.when(F.col("_p").isNull(), "added")
        .when(implausible, "read")
        .when((F.col("_s") == F.col("size")) & (F.col("_m") == F.col("mtime")), "unchanged")
        .when(F.col("_m").isNull() & (F.col("_s") == F.col("size")), "mtime_only")
        .otherwise("read")
    )
    return j.select("path", action.alias("action"))


def ingest_counts(diff: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """(result, n): added, updated, unchanged, and errors for the files to read that are among ``failed`` (path)."""
    if failed is not None:
        bad = failed.select(F.col("path").alias("_f")).distinct()
        diff = diff.join(bad, F.col("path") == F.col("_f"), "left").withColumn("action", F.when(F.col("_f").isNotNull() & F.col("action").isin("added", "read"), "errors").otherwise(F.col("action")))
    kind = F.when(F.col("action").isin("unchanged", "mtime_only"), "unchanged").when(F.col("action") == "read", "updated").otherwise(F.col("action"))
    return diff.groupBy(kind.alias("result")).agg(F.count(F.lit(1)).alias("n"))


def upsert(photos: DataFrame, records: DataFrame) -> DataFrame:
    """photos after ``records`` (path, filename, media_type, year, month, filesize, width, height, duration, mtime).

    A path keeps its id, rating, favourite and note; its digest stays only if size and time say
    that the file is the same. New paths get ids after the largest.
    """
    new = records.select(*[F.col(c).alias(f"n_{c}") for c in ("path", "filename", "media_type", "year", "month", "filesize", "width", "height", "duration", "mtime")])
    fresh = new.join(photos.select(F.col("path").alias("_p")), F.col("n_path") == F.col("_p"), "left_anti")
    fresh = numbered_after(fresh, photos, ["n_path"]).select(
        "id", *[F.col(f"n_{c}").alias(c) for c in ("path", "filename", "media_type", "year", "month", "filesize", "width", "height", "duration", "mtime")],
        F.lit(None).cast("string").alias("md5"), F.lit(0).alias("rating"), F.lit(False).alias("favorite"), F.lit(None).cast("string").alias("note"),
    )
    j = photos.join(new, F.col("path") == F.col("n_path"), "left")
    there = F.col("n_path").isNotNull()
    same = F.col("filesize").eqNullSafe(F.col("n_filesize")) & (F.col("mtime").isNull() | F.coalesce(F.col("mtime") == F.col("n_mtime"), F.lit(False)))
    pick = lambda c: F.when(there, F.col(f"n_{c}")).otherwise(F.col(c)).alias(c)
    kept = j.select(
        "id", "path", *[pick(c) for c in ("filename", "media_type", "year", "month", "filesize", "width", "height", "duration", "mtime")],
        F.when(~there | same, F.col("md5")).alias("md5"), "rating", "favorite", "note",
    )
    return kept.unionByName(fresh)


#: What a trash entry keeps of a photo; its time and fingerprint are made anew after a restore.
TRASH_FIELDS = ("path", "filename", "media_type", "year", "month", "filesize", "width", "height", "duration", "md5", "added_at", "rating", "favorite", "note")


def delete_to_trash(photos: DataFrame, photo_tags: DataFrame, tags: DataFrame, gone: DataFrame, batch: str, reason: str, at: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(photos, photo_tags, trash) after the photos with the ids in ``gone`` (id) went into one batch."""
    ids = gone.select(F.col("id").alias("_g")).distinct()
    out = photos.join(ids, F.col("id") == F.col("_g"), "left_semi")
    named = photo_tags.join(tags.select(F.col("id").alias("tag_id"), "name", "category", "color"), "tag_id").groupBy("photo_id").agg(F.array_sort(F.collect_list(F.struct("name", "category", "color"))).alias("tags"))
    empty = F.array().cast("array<struct<name:string,category:string,color:string>>")
    trash = out.join(named, F.col("id") == F.col("photo_id"), "left").select(
        F.lit(batch).alias("batch_id"), F.lit(reason).alias("reason"), at.alias("deleted_at"), "path", F.struct(*TRASH_FIELDS).alias("photo"), F.coalesce("tags", empty).alias("tags")
    )
    left = photos.join(ids, F.col("id") == F.col("_g"), "left_anti")
    return left, photo_tags.join(ids, F.col("photo_id") == F.col("_g"), "left_anti"), trash


def restore_batch(photos: DataFrame, trash: DataFrame, batch: str) -> DataFrame:
    """(path, action, rating, favorite, note) of each entry: restored as it was, or merged into a photo that has the path again."""
    e = trash.where(F.col("batch_id") == batch).select("path", "photo")
    p = photos.select(F.col("path").alias("_p"), F.col("rating").alias("_r"), F.col("favorite").alias("_f"), F.col("note").alias("_n"))
    j = e.join(p, F.col("path") == F.col("_p"), "left")
    there = F.col("_p").isNotNull()
    return j.select(
        "path", F.when(there, "merged").otherwise("restored").alias("action"), merge_rating(F.col("_r"), F.col("photo.rating")).alias("rating"),
        merge_favorite(F.col("_f"), F.col("photo.favorite")).alias("favorite"), F.when(there, merge_note(F.col("_n"), F.col("photo.note"))).otherwise(F.col("photo.note")).alias("note"),
    )


def restored_tags(trash: DataFrame, tags: DataFrame, batch: str) -> tuple[DataFrame, DataFrame]:
    """((path, name) pairs to add, tags to create again) of a batch."""
    pairs = trash.where(F.col("batch_id") == batch).select("path", F.explode("tags").alias("t")).select("path", "t.name", "t.category", "t.color")
    known = tags.select(F.lower("name").alias("_n"))
    lost = pairs.join(known, F.lower("name") == F.col("_n"), "left_anti").groupBy("name").agg(F.min("category").alias("category"), F.min("color").alias("color"))
    return pairs.select("path", "name").distinct(), lost


def restore(photos: DataFrame, photo_tags: DataFrame, tags: DataFrame, categories: DataFrame, trash: DataFrame, batch: str) -> Mapping[str, DataFrame]:
    """The catalogue after a batch came back: photos, photo_tags, tags, categories, trash, and counts (restored, merged).

    A photo whose path is free comes back with a new id and all that its entry kept; where the
    path is in the catalogue again, that photo takes the higher rating, a favourite, a note if it
    has none, and the entry's tags. Tags that are gone are made again, and their categories. Of
    several entries of one path the first by its fields comes back and the others merge into it.
    """
    entries = durable(trash.where(F.col("batch_id") == batch).select("path", "photo", "tags"))
    by = entries.groupBy("path").agg(F.min("photo").alias("photo"), F.max("photo.rating").alias("_r"), F.bool_or("photo.favorite").alias("_f"), F.min(F.nullif("photo.note", F.lit(""))).alias("_n"), F.count(F.lit(1)).alias("_many"))
    j = photos.join(by.withColumnRenamed("path", "_p"), F.col("path") == F.col("_p"), "left")
    merged = {"rating": F.when(F.col("_p").isNotNull(), merge_rating(F.col("rating"), F.col("_r"))).otherwise(F.col("rating")), "favorite": merge_favorite(F.col("favorite"), F.col("_f")), "note": F.when(F.col("_p").isNotNull(), merge_note(F.col("note"), F.col("_n"))).otherwise(F.col("note"))}
    there = j.select(*[merged.get(c, F.col(c)).alias(c) for c in photos.columns])
    gone = by.join(photos.select(F.col("path").alias("_p")), F.col("path") == F.col("_p"), "left_anti")
    new = lambda: numbered_after(gone.select(F.col("path").alias("_key"), *[F.col("photo")[c].alias(c) for c in TRASH_FIELDS if c not in ("rating", "favorite", "note")], merge_rating(F.col("photo.rating"), F.col("_r")).alias("rating"), F.coalesce("_f", F.lit(False)).alias("favorite"), merge_note(F.col("photo.note"), F.col("_n")).alias("note")), photos, ["_key"]).drop("_key")
    after = cache(lambda: durable(there.unionByName(new(), allowMissingColumns=True)))
    pairs, lost = restored_tags(trash, tags, batch)
    made = lost.select(F.col("name"), F.coalesce("category", F.lit("general")).alias("category"), F.coalesce("color", F.lit(DEFAULT_COLOR)).alias("color"))
    tags2 = cache(lambda: durable(tags.unionByName(numbered_after(made, tags, ["name"]).withColumns({c: F.lit(False) for c in ("hidden", "sidebar_hidden") if c in tags.columns}), allowMissingColumns=True)))
    cats = categories.select("name").unionByName(made.select(F.col("category").alias("name")).distinct().join(categories.select(F.lower("name").alias("_k")), F.lower("name") == F.col("_k"), "left_anti"))
    named = lambda: pairs.join(tags2().select(F.col("id").alias("tag_id"), F.lower("name").alias("_n")), F.lower("name") == F.col("_n")).join(after().select(F.col("id").alias("photo_id"), "path"), "path").select("photo_id", "tag_id")
    n = by.join(photos.select(F.col("path").alias("_p")).distinct(), F.col("path") == F.col("_p"), "left").agg(F.count_if(F.col("_p").isNull()).alias("restored"), (F.sum("_many") - F.count_if(F.col("_p").isNull())).alias("merged"))
    return Parts(photos=after, photo_tags=lambda: photo_tags.select("photo_id", "tag_id").unionByName(named()).distinct(), tags=tags2, categories=lambda: cats, trash=lambda: delete_batch(trash, batch), counts=lambda: n)


#: Fixed value: the colour of a tag that is made without one.
DEFAULT_COLOR = "#4A9EFF"


def numbered_after(new: DataFrame, old: DataFrame, order: list[str]) -> DataFrame:
    """``new`` with ids after the largest of ``old``, in the order of the given columns, which have no ties."""
    top = old.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))  # one row
    kind = old.schema["id"].dataType
    return ranked(new, [F.col(c) for c in order], ("_rank", "_total")).join(F.broadcast(top)).withColumn("id", (F.col("_top") + F.col("_rank") + 1).cast(kind)).drop("_top", "_rank", "_total")


def delete_batch(trash: DataFrame, batch: str) -> DataFrame:
    """What stays in the trash without one batch."""
    return trash.where(~F.col("batch_id").eqNullSafe(F.lit(batch)))


def purge(trash: DataFrame, as_of: Column, days: int | None = None) -> DataFrame:
    """What stays after entries older than so many days went; all go without a number."""
    return trash.where(F.lit(False)) if days is None else trash.where(F.col("deleted_at") >= as_of - F.make_dt_interval(F.lit(days)))


def relocation(photos: DataFrame, old: str, new: str) -> DataFrame:
    """(id, new_path, existing) of every photo in the old folder; ``existing`` is the photo that has the new path already."""
    if not old.strip() or not new.strip() or S.normal_folder(old.strip()).lower() == S.normal_folder(new.strip()).lower():
        raise ValueError("an old and another new folder are needed")
    moved = photos.where(S.inside(F.col("path"), old)).select("id", S.rewrite_prefix(F.col("path"), old, new).alias("new_path"))
    return moved.join(photos.select(F.col("id").alias("existing"), F.col("path").alias("_p")), F.col("new_path") == F.col("_p"), "left").select("id", "new_path", "existing")


def relocation_preview(plan: DataFrame, present: DataFrame, sample: int = 25) -> DataFrame:
    """(n, conflicts, checked, found, looks_right): of an evenly spaced sample in id order, at least half must be there."""
    n = plan.agg(F.count(F.lit(1)).alias("n"), F.count("existing").alias("conflicts"))
    numbered = evenly_spaced(plan, sample)
    hits = numbered.join(present.select("path").distinct(), F.col("new_path") == F.col("path"), "left").agg(F.count(F.lit(1)).alias("checked"), F.count("path").alias("found"))
    return n.join(F.broadcast(hits)).withColumn("looks_right", F.col("found") * 2 >= F.col("checked"))


def evenly_spaced(plan: DataFrame, sample: int = 25) -> DataFrame:
    """Every (n div sample)-th row by id, ``sample`` at most."""
    rows = ranked(plan, [F.col("id")], ("_k", "_n"))
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / sample)).cast("long")
    return rows.where((F.col("_k") % step == 0) & (F.col("_k") / step < sample)).select(*plan.columns)


def apply_relocation(photos: DataFrame, photo_tags: DataFrame, plan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(photos, photo_tags) after the plan: rows move, or give tags and extras to the photo that has the path."""
    x = plan.select(F.col("id").alias("_i"), "new_path", "existing")
    given = photos.join(x.where("existing IS NOT NULL"), F.col("id") == F.col("_i")).groupBy("existing").agg(
        F.max("rating").alias("_r"), F.bool_or("favorite").alias("_f"), F.min_by("note", "id").alias("_n")
    ).withColumnRenamed("existing", "_e")
    j = photos.join(x, F.col("id") == F.col("_i"), "left").where("existing IS NULL").join(given, F.col("id") == F.col("_e"), "left")
    moved = j.withColumn("path", F.coalesce("new_path", "path")).withColumn("filename", F.when(F.col("new_path").isNotNull(), S.basename(F.col("new_path"))).otherwise(F.col("filename")))
    merged = moved.withColumn("rating", merge_rating(F.col("rating"), F.col("_r"))).withColumn("favorite", merge_favorite(F.col("favorite"), F.col("_f"))).withColumn("note", merge_note(F.col("note"), F.col("_n")))
    pairs = photo_tags.join(x.where("existing IS NOT NULL").select("_i", "existing"), F.col("photo_id") == F.col("_i"), "left").select(F.coalesce("existing", "photo_id").alias("photo_id"), "tag_id").distinct()
    return merged.select(*photos.columns), pairs


def match_import(wanted: DataFrame, photos: DataFrame) -> DataFrame:
    """(path, photo_id, match_kind) of each wanted (path, filename, filesize): by path, else by name and size if one photo alone has them."""
    return _matched(wanted, photos).select("path", "photo_id", "match_kind")


def _matched(wanted: DataFrame, photos: DataFrame) -> DataFrame:
    p = photos.select(F.col("id").alias("_i"), F.col("path").alias("_p"))
    exact = wanted.join(p, F.col("path") == F.col("_p"), "left")
    named = photos.groupBy(F.lower("filename").alias("_f"), F.col("filesize").alias("_s")).agg(F.count(F.lit(1)).alias("_c"), F.min("id").alias("_j")).where("_c = 1")
    j = exact.join(named, (F.lower("filename") == F.col("_f")) & (F.col("filesize") == F.col("_s")), "left")
    kind = F.when(F.col("_i").isNotNull(), "path").when(F.col("_j").isNotNull(), "name").otherwise("missing")
    return j.select(*wanted.columns, F.coalesce("_i", "_j").alias("photo_id"), kind.alias("match_kind"))


def new_pairs(pairs: DataFrame, photo_tags: DataFrame) -> DataFrame:
    """The pairs that are not there yet, each once."""
    return pairs.select("photo_id", "tag_id").distinct().join(photo_tags, ["photo_id", "tag_id"], "left_anti")


def merge_extras(photos: DataFrame, extras: DataFrame) -> DataFrame:
    """photos after ``extras`` (photo_id, rating, favorite, note): ratings only rise, a note is only added."""
    e = extras.groupBy("photo_id").agg(F.max("rating").alias("_r"), F.bool_or("favorite").alias("_f"), F.max("note").alias("_n"))
    j = photos.join(e, F.col("id") == F.col("photo_id"), "left")
    rating = F.greatest(F.col("rating"), S.clean_rating(F.col("_r")))
    return j.select(*[c for c in photos.columns if c not in ("rating", "favorite", "note")], rating.alias("rating"), merge_favorite(F.col("favorite"), F.col("_f")).alias("favorite"), merge_note(F.col("note"), F.col("_n")).alias("note"))


def create_tags(names: DataFrame, tags: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tags, (name, tag_id)) after every wanted (name, category, color) that is neither a tag's name nor an alias became a tag.

    Names are trimmed and in lower case; empty ones are left out. Of several wishes for one name
    the first by category and colour counts.
    """
    clean = names.select(F.lower(F.trim("name")).alias("name"), F.coalesce("category", F.lit("general")).alias("category"), F.coalesce("color", F.lit(DEFAULT_COLOR)).alias("color")).where("name <> ''")
    clean = clean.groupBy("name").agg(F.min(F.struct("category", "color")).alias("x")).select("name", "x.category", "x.color")
    new = resolve_names(clean.select("name"), tags, aliases).where("tag_id IS NULL").select("name")
    made = numbered_after(clean.join(new, "name", "left_semi"), tags, ["name"]).withColumns({c: F.lit(False) for c in ("hidden", "sidebar_hidden") if c in tags.columns})
    after = durable(tags.unionByName(made, allowMissingColumns=True))
    return after, resolve_names(clean.select("name"), after, aliases)


def _all_or_none(more: DataFrame, clash: DataFrame) -> DataFrame:
    """The wishes of the tags that are not among those with a clash."""
    return more.join(clash.distinct(), F.col("tag") == F.col("_t"), "left_anti")


def import_catalogue(tags_in: DataFrame, categories_in: DataFrame, assignments: DataFrame, photos: DataFrame, photo_tags: DataFrame, tags: DataFrame, categories: DataFrame, aliases: DataFrame, rejections: DataFrame) -> Mapping[str, DataFrame]:
    """The catalogue after an import: photos, photo_tags, tags, categories, aliases, rejections, and counts (one row).

    ``tags_in`` (name, category, color, parent, aliases), ``categories_in`` (name) and
    ``assignments`` (path, filename, filesize, tags, rejected, rating, favorite, note) as an export
    has them. Nothing is overwritten or taken away: tags are made where neither a tag nor an alias
    has the name; a parent is set where a tag has none and no cycle arises; aliases where a tag has
    none and no name is taken; ratings rise, notes fill gaps; a rejection counts unless the photo
    has the tag or no tag has the name. ``tags_in`` may have seq, the place in the list: of rows
    that repeat a name the first makes the tag and the others are skipped; an alias that several
    tags want goes to the first, and the others get none of theirs; a tag's last list counts.
    """
    named = tags_in.where("trim(name) <> ''").withColumn("name", F.lower(F.trim("name")))
    if "seq" not in named.columns:
        named = named.withColumn("seq", F.lit(0))
    known = tags.select(F.lower("name").alias("_k"))
    matched = durable(_matched(assignments, photos))
    own = matched.where("photo_id IS NOT NULL")
    pairs = durable(own.select("photo_id", F.explode("tags").alias("name")).select("photo_id", F.lower(F.trim("name")).alias("name")).where("name <> ''").distinct())
    # Tags of the list first: they are made whatever aliases there are; then names that only assignments have.
    first = named.join(known, F.col("name") == F.col("_k"), "left_anti").select("name", "seq", F.coalesce("category", F.lit("general")).alias("category"), F.coalesce("color", F.lit(DEFAULT_COLOR)).alias("color"))
    first = first.groupBy("name").agg(F.min(F.struct("seq", "category", "color")).alias("x")).select("name", "x.category", "x.color")
    made = numbered_after(first, tags, ["name"]).withColumns({c: F.lit(False) for c in ("hidden", "sidebar_hidden") if c in tags.columns})
    listed = durable(tags.unionByName(made, allowMissingColumns=True))
    after, ids = create_tags(pairs.select("name").distinct().withColumns({"category": F.lit(None).cast("string"), "color": F.lit(None).cast("string")}), listed, aliases)
    @cache
    def tree() -> tuple[DataFrame, DataFrame]:
        """(wishes of the list by tag, the tags with their parents)."""
        # Parents and aliases where there are none.
        by_name = after.select(F.col("id").alias("_i"), F.lower("name").alias("_n"))
        wish = named.join(by_name, F.col("name") == F.col("_n")).select(F.col("_i").alias("tag"), F.lower(F.trim("parent")).alias("parent"), "aliases", "seq")
        asked = wish.join(by_name, F.col("parent") == F.col("_n")).groupBy("tag").agg(F.min("_i").alias("parent"))
        free = asked.join(after.where("parent_id IS NULL").select(F.col("id").alias("_i")), F.col("tag") == F.col("_i"), "left_semi").where("tag <> parent")
        joined = after.join(free, F.col("id") == F.col("tag"), "left").withColumn("parent_id", F.coalesce("parent_id", "parent")).drop("tag", "parent")
        joined = durable(joined)
        # A wish that closes a cycle is dropped: its tag would be its own ancestor.
        circle = descendants(joined).select("ancestor", F.col("tag").alias("below"))
        closes = free.join(circle, (F.col("tag") == F.col("ancestor")) & (F.col("parent") == F.col("below"))).select(F.col("tag").alias("_c")).distinct()
        new_tags = durable(joined.join(closes, F.col("id") == F.col("_c"), "left").withColumn("parent_id", F.when(F.col("_c").isNull(), F.col("parent_id"))).drop("_c"))
        return wish, new_tags

    @cache
    def other_names() -> DataFrame:
        wish, new_tags = tree()
        have = aliases.select(F.col("tag_id").alias("_h")).distinct()
        lists = wish.join(have, F.col("tag") == F.col("_h"), "left_anti").where(F.size("aliases") > 0).groupBy("tag").agg(F.max(F.struct("seq", "aliases")).alias("x"))
        more = lists.select("tag", "x.seq", F.explode("x.aliases").alias("alias")).select("tag", "seq", F.lower(F.trim("alias")).alias("alias")).where("alias <> ''").distinct()
        taken = new_tags.select(F.lower("name").alias("_n")).unionByName(aliases.select(F.lower("alias").alias("_n"))).distinct()
        more = durable(_all_or_none(more, more.join(taken, F.col("alias") == F.col("_n"), "left_semi").select(F.col("tag").alias("_t"))))
        # Of several tags that want an alias the first that gets all of its own has it.
        turns = ranked(more.select("tag", "seq").distinct(), [F.col("seq"), F.col("tag")]).select(F.col("tag").alias("_w"), F.col("rank").alias("turn"))
        wanted_by = durable(more.join(turns, F.col("tag") == F.col("_w")).select("turn", "tag", "alias"))
        rival = wanted_by.select(F.col("turn").alias("b"), F.col("alias").alias("_a"))
        both = durable(both_ways(wanted_by.select(F.col("turn").alias("a"), "alias").join(rival, (F.col("alias") == F.col("_a")) & (F.col("a") < F.col("b"))).select("a", "b").distinct()))
        late = both.select(F.col("x").alias("id")).distinct().join(first_come(both), "id", "left_anti").join(wanted_by, F.col("id") == F.col("turn")).select(F.col("tag").alias("_t"))
        return _all_or_none(more, late).select("alias", F.col("tag").cast("int").alias("tag_id"))

    # Pairs, extras, rejections.
    @cache
    def added() -> DataFrame:
        wanted = durable(pairs.join(ids, "name").select("photo_id", F.col("tag_id").cast("int").alias("tag_id")).distinct())
        return durable(new_pairs(wanted, photo_tags))

    all_pairs = lambda: photo_tags.select("photo_id", "tag_id").unionByName(added())

    @cache
    def raised() -> DataFrame:
        extras = own.where("coalesce(rating, 0) <> 0 OR favorite OR note <> ''").select("photo_id", S.clean_rating(F.col("rating")).alias("rating"), F.coalesce("favorite", F.lit(False)).alias("favorite"), F.nullif("note", F.lit("")).alias("note"))
        return durable(merge_extras(photos, extras))

    def refused() -> DataFrame:
        no = own.select("photo_id", F.explode("rejected").alias("name"))
        no = resolve_names(no.select("name").distinct(), tree()[1], aliases).where("tag_id IS NOT NULL").join(no, "name").select(F.col("tag_id").cast("int").alias("tag_id"), "photo_id").distinct()
        return import_rejections(rejections, no, all_pairs())

    cats = categories.select("name").unionByName(categories_in.select("name").where("name IS NOT NULL").distinct().join(categories.select(F.lower("name").alias("_k")), F.lower("name") == F.col("_k"), "left_anti"))
    def counts() -> DataFrame:
        old = photos.select(F.col("id").alias("_i"), F.struct("rating", "favorite", F.coalesce("note", F.lit("")).alias("note")).alias("_old"))
        changed = raised().join(old, F.col("id") == F.col("_i")).where(F.struct("rating", "favorite", F.coalesce("note", F.lit("")).alias("note")) != F.col("_old"))
        one = lambda df, c: df.agg(F.count(F.lit(1)).alias(c))
        kinds = matched.agg(*[F.count_if(F.col("match_kind") == k).alias(n) for k, n in (("path", "photos_matched"), ("name", "photos_by_name"), ("missing", "photos_missing"))])
        counts = kinds.join(tree()[1].join(tags.select(F.col("id").alias("_i")), F.col("id") == F.col("_i"), "left_anti").agg(F.count(F.lit(1)).alias("created")))
        return counts.join(one(named, "listed").join(one(first, "made")).select((F.col("listed") - F.col("made")).alias("skipped"))).join(one(added(), "pairs_added")).join(one(changed, "extras_added"))

    every = lambda: aliases.select("alias", F.col("tag_id").cast("int").alias("tag_id")).unionByName(other_names())
    return Parts(photos=raised, photo_tags=all_pairs, tags=lambda: tree()[1], categories=lambda: cats, aliases=every, rejections=refused, counts=counts)


def import_sidecars(found: DataFrame, photos: DataFrame, photo_tags: DataFrame, tags: DataFrame, aliases: DataFrame) -> dict[str, DataFrame]:
    """The catalogue after the tags and ratings of sidecars were added: photos, photo_tags, tags, and counts (one row).

    ``found``: (photo_id, tags array of (name, category), rating), a row for each photo with a
    readable sidecar. Tags that neither a name nor an alias has are made, in their category.
    """
    own = durable(found.where("size(tags) > 0 OR rating > 0"))
    named = own.select("photo_id", F.explode("tags").alias("t")).select("photo_id", "t.name", "t.category")
    after, ids = create_tags(named.select("name", "category", F.lit(None).cast("string").alias("color")), tags, aliases)
    pairs = named.select("photo_id", F.lower(F.trim("name")).alias("name")).join(ids, "name").select("photo_id", F.col("tag_id").cast("int").alias("tag_id")).distinct()
    added = durable(new_pairs(pairs, photo_tags))
    rated = own.where("rating > 0").select("photo_id", "rating", F.lit(False).alias("favorite"), F.lit(None).cast("string").alias("note"))
    raised = durable(merge_extras(photos, rated))
    old = photos.select(F.col("id").alias("_i"), F.col("rating").alias("_r"))
    counts = photos.agg(F.count(F.lit(1)).alias("checked")).join(own.agg(F.count(F.lit(1)).alias("with_xmp"))).join(added.agg(F.count(F.lit(1)).alias("pairs_added")))
    counts = counts.join(after.join(tags.select(F.col("id").alias("_i")), F.col("id") == F.col("_i"), "left_anti").agg(F.count(F.lit(1)).alias("tags_created"))).join(raised.join(old, F.col("id") == F.col("_i")).agg(F.count_if(F.col("rating") > F.coalesce("_r", F.lit(0))).alias("ratings_added")))
    return {"photos": raised, "photo_tags": photo_tags.select("photo_id", "tag_id").unionByName(added), "tags": after, "counts": counts}


def import_rejections(rejections: DataFrame, wanted: DataFrame, photo_tags: DataFrame) -> DataFrame:
    """All rejections after the wanted (tag_id, photo_id), but none where the photo has the tag."""
    ok = wanted.select("tag_id", "photo_id").join(photo_tags.select("tag_id", "photo_id"), ["tag_id", "photo_id"], "left_anti")
    return rejections.select("tag_id", "photo_id").unionByName(ok).distinct()


def add_tags(photo_tags: DataFrame, ids: DataFrame, tag: int) -> DataFrame:
    return photo_tags.unionByName(ids.select(F.col("id").alias("photo_id"), F.lit(tag).alias("tag_id"))).distinct()


def remove_tag(photo_tags: DataFrame, ids: DataFrame, tag: int) -> DataFrame:
    gone = ids.select(F.col("id").alias("_i")).distinct()
    return photo_tags.join(gone, (F.col("photo_id") == F.col("_i")) & (F.col("tag_id") == tag), "left_anti")


def replace_tags(photo_tags: DataFrame, ids: DataFrame, tags: list[int]) -> DataFrame:
    own = ids.select(F.col("id").alias("_i")).distinct()
    new = own.select(F.col("_i").alias("photo_id"), F.explode(F.array(*[F.lit(t) for t in tags])).alias("tag_id"))
    return photo_tags.join(own, F.col("photo_id") == F.col("_i"), "left_anti").unionByName(new)


def set_extras(photos: DataFrame, ids: DataFrame, rating: int | None = None, favorite: bool | None = None, note: str | None = None) -> DataFrame:
    """Bulk rating (0 to 5), favourite and note; an empty note clears it."""
    own = ids.select(F.col("id").alias("_i")).distinct()
    j = photos.join(own, F.col("id") == F.col("_i"), "left")
    hit = F.col("_i").isNotNull()
    if rating is not None:
        j = j.withColumn("rating", F.when(hit, F.lit(max(0, min(5, rating)))).otherwise(F.col("rating")))
    if favorite is not None:
        j = j.withColumn("favorite", F.when(hit, F.lit(favorite)).otherwise(F.col("favorite")))
    if note is not None:
        j = j.withColumn("note", F.when(hit, F.lit(note.strip() or None)).otherwise(F.col("note")))
    return j.drop("_i")


def latest_answers(answers: DataFrame) -> DataFrame:
    """(tag_id, photo_id, answer) of an answer log (tag_id, photo_id, answer, ts, seq): the last one wins."""
    return answers.groupBy("tag_id", "photo_id").agg(F.max_by("answer", F.struct("ts", "seq")).alias("answer"))


def apply_answers(photo_tags: DataFrame, rejections: DataFrame, latest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(photo_tags, rejections): yes adds the tag and clears a no, no does the reverse."""
    key = ["tag_id", "photo_id"]
    yes, no = latest.where("answer = 'yes'").select(*key), latest.where("answer = 'no'").select(*key)
    tagged = photo_tags.select(*key).join(no, key, "left_anti").unionByName(yes).distinct()
    return tagged, rejections.select(*key).join(yes, key, "left_anti").unionByName(no).distinct()


def answer_history(answers: DataFrame) -> DataFrame:
    """(seq, answer, before): each answer with the one before it on the same photo and tag, to undo it."""
    w = Window.partitionBy("tag_id", "photo_id").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return answers.select("seq", "answer", F.last_value("answer").over(w).alias("before"))


def keep_newest(snapshots: DataFrame, keep: int) -> DataFrame:
    """(kind, id, place) of the newest ``keep`` snapshots of each kind."""
    w = Window.partitionBy("kind").orderBy(F.desc("made_at"), F.desc("id"))
    return snapshots.withColumn("place", F.row_number().over(w)).where(F.col("place") <= keep).select("kind", "id", "place")


def worklist(valid: DataFrame, cached: DataFrame) -> DataFrame:
    """(key, action) of artefacts: make what is wanted and absent, remove what is there and unwanted."""
    v, c = valid.select(F.col("key").alias("_v")).distinct(), cached.select(F.col("key").alias("_c")).distinct()
    j = v.join(c, F.col("_v") == F.col("_c"), "full_outer")
    action = F.when(F.col("_c").isNull(), "make").when(F.col("_v").isNull(), "remove").otherwise("keep")
    return j.select(F.coalesce("_v", "_c").alias("key"), action.alias("action"))


def watch_folders(photos: DataFrame, roots: list[str], most: int = 3000) -> DataFrame:
    """(folder): the watched roots and the known folders below them, in order, so many at most."""
    known = photos.select(S.folder_of(F.col("path")).alias("folder")).distinct()
    below = known.where(S.inside(F.col("folder"), roots[0]) if len(roots) == 1 else F.array_max(F.array(*[S.inside(F.col("folder"), r) for r in roots])))
    own = photos.sparkSession.createDataFrame([(S.normal_folder(r) + "\\",) for r in roots], "folder string")
    return own.unionByName(below).distinct().orderBy("folder").limit(most)


def with_defaults(old: DataFrame, schema: dict[str, tuple[str, object]]) -> DataFrame:
    """An old snapshot in today's schema: {column: (type, value where the column is absent)}."""
    return old.select(*[(F.col(c) if c in old.columns else F.lit(v)).cast(t).alias(c) for c, (t, v) in schema.items()])
