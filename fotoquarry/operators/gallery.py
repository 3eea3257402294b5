"""Gallery queries: composable filters, orders, pages and positions."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import hierarchy
from .ranking import ranked

#: Orders by name; each ends in the id, so that pages never overlap.
ORDERS: dict[str, tuple[str, ...]] = {
    "date": ("year", "month", "filename", "id"),
    "filename": ("filename", "id"),
    "filesize": ("filesize", "id"),
    "added": ("added_at", "id"),
    "rating": ("rating", "year", "month", "filename", "id"),
}


def order_by(field: str, ascending: bool) -> list[Column]:
    """Nulls first when ascending, last when descending."""
    return [F.col(c).asc_nulls_first() if ascending else F.col(c).desc_nulls_last() for c in ORDERS[field]]


@dataclass(frozen=True)
class PhotoFilter:
    """Optional predicates, all of which must hold; empty values mean no filter, except ``only_ids``, where () matches nothing."""

    exclude_hidden: bool = False
    all_tags: tuple[int, ...] = ()
    tag_groups: tuple[tuple[int, ...], ...] = ()
    any_tags: tuple[int, ...] = ()
    none_tags: tuple[int, ...] = ()
    search: str = ""
    media_type: str | None = None
    year_from: int | None = None
    year_to: int | None = None
    min_pixels: int = 0
    orientation: str | None = None
    min_duration: float | None = None
    max_duration: float | None = None
    min_rating: int = 0
    favorites_only: bool = False
    not_rejected_for: int | None = None
    rejected_for: int | None = None
    only_ids: tuple[int, ...] | None = None
    with_note: bool = False
    folder: str = ""
    untagged_only: bool = False


def hidden_ids(tags: DataFrame, photo_tags: DataFrame) -> DataFrame:
    """(photo_id) of the photos that carry a hidden tag."""
    return photo_tags.join(tags.where("hidden").select(F.col("id").alias("tag_id")), "tag_id").select("photo_id").distinct()


def with_hidden(photos: DataFrame, tags: DataFrame, photo_tags: DataFrame) -> DataFrame:
    hid = hidden_ids(tags, photo_tags).select(F.col("photo_id").alias("_h"))
    return photos.join(hid, F.col("id") == F.col("_h"), "left").withColumn("hidden", F.col("_h").isNotNull()).drop("_h")


def contains_text(column: Column, text: str) -> Column:
    """LIKE '%text%' whatever the letter case; % and _ in the text keep their meaning."""
    return column.ilike("%" + text.replace("\\", "\\\\") + "%")


def predicates(f: PhotoFilter) -> Column:
    """The predicates on a photo's own columns; null sizes, years and durations never pass."""
    out: list[Column] = []
    if f.search:
        out.append(contains_text(F.col("filename"), f.search) | F.coalesce(contains_text(F.col("note"), f.search), F.lit(False)))
    if f.media_type:
        out.append(F.col("media_type") == f.media_type)
    if f.year_from is not None:
        out.append(F.col("year") >= f.year_from)
    if f.year_to is not None:
        out.append(F.col("year") <= f.year_to)
    if f.min_pixels:
        out.append(S.pixels(F.col("width"), F.col("height")) >= f.min_pixels)
    if f.orientation:
        out.append(S.has_shape(F.col("width"), F.col("height"), f.orientation))
    if f.min_duration is not None or f.max_duration is not None:
        out.append(F.col("media_type") == "video")
    if f.min_duration is not None:
        out.append(F.col("duration") >= f.min_duration)
    if f.max_duration is not None:
        out.append(F.col("duration") < f.max_duration)
    if f.min_rating:
        out.append(F.col("rating") >= f.min_rating)
    if f.favorites_only:
        out.append(F.col("favorite"))
    if f.with_note:
        out.append(F.col("note").isNotNull() & (F.col("note") != ""))
    if f.folder:
        out.append(S.inside(F.col("path"), f.folder))
    return S.all_of(out)


def _listed(spark, rows, schema: str) -> DataFrame:
    """Stated rows of whole numbers as a table of known size, so that Spark itself sees whether it can be sent to all tasks."""
    names = schema.split(", ")
    if not rows:
        return spark.createDataFrame([], schema)
    values = ", ".join("(" + ", ".join(str(int(v)) for v in r) + ")" for r in rows)
    raw = spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(n.split(' ')[0] for n in names)})")
    return raw.select(*[F.col(n.split(" ")[0]).cast(n.split(" ")[1]) for n in names])


def _ids(df: DataFrame, values) -> DataFrame:
    """Stated ids as a table; Spark sends it to all tasks if it is small, and deals it out if not."""
    return _listed(df.sparkSession, [(v,) for v in dict.fromkeys(values)], "v long")


#: Marks that fit into one whole number.
BITS = 62


def apply_filter(photos: DataFrame, tags: DataFrame, photo_tags: DataFrame, rejections: DataFrame, f: PhotoFilter) -> DataFrame:
    """The photos that pass: own columns first, then one semi or anti join for all conditions on tags together, and one for each on ids and answers.

    Every condition on tags is a mark, a bit; one pass over the pairs ors each photo's marks
    together, in numbers that combine before the shuffle. A single condition needs no marks: it
    is a semi or anti join with the pairs themselves.
    """
    out = photos.where(predicates(f))

    def semi(df: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
        key = ids.columns[0]
        return df.join(ids.select(F.col(key).alias("_p")), F.col("id") == F.col("_p"), how)

    if f.only_ids is not None:
        out = semi(out, _ids(photos, f.only_ids))
    must = [{t} for t in dict.fromkeys(f.all_tags)] + [set(g) for g in f.tag_groups] + ([set(f.any_tags)] if f.any_tags else [])
    # The last mark is what a photo must not have.
    never = len(must)
    rows = [(int(t), k) for k, ids in enumerate([*must, set(f.none_tags)]) for t in ids]
    if rows or f.exclude_hidden:
        want = _listed(photos.sparkSession, rows, "v int, mark int")
        if f.exclude_hidden:
            hidden = tags.where("hidden").select(F.col("id").alias("v"), F.lit(never).alias("mark"))
            want = want.unionByName(hidden) if rows else hidden
        tagged = photo_tags.join(want, F.col("tag_id") == F.col("v"))
        unwanted = bool(f.none_tags) or f.exclude_hidden
        if not must:
            out = semi(out, tagged, "left_anti")
        elif len(must) == 1 and not unwanted:
            out = semi(out, tagged)
        else:
            words = range(never // BITS + 1)
            one = lambda w: F.bit_or(F.when(F.floor(F.col("mark") / BITS) == w, F.expr(f"shiftleft(1L, mark % {BITS})")).otherwise(F.lit(0).cast("long"))).alias(f"m{w}")
            marks = tagged.groupBy("photo_id").agg(*[one(w) for w in words])
            full = [sum(1 << k % BITS for k in range(never) if k // BITS == w) for w in words]
            out = semi(out, marks.where(S.all_of([F.col(f"m{w}") == F.lit(full[w]).cast("long") for w in words])))
    if f.not_rejected_for is not None:
        out = semi(out, rejections.where(F.col("tag_id") == f.not_rejected_for).select("photo_id"), "left_anti")
    if f.rejected_for is not None:
        out = semi(out, rejections.where(F.col("tag_id") == f.rejected_for).select("photo_id"))
    if f.untagged_only:
        out = semi(out, photo_tags.select("photo_id"), "left_anti")
    return out


@dataclass(frozen=True)
class GalleryQuery:
    """What a user asks for; saved as JSON."""

    tag_ids: tuple[int, ...] = ()
    match_any: bool = False
    exclude_tag_ids: tuple[int, ...] = ()
    search: str = ""
    media_type: str | None = None
    year_from: int | None = None
    year_to: int | None = None
    min_megapixels: float = 0
    orientation: str | None = None
    min_duration: float | None = None
    max_duration: float | None = None
    min_rating: int = 0
    favorites_only: bool = False
    untagged_only: bool = False
    with_note: bool = False
    folder: str = ""
    not_rejected_for: int | None = None
    rejected_for: int | None = None
    sort: str = "date"
    ascending: bool = False

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> GalleryQuery:
        """Unknown keys are dropped, lists become tuples, an unknown order is the default."""
        raw = json.loads(text)
        known = {f.name for f in fields(cls)}
        own = {k: tuple(v) if isinstance(v, list) else v for k, v in raw.items() if k in known}
        out = cls(**own)
        return out if out.sort in ORDERS else replace(out, sort="date")

    def photo_filter(self, tags: DataFrame, show_hidden: bool = False) -> PhotoFilter:
        """Tags are expanded to their descendants (a bounded table: the tag tree); ids that do not exist are ignored."""
        wanted = {*self.tag_ids, *self.exclude_tag_ids}
        grown: dict[int, list[int]] = {}
        if wanted:
            grown = hierarchy.tree(tags).expanded(wanted)
        groups = tuple(tuple(sorted(grown[t])) for t in self.tag_ids if t in grown)
        either = tuple(sorted({t for g in groups for t in g}))
        return PhotoFilter(
            exclude_hidden=not show_hidden,
            tag_groups=() if self.match_any else groups,
            any_tags=either if self.match_any else (),
            none_tags=tuple(sorted({t for x in self.exclude_tag_ids for t in grown.get(x, ())})),
            min_pixels=int(self.min_megapixels * 1_000_000),
            **{k: getattr(self, k) for k in ("search", "media_type", "year_from", "year_to", "orientation", "min_duration", "max_duration", "min_rating", "favorites_only", "untagged_only", "with_note", "folder", "not_rejected_for", "rejected_for")},
        )


def gallery(catalog, query: GalleryQuery, show_hidden: bool = False) -> DataFrame:
    return apply_filter(catalog.photos, catalog.tags, catalog.photo_tags, catalog.tag_rejections, query.photo_filter(catalog.tags, show_hidden))


#: Albums that are always there.
ALBUMS = {
    "favourites": GalleryQuery(favorites_only=True),
    "four_stars": GalleryQuery(min_rating=4),
    "untagged": GalleryQuery(untagged_only=True),
    "videos": GalleryQuery(media_type="video"),
    "with_notes": GalleryQuery(with_note=True),
}


def count_queries(catalog, queries: dict[str, GalleryQuery], show_hidden: bool = False) -> DataFrame:
    """(name, n) of many queries in one pass over the photos with their tags and rejections as arrays."""
    tags = catalog.photo_tags.groupBy("photo_id").agg(F.collect_set("tag_id").alias("_tags"))
    no = catalog.tag_rejections.groupBy("photo_id").agg(F.collect_set("tag_id").alias("_no"))
    hid = hidden_ids(catalog.tags, catalog.photo_tags).select(F.col("photo_id").alias("_h"))
    p = catalog.photos.join(tags.withColumnRenamed("photo_id", "_t"), F.col("id") == F.col("_t"), "left").join(no.withColumnRenamed("photo_id", "_n"), F.col("id") == F.col("_n"), "left")
    p = p.join(hid, F.col("id") == F.col("_h"), "left")
    empty = F.array().cast("array<int>")
    own, nope = F.coalesce("_tags", empty), F.coalesce("_no", empty)
    lists = lambda ids: F.array(*[F.lit(int(i)) for i in ids])
    counts = []
    for name, q in queries.items():
        f = q.photo_filter(catalog.tags, show_hidden)
        c = [predicates(f)]
        if f.exclude_hidden:
            c.append(F.col("_h").isNull())
        c += [F.arrays_overlap(own, lists(g)) for g in f.tag_groups]
        if f.any_tags:
            c.append(F.arrays_overlap(own, lists(f.any_tags)))
        if f.none_tags:
            c.append(~F.arrays_overlap(own, lists(f.none_tags)))
        if f.untagged_only:
            c.append(F.size(own) == 0)
        if f.rejected_for is not None:
            c.append(F.array_contains(nope, f.rejected_for))
        if f.not_rejected_for is not None:
            c.append(~F.array_contains(nope, f.not_rejected_for))
        counts.append(F.struct(F.lit(name).alias("name"), F.count_if(S.all_of(c)).alias("n")))
    return p.agg(F.array(*counts).alias("a")).select(F.explode("a").alias("x")).select("x.name", "x.n")


def page(photos: DataFrame, field: str, ascending: bool, limit: int = -1, offset: int = 0) -> DataFrame:
    """One page of an order; a negative limit is none."""
    out = photos.orderBy(*order_by(field, ascending)).offset(offset)
    return out if limit < 0 else out.limit(limit)


def page_numbers(total: Column, limit: int, offset: int) -> list[Column]:
    """page_number, total_pages, has_previous, has_next."""
    pages = F.greatest(F.lit(1), F.ceil(total / limit)).cast("long")
    number = F.lit(offset // limit + 1).cast("long")
    return [number.alias("page_number"), pages.alias("total_pages"), (number > 1).alias("has_previous"), (number < pages).alias("has_next")]


def before_date(year: int | None, month: int | str | None, ascending: bool) -> Column:
    """Which photos come before the first one of a date, nulls first when ascending.

    ``month``: None for the whole year, "none" for the year's photos without a month;
    ``year`` None for the photos without a date.
    """
    y, m = F.col("year"), F.col("month")
    if ascending:
        if year is None:
            return F.lit(False)
        first = y.isNull() | (y < year)
        return first if month in (None, "none") else first | ((y == year) & (m.isNull() | (m < month)))
    if year is None:
        return y.isNotNull()
    later = y > year
    if month is None:
        return later
    return later | ((y == year) & (m.isNotNull() if month == "none" else m > month))


def position(photos: DataFrame, year: int | None, month: int | str | None, ascending: bool) -> DataFrame:
    """(n): the row to jump to, by counting alone."""
    return photos.agg(F.count_if(F.coalesce(before_date(year, month, ascending), F.lit(False))).alias("n"))


def numbered(photos: DataFrame, field: str, ascending: bool) -> DataFrame:
    """(id, row_no) over all photos, without a window over all of them; see ``ranking.ranked``."""
    return ranked(photos.select(*dict.fromkeys(("id", *ORDERS[field]))), order_by(field, ascending)).select("id", (F.col("rank") + 1).alias("row_no"))
