"""Queries of the gallery: scans, scalars, filters, orders, pages and positions."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from ..functions import dates
from ..functions import scalars as S
from ..operators import aggregates, gallery, saved
from ..operators.gallery import ALBUMS, GalleryQuery, PhotoFilter, apply_filter
from ..operators.gallery import gallery as run
from .define import Book

book = Book()
#: A file of next year is plausible, one of a later year is not.
MAX_YEAR = datetime.date.today().year + 1
HID = "(SELECT pt.photo_id FROM photo_tags pt JOIN tags t ON t.id = pt.tag_id WHERE t.hidden)"
#: Descendants with the tag itself, for the SQL twins.
CLOSURE = """WITH RECURSIVE clo(a, t) AS (SELECT id, id FROM tags UNION SELECT clo.a, tags.id FROM clo JOIN tags ON tags.parent_id = clo.t)
"""


def filtered(c, **f):
    return apply_filter(c.photos, c.tags, c.photo_tags, c.tag_rejections, PhotoFilter(**f))


# Scans and scalars.
book.add(
    "scan_catalogue",
    lambda c: gallery.with_hidden(c.photos, c.tags, c.photo_tags).select("id", "path", "filename", "media_type", "year", "month", "filesize", "width", "height", "duration", "added_at", "mtime", "rating", "favorite", "note", "hidden"),
    f"SELECT id, path, filename, media_type, year, month, filesize, width, height, duration, added_at, mtime, rating, favorite, note, id IN {HID} AS hidden FROM photos",
)
book.add(
    "path_parts",
    lambda c: c.photos.select("id", S.folder_of(F.col("path")).alias("fold"), S.parent_folder(S.folder_of(F.col("path"))).alias("parent"), S.root_of(F.col("path")).alias("root"), S.basename(F.col("path")).alias("base"), S.media_type(F.col("path")).alias("kind")),
    r"""SELECT id, regexp_replace(path, '[^\\]*$', '') AS fold, regexp_replace(regexp_replace(regexp_replace(path, '[^\\]*$', ''), '\\+$', ''), '[^\\]*$', '') AS parent,
      CASE WHEN regexp_matches(path, '^[A-Za-z]:\\') THEN substr(path, 1, 3) ELSE regexp_extract(path, '^\\\\[^\\]+\\[^\\]+\\', 0) END AS root,
      regexp_extract(path, '[^\\]*$', 0) AS base, CASE WHEN path LIKE '%.mp4' THEN 'video' ELSE 'image' END AS kind FROM photos""",
)
book.add(
    "shape_of_photo",
    lambda c: c.photos.select("id", *[S.has_shape(F.col("width"), F.col("height"), x).alias(x) for x in ("landscape", "portrait", "square")], S.pixels(F.col("width"), F.col("height")).alias("pixels")),
    """SELECT id, width * 50 > height * 51 AS landscape, height * 50 > width * 51 AS portrait, width * 50 BETWEEN height * 49 AND height * 51 AS square,
      width * height AS pixels FROM photos""",
)


def _first(col: str) -> str:
    three, two = "regexp_extract_all({0}, '{1}', 3)", "regexp_extract_all({0}, '{1}', 2)"
    strict = " AND CAST(x[2] AS INT) BETWEEN 1 AND 12 AND CAST(x[3] AS INT) BETWEEN 1 AND 31"
    rules = [
        (r"([0-9]{4})[_\-/\\]([0-9]{1,2})[_\-/\\]([0-9]{1,2})", three, ""),
        (r"(?:^|[^0-9])([0-9]{4})([0-9]{2})([0-9]{2})(?:[^0-9]|$)", three, strict),
        (r"(?:IMG|VID)[_\-]([0-9]{4})([0-9]{2})([0-9]{2})", three, strict),
        (r"([0-9]{4})[_\-]([0-9]{2})(?:[^_\-0-9]|$)", two, ""),
    ]
    one = lambda p, third, more: f"list_filter(list_zip(regexp_extract_all({col}, '{p}', 1), regexp_extract_all({col}, '{p}', 2), {third.replace('{0}', col).replace('{1}', p)}), lambda x: CAST(x[1] AS INT) BETWEEN 1990 AND {MAX_YEAR}{more})[1]"
    return "coalesce(" + ", ".join(one(*r) for r in rules) + ")"


book.add(
    "date_from_name",
    lambda c: c.photos.select("id", dates.date_from_text(F.col("filename"), MAX_YEAR).alias("d")).select("id", "d.year", "d.month"),
    f"SELECT id, CAST(d[1] AS INT) AS year, CASE WHEN CAST(d[2] AS INT) BETWEEN 1 AND 12 THEN CAST(d[2] AS INT) END AS month FROM (SELECT id, {_first('filename')} AS d FROM photos)",
)
book.add(
    "date_resolved",
    lambda c: c.photos.select("id", dates.resolved_date(F.lit(None).cast("struct<year:int,month:int>"), F.col("filename"), F.col("folder"), F.col("mtime"), MAX_YEAR).alias("d")).select("id", "d.year", "d.month"),
    f"""SELECT id, CAST(coalesce(d[1], CAST(year(t) AS VARCHAR)) AS INT) AS year, CASE WHEN d IS NULL THEN CAST(month(t) AS INT) WHEN CAST(d[2] AS INT) BETWEEN 1 AND 12 THEN CAST(d[2] AS INT) END AS month
      FROM (SELECT id, coalesce({_first('filename')}, {_first('folder')}) AS d, to_timestamp(mtime) AT TIME ZONE 'UTC' AS t FROM photos)""",
)
book.add(
    "labels_of_photo",
    lambda c: c.photos.select("id", S.stars(F.col("rating")).alias("stars"), S.clock(F.col("duration")).alias("clock"), S.short_name(F.col("filename")).alias("short"), S.human_size(F.expr("CASE id % 7 WHEN 0 THEN NULL WHEN 1 THEN 0 WHEN 2 THEN filesize div 100 WHEN 3 THEN filesize div 512 * 512 WHEN 4 THEN filesize * 10000 ELSE filesize END")).alias("size"), S.month_label(F.col("year"), F.col("month")).alias("label")),
    """SELECT id, CASE WHEN rating > 0 THEN repeat('★', rating) || repeat('☆', 5 - rating) ELSE '' END AS stars,
      CASE WHEN coalesce(duration, 0) <> 0 THEN printf('%d:%02d', CAST(trunc(duration) AS BIGINT) // 60, CAST(trunc(duration) AS BIGINT) % 60) ELSE '' END AS clock,
      CASE WHEN length(filename) > 22 THEN substr(filename, 1, 22) || '…' ELSE filename END AS short,
      CASE WHEN coalesce(n, 0) = 0 THEN '—' WHEN n < 1024 THEN printf('%.0f B', CAST(n AS DOUBLE)) WHEN n < 1024 * 1024 THEN printf('%.0f KB', n / 1024.0) WHEN n < 1024 * 1024 * 1024 THEN printf('%.1f MB', n / 1048576.0) ELSE printf('%.1f GB', n / 1073741824.0) END AS size,
      CASE WHEN coalesce(year, 0) = 0 THEN 'Sin fecha' WHEN month IS NULL THEN CAST(year AS VARCHAR)
        ELSE ['enero', 'febrero', 'marzo', 'abril', 'mayo', 'junio', 'julio', 'agosto', 'septiembre', 'octubre', 'noviembre', 'diciembre'][month] || ' ' || CAST(year AS VARCHAR) END AS label FROM (SELECT *, CASE id % 7 WHEN 0 THEN NULL WHEN 1 THEN 0 WHEN 2 THEN filesize // 100 WHEN 3 THEN filesize // 512 * 512 WHEN 4 THEN filesize * 10000 ELSE filesize END AS n FROM photos)""",
)
book.add(
    "cleaned_extras",
    lambda c: c.photos.select("id", S.clean_rating(F.col("rating") * 2 - 1).alias("rating"), S.clean_note(F.col("note")).alias("note")),
    "SELECT id, greatest(0, least(5, rating * 2 - 1)) AS rating, nullif(trim(note), '') AS note FROM photos",
)
book.add(
    "rewritten_paths",
    lambda c: c.photos.where(S.inside(F.col("path"), "g:/fotos/1997")).select("id", S.rewrite_prefix(F.col("path"), "G:\\Fotos\\1997", "H:\\Archivo").alias("moved")),
    r"SELECT id, 'H:\Archivo' || substr(path, 14) AS moved FROM photos WHERE starts_with(lower(path), 'g:\fotos\1997\')",
)
book.add("document_digests", lambda c: c.base("documents").select("doc_id", F.md5("text").alias("digest")), "SELECT doc_id, md5(text) AS digest FROM documents")
#: Names with marks, ligatures and letters of other scripts, and their plain forms.
_MARKED = {0: ("Gdańsk Świnoujście", "gdansk swinoujscie"), 1: ("Straße Ő", "strasse o"), 2: ("ﬁn № Ⅷ ㎏", "fin o viii kg"), 3: ("Ñandú — Кириллица", "nandu"), 4: ("İstanbul ½ 日本", "istanbul 1 2"), 5: ("n\u0303o Ａｂｃ", "no abc")}
_case = lambda k: "CASE id % 7 " + " ".join(f"WHEN {i} THEN '{v[k]}'" for i, v in _MARKED.items()) + " ELSE 'x' END"
book.add("normalised_names", lambda c: c.photos.select("id", S.normal_text(F.concat_ws(" ", F.expr(_case(0)), "filename")).alias("plain")), f"SELECT id, {_case(1)} || ' ' || trim(regexp_replace(lower(filename), '[^a-z0-9]+', ' ', 'g')) AS plain FROM photos")

_EXIF = """SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'Canon' WHEN 2 THEN '' ELSE 'Sony' END AS make, CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'CANON EOS 5' WHEN 2 THEN '' ELSE 'A7' END AS model,
  CASE WHEN o_orderkey % 3 = 0 THEN concat('lens ', CAST(o_custkey % 9 AS STRING)) END AS lens, {dates},
  CASE o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 1.0E0 / (o_custkey % 500 + 2) WHEN 2 THEN CAST(o_custkey % 40 AS DOUBLE) ELSE 1.0E0 + (o_custkey % 60) / 8.0E0 END AS exposure, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 8.0E0 WHEN 2 THEN (o_custkey % 900 + 10) / 40.0E0 ELSE (o_custkey % 90 + 10) / 10.0E0 END AS aperture,
  CASE o_orderkey % 4 WHEN 1 THEN NULL WHEN 2 THEN 0 ELSE CAST(100 * (o_custkey % 64) AS INT) END AS iso, CASE o_orderkey % 4 WHEN 2 THEN NULL ELSE (o_custkey % 800) / 4.0E0 END AS focal FROM {orders}"""
_DAY = "concat(CAST(year(o_orderdate) AS STRING), ':', lpad(CAST(month(o_orderdate) AS STRING), 2, '0'), ':', lpad(CAST(day(o_orderdate) AS STRING), 2, '0'))"
_DATES = f"CASE o_orderkey % 8 WHEN 0 THEN NULL WHEN 1 THEN 'not a date' WHEN 2 THEN '0000:00:00 00:00:00' ELSE concat({_DAY}, ' 07:08:09') END AS taken, CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '2999:01:01' ELSE {_DAY} END AS digitized, '2001:02:03 04:05:06' AS modified"
_exif = lambda c: c.spark.sql(_EXIF.replace("{dates}", _DATES), orders=c.base("orders"))
_G = "printf('%g', CAST({0} AS DOUBLE))"
book.add(
    "exif_details",
    lambda c: (lambda e: e.select("id", dates.exif_details({k: F.col(k) for k in ("make", "model", "lens", "taken", "exposure", "aperture", "iso", "focal")}).alias("d")).select("id", *[F.col("d")[k].alias(n) for k, n in (("Cámara", "camera"), ("Objetivo", "lens"), ("Tomada", "taken"), ("Ajustes", "settings"))]))(_exif(c)),
    f"""WITH e AS ({_EXIF.replace("{dates}", _DATES).replace("{orders}", "orders")}), m AS (SELECT *, coalesce(trim(make), '') AS mk, coalesce(trim(model), '') AS md FROM e)
     SELECT id, CASE WHEN mk = '' AND md = '' THEN NULL WHEN md = '' THEN mk WHEN mk = '' OR starts_with(lower(md), lower(mk)) THEN md ELSE mk || ' ' || md END AS camera, nullif(trim(lens), '') AS lens, strftime(try_strptime(taken[:19], '%Y:%m:%d %H:%M:%S'), '%d/%m/%Y %H:%M') AS taken,
       nullif(concat_ws(' · ', CASE WHEN exposure > 0 AND exposure < 1 THEN '1/' || CAST(CAST(round_even(1 / exposure, 0) AS BIGINT) AS VARCHAR) || ' s' WHEN exposure >= 1 THEN {_G.format('exposure')} || ' s' END,
         CASE WHEN aperture <> 0 THEN 'f/' || replace(printf('%.1f', aperture), '.0', '') END, CASE WHEN iso <> 0 THEN 'ISO ' || CAST(iso AS VARCHAR) END, CASE WHEN focal <> 0 THEN {_G.format('focal')} || ' mm' END), '') AS settings FROM m""",
)
_D = lambda x: f"(SELECT CASE WHEN year(t) BETWEEN 1900 AND {MAX_YEAR} THEN [year(t), month(t)] END FROM (SELECT try_strptime(trim({x})[:10], '%Y:%m:%d') AS t))"
book.add(
    "exif_dates",
    lambda c: _exif(c).select("id", dates.exif_first(F.col("taken"), F.col("digitized"), F.col("modified"), MAX_YEAR).alias("d"), dates.exif_date(F.col("taken"), MAX_YEAR).alias("o")).select("id", "d.year", "d.month", F.col("o.year").alias("original_year")),
    f"WITH e AS ({_EXIF.replace('{dates}', _DATES).replace('{orders}', 'orders')}), x AS (SELECT id, {_D('taken')} AS o, coalesce({_D('taken')}, {_D('digitized')}, {_D('modified')}) AS d FROM e) SELECT id, CAST(d[1] AS INT) AS year, CAST(d[2] AS INT) AS month, CAST(o[1] AS INT) AS original_year FROM x",
)

# Filters.
_FILTERS = {
    "filter_not_hidden": ({"exclude_hidden": True}, f"id NOT IN {HID}"),
    "filter_all_tags": ({"all_tags": (3, 9)}, "id IN (SELECT photo_id FROM photo_tags WHERE tag_id IN (3, 9) GROUP BY photo_id HAVING count(DISTINCT tag_id) = 2)"),
    "filter_tag_groups": ({"tag_groups": ((2, 6, 7, 8), (9, 10))}, "id IN (SELECT photo_id FROM photo_tags WHERE tag_id IN (2, 6, 7, 8)) AND id IN (SELECT photo_id FROM photo_tags WHERE tag_id IN (9, 10))"),
    "filter_any_tags": ({"any_tags": (1, 4, 5, 14, 20)}, "id IN (SELECT photo_id FROM photo_tags WHERE tag_id IN (1, 4, 5, 14, 20))"),
    "filter_none_tags": ({"none_tags": (1, 4, 5, 14, 20)}, "id NOT IN (SELECT photo_id FROM photo_tags WHERE tag_id IN (1, 4, 5, 14, 20))"),
    "filter_search": ({"search": "img_199%7"}, "filename ILIKE '%img_199%7%' OR coalesce(note ILIKE '%img_199%7%', false)"),
    "filter_search_note": ({"search": "NOTA o"}, "filename ILIKE '%NOTA o%' OR coalesce(note ILIKE '%NOTA o%', false)"),
    "filter_media": ({"media_type": "video"}, "media_type = 'video'"),
    "filter_years": ({"year_from": 1995, "year_to": 1997}, "year BETWEEN 1995 AND 1997"),
    "filter_pixels": ({"min_pixels": 12_000_000}, "width * height >= 12000000"),
    "filter_shape": ({"orientation": "portrait"}, "height * 50 > width * 51"),
    "filter_landscape": ({"orientation": "landscape"}, "width * 50 > height * 51"),
    "filter_square": ({"orientation": "square"}, "width * 50 BETWEEN height * 49 AND height * 51"),
    "filter_duration": ({"min_duration": 30, "max_duration": 300}, "media_type = 'video' AND duration >= 30 AND duration < 300"),
    "filter_rating": ({"min_rating": 4}, "rating >= 4"),
    "filter_favourites": ({"favorites_only": True}, "favorite"),
    "filter_not_rejected": ({"not_rejected_for": 5}, "id NOT IN (SELECT photo_id FROM tag_rejections WHERE tag_id = 5)"),
    "filter_rejected": ({"rejected_for": 5}, "id IN (SELECT photo_id FROM tag_rejections WHERE tag_id = 5)"),
    "filter_ids": ({"only_ids": tuple(range(0, 3000, 7))}, "id < 3000 AND id % 7 = 0"),
    "filter_with_note": ({"with_note": True}, "note IS NOT NULL AND note <> ''"),
    "filter_folder": ({"folder": "d:/Fotos/1996"}, r"starts_with(lower(path), 'd:\fotos\1996\')"),
    "filter_untagged": ({"untagged_only": True}, "id NOT IN (SELECT photo_id FROM photo_tags)"),
    "filter_combined": (
        {"exclude_hidden": True, "any_tags": (2, 6), "none_tags": (11,), "year_from": 1994, "min_rating": 1, "orientation": "landscape", "folder": "G:\\Fotos"},
        rf"id NOT IN {HID} AND id IN (SELECT photo_id FROM photo_tags WHERE tag_id IN (2, 6)) AND id NOT IN (SELECT photo_id FROM photo_tags WHERE tag_id = 11) AND year >= 1994 AND rating >= 1 AND width * 50 > height * 51 AND starts_with(lower(path), 'g:\fotos\')",
    ),
}
for _name, (_f, _sql) in _FILTERS.items():
    book.add(_name, lambda c, f=_f: filtered(c, **f).select("id", "path"), f"SELECT id, path FROM photos WHERE {_sql}")
book.add("facet_counts", lambda c: aggregates.facets(c.photos), "\nUNION ALL ".join(
    [f"SELECT 'resolution >= {m} MP' AS facet, count(*) FILTER (WHERE width * height >= {m}000000) AS n FROM photos" for m in (2, 8, 12, 24)]
    + ["SELECT 'video < 30 s', count(*) FILTER (WHERE media_type = 'video' AND duration < 30) FROM photos", "SELECT 'video 30 s - 5 min', count(*) FILTER (WHERE media_type = 'video' AND duration >= 30 AND duration < 300) FROM photos", "SELECT 'video >= 5 min', count(*) FILTER (WHERE media_type = 'video' AND duration >= 300) FROM photos"]
    + [f"SELECT 'rating >= {k}', count(*) FILTER (WHERE rating >= {k}) FROM photos" for k in range(1, 6)]
))
book.add("album_counts", lambda c: gallery.count_queries(c, ALBUMS, True), """SELECT 'favourites' AS name, count(*) FILTER (WHERE favorite) AS n FROM photos
 UNION ALL SELECT 'four_stars', count(*) FILTER (WHERE rating >= 4) FROM photos UNION ALL SELECT 'untagged', count(*) FILTER (WHERE id NOT IN (SELECT photo_id FROM photo_tags)) FROM photos
 UNION ALL SELECT 'videos', count(*) FILTER (WHERE media_type = 'video') FROM photos UNION ALL SELECT 'with_notes', count(*) FILTER (WHERE note <> '') FROM photos""")
book.add("visible_tags", lambda c: c.tags.where("NOT hidden").select("id", "name"), "SELECT id, name FROM tags WHERE NOT hidden")
book.add("photos_with_extras", lambda c: c.photos.where("rating > 0 OR favorite OR note <> ''").select("id"), "SELECT id FROM photos WHERE rating > 0 OR favorite OR note <> ''")

# Gallery queries with the tag tree.
_Q = GalleryQuery(tag_ids=(2,), year_from=1997)
_HAS2 = "id IN (SELECT photo_id FROM photo_tags JOIN clo ON clo.t = tag_id WHERE clo.a = 2)"
book.add("timeline_tag_since", lambda c: aggregates.timeline(run(c, _Q)), CLOSURE + f"SELECT year, month, count(*) AS n FROM photos WHERE id NOT IN {HID} AND {_HAS2} AND year >= 1997 GROUP BY year, month")
book.add("gallery_and_not", lambda c: run(c, GalleryQuery(tag_ids=(2, 3, 999), exclude_tag_ids=(5,)), True).select("id"), CLOSURE + f"SELECT id FROM photos WHERE {_HAS2} AND id IN (SELECT photo_id FROM photo_tags JOIN clo ON clo.t = tag_id WHERE clo.a = 3) AND id NOT IN (SELECT photo_id FROM photo_tags JOIN clo ON clo.t = tag_id WHERE clo.a = 5)")
book.add("gallery_any", lambda c: run(c, GalleryQuery(tag_ids=(2, 3), match_any=True, media_type="image")).select("id"), CLOSURE + f"SELECT id FROM photos WHERE media_type = 'image' AND id NOT IN {HID} AND id IN (SELECT photo_id FROM photo_tags JOIN clo ON clo.t = tag_id WHERE clo.a IN (2, 3))")
book.add("review_queue", lambda c: run(c, GalleryQuery(exclude_tag_ids=(2,), not_rejected_for=2), True).select("id"), CLOSURE + f"SELECT id FROM photos WHERE NOT {_HAS2} AND id NOT IN (SELECT photo_id FROM tag_rejections WHERE tag_id = 2)")
_SAVED = {"two or three": GalleryQuery(tag_ids=(2, 3), match_any=True), "portraits": GalleryQuery(orientation="portrait", min_rating=3), "not five": GalleryQuery(exclude_tag_ids=(5,), folder="D:\\Fotos"), "rejected nine": GalleryQuery(rejected_for=9)}
book.add("saved_query_counts", lambda c: gallery.count_queries(c, _SAVED), CLOSURE + rf"""SELECT 'two or three' AS name, count(*) AS n FROM photos WHERE id NOT IN {HID} AND id IN (SELECT photo_id FROM photo_tags JOIN clo ON clo.t = tag_id WHERE clo.a IN (2, 3))
 UNION ALL SELECT 'portraits', count(*) FROM photos WHERE id NOT IN {HID} AND height * 50 > width * 51 AND rating >= 3
 UNION ALL SELECT 'not five', count(*) FROM photos WHERE id NOT IN {HID} AND id NOT IN (SELECT photo_id FROM photo_tags JOIN clo ON clo.t = tag_id WHERE clo.a = 5) AND starts_with(lower(path), 'd:\fotos\')
 UNION ALL SELECT 'rejected nine', count(*) FROM photos WHERE id NOT IN {HID} AND id IN (SELECT photo_id FROM tag_rejections WHERE tag_id = 9)""")



def _stored(c):
    """A saved query for every tag and year, and one for every tag that leaves it out."""
    years = c.photos.where("year IS NOT NULL").select("year").distinct()
    both = c.tags.select("id").join(years).select(F.concat_ws(" ", F.lit("with"), "id", "year").alias("name"), F.to_json(F.struct(F.array("id").alias("tag_ids"), F.col("year").alias("year_from"), (F.col("id") % 4).alias("min_rating"))).alias("query"))
    without = c.tags.select(F.concat_ws(" ", F.lit("without"), "id").alias("name"), F.to_json(F.struct(F.array("id").alias("exclude_tag_ids"), F.col("id").alias("not_rejected_for"), F.lit("video").alias("media_type"))).alias("query"))
    return both.unionByName(without)


book.add(
    "saved_query_rows",
    lambda c: saved.count_saved(c, _stored(c)),
    CLOSURE + f""", has AS (SELECT DISTINCT a, photo_id FROM photo_tags JOIN clo ON clo.t = tag_id), p AS (SELECT * FROM photos WHERE id NOT IN {HID}), y AS (SELECT DISTINCT year FROM photos WHERE year IS NOT NULL)
    SELECT concat_ws(' ', 'with', tags.id, y.year) AS name, count(p.id) AS n FROM tags JOIN y ON true LEFT JOIN has ON has.a = tags.id LEFT JOIN p ON p.id = has.photo_id AND p.year >= y.year AND p.rating >= tags.id % 4 GROUP BY ALL
    UNION ALL SELECT concat_ws(' ', 'without', tags.id), count(p.id) FROM tags LEFT JOIN p ON p.media_type = 'video' AND NOT EXISTS (SELECT 1 FROM has WHERE has.a = tags.id AND has.photo_id = p.id) AND NOT EXISTS (SELECT 1 FROM tag_rejections r WHERE r.tag_id = tags.id AND r.photo_id = p.id) GROUP BY ALL""",
)

# Orders, pages, positions.
for _field, _cols in gallery.ORDERS.items():
    for _asc in (True, False):
        _o = ", ".join(f"{x} {'ASC NULLS FIRST' if _asc else 'DESC NULLS LAST'}" for x in _cols)
        book.add(
            f"page_by_{_field}_{'asc' if _asc else 'desc'}", lambda c, f=_field, a=_asc: gallery.page(c.photos, f, a, 100, 200).select("id", *[x for x in gallery.ORDERS[f] if x != "id"]),
            f"SELECT {', '.join(dict.fromkeys(('id', *_cols)))} FROM photos ORDER BY {_o} LIMIT 100 OFFSET 200",
        )
for _name, _field, _asc, _o in (
    ("by_date", "date", False, "year DESC NULLS LAST, month DESC NULLS LAST, filename DESC, id DESC"), ("oldest", "date", True, "year NULLS FIRST, month NULLS FIRST, filename, id"), ("by_name", "filename", True, "filename, id"),
    ("by_size", "filesize", False, "filesize DESC NULLS LAST, id DESC"), ("by_added", "added", True, "added_at NULLS FIRST, id"), ("by_rating", "rating", False, "rating DESC NULLS LAST, year DESC NULLS LAST, month DESC NULLS LAST, filename DESC, id DESC"),
):
    book.add(f"row_numbers_{_name}", lambda c, f=_field, a=_asc: gallery.numbered(c.photos, f, a), f"SELECT id, row_number() OVER (ORDER BY {_o}) AS row_no FROM photos")
book.add("chronological_ids", lambda c: gallery.page(c.photos, "date", True).select("id"), "SELECT id FROM photos")
book.add("page_numbers", lambda c: c.photos.agg(F.count(F.lit(1)).alias("n")).select("n", *gallery.page_numbers(F.col("n"), 100, 300)), "SELECT count(*) AS n, CAST(4 AS BIGINT) AS page_number, CAST(greatest(1, ceil(count(*) / 100.0)) AS BIGINT) AS total_pages, true AS has_previous, 4 < ceil(count(*) / 100.0) AS has_next FROM photos")
for _n, (_args, _sql) in {
    "month_desc": ((1996, 5, False), "year > 1996 OR (year = 1996 AND month > 5)"), "year_desc": ((1996, None, False), "year > 1996"), "no_month_desc": ((1996, "none", False), "year > 1996 OR (year = 1996 AND month IS NOT NULL)"),
    "undated_desc": ((None, None, False), "year IS NOT NULL"), "month_asc": ((1996, 5, True), "year IS NULL OR year < 1996 OR (year = 1996 AND (month IS NULL OR month < 5))"), "year_asc": ((1996, None, True), "year IS NULL OR year < 1996"),
}.items():
    book.add(f"position_{_n}", lambda c, a=_args: gallery.position(c.photos, *a), f"SELECT count(*) AS n FROM photos WHERE {_sql}")
