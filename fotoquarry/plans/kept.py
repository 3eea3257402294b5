"""Queries of kept counts and of order statistics."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F

from ..operators import gallery, kept, orderstats
from ..operators import maintenance as M
from .define import Book
from .session import shared_folder

book = Book()


def _changed(c):
    """Counts kept through four changes: a folder moves, photos go, dates are set right, tags come and go."""
    counts = kept.KeptCounts(c.spark, f"{shared_folder(c.spark)}/kept-{uuid.uuid4().hex}")
    photos, pairs = c.photos.select("id", "folder", "year", "month", "rating"), c.photo_tags
    counts.apply(0, kept.signed(None, photos), kept.signed(None, pairs))

    moves = (F.col("year") == 1995) & F.col("folder").startswith("G:")
    moved = photos.where(moves)
    counts.apply(1, kept.signed(moved, moved.withColumn("folder", F.concat(F.lit("H:"), F.expr("substring(folder, 3)")))))
    photos = photos.withColumn("folder", F.when(moves, F.concat(F.lit("H:"), F.expr("substring(folder, 3)"))).otherwise(F.col("folder")))

    goes = F.col("id") % 50 == 7
    gone = photos.where(goes)
    counts.apply(2, kept.signed(gone, None), kept.signed(pairs.where("photo_id % 50 = 7"), None))
    photos, pairs = photos.where(~goes), pairs.where("photo_id % 50 <> 7")

    wrong = photos.where("id % 30 = 11")
    counts.apply(3, kept.signed(wrong, wrong.withColumn("month", F.lit(12))))
    photos = photos.withColumn("month", F.when(F.col("id") % 30 == 11, 12).otherwise(F.col("month")))

    best = photos.where("rating = 5").select(F.col("id").alias("photo_id"))
    lost = pairs.where("tag_id = 5").join(best, "photo_id", "left_semi")
    new = M.new_pairs(photos.where("year = 1996").select(F.col("id").alias("photo_id"), F.lit(3).alias("tag_id")), pairs)
    counts.apply(4, pairs=kept.signed(lost, new))
    return counts.read()


book.add(
    "kept_counts",
    _changed,
    r"""WITH p AS (SELECT id, CASE WHEN year = 1995 AND starts_with(folder, 'G:') THEN 'H:' || substr(folder, 3) ELSE folder END AS f, year, CASE WHEN id % 30 = 11 THEN 12 ELSE month END AS month FROM photos WHERE id % 50 <> 7),
     t AS (SELECT photo_id, tag_id FROM photo_tags WHERE photo_id % 50 <> 7 AND NOT (tag_id = 5 AND photo_id IN (SELECT id FROM photos WHERE rating = 5)) UNION SELECT id, 3 FROM p WHERE year = 1996),
     r AS (SELECT f, CASE WHEN regexp_matches(f, '^[A-Za-z]:\\') THEN substr(f, 1, 3) ELSE regexp_extract(f, '^\\\\[^\\]+\\[^\\]+\\', 0) END AS root, count(*) AS n FROM p GROUP BY ALL),
     parts AS (SELECT *, list_filter(string_split(substr(f, length(root) + 1), chr(92)), lambda x: x <> '') AS parts FROM r)
     SELECT 'month' AS kind, NULL AS name, year, month, count(*) AS n FROM p GROUP BY ALL
     UNION ALL SELECT 'folder', f, NULL, NULL, n FROM r
     UNION ALL SELECT 'root', root, NULL, NULL, CAST(sum(n) AS BIGINT) FROM r GROUP BY root
     UNION ALL SELECT 'below', above, NULL, NULL, CAST(sum(n) AS BIGINT) FROM (SELECT n, unnest(list_concat([root], [root || array_to_string(parts[1:k], chr(92)) || chr(92) FOR k IN range(1, len(parts) + 1)])) AS above FROM parts) GROUP BY above
     UNION ALL SELECT 'tag', CAST(tag_id AS VARCHAR), NULL, NULL, count(*) FROM t GROUP BY tag_id""",
)


def _table(c, field: str, columns: tuple[str, ...] = ()):
    return orderstats.build(c.photos, field, f"{shared_folder(c.spark)}/order-{uuid.uuid4().hex}", columns)


def _pages(c):
    """A page three fifths down each of the ten orders."""
    out = []
    for field in gallery.ORDERS:
        laid = _table(c, field)
        start = laid.total() * 3 // 5
        for ascending in (True, False):
            page = laid.page(ascending, 100, start).select("id")
            out.append(page.select(F.lit(f"{field} {'asc' if ascending else 'desc'}").alias("page"), "id"))
    return reduce(lambda a, b: a.unionByName(b), out)


_ORDERED = "\nUNION ALL ".join(
    f"SELECT '{field} {'asc' if asc else 'desc'}' AS page, id FROM (SELECT id, row_number() OVER (ORDER BY {', '.join(x + (' ASC NULLS FIRST' if asc else ' DESC NULLS LAST') for x in cols)}) - 1 AS k, count(*) OVER () * 3 // 5 AS start FROM photos) WHERE k >= start AND k < start + 100"
    for field, cols in gallery.ORDERS.items()
    for asc in (True, False)
)
book.add("pages_by_ranges", _pages, _ORDERED)

_DATES = {
    "month desc": ((1996, 5, False), "year > 1996 OR (year = 1996 AND month > 5)"), "no month desc": ((1996, "none", False), "year > 1996 OR (year = 1996 AND month IS NOT NULL)"), "undated desc": ((None, None, False), "year IS NOT NULL"),
    "month asc": ((1996, 5, True), "year IS NULL OR year < 1996 OR (year = 1996 AND (month IS NULL OR month < 5))"), "year asc": ((1996, None, True), "year IS NULL OR year < 1996"),
}


def _positions(c):
    laid = _table(c, "date")
    return reduce(lambda a, b: a.unionByName(b), [laid.position(*args).select(F.lit(name).alias("place"), "n") for name, (args, _) in _DATES.items()])


book.add("positions_by_ranges", _positions, "\nUNION ALL ".join(f"SELECT '{name}' AS place, count(*) AS n FROM photos WHERE {cond}" for name, (_, cond) in _DATES.items()))
