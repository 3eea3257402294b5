"""Queries of perceptual fingerprints, on the grey pictures of the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import duplicates as D
from ..operators import gallery
from ..operators import perceptual as P
from .define import Book
from .gallery import HID

book = Book()

_hashes = lambda c: P.perceptual_hashes(P.text_pictures(c.base("documents")))
_SQL = """WITH w AS (SELECT doc_id AS id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS w FROM documents),
  g AS (SELECT id, CAST('0x' || substr(md5(w), 1, 3) AS BIGINT) >> 2 AS cell, least(255, 16 * count(*)) AS v FROM w GROUP BY ALL),
  said AS (SELECT id, 1024 * sum(v * v) - sum(v) * sum(v) < 16 * 1024 * 1024 AS flat FROM g GROUP BY id),
  across AS (SELECT id, cell // 32 AS y, u, sum(v * cos(pi() * (2 * (cell % 32) + 1) * u / 64)) AS s FROM g, range(8) r(u) GROUP BY ALL),
  low AS (SELECT id, list(round(s, 6) ORDER BY t, u) AS low FROM (SELECT id, t, u, sum(s * cos(pi() * (2 * y + 1) * t / 64)) AS s FROM across, range(8) r(t) GROUP BY ALL) GROUP BY id),
  bits AS (SELECT id, list_reduce(list_transform(low, lambda x: CAST(CASE WHEN x > list_sort(low[2:64])[32] THEN 1 ELSE 0 END AS BIGINT)), lambda a, y: (a & 4611686018427387903) * 2 + y + CASE WHEN (a >> 62) & 1 = 1 THEN -9223372036854775808 ELSE 0 END) AS b FROM low),
  hashed AS (SELECT DISTINCT doc_id AS id, CASE WHEN coalesce(flat, true) THEN CAST(0 AS BIGINT) WHEN b = 0 THEN 1 ELSE b END AS h FROM documents LEFT JOIN said ON said.id = doc_id LEFT JOIN bits ON bits.id = doc_id)"""
book.add("picture_hashes", _hashes, f"{_SQL} SELECT id, h FROM hashed")


def _known(c):
    """Photos of which two thirds have their fingerprint."""
    old = _hashes(c).where("id % 3 <> 0").select(F.col("id").alias("_d"), F.col("h").alias("phash"))
    return gallery.with_hidden(c.photos, c.tags, c.photo_tags).join(old, F.col("id") == F.col("_d"), "left").drop("_d")


book.add("picture_worklist", lambda c: P.needs_fingerprint(_known(c)).select("id", "path"), f"{_SQL} SELECT id, path FROM photos WHERE id NOT IN (SELECT id FROM hashed WHERE id % 3 <> 0) AND id NOT IN {HID}")
book.add("picture_hashes_set", lambda c: P.with_fingerprints(_known(c), _hashes(c).join(P.needs_fingerprint(_known(c)).select("id"), "id", "left_semi")).select("id", F.col("phash").cast("string").alias("phash")), f"{_SQL} SELECT photos.id, CAST(CASE WHEN photos.id % 3 <> 0 OR photos.id NOT IN {HID} THEN h END AS VARCHAR) AS phash FROM photos LEFT JOIN hashed ON hashed.id = photos.id")
for _name, _d in D.SENSITIVITY.items():
    book.add(
        f"near_pictures_{_name}",
        lambda c, d=_d: D.near_pairs(_hashes(c), d).select("a", "b", F.col("distance").cast("long").alias("distance")),
        f"""{_SQL}, one AS (SELECT h, min(id) AS id FROM hashed WHERE h <> 0 GROUP BY h) SELECT least(p.id, q.id) AS a, greatest(p.id, q.id) AS b, CAST(bit_count(xor(p.h, q.h)) AS BIGINT) AS distance FROM one p JOIN one q ON p.h < q.h AND bit_count(xor(p.h, q.h)) <= {_d}
         UNION ALL SELECT one.id, hashed.id, CAST(0 AS BIGINT) FROM hashed JOIN one ON hashed.h = one.h AND hashed.id > one.id""",
    )
_GROUPS = f"""WITH RECURSIVE {_SQL[5:]}, o AS MATERIALIZED (SELECT id, h, row_number() OVER (ORDER BY id) AS k FROM hashed WHERE h <> 0),
  step(k, id, leader, centres) AS (SELECT CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST([] AS STRUCT(id BIGINT, h BIGINT)[])
    UNION ALL SELECT k, id, coalesce(near, id), CASE WHEN near IS NULL THEN list_append(centres, {{'id': id, 'h': h}}) ELSE centres END
    FROM (SELECT o.k, o.id, o.h, step.centres, list_filter(step.centres, lambda c: bit_count(xor(c.h, o.h)) <= 8)[1].id AS near FROM step JOIN o ON o.k = step.k + 1)),
  led AS (SELECT id, leader FROM (SELECT id, leader, count(*) OVER (PARTITION BY leader) AS n FROM step WHERE k > 0) WHERE n > 1)"""
book.add("picture_leaders", lambda c: D.leader_groups(_hashes(c), 8), f"{_GROUPS} SELECT id, leader FROM led")
book.add(
    "picture_groups",
    lambda c: D.similar_groups(gallery.with_hidden(c.photos, c.tags, c.photo_tags), D.leader_groups(_hashes(c), 8)),
    f"""{_GROUPS}, y AS (SELECT leader, count(*) AS n, CAST(sum(filesize) AS BIGINT) AS size, min(path) AS first_path, bool_or(p.id IN {HID}) AS hid, count(DISTINCT md5) AS m, count(*) FILTER (WHERE md5 IS NULL) AS nulls FROM led JOIN photos p ON p.id = led.id GROUP BY leader)
     SELECT leader, n, size, first_path FROM y WHERE n > 1 AND NOT hid AND NOT (m = 1 AND nulls = 0)""",
)
