"""The catalogue tables, derived from the given ones by SQL that Spark and DuckDB both run.

The texts name their inputs in braces: Spark fills in DataFrames, DuckDB plain names.
"""

from __future__ import annotations

import re
from functools import cached_property
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

BASE = ("orders", "part", "lineitem", "events", "embeddings")

VIEWS = {
    "photos": r"""
SELECT b.*, concat(b.folder, b.filename) AS path FROM (
SELECT o_orderkey AS id,
  concat(CASE o_custkey % 3 WHEN 0 THEN concat('G:', chr(92)) WHEN 1 THEN concat('D:', chr(92))
         ELSE concat(chr(92), chr(92), 'nas', chr(92), 'fotos', chr(92)) END,
         'Fotos', chr(92), CAST(year(o_orderdate) AS STRING), chr(92),
         'Brand ', CAST(o_custkey % 25 + 1 AS STRING), ' trip', chr(92)) AS folder,
  CASE o_orderkey % 6
    WHEN 0 THEN concat('IMG_', ymd, '_', CAST(o_orderkey AS STRING), '.jpg')
    WHEN 1 THEN concat(substr(ymd,1,4), '-', substr(ymd,5,2), '-', substr(ymd,7,2), ' foto ', CAST(o_orderkey AS STRING), '.jpg')
    WHEN 2 THEN concat('IMG-', ymd, '-WA', lpad(CAST(o_orderkey % 10000 AS STRING), 4, '0'), '.jpg')
    WHEN 3 THEN concat('DSC', lpad(CAST(o_orderkey AS STRING), 5, '0'), '.jpg')
    WHEN 4 THEN concat('VID_', ymd, '_', CAST(o_orderkey AS STRING), '.mp4')
    ELSE concat('wallpaper_1920x1080_', CAST(o_orderkey AS STRING), '.png') END AS filename,
  CASE WHEN o_orderkey % 6 = 4 THEN 'video' ELSE 'image' END AS media_type,
  CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE CAST(year(o_orderdate) AS INT) END AS year,
  CASE WHEN o_orderkey % 97 = 0 OR o_orderkey % 41 = 0 THEN NULL ELSE CAST(month(o_orderdate) AS INT) END AS month,
  CAST(floor(o_totalprice) AS BIGINT) AS filesize,
  CASE WHEN o_orderkey % 89 = 0 THEN NULL ELSE CAST(CASE o_orderkey % 4 WHEN 0 THEN 4000 WHEN 1 THEN 3000 WHEN 2 THEN 1000 ELSE 800 END AS BIGINT) END AS width,
  CASE WHEN o_orderkey % 89 = 0 THEN NULL ELSE CAST(CASE o_orderkey % 4 WHEN 0 THEN 3000 WHEN 1 THEN 4000 WHEN 2 THEN 990 ELSE 600 END AS BIGINT) END AS height,
  CASE WHEN o_orderkey % 6 = 4 THEN CAST(o_orderkey % 900 AS DOUBLE) END AS duration,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE md5(concat(CAST(o_custkey % 500 AS STRING), '-', CAST(CAST(floor(o_totalprice / 1000) AS BIGINT) AS STRING))) END AS md5,
  o_orderdate AS added_at,
  CASE WHEN o_orderkey % 53 = 0 THEN NULL ELSE CAST(1500000000 + o_orderkey * 60 AS DOUBLE) END AS mtime,
  CASE substr(o_orderpriority,1,1) WHEN '1' THEN 5 WHEN '2' THEN 4 WHEN '3' THEN 3 WHEN '5' THEN 1 ELSE 0 END AS rating,
  (o_orderstatus = 'P' AND o_orderkey % 10 = 0) AS favorite,
  CASE o_orderkey % 20 WHEN 0 THEN concat('nota ', o_orderstatus) WHEN 1 THEN '' ELSE NULL END AS note
FROM (SELECT *, concat(CAST(year(o_orderdate) AS STRING), lpad(CAST(month(o_orderdate) AS STRING),2,'0'), lpad(CAST(day(o_orderdate) AS STRING),2,'0')) AS ymd FROM {orders}) o) b""",
    "tags": r"""
SELECT n AS id, concat('brand#', CAST(n AS STRING)) AS name, concat('cat', CAST(n % 5 AS STRING)) AS category,
  '#4A9EFF' AS color, n = 13 AS hidden, n = 7 AS sidebar_hidden,
  CASE WHEN n < 4 THEN NULL ELSE CAST(floor(n / 3) AS INT) END AS parent_id
FROM (SELECT DISTINCT CAST(substr(p_brand, 7) AS INT) AS n FROM {part}) t""",
    "categories": r"""
SELECT DISTINCT category AS name FROM {tags}""",
    "photo_tags": r"""
SELECT DISTINCT l_orderkey AS photo_id, CAST(substr(p_brand, 7) AS INT) AS tag_id FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""",
    "tag_aliases": r"""
SELECT concat('alias', CAST(n AS STRING)) AS alias, n AS tag_id FROM (SELECT DISTINCT CAST(substr(p_brand, 7) AS INT) AS n FROM {part}) t WHERE n % 4 = 0""",
    "tag_rejections": r"""
SELECT DISTINCT CAST(event_id % 25 + 1 AS INT) AS tag_id, event_id % 1500 AS photo_id FROM {events} WHERE event_type = 'error'""",
    "photo_embeddings": r"""
SELECT vec_id AS photo_id, 'm1' AS model, CAST(1500000000 + vec_id * 60 AS DOUBLE) AS mtime, embedding AS vec FROM {embeddings}""",
    "embedding_tags": r"""
SELECT vec_id AS photo_id, label AS tag_id FROM {embeddings} WHERE label >= 1""",
    "scan": r"""
SELECT path, CASE WHEN id % 11 = 0 THEN filesize + 1 ELSE filesize END AS size, CASE WHEN id % 11 = 0 OR mtime IS NULL THEN CAST(1600000000 + id AS DOUBLE) ELSE mtime END AS mtime
FROM {photos} WHERE id % 17 <> 0
UNION ALL
SELECT concat('G:', chr(92), 'Fotos', chr(92), 'new', chr(92), 'n', CAST(id AS STRING), '.jpg'), filesize, CAST(1600000000 + id AS DOUBLE) FROM {photos} WHERE id % 23 = 0""",
    "trash": r"""
SELECT id, md5(CAST(id % 5 AS STRING)) AS batch_id, concat('reason ', CAST(id % 5 AS STRING)) AS reason, added_at AS deleted_at, path, id % 3 = 0 AS tagged FROM {photos} WHERE id % 50 = 7""",
}


def _needs(name: str) -> list[str]:
    return re.findall(r"\{(\w+)\}", VIEWS[name])


class Catalog:
    """The catalogue over one folder of tables; every table is a lazy DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir
        if spark.sparkContext.master.startswith("local"):
            # Workers on this machine find the package here; on a cluster it is installed or sent with the job.
            spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _view(self, name: str) -> DataFrame:
        return self.spark.sql(VIEWS[name], **{n: getattr(self, n) if n in VIEWS else self.base(n) for n in _needs(name)})

    photos = cached_property(lambda self: self._view("photos"))
    tags = cached_property(lambda self: self._view("tags"))
    categories = cached_property(lambda self: self._view("categories"))
    photo_tags = cached_property(lambda self: self._view("photo_tags"))
    tag_aliases = cached_property(lambda self: self._view("tag_aliases"))
    tag_rejections = cached_property(lambda self: self._view("tag_rejections"))
    photo_embeddings = cached_property(lambda self: self._view("photo_embeddings"))
    embedding_tags = cached_property(lambda self: self._view("embedding_tags"))
    scan = cached_property(lambda self: self._view("scan"))
    trash = cached_property(lambda self: self._view("trash"))


def with_views(sql: str) -> str:
    """A SQL twin with the views that it names in front, for an engine that knows the base tables."""
    wanted: list[str] = []

    def want(name: str) -> None:
        for n in _needs(name):
            if n in VIEWS:
                want(n)
        if name not in wanted:
            wanted.append(name)

    for name in VIEWS:
        if re.search(rf"\b{name}\b", sql):
            want(name)
    ctes = [f"{n} AS ({VIEWS[n].format(**{k: k for k in _needs(n)})})" for n in wanted]
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return "WITH RECURSIVE " + ",\n".join([*ctes, body[len("WITH RECURSIVE") :].lstrip()])
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join([*ctes, body[len("WITH") :].lstrip()])
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body
