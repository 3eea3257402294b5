"""Queries that run as streams: each writes its input in parts, runs from one checkpoint, and returns what came out."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import snapshots
from ..streaming import stateful
from .define import Book
from .session import shared_folder
from .upkeep import ANSWERS_CTE, answers

book = Book()


def _folder(c) -> str:
    return f"{shared_folder(c.spark)}/stream-{uuid.uuid4().hex}"


def _listing(c) -> DataFrame:
    """The photos as one snapshot, the scan as the next, with a restart between them."""
    top, buckets = _folder(c), 8
    for rows in (c.photos.select("path", F.col("filesize").alias("size"), "mtime"), c.scan):
        snapshots.take_snapshot(rows, f"{top}/lists", buckets)
        stream = snapshots.listing_changes(c.spark, f"{top}/lists", buckets)
        stream.writeStream.format("parquet").option("path", f"{top}/out").option("checkpointLocation", f"{top}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return c.spark.read.schema(snapshots.SCHEMA).parquet(f"{top}/out").select("path", "change", "size", "snapshot")


book.add(
    "streamed_listing_changes",
    _listing,
    """WITH p AS (SELECT path, filesize, mtime FROM photos QUALIFY row_number() OVER (PARTITION BY path ORDER BY mtime DESC NULLS LAST, filesize DESC NULLS LAST) = 1), s AS (SELECT * FROM scan QUALIFY row_number() OVER (PARTITION BY path ORDER BY mtime DESC NULLS LAST, size DESC NULLS LAST) = 1)
    SELECT path, 'added' AS change, filesize AS size, CAST(1 AS BIGINT) AS snapshot FROM p
    UNION ALL SELECT coalesce(s.path, p.path), CASE WHEN p.path IS NULL THEN 'added' WHEN s.path IS NULL THEN 'removed' ELSE 'changed' END, s.size, 2 FROM p FULL OUTER JOIN s ON s.path = p.path WHERE p.path IS NULL OR s.path IS NULL OR s.size IS DISTINCT FROM p.filesize OR s.mtime IS DISTINCT FROM p.mtime""",
)


def _in_parts(c, parts: list[DataFrame], operator) -> DataFrame:
    """The rows that a stream with state gives for each part, a batch each; ``batch`` is the part's number."""
    top, out = _folder(c), None
    for k, rows in enumerate(parts):
        rows.write.parquet(f"{top}/in/part={k}")
        stream = c.spark.readStream.schema(rows.schema).parquet(f"{top}/in/part=*").drop("part")
        save = lambda b, epoch, k=k: b.write.mode("overwrite").parquet(f"{top}/out/batch={k}")
        # Such streams have no last batch; one takes all that is there.
        operator(stream).writeStream.outputMode("update").option("checkpointLocation", f"{top}/checkpoint").trigger(once=True).foreachBatch(save).start().awaitTermination()
        part = c.spark.read.parquet(f"{top}/out/batch={k}").withColumn("batch", F.lit(k).cast("long"))
        out = part if out is None else out.unionByName(part)
    return out


book.add(
    "streamed_answers",
    lambda c: _in_parts(c, [answers(c).where("seq % 2 = 0"), answers(c).where("seq % 2 = 1")], stateful.answers_that_hold),
    f"""WITH {ANSWERS_CTE}, early AS (SELECT tag_id, photo_id, arg_max(answer, (ts, seq)) AS answer, arg_max(seq, (ts, seq)) AS seq FROM a WHERE seq % 2 = 0 GROUP BY 1, 2), every AS (SELECT tag_id, photo_id, arg_max(answer, (ts, seq)) AS answer, arg_max(seq, (ts, seq)) AS seq FROM a GROUP BY 1, 2)
    SELECT tag_id, photo_id, answer, CAST(NULL AS VARCHAR) AS before, seq, CAST(0 AS BIGINT) AS batch FROM early UNION ALL SELECT every.tag_id, every.photo_id, every.answer, early.answer, every.seq, 1 FROM every LEFT JOIN early ON early.tag_id = every.tag_id AND early.photo_id = every.photo_id WHERE early.seq IS DISTINCT FROM every.seq""",
)
_requests = lambda c: c.photos.select("folder", (F.col("rating") >= 4).alias("force"), (F.col("id") % 9 == 0).alias("done"), F.col("id").alias("seq"))
book.add(
    "streamed_requests",
    lambda c: _in_parts(c, [_requests(c)], stateful.pending_requests).drop("batch"),
    """WITH r AS (SELECT folder, rating >= 4 AS force, id AS seq, count(*) FILTER (WHERE id % 9 = 0) OVER (PARTITION BY folder ORDER BY id) AS run, id % 9 = 0 AS done FROM photos),
      o AS (SELECT *, row_number() OVER (PARTITION BY folder, run ORDER BY seq) AS k, row_number() OVER (PARTITION BY folder, run, force ORDER BY seq) AS f FROM r WHERE NOT done) SELECT folder, force, seq FROM o WHERE k = 1 OR force AND f = 1""",
)
