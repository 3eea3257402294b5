"""Change events: debouncing, routing, windows, answers and incremental ingest as streams.

Every function takes a batch or a streaming DataFrame of events, except where it says so.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import maintenance


def with_time(events: DataFrame, late: str | None = None) -> DataFrame:
    """ts as a timestamp; on a stream with the lateness that is still taken."""
    out = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return out.withWatermark("ts", late) if late else out


def debounced(events: DataFrame, quiet: str = "30 seconds", by: str = "root") -> DataFrame:
    """(root, first, fires_at, n): one row once a root has been quiet for so long."""
    g = events.groupBy(by, F.session_window("ts", quiet).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return g.select(by, F.col("w.start").alias("first"), F.col("w.end").alias("fires_at"), "n")


#: Watched roots at the most.
MOST_ROOTS = 10_000


def routed(events: DataFrame, roots: DataFrame) -> DataFrame:
    """Events (path, …) with the longest watched root they are in; others go.

    The roots are a setting, ``MOST_ROOTS`` at the most; they go to all tasks as one row, and an
    event finds its root within its own row, so that repeated events stay and a stream keeps no
    state. Null and repeated roots count once.
    """
    known = roots.where("root IS NOT NULL").select(F.lower(F.regexp_replace("root", r"\\+$", "")).alias("key"), "root").groupBy("key").agg(F.min("root").alias("root"))
    if known.limit(MOST_ROOTS + 1).count() > MOST_ROOTS:
        raise ValueError(f"over {MOST_ROOTS} roots")
    row = known.agg(F.collect_list(F.struct(F.length("key").alias("long"), "key", "root")).alias("_roots"))
    path = F.lower(F.col("path"))
    inside = F.filter("_roots", lambda r: F.startswith(path, F.concat(r["key"], F.lit("\\"))))
    return events.join(F.broadcast(row)).withColumn("root", F.array_max(inside)["root"]).where("root IS NOT NULL").drop("_roots")


def tumbling(events: DataFrame, width: str = "1 hour", slide: str | None = None, by: str = "root") -> DataFrame:
    """(root, start, n): events a window."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.groupBy(by, w.alias("w")).agg(F.count(F.lit(1)).alias("n")).select(by, F.col("w.start").alias("start"), "n")


def coalesced(requests: DataFrame) -> DataFrame:
    """(folder, force, n): pending requests of a micro-batch, one a folder; forced if any is."""
    return requests.groupBy("folder").agg(F.bool_or("force").alias("force"), F.count(F.lit(1)).alias("n"))


def distinct_requests(requests: DataFrame) -> DataFrame:
    """On a stream with a watermark: a folder's repeated requests within it go."""
    return requests.dropDuplicatesWithinWatermark(["folder", "force"])


ANSWER = "tag_id int, photo_id long, answer string, seq long"


def latest_answers_stream(answers: DataFrame) -> DataFrame:
    """Stream of the answer that holds now for each (tag_id, photo_id) with news; the state is one answer a pair."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def update(key, batches, state):
        at, answer, seq = state.get if state.exists else (None, None, None)
        for pdf in batches:
            for ts, a, s in zip(pdf["ts"], pdf["answer"], pdf["seq"]):
                now = ts.timestamp()
                if at is None or (now, s) >= (at, seq):
                    at, answer, seq = now, a, int(s)
        state.update((at, answer, seq))
        yield pd.DataFrame({"tag_id": [key[0]], "photo_id": [key[1]], "answer": [answer], "seq": [seq]})

    return answers.groupBy("tag_id", "photo_id").applyInPandasWithState(update, ANSWER, "at double, answer string, seq long", "update", GroupStateTimeout.NoTimeout)


def ingest(manifests: DataFrame, catalogue: Callable[[], DataFrame], sink: Callable[[DataFrame, int], None], max_year: int):
    """A streaming writer: each micro-batch of (path, size, mtime) is compared with the catalogue as it is then; of rows that repeat a path the latest and then largest counts."""

    def batch(df: DataFrame, epoch: int) -> None:
        once = df.groupBy("path").agg(F.max(F.struct("mtime", "size")).alias("f")).select("path", "f.size", "f.mtime")
        sink(maintenance.index_diff(once, catalogue(), max_year), epoch)

    return manifests.writeStream.foreachBatch(batch)


def deltas(diff: DataFrame, photos: DataFrame, cached: DataFrame, vectors: DataFrame) -> dict[str, DataFrame]:
    """What a changed catalogue asks for: files to read, artefacts to make or remove, vectors to make."""
    keys = photos.select(S.artefact_key(F.col("path"), F.col("mtime")).alias("key"))
    from ..operators.vectors import stale_vectors

    return {"read": diff.where("action IN ('added', 'read')"), "artefacts": maintenance.worklist(keys, cached).where("action <> 'keep'"), "vectors": stale_vectors(photos, vectors)}
