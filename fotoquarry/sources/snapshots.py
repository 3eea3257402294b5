"""Changes of a file listing as a stream of its own.

A listing is kept as numbered snapshots: Parquet in hash buckets of the path, whole once Spark has
marked it so. The offsets of the stream are snapshot numbers, its rows the files that were added,
changed or removed between two of them. A bucket of both snapshots is compared in one task; the
driver looks at the names of the snapshots only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Hash buckets of a snapshot. All snapshots of a folder have as many; about a million files each are a few hundred MB.
BUCKETS = 16
SCHEMA = "path string, change string, size long, mtime double, old_size long, old_mtime double, snapshot long"


def _store(folder: str):
    """(file system, path in it) of a folder by its URI, or of a local one."""
    from pyarrow import fs

    uri = re.sub(r"^file:/+", "file:///", folder)
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), folder)


def snapshots(folder: str) -> list[int]:
    """Numbers of the snapshots that are whole, ascending."""
    from pyarrow import fs

    store, top = _store(folder)
    found = store.get_file_info(fs.FileSelector(top, allow_not_found=True))
    numbers = [(int(m[1]), f.path) for f in found if (m := re.fullmatch(r"snapshot-(\d+)", f.base_name))]
    return sorted(n for n, path in numbers if store.get_file_info(f"{path}/_SUCCESS").type == fs.FileType.File)


def take_snapshot(listing: DataFrame, folder: str, buckets: int = BUCKETS) -> int:
    """Write a listing (path, size, mtime) as the next snapshot and return its number.

    Null paths are left out; of rows that repeat a path the latest and then largest counts. One
    writer at a time; a snapshot that was not finished is written over.
    """
    number = max(snapshots(folder), default=0) + 1
    one = listing.where("path IS NOT NULL").groupBy("path").agg(F.max(F.struct(F.col("mtime").cast("double").alias("mtime"), F.col("size").cast("long").alias("size"))).alias("f"))
    rows = one.select("path", "f.size", "f.mtime", F.pmod(F.xxhash64("path"), F.lit(buckets)).alias("bucket"))
    rows.repartition(buckets, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/snapshot-{number:09d}")
    return number


class ListingChanges(DataSource):
    """``spark.readStream.format("listing_changes").option("path", folder)``; ``buckets`` as the snapshots were written."""

    @classmethod
    def name(cls) -> str:
        return "listing_changes"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> ListingReader:
        return ListingReader(self.options["path"], int(self.options.get("buckets", BUCKETS)))


class Bucket(InputPartition):
    def __init__(self, old: int, new: int, bucket: int) -> None:
        self.old, self.new, self.bucket = old, new, bucket


class ListingReader(DataSourceStreamReader):
    def __init__(self, folder: str, buckets: int) -> None:
        self.folder, self.buckets = folder, buckets

    def initialOffset(self) -> dict:
        return {"snapshot": 0}

    def latestOffset(self) -> dict:
        return {"snapshot": max(snapshots(self.folder), default=0)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        old, new = start["snapshot"], end["snapshot"]
        return [Bucket(old, new, k) for k in range(self.buckets)] if new > old else []

    def _table(self, number: int, bucket: int):
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyarrow import fs

        kind = pa.schema([("path", pa.string()), ("size", pa.int64()), ("mtime", pa.float64())])
        store, top = _store(self.folder)
        files = store.get_file_info(fs.FileSelector(f"{top}/snapshot-{number:09d}/bucket={bucket}", allow_not_found=True)) if number else []
        parts = [pq.ParquetFile(store.open_input_file(f.path)).read(columns=kind.names).cast(kind) for f in files if f.base_name.endswith(".parquet")]
        return pa.concat_tables([kind.empty_table(), *parts])

    def read(self, partition: Bucket) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        old, new = self._table(partition.old, partition.bucket), self._table(partition.new, partition.bucket)
        old = old.rename_columns(["path", "old_size", "old_mtime"]).append_column("was", pa.array([True] * len(old), pa.bool_()))
        new = new.append_column("now", pa.array([True] * len(new), pa.bool_()))
        both = new.join(old, "path", join_type="full outer")
        was, now = (pc.fill_null(both[n], False) for n in ("was", "now"))
        # Two nulls are equal, a null and a value are not.
        same = lambda a, b: pc.or_(pc.fill_null(pc.equal(both[a], both[b]), False), pc.and_(pc.is_null(both[a]), pc.is_null(both[b])))
        kept = pc.and_(pc.and_(was, now), pc.and_(same("size", "old_size"), same("mtime", "old_mtime")))
        change = pc.if_else(pc.invert(was), "added", pc.if_else(pc.invert(now), "removed", "changed"))
        out = both.append_column("change", change).append_column("snapshot", pa.array([partition.new] * len(both), pa.int64())).filter(pc.invert(kept))
        yield from out.select(["path", "change", "size", "mtime", "old_size", "old_mtime", "snapshot"]).to_batches(max_chunksize=10_000)


def listing_changes(spark: SparkSession, folder: str, buckets: int = BUCKETS) -> DataFrame:
    """The stream of changes of a folder of snapshots: path, change (added, changed or removed), size and mtime now and before, and the snapshot."""
    spark.dataSource.register(ListingChanges)
    return spark.readStream.format(ListingChanges.name()).option("path", folder).option("buckets", buckets).load()
