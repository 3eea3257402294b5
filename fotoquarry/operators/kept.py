"""Kept counts: timelines, folders, roots and tags counted once, then moved by signed changes.

A change is given by the rows that it takes away and the rows that it brings (``signed``); their
counts, merged into the kept ones, are the counts after the change. What did not change is not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from .aggregates import ancestor_folders, folder_column

#: What a kept count is of: photos of a month, in a folder, in it and below, of a root; pairs of a tag.
KINDS = ("month", "folder", "below", "root", "tag")
SCHEMA = "kind string, name string, year int, month int, n long"
_KEY = ("kind", "name", "year", "month")


def signed(before: DataFrame | None, after: DataFrame | None) -> DataFrame:
    """The rows before a change with sign -1 and those after it with sign 1; either may be left out."""
    parts = [rows.withColumn("sign", F.lit(sign)) for rows, sign in ((before, -1), (after, 1)) if rows is not None]
    if not parts:
        raise ValueError("a change has rows before or after it")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def photo_deltas(changes: DataFrame) -> DataFrame:
    """Counts by month, folder, folder with all below and root of signed photos (folder or path, year, month, sign).

    Photos are summed by folder and month first, so that ancestors are made for few rows. A null
    sign counts nothing; a photo without a folder counts in its month alone.
    """
    base = changes.groupBy(folder_column(changes).alias("folder"), F.col("year").cast("int").alias("year"), F.col("month").cast("int").alias("month")).agg(F.sum("sign").alias("n")).where("n <> 0")
    none = F.lit(None).cast("int")
    key = lambda kind, name, year=none, month=none: F.struct(F.lit(kind).alias("kind"), name.cast("string").alias("name"), year.alias("year"), month.alias("month"))
    folder = F.col("folder")
    of_folder = F.concat(F.array(key("folder", folder), key("root", S.root_of(folder))), F.transform(ancestor_folders(folder), lambda above: key("below", above)))
    of_month = F.array(key("month", F.lit(None), F.col("year"), F.col("month")))
    keys = F.when(folder.isNull(), of_month).otherwise(F.concat(of_month, of_folder))
    return merged(base.select(F.explode(keys).alias("k"), "n").select("k.*", "n"))


def tag_deltas(changes: DataFrame) -> DataFrame:
    """Counts by tag of signed pairs (tag_id, sign); pairs without a tag count nothing."""
    n = changes.where("tag_id IS NOT NULL").groupBy("tag_id").agg(F.sum("sign").alias("n"))
    none = F.lit(None).cast("int")
    return n.where("n <> 0").select(F.lit("tag").alias("kind"), F.col("tag_id").cast("string").alias("name"), none.alias("year"), none.alias("month"), F.col("n").cast("long").alias("n"))


def merged(*counts: DataFrame) -> DataFrame:
    """The sum of counts; keys whose count is zero go."""
    every = reduce(lambda a, b: a.unionByName(b), counts)
    return every.groupBy(*_KEY).agg(F.sum("n").cast("long").alias("n")).where("n <> 0")


def deltas(photos: DataFrame | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """The counts of signed photos and signed pairs together."""
    parts = [make(rows) for rows, make in ((photos, photo_deltas), (pairs, tag_deltas)) if rows is not None]
    if not parts:
        raise ValueError("neither photos nor pairs changed")
    return reduce(lambda a, b: a.unionByName(b), parts)


class KeptCounts:
    """Counts in a folder that driver and executors share, one version after another.

    A version is there once Spark has committed it; one left half-written by a lost job is
    written again. A version that is there already is not applied twice, so a batch of a stream
    may be repeated. The last ``keep`` versions stay for readers that began before.
    """

    def __init__(self, spark: SparkSession, folder: str, keep: int = 2) -> None:
        self.spark, self.folder, self.keep = spark, folder.rstrip("/"), max(1, keep)
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, version: int) -> str:
        return f"{self.folder}/v{version:012d}"

    def versions(self) -> list[int]:
        """The versions that can be read, oldest first."""
        home = self._path(self.folder)
        names = [s.getPath().getName() for s in self._fs.listStatus(home)] if self._fs.exists(home) else []
        found = [int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit()]
        return sorted(v for v in found if self._fs.exists(self._path(f"{self._at(v)}/_SUCCESS")))

    def read(self, version: int | None = None) -> DataFrame:
        """The counts (kind, name, year, month, n) of a version, the last one if none is named."""
        if version is None:
            there = self.versions()
            if not there:
                raise FileNotFoundError(f"no counts in {self.folder}")
            version = there[-1]
        return self.spark.read.schema(SCHEMA).parquet(self._at(version))

    def apply(self, version: int, photos: DataFrame | None = None, pairs: DataFrame | None = None) -> DataFrame:
        """The counts after the signed changes of a version; version 0 starts from nothing and is all rows with sign 1."""
        there = self.versions()
        if there and version <= there[-1]:
            return self.read()
        if version != (there[-1] + 1 if there else 0):
            raise ValueError(f"version {version} does not follow {there[-1] if there else 'an empty folder'}")
        new = deltas(photos, pairs)
        after = merged(self.read(there[-1]), new) if there else merged(new)
        after.coalesce(max(1, self.spark.sparkContext.defaultParallelism)).write.mode("overwrite").parquet(self._at(version))
        for old in self.versions()[: -self.keep]:
            self._fs.delete(self._path(self._at(old)), True)
        return self.read(version)


def timeline(counts: DataFrame) -> DataFrame:
    """(year, month, n) as ``aggregates.timeline`` counts it."""
    return counts.where("kind = 'month'").select("year", "month", "n")


def folder_tree(counts: DataFrame) -> DataFrame:
    """(folder, own, total) as ``aggregates.folder_tree`` counts it."""
    c = counts.where("kind IN ('folder', 'below')").groupBy(F.col("name").alias("folder"))
    own, total = (F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(a) for k, a in (("folder", "own"), ("below", "total")))
    return c.agg(own, total)


def root_counts(counts: DataFrame) -> DataFrame:
    return counts.where("kind = 'root'").select(F.col("name").alias("root"), "n")


def tag_counts(counts: DataFrame) -> DataFrame:
    return counts.where("kind = 'tag'").select(F.col("name").cast("int").alias("tag_id"), "n")
