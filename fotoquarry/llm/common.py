"""Helpers shared by the corpus operators: reading, reliable checkpoints, components."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts per Arrow batch. Documents can be long, so a batch is kept to a few MB.
ARROW_ROWS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if spark.sparkContext.master.startswith("local"):
        # Workers on this machine find the package here; on a cluster it is installed or sent with the job.
        spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Bound what a Python worker holds at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that driver and executors share.

    The folder is the session's ``spark.checkpoint.dir``; a folder of our own is set only
    where neither that setting nor ``setCheckpointDir`` has named one and everything runs in
    one process (tests). On a cluster that is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="fotoquarry-"))
    return sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the folder that all executors share."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def durable_afresh(df: DataFrame) -> DataFrame:
    """``durable`` for loops: also cut off is Spark's estimate of the size, which a checkpoint inherits.

    A join multiplies the estimates of both sides. Rounds of joins square it again and again, until
    the driver has no memory or time left for its digits.
    """
    kept = durable(df)
    return DataFrame(df.sparkSession._jsparkSession.createDataFrame(kept._jdf.toJavaRDD(), kept._jdf.schema()), df.sparkSession)


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage of a wide table: Parquet in the shared folder, read again."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the files of a table that ``written`` made and nothing needs any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/table-" in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of finished jobs now; it does so when nothing refers to them after a collection of garbage."""
    gc.collect()
    spark._jvm.System.gc()


def boxed(docs: DataFrame, *needed: str) -> tuple[DataFrame, dict[str, str], list[str]]:
    """(docs with columns x0, x1, ..., the places of the needed columns, the places of all).

    An operator that keeps its caller's columns works on these names, so that its own can
    clash with none of them, whatever they are; ``toDF(*docs.columns)`` brings the names back.
    """
    places = [f"x{k}" for k in range(len(docs.columns))]
    return docs.toDF(*places), {n: places[docs.columns.index(n)] for n in needed}, places


def any_row(df: DataFrame) -> bool:
    return df.limit(1).count() > 0


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that is not the smallest of its connected component.

    ``edges`` has the columns a and b; nulls and loops are ignored. Contraction: each node
    hooks to its smallest smaller neighbour, pointer jumping turns the hooks into stars, the
    edges are relabelled by star centre and the round repeats until none is left. Rounds and
    jumps grow with the logarithm of the component, every step is a join or a combinable
    aggregate, and nothing is collected.
    """
    lo, hi = F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")
    left = durable_afresh(edges.where("a <> b").select(hi, lo).distinct())
    roots = None
    while any_row(left):
        hook = durable_afresh(left.groupBy("a").agg(F.min("b").alias("p")))
        while True:
            up = hook.select(F.col("a").alias("u"), F.col("p").alias("pp"))
            hook = durable_afresh(hook.join(up, hook.p == up.u, "left").select("a", F.coalesce("pp", "p").alias("p"), F.col("pp").isNotNull().alias("moved")))
            moved = any_row(hook.where("moved"))
            hook = hook.select("a", "p")
            if not moved:
                break
        if roots is None:
            roots = hook.select(F.col("a").alias("node"), F.col("p").alias("root"))
        else:
            roots = durable_afresh(
                roots.join(hook, roots.root == hook.a, "left").select("node", F.coalesce("p", "root").alias("root")).unionByName(hook.select(F.col("a").alias("node"), F.col("p").alias("root")))
            )
        ra, rb = hook.select(F.col("a").alias("ka"), F.col("p").alias("pa")), hook.select(F.col("a").alias("kb"), F.col("p").alias("pb"))
        new = left.join(ra, left.a == ra.ka, "left").join(rb, left.b == rb.kb, "left").select(F.coalesce("pa", "a").alias("x"), F.coalesce("pb", "b").alias("y"))
        left = durable_afresh(new.where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct())
    if roots is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots
