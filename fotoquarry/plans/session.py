"""Session settings that operators need."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``, which driver and executors share; see ``durable``."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="fotoquarry-"))
    return sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """A checkpoint in the session's ``spark.checkpoint.dir``; a folder of our own only where none is set and all runs in one process (tests)."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def durable_afresh(df: DataFrame) -> DataFrame:
    """``durable`` for loops: without Spark's estimate of the size, which a checkpoint inherits and joins of one round multiply for the next."""
    kept = durable(df)
    return DataFrame(df.sparkSession._jsparkSession.createDataFrame(kept._jdf.toJavaRDD(), kept._jdf.schema()), df.sparkSession)
