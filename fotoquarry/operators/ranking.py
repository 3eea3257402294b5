"""Row numbers over whole tables, by ranges instead of one window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.session import durable


def ranked(rows: DataFrame, order: list[Column], names: tuple[str, ...] = ("rank", "total")) -> DataFrame:
    """``rows`` with their place from 0 in the order, and the number of all rows.

    Rows are dealt out by ranges of the order, numbered within their range, and the ranges'
    totals are added: a row a range, as many as there are shuffle partitions. The ranges are
    kept, since their bounds are drawn by sampling. The order must have no ties.
    """
    rank, total = names
    dealt = rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    dealt = durable(dealt)
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sizes = sizes.select(F.col("_range").alias("_r"), F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"), F.sum("_size").over(every).alias(total))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return dealt.withColumn(rank, place).join(F.broadcast(sizes), F.col("_range") == F.col("_r")).withColumn(rank, (F.col(rank) + F.col("_before")).cast("long")).drop("_range", "_r", "_before")
