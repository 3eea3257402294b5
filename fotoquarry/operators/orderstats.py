"""Order statistics: photos laid out by ranges of an order, with the number of rows before each.

A page at any offset, the row number of a photo and the place of a date read the one or two ranges
that hold them. A descending order is an ascending one read backwards, so five layouts serve ten orders.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .gallery import ORDERS, before_date, order_by

#: Rows of a range: the given number, but at least ``SHARE`` ranges where the table is small.
RANGE_ROWS, SHARE, LEAST = 65_536, 200, 256


def range_rows(total: int) -> int:
    """How many rows a range should hold in a table of so many."""
    return min(RANGE_ROWS, max(LEAST, total // SHARE))


@dataclass(frozen=True)
class OrderTable:
    """One order of a table: ``rows`` partitioned by range, and ``sizes`` (part, n, before, first, last), a row a range.

    ``first`` and ``last`` are the key structs at a range's ends.
    """

    field: str
    rows: DataFrame
    sizes: DataFrame

    def _key(self) -> Column:
        return F.struct(*ORDERS[self.field])

    def _read(self, parts: list[int]) -> DataFrame:
        return self.rows.where(F.col("part").isin(parts)) if parts else self.rows.where(F.lit(False))

    def total(self) -> int:
        return self.sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def page(self, ascending: bool, limit: int, offset: int = 0) -> DataFrame:
        """The rows from ``offset`` on in the order, ``limit`` at most; a negative limit is none.

        The driver learns only the numbers of the ranges that the page covers.
        """
        total = self.total()
        offset = max(0, offset)
        end = total if limit < 0 else min(total, offset + limit)
        low, high = (offset, end) if ascending else (total - end, total - offset)
        if low >= high:
            return self.rows.where(F.lit(False)).drop("part")
        parts = self.sizes.where((F.col("before") < high) & (F.col("before") + F.col("n") > low)).select("part", "before", "n").orderBy("before").collect()
        skip = low - parts[0]["before"] if ascending else parts[-1]["before"] + parts[-1]["n"] - high
        return self._read([r["part"] for r in parts]).drop("part").orderBy(*order_by(self.field, ascending)).offset(skip).limit(high - low)

    def place(self, photo: dict, ascending: bool) -> int | None:
        """The row number from 1 of the photo with these keys, None if there is none: reads the range that holds it."""
        key = F.struct(*[F.lit(photo[c]).cast(self.rows.schema[c].dataType).alias(c) for c in ORDERS[self.field]])
        at = self.sizes.where((F.col("first") <= key) & (F.col("last") >= key)).select("part", "before").first()
        if at is None:
            return None
        own = self._read([at["part"]]).agg(F.count_if(self._key() < key).alias("less"), F.count_if(self._key() == key).alias("there")).first()
        if not own["there"]:
            return None
        before = at["before"] + own["less"]
        return before + 1 if ascending else self.total() - before

    def position(self, year: int | None, month: int | str | None, ascending: bool) -> DataFrame:
        """(n) as ``gallery.position`` counts it: whole ranges by their ends, rows only of those that the date divides.

        The order must begin with year and month.
        """
        if ORDERS[self.field][:2] != ("year", "month"):
            raise ValueError(f"{self.field} is no order by date")
        before = F.coalesce(before_date(year, month, ascending), F.lit(False))
        ends = [self.sizes.select("part", "n", f"{end}.year", f"{end}.month").select("part", "n", before.alias(end)) for end in ("first", "last")]
        known = ends[0].join(ends[1].drop("n"), "part")
        divided = [r[0] for r in known.where("first <> last").select("part").collect()]  # one at the most: rows before a date are a prefix or a suffix
        whole = known.where("first AND last").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("whole"))
        return self._read(divided).agg(F.count_if(before).alias("some")).join(whole).select((F.col("whole") + F.col("some")).cast("long").alias("n"))


def build(photos: DataFrame, field: str, folder: str, columns: tuple[str, ...] | None = None, rows_a_range: int | None = None) -> OrderTable:
    """Lay ``photos`` out in ``folder`` by ranges of an order, with the given columns beside its own (all if None).

    Ranges are drawn by sampling, so their sizes vary; they are counted from what was written.
    Nothing is collected but the number of all rows. The folder must be one that executors share.
    """
    keys = ORDERS[field]
    named = photos.columns if columns is None else list(dict.fromkeys([*keys, *columns]))
    total = photos.count()
    ranges = max(1, -(-total // (rows_a_range or range_rows(total))))
    order = order_by(field, True)
    dealt = photos.select(*named).repartitionByRange(ranges, *order).withColumn("part", F.spark_partition_id()).sortWithinPartitions("part", *order)
    dealt.write.mode("overwrite").partitionBy("part").parquet(f"{folder}/rows")
    spark = photos.sparkSession
    schema = photos.select(*named).withColumn("part", F.lit(0)).schema
    rows = spark.read.schema(schema).parquet(f"{folder}/rows") if total else spark.createDataFrame([], schema)
    key = F.struct(*keys)
    sizes = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first"), F.max(key).alias("last"))
    above = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    sizes.withColumn("before", F.coalesce(F.sum("n").over(above), F.lit(0))).coalesce(1).write.mode("overwrite").parquet(f"{folder}/sizes")
    return OrderTable(field, rows, spark.read.parquet(f"{folder}/sizes"))
