"""Hard negatives by zone maps over Hilbert-ordered blocks.

The candidates are ordered by label and then along a Hilbert curve through their principal
directions, cut into blocks of neighbours and written as Parquet with the number of their block. A
zone map has the smallest and the largest value of each dimension and of the label in a block.
Interval arithmetic over a zone map bounds the inner products that an anchor can have with the rows
of the block. An anchor asks for windows: the best few rows of its own label, then, for each of
these, the best few rows of other labels with scores in a range. A first pass reads, for each
window, the block of the highest bound in each zone group; its rows raise the window's lower end.
The second pass reads the blocks whose bounds still meet the window: no other block can hold a row
of the answer, so the answer is exact however the blocks lie.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, durable, small_batches, table, written

#: Rows of a block, blocks of a unit (rows that are sent together), units of a zone group, anchors of an anchor group.
BLOCK, UNIT, ZONES, ANCHORS = 64, 16, 64, 256
#: Directions and bits of the Hilbert curve, and rows (about) that the directions are learned from; they change speed only.
DIRECTIONS, BITS, SAMPLE = 8, 7, 4096
#: Inner products are exact in double precision up to this bound of their parts' sum.
EXACT = 2.0**53
_WINDOW = "array<struct<low:double,high:double>>"


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The place of each row of cells (0 to 2**bits - 1 on each of n axes) on the n-dimensional Hilbert curve.

    Gray-code form: from the highest bit down, each axis's bit decides how the lower bits of the
    first axis are inverted or swapped with its own; the transposed bits are then a Gray code.
    """
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for axis in range(n):
            set_bit = (x[axis] >> level) & 1 == 1
            swap = np.where(set_bit, 0, (x[0] ^ x[axis]) & low)
            x[0] ^= np.where(set_bit, low, swap)
            x[axis] ^= swap
    for axis in range(1, n):
        x[axis] ^= x[axis - 1]
    flip = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, 0, -1):
        flip ^= np.where((x[n - 1] >> level) & 1 == 1, (1 << level) - 1, 0)
    x ^= flip
    place = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, -1, -1):
        for axis in range(n):
            place = (place << 1) | ((x[axis] >> level) & 1)
    return place


def _matrix(column, d: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, d).astype(np.float64)


def _axes(rows: DataFrame, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(directions, low, high) from a draw of about ``SAMPLE`` rows by a hash of their ids."""
    many = rows.count()
    share = min(1.0, SAMPLE / max(many, 1))
    drawn = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 40)) < F.lit(int(share * (1 << 40)))).select("id", "q").toArrow()
    x = _matrix(drawn.column("q"), d) if drawn.num_rows > 1 else np.zeros((2, d))
    x = x[np.lexsort(x.T)]
    v = np.linalg.eigh(np.cov(x, rowvar=False).reshape(d, d))[1][:, ::-1][:, : min(d, DIRECTIONS)]
    p = x @ v
    return v, np.quantile(p, 0.01, axis=0), np.quantile(p, 0.99, axis=0)


def blocked(rows: DataFrame, d: int, block: int = BLOCK, unit: int = UNIT) -> DataFrame:
    """The rows (id, label, q of length ``d``) as a Parquet table in the order of label and curve, with their unit and block."""
    v, low, high = _axes(rows, d)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                p = _matrix(pa.chunked_array([batch.column(2)]), d) @ v
                cells = np.clip((p - low) / np.maximum(high - low, 1e-9) * (1 << BITS), 0, (1 << BITS) - 1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hilbert(cells))], ["id", "label", "q", "place"])

    placed = rows.select("id", "label", "q").mapInArrow(run, "id long, label int, q array<bigint>, place long")
    # The ids and vectors end the order, so that no place, however full, must be in one task.
    order = ["label", "place", "id", "q"]
    ranged = placed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("n", F.monotonically_increasing_id())
    part, row = F.shiftright("n", 33), F.col("n").bitwiseAND((1 << 33) - 1)
    in_unit = F.lit(block * unit)
    return written(ranged.select((part * F.lit(1 << 32) + F.floor(row / in_unit)).alias("unit"), F.floor((row % in_unit) / block).cast("int").alias("block"), "id", "label", "q"))


def zone_maps(blocks: DataFrame, d: int) -> DataFrame:
    """(unit, block, low, high, first, last): per block the ends of every dimension and of the label."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                x, at = _matrix(pa.chunked_array([batch.column(3)]), d), np.stack([batch.column(k).to_numpy() for k in (0, 1)], 1)
                label = batch.column(2).to_numpy().astype(np.int64)
                own, first = np.unique(at, axis=0, return_inverse=True)
                first = np.ravel(first)
                order = np.argsort(first, kind="stable")
                starts = np.searchsorted(first[order], np.arange(len(own)))
                ends = [f.reduceat(v[order], starts) for v in (x, label) for f in (np.minimum, np.maximum)]
                lists = [pa.array(list(e)) for e in ends[:2]]
                yield pa.RecordBatch.from_arrays([pa.array(own[:, 0]), pa.array(own[:, 1].astype(np.int32)), *lists, pa.array(ends[2]), pa.array(ends[3])], ["unit", "block", "low", "high", "first", "last"])

    parts = blocks.select("unit", "block", "label", "q").mapInArrow(run, "unit long, block int, low array<double>, high array<double>, first long, last long")
    # A block that lies in several batches has a row from each.
    ends = parts.groupBy("unit", "block").agg(F.collect_list("low").alias("low"), F.collect_list("high").alias("high"), F.min("first").alias("first"), F.max("last").alias("last"))
    over = lambda name, f: F.aggregate(F.slice(name, 2, F.greatest(F.size(name) - 1, F.lit(0))), F.col(name)[0], lambda a, b: F.zip_with(a, b, lambda x, y: f(x, y))).alias(name)
    return ends.select("unit", "block", over("low", F.least), over("high", F.greatest), "first", "last")


def bounds(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, greatest) inner product of each row with anything in each box."""
    plus, minus = np.maximum(q, 0), np.minimum(q, 0)
    least, most = plus @ low.T + minus @ high.T, plus @ high.T + minus @ low.T
    # Where doubles are not exact the bounds give way a little.
    slack = np.where((plus @ np.abs(high).T - minus @ np.abs(low).T) >= EXACT / 4, 1e-9, 0.0) * (np.abs(least) + np.abs(most))
    return least - slack, most + slack


def _windows(column) -> list[np.ndarray]:
    """(windows, 2) ends for each anchor."""
    return [np.array([[w["low"], w["high"]] for w in ws], float).reshape(-1, 2) for ws in column.to_pylist()]


def _choose(anchors, zones, d: int, same: bool, first: bool):
    """(unit, id, label, q, windows, blocks): what one anchor group must read of one zone group."""
    import pyarrow as pa

    out: dict = {n: [] for n in ("unit", "row", "blocks")}
    if anchors.num_rows and zones.num_rows:
        zones = zones.sort_by([("unit", "ascending"), ("block", "ascending")])
        q, label = _matrix(anchors.column("q"), d), anchors.column("label").to_numpy().astype(np.int64)
        low, high = _matrix(zones.column("low"), d), _matrix(zones.column("high"), d)
        least, most = bounds(q, low, high)
        la, lb = (zones.column(n).to_numpy() for n in ("first", "last"))
        may = (la <= label[:, None]) & (label[:, None] <= lb) if same else (la != label[:, None]) | (lb != label[:, None])
        unit, block = zones.column("unit").to_numpy(), zones.column("block").to_numpy()
        cuts = np.flatnonzero(np.diff(unit)) + 1
        for r, ends in enumerate(_windows(anchors.column("windows"))):
            take = np.zeros(len(unit), bool)
            for a, b in ends:
                own = may[r] & (most[r] >= a) & (least[r] <= b)
                if first and own.any():
                    take[np.argmax(np.where(own, most[r], -np.inf))] = True
                elif not first:
                    take |= own
            if take.any():
                for u, part in zip(np.split(unit, cuts), np.split(np.where(take, block, -1), cuts)):
                    if (part >= 0).any():
                        out["unit"].append(int(u[0]))
                        out["row"].append(r)
                        out["blocks"].append(part[part >= 0].tolist())
    many = lambda kind: pa.list_(pa.field("element", kind))
    kinds = {"id": pa.int64(), "label": pa.int32(), "q": many(pa.int64()), "windows": many(pa.struct([("low", pa.float64()), ("high", pa.float64())]))}
    rows = pa.array(out["row"], pa.int64())
    chosen = [anchors.column(n).take(rows).cast(t) for n, t in kinds.items()]
    return pa.table([pa.array(out["unit"], pa.int64()), *chosen, pa.array(out["blocks"], many(pa.int32()))], names=["unit", *kinds, "blocks"])


def _scores(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact whole-number inner products; beyond 2**53 by whole-number arithmetic (an error beyond a long)."""
    if not x.size or not y.size or np.abs(x).max() * np.abs(y).max() * x.shape[1] < EXACT:
        return x @ y.T
    exact = np.array([[sum(int(a) * int(b) for a, b in zip(u, v)) for v in y] for u in x], object)
    return exact.astype(np.int64)


def _read(anchors, rows, d: int, same: bool, k: int):
    """(anchor, window, id, score): the best ``k`` rows of a unit for each window of the anchors that read it."""
    import pyarrow as pa

    out: list = [[], [], [], []]
    if anchors.num_rows and rows.num_rows:
        block, ids, label = (rows.column(n).to_numpy() for n in ("block", "id", "label"))
        x, y = _matrix(anchors.column("q"), d), _matrix(rows.column("q"), d)
        chosen, own = anchors.column("blocks").to_pylist(), anchors.column("label").to_numpy()
        s = _scores(x, y)
        who = anchors.column("id").to_numpy()
        for r, ends in enumerate(_windows(anchors.column("windows"))):
            ok = np.isin(block, chosen[r]) & (ids != who[r]) & ((label == own[r]) == same)
            for w, (a, b) in enumerate(ends):
                at = np.flatnonzero(ok & (s[r] >= a) & (s[r] <= b))
                at = at[np.lexsort((ids[at], -s[r, at]))][:k]
                out[0].append(np.full(len(at), who[r]))
                out[1].append(np.full(len(at), w))
                out[2].append(ids[at])
                out[3].append(s[r, at])
    flat = [np.concatenate(c).astype(np.int64) if c else np.zeros(0, np.int64) for c in out]
    return pa.table([pa.array(c) for c in flat], names=["anchor", "window", "id", "score"])


class Index:
    """Blocks and zone maps of the rows (id, label, q) of one vector length."""

    def __init__(self, rows: DataFrame, d: int, block: int = BLOCK, unit: int = UNIT) -> None:
        self.d, self.blocks = d, blocked(rows, d, block, unit)
        zones = zone_maps(self.blocks, d)
        group = F.pmod(F.xxhash64("unit"), F.lit(1 << 30))
        units = zones.select("unit").distinct().count()
        self.groups = max(1, -(-units // ZONES))
        self.zones = durable(zones.withColumn("zone", (group % self.groups).cast("int")))

    def chosen(self, anchors: DataFrame, same: bool, first: bool) -> DataFrame:
        """(unit, part, id, label, q, windows, blocks): the blocks that each anchor reads, a row for each unit that has some."""
        d = self.d
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        left = anchors.withColumn("zone", every(self.groups))
        right = self.zones.withColumn("part", every(self.parts)).select("part", "unit", "block", "low", "high", "first", "last", "zone")
        kind = f"unit long, id long, label int, q array<bigint>, windows {_WINDOW}, blocks array<int>"
        found = left.groupBy("zone", "part").cogroup(right.groupBy("zone", "part")).applyInArrow(lambda a, b: _choose(a, b, d, same, first), kind)
        return found.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(self.parts)).cast("int"))

    def _pass(self, anchors: DataFrame, same: bool, first: bool, k: int) -> DataFrame:
        d = self.d
        asked = durable(self.chosen(anchors, same, first))
        read = asked.select(F.col("unit").alias("u"), F.col("part").alias("p")).distinct()
        rows = self.blocks.join(read, F.col("unit") == F.col("u")).select(F.col("u").alias("unit"), F.col("p").alias("part"), "block", "id", "label", "q")
        found = asked.groupBy("unit", "part").cogroup(rows.groupBy("unit", "part")).applyInArrow(lambda a, b: _read(a, b, d, same, k), "anchor long, window long, id long, score long")
        order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "id")
        return found.distinct().withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)

    def search(self, anchors: DataFrame, same: bool, k: int) -> DataFrame:
        """(anchor, window, rank, id, score): for each window of the anchors (id, label, q, windows) its best ``k`` rows with the anchor's label or, if not ``same``, another."""
        # Anchors with one id and different vectors have no meaning here; see hard_negatives.
        many = anchors.count()
        self.parts = max(1, -(-many // ANCHORS))
        anchors = durable(anchors.select("id", "label", "q", "windows").withColumn("part", F.pmod(F.xxhash64("id"), F.lit(self.parts)).cast("int")))
        seen = self._pass(anchors, same, True, k)
        least = seen.where(F.col("rank") == k).groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("least"))
        # A row below the k-th one seen is in no answer.
        raised = F.transform("windows", lambda w, i: F.struct(F.greatest(w["low"], F.coalesce(F.try_element_at("least", i.cast("long")).cast("double"), w["low"])).alias("low"), w["high"].alias("high")))
        tight = anchors.join(least, anchors.id == least.anchor, "left").withColumn("windows", raised).select(*anchors.columns)
        return self._pass(tight, same, False, k)


def quantised(rows: DataFrame, scale: float = 256.0) -> DataFrame:
    """(id, label, q) of the rows (id, label, vector) that take part: q is the floor of ``scale`` times each component."""
    whole = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    ok = F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("vector") > 0) & whole
    return rows.where(F.coalesce(ok, F.lit(False))).select("id", "label", F.transform("vector", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("bigint")).alias("q"))


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, block: int = BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``rows`` and ``anchors`` have id, label and q (whole numbers); scores are inner products. An
    anchor's positives are its best ``positives`` rows with its label and another id; for each, the
    best ``negatives`` rows of other labels whose score is ``low`` to ``high`` hundredths of the
    positive's. Higher scores come first, ties go to the smaller id; with fewer rows all count.
    Nulls and empty vectors take no part; vectors meet those of their own length. Repeated rows
    count once; rows that share an id are candidates each, and of anchors that share one the first
    by label and vector asks. Extra columns are dropped; empty tables give no rows.
    """
    kind = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark, whole = rows.sparkSession, lambda df: df.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(F.size("q") > 0, F.lit(False))).select("id", F.col("label").cast("int").alias("label"), "q").distinct()
    rows = durable(whole(rows))
    first = Window.partitionBy("id").orderBy("label", "q")
    anchors = durable(whole(anchors).withColumn("k", F.row_number().over(first)).where("k = 1").drop("k"))
    out = spark.createDataFrame([], kind)
    for r in anchors.groupBy(F.size("q").alias("d")).count().orderBy("d").collect():  # a row a vector length
        d = r["d"]
        index, own = Index(rows.where(F.size("q") == d), d, block), anchors.where(F.size("q") == d)
        ends = lambda a, b: F.struct(a.cast("double").alias("low"), b.cast("double").alias("high"))
        least, most = F.lit(float("-inf")), F.lit(float("inf"))
        near = durable(index.search(own.withColumn("windows", F.array(ends(least, most))), True, positives))
        # For a negative score the range is empty.
        pairs = near.where(F.col("score") >= 0).select("anchor", (F.col("rank") - 1).cast("long").alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        per = pairs.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("window", F.ceil(F.col("positive_score") * low / 100).alias("a"), F.floor(F.col("positive_score") * high / 100).alias("b")))).alias("w"))
        asked = own.join(per, own.id == per.anchor).select("id", "label", "q", F.transform("w", lambda w: ends(w["a"], w["b"])).alias("windows"))
        found = index.search(asked, False, negatives).withColumnRenamed("id", "negative_id").withColumnRenamed("score", "negative_score")
        done = found.join(pairs, ["anchor", "window"]).select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")
        out = out.unionByName(durable(done))
        discard(index.blocks)
    return out


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark, 2000)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = quantised(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), label.alias("label"), F.col("embedding").alias("vector")))
    return hard_negatives(rows, rows.where("id % 100 = 0"))


QUERIES = {"op13_hard_negatives": op13_hard_negatives}
#: Every anchor against every row.
ORACLES = {
    "op13_hard_negatives": """
WITH part AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
    FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
    FROM part a JOIN part b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
positive AS (SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
pair AS (
    SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
        row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) AS rank
    FROM positive p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM pair WHERE rank <= 5
"""
}
