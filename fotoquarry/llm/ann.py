"""Nearest neighbours by inner product with multiprobe p-stable hashing.

Vectors get one more component that makes all of them equally long, so that the largest inner
product is the smallest distance. Each table cuts a few Gaussian projections into cells; a
query visits the cells around its own in the order of their estimated success. Candidates of
all tables are ranked by the inner product of the original vectors, summed in one order, so that
equal products are equal wherever they are computed. The first block of each bucket gives a query
its best rows; of all further blocks only those that are as near as the last of these are kept, so
that a bucket of many blocks does not give a set of candidates for each. Queries that meet too few
candidates are compared with all rows, in blocks.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import any_row, durable, small_batches, table
from .vectors import matrices, usable

TABLES, PROJECTIONS, WIDTH, PROBES = 2, 4, 2.0, 40
#: Cells are numbered from -EDGE to EDGE; what lies beyond is in the outermost.
EDGE = 4
#: Vectors and queries that one task multiplies.
BLOCK, QUERY_BLOCK = 2048, 512
_OFFSETS = np.array(list(itertools.product((-1, 0, 1), repeat=PROJECTIONS)))
_PLACES = (2 * EDGE + 1) ** np.arange(PROJECTIONS)


def _projected(x: np.ndarray, longest: float, query: bool) -> np.ndarray:
    """(tables, rows, projections) in units of a cell."""
    d = x.shape[1]
    rng = np.random.default_rng([11, d])
    a, b = rng.normal(size=(TABLES, d + 1, PROJECTIONS)), rng.uniform(0, WIDTH, (TABLES, 1, PROJECTIONS))
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    if query:
        full = np.hstack([x / norm, np.zeros((len(x), 1))])
    else:
        full = np.hstack([x / longest, np.sqrt(np.maximum(0, 1 - (norm / longest) ** 2))])
    return (full @ a + b) / WIDTH


def _number(cells: np.ndarray) -> np.ndarray:
    return (np.clip(cells, -EDGE, EDGE) + EDGE) @ _PLACES


def buckets(x: np.ndarray, longest: float) -> np.ndarray:
    """(tables, rows): the bucket of each vector."""
    return _number(np.floor(_projected(x, longest, False)).astype(np.int64))


def probes(x: np.ndarray) -> np.ndarray:
    """(tables, rows, PROBES): buckets in the order of the squared distances to their cells' edges."""
    u = _projected(x, 1.0, True)
    low = np.floor(u)
    cost = np.stack([(u - low) ** 2, np.zeros_like(u), (1 - (u - low)) ** 2], -1)
    total = sum(cost[:, :, j, :][:, :, _OFFSETS[:, j] + 1] for j in range(PROJECTIONS))
    best = np.argsort(total, axis=2, kind="stable")[:, :, :PROBES]
    return _number(low.astype(np.int64)[:, :, None, :] + _OFFSETS[best])


def _hashed(rows: DataFrame, longest: dict[int, float], query: bool) -> DataFrame:
    """(dim, t, bucket, id, vector), a row for each table and, for queries, each probe."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for own, x in matrices(batch.column(1)):
                found = probes(x) if query else buckets(x, longest[x.shape[1]])[:, :, None]
                places = [np.unique(found[t, r]) for t in range(TABLES) for r in range(len(own))]
                many = [len(p) for p in places]
                source = np.repeat(np.tile(own, TABLES), many)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(source), x.shape[1], np.int32)), pa.array(np.repeat(np.repeat(np.arange(TABLES, dtype=np.int32), len(own)), many)), pa.array(np.concatenate(places).astype(np.int32))]
                    + [batch.column(k).take(pa.array(source)) for k in (0, 1)],
                    ["dim", "t", "bucket", "id", "vector"],
                )

    kind = rows.schema["vector"].dataType.simpleString()
    return rows.select("id", "vector").mapInArrow(run, f"dim int, t int, bucket int, id long, vector {kind}")


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed from the first component to the last."""
    out = np.zeros(len(x))
    for j in range(x.shape[1]):
        out += x[:, j] * y[:, j]
    return out


def _rank(k: int, a, b):
    """(query_id, vec_id, score): of one block of queries and one of vectors the best k of each query, none below the query's ``least`` if it has one."""
    import pyarrow as pa

    out: list = [[], [], []]
    if a.num_rows and b.num_rows:
        qi, ci = (t.column("id").to_numpy() for t in (a, b))
        (_, x), (_, y) = (matrices(t.column("vector").combine_chunks())[0] for t in (a, b))
        s = x @ y.T
        # A matrix product may differ in its last bits from the sum that counts.
        slack = 1e-12 * np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1).max()
        s[qi[:, None] == ci[None, :]] = -np.inf
        n = min(k, len(ci))
        edge = np.partition(s, len(ci) - n, axis=1)[:, len(ci) - n]
        if "least" in a.column_names:
            edge = np.maximum(edge, a.column("least").to_numpy())
        for r in range(len(qi)):
            near = np.flatnonzero((s[r] >= edge[r] - slack[r]) & (s[r] > -np.inf))
            exact = products(np.broadcast_to(x[r], (len(near), x.shape[1])), y[near])
            if "least" in a.column_names:
                keep = exact >= edge[r] - slack[r]
                near, exact = near[keep], exact[keep]
            best = np.lexsort((ci[near], -exact))[:n]
            out[0].append(np.full(len(best), qi[r]))
            out[1].append(ci[near][best])
            out[2].append(exact[best])
    flat = [np.concatenate(c) if c else np.zeros(0) for c in out]
    return pa.table({"query_id": pa.array(flat[0].astype(np.int64)), "vec_id": pa.array(flat[1].astype(np.int64)), "score": pa.array(flat[2].astype(np.float64))})


def nearest(rows: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the ``k`` candidates with the largest inner products found.

    ``rows`` and ``queries`` have id and vector. A query is not its own candidate; ties go to
    the smaller id. Vectors that are null, empty, zero or hold null or non-finite components,
    and rows with a null id, take no part; vectors meet only those of their own length.
    Repeated rows count once; of rows with the same id and different vectors, the best score counts.
    Of equal vectors the k + 1 with the smallest ids are candidates: no other can be returned.
    """
    good = usable(F.col("vector")) & F.col("id").isNotNull()
    queries = queries.where(good).select("id", "vector").distinct()
    base = rows.where(good).select("id", "vector")
    part = Window.partitionBy("vector", "part").orderBy("id")
    whole = Window.partitionBy("vector").orderBy("id")
    base = base.distinct().withColumn("part", F.pmod(F.xxhash64("id"), F.lit(64)))
    base = base.withColumn("n", F.row_number().over(part)).where(F.col("n") <= k + 1)
    base = durable(base.withColumn("n", F.row_number().over(whole)).where(F.col("n") <= k + 1).select("id", "vector"))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    longest = {r["dim"]: r["norm"] for r in base.groupBy(F.size("vector").alias("dim")).agg(F.max(norm).alias("norm")).collect()}  # a row a vector length

    place = ["dim", "t", "bucket"]
    data, asked = _hashed(base, longest, False), _hashed(queries, longest, True)
    # At most TABLES * (2 * EDGE + 1) ** PROJECTIONS buckets for each vector length.
    sizes = durable(data.groupBy(*place).agg(F.count(F.lit(1)).alias("n")).join(asked.groupBy(*place).agg(F.count(F.lit(1)).alias("m")), place))
    blocks = F.broadcast(sizes.select(*place, F.ceil(F.col("n") / BLOCK).cast("int").alias("bs"), F.ceil(F.col("m") / QUERY_BLOCK).cast("int").alias("qs")))
    own, every = (lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")), (lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)))
    left = asked.join(blocks, place).select(*place, every("bs").alias("b"), own("qs").alias("q"), "id", "vector")
    right = data.join(blocks, place).withColumn("b", own("bs")).select(*place, "b", every("qs").alias("q"), "id", "vector")
    key = [*place, "b", "q"]

    rank, kind = (lambda a, b: _rank(k, a, b)), "query_id long, vec_id long, score double"
    meet = lambda a, b: a.groupBy(*key).cogroup(b.groupBy(*key)).applyInArrow(rank, kind)
    once = lambda df: df.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    found = durable(once(meet(left.where("b = 0"), right.where("b = 0"))))
    if any_row(sizes.where(F.col("n") > BLOCK)):
        # A query's k-th best so far: what is worse cannot be among its k best.
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        least = found.withColumn("n", F.row_number().over(best)).where(F.col("n") == k).select(F.col("query_id").alias("id"), F.col("score").alias("least"))
        known = left.where("b > 0").join(least, "id", "left").select(*key, "id", "vector", F.coalesce("least", F.lit(float("-inf"))).alias("least"))
        found = durable(once(found.unionByName(meet(known, right.where("b > 0")))))

    # What met fewer than k candidates though there are more meets all rows of its length.
    many = durable(base.groupBy(F.size("vector").alias("dim")).agg(F.count_distinct("id").alias("all")))
    met = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("met"))
    short = queries.select("id", "vector", F.size("vector").alias("dim")).join(met, F.col("id") == F.col("query_id"), "left").join(F.broadcast(many), "dim")  # a row a vector length
    short = durable(short.where((F.coalesce("met", F.lit(0)) < k) & (F.coalesce("met", F.lit(0)) < F.col("all") - 1)).select("dim", "id", "vector", F.ceil(F.col("all") / BLOCK).cast("int").alias("bs")))
    if any_row(short):
        sizes = durable(short.groupBy("dim").agg(F.max("bs").alias("bs"), F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("qs")))
        left = short.drop("bs").join(F.broadcast(sizes), "dim").select("dim", every("bs").alias("b"), own("qs").alias("q"), "id", "vector").toDF("dim", "b", "q", "id", "vector")
        right = base.select(F.size("vector").alias("dim"), "id", "vector").join(F.broadcast(sizes), "dim").withColumn("b", own("bs")).select("dim", "b", every("qs").alias("q"), "id", "vector").toDF("dim", "b", "q", "id", "vector")
        rest = left.groupBy("dim", "b", "q").cogroup(right.groupBy("dim", "b", "q")).applyInArrow(rank, kind)
        found = found.unionByName(rest).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark, 2000)
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return nearest(rows, rows.where("id % 20 = 0"))


QUERIES = {"op6_nearest": op6_nearest}
ORACLES: dict = {}
