"""Embedding near-duplicates with iterative quantisation.

Rotations learned on a bounded sample turn vectors into balanced binary codes. Hamming tables
index the codes by segment, one table a segment, whose width and number follow from the number of
vectors (see ``layout``); vectors with an equal segment meet. What is shuffled is the segment, the
vector's number and the code's first 63 bits, by which unrelated pairs and most repeated meetings
are dropped where they meet; the original vectors decide in double precision.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, durable, small_batches, table
from .vectors import matrices, usable

#: Vectors that the rotation is learned from, at the most (about).
SAMPLE = 4096
#: Share of links that the tables may miss by calculation, and how many standard deviations over the
#: mean the first bits of a pair may differ in before its vectors are not even compared.
MISSED, DEVIATIONS = 2e-4, 5.0
#: Bits of a code that are shuffled beside its segments, in one integer.
FIRST = 63


def layout(rows: int, least: float) -> tuple[int, int, int]:
    """(segments, bits of each, most of the first bits in which a linked pair may differ) for so many vectors of a label.

    Segments are about as wide as the logarithm of the rows, so that the unrelated vectors that
    a vector meets in a table stay few however many there are; there are as many as the links need.
    """
    width = min(30, max(8, (max(rows, 2) - 1).bit_length() - 1))
    flip = float(np.arccos(np.clip(least, -1, 1)) / np.pi)
    meets = (1 - flip) ** width
    segments = max(8, int(np.ceil(np.log(MISSED) / np.log1p(-min(meets, 1 - 1e-9)))))
    return segments, width, int(FIRST * flip + DEVIATIONS * np.sqrt(FIRST * flip * (1 - flip))) + 1


def learn(sample: np.ndarray, bits: int = 64, rounds: int = 40, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection to so many signs): principal directions and rotations nearest to binary codes, as many as the bits need."""
    mean = sample.mean(0)
    x = sample - mean
    _, _, axes = np.linalg.svd(x, full_matrices=True)
    axes = axes[: min(bits, x.shape[1])].T
    v, rng, parts = x @ axes, np.random.default_rng(seed), []
    while sum(p.shape[1] for p in parts) < bits:
        r = np.linalg.qr(rng.normal(size=(axes.shape[1],) * 2))[0]
        for _ in range(rounds):
            u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
            r = (u @ w).T
        parts.append(axes @ r)
    return mean, np.concatenate(parts, axis=1)[:, :bits]


def codes(x: np.ndarray, model: dict, bits: int = 64) -> np.ndarray:
    """The signs of each row, (rows, bits) of 0 and 1; a length that the sample lacks is projected at random."""
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    if x.shape[1] not in model:
        model[x.shape[1]] = (0.0, np.random.default_rng(x.shape[1]).normal(size=(x.shape[1], bits)))
    mean, p = model[x.shape[1]]
    return ((x - mean) @ p >= 0).astype(np.uint8)


def segment_values(signs: np.ndarray, segments: int, width: int) -> np.ndarray:
    """(rows, segments): each segment as an integer."""
    return signs.reshape(len(signs), segments, width).astype(np.int64) @ (1 << np.arange(width, dtype=np.int64))


def _not_met_before(x: Column, segment: Column, width: int) -> Column:
    """Whether a pair whose first bits differ by ``x`` has no earlier whole segment within them in common.

    Of the tables where a pair meets it leaves one among those that the first bits hold; it is
    left in any later ones if it met in none of these.
    """
    apart = [(segment <= j) | (x.bitwiseAND(F.lit(((1 << width) - 1) << (j * width))) != 0) for j in range(FIRST // width)]
    return reduce(lambda a, b: a & b, apart)


def links(distinct: DataFrame, least: float) -> DataFrame:
    """(a, b) with a < b of the distinct vectors (nid, label, embedding) whose cosine is at least ``least``."""
    spark = distinct.sparkSession
    sizes = distinct.groupBy("label", F.size("embedding")).agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("all"), F.max("n").alias("most")).first()
    total = sizes["all"] or 0
    segments, width, radius = layout(sizes["most"] or 0, least)
    bits, numbers = segments * width, (segments - 1).bit_length()
    draw = F.pmod(F.xxhash64("embedding"), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, SAMPLE / max(total, 1))))
    drawn = [np.array(r[0], float) for r in distinct.where(draw).select("embedding").limit(2 * SAMPLE).collect()]
    model = {}
    for d in {len(v) for v in drawn}:
        own = np.array([v for v in drawn if len(v) == d])
        if len(own) > 1:
            model[d] = learn(own / np.linalg.norm(own, axis=1, keepdims=True), bits)
    shared = spark.sparkContext.broadcast(model)

    def encode(batches):
        import pyarrow as pa

        places = np.arange(segments, dtype=np.int64) << width
        for batch in batches:
            first, keys = np.zeros(batch.num_rows, np.int64), np.zeros((batch.num_rows, segments), np.int64)
            group = np.asarray(batch.column(1)) << (width + numbers)
            for rows, x in matrices(batch.column(2)):
                signs = codes(x, shared.value, bits)
                first[rows] = segment_values(signs[:, :FIRST], 1, FIRST)[:, 0]
                keys[rows] = segment_values(signs, segments, width) | places | group[rows, None]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, segments, dtype=np.int32)), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(first), lists], ["nid", "first", "keys"])

    # A key is a hash of label and length, the segment's number and the segment: groups whose hashes share their low bits are told apart below.
    coded = durable(distinct.select("nid", F.xxhash64("label", F.size("embedding")).alias("group"), "embedding").mapInArrow(encode, "nid long, first long, keys array<long>"))
    spread = coded.select("nid", "first", F.explode("keys").alias("key"))
    x = F.col("p.first").bitwiseXOR(F.col("q.first"))
    segment = F.shiftright("p.key", width).bitwiseAND(F.lit((1 << numbers) - 1))
    close = (F.col("p.nid") < F.col("q.nid")) & (F.bit_count(x) <= radius) & _not_met_before(x, segment, width)
    # A size estimate does not see that explode multiplies rows, so the join is told not to broadcast. Both sides are one shuffle.
    met = spread.alias("p").hint("merge").join(spread.alias("q"), (F.col("p.key") == F.col("q.key")) & close).select(F.col("p.nid").alias("a"), F.col("q.nid").alias("b")).distinct()
    va, vb = (distinct.select(F.col("nid").alias(n), F.col("label").alias("l" + n), F.col("embedding").alias("v" + n)) for n in ("a", "b"))
    both = met.join(va, "a").join(vb, "b").where((F.col("la") == F.col("lb")) & (F.size("va") == F.size("vb"))).select("a", "b", "va", "vb")

    def verify(batches):
        import pyarrow as pa

        for batch in batches:
            ok = np.zeros(batch.num_rows, bool)
            for (rows, x), (_, y) in zip(matrices(batch.column(2)), matrices(batch.column(3))):
                ok[rows] = np.einsum("ij,ij->i", x, y) / (np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y))) >= least
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok)), batch.column(1).filter(pa.array(ok))], ["a", "b"])

    return both.mapInArrow(verify, "a long, b long")


def near_vectors(rows: DataFrame, least: float = 0.93) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Vectors link when their labels are equal and not null, their lengths are equal and their
    cosine is at least ``least``. Vectors that are null, empty, zero or hold null or non-finite
    components link with nothing, and neither do rows with a null vec_id, whose component is
    null. Equal vectors of a label are indexed once and link with each other; repeated rows
    count as vectors of their own. Extra columns are dropped.
    """
    base = rows.select("vec_id", "embedding", F.col("label").cast("string").alias("label"))
    fit = F.coalesce(usable(F.col("embedding")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False))
    base = base.withColumn("embedding", F.when(fit, F.col("embedding"))).withColumn("fit", fit)
    grouped = base.where("fit").groupBy("label", "embedding").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("many"))
    distinct = durable(grouped.withColumn("nid", F.monotonically_increasing_id()))
    found = durable(links(distinct, least))
    sizes = distinct.select("nid", "many")
    ways = found.select(F.col("a").alias("n"), F.col("b").alias("nid")).unionByName(found.select(F.col("b").alias("n"), F.col("a").alias("nid")))
    linked = ways.join(sizes, "nid").groupBy("n").agg(F.sum("many").alias("more"))
    roots = components(found)
    named = distinct.join(linked, F.col("nid") == F.col("n"), "left").join(roots, F.col("nid") == F.col("node"), "left")
    named = named.select("label", "embedding", "first", F.coalesce("root", "nid").alias("root"), (F.col("many") - 1 + F.coalesce("more", F.lit(0))).alias("links"))
    least_id = named.groupBy("root").agg(F.min("first").alias("component"))
    named = named.join(least_id, "root").select(F.col("label").alias("l"), F.col("embedding").alias("e"), "links", "component")
    out = base.join(named, F.col("fit") & (F.col("label") == F.col("l")) & (F.col("embedding") == F.col("e")), "left")
    component = F.coalesce("component", "vec_id").cast("long")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark, 2000)
    return near_vectors(table(spark, sf_dir, "embeddings"))


_ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[64]) AS e FROM embeddings WHERE label IS NOT NULL),
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND array_cosine_similarity(a.e, b.e) >= 0.93),
reach(a, b) AS (SELECT a, b FROM pairs UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a),
low AS (SELECT a, min(b) AS m FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, least(vec_id, coalesce(low.m, vec_id)) AS component_id, vec_id <= coalesce(low.m, vec_id) AS kept
FROM embeddings LEFT JOIN low ON low.a = vec_id LEFT JOIN n ON n.a = vec_id
"""

QUERIES = {"op3_embedding_dedup": op3_embedding_dedup}
ORACLES = {"op3_embedding_dedup": _ORACLE}
