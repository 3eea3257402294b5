"""Vector search, centroids, thresholds and content suggestions.

Query vectors and centroids (one a tag) are counted before they are sent to all tasks, see
``scores`` and ``beside``; the photo vectors are never collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..plans.session import durable

SIMILAR_MIN, RESULTS_MAX, TEXT_MIN_Z, MIN_EXAMPLES, PERCENTILE = 0.83, 1000, 2.5, 5, 0.25


def beside(many: DataFrame, few: DataFrame, n: int, most: int = 10_000) -> DataFrame:
    """Every row of ``many`` with every one of the n rows of ``few``: sent to all tasks up to ``most`` rows, beyond in blocks of so many that meet blocks of the other side."""
    if n <= most:
        return many.join(F.broadcast(few))
    blocks, salts = -(-n // most), 200
    left = many.withColumn("_s", F.pmod(F.xxhash64(*[c for c in many.columns if c != "vec"]), F.lit(salts))).withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = few.withColumn("_b", F.pmod(F.xxhash64(*[c for c in few.columns if c in ("query", "tag_id")]), F.lit(blocks)).cast("int")).withColumn("_s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return left.join(right, ["_b", "_s"]).drop("_b", "_s")


def scores(vectors: DataFrame, queries: DataFrame, most: int = 16) -> DataFrame:
    """(query, photo_id, score): inner product of each stated query with every vector; zero vectors left out.

    ``queries``: query, qvec; any number: up to ``most`` are sent to all tasks, more meet the
    vectors in blocks, see ``in_blocks``. A null vector or component, or two lengths, give a null score.
    """
    v, q, n = vectors.where(~S.is_zero(F.col("vec"))).select("photo_id", "vec"), queries.select("query", "qvec"), queries.count()
    if n <= most:
        return v.join(F.broadcast(q)).select("query", "photo_id", S.dot(F.col("vec"), F.col("qvec")).alias("score"))
    return in_blocks(v, q, n)


#: Queries and vectors that one task multiplies at once, and what a block holds of them on average, so that few hold more.
SIDES, FILL = (4096, 8192), (3800, 7600)
#: Vectors of a block on average where there are too few for two tasks a core.
LEAST = 3800
#: Scores that leave a task at once, and the most tasks.
BATCH, TASKS = 1 << 18, 10_000


def ordered(scores):
    """The places of the scores from the smallest to the largest; those within 2**-37 of their range stand in any order."""
    import numpy as np

    low, high = (scores.min(), scores.max()) if len(scores) else (0.0, 0.0)
    if not (high - low > 0 and np.isfinite((high - low) * 2.0**37) and len(scores) <= 1 << 25):
        return np.argsort(scores)
    # A sort of whole numbers that hold their places takes a quarter of the time of a sort of places.
    keys = np.empty(len(scores), np.int64)
    for at in range(0, len(keys), BATCH):
        part = keys[at : at + BATCH]
        part[:] = (scores[at : at + BATCH] - low) * ((2.0**37 - 1) / (high - low))
        part <<= 25
        part |= np.arange(at, at + len(part))
    keys.sort()
    keys &= (1 << 25) - 1
    return keys


def in_blocks(v: DataFrame, q: DataFrame, n: int) -> DataFrame:
    """(query, photo_id, score) of all (photo_id, vec) with all n (query, qvec), by one matrix product a block of queries and a block of vectors.

    A vector is sent to as many tasks as the other side has blocks. A task holds a block of each
    side and the scores of 4096 by 8192 at most. The scores of a block come in order: as files
    they take less than half of the space, since the ids of a block are few and equal rounded scores
    follow one another. They begin in the middle, where most are equal, as a file's dictionary takes
    the first values only. The result has as many rows as there are pairs, so files grow with their number.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    kinds = [q.schema["query"].dataType.simpleString(), v.schema["photo_id"].dataType.simpleString()]
    number = "float" if all(d.schema[c].dataType.simpleString() == "array<float>" for d, c in ((v, "vec"), (q, "qvec"))) else "double"
    qs, m = max(1, -(-n // FILL[0])), v.count()
    vs = max(1, -(-m // FILL[1]), min(-(-m // LEAST), -(-2 * v.sparkSession.sparkContext.defaultParallelism // qs)))
    parts = min(qs * vs, TASKS)
    own, every = (lambda c, k: F.pmod(F.xxhash64(c), F.lit(k))), (lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long"))))
    as_vec = lambda c: F.col(c).cast(f"array<{number}>").alias("vec")
    left = q.select(own("query", qs).alias("_q"), every(vs).alias("_v"), "query", F.lit(None).cast(kinds[1]).alias("photo_id"), as_vec("qvec"), F.lit(True).alias("_asks"))
    right = v.select(every(qs).alias("_q"), own("photo_id", vs).alias("_v"), F.lit(None).cast(kinds[0]).alias("query"), "photo_id", as_vec("vec"), F.lit(False).alias("_asks"))
    met = left.unionByName(right).select((F.col("_q") * vs + F.col("_v")).alias("block"), "query", "photo_id", "vec", "_asks")

    def by_length(vecs):
        """(places, matrix, places of the matrix with a null component) of each length; null vectors are -1 long."""
        sizes = np.where(vecs.is_valid().to_numpy(zero_copy_only=False), np.diff(vecs.offsets.to_numpy()), -1)
        starts, flat = vecs.offsets.to_numpy()[:-1], vecs.values
        gaps = flat.is_null().to_numpy(zero_copy_only=False) if flat.null_count else None
        flat = flat.to_numpy(zero_copy_only=False).astype(float)
        for d in np.unique(sizes).tolist():
            rows = np.flatnonzero(sizes == d)
            cells = starts[rows][:, None] + np.arange(max(d, 0))
            yield d, rows, flat[cells], np.zeros(len(rows), bool) if gaps is None else gaps[cells].any(1)

    def product(asks, answers):
        names, ids, s, known = asks.column(1), answers.column(2), np.zeros((len(asks), len(answers))), None
        right = list(by_length(answers.column(3)))
        for d, rows, x, holes in by_length(asks.column(3)):
            for e, cols, y, gaps in right:
                if d == e and d >= 0 and len(rows) == len(names) and len(cols) == len(ids):
                    s = x @ y.T
                elif d == e and d >= 0:
                    s[np.ix_(rows, cols)] = x @ y.T
                if d != e or d < 0 or holes.any() or gaps.any():
                    known = np.ones(s.shape, bool) if known is None else known
                    known[np.ix_(rows, cols)] = (d == e and d >= 0) & ~(holes[:, None] | gaps[None, :])
        s, known = s.ravel(), None if known is None else known.ravel()
        order = np.roll(ordered(s), -(len(s) // 2))
        for at in range(0, len(order), BATCH):
            k = order[at : at + BATCH]
            i, j = np.divmod(k.astype(np.uint32), np.uint32(len(ids)))
            yield pa.RecordBatch.from_arrays([names.take(pa.array(i)), ids.take(pa.array(j)), pa.array(s[k], mask=None if known is None else ~known[k])], ["query", "photo_id", "score"])

    def multiply(batches):
        block, held = None, []

        def products():
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            asks, answers = rows.filter(rows.column(4)), rows.filter(pc.invert(rows.column(4)))
            for a in range(0, len(asks), SIDES[0]):
                for b in range(0, len(answers), SIDES[1]):
                    yield from product(asks.slice(a, SIDES[0]), answers.slice(b, SIDES[1]))

        with np.errstate(all="ignore"):
            for batch in batches:
                at = 0
                for end in [*(np.flatnonzero(np.diff(batch.column(0).to_numpy())) + 1).tolist(), len(batch)]:
                    if end > at:
                        if held and batch.column(0)[at].as_py() != block:
                            yield from products()
                            held = []
                        block = batch.column(0)[at].as_py()
                        held.append(batch.slice(at, end - at))
                        at = end
            if held:
                yield from products()

    dealt = met.withColumn("_part", F.pmod("block", F.lit(parts)).cast("int")).repartitionById(parts, F.col("_part")).drop("_part")
    return dealt.sortWithinPartitions("block").mapInArrow(multiply, f"query {kinds[0]}, photo_id {kinds[1]}, score double")


def scores_arrow(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """As ``scores``, always in blocks; nothing is collected or sent to all tasks. Rows with a null id or vector take no part."""
    q = queries.where("query IS NOT NULL AND qvec IS NOT NULL").select(F.col("query").cast("long").alias("query"), "qvec")
    v = vectors.where(~S.is_zero(F.col("vec"))).where("photo_id IS NOT NULL").select(F.col("photo_id").cast("long").alias("photo_id"), "vec")
    return in_blocks(v, q, q.count())


def tag_vector(cents: DataFrame, tag: int, fallback: list[float] | None = None) -> DataFrame:
    """(query, qvec, origin): how a tag looks: the mean of its photos or, where it has too few, the fallback (the vector of its name)."""
    own = cents.where(F.col("tag_id") == tag).select(F.col("tag_id").alias("query"), F.col("centroid").alias("qvec"), F.lit("photos").alias("origin"))
    if fallback is None:
        return own
    other = cents.sparkSession.createDataFrame([(tag, [float(x) for x in fallback], "name")], "query int, qvec array<double>, origin string")
    return own.unionByName(other.join(own.select(F.col("query").alias("_q")), F.col("query") == F.col("_q"), "left_anti").drop("_q"))


def ranked(scored: DataFrame, least: float | None = None, most: int | None = RESULTS_MAX) -> DataFrame:
    """(photo_id, score), best first, ties by id."""
    out = (scored if least is None else scored.where(F.col("score") >= least)).orderBy(F.desc("score"), "photo_id").select("photo_id", "score")
    return out if most is None else out.limit(most)


def standing_out(scored: DataFrame, z: float = TEXT_MIN_Z) -> DataFrame:
    """The scores of at least the mean plus z standard deviations of all scores."""
    cut = scored.agg((F.avg("score") + z * F.stddev_pop("score")).alias("cut"))
    return scored.join(F.broadcast(cut), F.col("score") >= F.col("cut")).drop("cut")  # one row is broadcast


def centroids(vectors: DataFrame, tagged: DataFrame, least: int = MIN_EXAMPLES) -> DataFrame:
    """(tag_id, n, centroid): unit mean of the non-zero vectors of each tag that has enough; means combine before they are shuffled."""
    v = vectors.where(~S.is_zero(F.col("vec"))).join(tagged, "photo_id").select("tag_id", F.posexplode("vec").alias("i", "x"))
    mean = v.groupBy("tag_id", "i").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    parts = mean.groupBy("tag_id").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("p"), F.max("n").alias("n"))
    return parts.select("tag_id", "n", S.unit(F.transform("p", lambda s: s["m"]), 1e-9).alias("centroid"))


#: Ranks to both sides of a percentile, as a share, among which a sketch is trusted to have it, and the bins that they are cut into.
AROUND, BINS = 0.05, 1024


def thresholds(vectors: DataFrame, tagged: DataFrame, cents: DataFrame, share: float = PERCENTILE) -> DataFrame:
    """(tag_id, threshold): the share's percentile of the members' scores with their own centroid, between two scores by linear interpolation."""
    own = vectors.where(~S.is_zero(F.col("vec"))).join(tagged, "photo_id").join(cents, "tag_id")
    return percentiles(own.select("tag_id", S.dot(F.col("vec"), F.col("centroid")).alias("s")), share)


def percentiles(scored: DataFrame, share: float, guess: float | None = None) -> DataFrame:
    """(tag_id, threshold) of (tag_id, s): the exact percentile of each tag's scores, without sorting them.

    A quantile sketch a tag, which combines before the shuffle, says between which scores the
    percentile lies; these are counted in bins, and only scores of the one or two bins that hold it
    are put in order. Where a sketch is wrong, the percentile lies in the bin below or above, and
    that one is taken: the sketch decides how much is put in order, never the result. Null scores
    take no part. Sketches are drawn at random, so they are kept, a row a tag, before the rows are
    compared with them twice; that job runs when this is called. ``guess`` is the share around which
    the sketch is asked, the wanted one by default.
    """
    guess = share if guess is None else guess
    rows = scored.where("s IS NOT NULL").select("tag_id", F.col("s").cast("double").alias("s"))
    quantile = lambda q: F.expr(f"kll_sketch_get_quantile_double(k, {q}D)")
    sketch = rows.groupBy("tag_id").agg(F.expr("kll_sketch_agg_double(s)").alias("k"), F.count(F.lit(1)).alias("n"))
    ends = durable(sketch.select(F.col("tag_id").alias("_t"), ((F.col("n") - 1) * F.lit(share)).alias("at"), quantile(max(0.0, guess - AROUND)).alias("lo"), quantile(min(1.0, guess + AROUND)).alias("hi")))
    place = F.when(F.col("s") < F.col("lo"), -1).when(F.col("s") > F.col("hi"), BINS).when(F.col("hi") > F.col("lo"), F.least(F.lit(BINS - 1), F.floor((F.col("s") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS))).otherwise(0)
    binned = rows.join(ends, F.col("tag_id") == F.col("_t")).select("tag_id", "s", "at", place.cast("int").alias("bin"))
    # BINS + 2 rows a tag at the most.
    counted = binned.groupBy("tag_id", "bin").agg(F.count(F.lit(1)).alias("c"), F.first("at").alias("at"))
    upto = F.sum("c").over(Window.partitionBy("tag_id").orderBy("bin"))
    holds = lambda first, end: ((F.floor("at") >= first) & (F.floor("at") < end)) | ((F.ceil("at") >= first) & (F.ceil("at") < end))
    chosen = counted.withColumn("end", upto).withColumn("first", F.col("end") - F.col("c")).where(holds(F.col("first"), F.col("end"))).select(F.col("tag_id").alias("_c"), F.col("bin").alias("_b"), "first")
    near = binned.join(chosen, (F.col("tag_id") == F.col("_c")) & (F.col("bin") == F.col("_b"))).groupBy("tag_id", "bin", "s").agg(F.count(F.lit(1)).alias("m"), F.first("first").alias("first"), F.first("at").alias("at"))
    end = F.col("first") + F.sum("m").over(Window.partitionBy("tag_id", "bin").orderBy("s"))
    ranked_near = near.withColumn("end", end).withColumn("begin", F.col("end") - F.col("m"))
    value = lambda k: F.max(F.when((k >= F.col("begin")) & (k < F.col("end")), F.col("s")))
    two = ranked_near.groupBy("tag_id").agg(value(F.floor("at")).alias("low"), value(F.ceil("at")).alias("high"), F.first("at").alias("at"))
    return two.select("tag_id", (F.col("low") + (F.col("high") - F.col("low")) * (F.col("at") - F.floor("at"))).alias("threshold"))


def contrast(scored: DataFrame, good: list[int], bad: list[int]) -> DataFrame:
    """(photo_id, score): best score with the one set of queries minus the best with the other."""
    best = lambda ids: F.max(F.when(F.col("query").isin(ids), F.col("score")))
    return scored.groupBy("photo_id").agg((best(good) - best(bad)).alias("score"))


def content_suggestions(vectors: DataFrame, tagged: DataFrame, visible: DataFrame, most: int = 4) -> DataFrame:
    """(photo_id, tag_id, score): for all photos at once, tags whose photos look alike and that the photo has not.

    There is one centroid a tag, so photos times tags are scored; ``visible`` (tag_id, name) bounds the tags.
    """
    c = centroids(vectors, tagged)
    limits = c.join(thresholds(vectors, tagged, c), "tag_id").join(visible, "tag_id").select("tag_id", "name", "centroid", "threshold")
    limits = durable(limits)
    met = beside(vectors.where(~S.is_zero(F.col("vec"))), limits, limits.count()).withColumn("s", S.dot(F.col("vec"), F.col("centroid"))).where("s >= threshold")
    new = met.select("photo_id", "tag_id", "name", "s").join(tagged, ["photo_id", "tag_id"], "left_anti")
    w = Window.partitionBy("photo_id").orderBy(F.desc("s"), "name")
    return new.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most).select("photo_id", "tag_id", F.round("s", 3).alias("score"))


def stale_vectors(photos: DataFrame, vectors: DataFrame) -> DataFrame:
    """(id) of photos whose vector is absent or was made from another state of the file."""
    v = vectors.select(F.col("photo_id").alias("_p"), F.col("mtime").alias("_m"))
    j = photos.join(v, F.col("id") == F.col("_p"), "left")
    return j.where(F.col("_p").isNull() | ~F.col("mtime").eqNullSafe(F.col("_m"))).select("id")


def orphan_vectors(photos: DataFrame, vectors: DataFrame) -> DataFrame:
    return vectors.join(photos.select(F.col("id").alias("photo_id")), "photo_id", "left_anti").select("photo_id")


def coverage(photos: DataFrame, vectors: DataFrame) -> DataFrame:
    v = vectors.select(F.col("photo_id").alias("_p")).distinct()
    return photos.join(v, F.col("id") == F.col("_p"), "left").agg(F.count("_p").alias("analysed"), F.count(F.lit(1)).alias("total"))
