"""Exact and near duplicates of photos and documents."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..plans.session import durable
from . import graph
from .ranking import ranked

#: Hamming distances of the sensitivities.
SENSITIVITY = {"strict": 3, "normal": 6, "loose": 8}
FLAT = 0


def needs_hash(photos: DataFrame) -> DataFrame:
    """Photos without a digest whose size another photo shares: all others are unique anyway."""
    shared = photos.where("filesize > 0").groupBy("filesize").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("filesize")
    return photos.where("md5 IS NULL AND filesize > 0").join(shared, "filesize", "left_semi").orderBy("path")


def exact_groups(photos: DataFrame, show_hidden: bool = False) -> DataFrame:
    """(md5, n, size, wasted, best, first_path): groups of equal digests; a group with a hidden photo only where shown."""
    best = F.struct(F.coalesce(S.pixels(F.col("width"), F.col("height")), F.lit(0)), F.coalesce("filesize", F.lit(0)), -F.col("id"))
    g = photos.where("md5 IS NOT NULL").groupBy("md5").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("filesize").alias("size"),
        (F.sum("filesize") - F.max("filesize")).alias("wasted"),
        F.max_by("id", best).alias("best"),
        F.min("path").alias("first_path"),
        F.bool_or("hidden").alias("_h"),
    )
    g = g.where("n > 1") if show_hidden else g.where("n > 1 AND NOT _h")
    return g.drop("_h").orderBy(F.desc("size"), "first_path")


def reclaimable(photos: DataFrame) -> DataFrame:
    return exact_groups(photos, True).agg(F.sum("wasted").alias("bytes"))


def keep_best(photos: DataFrame) -> DataFrame:
    """(md5, id, place): members of each group, the one to keep first. Members are numbered in one order of all groups, so that a digest of very many photos is no single task."""
    many = photos.where("md5 IS NOT NULL").groupBy("md5").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("md5")
    own = photos.join(many, "md5", "left_semi").select("md5", "id", F.coalesce(S.pixels(F.col("width"), F.col("height")), F.lit(0)).alias("pixels"), "filesize")
    rows = ranked(own, [F.col("md5"), F.desc("pixels"), F.desc_nulls_last("filesize"), F.col("id")])
    first = rows.groupBy("md5").agg(F.min("rank").alias("first"))
    return rows.join(first, "md5").select("md5", "id", (F.col("rank") - F.col("first") + 1).cast("int").alias("place"))


def bands(distance: int, bits: int = 64) -> list[tuple[int, int]]:
    """(first bit, end bit) of distance + 1 bands: two hashes within the distance agree on one of them."""
    edges = np.linspace(0, bits, distance + 2).astype(int).tolist()
    return list(zip(edges[:-1], edges[1:]))


def _band_keys(h: Column, distance: int) -> Column:
    """A key for each band: its number above its bits; a single band is the hash itself."""
    out = []
    for k, (a, b) in enumerate(bands(distance)):
        out.append(F.shiftrightunsigned(h, a).bitwiseAND(F.lit((1 << (b - a)) - 1)).bitwiseOR(F.lit(k << BAND_AT)) if b - a < 64 else h)
    return F.array(*out)


#: Where the number of a band stands in its key.
BAND_AT = 56
#: Hashes of a key that one task compares with as many others, and comparisons made at once.
HASH_BLOCK, AT_ONCE = 8192, 1 << 17


def _blocks(left: DataFrame, right: DataFrame | None, distance: int) -> GroupedData:
    """Rows (key, h, id, side), grouped so that hashes of the left and the right that agree on a band meet in one group.

    Without a right side each pair of the left's hashes meets, in its group or, within a block of
    a group, both ways round. Keys of few rows share a group; a key of many is cut into blocks, each
    of which meets each block of the other side.
    """
    keyed = lambda df: df.select("id", "h", F.explode(_band_keys(F.col("h"), distance)).alias("key"))
    both = keyed(left) if right is None else keyed(left).unionByName(keyed(right))
    # At most a key for each HASH_BLOCK rows.
    big = F.broadcast(durable(both.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / HASH_BLOCK).cast("int").alias("n")).where("n > 1")))
    n_rows = (left.count() + (right.count() if right is not None else 0)) * (distance + 1)
    few = F.pmod(F.xxhash64("key"), F.lit(max(1, -(-n_rows // HASH_BLOCK))))

    def placed(df, side):
        df = keyed(df).join(big, "key", "left").withColumn("n", F.coalesce("n", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("h"), F.col("n")).cast("int"))
        first, last = (F.lit(0), F.col("n") - 1) if right is not None else (F.col("own"), F.col("n") - 1) if side == 0 else (F.lit(0), F.col("own"))
        df = df.withColumn("other", F.explode(F.sequence(first, last)))
        i, j = (F.col("own"), F.col("other")) if side == 0 else (F.col("other"), F.col("own"))
        return df.select(F.when(F.col("n") > 1, F.col("key")).otherwise(few).alias("g"), (F.col("n") > 1).alias("cut"), i.alias("i"), j.alias("j"), "key", "h", "id", F.lit(side).alias("side"))

    return placed(left, 0).unionByName(placed(left if right is None else right, 1)).groupBy("g", "cut", "i", "j")


def _near(x: np.ndarray, y: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in x, places in y) of all hashes that differ in at most ``distance`` bits, piece by piece."""
    step = max(1, AT_ONCE // max(1, len(y)))
    for at in range(0, len(x), step):
        hit = np.flatnonzero(np.bitwise_count(x[at : at + step, None] ^ y) <= distance)
        if len(hit):
            yield at + hit // len(y), hit % len(y)


def _runs(batches: Iterable[pa.RecordBatch], own: bool) -> Iterator[tuple[int, bool, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(key, whether both sides are one block, left hashes, left ids, right hashes, right ids) of each key of a group; with ``own`` the sides are the same hashes, and one alone has no pair."""
    t = pa.Table.from_batches(list(batches))
    key, h, ids, side = (t.column(c).to_numpy() for c in ("key", "h", "id", "side"))
    alike = bool(t.num_rows) and t.column("i")[0].as_py() == t.column("j")[0].as_py()
    order = np.lexsort((side, key))
    key, h, ids, side = key[order], h[order].view(np.uint64), ids[order], side[order]
    edges = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
    middle = edges[:-1] + np.add.reduceat(side == 0, edges[:-1]) if len(key) else edges[:-1]
    for lo, mid, hi in zip(edges[:-1].tolist(), middle.tolist(), edges[1:].tolist()):
        if lo < mid < hi and not (own and alike and hi - lo == 2):
            yield int(key[lo]), alike, h[lo:mid], ids[lo:mid], h[mid:hi], ids[mid:hi]


def _meeting(hashes: DataFrame, distance: int) -> DataFrame:
    """(a, b, distance) of the first ids of different hashes that differ in at most ``distance`` bits.

    Equal hashes are one candidate, so that a hot hash gives no quadratic bucket.
    """
    one = durable(hashes.where((F.col("h") != FLAT)).groupBy("h").agg(F.min("id").alias("id")))
    cut = bands(distance)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, alike, x, xi, y, yi in _runs(batches, True):
            for p, q in _near(x, y, distance):
                differs = x[p] ^ y[q]
                good = x[p] < y[q] if alike else differs != 0
                # A pair counts where it meets first: at the first band of which no bit differs.
                for a, b in cut[: key >> BAND_AT if distance else 0]:
                    good &= (differs >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1) != 0
                a, b, d = xi[p[good]], yi[q[good]], np.bitwise_count(differs[good]).astype(np.int32)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(d)], ["a", "b", "distance"])

    return _blocks(one, None, distance).applyInArrow(pairs, "a long, b long, distance int")


def _first_near(hashes: DataFrame, centres: DataFrame, distance: int) -> DataFrame:
    """(id, leader): the smallest id of the centres (id, h) within the distance of each hash that has one; a row a hash and group, not a row a pair, leaves the tasks."""

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, x, xi, y, yi in _runs(batches, False):
            order = np.argsort(yi)
            y, yi, best = y[order], yi[order], np.full(len(x), len(y))
            for p, q in _near(x, y, distance):
                np.minimum.at(best, p, q)
            own = best < len(y)
            yield pa.RecordBatch.from_arrays([pa.array(xi[own]), pa.array(yi[best[own]])], ["id", "leader"])

    found = _blocks(hashes, centres, distance).applyInArrow(least, "id long, leader long")
    return found.groupBy("id").agg(F.min("leader").alias("leader"))


def near_pairs(hashes: DataFrame, distance: int) -> DataFrame:
    """(a, b, distance) with a < b: the links of all ids whose 64-bit hashes differ in at most ``distance`` bits.

    ``hashes``: id, h. Flat hashes and nulls take no part. Different hashes link at the first id
    of each; every other id of a hash links to its first with distance 0. So n copies give
    n - 1 links, and no document that is near another is in none.
    """
    hashes = durable(hashes.select("id", "h"))
    own = hashes.where(F.col("h") != FLAT)
    first = own.groupBy("h").agg(F.min("id").alias("a"))
    members = own.join(first, "h").where(F.col("id") > F.col("a")).select("a", F.col("id").alias("b"), F.lit(0).alias("distance"))
    return _meeting(hashes, distance).unionByName(members)


def near_pairs_and_members(hashes: DataFrame, distance: int) -> DataFrame:
    """(a, b, distance): the links of the first ids of different hashes, and (id, first id, 0) of every row with a hash that is not flat.

    A first id is its own member, so every document is in a row and a hot hash of n documents gives n rows.
    """
    hashes = durable(hashes.select("id", "h"))
    own = hashes.where(F.col("h") != FLAT)
    first = own.groupBy("h").agg(F.min("id").alias("b"))
    members = own.join(first, "h").select(F.col("id").alias("a"), "b", F.lit(0).alias("distance"))
    return _meeting(hashes, distance).unionByName(members)


#: Hashes of the first stretch of ids whose links are all made; each later stretch is as long as all before it.
STRETCH = 50_000


def leader_groups(hashes: DataFrame, distance: int) -> DataFrame:
    """(id, leader) of the groups of two or more.

    In id order, a hash joins the first centre within the distance, else it becomes a centre; so
    groups do not chain. Done for distinct hashes by stretches of ids, each as long as all before:
    a hash within the distance of an earlier centre joins the first of them, without its other
    links being made; only those that are near none are linked with each other, see ``graph.first_come``.
    """
    hashes = durable(hashes.select("id", "h").where(F.col("h") != FLAT))
    one = durable(hashes.groupBy("h").agg(F.min("id").alias("id")))
    n, shares = one.count(), []
    while STRETCH << len(shares) < n:
        shares.append((STRETCH << len(shares)) / n)
    # Any cuts give the same groups, so approximate ones do.
    cuts = one.agg(F.percentile_approx("id", shares).alias("c")).first()["c"] if shares else []
    led, centres = None, None
    for low, high in zip([None, *cuts], [*cuts, None]):
        fresh = one.where((F.lit(True) if low is None else F.col("id") > low) & (F.lit(True) if high is None else F.col("id") <= high))
        parts = [led] if led is not None else []
        if centres is not None:
            fresh = durable(fresh)
            near = durable(_first_near(fresh, centres, distance))
            parts.append(near)
            fresh = durable(fresh.join(near.select("id"), "id", "left_anti"))
        both = durable(graph.both_ways(_meeting(fresh, distance)))
        chosen = graph.first_come(both)
        first = both.join(chosen.select(F.col("id").alias("y")), "y", "left_semi").groupBy("x").agg(F.min("y").alias("leader"))
        joined = durable(first.join(chosen, F.col("x") == F.col("id"), "left_anti").select(F.col("x").alias("id"), "leader"))
        new = fresh.select("id", "h").join(joined.select("id"), "id", "left_anti")
        centres = durable(new if centres is None else centres.unionByName(new))
        parts += [joined, new.select("id", F.col("id").alias("leader"))]
        led = durable(reduce(DataFrame.unionByName, parts))
    every = hashes.join(one.select("h", F.col("id").alias("first")), "h").join(led.select(F.col("id").alias("first"), "leader"), "first").select("id", "leader")
    big = every.groupBy("leader").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("leader")
    return every.join(big, "leader", "left_semi").select("id", "leader")


def similar_groups(photos: DataFrame, groups: DataFrame, show_hidden: bool = False) -> DataFrame:
    """(leader, n, size, first_path) of near-duplicate groups: none of hidden photos unless shown, none whose digests are all equal."""
    g = groups.join(photos, "id").groupBy("leader").agg(
        F.count(F.lit(1)).alias("n"), F.sum("filesize").alias("size"), F.min("path").alias("first_path"), F.bool_or("hidden").alias("_h"), F.count_distinct("md5").alias("_m"), F.count_if(F.col("md5").isNull()).alias("_nulls")
    )
    g = g.where("n > 1 AND NOT (_m = 1 AND _nulls = 0)")
    return (g if show_hidden else g.where("NOT _h")).select("leader", "n", "size", "first_path").orderBy(F.desc("size"), "first_path")


#: Two counters of so many bits fit into a long; no text has that many different words.
COUNTER = 30


def text_fingerprint(docs: DataFrame, bits: int = 2 * COUNTER) -> DataFrame:
    """(id, h): 60-bit SimHash of the distinct lower-case words; a word's hash is the first 15 hex digits of its md5.

    The words of a document lie in one task, so its sums are whole before the shuffle: one row
    of packed counters a document crosses it. Rows with the same id count as one text; texts
    without a word have no row.
    """
    words = docs.select(F.col("doc_id").alias("id"), F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))).alias("w")).where("w <> ''")
    hashed = words.select("id", F.conv(F.substring(F.md5(F.col("w").cast("binary")), 1, 15), 16, 10).cast("long").alias("x"))
    # Sum k counts bit k in its lower half and bit k + COUNTER in its upper half.
    pair = F.lit(1 | 1 << COUNTER)
    sums = [F.sum(F.shiftrightunsigned("x", k).bitwiseAND(pair)).alias(f"s{k}") for k in range(COUNTER)]
    counted = hashed.groupBy("id").agg(F.count(F.lit(1)).alias("n"), *sums)
    count = lambda k: F.shiftrightunsigned(f"s{k % COUNTER}", k // COUNTER * COUNTER).bitwiseAND(F.lit((1 << COUNTER) - 1))
    value = F.lit(0).cast("long")
    for k in range(bits):
        value = value.bitwiseOR(F.when(count(k) * 2 > F.col("n"), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")))
    return counted.select("id", value.alias("h"))
