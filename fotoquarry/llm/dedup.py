"""SimHash near-duplicates through deletion-variant signatures.

A 64-bit fingerprint is cut into three segments. Fingerprints that differ in at most four bits
differ in at most one bit of some segment, so they agree on one of that segment's variants with
a single bit left out. Each distinct fingerprint is indexed under its 64 variants, fingerprints
meet by equality and are verified by their distance.

Groups of near copies stay cheap: fingerprints that meet are first chained to the bucket's
first and to their neighbour in order, and only members of different components are compared
pairwise after that, the largest component of a bucket never with itself.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import any_row, boxed, components, durable, release, small_batches, table, written

#: First bit and width of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: A wide SimHash for a similarity of 0.8: its bits, the tables that each index a fixed choice of them, and the
#: bits among the first 128 in which two fingerprints that meet may differ.
WIDE, TABLES, APART = 512, 96, 34
#: Counters by which shingles are ordered, rare ones first, and the parts in which they are added up.
COUNTERS, COUNTER_PARTS = 1 << 21, 256
#: Candidates of a text that meet it in one place.
BLOCK = 512
#: Bytes of text, and texts, of each side that one task compares with each other.
BLOCK_BYTES, BLOCK_TEXTS = 1 << 22, 4096
_RNG = np.random.default_rng(42)
_CHOICE = np.stack([_RNG.permutation(WIDE) for _ in range(TABLES)])
_LANES = _RNG.integers(0, 1 << 63, WIDE // 64, dtype=np.uint64)
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def shingle_hashes(text: bytes | None, width: int = 4, seed: int = 42) -> np.ndarray:
    """XXH64 of every run of ``width`` lower-cased words; of all words if there are fewer."""
    own = (text or b"").lower().split()
    if not own:
        return np.zeros(0, np.uint64)
    line, digest = b" ".join(own), xxhash.xxh64_intdigest
    if len(own) <= width:
        return np.array([digest(line, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: len(own) - width + 1].tolist(), ends[width - 1 :].tolist())
    return np.array([digest(line[i:j], seed) for i, j in spans], np.uint64)


def simhash(text: bytes | None, width: int = 4) -> int:
    """Bit k is 1 if bit k is set in over half of the shingle hashes; 0 without words."""
    hashes = shingle_hashes(text, width)
    if not len(hashes):
        return 0
    by = np.ascontiguousarray(hashes.astype("<u8")).view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(by[:, k], minlength=256) @ _BITS for k in range(8)])
    return int(sum(1 << k for k in np.flatnonzero(2 * ones > len(hashes)).tolist()))


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed long."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            fps = np.array([simhash(t, width) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["doc_id", "fp"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _variants(fp: Column) -> Column:
    """64 integers: the variant's number above its segment's bits, one of them cleared."""
    out = []
    for at, width in SEGMENTS:
        part = F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1)).cast("int")
        out += [part.bitwiseAND(F.lit(((1 << width) - 1) ^ (1 << k)).cast("int")).bitwiseOR(F.lit((at + k) << 22).cast("int")) for k in range(width)]
    return F.array(*out)


def _far(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def near_components(fps: DataFrame, most: int = 4) -> DataFrame:
    """(fp, root) of the distinct fingerprints that are linked to a smaller one; ``most`` is 4 at most."""
    spread = lambda df, *more: df.select("fp", *more, F.explode(_variants(F.col("fp"))).alias("key"))
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # narrow rows that grow 64 times
    distinct = durable(fps.select("fp").distinct().repartition(parts, "fp"))
    order = Window.partitionBy("key").orderBy("fp")
    met = spread(distinct).select("fp", F.lag("fp").over(order).alias("before"), F.first("fp").over(order).alias("first"))
    pairs = met.select("fp", F.explode(F.array("before", "first")).alias("other")).where((F.col("fp") != F.col("other")) & (_far("fp", "other") <= most))
    chained = durable(components(pairs.select(F.col("fp").alias("a"), F.col("other").alias("b"))))
    named = distinct.join(chained, distinct.fp == chained.node, "left").select("fp", F.coalesce("root", "fp").alias("comp"))
    named = durable(named.repartition(parts, "fp"))
    # Members of buckets with several components; the left side leaves out a bucket's largest one.
    bucket, own = Window.partitionBy("key"), Window.partitionBy("key", "comp")
    live = spread(named, "comp").withColumn("all", F.count(F.lit(1)).over(bucket)).where("all > 1").withColumn("n", F.count(F.lit(1)).over(own))
    live = live.where("n < all").withColumn("top", F.max(F.struct("n", "comp")).over(bucket)["comp"]).select("key", "fp", "comp", "top")
    live = durable(live)
    left = live.where("comp <> top").select(F.col("key").alias("lk"), F.col("fp").alias("lf"), F.col("comp").alias("lc"))
    found = left.join(live, (F.col("lk") == F.col("key")) & (F.col("lc") != F.col("comp")) & ((F.col("comp") == F.col("top")) | (F.col("lf") < F.col("fp"))) & (_far("lf", "fp") <= most))
    bridges = components(found.select(F.col("lc").alias("a"), F.col("comp").alias("b")))
    both = named.join(bridges, named.comp == bridges.node, "left").select("fp", F.coalesce("root", "comp").alias("root"))
    return both


def near_duplicates(docs: DataFrame, width: int = 4, most: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row.

    ``component_id`` is the smallest doc_id reachable over links of at most ``most`` differing
    bits. Null, empty and white-space texts have fingerprint 0 and link with each other. Rows
    with a null doc_id link like any other but give no id; a component of such rows alone has
    a null id. Repeated rows give a row each. Extra columns are dropped.
    """
    fps = durable(fingerprints(docs, width))
    roots = near_components(fps, most).select(F.col("fp").alias("f"), "root")
    smallest = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    named = durable(smallest.join(roots, F.col("fp") == F.col("f")).select("fp", "first", "root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = named.select(F.col("fp").alias("f"), "root").join(least, "root").select("f", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return fps.join(by_fp, F.col("fp") == F.col("f")).select("doc_id", hexed.alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, **how) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest doc_id; all columns stay, whatever they are called.

    Documents without an id stay, as nothing says which of them to keep. Rows that repeat the
    kept doc_id count as one document: one of them stays, chosen by a hash of its text.
    """
    return _first_of_each(docs, lambda d: near_duplicates(d, **how))


def _first_of_each(docs: DataFrame, group) -> DataFrame:
    inner, at, places = boxed(docs, "doc_id", "text")
    i, t = at["doc_id"], at["text"]
    groups = group(inner.select(F.col(i).alias("doc_id"), F.col(t).alias("text")))
    kept = groups.where("doc_id = component_id").select(F.col("doc_id").alias("kept")).distinct()
    # Which row of each kept id stays is found on narrow rows, so that whole documents meet it once.
    own = inner.select(F.col(i).alias("k"), F.xxhash64(t).alias("hash")).join(kept, F.col("k") == F.col("kept"), "left_semi")
    counted = own.groupBy("k", "hash").agg(F.count(F.lit(1)).alias("n"))
    least = durable(counted.groupBy("k").agg(F.min(F.struct("hash", "n")).alias("m")).select("k", "m.hash", "m.n"))
    chosen = lambda cond: inner.join(written(least.where(cond).select("k", "hash")), (F.col(i) == F.col("k")) & (F.xxhash64(t) == F.col("hash")), "left_semi")
    return chosen("n = 1").unionByName(chosen("n > 1").dropDuplicates([i])).unionByName(inner.where(F.col(i).isNull())).select(*places).toDF(*docs.columns)


def wide_simhash(hashes: np.ndarray) -> np.ndarray:
    """``WIDE`` bits of a set of shingle hashes, as 64-bit words: each bit is the majority of that bit over the hashes; a lane of 64 bits mixes them anew."""
    ones = np.zeros((WIDE // 8, 256), np.int64)
    place = np.arange(WIDE // 8)[None, :] * 256
    for at in range(0, len(hashes), 4096):
        z = hashes[at : at + 4096, None] + _LANES
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        by = np.ascontiguousarray(z ^ (z >> np.uint64(31))).astype("<u8").view(np.uint8).reshape(len(z), -1)
        ones += np.bincount((by + place).ravel(), minlength=ones.size).reshape(ones.shape)
    return np.packbits(2 * (ones @ _BITS).ravel() > len(hashes), bitorder="little").view("<u8")


def table_keys(wide: np.ndarray, n_bits: int) -> np.ndarray:
    """(rows, TABLES): the key of each fingerprint in each table, its number above ``n_bits`` chosen bits."""
    bits = np.unpackbits(np.ascontiguousarray(wide).view(np.uint8).reshape(len(wide), -1), axis=1, bitorder="little").astype(np.int64)
    power = 1 << np.arange(n_bits, dtype=np.int64)
    return np.stack([bits[:, own[:n_bits]] @ power for own in _CHOICE], 1) + (np.arange(TABLES, dtype=np.int64) << 40)


def few_bits_apart(first: np.ndarray, second: np.ndarray):
    """Whether rows i and j differ in at most ``APART`` of their 128 bits."""
    return lambda i, j: np.bitwise_count(first[i] ^ first[j]).astype(int) + np.bitwise_count(second[i] ^ second[j]) <= APART


def may_be_similar(place: np.ndarray, odd: np.ndarray):
    """Whether sets i and j may have a similarity of 0.8 if the element they meet on is their first common one.

    ``place`` is a set's size above 32 bits with the element's place in it, ``odd`` its ``parities``. What is common
    follows on both places and is four ninths of both sizes or more, so that at most a ninth of them is not common.
    """
    size = (place >> np.uint64(32)).astype(np.int64)
    rest = size - (place & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return lambda i, j: (9 * np.minimum(rest[i], rest[j]) >= 4 * (size[i] + size[j])) & (9 * np.bitwise_count(odd[i] ^ odd[j]).astype(int) <= size[i] + size[j])


def parities(hashes: np.ndarray) -> int:
    """64 bits, each of which says if the number of hashes with its own first six bits is odd: those of two sets differ in no more bits than the sets in elements."""
    return int(np.packbits((np.bincount((hashes >> np.uint64(58)).astype(np.int64), minlength=64) & 1).astype(np.uint8), bitorder="little").view("<u8")[0])


def rare_first(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The part of a set, in one order for all sets, that holds an element of each set with a similarity of 0.8 or more.

    Four fifths of a set or more are common then, so the first common element is among the first fifth and one. Sets
    of three elements or fewer are similar to none but themselves.
    """
    if len(hashes) < 4:
        return hashes[:0]
    return hashes[np.lexsort((hashes, counts[(hashes & np.uint64(COUNTERS - 1)).astype(np.int64)]))[: len(hashes) // 5 + 1]]


def gathered(key: np.ndarray, first: np.ndarray, second: np.ndarray, alike=few_bits_apart) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(smallest, closest, group) of each row of a table in key order: the two of ``meetings``, and the place of the first row of its key that is reached over near ones."""
    near_ones = alike(first, second)
    lo, hi, group = np.full(len(key), -2), np.full(len(key), -2), np.arange(len(key))
    left, shift = np.arange(len(key)), 1
    while len(left := left[left + shift < len(key)]):
        left = left[key[left] == key[left + shift]]
        near = left[near_ones(left, left + shift)]
        lo[near + shift] = near
        hi[near + shift] = np.where(hi[near + shift] < 0, near, hi[near + shift])
        lo[near], hi[near] = np.maximum(lo[near], -1), np.maximum(hi[near], -1)
        x, y = group[near], group[near + shift]
        while len(x := x[apart := x != y]):
            y = y[apart]
            np.minimum.at(group, np.maximum(x, y), np.minimum(x, y))
            while (up := group[group] != group).any():
                group[up] = group[group[up]]
            x, y = group[x], group[y]
        shift += 1
    return lo, hi, group


def meetings(key: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(smallest, closest): for each row of a table in key order the place of the first row of its key that is near, and of the last near one before it; rows without a near one before them have -1, those without any -2."""
    return gathered(key, first, second)[:2]


def bridging(left: list[tuple], right: list[tuple]) -> list[tuple]:
    """Pairs of ids with a similarity of 0.8 or more: enough to join all components that such pairs join, and fewer than there are components.

    Both sides are texts (id, component, distinct hashes); every text of ``left`` is compared
    with every one of ``right``, unless pairs found before have joined their components.
    """
    known = np.intersect1d(np.concatenate([s for *_, s in left]), np.concatenate([s for *_, s in right]))
    if not len(known):
        return []

    def shared(hashes):
        place = np.minimum(known.searchsorted(hashes), len(known) - 1)
        return place[known[place] == hashes]

    places = [shared(s) for *_, s in right]
    # A text without a shared hash is similar to none; the places of the others follow one another.
    some = np.flatnonzero([len(p) for p in places])
    n, size = np.array([len(places[j]) for j in some]), np.array([len(right[j][2]) for j in some])
    flat, starts, held = np.concatenate(places), np.cumsum(n) - n, np.zeros(len(known), bool)
    comps, at = np.unique([c for side in (left, right) for _, c, _ in side], return_inverse=True)
    group, mine, theirs = np.arange(len(comps)), at[: len(left)], at[len(left) :][some]
    found = []
    for (a, _, own), c in zip(left, mine):
        place = shared(own)
        held[place] = True
        common = np.add.reduceat(held[flat], starts, dtype=np.int64)
        held[place] = False
        for j in np.flatnonzero((5 * common >= 4 * (len(own) + size - common)) & (group[theirs] != group[c])):
            if group[theirs[j]] != group[c]:
                found.append((a, right[some[j]][0]))
                group[group == group[theirs[j]]] = group[c]
    return found


def _blocks() -> Column:
    """How many blocks a group of rows (bytes, n) takes."""
    return F.greatest(F.ceil(F.sum("bytes") / BLOCK_BYTES), F.ceil(F.sum("n") / BLOCK_TEXTS))


def _bridges(members: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """Pairs (a, b) that join the components of a region: of ``members`` (region, comp, sid, bytes), whose texts are in ``texts`` (sid, text).

    A region of one block is one task, and each text is sent once. In others the largest component
    meets the rest, not itself: texts of the rest, in blocks, are compared with blocks of all texts
    of the region, a pair of blocks in a task. What comes out grows with the components, however
    many texts are alike.
    """
    import pyarrow as pa

    def compare(batches):
        place, left, right = None, [], []
        names = pa.schema([("a", pa.int64()), ("b", pa.int64())])

        def found():
            pairs = bridging(left or right, right) if right else []
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], schema=names)

        for batch in batches:
            for region, i, j, first, sid, comp, text in zip(*(c.to_pylist() for c in batch.columns)):
                if place != (region, i, j):
                    yield found()
                    place, left, right = (region, i, j), [], []
                (left if first else right).append((sid, comp, np.unique(shingle_hashes(text, width))))
        yield found()

    comps = members.groupBy("region", "comp").agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n"))
    top = comps.groupBy("region").agg(F.max(F.struct("bytes", "comp"))["comp"].alias("top"), _blocks().alias("rs"))
    rest = comps.join(top, "region").where("comp <> top").groupBy("region").agg(F.first("top").alias("top"), F.first("rs").alias("rs"), _blocks().alias("ls"))
    sent = members.join(durable(rest), "region")
    own, every = (lambda n: F.pmod(F.xxhash64("sid"), n).cast("int")), (lambda n: F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1)))
    left = sent.where("comp <> top AND rs > 1").select("region", own("ls").alias("i"), every("rs").alias("j"), F.lit(True).alias("first"), "sid", "comp")
    right = sent.select("region", every("ls").alias("i"), own("rs").alias("j"), F.lit(False).alias("first"), "sid", "comp")
    places = written(left.unionByName(right))
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # as many as for other shuffles
    rows = places.join(texts.select("sid", "text"), "sid").select("region", "i", "j", "first", "sid", "comp", "text")
    return rows.repartition(parts, "region", "i", "j").sortWithinPartitions("region", "i", "j").mapInArrow(compare, "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """The pairs (a, b) of texts (sid, text) whose shingle sets have a Jaccard similarity of 0.8 or more.

    The texts of all b are sent to the text of their a, in blocks; that is the only time that texts
    are shuffled where the pairs are few enough to be sent to the tasks.
    """
    import pyarrow as pa

    def judge(batches):
        place, x = None, None
        for batch in batches:
            good = []
            for a, block, b, text in zip(*(c.to_pylist() for c in batch.columns)):
                y = np.unique(shingle_hashes(text, width))
                if b is None:
                    place, x = (a, block), y
                    good.append(False)
                    continue
                assert place == (a, block)
                common = len(np.intersect1d(x, y, assume_unique=True))
                good.append(5 * common >= 4 * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    dealt = written(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks")))
    others = written(pairs.join(dealt, "a").select("a", F.pmod("b", "blocks").alias("block"), "b"))
    theirs = texts.join(others, F.col("sid") == F.col("b")).select("a", "block", "b", "text")
    own = texts.join(dealt, F.col("sid") == F.col("a")).select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.lit(None).cast("long").alias("b"), "text")
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # as many as for other shuffles
    both = theirs.unionByName(own).repartition(parts, "a", "block").sortWithinPartitions("a", "block", F.asc_nulls_first("b"))
    return both.mapInArrow(judge, "a long, b long")


def _met(keys: DataFrame, parts: int, alike) -> DataFrame:
    """(key, sid, lowest, closest, first) of the rows (key, sid, f0, f1) that are near another one of their key, as ``gathered`` names them."""
    import pyarrow as pa

    def met(batches):
        held = None

        def found(cols):
            key, sid, f0, f1 = cols
            lo, hi, group = gathered(key, f0.view(np.uint64), f1.view(np.uint64), alike)
            own = np.flatnonzero(lo > -2)
            other = lambda at: pa.array(sid[at[own]], mask=at[own] < 0)
            return pa.RecordBatch.from_arrays([pa.array(key[own]), pa.array(sid[own]), other(lo), other(hi), other(group)], ["key", "sid", "lowest", "closest", "first"])

        for batch in batches:
            cols = [c.to_numpy() for c in batch.columns]
            cols = cols if held is None else [np.concatenate(c) for c in zip(held, cols)]
            # The last key may go on in the next batch.
            end = np.searchsorted(cols[0], cols[0][-1]) if len(cols[0]) else 0
            held = [c[end:] for c in cols]
            if end:
                yield found([c[:end] for c in cols])
        if held is not None and len(held[0]):
            yield found(held)

    return durable(keys.repartition(parts, "key").sortWithinPartitions("key", "sid").mapInArrow(met, "key long, sid long, lowest long, closest long, first long"))


def _counts(texts: DataFrame, width: int) -> np.ndarray:
    """``COUNTERS`` numbers of shingles of all texts, by the last bits of their hashes; they only say which come first, so that numbers beyond 65535 need not be told apart."""
    import pyarrow as pa

    size = COUNTERS // COUNTER_PARTS
    rows = lambda found: pa.RecordBatch.from_arrays([pa.array(list(found)), pa.array([np.minimum(c, 65535).astype("<u2").tobytes() for c in found.values()], pa.binary())], ["part", "counts"])

    def count(batches):
        found = np.zeros(COUNTERS, np.int32)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                own = np.unique(shingle_hashes(text, width))
                np.add.at(found, (own & np.uint64(COUNTERS - 1)).astype(np.int64), 1)
        if found.any():
            yield rows(dict(enumerate(found.reshape(COUNTER_PARTS, size))))

    def added(batches):
        found = {}
        for batch in batches:
            for part, counts in zip(*(c.to_pylist() for c in batch.columns)):
                found[part] = found.get(part, 0) + np.frombuffer(counts, "<u2").astype(np.int64)
        if found:
            yield rows(found)

    out = np.zeros((COUNTER_PARTS, size), "<u2")
    kind = "part long, counts binary"
    for part, counts in texts.select("text").mapInArrow(count, kind).repartition("part").mapInArrow(added, kind).collect():
        out[part] = np.frombuffer(counts, "<u2")
    return out.ravel()


def _rare_keys(rows: DataFrame, named: DataFrame, width: int) -> DataFrame:
    """(key, sid, f0, f1): the shingles of each distinct set's ``rare_first``, with what ``may_be_similar`` takes, from rows (row, sid, text) and the row of each set in ``named``."""
    import pyarrow as pa

    counts = _counts(rows, width)

    def chosen(batches):
        for batch in batches:
            row, sid, texts = batch.columns
            sets = [np.unique(shingle_hashes(t, width)) for t in texts.to_pylist()]
            odd = np.array([parities(s) for s in sets], np.uint64).view(np.int64)
            keys = pa.array([rare_first(s, counts).tobytes() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([row, sid, pa.array([len(s) for s in sets], pa.int64()), pa.array(odd), keys], ["row", "sid", "size", "odd", "keys"])

    def spread(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                sid, size, odd = (part.column(k).to_numpy() for k in (0, 1, 2))
                own = [np.frombuffer(k, np.int64) for k in part.column(3).to_pylist()]
                n = [len(k) for k in own]
                place = (np.repeat(size, n) << 32) + np.concatenate([np.arange(k) for k in n])
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.concatenate(own), np.repeat(sid, n), place, np.repeat(odd, n))], ["key", "sid", "f0", "f1"])

    # A set's keys go to its one row while they are still one value.
    sets = rows.select("row", "sid", "text").mapInArrow(chosen, "row long, sid long, size long, odd long, keys binary")
    return sets.join(named.select("row"), "row", "left_semi").select("sid", "size", "odd", "keys").mapInArrow(spread, "key long, sid long, f0 long, f1 long")


def similar_components(docs: DataFrame, width: int = 5) -> DataFrame:
    """(doc_id, component_id) of every row over links of a Jaccard similarity of 0.8 or more.

    Compared are the sets of ``width``-word shingles. Distinct sets have a SimHash of ``WIDE``
    bits; each table indexes about log2 of their number of its bits, and sets that agree on those
    and differ in at most ``APART`` of the first 128 bits are candidates, verified on the sets
    themselves. Bits miss some pairs, so sets also meet on each shingle of their rarest fifth,
    which misses none (``rare_first``). Sets that candidates lead to are a region; a region is compared in blocks of texts,
    in one task where it has one block. In a region of several, each set is first verified with its
    first and its closest near one, and what these join is not compared again. Texts without a word
    are one set. Null ids are treated as in ``near_duplicates``.
    """
    import pyarrow as pa

    def signed(batches):
        for batch in batches:
            sets = [np.unique(shingle_hashes(t, width)) for t in batch.column(1).to_pylist()]
            sid = np.array([xxhash.xxh64_intdigest(s.tobytes()) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
            wide = pa.array([wide_simhash(s).tobytes() if len(s) else None for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sid), wide, batch.column(1)], ["doc_id", "sid", "wide", "text"])

    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(signed, "doc_id long, sid long, wide binary, text binary")
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()))
    named = durable(rows.groupBy("sid").agg(F.min("doc_id").alias("first"), F.first("wide").alias("wide"), F.min("row").alias("row")))
    n_bits = max(6, min(32, named.count().bit_length()))

    def spread(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                wide = np.frombuffer(b"".join(part.column(1).to_pylist()), "<u8").reshape(part.num_rows, -1)
                own = [np.repeat(x, TABLES) for x in (part.column(0).to_numpy(), wide[:, 0].astype(np.uint64).view(np.int64), wide[:, 1].astype(np.uint64).view(np.int64))]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (table_keys(wide, n_bits).ravel(), *own)], ["key", "sid", "f0", "f1"])

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # narrow rows that grow so many times
    keys = named.where("wide IS NOT NULL").select("sid", "wide").repartition(parts, "sid").mapInArrow(spread, "key long, sid long, f0 long, f1 long")
    near = _met(keys, parts, few_bits_apart)
    release(docs.sparkSession)
    near = near.unionByName(_met(_rare_keys(rows, named, width), parts, may_be_similar))
    release(docs.sparkSession)
    shown = written(named.join(near.select("sid").distinct(), "sid", "left_semi").select("row"))
    texts = written(rows.join(shown, "row", "left_semi").select("sid", F.octet_length("text").alias("bytes"), "text"))
    regions = components(near.select(F.col("sid").alias("a"), F.col("first").alias("b")))
    sized = durable(texts.select("sid", "bytes").join(regions, F.col("sid") == F.col("node"), "left").select(F.coalesce("root", "sid").alias("region"), F.col("sid").alias("comp"), "sid", "bytes"))
    large = durable(sized.withColumn("n", F.lit(1)).groupBy("region").agg(_blocks().alias("blocks")).where("blocks > 1"))
    links = near.select(F.col("sid").alias("a"), F.col("first").alias("b")).limit(0)
    if any_row(large):
        tried = near.join(sized.join(large, "region", "left_semi").select("sid"), "sid", "left_semi").groupBy("sid").agg(F.min("lowest").alias("lowest"), F.max("closest").alias("closest"))
        tried = durable(tried.select(F.col("sid").alias("b"), F.explode(F.array_distinct(F.array("lowest", "closest"))).alias("a")).where("a IS NOT NULL").select("a", "b"))
        links = durable(_verified(tried, texts, width))
        chained = components(links)
        sized = durable(sized.drop("comp").join(chained, F.col("sid") == F.col("node"), "left").select("region", F.coalesce("root", "sid").alias("comp"), "sid", "bytes"))
    found = _verified(durable(_bridges(sized, texts, width).distinct()), texts, width)
    roots = components(links.unionByName(found))
    whole = durable(named.join(roots, F.col("sid") == F.col("node"), "left").select("sid", "first", F.coalesce("root", "sid").alias("root")))
    least = whole.groupBy("root").agg(F.min("first").alias("component_id"))
    by_set = whole.join(least, "root").select(F.col("sid").alias("s"), "component_id")
    return rows.select("doc_id", "sid").join(by_set, F.col("sid") == F.col("s")).select("doc_id", "component_id")


def keep_first_similar(docs: DataFrame, width: int = 5) -> DataFrame:
    """``keep_first`` over the groups of ``similar_components``."""
    return _first_of_each(docs, lambda d: similar_components(d, width))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op1_simhash": op1_simhash}
ORACLES: dict = {}
