"""Removal of long passages that an earlier document has too, by suffix automata of reference shards.

The reference is what documents share: the first occurrence of every window of ``SPAN`` words
that more than one document may hold. It is cut into chunks of a document, and the chunks are
dealt by hash to shards of about ``SHARD_WORDS`` words, one suffix automaton each. Every document
streams its shared passages past the shards that hold their first occurrences; matching statistics
of at least ``SPAN`` whose state first occurred in a smaller doc_id give the spans, and nothing
else does. A shard that many documents stream past is copied, automaton and all, to as many tasks
as its stream needs.

Hashes only choose what meets: every window belongs to one anchor, its winnowed ``GRAM``-word run,
so equal windows have equal anchors, and anchors of one document only are dropped. Texts around an
anchor that differ are compared window by window for the document that has each window first.
"""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import boxed, discard, durable, release, small_batches, table, written

SPAN, GRAM = 50, 25
#: Words of a reference shard, words that stream past one copy of it (both about), window starts of a chunk.
SHARD_WORDS, STREAM_WORDS, CHUNK = 60_000, 1_500_000, 1024
#: Bits of a gram's hash that make an anchor; with fewer more texts meet and the result is the same.
ANCHOR_BITS = 64
_BASE = 0x9E3779B97F4A7C13
_powers: dict[str, np.ndarray] = {}
_RUN = np.dtype([("c", "<i8"), ("s", "<i4"), ("n", "<i4")])


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    if not _powers or len(_powers["up"]) < n:
        size = max(1 << 14, 1 << (n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            own = np.full(size, np.uint64(base))
            own[0] = 1
            _powers[name] = np.cumprod(own)
    return _powers["up"][:n], _powers["down"][:n]


def _rolled(own: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of the word hashes, each times a power of the base, and the powers that undo it."""
    up, down = _powers_to(len(own) + 1)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, own), np.uint64, len(own))
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * up[: len(own)]))), down


def anchors(own: list[bytes], bits: int = ANCHOR_BITS) -> tuple[np.ndarray, ...]:
    """(anchor, content, first window, windows) of each run of windows with the same anchor.

    ``content`` is a hash of all words that the run's windows cover, and of the anchor's place in it.
    """
    n = len(own)
    if n < SPAN:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int32, np.int32))
    sums, down = _rolled(own)
    grams = _mix((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1])
    # The first smallest gram of each window, over spans of 1, 2, 4, ... grams.
    at, span, width = np.arange(len(grams)), 1, SPAN - GRAM + 1
    while span < width:
        step = min(span, width - span)
        a, b = at[:-step], at[step:]
        at = np.where(grams[b] < grams[a], b, a)
        span += step
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    last = np.concatenate((first[1:], [len(at)])) - 1
    inner = (sums[last + SPAN] - sums[first]) * down[first]
    content = _mix(inner + np.uint64(0x2545F4914F6CDD1D) * (at[first] - first + 64 * (last - first)).astype(np.uint64))
    anchor = grams[at[first]] & np.uint64((1 << bits) - 1)
    return anchor.view(np.int64), content.view(np.int64), first.astype(np.int32), (last - first + 1).astype(np.int32)


class Automaton:
    """Suffix automaton of word sequences that are added in the order of their documents; a state knows the first document that holds its words."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.first = [-1], [0], [-1]

    def _state(self, length: int, link: int, moves: dict, first: int) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.first.append(first)
        return len(self.link) - 1

    def _clone(self, p: int, word: bytes, q: int) -> int:
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]), self.first[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def add(self, sequence: list[bytes], doc: int) -> None:
        last = 0
        for word in sequence:
            q = self.next[last].get(word)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._clone(last, word, q)
                continue
            new, p = self._state(self.length[last] + 1, 0, {}, doc), last
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][word]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, word, q)
            last = new

    def repeats(self, sequence: list[bytes], doc: int, span: int = SPAN) -> list[tuple[int, int]]:
        """(first window, windows) of the maximal runs of places whose match is ``span`` words long or longer and stands in a document before ``doc``."""
        out: list[list[int]] = []
        moves, link, length, first = self.next, self.link, self.length, self.first
        state = size = 0
        for end, word in enumerate(sequence):
            while state and word not in moves[state]:
                state = link[state]
                size = length[state]
            state = moves[state].get(word, 0)
            size = size + 1 if state else 0
            if size >= span:
                # The state of the last ``span`` words: a longer match says nothing more.
                while length[link[state]] >= span:
                    state = link[state]
                    size = length[state]
                if first[state] < doc:
                    start = end - span + 1
                    if out and out[-1][0] + out[-1][1] == start:
                        out[-1][1] += 1
                    else:
                        out.append([start, 1])
        return [(a, b) for a, b in out]


def _packed(values: np.ndarray, starts: np.ndarray):
    """An Arrow binary column: the bytes of ``values`` from each start to the next."""
    import pyarrow as pa

    offsets = (np.append(starts, len(values)) * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())])


def _anchor_rows(batches, bits: int):
    """(d, r, a, runs): one row for each anchor of a document, however often it has it."""
    import pyarrow as pa

    for batch in batches:
        keys = [batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)]
        found = [anchors(t.split(), bits) for t in batch.column(2).to_pylist()]
        many = np.array([len(x[0]) for x in found], int)
        if many.sum():
            a, c, s, n = (np.concatenate([x[k] for x in found]) for k in range(4))
            doc = np.repeat(np.arange(len(found)), many)
            order = np.lexsort((a, doc))
            runs = np.zeros(len(a), _RUN)
            runs["c"], runs["s"], runs["n"] = c[order], s[order], n[order]
            a, doc = a[order], doc[order]
            starts = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (doc[1:] != doc[:-1]))))
            yield pa.RecordBatch.from_arrays([pa.array(k[doc[starts]]) for k in keys] + [pa.array(a[starts]), _packed(runs, starts)], ["d", "r", "a", "runs"])


def _text_rows(batches):
    """(d, r, a, c, s, n, at): one row for each text around an anchor in a document, with the windows where it starts."""
    import pyarrow as pa

    for batch in batches:
        if not batch.num_rows:
            continue
        raw = batch.column(3).to_pylist()
        runs = np.frombuffer(b"".join(raw), _RUN)
        row = np.repeat(np.arange(len(raw)), [len(x) // _RUN.itemsize for x in raw])
        order = np.lexsort((runs["s"], runs["c"], row))
        runs, row = runs[order], row[order]
        starts = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (runs["c"][1:] != runs["c"][:-1]))))
        keys = [batch.column(k).take(pa.array(row[starts])) for k in range(3)]
        own = [pa.array(np.ascontiguousarray(runs[f][starts])) for f in ("c", "s", "n")]
        yield pa.RecordBatch.from_arrays([*keys, *own, _packed(np.ascontiguousarray(runs["s"]), starts)], ["d", "r", "a", "c", "s", "n", "at"])


def _window_rows(batches):
    """(a, w, c, i, d, r, s): the windows of each wanted text, by their hash."""
    import pyarrow as pa

    for batch in batches:
        out: list[list] = [[] for _ in range(7)]
        for d, r, text, wanted in zip(*(batch.column(k).to_pylist() for k in range(4))):
            sums, down = _rolled(text.split())
            for x in wanted:
                at = np.arange(x["s"], x["s"] + x["n"])
                w = _mix((sums[at + SPAN] - sums[at]) * down[at]).view(np.int64)
                for col, v in zip(out, (np.full(len(at), x["a"]), w, np.full(len(at), x["c"]), at - x["s"], np.full(len(at), d), np.full(len(at), r), at)):
                    col.append(v)
        if out[0]:
            kinds = (np.int64, np.int64, np.int64, np.int32, np.int64, np.int32, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(t)) for c, t in zip(out, kinds)], list("awcidrs"))


def _cut_texts(batches):
    """(shard, copy, kind, d, r, s, words) of the passages that each document gives to shards (kind 0) or streams past them (kind 1)."""
    import pyarrow as pa

    for batch in batches:
        out: list[list] = [[] for _ in range(7)]
        for d, r, text, wanted in zip(*(batch.column(k).to_pylist() for k in range(4))):
            own, by = text.split(), {}
            for x in wanted:
                for at in np.frombuffer(x["at"], "<i4").tolist():
                    by.setdefault((x["shard"], x["copy"], x["kind"]), []).append((at + x["lo"], at + x["hi"]))
            for (shard, copy, kind), spans in by.items():
                spans.sort()
                merged = [list(spans[0])]
                for lo, hi in spans[1:]:
                    if lo <= merged[-1][1] + 1:
                        merged[-1][1] = max(merged[-1][1], hi)
                    else:
                        merged.append([lo, hi])
                for lo, hi in merged:
                    for col, v in zip(out, (shard, copy, kind, d, r, lo, b" ".join(own[lo : hi + SPAN]))):
                        col.append(v)
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], ["shard", "copy", "kind", "d", "r", "s", "words"])


def _match(batches):
    """(d, r, s, n): builds the automaton of each shard from its reference, which comes first, and streams the documents past it."""
    import pyarrow as pa

    place = machine = None
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for shard, copy, kind, d, r, s, words in zip(*(batch.column(k).to_pylist() for k in range(7))):
            if (shard, copy) != place:
                place, machine = (shard, copy), Automaton()
            if kind == 0:
                machine.add(words.split(b" "), d)
                continue
            for start, many in machine.repeats(words.split(b" "), d):
                for col, v in zip(out, (d, r, s + start, many)):
                    col.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.int32(), pa.int32()))], ["d", "r", "s", "n"])


def repeated_windows(texts: DataFrame, shard_words: int = SHARD_WORDS, stream_words: int = STREAM_WORDS, anchor_bits: int = ANCHOR_BITS) -> DataFrame:
    """(d, r, s, n): windows s to s+n-1 of document d that a document with a smaller d has too.

    ``texts``: d (long), r (int) tells apart texts with the same d, raw (the text's bytes);
    rows with a negative r take no part. None of the other arguments changes the result.
    """
    found = texts.where("r >= 0").select("d", "r", "raw").mapInArrow(lambda batches: _anchor_rows(batches, anchor_bits), "d long, r int, a long, runs binary")
    shared = durable(found.groupBy("a").agg(F.min("d").alias("lo"), F.max("d").alias("hi")).where("lo < hi").select("a"))
    live = durable(found.join(shared, "a", "left_semi").select("d", "r", "a", "runs").mapInArrow(_text_rows, "d long, r int, a long, c long, s int, n int, at binary"))

    release(texts.sparkSession)

    # The first document of each text around an anchor, and of each window where an anchor has several texts.
    first = live.groupBy("a", "c").agg(F.min(F.struct("d", "r", "s", "n")).alias("f"), F.max("d").alias("last"))
    first = durable(first.select("a", "c", "f.*", "last"))
    mixed = durable(first.groupBy("a").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("a"))
    several, single = first.join(mixed, "a", "left_semi"), first.join(mixed, "a", "left_anti")
    wanted = several.groupBy("d", "r").agg(F.collect_list(F.struct("a", "c", "s", "n")).alias("wanted"))
    windows = written(texts.select("d", "r", "raw").join(wanted, ["d", "r"]).select("d", "r", "raw", "wanted").mapInArrow(_window_rows, "a long, w long, c long, i int, d long, r int, s int"))
    holder = windows.groupBy("a", "w").agg(F.min(F.struct("d", "r", "s")).alias("h"))
    chunk = lambda s: F.floor(s / CHUNK).cast("int").alias("chunk")
    split = windows.join(holder, ["a", "w"]).select("a", "c", "i", F.col("h.d").alias("hd"), F.col("h.r").alias("hr"), F.col("h.s").alias("hs")).withColumn("chunk", chunk(F.col("hs")))
    split = split.groupBy("a", "c", "hd", "hr", "chunk").agg(F.min("i").alias("lo"), F.max("i").alias("hi"), F.min("hs").alias("from"), F.max("hs").alias("to"))
    split = split.join(several.select("a", "c", "last"), ["a", "c"])
    whole = single.select("a", "c", F.col("d").alias("hd"), F.col("r").alias("hr"), chunk(F.col("s")), F.lit(0).alias("lo"), (F.col("n") - 1).alias("hi"), F.col("s").alias("from"), (F.col("s") + F.col("n") - 1).alias("to"), "last")
    # Where the windows of each text stand first; a text that only its first holder has needs no reference.
    points = durable(split.unionByName(whole).where("last > hd").drop("last"))
    discard(windows)
    release(texts.sparkSession)

    reference = durable(points.groupBy("hd", "hr", "chunk").agg(F.min("from").alias("from"), F.max("to").alias("to")))
    total = reference.agg(F.sum(F.col("to") - F.col("from") + SPAN).alias("n")).first()["n"] or 0
    shards = max(1, -(-total // shard_words))
    shard = F.pmod(F.xxhash64("hd", "hr", "chunk"), F.lit(shards)).alias("shard")
    stream = live.select("d", "r", "a", "c", "at").join(points.select("a", "c", "hd", "lo", "hi", shard), ["a", "c"]).where("d > hd").select("d", "r", "shard", "at", "lo", "hi")
    load = stream.groupBy("shard").agg(F.sum(F.length("at") / 4 * (F.col("hi") - F.col("lo") + SPAN)).alias("words"))
    copies = durable(load.select("shard", F.ceil(F.col("words") / stream_words).cast("int").alias("copies")))
    give = reference.select(F.col("hd").alias("d"), F.col("hr").alias("r"), shard, "from", "to").join(copies, "shard")
    give = give.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).select("d", "r", F.struct("shard", "copy", F.lit(0).alias("kind"), F.unhex(F.lit("00000000")).alias("at"), F.col("from").alias("lo"), F.col("to").alias("hi")).alias("x"))
    take = stream.join(copies, "shard").select("d", "r", F.struct("shard", F.pmod(F.xxhash64("d", "r"), F.col("copies")).cast("int").alias("copy"), F.lit(1).alias("kind"), "at", "lo", "hi").alias("x"))
    wanted = give.unionByName(take).groupBy("d", "r").agg(F.collect_list("x").alias("wanted"))
    cut = texts.select("d", "r", "raw").join(wanted, ["d", "r"]).select("d", "r", "raw", "wanted").mapInArrow(_cut_texts, "shard long, copy int, kind int, d long, r int, s int, words binary")
    return cut.repartition("shard", "copy").sortWithinPartitions("shard", "copy", "kind", "d").mapInArrow(_match, "d long, r int, s int, n int")


def _row_keys(doc_id: str, text: str) -> list:
    """d, r and raw of a row: r tells apart texts with the same id; -1 without a text, -2 without an id."""
    r = F.coalesce(F.xxhash64(text).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int"), F.lit(0))
    r = F.when(F.col(doc_id).isNull(), F.lit(-2)).when(F.col(text).isNull(), F.lit(-1)).otherwise(r)
    return [F.coalesce(F.col(doc_id).cast("long"), F.lit(0)).alias("d"), r.alias("r"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("raw")]


def _with_spans(keyed: DataFrame, **how) -> DataFrame:
    """``keyed`` (d, r, raw and others) with spans, null where there are none."""
    spans = repeated_windows(keyed, **how).groupBy("d", "r").agg(F.collect_set(F.struct("s", "n")).alias("spans"))
    return keyed.join(spans, ["d", "r"], "left")


def _keep(text: bytes, spans) -> tuple[int, list[bytes]]:
    """(words, kept words)."""
    own = text.split()
    if not spans:
        return len(own), own
    edge = np.zeros(len(own) + 1, np.int64)
    for s, n in spans:
        edge[s] += 1
        edge[s + n + SPAN - 1] -= 1
    stays = np.cumsum(edge[:-1]) == 0
    return len(own), [w for w, ok in zip(own, stays.tolist()) if ok]


def remove_repeats(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row.

    Null, empty and white-space texts have no words. Rows with a null doc_id keep all words
    and are no reference. Rows with the same doc_id are the same document and never repeat
    each other; repeated rows give a row each. An empty table gives no rows. Extra columns
    are dropped. Texts of any length are read whole.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            n, gone, sha = [], [], []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                total, kept = _keep(text, [(x["s"], x["n"]) for x in spans or ()])
                n.append(total)
                gone.append(total - len(kept))
                sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    spanned = _with_spans(docs.select(*_row_keys("doc_id", "text")), **how)
    return spanned.select(F.when(F.col("r") != -2, F.col("d")).alias("doc_id"), "raw", "spans").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def cut_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the kept words of each text, joined by one space, where anything was removed; n_chars follows.

    All rows and columns stay, whatever the columns are called. Null and empty texts, rows
    with a null doc_id and texts without a repeated passage stay as they are; see
    ``remove_repeats`` for repeated ids.
    """
    names = docs.columns
    inner, at, places = boxed(docs, "doc_id", "text", *(["n_chars"] if "n_chars" in names else []))
    spanned = _with_spans(inner.select(*places, *_row_keys(at["doc_id"], at["text"])))

    @F.pandas_udf("string")
    def shorten(text, spans):
        import pandas as pd

        return pd.Series([None if s is None else b" ".join(_keep(bytes(t), [(x["s"], x["n"]) for x in s])[1]).decode("utf-8", "replace") for t, s in zip(text, spans)], dtype=object)

    cut = F.col("spans").isNotNull()
    out = spanned.withColumn("short", shorten("raw", "spans"))
    new = {at["text"]: F.when(cut, F.col("short")).otherwise(F.col(at["text"]))}
    if "n_chars" in names:
        new[at["n_chars"]] = F.when(cut, F.length("short")).otherwise(F.col(at["n_chars"])).cast(docs.schema[names.index("n_chars")].dataType)
    return out.select(*[new.get(p, F.col(p)).alias(p) for p in places]).toDF(*names)


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return remove_repeats(table(spark, sf_dir, "documents"))

_ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
f AS (SELECT h, min(doc_id) AS m FROM win GROUP BY h),
cov AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN f USING (h) WHERE m < doc_id),
gone AS (SELECT doc_id, count(*) AS n FROM cov GROUP BY doc_id),
word AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text FROM word ANTI JOIN cov USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(gone.n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

QUERIES = {"op5_substrings": op5_substrings}
ORACLES = {"op5_substrings": _ORACLE}
