"""Packing of token sequences by length patterns fitted with non-negative least squares.

The lengths of all pieces form a histogram of at most 2048 bins, whatever the corpus. Patterns
of a few lengths that nearly fill a sequence are enumerated, repeat counts are fitted to the
histogram, rounded to what is there, and the pieces left over are packed by best fit, again on
the histogram. The pieces then take their places by their rank among the pieces of their length.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import encode, tokenizer
from .common import durable, small_batches, table

SEQUENCE = 2048
#: Patterns that are fitted at the most, and slack that a pattern may leave.
MAX_PATTERNS, MAX_SLACK = 30_000, 24
#: Parts in which the pieces of one length are numbered.
RANK_PARTS = 256
#: Words, and parts of words, whose ids a Python worker remembers.
_MEMORY = 700_000
_words: dict[bytes, bytes] = {}
_parts: dict[bytes, bytes] = {b"": b""}
_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_ends: dict[str, np.ndarray] = {}


def _plain_letters(part: bytes) -> bool:
    """Only Latin letters, which the tokenizer keeps in one piece and normalises one by one."""
    if part.isalpha():  # of ASCII
        return True
    text = part.decode("utf-8", "replace")
    return text.isalpha() and max(text) < "\u0250" and "\u0130" not in text


def _split(word: bytes) -> tuple[bytes, bytes]:
    """A word as (core, trailing punctuation), cut only where the tokenizer always cuts; ASCII letters in lower case."""
    low = word.lower()
    if low.isalpha():
        return low, b""
    if b"<|" in word:  # may hold a special string
        return word, b""
    core = low.rstrip(_PUNCTUATION)
    if len(core) == len(low):
        return low, b""
    last = core[-2:].decode("utf-8", "ignore")[-1:]
    if last.isalnum() and last < "\u0250" and last != "\u0130":  # that one gains a mark in lower case
        return core, low[len(core) :]
    return low, b""


def _encode_parts(new: list[bytes], path: str) -> None:
    """Remember the ids of parts: plain words in one text, cut again at the ids that end a word; others one by one."""
    plain, other = [], []
    for p in new:
        (plain if _plain_letters(p) else other).append(p)
    if plain:
        if path not in _ends:
            vocab = tokenizer(path).get_vocab(with_added_tokens=False)
            ends = np.zeros(max(vocab.values()) + 1, bool)
            ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
            _ends[path] = ends
        ids = np.array(encode(path, [b" ".join(plain).decode()])[0], "<u4")
        stops = (4 * (np.flatnonzero(_ends[path][ids]) + 1)).tolist()
        raw, at = ids.tobytes(), 0
        assert len(stops) == len(plain)
        for p, stop in zip(plain, stops):
            _parts[p] = raw[at:stop]
            at = stop
    for p, ids in zip(other, encode(path, [p.decode("utf-8", "replace") for p in other])):
        _parts[p] = np.array(ids, "<u4").tobytes()


def token_bytes(texts: list[bytes | None], path: str) -> list[bytes]:
    """Each text's ids, four little-endian bytes an id, then id 0. Null is the empty text.

    The tokenizer drops white space and never joins across it, so words at ASCII white space
    are encoded one by one and remembered.
    """
    if len(_words) > _MEMORY:
        _words.clear()
    if len(_parts) > _MEMORY:
        _parts.clear()
        _parts[b""] = b""
    own = [(t or b"").split() for t in texts]
    split = {w: _split(w) for w in set().union(*own).difference(_words)}
    if unknown := {p for x in split.values() for p in x}.difference(_parts):
        _encode_parts(list(unknown), path)
    for w, (core, tail) in split.items():
        _words[w] = _parts[core] + _parts[tail]
    return [b"".join(map(_words.__getitem__, x)) + b"\0\0\0\0" for x in own]


def cut_pieces(docs: DataFrame, path: str, size: int = SEQUENCE) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every document's ids in pieces of ``size``, the last one shorter."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out: list = [[], [], [], [], []]
            for doc_id, ids in zip(batch.column(0).to_pylist(), token_bytes(batch.column(1).to_pylist(), path)):
                for k, at in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[at : at + 4 * size]
                    for c, v in zip(out, (doc_id, k, at // 4, len(part) // 4, zlib.crc32(part))):
                        c.append(v)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def patterns(hist: np.ndarray, size: int = SEQUENCE) -> np.ndarray:
    """Rows of four lengths (0: none) that leave at most ``MAX_SLACK``, made of lengths that occur."""
    there = np.flatnonzero(hist[: size + 1])
    there = there[(there > 0) & (there < size)]
    if not len(there):
        return np.zeros((0, 4), int)
    under = np.zeros(size + 1, int)  # the largest length that occurs, up to each value
    under[there] = there
    under = np.maximum.accumulate(under)
    picks = lambda k: np.unique(there[np.linspace(0, len(there) - 1, k).astype(int)])
    found = [np.stack([there, under[size - there], 0 * there, 0 * there], 1)]
    a, b = (x.ravel() for x in np.meshgrid(there, picks(14), indexing="ij"))
    fits = a + b < size
    a, b = a[fits], b[fits]
    found.append(np.stack([a, b, under[size - a - b], 0 * a], 1))
    a, b, c = (x.ravel() for x in np.meshgrid(there, picks(8), picks(8), indexing="ij"))
    fits = (b <= c) & (a + b + c < size)
    a, b, c = a[fits], b[fits], c[fits]
    found.append(np.stack([a, b, c, under[size - a - b - c]], 1))
    rows = -np.sort(-np.concatenate(found), axis=1)
    rows = np.unique(rows[rows.sum(1) >= size - MAX_SLACK], axis=0)
    if len(rows) > MAX_PATTERNS:
        rows = rows[np.linspace(0, len(rows) - 1, MAX_PATTERNS).astype(int)]
    return rows


def fit(rows: np.ndarray, hist: np.ndarray, rounds: int = 250) -> np.ndarray:
    """Non-negative repeat counts whose lengths come nearest to the histogram: accelerated projected gradient."""
    if not len(rows):
        return np.zeros(0)
    n, h = len(hist), hist.astype(float)
    h[0] = 0
    apply = lambda x: sum(np.bincount(rows[:, k], x, n) for k in range(4)) * (np.arange(n) > 0)
    back = lambda r: sum(r[rows[:, k]] * (rows[:, k] > 0) for k in range(4))
    v = np.ones(len(rows))
    for _ in range(15):
        w = back(apply(v))
        top = float(np.linalg.norm(w)) / max(float(np.linalg.norm(v)), 1e-12)
        v = w / max(float(np.linalg.norm(w)), 1e-12)
    x = y = np.zeros(len(rows))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - back(apply(y) - h) / (1.02 * top + 1e-9))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        x, y, t = new, new + (t - 1) / t2 * (new - x), t2
    return x


def plan(hist: np.ndarray, size: int = SEQUENCE) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats): patterns that hold exactly the histogram's pieces, none over ``size``."""
    left = hist.astype(np.int64).copy()
    left[0] = 0
    out: list[tuple[tuple[int, ...], int]] = []
    if left[size]:
        out.append(((size,), int(left[size])))
        left[size] = 0
    rows = patterns(left, size)
    x = fit(rows, left)
    for k in np.argsort(-x, kind="stable"):
        want = round(float(x[k]))
        if want < 1:
            break
        own = [int(v) for v in rows[k] if v]
        n = min(want, *(int(left[v]) // own.count(v) for v in own))
        if n > 0:
            out.append((tuple(own), n))
            for v in own:
                left[v] -= n
    return out + best_fit(left, size)


def best_fit(left: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, on counts: sequences with the same content are one group."""
    groups: dict[int, list] = defaultdict(list)  # by room: [content, how many]
    rooms: list[int] = []
    for v in np.flatnonzero(left)[::-1]:
        v, n = int(v), int(left[v])
        while n:
            at = bisect.bisect_left(rooms, v)
            if at == len(rooms):
                per = size // v
                new = [((v,) * per, n // per), ((v,) * (n % per), 1)]
                n = 0
                for content, many in new:
                    if content and many:
                        _put(groups, rooms, size - v * len(content), content, many)
                break
            room = rooms[at]
            content, many = groups[room].pop()
            if not groups[room]:
                rooms.pop(at)
            per = min(room // v, n)  # as many of this length as each takes
            took = min(many, n // per)
            if took < many:
                _put(groups, rooms, room, content, many - took)
            _put(groups, rooms, room - per * v, content + (v,) * per, took)
            n -= took * per
    return [(content, many) for x in groups.values() for content, many in x]


def _put(groups: dict, rooms: list[int], room: int, content: tuple, many: int) -> None:
    if room not in rooms[(at := bisect.bisect_left(rooms, room)) : at + 1]:
        rooms.insert(at, room)
    groups[room].append((content, many))


def pack(docs: DataFrame, path: str, size: int = SEQUENCE) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece.

    Null texts are the empty text, which still has its end id. Repeated rows are packed each;
    null doc_ids keep their pieces. An empty table gives no rows. Only the histogram of
    lengths (``size`` bins) reaches the driver, and the plan that goes back is bounded by the
    patterns and by the bins.
    """
    spark = docs.sparkSession
    got = durable(cut_pieces(docs, path, size).withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(RANK_PARTS)).cast("int")))
    per_part = got.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    hist = np.zeros(size + 1, np.int64)
    for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect():
        hist[r["length"]] = r["n"]
    # For each length, the places in the plan: from rank, sequences from, place within.
    first, rank = 0, np.zeros(size + 1, np.int64)
    keys, bases, offsets, starts = [], [], [], []
    for content, many in plan(hist, size):
        offset = 0
        for v in content:
            keys.append((v << 44) + int(rank[v]))
            bases.append(first)
            offsets.append(offset)
            starts.append(int(rank[v]))
            rank[v] += many
            offset += v
        first += many
    order = np.argsort(np.array(keys, np.int64))
    shared = spark.sparkContext.broadcast([np.array(x, np.int64)[order] for x in (keys, bases, offsets, starts)])

    before = per_part.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).select("length", "part", "before")
    own = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = got.withColumn("own", F.row_number().over(own) - 1).join(before, ["length", "part"]).withColumn("rank", F.col("own") + F.col("before"))

    def place(batches):
        import pyarrow as pa

        keys, bases, offsets, starts = shared.value
        for batch in batches:
            length, rank = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (3, 5))
            at = np.searchsorted(keys, (length << 44) + rank, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(bases[at] + rank - starts[at]), pa.array(offsets[at])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
            )

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    small_batches(spark)
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op8_packing": op8_packing}
ORACLES: dict = {}
