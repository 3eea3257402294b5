"""Periodic runs of words: stretches that repeat a short passage at least four times over.

A run of period q and length at least ``max(6, 4 q)`` agrees with itself shifted by q over a
stretch of at least ``max(5, 3 q)`` words. So for the periods from Q to 2 Q - 1 (Q a power of two)
an index of k-grams of that guaranteed overlap, k = max(5, 3 Q), has an occurrence pair of every
such run. As k is at least as long as the period, a k-gram inside a run occurs next exactly one
period later: the pairs of neighbouring occurrences are enough, they are at most as many as there
are words, and their lag is the smallest period. Each pair is a seed on the diagonal of its lag;
it is extended in both directions unless the table of the furthest covered word of that lag says
that an earlier extension has been there.
"""

from __future__ import annotations

import itertools
from collections import defaultdict

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

#: A run has ``LEAST`` words and ``TIMES`` periods at least.
LEAST, TIMES = 6, 4
#: Words that are compared at once when a seed is extended, at first.
_STEP = 64
RUN = "struct<start:bigint,length:bigint,period:bigint>"


def _pairs(names: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Equal pairs get equal numbers; pairs are numbered exactly, not hashed."""
    return np.unique(names * np.int64(len(names) + other.max() + 2) + other, return_inverse=True)[1]


class Grams:
    """Occurrences of k-grams that occur more than once, for growing k.

    Only positions whose shorter gram repeats can have a longer one that does, so the index
    shrinks as k grows.
    """

    def __init__(self, words: np.ndarray) -> None:
        self.n, self.size = len(words), 1
        self.at = np.arange(self.n)
        self.name = words.astype(np.int64)
        self._repeated()

    def _repeated(self) -> None:
        many = np.bincount(self.name, minlength=1)
        keep = many[self.name] > 1
        self.at, self.name = self.at[keep], self.name[keep]

    def grow(self, k: int) -> None:
        """To grams of ``k`` words: two grams of the last size that overlap, doubling as often as needed."""
        while self.size < k and len(self.at):
            shift = min(self.size, k - self.size)
            place = np.full(self.n + 1, -1, np.int64)
            place[self.at] = np.arange(len(self.at))
            second = place[np.minimum(self.at + shift, self.n)]
            keep = second >= 0
            first = np.flatnonzero(keep)
            self.at, self.name = self.at[first], _pairs(self.name[first], self.name[second[first]]) if len(first) else self.name[first]
            self.size += shift
            self._repeated()

    def neighbours(self) -> tuple[np.ndarray, np.ndarray]:
        """(position, lag) of every occurrence of a gram that has a next one."""
        order = np.lexsort((self.at, self.name))
        at, name = self.at[order], self.name[order]
        same = name[1:] == name[:-1]
        return at[:-1][same], (at[1:] - at[:-1])[same]


def _agreeing(words: np.ndarray, i: int, lag: int, way: int) -> int:
    """How many words from i on (way 1) or before i (way -1) equal the one ``lag`` later."""
    n, done, step = len(words) - lag, 0, _STEP
    while True:
        a, b = (i + done, min(n, i + done + step)) if way > 0 else (max(0, i - done - step), i - done)
        if a >= b:
            return done
        differ = np.flatnonzero(words[a:b] != words[a + lag : b + lag])
        if len(differ):
            return done + int(differ[0] if way > 0 else b - a - 1 - differ[-1])
        done, step = done + b - a, 2 * step


def runs(words: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs among numbered words, by start, then period. ``times`` is 3 or more."""
    found, grams, q = [], Grams(words), 1
    covered: dict[int, int] = {}
    while q * times <= len(words) and len(grams.at):
        k = max(least - 2 * q + 1, (times - 1) * q)
        grams.grow(k)
        at, lag = grams.neighbours()
        own = (lag >= q) & (lag < 2 * q)
        order = np.lexsort((at[own], lag[own]))
        at, lag = at[own][order], lag[own][order]
        edges = np.flatnonzero(np.diff(lag, prepend=0, append=0))
        for a, b in itertools.pairwise(edges):
            period, seeds, s = int(lag[a]), at[a:b], 0
            while s < len(seeds):
                i = int(seeds[s])
                start = i - _agreeing(words, i, period, -1)
                covered[period] = i + k + _agreeing(words, i + k, period, 1)
                length = covered[period] - start + period
                if length >= max(least, times * period):
                    found.append((start, length, period))
                s = int(np.searchsorted(seeds, covered[period]))
        q *= 2
    return sorted(found, key=lambda r: (r[0], r[2]))


def numbered(words: list) -> np.ndarray:
    number = defaultdict(itertools.count().__next__)
    return np.fromiter(map(number.__getitem__, words), np.int64, len(words))


def collapsed(words: list, found: list[tuple[int, int, int]]) -> list:
    """Without the words that a run has after its first period."""
    if not found:
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        gone[start + period] += 1
        gone[start + length] -= 1
    keep = np.cumsum(gone[:-1]) == 0
    return list(itertools.compress(words, keep.tolist()))


def periodic_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs, text) of every row.

    ``runs`` are all maximal periodic runs of words ``[^\\x20\\x09-\\x0D]+`` with at least 6
    words and four of their smallest periods, by start and period; ``text`` has the words that
    stay when each run is cut to its first period, joined by spaces. Null and empty texts have
    no words. Texts of any length are read whole, in time about linear in their words. Null
    ids are kept, repeated rows give a row each, an empty table none; extra columns are dropped.
    """

    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))
        for batch in batches:
            many, all_runs, kept = [], [], []
            for text in batch.column(1).to_pylist():
                words = (text or b"").split()
                found = runs(numbered(words)) if len(words) >= LEAST else []
                many.append(len(words))
                all_runs.append([{"start": s, "length": n, "period": q} for s, n, q in found])
                kept.append(b" ".join(collapsed(words, found)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(many, pa.int64()), pa.array(all_runs, kind), pa.array(kept, pa.binary())], ["doc_id", "n_words", "runs", "kept"])

    found = docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(run, f"doc_id long, n_words long, runs array<{RUN}>, kept binary")
    return found.select("doc_id", "n_words", "runs", F.col("kept").cast("string").alias("text"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text): of the documents with h % 10 = 0, h = crc32(doc_id), the words from a on repeat the first p of them."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10).cast("long")
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rest = docs.select("doc_id", "text", h.alias("h"), g.alias("g"), words.alias("w")).withColumn("n", F.size("w"))
    a, n = F.col("g") % F.greatest("n", F.lit(1)), F.col("n")
    p = 1 + F.floor((n - a) / (3 + F.col("g") % 8))
    # a, p and n are at most the number of words.
    rest = rest.withColumn("a", a.cast("int")).withColumn("p", p.cast("int"))
    unit = F.slice("w", F.col("a") + 1, F.col("p"))
    again = F.slice(F.flatten(F.array_repeat(unit, F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int"))), F.lit(1), F.col("n") - F.col("a"))
    planted = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), again), " ")
    return rest.select("doc_id", F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), planted).otherwise(F.col("text")).alias("text"))


def _best(found: Column) -> Column:
    """The run with the greatest length over period; of equal ones the first. Compared in whole numbers."""
    wide = lambda x: x.cast("decimal(19,0)")
    better = lambda r, b: b.isNull() | (wide(r["length"]) * wide(b["period"]) > wide(b["length"]) * wide(r["period"]))
    return F.aggregate(found, F.lit(None).cast(RUN), lambda b, r: F.when(better(r, b), r).otherwise(b))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = with_planted_runs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = periodic_runs(docs).withColumn("best", _best(F.col("runs")))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"),
    )


QUERIES = {"op12_periodic_runs": op12_periodic_runs}
#: Equal 5-grams of a document at most a quarter of it apart, joined to stretches on each lag.
ORACLES = {
    "op12_periodic_runs": r"""
WITH hashed AS (
    SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
        xor(4294967295, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)),
            lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::UBIGINT) ELSE x // 2 END)))::BIGINT AS h
    FROM documents),
cut AS (SELECT *, len(w) AS n, (h // 10) % greatest(len(w), 1) AS a, (h // 10) % 8 AS e FROM hashed),
word AS (
    SELECT doc_id, n, i, w[1 + CASE WHEN h % 10 = 0 AND i >= a THEN a + (i - a) % (1 + (n - a) // (3 + e)) ELSE i END] AS word
    FROM (SELECT *, unnest(range(n)) AS i FROM cut)),
gram AS (
    SELECT doc_id, n, i, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o || ' ' || lead(word, 4) OVER o AS g
    FROM word WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
often AS (SELECT * FROM gram WHERE g IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
pair AS (SELECT a.doc_id, a.i, b.i - a.i AS q FROM often a JOIN often b ON a.doc_id = b.doc_id AND a.g = b.g AND b.i > a.i AND 4 * (b.i - a.i) <= a.n),
island AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM pair),
stretch AS (SELECT doc_id, q, min(i) AS s, max(i) - min(i) + 5 + q AS l FROM island GROUP BY doc_id, q, k HAVING max(i) - min(i) + 5 + q >= greatest(6, 4 * q)),
run AS (SELECT * FROM stretch r WHERE NOT EXISTS (FROM stretch o WHERE o.doc_id = r.doc_id AND o.q < r.q AND r.q % o.q = 0 AND o.s <= r.s AND o.s + o.l >= r.s + r.l)),
listed AS (
    SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM run GROUP BY doc_id),
best AS (
    SELECT r.* FROM run r WHERE NOT EXISTS (FROM run o WHERE o.doc_id = r.doc_id AND (o.l * r.q > r.l * o.q OR (o.l * r.q = r.l * o.q AND (o.s < r.s OR (o.s = r.s AND o.q < r.q)))))),
kept AS (
    SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS body FROM word t
    WHERE NOT EXISTS (FROM run r WHERE r.doc_id = t.doc_id AND t.i >= r.s + r.q AND t.i < r.s + r.l) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, s AS "start", l AS length, q AS period, 1000 * l // q AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(body, '')) AS collapsed_sha256
FROM documents LEFT JOIN listed USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
}
