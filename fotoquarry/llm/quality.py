"""Document quality by co-training of a text view and a metadata view.

The text view sees the content (bytes, byte trigrams, word shapes), the metadata view the source,
the language and the length; both are logistic regressions, calibrated on labelled rows that they
have not learned from. In each round every view scores all unlabelled documents and hands the
ones of which it is surest, by rank, as pseudo-labels to the other view. A pseudo-label weighs what
its view knows: the part of the uncertainty of the base rate that its calibrated probability takes
away, so that a view that knows nothing changes nothing. In the end the calibrated log odds of both
views are added.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import boxed, small_batches, table

#: Bound of the labelled rows that are learned from (about).
LABELLED = 4000
#: Rounds of exchange, and pseudo-labels that a view hands over in a round.
ROUNDS, PER_ROUND = 2, 300
#: Score from which a document is kept.
KEEP = 0.5
_SOURCES, _TRIGRAMS, _SHAPES = 64, 1024, 16
TEXT, META = 128 + _SHAPES + _TRIGRAMS, 64 + 16 + 24
VIEWS = ("text", "metadata")


def text_features(text: bytes | None) -> np.ndarray:
    """Shares of bytes, of hashed byte trigrams and of word shapes over the whole text; zeros without words."""
    own = (text or b"").split()
    out = np.zeros(TEXT, np.float32)
    if not own:
        return out
    n, raw = len(own), np.frombuffer(text, np.uint8)
    by = np.bincount(raw, minlength=256) / len(text)
    out[:128] = np.sqrt(by[:128])
    lines = text.split(b"\n")
    out[128:144] = (
        np.sqrt(by[128:].sum()), len(set(own)) / n, np.log1p(n) / 10, len(text) / n / 20, 1 - len(set(lines)) / len(lines), by[65:91].sum() / max(by[65:91].sum() + by[97:123].sum(), 1e-9), by[48:58].sum(),
        (by[33:48].sum() + by[58:65].sum() + by[91:97].sum() + by[123:127].sum()) * 4, sum(map(bytes.isupper, own)) / n, own.count(own[n // 2]) / n, own.count(b"|") / n, max(map(len, own)) > 60, n < 20, 0, 0, 0,
    )
    if len(raw) > 2:
        low = raw.astype(np.uint32)
        code = (low[:-2] | low[1:-1] << np.uint32(8) | low[2:] << np.uint32(16)) * np.uint32(2654435761) >> np.uint32(22)
        out[144:] = np.sqrt(np.bincount(code, minlength=_TRIGRAMS) / len(code))
    return out


def meta_features(lang: str | None, source: str | None, chars: int | None) -> np.ndarray:
    """Source and language hashed into indicators, length in logarithmic steps; nulls are values of their own."""
    out = np.zeros(META, np.float32)
    out[zlib.crc32((source or "").encode()) % _SOURCES] = 1
    out[_SOURCES + zlib.crc32((lang or "").encode()) % 16] = 1
    out[_SOURCES + 16 + min(23, max(0, int(chars or 0)).bit_length())] = 1
    return out


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-3, steps: int = 25) -> np.ndarray:
    """Weights (the last is the intercept) by Newton's method; y from 0 to 1. Wide tables are solved in their 256 principal directions."""
    base = None
    if x.shape[1] > 512:
        base = np.linalg.eigh(np.cov(x, rowvar=False))[1][:, -256:].T
        x = x @ base.T
    x = np.hstack([x, np.ones((len(x), 1))]).astype(float)
    b = np.zeros(x.shape[1])
    pull = ridge * w.sum() * np.eye(len(b))
    pull[-1, -1] = 1e-9
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + pull, x.T @ (w * (y - p)) - pull @ b)
        b += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return b if base is None else np.append(b[:-1] @ base, b[-1])


def _odds(x: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.clip(x @ b[:-1] + b[-1], -30, 30)


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -30, 30)))


def knowledge(p: np.ndarray, base: float) -> np.ndarray:
    """The part of the entropy of the base rate that a probability takes away, from 0 to 1."""
    h = lambda q: -(q * np.log(q) + (1 - q) * np.log(1 - q))
    return np.clip(1 - h(np.clip(p, 1e-9, 1 - 1e-9)) / h(base), 0.0, 1.0)


def _fit(views: list[np.ndarray], label: np.ndarray, more: list[tuple[np.ndarray, np.ndarray, np.ndarray]], base: float) -> list:
    """(weights, calibration) of each view: learned from two thirds of the labelled rows and the other view's pseudo-labels, calibrated on the last third."""
    rows = np.arange(len(label))
    cal, fit = rows % 3 == 0, rows % 3 != 0
    out = []
    for x, (mx, my, mw) in zip(views, more):
        own = np.concatenate([x[fit], mx]) if len(mx) else x[fit]
        b = _logistic(own, np.concatenate([label[fit], my]), np.concatenate([np.ones(fit.sum()), mw]))
        c = _logistic(_odds(x[cal], b)[:, None], label[cal], np.ones(cal.sum()), 1e-2)
        c[0] = max(c[0], 0.0)
        out.append((b, c))
    return out


def trainable(label: np.ndarray) -> bool:
    """Two classes among the rows that are learned from and among those that calibrate."""
    rows = np.arange(len(label))
    return len(label) >= 20 and all(len(set(label[part])) == 2 for part in (rows % 3 == 0, rows % 3 != 0))


def co_train(text: np.ndarray, meta: np.ndarray, label: np.ndarray, surest, rounds: int = ROUNDS, per_round: int = PER_ROUND) -> dict:
    """The model. ``label`` is 0 or 1.

    ``surest(model, per class, taken)`` gives, for each view, the (text, metadata, pseudo-label,
    probability, key) rows of the unlabelled documents of which it is surest, none of whose keys is
    in ``taken``. Each view hands over ``per_round`` of them, the classes in proportion to the base rate.
    """
    base = float(np.clip(label.mean(), 1e-3, 1 - 1e-3)) if len(label) else 0.5
    model = {"prior": np.log(base / (1 - base)), "views": None, "exchange": []}
    if not trainable(label):
        return model
    none = lambda x: (np.zeros((0, x.shape[1]), x.dtype), np.zeros(0), np.zeros(0))
    more, taken = [none(text), none(meta)], [set(), set()]
    model["views"] = _fit([text, meta], label, more, base)
    ones = min(per_round - 1, max(1, round(per_round * base)))
    for _ in range(rounds):
        given = {}
        for k, found in enumerate(surest(model, {1: ones, 0: per_round - ones}, taken)):
            t, m, y, p, key = found
            weight, to = knowledge(p, base), 1 - k
            x = (t, m)[to]
            if len(y):
                more[to] = tuple(np.concatenate([a, b]) for a, b in zip(more[to], (x, y, weight)))
            taken[k].update(key)
            given[VIEWS[k]] = (len(y), float(weight.sum()))
        model["exchange"].append(given)
        model["views"] = _fit([text, meta], label, more, base)
    return model


def view_probabilities(model: dict, text: np.ndarray, meta: np.ndarray) -> list[np.ndarray]:
    return [_sigmoid(_odds(_odds(x, b)[:, None], c)) for x, (b, c) in zip((text, meta), model["views"])]


def score_batch(model: dict, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(score, text view, metadata view): log odds of both views, the prior counted once."""
    odds = [np.full(len(text), model["prior"])] * 2
    if model["views"]:
        odds = [_odds(_odds(x, b)[:, None], c) for x, (b, c) in zip((text, meta), model["views"])]
    return _sigmoid(odds[0] + odds[1] - model["prior"]), _sigmoid(odds[0]), _sigmoid(odds[1])


_COLUMNS = ("doc_id", "lang", "source", "n_chars")


def _features(batch, first: int = 1) -> tuple[np.ndarray, np.ndarray]:
    lang, source, chars, text = (batch.column(k).to_pylist() for k in range(first, first + 4))
    return np.array([text_features(t) for t in text], np.float32).reshape(-1, TEXT), np.array([meta_features(*x) for x in zip(lang, source, chars)], np.float32).reshape(-1, META)


def _feature_rows(rows: DataFrame) -> list[tuple]:
    """(doc_id, y, text features, metadata features) of a bounded frame (_COLUMNS, text, y), in one order however the rows came."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            t, m = _features(batch)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(5), *(pa.array([r.tobytes() for r in x], pa.binary()) for x in (t, m))], ["doc_id", "y", "t", "m"])

    got = [(r["doc_id"], r["y"], bytes(r["t"]), bytes(r["m"])) for r in rows.mapInArrow(run, "doc_id long, y double, t binary, m binary").collect()]
    return sorted(got, key=lambda r: (zlib.crc32(str(r[0]).encode()), str(r[0]), r[2]))


def _matrix(rows: list[tuple], k: int, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(r[k] for r in rows), np.float32).reshape(-1, width)


def train(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS, per_round: int = PER_ROUND, most: int = LABELLED) -> dict:
    """The model: learned from at most about ``most`` of the labelled documents at hand, by a hash of their ids, and from pseudo-labels of all documents."""
    spark = docs.sparkSession
    docs = docs.select(*_COLUMNS, F.col("text").cast("binary").alias("text"))
    label = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").cast("double").alias("y"))
    label = label.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").withColumn("draw", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)))
    many = label.count()
    chosen = F.broadcast(label.where(F.col("draw") < F.lit(int((1 << 40) * min(1.0, most / max(many, 1))))).select("doc_id", "y"))  # about ``most`` rows
    known = _feature_rows(docs.join(chosen, "doc_id").select(*_COLUMNS, "text", "y"))
    pool = docs.where("doc_id IS NOT NULL").join(chosen, "doc_id", "left_anti")

    def surest(model: dict, per_class: dict, taken: list[set]) -> list:
        shared = spark.sparkContext.broadcast((model, per_class, taken))

        def best(batches):
            """(view, class, p, tie, doc_id): the surest documents of this task; more than are asked for by none."""
            import pyarrow as pa

            model, per_class, taken = shared.value
            top: dict = {(v, c): [] for v in (0, 1) for c in per_class}
            for batch in batches:
                ids = batch.column(0).to_pylist()
                for v, p in enumerate(view_probabilities(model, *_features(batch)) if ids else []):
                    for c, n in per_class.items():
                        sure = p if c else 1 - p
                        own = top[v, c]
                        least = own[-1][0] if len(own) >= n else 2.0
                        new = [(-float(sure[k]), zlib.crc32(str(ids[k]).encode()), ids[k]) for k in np.flatnonzero(-sure <= least) if ids[k] not in taken[v]]
                        top[v, c] = sorted({*own, *new})[:n]
            flat = [(v, c, -s, t, i) for (v, c), own in top.items() for s, t, i in own]
            kinds = (pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in flat], t) for k, t in enumerate(kinds)], ["view", "class", "p", "tie", "doc_id"])

        found = pool.select(*_COLUMNS, "text").mapInArrow(best, "view int, class int, p double, tie long, doc_id long").distinct()
        order = Window.partitionBy("view", "class").orderBy(F.desc("p"), "tie", "doc_id")
        limit = F.create_map(*[F.lit(x) for pair in per_class.items() for x in pair])
        picked = found.withColumn("k", F.row_number().over(order)).where(F.col("k") <= limit[F.col("class")]).collect()
        ids = spark.createDataFrame([(i,) for i in {r["doc_id"] for r in picked}], "doc_id long")
        rows = pool.join(F.broadcast(ids), "doc_id").dropDuplicates(["doc_id"]).select(*_COLUMNS, "text", F.lit(None).cast("double").alias("y"))
        by = {r[0]: r for r in _feature_rows(rows)}
        out = []
        for v in (0, 1):
            own = sorted((r["doc_id"], r["class"], r["p"]) for r in picked if r["view"] == v)
            p = np.array([q if c else 1 - q for _, c, q in own])
            out.append((_matrix([by[i] for i, *_ in own], 2, TEXT), _matrix([by[i] for i, *_ in own], 3, META), np.array([float(c) for _, c, _ in own]), p, [i for i, *_ in own]))
        return out

    return co_train(_matrix(known, 2, TEXT), _matrix(known, 3, META), np.array([r[1] for r in known], float), surest, rounds, per_round)


def score(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """(doc_id, score, text_score, meta_score, keep) of every row.

    Scores are calibrated probabilities of quality 1. Null and empty texts have no words and
    score by their metadata and what the text view makes of none. Without two classes among
    the labels, or with fewer than 20 labelled documents, every document has the base rate.
    Labels with a null or other quality, a null doc_id or no document here are ignored; of
    several labels of a document the largest counts. Repeated rows give a row each, an empty
    table none. Extra columns are dropped.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(train(docs, labels, **how))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                s = score_batch(model.value, *_features(batch))
                yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, s), pa.array(s[0] >= KEEP)], ["doc_id", "score", "text_score", "meta_score", "keep"])

    return docs.select(*_COLUMNS, F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, score double, text_score double, meta_score double, keep boolean")


def keep_good(docs: DataFrame, labels: DataFrame, least: float = KEEP) -> DataFrame:
    """The rows that score at least ``least``; all columns stay, whatever they are called. Where nothing can be learned (see ``score``) all rows stay."""
    inner, at, places = boxed(docs, *_COLUMNS, "text")
    named = inner.select(*[F.col(at[c]).alias(c) for c in (*_COLUMNS, "text")])
    model = docs.sparkSession.sparkContext.broadcast(train(named, labels))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            n = batch.num_columns - 5
            own = batch.select(range(n))
            if batch.num_rows and model.value["views"]:
                own = own.filter(pa.array(score_batch(model.value, *_features(batch, n + 1))[0] >= least))
            yield own

    more = [F.col(at[c]).alias(f"own_{c}") for c in _COLUMNS] + [F.col(at["text"]).cast("binary").alias("own_text")]
    return inner.select(*places, *more).mapInArrow(run, inner.schema).toDF(*docs.columns)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op10_quality": op10_quality}
ORACLES: dict = {}
