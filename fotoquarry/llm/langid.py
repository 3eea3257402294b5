"""Language identification with blended-spectrum string kernels.

The kernel of two texts is the number of 1- to 4-byte n-grams that occur in both, over the
square root of the product of their numbers. Landmark texts give the Nyström map, one-versus-
rest kernel ridge regression the class scores. N-grams are exact, not hashed: only those of the
landmarks matter to a kernel value, so the table of weights has a row for each of them and grows
with the landmarks. A batch of texts is scored by one product of its sparse presence matrix with
that table.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import boxed, small_batches, table

ORDERS = 4
#: Bounds of what the model is learned from: rows in all and rows of a language (about); each language has a row at least.
MOST_ROWS, PER_LANGUAGE = 8192, 300
#: Landmark texts in all where there are few languages, and of each language at least.
LANDMARKS, PER_LANDMARKS = 128, 8
RIDGE, SHARPNESS = 1e-3, 4.0
#: Share of a language's usual evidence (its labelled texts but the least 5 %) that a text needs to be
#: kept, and the n-grams below which a text is too short for that much.
EVIDENCE, FEW = 0.45, 64
#: Texts that are scored by one matrix product.
_ROWS = 64
_KEEP = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def grams(text: bytes) -> np.ndarray:
    """The n-grams that occur among the letters of a text, sorted; runs of anything else are one space. Fewer than four bytes are filled up with zeros, which no text has."""
    a = np.frombuffer(b" " + b" ".join(text.translate(_KEEP).split()) + b" ", np.uint8).astype(np.uint32)
    code, found = np.zeros(len(a), np.uint32), []
    for n in range(ORDERS):
        code = code[: len(a) - n] | (a[n:] << np.uint32(8 * n))
        found.append(code)
    return np.unique(np.concatenate(found))


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, most: int = MOST_ROWS, per_language: int = PER_LANGUAGE) -> list[tuple[str, bytes]]:
    """(lang, grams) of a bounded sample of the learnable rows, the first of each language by a hash of their ids.

    Every language has the same share of ``most`` rows and one at least, ``per_language`` at the
    most, so that with more languages each has fewer rows and none is left out.
    """
    own = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & has_letter(F.col("text")) & ~held_out(F.col("doc_id")))
    counts = own.groupBy("lang").count()
    languages = counts.count()
    if not languages:
        return []
    per = max(1, min(per_language, most // languages))
    # A draw with a wide margin bounds what is ranked; a language has none drawn with a chance of e**-20.
    # A row a language is sent to all tasks, as the model itself is.
    share = counts.select(F.col("lang").alias("known"), ((4.0 * per + 20) / F.col("count")).alias("share"))
    drawn = own.select("lang", "doc_id", F.col("text").cast("binary").alias("text"), (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))).alias("draw"))
    drawn = drawn.join(F.broadcast(share), F.col("lang") == F.col("known")).where("draw < share")
    order = Window.partitionBy("lang").orderBy("draw", "doc_id", "text")
    chosen = drawn.select("lang", "text", F.row_number().over(order).alias("k")).where(F.col("k") <= per).select("lang", "text")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([grams(t).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], ["lang", "grams"])

    return sorted((r["lang"], bytes(r["grams"])) for r in chosen.mapInArrow(run, "lang string, grams binary").collect())


def kernel(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Kernel values of two lists of texts, each by its grams."""
    known = np.unique(np.concatenate(right))
    x = np.zeros((len(right), len(known)), np.float32)
    for k, g in enumerate(right):
        x[k, np.searchsorted(known, g)] = 1
    out = np.zeros((len(left), len(right)))
    for k, g in enumerate(left):
        at = np.minimum(np.searchsorted(known, g), len(known) - 1)
        out[k] = x[:, at[known[at] == g]].sum(1)
    return out / np.sqrt(np.outer([len(g) for g in left], [len(g) for g in right]))


def learn(rows: list[tuple[str, bytes]]) -> dict:
    """Kernel ridge regression on the Nyström features of the rows.

    Classes are told apart on targets of 1 and -1. Evidence has targets of 1 and 0: about 1 for a
    text of the language, near 0 for what is like no landmark, however many languages there are.
    Both are linear in a text's presence vector, so the landmarks and weights fold into one row
    of weights for each n-gram.
    """
    names = sorted({lang for lang, _ in rows})
    own = [np.frombuffer(g, np.uint32) for _, g in rows]
    y = np.array([[1.0 if lang == n else -1.0 for n in names] for lang, _ in rows])
    by = {n: [k for k, (lang, _) in enumerate(rows) if lang == n] for n in names}
    per = max(PER_LANDMARKS, LANDMARKS // len(names))
    chosen = sorted(k for ids in by.values() for k in ids[:: max(1, len(ids) // per)][:per])
    marks = [own[k] for k in chosen]
    cross = kernel(own, marks)
    value, vector = np.linalg.eigh(cross[chosen])
    good = value > 1e-6 * value.max()
    whiten = vector[:, good] / np.sqrt(value[good])
    z = cross @ whiten
    # Classes weigh the same, however many texts each has.
    w = (1.0 / np.array([len(by[lang]) for lang, _ in rows]))[:, None]
    w /= w.mean()
    ridge = z.T @ (w * z) + RIDGE * len(rows) * np.eye(z.shape[1])
    fit, seen = np.linalg.solve(ridge, z.T @ (w * y)), np.linalg.solve(ridge, z.T @ (w * (y + 1) / 2))
    usual = np.array([np.quantile(z[by[n]] @ seen[:, c], 0.05) for c, n in enumerate(names)])
    known = np.unique(np.concatenate(marks))
    both = np.hstack([whiten @ fit, whiten @ seen]) / np.sqrt([[len(g)] for g in marks])
    weights = np.zeros((len(known) + 1, both.shape[1]), np.float32)  # the last row is for n-grams of no landmark
    for g, row in zip(marks, both.astype(np.float32)):
        weights[np.searchsorted(known, g)] += row
    return {"names": names, "grams": known, "weights": weights, "usual": usual}


def _scores(model: dict, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class scores, evidence, n-grams) of a batch: its sparse presence matrix times the weights."""
    found = [grams(t) for t in texts]
    n = np.array([len(g) for g in found])
    flat, known = np.concatenate(found), model["grams"]
    at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
    at[known[at] != flat] = len(known)
    f = np.add.reduceat(model["weights"][at], np.concatenate(([0], np.cumsum(n)[:-1])), axis=0, dtype=np.float64) / np.sqrt(n)[:, None]
    classes = len(model["names"])
    return f[:, :classes], f[:, classes:], n


def _predict(model, texts: list, letters: list) -> tuple[list[str], list[float]]:
    pred, score = ["und"] * len(texts), [0.0] * len(texts)
    live = [k for k, ok in enumerate(letters) if ok] if model else []
    for at in range(0, len(live), _ROWS):
        part = live[at : at + _ROWS]
        f = _scores(model, [texts[k] for k in part])[0] * SHARPNESS
        p = np.exp(f - f.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        for k, best, own in zip(part, p.argmax(1), p):
            pred[k], score[k] = model["names"][best], float(own[best])
    return pred, score


def _known(model, texts: list, letters: list, share: float) -> list[bool]:
    """Whether a text has enough evidence of some language."""
    ok = [False] * len(texts)
    live = [k for k, a in enumerate(letters) if a]
    for at in range(0, len(live), _ROWS):
        part = live[at : at + _ROWS]
        _, seen, n = _scores(model, [texts[k] for k in part])
        good = seen >= share * model["usual"] * np.sqrt(np.minimum(1.0, n / FEW))[:, None]
        for k, own in zip(part, good.any(1).tolist()):
            ok[k] = own
    return ok


def _model(train: DataFrame):
    rows = sample(train.select("doc_id", "text", "lang"))
    return train.sparkSession.sparkContext.broadcast(learn(rows) if rows else None)


def identify(docs: DataFrame, train: DataFrame | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row.

    ``lang_pred`` is ``und`` with score 0 for texts that are null or have no letter, and for
    all texts if nothing can be learned. Only rows of ``train`` (``docs`` by default) with an
    id, a language and a letter whose id is not held out are learned from. A null id is not
    held out. Texts of any length are read whole; equal scores go to the first language by name.
    Extra columns are dropped; repeated rows give a row each, an empty table none.
    """
    model = _model(docs if train is None else train)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            pred, score = _predict(model.value, batch.column(2).to_pylist(), batch.column(3).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    text = F.col("text")
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), text.cast("binary").alias("text"), has_letter(text).alias("letter")).mapInArrow(
        run, "doc_id long, held_out boolean, lang_pred string, score double"
    )


def keep_known(docs: DataFrame, share: float = EVIDENCE) -> DataFrame:
    """The rows with evidence of a learned language, ``share`` of its usual one at least; all columns stay, whatever they are called.

    Texts that are null or have no letter go. If nothing can be learned, all other rows stay.
    Repeated rows are judged each, and alike; null ids and languages do not matter.
    """
    inner, at, places = boxed(docs, "text", "lang", "doc_id")
    model = _model(inner.select(*[F.col(at[c]).alias(c) for c in at]))
    text = F.col(at["text"])
    judged = inner.select(*places, text.cast("binary").alias("raw"), has_letter(text).alias("letter"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            letters = batch.column(batch.num_columns - 1).to_pylist()
            ok = letters
            if model.value:
                ok = _known(model.value, batch.column(batch.num_columns - 2).to_pylist(), letters, share)
            yield batch.select(range(batch.num_columns - 2)).filter(pa.array(ok, pa.bool_()))

    return judged.mapInArrow(run, inner.schema).toDF(*docs.columns)


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return identify(table(spark, sf_dir, "documents"))


QUERIES = {"op4_langid": op4_langid}
ORACLES: dict = {}
