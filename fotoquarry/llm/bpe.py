"""Byte-level BPE encoding and decoding through a distinct-word table.

Texts are split into words at places where the tokenizer's own pre-splitting always cuts, so
that the ids of a text are the ids of its words in order. Each distinct word of the corpus is
counted, words that occur often are encoded once, decoded once through the id-to-piece join
and joined back by position from a table of bounded size; see ``encode_decode``.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, small_batches, table

#: White space as the tokenizer's pattern has it; Python's own class is wider.
_WS = "\t-\r \x85\xa0  -     　"
_WORD = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
SPECIAL = "<|endoftext|>"

#: Bounds of the broadcast word table: its words, and the characters of each.
TABLE_WORDS, TABLE_CHARS = 200_000, 48
#: Words that a task remembers beside the table.
_MEMORY = 100_000


def words(text: str | None) -> list[str]:
    """The words of a text, white space included; the special string is a word of its own. Null has none.

    >>> words("a  b\\n")
    ['a', ' ', ' b', '\\n']
    """
    if not text:
        return []
    if SPECIAL not in text:
        return _WORD.findall(text)
    out: list[str] = []
    for k, part in enumerate(text.split(SPECIAL)):
        if k:
            out.append(SPECIAL)
        out += _WORD.findall(part)
    return out


_loaded: dict = {}


def tokenizer(path: str):
    """The tokenizer in this Python worker; kept for the worker's later tasks."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _loaded[path] = t
    return _loaded[path]


def encode(path: str, texts: list[str]) -> list[list[int]]:
    return [e.ids for e in tokenizer(path).encode_batch(texts, add_special_tokens=False)]


def pieces(path: str) -> list[tuple[int, bytes]]:
    """(id, bytes) of each piece of a byte-level vocabulary file."""
    raw = json.load(open(path, encoding="utf-8"))
    # Byte-level files write each byte as a printable character: printable Latin-1 as itself, the others from U+0100 on.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    found = {i: bytes(byte_of[c] for c in p) for p, i in raw["model"]["vocab"].items()}
    found |= {t["id"]: t["content"].encode() for t in raw["added_tokens"]}
    return sorted(found.items())


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all texts; each task adds up before it sends."""

    def count(batches):
        import pyarrow as pa

        seen: Counter = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
            seen.clear()
            return out

        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(words(text))
                if len(seen) > 300_000:
                    yield flush()
        if seen:
            yield flush()

    return docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, most: int = TABLE_WORDS) -> DataFrame:
    """The words that occur at least so often that ``most`` of them at the most do; long ones left out."""
    short = counts.where(F.length("word") <= TABLE_CHARS)
    level = F.when(F.col("n") < 4096, F.col("n")).otherwise(F.lit(4096))
    by_level = short.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect()  # 4096 rows at the most
    least, total = 4097, 0
    for row in by_level:
        if total + row["count"] > most:
            break
        least, total = row["level"], total + row["count"]
    if least > 4096 and by_level:  # more very frequent words than the table holds: the longest counts by plain order
        return short.orderBy(F.desc("n"), "word").limit(most)
    return short.where(F.col("n") >= least)


def word_table(chosen: DataFrame, path: str) -> DataFrame:
    """(word, ids, n_tokens, decoded): every word encoded once; the bytes by a join of ids with pieces."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(encode(path, texts), pa.list_(pa.int32()))], ["word", "ids"])

    spark = chosen.sparkSession
    coded = durable(chosen.select("word").mapInArrow(run, "word string, ids array<int>"))
    names = spark.createDataFrame(pieces(path), "id int, piece binary")
    spread = coded.select("word", F.posexplode("ids").alias("at", "id")).join(F.broadcast(names), "id")
    hexed = F.transform(F.sort_array(F.collect_list(F.struct("at", F.hex("piece").alias("h")))), lambda x: x["h"])
    decoded = spread.groupBy("word").agg(F.unhex(F.array_join(hexed, "")).alias("decoded"), F.count(F.lit(1)).alias("n_tokens"))
    return coded.join(decoded, "word").select("word", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"), "n_tokens", "decoded")


#: This worker's word table: (ids of a word, each with a comma behind; the bytes that these ids decode to), by the run that it belongs to.
_tables: dict[str, tuple[dict, dict]] = {}
_later: set[str] = set()


def _remember(table: tuple[dict, dict], word: str, ids: str, decoded: bytes) -> None:
    table[0][word], table[1][word] = f"{ids}," if ids else "", bytes(decoded)


def _table(key: str, shared) -> tuple[dict, dict]:
    if key not in _tables:
        _tables.clear()
        _later.clear()
        _tables[key] = ({}, {})
        for row in zip(*shared.value):
            _remember(_tables[key], *row)
    return _tables[key]


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row.

    Null and empty texts have no ids. Repeated rows and repeated or null doc_ids give a row
    each. Words beyond the table (rarer than its rarest, or longer than ``TABLE_CHARS``) are
    encoded where they stand, with the same tokenizer and the same piece table, so that the
    result does not depend on the table's size.
    """
    spark = docs.sparkSession
    counts = durable(word_counts(docs))
    known = word_table(frequent(counts), path).toArrow()  # TABLE_WORDS rows of TABLE_CHARS characters at the most
    shared = spark.sparkContext.broadcast([known.column(k).to_pylist() for k in (0, 1, 3)])
    names = spark.sparkContext.broadcast([b for _, b in pieces(path)])
    key = uuid.uuid4().hex

    def run(batches):
        import pyarrow as pa

        table, later = _table(key, shared), _later
        ids_of, bytes_of = table
        for batch in batches:
            n_tokens, id_sha, text_sha = [], [], []
            for text in batch.column(1).to_pylist():
                own = words(text)
                if new := list(set(own).difference(ids_of)):
                    if len(later) > _MEMORY:
                        for w in later.difference(own):
                            del ids_of[w], bytes_of[w]
                        later.intersection_update(own)
                    for w, got in zip(new, encode(path, new)):
                        _remember(table, w, ",".join(map(str, got)), b"".join([names.value[i] for i in got]))
                    later.update(new)
                ids = "".join(map(ids_of.__getitem__, own))
                n_tokens.append(ids.count(","))
                id_sha.append(hashlib.sha256(ids[:-1].encode()).hexdigest())
                # The text is what the pieces of its ids make, word by word.
                back = b"".join(map(bytes_of.__getitem__, own)).decode("utf-8", "replace")
                text_sha.append(hashlib.sha256(back.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_tokens, pa.int64()), pa.array(id_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    small_batches(spark)
    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op7_bpe": op7_bpe}
ORACLES: dict = {}
