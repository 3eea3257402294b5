"""Perceptual fingerprints of grey images: which photos need one, how it is made and where it goes."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .duplicates import FLAT

#: Side of the grey image, side of the block of low frequencies, and the standard
#: deviation of grey values (0 to 255) below which an image says nothing.
SIDE, LOW, FLAT_STD = 32, 8, 4.0
#: Decimals of the coefficients that are compared, so that no bit hangs on the order of a sum.
DECIMALS = 6
#: Images that are transformed at once, 8 kB each and a few copies.
IMAGES = 512
#: Where a piece of a text that is no word falls.
NO_CELL = 0xFFFF
_COSINES = np.cos(np.pi / (2 * SIDE) * np.outer(np.arange(LOW), 2 * np.arange(SIDE) + 1))


def low_frequencies(grey: np.ndarray) -> np.ndarray:
    """(images, 64): the lowest coefficients of the separable DCT-II of (images, 1024) grey values, row by row."""
    return (_COSINES @ grey.reshape(-1, SIDE, SIDE) @ _COSINES.T).reshape(-1, LOW * LOW).round(DECIMALS)


def fingerprints(grey: np.ndarray) -> np.ndarray:
    """Signed 64-bit fingerprints: a bit for each low frequency over the median of all but the first, which is the mean brightness.

    Flat images have ``FLAT``; another image whose bits are all zero has 1.
    """
    low = low_frequencies(grey)
    bits = low > np.median(low[:, 1:], axis=1, keepdims=True)
    out = np.packbits(bits, axis=1).view(">u8")[:, 0].astype(np.uint64).view(np.int64)
    out[out == FLAT] = 1
    out[grey.std(axis=1) < FLAT_STD] = FLAT
    return out


def perceptual_hashes(images: DataFrame) -> DataFrame:
    """(id, h) of images (id, grey): grey values of a picture reduced to 32 by 32, row by row, in an array of 1024.

    What could not be read has no hash: null arrays, arrays of another length or with a null or
    non-finite value give null, and stay on the worklist. Repeated rows give a row each.
    """

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for at in range(0, whole.num_rows, IMAGES):
                batch = whole.slice(at, IMAGES)
                grey, h = batch.column(1), [None] * batch.num_rows
                sizes = grey.value_lengths().to_pylist()
                rows = [k for k, n in enumerate(sizes) if n == SIDE * SIDE]
                if rows:
                    x = grey.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, SIDE * SIDE)
                    good = np.isfinite(x).all(1)
                    for k, value in zip(np.array(rows)[good].tolist(), fingerprints(x[good]).tolist()):
                        h[k] = value
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(h, pa.int64())], ["id", "h"])

    # Small integers stay so on their way to the task, a quarter of the bytes.
    grey = F.col("grey") if images.schema["grey"].dataType.simpleString() == "array<smallint>" else F.col("grey").cast("array<double>")
    return images.select(F.col("id").cast("long"), grey).mapInArrow(run, "id long, h long")


def needs_fingerprint(photos: DataFrame, show_hidden: bool = False) -> DataFrame:
    """The photos (with hidden) whose phash is null: new, changed, or of an old catalogue. Hidden ones only where shown."""
    own = photos.where("phash IS NULL")
    return own if show_hidden else own.where("NOT hidden")


def with_fingerprints(photos: DataFrame, hashes: DataFrame) -> DataFrame:
    """The photos with new fingerprints (id, h) in place; those without a new one keep theirs. Of several for an id the smallest counts."""
    new = hashes.where("h IS NOT NULL").groupBy(F.col("id").alias("_i")).agg(F.min("h").alias("_h"))
    rest = [c for c in photos.columns if c != "phash"]
    return photos.join(new, F.col("id") == F.col("_i"), "left").select(*rest, F.coalesce("_h", "phash").alias("phash"))


def text_pictures(docs: DataFrame) -> DataFrame:
    """(id, grey): a grey picture of each text, for fingerprints of documents.

    A word falls into one of 1024 cells by the first ten bits of its md5; a cell is 16 grey steps
    a word bright, 255 at the most. Texts without a word are black. Rows with the same id are one
    picture; of each row only its words' cells, two bytes a word, cross the shuffle.
    """

    def cells(batches):
        import pyarrow as pa

        for whole in batches:
            for at in range(0, whole.num_rows, IMAGES):
                batch = whole.slice(at, IMAGES)
                lists = batch.column(1)
                words = lists.flatten().dictionary_encode()
                digests = [hashlib.md5(w.encode()).digest() if w else None for w in words.dictionary.to_pylist()]
                cell = np.array([d[0] << 2 | d[1] >> 6 if d else NO_CELL for d in digests] or [NO_CELL], "<u2")[words.indices.to_numpy()]
                many = lists.value_lengths().fill_null(0).to_numpy()
                parts = np.split(cell, np.cumsum(many)[:-1])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c[c != NO_CELL].tobytes() for c in parts], pa.binary())], ["id", "cells"])

    def pictures(batches):
        import pyarrow as pa

        for whole in batches:
            for at in range(0, whole.num_rows, IMAGES):
                batch = whole.slice(at, IMAGES)
                own = [np.frombuffer(c, "<u2") for c in batch.column(1).to_pylist()]
                place = np.repeat(np.arange(len(own)) * SIDE * SIDE, [len(c) for c in own]) + np.concatenate(own)
                grey = np.minimum(255, 16 * np.bincount(place, minlength=len(own) * SIDE * SIDE)).astype(np.int16)
                ends = pa.array(np.arange(len(own) + 1, dtype=np.int32) * SIDE * SIDE)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(grey))], ["id", "grey"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    words = docs.select(F.col("doc_id").alias("id"), F.split(F.lower("text"), r"[^\p{L}\p{N}]+").alias("w"))
    rows = words.mapInArrow(cells, f"id {kind}, cells binary").groupBy("id").agg(F.listagg("cells").alias("cells"))
    return rows.mapInArrow(pictures, f"id {kind}, grey array<smallint>")
