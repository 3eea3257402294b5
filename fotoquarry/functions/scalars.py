"""Scalar functions of the catalogue as Column expressions; all stay inside generated code."""

from __future__ import annotations

import itertools
import unicodedata
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

BS = "\\"
#: File extensions that count as images and as videos.
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".gif", ".bmp", ".webp", ".tiff", ".tif", ".heic", ".heif", ".avif")
VIDEO_EXTENSIONS = (".mp4", ".avi", ".mov", ".mkv", ".wmv", ".flv", ".webm", ".m4v", ".mpg", ".mpeg", ".3gp", ".mts", ".m2ts", ".ts")
NO_ROOT = "(sin unidad)"


def folder_of(path: Column) -> Column:
    """Everything up to the last backslash, included."""
    return F.regexp_replace(path, r"[^\\]*$", "")


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"[^\\]*$", 0)


def parent_folder(folder: Column) -> Column:
    """The folder above; empty at a root."""
    return F.regexp_replace(F.regexp_replace(folder, r"\\+$", ""), r"[^\\]*$", "")


def root_of(path: Column) -> Column:
    """``X:\\`` or the server and share of a network path."""
    share = F.regexp_extract(path, r"^\\\\[^\\]+\\[^\\]+\\?", 0)
    return F.when(path.rlike(r"^[A-Za-z]:\\"), F.substring(path, 1, 3)).when(share != "", F.concat(F.regexp_replace(share, r"\\$", ""), F.lit(BS))).otherwise(F.lit(NO_ROOT))


def normal_folder(folder: str) -> str:
    return folder.replace("/", BS).rstrip(BS)


def inside(path: Column, folder: str) -> Column:
    """In the folder or below it, letter case aside; a sibling with a longer name is not inside."""
    return F.startswith(F.lower(path), F.lit(normal_folder(folder).lower() + BS))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.[^.\\]*$", 0))


def media_type(path: Column) -> Column:
    return F.when(extension(path).isin(*VIDEO_EXTENSIONS), "video").when(extension(path).isin(*IMAGE_EXTENSIONS), "image")


def has_shape(width: Column, height: Column, shape: str) -> Column:
    """Whether a size is landscape, portrait or square, within two per cent; null without both sizes.

    The three are conditions of their own: a size just under square is both portrait and square.
    """
    w, h = width.cast("long"), height.cast("long")
    if shape == "landscape":
        return w * 50 > h * 51
    if shape == "portrait":
        return h * 50 > w * 51
    if shape == "square":
        return (w * 50).between(h * 49, h * 51)
    return F.lit(True)  # no filter


def pixels(width: Column, height: Column) -> Column:
    return width.cast("long") * height.cast("long")


def rewrite_prefix(path: Column, old: str, new: str) -> Column:
    old, new = normal_folder(old), normal_folder(new)
    return F.concat(F.lit(new), F.substring(path, F.lit(len(old) + 1), F.length(path)))


def clean_rating(rating: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(5), F.coalesce(rating, F.lit(0))))


def clean_note(note: Column) -> Column:
    return F.nullif(F.trim(note), F.lit(""))


def stars(rating: Column, of: int = 5) -> Column:
    """Filled stars, then empty ones; nothing at 0."""
    return F.when(rating > 0, F.concat(F.repeat(F.lit("★"), rating), F.repeat(F.lit("☆"), F.lit(of) - rating))).otherwise(F.lit(""))


def clock(seconds: Column) -> Column:
    """Minutes and seconds; empty without a duration or at 0."""
    s = F.floor(seconds).cast("long")
    return F.when(seconds.isNull() | (seconds == 0), "").otherwise(F.format_string("%d:%02d", F.floor(s / 60).cast("long"), s % 60))


def short_name(name: Column, most: int = 22) -> Column:
    return F.when(F.length(name) > most, F.concat(F.substring(name, 1, most), F.lit("…"))).otherwise(name)


def human_size(size: Column) -> Column:
    """Bytes, KB, MB or GB; whole numbers up to KB, one decimal from MB on, halves to the even digit; a dash without a size or at 0."""
    whole = lambda n: F.bround(size / float(1024**n), 0).cast("long").cast("string")
    tenth = lambda n: F.format_string("%.1f", F.bround(size / float(1024**n), 1))
    return (
        F.when(size.isNull() | (size == 0), "—")
        .when(size < 1024, F.concat(whole(0), F.lit(" B")))
        .when(size < 1024**2, F.concat(whole(1), F.lit(" KB")))
        .when(size < 1024**3, F.concat(tenth(2), F.lit(" MB")))
        .otherwise(F.concat(tenth(3), F.lit(" GB")))
    )


#: Month names.
MONTHS = ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre")


def month_label(year: Column, month: Column) -> Column:
    """Month and year; the year alone where the month cannot be one, a note without a year."""
    name = F.get(F.array(*map(F.lit, MONTHS)), month - 1)  # null outside the list
    return F.when(year.isNull() | (year == 0), "Sin fecha").when(name.isNull(), year.cast("string")).otherwise(F.concat_ws(" ", name, year.cast("string")))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def rounded(x: Column, places: int) -> Column:
    """``round`` of a double, halves away from zero: by whole numbers where these are exact, which takes a tenth of the time of decimals."""
    power = F.lit(10.0**places)
    by = F.abs(x) * power
    whole = F.floor(by)
    near = whole + F.when(by - whole >= 0.5, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))
    return F.when(by < 1e15, F.when(x < 0, -near).otherwise(near) / power).otherwise(F.round(x, places))


def unit(v: Column, floor: float = 1e-12) -> Column:
    norm = F.greatest(F.sqrt(dot(v, v)), F.lit(floor))
    return F.transform(v, lambda x: x.cast("double") / norm)


def is_zero(v: Column) -> Column:
    return ~F.exists(v, lambda x: x != 0)


def perceptual_bits(block: Column) -> Column:
    """64 bits of an 8 by 8 block, first coefficient highest: over the median of the other 63. 0 is kept for flat images, so it becomes 1."""
    median = F.element_at(F.array_sort(F.slice(block, 2, 63)), 32)
    bits = F.aggregate(F.transform(block, lambda x: F.when(x > median, F.lit(1)).otherwise(F.lit(0)).cast("long")), F.lit(0).cast("long"), lambda a, b: F.shiftleft(a, 1).bitwiseOR(b))
    return F.when(bits == 0, F.lit(1).cast("long")).otherwise(bits)


def artefact_key(path: Column, mtime: Column, version: int = 1) -> Column:
    """Key of what is derived from a file; it changes with the file's path, time and the deriving code's version."""
    return F.sha1(F.concat_ws("::", path, F.coalesce(mtime.cast("decimal(20,6)").cast("string"), F.lit("")), F.lit(str(version))))


@cache
def _folded() -> tuple[str, str, dict[str, str]]:
    """(characters, what single characters they become, characters that become several), for all of Unicode.

    A character becomes its case folding, decomposed (NFKD) and without combining marks. What is
    left without a counterpart at the end of the first text becomes nothing.
    """
    one: dict[str, str] = {}
    gone, several = [], {}
    for c in map(chr, itertools.chain(range(0xD800), range(0xE000, 0x110000))):
        plain = "".join(x for x in unicodedata.normalize("NFKD", c.casefold()) if not unicodedata.combining(x))
        if plain == c:
            continue
        # Only letters a to z and digits are told apart later; all else is a gap.
        kept = "".join(x if x in _WORD else " " for x in plain)
        if not plain:
            gone.append(c)
        elif len(kept) == 1 or not kept.strip():
            one[c] = kept[0]
        else:
            several[c] = kept
    return "".join([*one, *gone]), "".join(one.values()), several


_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def normal_text(text: Column) -> Column:
    """Case folded, decomposed (NFKD) and without marks, in any script: runs of a to z and digits, joined by one space."""
    chars, plain, several = _folded()
    table = F.create_map(*[F.lit(x) for pair in several.items() for x in pair])
    any_of = "[" + "".join(f"\\x{{{ord(c):X}}}" for c in several) + "]"
    # Few texts have a character that becomes several, such as a ligature; the sharp s, which many have, is dealt with first.
    text = F.replace(text, F.lit("ß"), F.lit("ss"))
    longer = F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), "")
    whole = F.when(text.rlike(any_of), longer).otherwise(text)
    # A text as long in bytes as in characters is ASCII.
    folded = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(whole, chars, plain))
    return F.trim(F.regexp_replace(folded, r"[^a-z0-9]+", " "))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
