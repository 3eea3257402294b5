"""Dates from EXIF values, file names and folders, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The patterns in the order they are tried: separated, compact, camera prefix, year and month.
PATTERNS = (
    (r"(\d{4})[_\-/\\](\d{1,2})[_\-/\\](\d{1,2})", True, False),
    (r"(?<!\d)(\d{4})(\d{2})(\d{2})(?!\d)", True, True),
    (r"(?:IMG|VID)[_\-](\d{4})(\d{2})(\d{2})", True, True),
    (r"(\d{4})[_\-](\d{2})(?![_\-\d])", False, False),
)
_DATE = "struct<year:int,month:int>"


def exif_date(value: Column, max_year: int) -> Column:
    """struct(year, month) of a ``yyyy:MM:dd`` value, or null."""
    day = F.try_to_timestamp(F.substring(F.trim(value), 1, 10), F.lit("yyyy:MM:dd"))
    return F.when(F.year(day).between(1900, max_year), F.struct(F.year(day).alias("year"), F.month(day).alias("month")))


def exif_first(original: Column, digitized: Column, modified: Column, max_year: int) -> Column:
    return F.coalesce(*(exif_date(v, max_year) for v in (original, digitized, modified)))


def date_from_text(text: Column, max_year: int) -> Column:
    """struct(year, month) of the first plausible date, or null.

    The patterns go in order and each over all its matches. A compact date must have a real
    month and day; a separated one with an impossible month counts as its year.
    """
    found = []
    for pattern, has_day, compact in PATTERNS:
        groups = [F.regexp_extract_all(text, F.lit(pattern), F.lit(k)) for k in range(1, 4 if has_day else 3)]
        n = lambda m, k: m[str(k)].cast("int")
        year_ok = lambda m: n(m, 0).between(1990, max_year)  # noqa: E731, B023
        month_ok = lambda m: n(m, 1).between(1, 12)  # noqa: E731, B023
        ok = (lambda m: year_ok(m) & month_ok(m) & n(m, 2).between(1, 31)) if compact else year_ok  # noqa: B023
        pick = lambda m: F.struct(n(m, 0).alias("year"), F.when(month_ok(m), n(m, 1)).alias("month")).cast(_DATE)  # noqa: E731, B023
        found.append(F.transform(F.filter(F.arrays_zip(*groups), ok), pick))
    return F.get(F.concat(*found), F.lit(0))


def resolved_date(exif: Column, filename: Column, folder: Column, mtime: Column, max_year: int) -> Column:
    """EXIF, else the file name, else its folder, else the time of the last change; year and month stay together."""
    changed = F.timestamp_seconds(mtime)
    last = F.when(mtime.isNotNull(), F.struct(F.year(changed).alias("year"), F.month(changed).alias("month")).cast(_DATE))
    return F.coalesce(exif.cast(_DATE), date_from_text(filename, max_year), date_from_text(folder, max_year), last)


def general(x: Column) -> Column:
    """A number in at most six significant digits, without zeros at its end; in powers of ten from a million on."""
    digits = F.when(x >= 1e5, F.format_string("%.0f", x))
    for k in range(1, 6):
        digits = digits.when(x >= 10 ** (5 - k), F.format_string(f"%.{k}f", x))
    plain = digits.when(x >= 0.1, F.format_string("%.6f", x)).when(x >= 0.01, F.format_string("%.7f", x)).otherwise(F.format_string("%.8f", x))
    short = F.when(plain.contains("."), F.regexp_replace(plain, r"\.?0+$", "")).otherwise(plain)
    power = F.regexp_replace(F.regexp_replace(F.format_string("%.5e", x), r"0+e", "e"), r"\.e", "e")
    return F.when(x >= 999999.5, power).otherwise(short)


def _tenth(x: Column) -> Column:
    """A number from 0 to 1024 rounded to one decimal as it is in binary: below a half down, above it up, an exact half to the even digit."""
    high = F.floor(x * float(1 << 26))
    low = F.floor((x * float(1 << 26) - high) * float(1 << 30))
    # 20 x + 1 in units of 2**-56, in whole numbers.
    n = ((high.cast("decimal(12,0)") * F.lit(1 << 30).cast("decimal(11,0)") + low.cast("decimal(11,0)")) * F.lit(20) + F.lit(1 << 56)).cast("decimal(30,0)")
    rest = (n % F.lit(1 << 57)).cast("decimal(18,0)")
    tenths = ((n - rest) / F.lit(1 << 57)).cast("long")
    even = F.when((rest == 0) & (tenths % 2 == 1), tenths - 1).otherwise(tenths)
    return F.when(x.between(0, 1024), even / 10).otherwise(x)


def exif_details(c: dict[str, Column]) -> Column:
    """map of the details that are there: camera, lens, time taken, and the settings in one line.

    ``c``: make, model, lens, taken (``yyyy:MM:dd HH:mm:ss``), exposure (seconds), aperture, iso, focal (mm).
    """
    text = lambda v: F.trim(F.regexp_replace(F.trim(F.coalesce(v, F.lit(""))), "^\\x00+|\\x00+$", ""))
    make, model = text(c["make"]), text(c["model"])
    both = (model != "") & (make != "") & ~F.startswith(F.lower(model), F.lower(make))
    camera = F.when(both, F.concat_ws(" ", make, model)).otherwise(F.coalesce(F.nullif(model, F.lit("")), F.nullif(make, F.lit(""))))
    taken = F.date_format(F.try_to_timestamp(F.substring(text(c["taken"]), 1, 19), F.lit("yyyy:MM:dd HH:mm:ss")), "dd/MM/yyyy HH:mm")
    t, f, iso, mm = c["exposure"], c["aperture"], c["iso"], c["focal"]
    settings = F.filter(
        F.array(
            F.when((t > 0) & (t < 1), F.concat(F.lit("1/"), F.bround(1 / t, 0).cast("long").cast("string"), F.lit(" s"))).when(t >= 1, F.concat(general(t), F.lit(" s"))),
            F.when(f != 0, F.concat(F.lit("f/"), F.regexp_replace(F.format_string("%.1f", _tenth(f)), r"\.0$", ""))),
            F.when(iso != 0, F.concat(F.lit("ISO "), iso.cast("string"))),
            F.when(mm != 0, F.concat(general(mm), F.lit(" mm"))),
        ),
        lambda x: x.isNotNull(),
    )
    parts = [("Cámara", camera), ("Objetivo", F.nullif(text(c["lens"]), F.lit(""))), ("Tomada", taken), ("Ajustes", F.nullif(F.array_join(settings, " · "), F.lit("")))]
    there = [F.when(v.isNotNull(), F.struct(F.lit(k).alias("k"), v.alias("v"))) for k, v in parts]
    return F.map_from_entries(F.filter(F.array(*there), lambda x: x.isNotNull()))
