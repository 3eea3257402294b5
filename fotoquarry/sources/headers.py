"""What the headers of media files say, read from their first bytes without decoding a picture.

Walkers for PNG, JPEG, GIF, BMP, TIFF, WebP, AVI and the MP4 family follow the lengths that a file
states and check each against what is there. A file that ends too early, states an impossible
length or is of no known kind gives a row with its error instead of failing the job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import scalars as S

#: Bytes of a file that are looked at, and rows of an Arrow batch (8 MB at the most).
FIRST_BYTES, BATCH = 1 << 18, 32

# Numbers of EXIF tags, the bytes of their value types, the markers of JPEG frames.
EXIF_DIRECTORY = 0x8769
TAGS = {0x0112: "orientation", 0x010F: "make", 0x0110: "model", 0x0132: "modified", 0x9003: "original", 0x9004: "digitized", 0x829A: "exposure", 0x829D: "aperture", 0x8827: "iso", 0x920A: "focal", 0xA434: "lens"}
TYPE_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8}
FRAMES = frozenset(range(0xC0, 0xD0)) - {0xC4, 0xC8, 0xCC}
TURNED = (5, 6, 7, 8)


class Broken(ValueError):
    """The file is not what it says."""


def _part(data: bytes, at: int, n: int) -> bytes:
    if at < 0 or at + n > len(data):
        raise Broken(f"ends at byte {len(data)}, {at + n} needed")
    return data[at : at + n]


def _number(data: bytes, at: int, n: int, order: str = "big") -> int:
    return int.from_bytes(_part(data, at, n), order)


def _size(width: int, height: int) -> dict:
    if width <= 0 or height <= 0:
        raise Broken(f"a size of {width} by {height}")
    return {"width": width, "height": height}


def tiff(data: bytes) -> dict:
    """The known tags of a TIFF structure, its first directory before the EXIF directory."""
    order = {b"II": "little", b"MM": "big"}.get(data[:2])
    if order is None or _number(data, 2, 2, order) != 42:
        raise Broken("no TIFF header")
    out: dict = {}

    def value(at: int):
        kind, count = _number(data, at + 2, 2, order), _number(data, at + 4, 4, order)
        unit = TYPE_BYTES.get(kind)
        if unit is None or not count:
            return None
        start = at + 8 if unit * count <= 4 else _number(data, at + 8, 4, order)
        raw = _part(data, start, unit * count)
        if kind in (2, 7):
            return raw.split(b"\0")[0].decode("latin-1")
        signed = kind in (6, 8, 9, 10)
        whole = lambda k, n: int.from_bytes(raw[k : k + n], order, signed=signed)
        if kind in (5, 10):
            below = whole(4, 4)
            return whole(0, 4) / below if below else None
        return whole(0, unit)

    def directory(at: int) -> int | None:
        more = None
        for k in range(_number(data, at, 2, order)):
            entry = at + 2 + 12 * k
            tag = _number(data, entry, 2, order)
            if tag == EXIF_DIRECTORY:
                more = value(entry)
            elif tag in TAGS:
                out.setdefault(TAGS[tag], value(entry))
            elif tag in (0x0100, 0x0101):
                out.setdefault("tiff_width" if tag == 0x0100 else "tiff_height", value(entry))
        return more

    more = directory(_number(data, 4, 4, order))
    if more:
        directory(int(more))
    return out


def _with_exif(found: dict, body: bytes | None) -> dict:
    """Broken EXIF takes nothing from the size: the row has both the size and the error."""
    if body is None:
        return found
    try:
        return found | {k: v for k, v in tiff(body).items() if not k.startswith("tiff_")}
    except Broken as e:
        return found | {"error": f"exif: {e}"}


def png(data: bytes) -> dict:
    if _number(data, 8, 4) != 13 or _part(data, 12, 4) != b"IHDR":
        raise Broken("no IHDR chunk first")
    found, at, exif = _size(_number(data, 16, 4), _number(data, 20, 4)), 33, None
    while at + 8 <= len(data) and data[at + 4 : at + 8] not in (b"IDAT", b"IEND"):
        n = _number(data, at, 4)
        if data[at + 4 : at + 8] == b"eXIf":
            exif = data[at + 8 : at + 8 + n]
        at += 12 + n
    return _with_exif(found, exif)


def jpeg(data: bytes) -> dict:
    at, found, exif = 2, None, None
    while True:
        if _number(data, at, 1) != 0xFF:
            raise Broken(f"no marker at byte {at}")
        mark = _number(data, at + 1, 1)
        if mark == 0xFF:  # fill
            at += 1
            continue
        if mark == 0x01 or 0xD0 <= mark <= 0xD8:
            at += 2
            continue
        if mark in (0xD9, 0xDA):
            break
        n = _number(data, at + 2, 2)
        if n < 2:
            raise Broken(f"a segment of {n} bytes at byte {at}")
        if mark in FRAMES:
            found = _size(_number(data, at + 7, 2), _number(data, at + 5, 2))
        body = data[at + 4 : at + 2 + n]
        if mark == 0xE1 and body[:6] == b"Exif\0\0" and exif is None:
            exif = body[6:]
        at += 2 + n
        if found and at + 4 > len(data):  # the rest says no more about the size
            break
    if not found:
        raise Broken("no frame header")
    return _with_exif(found, exif)


def gif(data: bytes) -> dict:
    return _size(_number(data, 6, 2, "little"), _number(data, 8, 2, "little"))


def bmp(data: bytes) -> dict:
    if _number(data, 14, 4, "little") == 12:
        return _size(_number(data, 18, 2, "little"), _number(data, 20, 2, "little"))
    return _size(int.from_bytes(_part(data, 18, 4), "little", signed=True), abs(int.from_bytes(_part(data, 22, 4), "little", signed=True)))


def tiff_picture(data: bytes) -> dict:
    found = tiff(data)
    size = _size(found.pop("tiff_width", None) or 0, found.pop("tiff_height", None) or 0)
    return found | size


def riff(data: bytes) -> dict:
    """WebP pictures and AVI films."""
    little = lambda at, n: _number(data, at, n, "little")
    kind, chunk = _part(data, 8, 4), _part(data, 12, 4)
    if kind == b"WEBP":
        if chunk == b"VP8X":
            return _size(little(24, 3) + 1, little(27, 3) + 1)
        if chunk == b"VP8L":
            bits = little(21, 4)
            return _size((bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1)
        if chunk == b"VP8 ":
            return _size(little(26, 2) & 0x3FFF, little(28, 2) & 0x3FFF)
    if kind == b"AVI " and chunk == b"LIST" and _part(data, 20, 8) == b"hdrlavih":
        frame, frames = little(32, 4), little(48, 4)
        return _size(little(64, 4), little(68, 4)) | {"duration": frames * frame / 1e6 if frame else None}
    raise Broken("no known RIFF content")


def boxes(data: bytes, at: int, end: int):
    """(type, start, end) of the boxes between two places; a box may not reach beyond the one it is in."""
    while at + 8 <= end:
        n, kind, head = _number(data, at, 4), _part(data, at + 4, 4), 8
        if n == 1:
            n, head = _number(data, at + 8, 8), 16
        elif n == 0:
            n = end - at
        if n < head or at + n > end:
            raise Broken(f"a box of {n} bytes at byte {at}, {end - at} left")
        yield kind, at + head, at + n
        at += n
        if at > len(data):
            return


def _lasting(data: bytes, at: int) -> float | None:
    """Seconds by a movie or media header."""
    long = _number(data, at, 1) == 1
    scale, units = (_number(data, at + 20, 4), _number(data, at + 24, 8)) if long else (_number(data, at + 12, 4), _number(data, at + 16, 4))
    return units / scale if scale and units not in (0xFFFFFFFF, 0xFFFFFFFFFFFFFFFF) else None


def mp4(data: bytes, length: int) -> dict:
    """Size of the first video track and how long it lasts, by its own header or the movie's."""
    for kind, a, b in boxes(data, 0, max(length, len(data))):
        if kind != b"moov":
            continue
        if b > len(data):
            raise Broken(f"moov ends at byte {b}, {len(data)} read")
        movie, found = None, None
        for inner, c, d in boxes(data, a, b):
            if inner == b"mvhd":
                movie = _lasting(data, c)
            if inner == b"trak" and found is None:
                size, lasts, handler = None, None, None
                for part, e, f in boxes(data, c, d):
                    if part == b"tkhd":
                        place = e + (88 if _number(data, e, 1) == 1 else 76)
                        size = (_number(data, place, 4) >> 16, _number(data, place + 4, 4) >> 16)
                    if part == b"mdia":
                        for leaf, g, _ in boxes(data, e, f):
                            if leaf == b"mdhd":
                                lasts = _lasting(data, g)
                            if leaf == b"hdlr":
                                handler = _part(data, g + 8, 4)
                if handler == b"vide" and size:
                    found = _size(*size) | {"duration": lasts}
        if found is None:
            raise Broken("no video track")
        return found | {"duration": movie if found["duration"] is None else found["duration"]}
    raise Broken(f"no moov box in the first {len(data)} bytes")


def header(data: bytes, length: int | None = None) -> dict:
    """Fields of a file's header; raises ``Broken``. ``length``: of the whole file, where ``data`` is its first bytes."""
    for start, walker in ((b"\x89PNG\r\n\x1a\n", png), (b"\xff\xd8", jpeg), (b"GIF8", gif), (b"BM", bmp), (b"II*\0", tiff_picture), (b"MM\0*", tiff_picture), (b"RIFF", riff)):
        if data.startswith(start):
            return walker(data)
    if data[4:8] in (b"ftyp", b"moov", b"mdat", b"free", b"skip", b"wide"):
        return mp4(data, length or len(data))
    raise Broken("no known kind of file")


FIELDS = {"width": "long", "height": "long", "duration": "double", "orientation": "long", "original": "string", "digitized": "string", "modified": "string", "make": "string", "model": "string", "lens": "string", "exposure": "double", "aperture": "double", "iso": "long", "focal": "double", "error": "string"}
_PYTHON = {"long": int, "double": float, "string": str}


def read_media(files: DataFrame, first_bytes: int = FIRST_BYTES) -> DataFrame:
    """(path, width, height, duration, orientation, dates and camera fields, error) of (path, content) rows.

    Width and height are as a picture is seen: orientations 5 to 8 swap them. A file that cannot
    be read has its error and nothing else; broken EXIF leaves the size. Null and empty contents
    are errors, null paths are kept, repeated rows give a row each, an empty table none. Only the
    first ``first_bytes`` of a content reach Python; a film whose index lies behind them is an error.
    """
    names = list(FIELDS)
    files.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))

    def run(batches):
        import pyarrow as pa

        kinds = {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}
        for batch in batches:
            out = []
            for content, length in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                try:
                    found = header(content or b"", length)
                except Broken as e:
                    found = {"error": str(e)}
                if found.get("orientation") in TURNED and found.get("width"):
                    found["width"], found["height"] = found["height"], found["width"]
                own = {}
                for n, v in found.items():
                    want = _PYTHON[FIELDS[n]]
                    # A tag of another type than it should have says nothing.
                    own[n] = want(v) if isinstance(v, want) or (want is float and isinstance(v, int)) else None
                out.append(own)
            columns = [pa.array([o.get(n) for o in out], kinds[FIELDS[n]]) for n in names]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["path", *names])

    given = files.select("path", F.substring("content", 1, first_bytes).alias("content"), F.length("content").cast("long").alias("length"))
    return given.mapInArrow(run, "path string, " + ", ".join(f"{n} {t}" for n, t in FIELDS.items()))


def media_records(listing: DataFrame, headers: DataFrame, max_year: int) -> DataFrame:
    """(path, filename, year, month, filesize, width, height, media_type, duration, mtime) of listed files.

    ``listing``: path, size, mtime; ``headers``: as ``read_media`` gives them. The date is the first
    of EXIF, file name, folder and time of the last change; a file without a readable header stays.
    A path that is listed or read more than once gives a row for each listed with each header.
    """
    h = headers.select(F.col("path").alias("_path"), "width", "height", "duration", D.exif_first(F.col("original"), F.col("digitized"), F.col("modified"), max_year).alias("_exif"))
    name, folder = S.basename(F.col("path")), F.regexp_replace(F.col("path"), r"\\[^\\]*$", "")
    dated = listing.join(h, F.col("path") == F.col("_path"), "left").withColumn("_d", D.resolved_date(F.col("_exif"), name, folder, F.col("mtime"), max_year))
    return dated.select("path", name.alias("filename"), "_d.year", "_d.month", F.col("size").alias("filesize"), "width", "height", S.media_type(F.col("path")).alias("media_type"), "duration", "mtime")
