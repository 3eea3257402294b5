"""Header walkers on files that are put together byte by byte, cut at every place and given false lengths."""

import struct

import pytest

from fotoquarry.sources import headers


def chunk(kind, body, order=">"):
    return struct.pack(order + "I", len(body)) + kind + body + (b"\0" * 4 if order == ">" else b"")


def directory(order, entries, more=0):
    return struct.pack(order + "H", len(entries)) + b"".join(struct.pack(order + "HHI", t, k, n) + v for t, k, n, v in entries) + struct.pack(order + "I", more)


def exif(order, orientation=6, taken=b"2019:07:04 10:11:12\0"):
    """Orientation, make, and an EXIF directory with the time taken, the exposure and the focal length."""
    short = lambda v: struct.pack(order + "HH", v, 0)
    long = lambda v: struct.pack(order + "I", v)
    first = [(0x0112, 3, 1, short(orientation)), (0x010F, 2, 4, b"Abc\0"), (0x8769, 4, 1, long(50))]
    second = [(0x9003, 2, 20, long(110)), (0x829A, 5, 1, long(130)), (0x8827, 3, 1, short(400)), (0xFFFF, 99, 1, long(0))]
    head = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8)
    out = head + directory(order, first)
    assert len(out) == 50
    return out + directory(order, second) + b"\0" * (110 - 50 - 54) + taken + struct.pack(order + "II", 1, 250)


def png(w=640, h=480, extra=b""):
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">II", w, h) + b"\x08\x02\0\0\0") + extra + chunk(b"IDAT", b"xx")


def jpeg(w=640, h=480, body=None):
    app = b"" if body is None else b"\xff\xe1" + struct.pack(">H", len(body) + 8) + b"Exif\0\0" + body
    return b"\xff\xd8\xff\xe0\0\x04ab" + app + b"\xff\xff\xc2\0\x0b\x08" + struct.pack(">HH", h, w) + b"\x01\x01\x11\0" + b"\xff\xda\0\x02"


def box(kind, *parts, wide=False):
    body = b"".join(parts)
    return struct.pack(">I", 1) + kind + struct.pack(">Q", len(body) + 16) + body if wide else struct.pack(">I", len(body) + 8) + kind + body


def mp4(version=0, w=1920, h=1080, handler=b"vide", media=(90000, 900000), last=b""):
    times = (lambda s, u: b"\0" * 12 + struct.pack(">II", s, u)) if version == 0 else (lambda s, u: b"\1" + b"\0" * 19 + struct.pack(">IQ", s, u))
    track = bytes([version]) + b"\0" * (75 if version == 0 else 87) + struct.pack(">II", w << 16, h << 16)
    return box(b"ftyp", b"isom") + box(b"mdat", b"\0" * 9, wide=version == 1) + box(b"moov", box(b"mvhd", times(1000, 7000)), box(b"trak", box(b"tkhd", track), box(b"mdia", box(b"mdhd", times(*media)), box(b"hdlr", b"\0" * 8 + handler)))) + last


@pytest.mark.parametrize("order", ["<", ">"])
def test_exif_in_both_byte_orders(order):
    want = {"width": 640, "height": 480, "orientation": 6, "make": "Abc", "original": "2019:07:04 10:11:12", "exposure": 1 / 250, "iso": 400}
    assert headers.header(jpeg(body=exif(order))) == headers.header(png(extra=chunk(b"eXIf", exif(order)))) == want


def test_kinds():
    h = headers.header
    assert h(png()) == h(jpeg()) == h(b"GIF89a" + struct.pack("<HH", 640, 480)) == {"width": 640, "height": 480}
    assert h(b"BM" + b"\0" * 12 + struct.pack("<Iii", 40, 640, -480)) == h(b"BM" + b"\0" * 12 + struct.pack("<IHH", 12, 640, 480)) == {"width": 640, "height": 480}
    assert h(b"RIFF\0\0\0\0WEBPVP8X" + b"\0" * 8 + (639).to_bytes(3, "little") + (479).to_bytes(3, "little")) == {"width": 640, "height": 480}
    assert h(b"RIFF\0\0\0\0WEBPVP8L\0\0\0\0/" + (639 | 479 << 14).to_bytes(4, "little")) == {"width": 640, "height": 480}
    assert h(b"RIFF\0\0\0\0AVI LIST\0\0\0\0hdrlavih\0\0\0\0" + struct.pack("<IIIIIIIIII", 40000, 0, 0, 0, 250, 0, 0, 0, 640, 480)) == {"width": 640, "height": 480, "duration": 10.0}
    size = directory("<", [(0x0100, 3, 1, struct.pack("<HH", 640, 0)), (0x0101, 4, 1, struct.pack("<I", 480)), (0x0112, 3, 1, struct.pack("<HH", 3, 0))])
    assert h(b"II*\0\x08\0\0\0" + size) == {"width": 640, "height": 480, "orientation": 3}
    assert h(mp4()) == h(mp4(1)) == {"width": 1920, "height": 1080, "duration": 10.0}
    assert h(mp4(media=(0, 5)))["duration"] == h(mp4(media=(90000, 0xFFFFFFFF)))["duration"] == 7.0


def test_cut_files_are_broken_or_whole_but_never_wrong():
    for whole in (png(extra=chunk(b"eXIf", exif(">"))), jpeg(body=exif("<")), mp4(), mp4(1)):
        want = headers.header(whole)
        for n in range(len(whole)):
            try:
                found = headers.header(whole[:n])
            except headers.Broken:
                continue
            found.pop("error", None)
            assert set(found.items()) <= set(want.items())


@pytest.mark.parametrize(
    "lying",
    [
        b"", b"\xff", b"not a picture", png(0), png()[:8] + b"\0\0\0\x0e" + png()[12:], jpeg(0), b"\xff\xd8\xff\xe0\0\x01" + jpeg()[6:], b"\xff\xd8\xff\xe1\xff\xff" + jpeg()[8:], b"\xff\xd8\xff\xda\0\x02", b"\xff\xd8ab",
        mp4(handler=b"soun"), mp4(w=0), box(b"ftyp", b"isom") + struct.pack(">I", 4) + b"moov", box(b"ftyp", b"isom") + struct.pack(">I", 999) + b"moov", box(b"ftyp", b"isom") + box(b"moov", struct.pack(">I", 50) + b"trak"), box(b"ftyp", b"isom"), b"RIFF\0\0\0\0WAVEfmt ",
    ],
)
def test_lies_are_told(lying):
    with pytest.raises(headers.Broken):
        headers.header(lying)


def test_broken_exif_leaves_the_size():
    for body in (b"", b"XX*\0", b"II*\0\xff\xff\0\0", exif("<")[:60], b"II*\0\x08\0\0\0\xff\xff"):
        found = headers.header(jpeg(body=body))
        assert (found["width"], found["height"]) == (640, 480) and found["error"].startswith("exif: ")
    # A directory that points at itself ends.
    loop = b"MM\0*\0\0\0\x08" + directory(">", [(0x8769, 4, 1, struct.pack(">I", 8))])
    assert headers.header(jpeg(body=loop)) == {"width": 640, "height": 480}


def test_rows_and_files(spark, tmp_path):
    from pyspark.sql import functions as F

    wrong = directory("<", [(0x0112, 2, 4, b"six\0"), (0x010F, 3, 1, struct.pack("<HH", 7, 0))])
    rows = [("a.jpg", jpeg(body=exif("<"))), ("b.mp4", mp4()), ("c.png", None), ("d.png", b""), (None, png()), ("e.jpg", jpeg(body=b"II*\0\x08\0\0\0" + wrong)), ("f.mp4", mp4()[:40]), ("b.mp4", mp4())]
    df = spark.createDataFrame([(p, None if c is None else bytearray(c)) for p, c in rows], "path string, content binary")
    got = sorted(((r["path"] or "", r["width"], r["height"], r["duration"], r["error"] is None) for r in headers.read_media(df).collect()), key=repr)
    assert got == sorted([("a.jpg", 480, 640, None, True), ("b.mp4", 1920, 1080, 10.0, True), ("b.mp4", 1920, 1080, 10.0, True), ("c.png", None, None, None, False), ("d.png", None, None, None, False), ("", 640, 480, None, True), ("e.jpg", 640, 480, None, True), ("f.mp4", None, None, None, False)], key=repr)
    assert headers.read_media(df.limit(0)).count() == 0
    # A film whose index lies behind the bytes that are read.
    assert "read" in headers.read_media(df.where("path = 'b.mp4'"), 90).first()["error"]
    (tmp_path / "x.jpg").write_bytes(jpeg(body=exif(">")) + b"\0" * 5000)
    (tmp_path / "y.png").write_bytes(png())
    files = spark.read.format("binaryFile").load(str(tmp_path))
    listing = files.select("path", F.col("length").alias("size"), F.lit(1.6e9).alias("mtime"))
    found = {r["path"][-5:]: (r["year"], r["month"], r["width"], r["height"]) for r in headers.media_records(listing, headers.read_media(files), 2030).collect()}
    assert found["x.jpg"] == (2019, 7, 480, 640) and found["y.png"][2:] == (640, 480)
