"""Operators on small hand-made frames, and properties that tie two of them together."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from fotoquarry.functions import dates
from fotoquarry.functions import scalars as S
from fotoquarry.operators import aggregates, duplicates, gallery, hierarchy, maintenance, suggest, vectors
from fotoquarry.sources import interchange
from fotoquarry.sources.catalog import Catalog


@pytest.fixture(scope="module")
def cat(spark, sf_dir):
    return Catalog(spark, sf_dir)


@pytest.mark.parametrize(
    "text,want",
    [
        ("2020-05-12 playa.jpg", (2020, 5)), ("foto_2019_7_3.png", (2019, 7)), ("IMG_20200512_101010.jpg", (2020, 5)), ("IMG-20180101-WA0001.jpg", (2018, 1)), ("2015-08.jpg", (2015, 8)), ("1999/12/31", (1999, 12)),
        ("2020-13-45.jpg", (2020, None)), ("wallpaper_1920x1080.png", None), ("DSC00123.jpg", None), ("20547205-aaaa.jpg", None), ("12345678901234.jpg", None), ("19891231.jpg", None), ("20201399.jpg", None), ("", None),
        ("20991399 2021-02-03", (2021, 2)), ("1800-01-01 2001-02-03", (2001, 2)),
    ],
)
def test_date_from_text(spark, text, want):
    got = spark.range(1).select(dates.date_from_text(F.lit(text), 2027).alias("d")).first()["d"]
    assert (None if got is None else (got["year"], got["month"])) == want


def test_exif_dates_in_order(spark):
    df = spark.createDataFrame([("bad", "2001:02:03 04:05:06", "2010:01:01"), (None, None, "0000:00:00"), ("2031:01:01", None, None)], "o string, d string, m string")
    got = [r["x"] and tuple(r["x"]) for r in df.select(dates.exif_first(F.col("o"), F.col("d"), F.col("m"), 2027).alias("x")).collect()]
    assert got == [(2001, 2), None, None]


def test_exif_details(spark):
    kind = "make string, model string, lens string, taken string, exposure double, aperture double, iso int, focal double"
    df = spark.createDataFrame([("Canon", "Canon EOS 5", " 50mm ", "2020:01:02 03:04:05.6", 0.004, 8.0, 100, 4.25), ("Sony", "A7", None, "bad", 2.0, 2.8, 0, 50.0), ("Sony", None, "", None, 1.5, 0.0, None, None), (None,) * 8], kind)
    got = [r["m"] for r in df.select(dates.exif_details({c: F.col(c) for c in df.columns}).alias("m")).collect()]
    assert got == [
        {"Cámara": "Canon EOS 5", "Objetivo": "50mm", "Tomada": "02/01/2020 03:04", "Ajustes": "1/250 s · f/8 · ISO 100 · 4.25 mm"}, {"Cámara": "Sony A7", "Ajustes": "2 s · f/2.8 · 50 mm"}, {"Cámara": "Sony", "Ajustes": "1.5 s"}, {},
    ]
    xs = [0.5, 1.0, 4.25, 30.0, 123.456, 1234.5678, 99999.5, 123456.7, 1234567.0, 2e8]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(dates.general(F.col("x"))).collect()]
    assert got == [f"{x:g}" for x in xs]


def test_labels_at_their_edges(spark):
    sizes = [None, 0, 1, 1023, 1024, 1536, 2560, 1024**2 - 1, 1024**2, 1310720, 1024**3 - 1, 1024**3, 5 * 1024**3 + 2**28]

    def human(n):
        units = [("B", 0), ("KB", 0), ("MB", 1), ("GB", 1)]
        k = next((k for k in range(3) if n < 1024 ** (k + 1)), 3) if n else 0
        return f"{n / 1024**k:.{units[k][1]}f} {units[k][0]}" if n else "—"

    assert [r[0] for r in spark.createDataFrame([(n,) for n in sizes], "n long").select(S.human_size(F.col("n"))).collect()] == [human(n) for n in sizes]
    df = spark.createDataFrame([(None, None), (0, 3), (2020, None), (2020, 0), (2020, 13), (2020, 12)], "y int, m int")
    assert [r[0] for r in df.select(S.month_label(F.col("y"), F.col("m"))).collect()] == ["Sin fecha", "Sin fecha", "2020", "2020", "2020", "diciembre 2020"]
    df = spark.createDataFrame([(None, "a" * 22), (0.0, "b" * 23), (0.9, ""), (61.9, "c")], "d double, n string")
    assert [tuple(r) for r in df.select(S.clock(F.col("d")), S.short_name(F.col("n"))).collect()] == [("", "a" * 22), ("", "b" * 22 + "…"), ("0:00", ""), ("1:01", "c")]
    df = spark.createDataFrame([(9802, 10000), (1000, 990), (9800, 10000), (9799, 10000), (1021, 1000), (None, 5)], "w long, h long")
    shapes = ("landscape", "portrait", "square")
    got = [[x for x, ok in zip(shapes, r) if ok] for r in df.select(*[S.has_shape(F.col("w"), F.col("h"), x) for x in shapes]).collect()]
    assert got == [["portrait", "square"], ["square"], ["portrait", "square"], ["portrait"], ["landscape"], []]


def test_full_text_normalisation(spark):
    df = spark.createDataFrame([("Mañana—ÁÉÍ  Straße ﬁn",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(S.normal_text(F.col("t"))).collect()] == ["manana aei strasse fin", None, ""]


def test_paths(spark):
    df = spark.createDataFrame([("D:\\Fotos\\a.jpg",), ("D:\\a.JPEG",), ("\\\\nas\\x\\b\\c.mp4",), ("c.txt",)], "p string")
    p = F.col("p")
    got = [tuple(r) for r in df.select(S.folder_of(p), S.parent_folder(S.folder_of(p)), S.root_of(p), S.media_type(p)).collect()]
    assert got == [("D:\\Fotos\\", "D:\\", "D:\\", "image"), ("D:\\", "", "D:\\", "image"), ("\\\\nas\\x\\b\\", "\\\\nas\\x\\", "\\\\nas\\x\\", "video"), ("", "", S.NO_ROOT, None)]


def test_folder_filter_leaves_siblings(spark):
    df = spark.createDataFrame([("D:\\Fotos\\a",), ("D:\\Fotos2\\b",), ("d:\\fotos\\x\\c",), ("D:\\F_tos\\d",)], "p string")
    assert [r[0] for r in df.where(S.inside(F.col("p"), "D:/Fotos/")).collect()] == ["D:\\Fotos\\a", "d:\\fotos\\x\\c"]


def test_position_equals_listing(cat):
    for ascending in (True, False):
        rows = gallery.page(cat.photos.select("id", "year", "month"), "date", ascending).collect()
        cases = [(1996, 5), (1998, None), (1997, "none"), (None, None)]
        for year, month in cases:
            match = (lambda r: r["year"] is None) if year is None else (lambda r: r["year"] == year and (month is None or (r["month"] is None if month == "none" else r["month"] == month)))
            first = next(k for k, r in enumerate(rows) if match(r))
            assert gallery.position(cat.photos, year, month, ascending).first()["n"] == first, (year, month, ascending)


@pytest.mark.parametrize("field", list(gallery.ORDERS))
def test_pages_cover_each_id_once(cat, field):
    few = cat.photos.where("id < 300")
    total = few.count()
    for ascending in (True, False):
        ids = [r["id"] for k in range(0, total, 90) for r in gallery.page(few, field, ascending, 90, k).select("id").collect()]
        assert len(ids) == len(set(ids)) == total


def test_query_json_round_trip():
    q = gallery.GalleryQuery(tag_ids=(1, 2), search="x", sort="rating")
    assert gallery.GalleryQuery.from_json(q.to_json()) == q
    assert gallery.GalleryQuery.from_json('{"sort": "nonsense", "unknown": 1}') == gallery.GalleryQuery()


def test_empty_id_set_matches_nothing(cat):
    f = lambda **k: gallery.apply_filter(cat.photos, cat.tags, cat.photo_tags, cat.tag_rejections, gallery.PhotoFilter(**k)).count()
    assert f(only_ids=()) == 0 and f(all_tags=(), any_tags=(), min_rating=0, search="") == cat.photos.count()


def test_closure_is_cycle_safe(spark):
    tags = spark.createDataFrame([(1, "a", 3), (2, "b", 1), (3, "c", 2), (4, "d", None)], "id int, name string, parent_id int")
    got = {(r["ancestor"], r["tag"]) for r in hierarchy.descendants(tags).collect()}
    assert got == {(1, 2), (1, 3), (2, 3), (2, 1), (3, 1), (3, 2)}


def test_deep_trees_are_whole(spark):
    n = 70
    tags = spark.createDataFrame([(k, f"t{k}", k - 1 if k > 1 else None) for k in range(1, n + 1)], "id int, name string, parent_id int")
    got = {(r["ancestor"], r["tag"]): r["depth"] for r in hierarchy.descendants(tags).collect()}
    assert got == {(a, t): t - a for a in range(1, n + 1) for t in range(a + 1, n + 1)}
    assert hierarchy.tree(tags).expanded([1, 69, 999]) == {1: list(range(1, n + 1)), 69: [69, 70]}
    bad = hierarchy.reparent_check(tags, spark.createDataFrame([(1, n), (n, 1), (5, 5)], "tag int, parent int"))
    assert {tuple(r) for r in bad.collect()} == {(1, n, False), (n, 1, True), (5, 5, False)}


def test_merge_into_descendant_takes_the_parent(spark):
    tags = spark.createDataFrame([(1, "a", None), (2, "b", 1), (3, "c", 2)], "id int, name string, parent_id int")
    pairs, aliases = spark.createDataFrame([(9, 2), (9, 3), (8, 2)], "photo_id long, tag_id int"), spark.createDataFrame([("x", 2)], "alias string, tag_id int")
    t, p, a = hierarchy.merge_tags(tags, pairs, aliases, 2, 3)
    assert {(r["id"], r["parent_id"]) for r in t.collect()} == {(1, None), (3, 1)}
    assert {tuple(r) for r in p.collect()} == {(9, 3), (8, 3)} and {tuple(r) for r in a.collect()} == {("x", 3), ("b", 3)}


def test_near_pairs_equal_brute_force(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(40)]
    hs = [h ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 8))) for h in base for _ in range(4)] + [0, 0]
    signed = [h - (1 << 64) if h >> 63 else h for h in hs]
    df = spark.createDataFrame(list(enumerate(signed)), "id long, h long")
    for d in (3, 6, 8):
        got = [tuple(r) for r in duplicates.near_pairs(df, d).collect()]
        # The links are true, none is twice, and over equal hashes they say which ids are near which.
        assert len(got) == len(set(got)) and all(a < b and n == (hs[a] ^ hs[b]).bit_count() <= d for a, b, n in got)
        first = {b: a for a, b, n in sorted(got) if n == 0}
        met = {(first.get(a, a), first.get(b, b)) for a, b, _ in got}
        for a, x in enumerate(hs):
            for b in range(a + 1, len(hs)):
                if x and hs[b] and (x ^ hs[b]).bit_count() <= d:
                    p, q = sorted((first.get(a, a), first.get(b, b)))
                    assert p == q or (p, q) in met


def test_equal_hashes_link(spark):
    got = {tuple(r) for r in duplicates.near_pairs(spark.createDataFrame([(1, 5), (2, 5), (3, 4), (4, 0), (5, None)], "id long, h long"), 1).collect()}
    assert got == {(1, 2, 0), (1, 3, 1)}


def _sequential(rows, d):
    centres, leader = [], {}
    for i, h in sorted(rows):
        if h == 0:
            continue
        near = [c for c, g in centres if (g ^ h).bit_count() <= d]
        leader[i] = near[0] if near else i
        if not near:
            centres.append((i, h))
    return {(i, c) for i, c in leader.items() if sum(x == c for x in leader.values()) > 1}


def test_leader_groups_do_not_chain(spark):
    rows = [(1, 0b0001), (2, 0b0111), (3, 0b1111110), (4, 1 << 40), (5, 1 << 40), (6, 0)]
    rng = random.Random(9)
    h = 0xF0F0F0F0
    for k in range(7, 60):
        h ^= 1 << rng.randrange(20)
        rows.append((k, h))
    got = {tuple(r) for r in duplicates.leader_groups(spark.createDataFrame(rows, "id long, h long"), 2).collect()}
    assert got == _sequential(rows, 2)


def test_long_chains_of_leaders(spark):
    rows = [(k, (1 << (k % 60)) | (1 << ((k + 1) % 60)) | (k // 60) << 60) for k in range(1, 58)]
    got = {tuple(r) for r in duplicates.leader_groups(spark.createDataFrame(rows, "id long, h long"), 2).collect()}
    assert got == _sequential(rows, 2)


def test_similar_groups_skip_identical(spark):
    photos = spark.createDataFrame([(1, "a", 5, "m", False), (2, "b", 5, "m", False), (3, "c", 7, None, False), (4, "d", 7, "n", False), (5, "e", 1, None, True), (6, "f", 1, None, False)], "id long, path string, filesize long, md5 string, hidden boolean")
    groups = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 3), (5, 5), (6, 5)], "id long, leader long")
    assert [r["leader"] for r in duplicates.similar_groups(photos, groups).collect()] == [3]
    assert [r["leader"] for r in duplicates.similar_groups(photos, groups, True).collect()] == [3, 5]


def test_missing_files_are_protected(spark):
    rows = [(k, f"G:\\f\\{k}.jpg") for k in range(25)] + [(100 + k, f"D:\\f\\{k}.jpg") for k in range(5)] + [(200, "Z:\\a.jpg"), (201, "D:\\keep.jpg")]
    photos = spark.createDataFrame(rows, "id long, path string")
    here, up = spark.createDataFrame([("D:\\keep.jpg",)], "path string"), spark.createDataFrame([("G:\\",), ("D:\\",)], "root string")
    verdict = {r["root"]: r["verdict"] for r in aggregates.missing_by_root(photos, here, up).collect()}
    assert verdict == {"G:\\": "all missing", "D:\\": "report", "Z:\\": "unavailable"}
    assert {r["id"] for r in aggregates.missing_ids(photos, here, up).collect()} == set(range(100, 105))


def test_purge_and_relocation_arguments(spark, cat):
    assert maintenance.purge(cat.trash, F.lit(datetime.datetime(2020, 1, 1)), None).count() == 0
    with pytest.raises(ValueError):
        maintenance.relocation(cat.photos, "D:\\x", "d:/X/")


def test_suggestions_of_folder_name(spark):
    photos = spark.createDataFrame([(1, "D:\\Fotos\\Playa 2019\\a.jpg"), (2, "D:\\Fotos\\Playa 2019\\b.jpg"), (3, "D:\\Fotos\\Otra\\c.jpg")], "id long, path string")
    tags = spark.createDataFrame([(1, "playa", False), (2, "mar", False), (3, "secreto", True)], "id int, name string, hidden boolean")
    aliases = spark.createDataFrame([("fotos", 2)], "alias string, tag_id int")
    pairs = spark.createDataFrame([(1, 3), (2, 3)], "photo_id long, tag_id int")
    got = {tuple(r) for r in suggest.folder_suggestions(photos, pairs, tags, aliases).collect()}
    assert {r[:3] for r in got} == {(1, 1, 0.9), (2, 1, 0.9), (1, 2, 0.9), (2, 2, 0.9), (3, 2, 0.9)}
    assert {r[3] for r in got} == {"«playa» aparece en el nombre de la carpeta", "«fotos» aparece en el nombre de la carpeta"}


def test_zero_vectors_never_match(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [0.6, 0.8])], "photo_id long, vec array<double>")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query int, qvec array<double>")
    assert {r["photo_id"] for r in vectors.scores(v, q).collect()} == {1, 3}
    # Beyond the bound they meet in blocks, and so do matrix products.
    every = v.select(F.col("photo_id").alias("query"), F.col("vec").alias("qvec"))
    want = sorted(map(tuple, vectors.scores(v, every).select("query", "photo_id", F.round("score", 9)).collect()))
    assert sorted(map(tuple, vectors.scores(v, every, most=1).select("query", "photo_id", F.round("score", 9)).collect())) == want
    assert sorted(map(tuple, vectors.scores_arrow(v, every).select("query", "photo_id", F.round("score", 9)).collect())) == want
    cents = vectors.centroids(v, v.select("photo_id", F.lit(3).alias("tag_id")), 1)
    assert [r["origin"] for tag in (3, 4) for r in vectors.tag_vector(cents, tag, [1.0, 0.0]).collect()] == ["photos", "name"] and vectors.tag_vector(cents, 4).count() == 0


def test_scores_in_blocks(spark, monkeypatch):
    """Many queries meet the vectors in blocks of arrays, evenly dealt; every pair has its score, also where blocks are cut and components are missing."""
    import numpy as np

    rng = np.random.default_rng(3)
    vecs = [(k, [float(x) for x in rng.normal(size=4)]) for k in range(60)] + [(60, [1.0, 2.0]), (61, [1.0, None, 0.0, 2.0]), (62, [float("inf"), 0.0, 0.0, 1.0]), (None, [1.0, 1.0, 1.0, 1.0]), (63, [0.0] * 4), (64, None), (5, [1.0, 0.0, 0.0, 0.0])]
    v = spark.createDataFrame(vecs, "photo_id long, vec array<double>").repartition(3)
    q = v.where("photo_id IS NULL OR photo_id % 2 = 0").select(F.col("photo_id").cast("int").alias("query"), F.col("vec").alias("qvec"))
    key = lambda r: tuple((x is None, -1 if x is None else x) for x in r[:2])
    rows = lambda df: sorted([(r[0], r[1], r[2] if r[2] is None else "nan" if r[2] != r[2] else round(r[2], 9)) for r in df.collect()], key=lambda r: (*key(r), str(r[2])))
    want = vectors.scores(v, q, most=10_000)
    assert "MapInArrow" not in want._jdf.queryExecution().toString()
    for sides, fill in ((vectors.SIDES, vectors.FILL), ((7, 6), (10, 10))):
        monkeypatch.setattr(vectors, "SIDES", sides)
        monkeypatch.setattr(vectors, "FILL", fill)
        monkeypatch.setattr(vectors, "BATCH", 5 if sides == (7, 6) else 1 << 18)
        got = vectors.scores(v, q)
        assert got.dtypes == want.dtypes and rows(got) == rows(want)
        # No join of single rows, and no block of pairs decides alone how many tasks there are.
        assert "MapInArrow" in got._jdf.queryExecution().toString() and "NestedLoop" not in got._jdf.queryExecution().toString()
        assert got.rdd.getNumPartitions() == (28 if sides == (7, 6) else 1)
        known = want.where("query IS NOT NULL AND photo_id IS NOT NULL").join(q.where("qvec IS NOT NULL").select("query").distinct(), "query", "left_semi").select("query", "photo_id", "score")
        assert rows(vectors.scores_arrow(v, q)) == rows(known)
    s = rng.normal(size=5000)
    assert (s[vectors.ordered(s)] == np.sort(s)).all() and sorted(vectors.ordered(np.append(s, [np.nan, np.inf]))) == list(range(5002))
    assert len(vectors.ordered(s[:0])) == 0


def test_rounded_is_round(spark):
    import math

    from fotoquarry.functions import scalars as S

    values = [0.0, -0.0, 0.1234564, -0.1234566, 2.5e-7, -2.5e-7, 1e-9, -1e-9, 0.9999996, 123456.1234567, 1e9, -1e9, 3.3e12, 1e300, float("inf"), float("-inf"), float("nan"), None, *(math.sin(k) * 1.7 for k in range(3000))]
    df = spark.createDataFrame([(x,) for x in values], "x double")
    # As text, so that the sign of zero counts.
    assert df.where(~S.rounded(F.col("x"), 6).cast("string").eqNullSafe(F.round("x", 6).cast("string"))).collect() == []


@pytest.mark.parametrize("share", [0.0, 0.25, 0.5, 0.999, 1.0])
def test_percentiles_without_sorting(spark, share):
    import numpy as np

    rng = np.random.default_rng(6)
    groups = {1: rng.normal(size=20_000), 2: np.full(9000, 0.5), 3: np.array([3.0]), 4: np.array([1.0, 2.0]), 5: rng.integers(0, 5, 7000) / 4, 6: np.append(rng.normal(size=3000), [1e9, -1e9])}
    rows = spark.createDataFrame([(t, float(x)) for t, xs in groups.items() for x in xs] + [(1, None), (7, None)], "tag_id int, s double")
    want = {t: np.percentile(xs, 100 * share) for t, xs in groups.items()}
    for guess in (None, 0.1, 0.9):  # a sketch that is wrong changes nothing
        got = {r["tag_id"]: r["threshold"] for r in vectors.percentiles(rows, share, guess).collect()}
        assert got.keys() == want.keys() and all(abs(got[t] - want[t]) < 1e-9 for t in want)


def test_media_listing(spark, tmp_path):
    (tmp_path / "x").mkdir()
    for n, size in (("a.JPG", 3), ("x/b.mp4", 5), ("x/c.txt", 1)):
        (tmp_path / n).write_bytes(b"z" * size)
    got = [(r["path"].rsplit("/", 1)[1], r["size"], r["media_type"]) for r in interchange.list_media(spark, str(tmp_path)).collect()]
    assert got == [("a.JPG", 3, "image"), ("b.mp4", 5, "video")]


def test_headers_with_a_codec(spark):
    files = spark.createDataFrame([("a.jpg", bytearray(b"40,30,6")), ("b.mp4", bytearray(b"1,2,v")), ("c.jpg", bytearray(b"?"))], "path string, content binary")

    def codec(path, content):
        w, h, o = content.decode().split(",")
        return {"width": int(w), "height": int(h), "orientation": int(o)} if o != "v" else {"width": 1, "height": 2, "frames": 50, "fps": 25}

    got = {r["path"]: (r["width"], r["height"], r["duration"], r["error"] is None) for r in interchange.read_headers(files, codec).collect()}
    assert got == {"a.jpg": (30, 40, None, True), "b.mp4": (1, 2, 2.0, True), "c.jpg": (None, None, None, False)}


def test_export_round_trip(spark, cat, tmp_path):
    import json

    rows = [json.loads(x) for x in interchange.export_assignments(cat.photos, cat.photo_tags, cat.tags, cat.tag_rejections).limit(20).toJSON().collect()]
    assert all(r.get("rating") != 0 and r.get("note") != "" for r in rows)
    good, bad = tmp_path / "a.json", tmp_path / "b.json"
    good.write_text(json.dumps({"version": 3, "categories": ["x"], "tags": [{"name": "t", "aliases": ["u"]}], "assignments": rows}))
    bad.write_text(json.dumps({"version": 9}))
    data = interchange.read_export(spark, str(good))
    assert tuple(interchange.export_summary(data).first()) == (3, 1, 1, len(rows))
    matched = maintenance.match_import(data.select(F.explode("assignments").alias("a")).select("a.path", "a.filename", "a.filesize"), cat.photos)
    assert matched.where("match_kind <> 'path'").count() == 0
    with pytest.raises(ValueError):
        interchange.read_export(spark, str(bad))


def _sidecar(body, attributes=""):
    spaces = "".join(f' xmlns:{k}="{v}"' for k, v in interchange.SPACES.items() if k != "x")
    return f'<?xpacket begin=""?><x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF{spaces}><rdf:Description{attributes}>{body}</rdf:Description></rdf:RDF></x:xmpmeta><?xpacket end="w"?>'


def test_foreign_and_broken_sidecars(spark):
    bag = lambda kind, *names: f"<{kind}><rdf:Bag>{''.join(f'<rdf:li>{n}</rdf:li>' for n in names)}</rdf:Bag></{kind}>"
    texts = {
        "a.xmp": _sidecar(bag("dc:subject", "Playa", "playa", " ", "Mar") + bag("lr:hierarchicalSubject", "Lugares|Costa|Mar", "Otros|Nunca") + "<xmp:Rating>9</xmp:Rating>"), "b.xmp": "<x", "c.xmp": _sidecar("", ' xmp:Rating="2.5" fq:managed="True"'),
        "d.xmp": _sidecar(bag("dc:subject", "managed"), ' xmp:Rating="-1" fq:managed="no"'), "e.xmp": _sidecar("", ' xmp:Rating="3.5"'), "f.xmp": _sidecar("", ' xmp:Rating="viel"'), "g.xmp": _sidecar(""),
    }
    files = spark.createDataFrame([(k, bytearray(t.encode())) for k, t in texts.items()], "path string, content binary")
    got = {r["path"]: r for r in interchange.parse_sidecars(files).collect()}
    assert [(t["name"], t["category"]) for t in got["a.xmp"]["tags"]] == [("playa", None), ("mar", "lugares")]
    assert {k: r["rating"] for k, r in got.items()} == {"a.xmp": 5, "b.xmp": 0, "c.xmp": 2, "d.xmp": 0, "e.xmp": 4, "f.xmp": 0, "g.xmp": 0}
    assert [k for k, r in got.items() if r["managed"]] == ["c.xmp"] and [k for k, r in got.items() if not r["ok"]] == ["b.xmp"]
    photos = spark.createDataFrame([(1, "D:\\a.jpg"), (2, "D:\\b.jpg"), (3, "D:\\c.jpg")], "id long, path string")
    cars = spark.createDataFrame([("D:\\a.xmp", True), ("D:\\a.jpg.xmp", False), ("D:\\B.XMP", True), ("D:\\c.jpg.xmp", True), ("D:\\c.xmp", True)], "path string, ok boolean")
    assert {(r["id"], r["sidecar"]) for r in interchange.first_sidecar(photos, cars).collect()} == {(1, "D:\\a.xmp"), (2, "D:\\B.XMP"), (3, "D:\\c.jpg.xmp")}


def test_sidecars_are_written_beside_their_photos(spark, tmp_path):
    kind = "path string, tags array<struct<name:string,category:string>>, rating int"
    names = [str(tmp_path / f"{n}.jpg") for n in "abcd"] + [str(tmp_path / "gone" / "e.jpg")]
    wanted = spark.createDataFrame([(names[0], [("Rock & <Roll>", "música|padre")], 3), (names[1], [], 0), (names[2], [], 4), (names[3], [("x", None)], 0), (names[4], [("y", None)], 1)], kind)

    def current():
        found = spark.read.format("binaryFile").option("pathGlobFilter", "*.xmp").load(str(tmp_path)).select(F.regexp_replace("path", "^file:|[.]xmp$", "").alias("path"), "content")
        return interchange.parse_sidecars(found).select("path", "managed", "tags", "rating")

    (tmp_path / "b.jpg.xmp").write_text(_sidecar("", ' fq:managed="True"'))
    (tmp_path / "d.jpg.xmp").write_text(_sidecar(""))
    plan = lambda: interchange.sidecar_plan(wanted, current())
    assert [r["outcome"] for r in plan().orderBy("path").collect()] == ["WRITTEN", "REMOVED", "WRITTEN", "FOREIGN", "WRITTEN"]
    done = interchange.apply_plan(wanted, plan()).orderBy("path").collect()
    assert [r["outcome"] for r in done] == ["WRITTEN", "REMOVED", "WRITTEN", "FOREIGN", "ERROR"]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.jpg.xmp", "c.jpg.xmp", "d.jpg.xmp"]
    assert [r["outcome"] for r in plan().orderBy("path").collect()] == ["UNCHANGED", "UNCHANGED", "UNCHANGED", "FOREIGN", "WRITTEN"]
    assert [(t["name"], t["category"]) for t in current().where("path LIKE '%a.jpg'").first()["tags"]] == [("rock & <roll>", "música")]


def test_vector_store(spark, cat, tmp_path):
    store = str(tmp_path / "v")
    interchange.save_vectors(cat.photo_embeddings.unionByName(cat.photo_embeddings.withColumn("model", F.lit("m2"))), store)
    interchange.save_vectors(cat.photo_embeddings.limit(3), store)
    assert interchange.load_vectors(spark, store, "m1").count() == 3 and interchange.load_vectors(spark, store, "m2").count() == cat.photo_embeddings.count()


def test_plans_stay_declarative(cat):
    plan = gallery.page(cat.photos, "date", False, 100)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
    plan = aggregates.timeline(cat.photos.where("rating >= 3"))._jdf.queryExecution().executedPlan().toString()
    assert "o_clerk" not in plan and "ReadSchema" in plan and "Python" not in plan


def test_near_pairs_and_members_name_every_document(spark):
    df = spark.createDataFrame([(5, 0b111), (3, 0b111), (9, 0b111), (4, 0b110), (7, 1 << 40), (8, 0), (6, None)], "id long, h long")
    got = sorted(tuple(r) for r in duplicates.near_pairs_and_members(df, 1).collect())
    assert got == [(3, 3, 0), (3, 4, 1), (4, 4, 0), (5, 3, 0), (7, 7, 0), (9, 3, 0)]


def test_fingerprints_equal_brute_force(spark):
    import hashlib
    import re

    def brute(text):
        hashes = [int(hashlib.md5(w.encode()).hexdigest()[:15], 16) for w in {w for w in re.split(r"[\W_]+", text.lower()) if w}]
        return sum(1 << k for k in range(60) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))

    texts = [(1, "a b c"), (2, None), (3, ""), (4, " .. "), (5, " ".join(f"w{i}" for i in range(20000))), (6, "one"), (7, "Ñandú übér ño"), (8, "one one, ONE")]
    got = {r["id"]: r["h"] for r in duplicates.text_fingerprint(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == {i: brute(t) for i, t in texts if i not in (2, 3, 4)}
    assert duplicates.text_fingerprint(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_tag_conditions_together(spark):
    photos = spark.createDataFrame([(i,) for i in range(1, 9)], "id long")
    tags = spark.createDataFrame([(1, False), (2, False), (3, True), (4, False)], "id int, hidden boolean")
    have = {1: {1}, 2: {1, 2}, 3: {1, 2, 3}, 4: {2, 4}, 5: {1, 2, 4}, 6: {3}, 7: set(), 8: {4}}
    pairs = spark.createDataFrame([(p, t) for p, own in have.items() for t in own for _ in range(2)], "photo_id long, tag_id int")
    no = spark.createDataFrame([], "tag_id int, photo_id long")

    def found(**f):
        return {r["id"] for r in gallery.apply_filter(photos, tags, pairs, no, gallery.PhotoFilter(**f)).collect()}

    assert found(all_tags=(1, 2, 2)) == {2, 3, 5}
    assert found(all_tags=(1, 2), none_tags=(4,), exclude_hidden=True) == {2}
    assert found(tag_groups=((1, 4), (2,)), exclude_hidden=True) == {2, 4, 5}
    assert found(tag_groups=((1,), ())) == set()
    assert found(any_tags=(1, 4), none_tags=(2,)) == {1, 8}
    assert found(none_tags=(1,), exclude_hidden=True) == {4, 7, 8}
    assert found(only_ids=()) == set()
