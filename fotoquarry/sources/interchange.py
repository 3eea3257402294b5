"""Files in and out: media listings, headers, exports, sidecars and the vector store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S

EXPORT_VERSIONS = (1, 2, 3)
EXPORT_SCHEMA = """version int, categories array<string>,
  tags array<struct<name:string,category:string,color:string,parent:string,aliases:array<string>>>,
  assignments array<struct<path:string,filename:string,filesize:bigint,tags:array<string>,rejected:array<string>,rating:int,favorite:boolean,note:string>>"""


def list_media(spark: SparkSession, folder: str) -> DataFrame:
    """(path, size, mtime, media_type) of all media files below a folder, by path; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreMissingFiles", True).load(folder)
    return media_rows(files)


def media_rows(files: DataFrame) -> DataFrame:
    """``list_media`` of given (path, length, modificationTime): what is neither image nor video goes."""
    ext = F.lower(F.regexp_extract("path", r"\.[^./\\]*$", 0))
    kind = F.when(ext.isin(*S.VIDEO_EXTENSIONS), "video").when(ext.isin(*S.IMAGE_EXTENSIONS), "image")
    rows = files.select("path", F.col("length").alias("size"), F.unix_micros("modificationTime").cast("double").alias("us"), kind.alias("media_type"))
    return rows.where("media_type IS NOT NULL").select("path", "size", (F.col("us") / 1e6).alias("mtime"), "media_type").orderBy("path")


HEADER = "path string, width long, height long, duration double, exif_date string, error string"


def read_headers(files: DataFrame, codec: Callable[[str, bytes], dict]) -> DataFrame:
    """Header fields of (path, content) rows by a caller's codec: width, height, orientation, frames, fps, exif_date.

    Orientations 5 to 8 swap the sides; a video lasts frames over fps. A file that the codec
    cannot read gives a row with its error.
    """

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    h = codec(path, bytes(content))
                    w, t = h.get("width"), h.get("height")
                    if h.get("orientation") in (5, 6, 7, 8):
                        w, t = t, w
                    out.append((path, w, t, h["frames"] / h["fps"] if h.get("fps") else None, h.get("exif_date"), None))
                except Exception as e:  # noqa: BLE001
                    out.append((path, None, None, None, None, f"{type(e).__name__}: {e}"))
            frame = pd.DataFrame(out, columns=["path", "width", "height", "duration", "exif_date", "error"])
            yield frame.astype({"width": "Int64", "height": "Int64", "duration": "Float64"})

    return files.select("path", "content").mapInPandas(run, HEADER)


def export_assignments(photos: DataFrame, photo_tags: DataFrame, tags: DataFrame, rejections: DataFrame) -> DataFrame:
    """(path, filename, filesize, tags, rejected, rating, favorite, note) of photos that have any; absent values are null, so that the JSON writer leaves them out."""
    names = tags.select(F.col("id").alias("tag_id"), "name")
    group = lambda pairs, c: pairs.join(names, "tag_id").groupBy("photo_id").agg(F.array_sort(F.collect_list("name")).alias(c))
    t, r = group(photo_tags, "tags"), group(rejections, "rejected").withColumnRenamed("photo_id", "_r")
    j = photos.join(t, F.col("id") == F.col("photo_id"), "left").join(r, F.col("id") == F.col("_r"), "left")
    rating, favorite, note = F.nullif(F.col("rating"), F.lit(0)), F.when(F.col("favorite"), F.lit(True)), S.clean_note(F.col("note"))
    out = j.select("path", "filename", "filesize", "tags", "rejected", rating.alias("rating"), favorite.alias("favorite"), note.alias("note"))
    return out.where("tags IS NOT NULL OR rejected IS NOT NULL OR rating IS NOT NULL OR favorite OR note IS NOT NULL")


def export_tags(tags: DataFrame, aliases: DataFrame) -> DataFrame:
    """(name, category, color, parent, aliases)."""
    a = aliases.groupBy("tag_id").agg(F.array_sort(F.collect_list("alias")).alias("aliases"))
    p = tags.select(F.col("id").alias("_p"), F.col("name").alias("parent"))
    return tags.join(a, F.col("id") == F.col("tag_id"), "left").join(p, F.col("parent_id") == F.col("_p"), "left").select("name", "category", "color", "parent", "aliases")


def write_export(folder: str, tags: DataFrame, categories: DataFrame, aliases: DataFrame, photos: DataFrame, photo_tags: DataFrame, rejections: DataFrame, version: int = 3) -> None:
    """An export as JSON lines in a folder: every line is an export of its own with one part of the whole, so that no task writes all.

    Absent values are left out. ``read_export(…, lines=True)`` reads it.
    """
    part = lambda df, c: df.select(F.lit(version).alias("version"), F.array(F.struct(*df.columns) if c != "categories" else F.col("name")).alias(c))
    parts = part(export_tags(tags, aliases), "tags"), part(categories.select("name"), "categories"), part(export_assignments(photos, photo_tags, tags, rejections), "assignments")
    parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True).write.mode("overwrite").json(folder)


def read_export(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Rows of ``EXPORT_SCHEMA``: one for a file that holds one object, one for each line of ``write_export``; other versions are an error."""
    data = spark.read.json(path, schema=EXPORT_SCHEMA, multiLine=not lines)
    bad = data.where(~F.coalesce(F.col("version"), F.lit(-1)).isin(*EXPORT_VERSIONS)).limit(1).collect()
    if bad:
        raise ValueError(f"unknown export version {bad[0]['version']}")
    return data


def export_summary(data: DataFrame) -> DataFrame:
    """(version, tags, categories, assignments): how many there are, over all rows of an export."""
    n = lambda c: F.sum(F.greatest(F.lit(0), F.coalesce(F.size(c), F.lit(0)))).cast("long").alias(c)
    return data.groupBy("version").agg(n("tags"), n("categories"), n("assignments"))


SIDECAR = "path string, ok boolean, managed boolean, rating int, tags array<struct<name:string,category:string>>"
#: Public name spaces of sidecars, and our own, whose attribute marks the files that we wrote.
SPACES = {"x": "adobe:ns:meta/", "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "dc": "http://purl.org/dc/elements/1.1/", "lr": "http://ns.adobe.com/lightroom/1.0/", "xmp": "http://ns.adobe.com/xap/1.0/", "fq": "urn:fotoquarry:sidecar"}

_SUBJECT, _HIERARCHY, _LINE, _RATING, _MANAGED = (f"{{{SPACES[s]}}}{n}" for s, n in (("dc", "subject"), ("lr", "hierarchicalSubject"), ("rdf", "li"), ("xmp", "Rating"), ("fq", "managed")))


def _parsed(text: str) -> tuple[list[dict], bool, int]:
    """(tags, whether we wrote it, rating) of one sidecar."""
    import xml.etree.ElementTree as ET

    start = text.find("<x:xmpmeta")
    start = start if start >= 0 else text.find("<rdf:RDF")
    end = text.rfind("</x:xmpmeta>")
    if 0 <= start < end:
        text = text[start : end + len("</x:xmpmeta>")]
    lines: dict[str, list[str]] = {_SUBJECT: [], _HIERARCHY: []}
    rating, rated, managed = 0, False, False
    for e in ET.fromstring(text).iter():
        managed = managed or e.get(_MANAGED) == "True"
        if e.tag in lines:
            lines[e.tag] += [(li.text or "").strip() for li in e.iter(_LINE) if li is not e]
        if not rated:
            found = e.get(_RATING)
            found = e.findtext(_RATING) if found is None else found
            if found:
                rated = True
                try:
                    rating = max(0, min(5, round(float(found))))
                except ValueError:
                    rating = 0
    category: dict[str, str] = {}
    for line in lines[_HIERARCHY]:
        parts = [x.strip().lower() for x in line.split("|") if x.strip()]
        if len(parts) > 1:
            category.setdefault(parts[-1], parts[0])
    names = dict.fromkeys(n.lower() for n in lines[_SUBJECT] if n)
    return [{"name": n, "category": category.get(n)} for n in names], managed, rating


def parse_sidecars(files: DataFrame) -> DataFrame:
    """Sidecar XML (path, content): the subjects in lower case, each once, with the first level of a hierarchical subject that ends in it as category, the rating rounded to 0 to 5 (0 if there is none), and whether we wrote it.

    Broken XML gives ok = false, not an error.
    """

    def run(batches):
        import xml.etree.ElementTree as ET

        import pandas as pd

        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"]):
                text = content if isinstance(content, str) else bytes(content).decode("utf-8", "replace")
                try:
                    tags, managed, rating = _parsed(text)
                    out.append((path, True, managed, rating, tags))
                except (ET.ParseError, OverflowError, ValueError):
                    out.append((path, False, False, 0, []))
            yield pd.DataFrame(out, columns=["path", "ok", "managed", "rating", "tags"]).astype({"rating": "Int64"})

    return files.select("path", "content").mapInPandas(run, SIDECAR)


def first_sidecar(photos: DataFrame, sidecars: DataFrame) -> DataFrame:
    """(id, sidecar): of ``name.ext.xmp`` and ``name.xmp`` the first that is there and, where ``sidecars`` says ok, can be read; of names that differ in case only the first in order."""
    if "ok" in sidecars.columns:
        sidecars = sidecars.where("ok")
    stem = F.regexp_replace("path", r"\.[^.\\/]*$", "")
    names = photos.select("id", F.posexplode(F.array(F.concat("path", F.lit(".xmp")), F.concat(stem, F.lit(".xmp")))).alias("rank", "_s"))
    return names.join(sidecars.select(F.col("path").alias("_f")), F.lower("_s") == F.lower("_f")).groupBy("id").agg(F.min_by("_f", F.struct("rank", "_f")).alias("sidecar"))


def _xml(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def wanted_sidecars(photos: DataFrame, photo_tags: DataFrame, tags: DataFrame) -> DataFrame:
    """(path, tags, rating) of every photo: what its sidecar should say. A tag's category is followed by the names above it."""
    from ..operators.hierarchy import tag_paths

    above = tag_paths(tags).select(F.col("id").alias("_t"), F.slice("names", F.lit(1), F.size("names") - 1).alias("_above"))
    full = tags.join(above, F.col("id") == F.col("_t")).select(F.col("id").alias("tag_id"), "name", F.when(F.coalesce("category", F.lit("")) != "", F.array_join(F.concat(F.array("category"), "_above"), "|")).alias("category"))
    named = photo_tags.join(full, "tag_id").groupBy("photo_id").agg(F.array_sort(F.collect_list(F.struct("name", "category"))).alias("t"))
    none = F.array().cast("array<struct<name:string,category:string>>")
    return photos.join(named, F.col("id") == F.col("photo_id"), "left").select("path", F.coalesce("t", none).alias("tags"), F.coalesce("rating", F.lit(0)).alias("rating"))


def build_sidecars(photos: DataFrame, photo_tags: DataFrame, tags: DataFrame) -> DataFrame:
    """(path, xml) for every photo that has a tag or a rating; see ``with_xml``."""
    return with_xml(wanted_sidecars(photos, photo_tags, tags).where("size(tags) > 0 OR rating > 0")).select("path", "xml")


def with_xml(wanted: DataFrame) -> DataFrame:
    """``wanted_sidecars`` and the xml of each; a rating of 0 is not written."""
    li = lambda f: F.array_join(F.transform("tags", lambda x: F.concat(F.lit("<rdf:li>"), f(x), F.lit("</rdf:li>"))), "")
    spaces = {k: f' xmlns:{k}="{v}"' for k, v in SPACES.items()}
    head = f'<x:xmpmeta{spaces["x"]}><rdf:RDF{spaces["rdf"]}><rdf:Description rdf:about=""{spaces["dc"]}{spaces["lr"]}{spaces["xmp"]}{spaces["fq"]} fq:managed="True"'
    xml = F.concat(
        F.lit(head), F.when(F.col("rating") > 0, F.concat(F.lit(' xmp:Rating="'), F.col("rating").cast("string"), F.lit('"'))).otherwise(F.lit("")), F.lit("><dc:subject><rdf:Bag>"), li(lambda x: _xml(x["name"])),
        F.lit("</rdf:Bag></dc:subject><lr:hierarchicalSubject><rdf:Bag>"), li(lambda x: _xml(F.concat_ws("|", x["category"], x["name"]))), F.lit("</rdf:Bag></lr:hierarchicalSubject></rdf:Description></rdf:RDF></x:xmpmeta>"),
    )
    return wanted.withColumn("xml", xml)


def sidecar_plan(wanted: DataFrame, current: DataFrame, folders: DataFrame | None = None) -> DataFrame:
    """(path, outcome) of every photo in ``wanted`` (path, tags, rating) against ``current`` (path, managed, tags, rating, as parsed).

    Files of others are FOREIGN. Ours are REMOVED where a photo has neither tag nor rating,
    UNCHANGED where names, first levels of the categories and rating are the same, else WRITTEN.
    ERROR: the photo's folder is not among ``folders`` (folder), if they are given.
    """
    said = lambda t: F.array_sort(F.transform(t, lambda x: F.struct(F.lower(x["name"]).alias("n"), F.coalesce(F.substring_index(x["category"], "|", 1), F.lit("")).alias("c"))))
    c = current.select(F.col("path").alias("_c"), F.col("managed").alias("_m"), F.col("tags").alias("_t"), F.col("rating").alias("_r"))
    j = wanted.join(c, F.col("path") == F.col("_c"), "left")
    data, there = (F.size("tags") > 0) | (F.col("rating") > 0), F.col("_c").isNotNull()
    reachable = F.lit(True)
    if folders is not None:
        j = j.join(folders.select(F.col("folder").alias("_f")).distinct(), S.folder_of(F.col("path")) == F.col("_f"), "left")
        reachable = F.col("_f").isNotNull()
    outcome = (
        F.when(there & ~F.col("_m"), "FOREIGN").when(there & ~data, "REMOVED").when(there & (said("tags") == said("_t")) & (F.col("rating") == F.col("_r")), "UNCHANGED")
        .when(~there & ~data, "UNCHANGED").when(~reachable, "ERROR").otherwise("WRITTEN")
    )
    return j.select("path", outcome.alias("outcome"))


def _write_file(path: str, text: str) -> None:
    import os

    with open(path + ".tmp", "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(path + ".tmp", path)


def _remove_file(path: str) -> None:
    import os

    os.remove(path)


def apply_plan(wanted: DataFrame, plan: DataFrame, write: Callable[[str, str], None] = _write_file, remove: Callable[[str], None] = _remove_file) -> DataFrame:
    """(path, outcome) after WRITTEN sidecars were written beside their photos (``path`` and .xmp) and REMOVED ones removed; ERROR where that failed.

    Tasks do the work when the result is read; doing it twice leaves the same files. ``write``
    and ``remove`` reach the store of the photos, a mounted file system by default.
    """

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for path, outcome, xml in zip(pdf["path"], pdf["outcome"], pdf["xml"]):
                try:
                    if outcome == "WRITTEN":
                        write(path + ".xmp", xml)
                    elif outcome == "REMOVED":
                        remove(path + ".xmp")
                except FileNotFoundError:
                    outcome = "REMOVED" if outcome == "REMOVED" else "ERROR"
                except OSError:
                    outcome = "ERROR"
                out.append((path, outcome))
            yield pd.DataFrame(out, columns=["path", "outcome"])

    return plan.join(with_xml(wanted), "path").select("path", "outcome", "xml").mapInPandas(run, "path string, outcome string")


def sidecar_counts(outcomes: DataFrame) -> DataFrame:
    """(written, unchanged, foreign, errors) of one run; removed ones count as unchanged."""
    n = lambda *k: F.count_if(F.col("outcome").isin(*k))
    return outcomes.agg(n("WRITTEN").alias("written"), n("UNCHANGED", "REMOVED").alias("unchanged"), n("FOREIGN").alias("foreign"), n("ERROR").alias("errors"))


def save_vectors(vectors: DataFrame, folder: str) -> None:
    """The vector store: Parquet by model; only the models at hand are replaced."""
    vectors.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model").parquet(folder)


def load_vectors(spark: SparkSession, folder: str, model: str) -> DataFrame:
    return spark.read.parquet(folder).where(F.col("model") == model)


def stored_counts(vectors: DataFrame) -> DataFrame:
    """(model, n): how many vectors are stored of each model."""
    return vectors.groupBy("model").agg(F.count(F.lit(1)).alias("n"))


def without_other_models(vectors: DataFrame, model: str) -> DataFrame:
    """The vectors of one model; those of all others are forgotten."""
    return vectors.where(F.col("model") == model)


def without_vectors(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    return vectors.join(ids.select(F.col("id").alias("_i")), F.col("photo_id") == F.col("_i"), "left_anti")
