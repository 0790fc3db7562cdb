"""Readers and sinks for libraries of texts, pages and timelines."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as tx

#: Format and kind of medium by file extension.
FORMATS = (("epub", "epub", "text"), ("mobi", "mobi", "text"), ("azw3", "mobi", "text"), ("azw", "mobi", "text"), ("pdf", "pdf", "text"), ("txt", "text", "text"), ("mp3", "mp3", "audio"), ("m4b", "m4b", "audio"), ("m4a", "m4a", "audio"), ("flac", "flac", "audio"), ("aac", "aac", "audio"), ("opus", "opus", "audio"), ("ogg", "opus", "audio"))
#: Origin that a format suggests.
ORIGINS = (("epub", "publisher_epub"), ("mobi", "publisher_mobi"), ("pdf", "publisher_pdf"))
TIMELINE = "duration DOUBLE, language STRING, language_probability DOUBLE, segments ARRAY<STRUCT<start: DOUBLE, end: DOUBLE, text: STRING, words: ARRAY<STRUCT<word: STRING, start: DOUBLE, end: DOUBLE, probability: DOUBLE>>>>"


def _lookup(key: Column, pairs) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for p in pairs for x in p]), key)


def classify(files: DataFrame, path: str = "path") -> DataFrame:
    """``files`` with format, media_type, origin and title from the path; unknown kinds go (SRC1, SRC3, SRC4)."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    out = files.withColumn("format", _lookup(ext, [(a, b) for a, b, _ in FORMATS])).withColumn("media_type", _lookup(ext, [(a, c) for a, _, c in FORMATS])).where("format is not null")
    return out.withColumn("origin", F.coalesce(_lookup(F.col("format"), ORIGINS), F.lit("user_upload"))).withColumn("title", tx.title_from_filename(path))


def walk(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """Files under ``root`` with size and time; contents are read only if asked for (SRC1)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    files = files.where(~F.col("path").rlike("/(tts-previews|abooks)/"))
    return classify(files if content else files.drop("content"))


def read_timeline(spark: SparkSession, path: str) -> DataFrame:
    """Words of transcript files: path, pos, s, e, w, conf (SRC9, SRC10, SCA48)."""
    j = spark.read.schema(TIMELINE).option("multiLine", "true").json(path).withColumn("path", F.input_file_name())
    seg = j.select("path", F.posexplode("segments").alias("seg", "x"))
    w = seg.select("path", "seg", F.posexplode("x.words").alias("k", "w"))
    return w.select("path", "seg", "k", F.col("w.start").alias("s"), F.col("w.end").alias("e"), F.trim("w.word").alias("w"), F.col("w.probability").alias("conf"))


#: Versions of transcript files: the third has words, silences and sources at the top; the first two name words' fields otherwise or keep them within segments.
SIDECAR = "version INT, duration DOUBLE, language STRING, words ARRAY<STRUCT<word: STRING, text: STRING, start: DOUBLE, end: DOUBLE, s: DOUBLE, e: DOUBLE, probability: DOUBLE, confidence: DOUBLE>>, segments ARRAY<STRUCT<words: ARRAY<STRUCT<word: STRING, start: DOUBLE, end: DOUBLE, probability: DOUBLE>>>>, silences ARRAY<STRUCT<start: DOUBLE, end: DOUBLE, kind: STRING>>, sources ARRAY<STRUCT<filename: STRING, start_sec: DOUBLE, duration: DOUBLE>>"


def upgraded_sidecars(spark: SparkSession, path: str) -> DataFrame:
    """Transcript files of any version in the form of the third (SRC9, SRC10): path, version, made_by, duration, words, silences, sources."""
    j = spark.read.schema(SIDECAR).option("multiLine", "true").json(path).withColumn("path", F.input_file_name())
    own = F.transform("words", lambda w: F.struct(F.trim(F.coalesce(w["word"], w["text"])).alias("w"), F.coalesce(w["start"], w["s"]).alias("s"), F.coalesce(w["end"], w["e"]).alias("e"), F.coalesce(w["probability"], w["confidence"]).alias("conf")))
    nested = F.flatten(F.transform("segments", lambda g: F.transform(g["words"], lambda w: F.struct(F.trim(w["word"]).alias("w"), w["start"].alias("s"), w["end"].alias("e"), w["probability"].alias("conf")))))
    words = F.coalesce(F.when(F.size("words") > 0, own), nested, F.array().cast("array<struct<w:string,s:double,e:double,conf:double>>"))
    was = F.coalesce("version", F.when(F.col("silences").isNotNull(), 2).otherwise(1))
    kind = lambda x: F.coalesce(x["kind"], F.when(x["end"] - x["start"] >= 3.0, "chapter").when(x["end"] - x["start"] >= 0.6, "paragraph").when(x["end"] - x["start"] >= 0.3, "sentence").otherwise("breath"))
    quiet = F.coalesce(F.transform("silences", lambda x: F.struct(x["start"].alias("a"), x["end"].alias("b"), kind(x).alias("kind"))), F.array().cast("array<struct<a:double,b:double,kind:string>>"))
    sources = F.coalesce("sources", F.array().cast("array<struct<filename:string,start_sec:double,duration:double>>"))
    end = F.array_max(F.transform(words, lambda w: w["e"]))
    return j.select("path", F.lit(3).alias("version"), F.concat(F.lit("upgraded from "), was.cast("string")).alias("made_by"), F.coalesce(F.when(F.col("duration") > 0, F.col("duration")), end, F.lit(0.0)).alias("duration"), words.alias("words"), quiet.alias("silences"), sources.alias("sources"))


def sidecar_of(files: DataFrame, present: DataFrame, path: str = "path") -> DataFrame:
    """The transcript file of each audio file (OTH19): that of its folder, else of its name without the ending, else of its whole name.

    ``present``: path, the transcript files that there are.
    """
    folder, bare = F.regexp_replace(path, "/[^/]*$", ""), F.regexp_replace(path, r"\.[^./]*$", "")
    wanted = F.array(*[F.concat(p, F.lit(".stt.json")) for p in (folder, bare, F.col(path))])
    each = files.select(path, F.posexplode(wanted).alias("rank", "sidecar"))
    met = each.join(present.select(F.col("path").alias("sidecar")), "sidecar", "left_semi").groupBy(path).agg(F.min_by("sidecar", "rank").alias("sidecar"))
    return files.join(met, path, "left")


def embedded_chapters(probed: DataFrame, key: str, json: str) -> DataFrame:
    """Chapter marks inside audio files, from the probe's JSON (SRC19, OTH17): key, idx, title, start_sec, end_sec."""
    kind = "chapters ARRAY<STRUCT<id: BIGINT, start_time: STRING, end_time: STRING, tags: STRUCT<title: STRING>>>"
    c = probed.select(key, F.posexplode(F.from_json(json, kind)["chapters"]).alias("idx", "c"))
    number = lambda c: F.coalesce(c.try_cast("double"), F.lit(0.0))
    title = F.coalesce(F.nullif(F.col("c.tags.title"), F.lit("")), F.concat(F.lit("Chapter "), (F.col("idx") + 1).cast("string")))
    return c.select(key, "idx", title.alias("title"), number(F.col("c.start_time")).alias("start_sec"), number(F.col("c.end_time")).alias("end_sec"))


def write_timeline(words: DataFrame, path: str) -> None:
    """Words of each book as one JSON row (SRC11); Spark's commit makes the write all or nothing."""
    listed = F.array_sort(F.collect_list(F.struct("pos", "s", "e", "w")))
    words.groupBy("doc_id").agg(F.transform(listed, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["w"].alias("w"))).alias("words")).write.mode("overwrite").json(path)


def read_written_timeline(spark: SparkSession, path: str) -> DataFrame:
    """Words that ``write_timeline`` wrote (SCA48): doc_id, pos, s, e, w."""
    j = spark.read.schema("doc_id BIGINT, words ARRAY<STRUCT<s: DOUBLE, e: DOUBLE, w: STRING>>").json(path)
    return j.select("doc_id", F.posexplode("words").alias("pos", "x")).select("doc_id", "pos", "x.s", "x.e", "x.w")


def float_blob(vector: Column) -> Column:
    """A vector as little-endian 32-bit floats (SCA35)."""

    @F.pandas_udf("binary")
    def pack(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None else np.asarray(x, dtype="<f4").tobytes())

    return pack(vector)


def blob_floats(blob: Column) -> Column:
    """The vector of a blob of 32-bit floats (SCA35); null where its length does not fit."""

    @F.pandas_udf("array<float>")
    def unpack(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None or not len(x) or len(x) % 4 else np.frombuffer(x, dtype="<f4"))

    return unpack(blob)


def write_archive(tables: dict[str, DataFrame], path: str, key: str = "work_id") -> DataFrame:
    """Tables by work under ``path`` and a manifest with rows and a checksum of each (SRC12): name, rows, checksum."""
    out = None
    for name, df in tables.items():
        df.write.mode("overwrite").partitionBy(key).parquet(f"{path}/{name}")
        back = df.sparkSession.read.parquet(f"{path}/{name}")
        one = back.agg(F.count("*").alias("rows"), _checksum(back).alias("checksum")).select(F.lit(name).alias("name"), "rows", "checksum")
        out = one if out is None else out.unionByName(one)
    out.write.mode("overwrite").json(f"{path}/manifest")
    return df.sparkSession.read.schema("name string, rows long, checksum string").json(f"{path}/manifest")


def archive_faults(spark: SparkSession, path: str) -> DataFrame:
    """Tables of an archive whose rows or checksum are not those of its manifest (SRC15): name, rows, found."""
    manifest = spark.read.schema("name string, rows long, checksum string").json(f"{path}/manifest")
    out = None
    for m in manifest.collect():  # one row a table
        t = spark.read.parquet(f"{path}/{m['name']}")
        one = t.agg(F.count("*").alias("found"), _checksum(t).alias("sum")).select(F.lit(m["name"]).alias("name"), F.lit(m["rows"]).alias("rows"), "found", (F.col("sum") == m["checksum"]).alias("same"))
        out = one if out is None else out.unionByName(one)
    kind = "name string, rows long, found long"
    return spark.createDataFrame([], kind) if out is None else out.where("not same or rows <> found").select("name", "rows", "found")


def archive_counts(spark: SparkSession, path: str, key: str = "work_id") -> DataFrame:
    """What an archive holds of each work (SRC14): key, name, rows."""
    out = None
    for m in spark.read.schema("name string, rows long, checksum string").json(f"{path}/manifest").collect():
        one = spark.read.parquet(f"{path}/{m['name']}").groupBy(key).agg(F.count("*").alias("rows")).select(key, F.lit(m["name"]).alias("name"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def _checksum(df: DataFrame) -> Column:
    return F.coalesce(F.sum(F.xxhash64(*[F.col(c).cast("string") for c in sorted(df.columns)]).cast("decimal(38,0)")), F.lit(0)).cast("string")


def import_archive(spark: SparkSession, path: str, remap: DataFrame, target: str, key: str = "work_id") -> list[str]:
    """All tables of an archive under new identifiers, written to ``target`` (SRC13); an archive that is not whole is refused and nothing is written."""
    bad = [r["name"] for r in archive_faults(spark, path).collect()]
    if bad:
        raise ValueError(f"archive is not whole: {', '.join(sorted(bad))}")
    names = [m["name"] for m in spark.read.schema("name string, rows long, checksum string").json(f"{path}/manifest").collect()]
    for name in names:
        read_archive(spark, path, name, remap, key).write.mode("overwrite").partitionBy(key).parquet(f"{target}/{name}")
    return names


def read_archive(spark: SparkSession, path: str, name: str, remap: DataFrame, key: str = "work_id") -> DataFrame:
    """A table of an archive under the identifiers of this library (SRC13); ``remap`` has old_id and new_id."""
    t = spark.read.parquet(f"{path}/{name}")
    return t.join(remap, t[key] == remap["old_id"]).withColumn(key, F.col("new_id")).drop("old_id", "new_id")


def zero_runs(files: DataFrame, least: int = 256 * 1024) -> DataFrame:
    """``files`` with the longest run of zero bytes and whether it tells of a truncated file (SRC20)."""

    @F.pandas_udf("long")
    def longest(content: pd.Series) -> pd.Series:
        def run(raw) -> int:
            filled = np.flatnonzero(np.frombuffer(raw, dtype=np.uint8))
            return int(np.diff(np.concatenate([[-1], filled, [len(raw)]])).max()) - 1

        return content.map(run)

    return files.withColumn("longest_zero_run", longest("content")).withColumn("truncated", F.col("longest_zero_run") >= least)


def read_epub(files: DataFrame) -> DataFrame:
    """Chapters of EPUB files in reading order (SRC5): path, chapter_idx, href, title, book and text; damaged files give no rows.

    A file of the reading order is a chapter, titled by the table of contents or
    its first heading, unless the headings of all files together part the book
    into more.
    """

    def chapters(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(path, i, *c) for path, raw in zip(pdf["path"], pdf["content"], strict=True) for i, c in enumerate(_chapters(bytes(raw)))]
            yield pd.DataFrame(rows, columns=["path", "chapter_idx", "href", "title", "book", "html"])

    pages = files.select("path", "content").mapInPandas(chapters, "path string, chapter_idx int, href string, title string, book string, html string")
    return pages.select("path", "chapter_idx", "href", "title", "book", tx.html_to_text("html").alias("text"))


def read_epub_metadata(files: DataFrame) -> DataFrame:
    """Title, author, genre and series of EPUB files (SRC6): path, title, author, genre, series, series_index.

    The first title and creator; the first subject that is no trade code; the
    series of the library's own marks, else of the title.
    """

    def described(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(path, *m) for path, raw in zip(pdf["path"], pdf["content"], strict=True) if (m := _described(bytes(raw))) is not None]
            yield pd.DataFrame(rows, columns=["path", "title", "author", "genre", "series", "series_index"]).astype({"series_index": float})

    m = files.select("path", "content").mapInPandas(described, "path string, title string, author string, genre string, series string, series_index double")
    by_title = tx.series_of("title")
    own = F.col("series") != ""
    return m.withColumns({"series": F.when(own, F.col("series")).otherwise(F.coalesce(by_title["name"], F.lit(""))), "series_index": F.when(own, F.col("series_index")).otherwise(by_title["index"].cast("double"))})


_HEADING = re.compile(r"(?is)<h([1-3])\b[^>]*>(.*?)</h\1\s*>")
_CHAPTER_LIKE = re.compile(r"(?i)^\s*(chapter|part|book|section|letter|stave|prologue|epilogue)\b|^\s*[IVXLC]+\.?\s*$")


def _local(e) -> str:
    return e.tag.rpartition("}")[2]


def _opened(raw: bytes):
    """The archive, the folder of the package file and its tree."""
    z = zipfile.ZipFile(io.BytesIO(raw))
    box = ElementTree.fromstring(z.read("META-INF/container.xml"))
    opf = next(e.get("full-path") for e in box.iter() if _local(e) == "rootfile")
    return z, opf.rpartition("/")[0], ElementTree.fromstring(z.read(opf))


_DAMAGED = (zipfile.BadZipFile, KeyError, StopIteration, ElementTree.ParseError)


def _plain(html: str) -> str:
    return " ".join(re.sub(r"(?s)<[^>]*>", " ", html).split())


def _chapters(raw: bytes) -> list[tuple[str, str, str, str]]:
    try:
        z, base, book = _opened(raw)
        place = lambda href: f"{base}/{href}" if base else href
        items = {e.get("id"): (e.get("href"), e.get("media-type", "")) for e in book.iter() if _local(e) == "item"}
        name = next((e.text or "" for e in book.iter() if _local(e) == "title"), "")
        titles = {}
        for href, kind in items.values():
            if "ncx" in kind:
                for point in ElementTree.fromstring(z.read(place(href))).iter():
                    if _local(point) == "navPoint":
                        text = next((e.text or "" for e in point.iter() if _local(e) == "text"), "")
                        src = next((e.get("src", "") for e in point.iter() if _local(e) == "content"), "")
                        titles.setdefault(src.partition("#")[0], text.strip())
        pages = []
        for e in book.iter():
            if _local(e) == "itemref" and e.get("linear") != "no" and e.get("idref") in items and "html" in items[e.get("idref")][1]:
                href = items[e.get("idref")][0]
                pages.append((href, z.read(place(href)).decode("utf-8", "replace")))
    except _DAMAGED:
        return []
    whole = "\n".join(html for _, html in pages)
    cuts = [m for m in _HEADING.finditer(whole) if _CHAPTER_LIKE.search(_plain(m[2]))]
    if len(cuts) >= 2 and len(cuts) > len(pages):
        ends = [m.start() for m in cuts[1:]] + [len(whole)]
        return [("", _plain(m[2]), name, whole[m.start() : end]) for m, end in zip(cuts, ends, strict=True)]
    first = lambda html: next((_plain(m[2]) for m in _HEADING.finditer(html)), "")
    return [(href, titles.get(href) or first(html) or name, name, html) for href, html in pages]


def _described(raw: bytes) -> tuple[str, str, str, str, float | None] | None:
    try:
        book = _opened(raw)[2]
    except _DAMAGED:
        return None
    of = lambda tag: [(e.text or "").strip() for e in book.iter() if _local(e) == tag]
    marks = {e.get("name"): (e.get("content") or "").strip() for e in book.iter() if _local(e) == "meta" and e.get("name")}
    genre = next((s for s in of("subject") if s and not re.fullmatch(r"[A-Z]{3}\d{6}", s)), "")
    index = marks.get("calibre:series_index", "")
    return (*[next(iter(of(t)), "") for t in ("title", "creator")], genre, marks.get("calibre:series", ""), float(index) if re.fullmatch(r"\d+(\.\d+)?", index) else None)
