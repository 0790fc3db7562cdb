"""Books, transcripts and archives as one source: ``spark.read.format("bookfiles")``.

``register`` once a session, then name a ``kind`` and a folder:

* ``epub``: chapters in reading order, and a row with a fault for a file that cannot be read;
* ``sidecar``: transcripts of any version in the form of the third, or a fault;
* ``archive``: the members of book archives, each held against the manifest's checksum.

Files are dealt to partitions by size, and each is opened in a task through
``pyarrow.fs``, so a folder may be ``file:``, ``hdfs:``, ``s3:`` or ``gs:``.
"""

from __future__ import annotations

import hashlib
import io
import json
import posixpath
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quire.sources import readers

#: Bytes of files that a task reads, about.
PARTITION_BYTES = 64_000_000
#: Length in seconds from which a silence without a kind is one of a chapter, a paragraph or a sentence.
SILENCES = ((3.0, "chapter"), (0.6, "paragraph"), (0.3, "sentence"))
WORDS = "array<struct<w:string,s:double,e:double,conf:double>>"
KINDS = {
    "epub": ((".epub",), "path string, chapter_idx int, href string, title string, book string, html string, fault string"),
    "sidecar": ((".stt.json",), f"path string, made_by string, duration double, words {WORDS}, silences array<struct<a:double,b:double,kind:string>>, fault string"),
    "archive": ((".abook", ".zip"), "path string, member string, size long, sha256 string, state string, content binary"),
}


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...]


class BookFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bookfiles"

    def _kind(self) -> str:
        kind = self.options.get("kind", "")
        if kind not in KINDS:
            raise ValueError(f"kind must be one of {', '.join(KINDS)}")
        return kind

    def schema(self) -> str:
        return KINDS[self._kind()][1]

    def reader(self, schema) -> DataSourceReader:
        return BookReader(self._kind(), dict(self.options))


class BookReader(DataSourceReader):
    def __init__(self, kind: str, options: dict):
        self.kind, self.root = kind, options["path"]
        self.most = int(options.get("partitionbytes", PARTITION_BYTES))
        self.content = options.get("content", "false") == "true"

    def partitions(self) -> list[InputPartition]:
        """Files of the folder in order of their names, about ``partitionBytes`` together."""
        files, at = opened(self.root)
        found = sorted((x.path, x.size) for x in files.get_file_info(pafs.FileSelector(at, recursive=True)) if x.is_file and x.path.lower().endswith(KINDS[self.kind][0]))
        out, held, size = [], [], 0
        for path, n in found:
            if held and size + n > self.most:
                out.append(Files(tuple(held)))
                held, size = [], 0
            held.append(path)
            size += n
        return [*out, Files(tuple(held))] if held or not out else out

    def read(self, partition: Files) -> Iterator[tuple]:
        files, _ = opened(self.root)
        rows = {"epub": book_rows, "sidecar": sidecar_rows, "archive": self._members}[self.kind]
        for path in partition.paths:
            with files.open_input_file(path) as f:
                yield from ((path, *row) for row in rows(f.read()))

    def _members(self, raw: bytes) -> Iterator[tuple]:
        for member, size, digest, state, content in archive_rows(raw):
            yield member, size, digest, state, content if self.content else None


def opened(root: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(root) if ":" in root else (pafs.LocalFileSystem(), root)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BookFiles)


def read(spark: SparkSession, kind: str, root: str, content: bool = False) -> DataFrame:
    """Rows of the files of a kind under ``root`` (SRC5, SRC9, SRC14, SRC15)."""
    register(spark)
    return spark.read.format("bookfiles").option("kind", kind).option("content", str(content).lower()).load(root)


def book_rows(raw: bytes) -> Iterator[tuple]:
    """Chapters of an EPUB file (SRC5); a file that is no book or has no chapter is one row with a fault."""
    found = readers._chapters(raw)
    if not found:
        yield None, None, None, None, None, "damaged" if not zipfile.is_zipfile(io.BytesIO(raw)) else "no chapters"
    for i, (href, title, book, html) in enumerate(found):
        yield i, href, title, book, html, None


def sidecar_rows(raw: bytes) -> Iterator[tuple]:
    """A transcript in the form of the third version (SRC9, SRC10), or a row with a fault."""
    none = (None, None, None, None)
    try:
        doc = json.loads(raw)
        version = doc.get("version") or (2 if doc.get("silences") is not None else 1)
    except (ValueError, AttributeError):
        yield *none, "damaged"
        return
    if version not in (1, 2, 3):
        yield *none, f"unknown version {version}"
        return
    try:
        first = lambda w, *names: next((w[n] for n in names if w.get(n) is not None), None)
        number = lambda x: None if x is None else float(x)
        listed = doc.get("words") or [w for s in doc.get("segments") or [] for w in s.get("words") or []]
        words = [((first(w, "word", "text") or "").strip(), *(number(first(w, *n)) for n in (("start", "s"), ("end", "e"), ("probability", "confidence")))) for w in listed]
        quiet = [(float(q["start"]), float(q["end"]), q.get("kind") or next((k for least, k in SILENCES if q["end"] - q["start"] >= least), "breath")) for q in doc.get("silences") or []]
        length = float(doc.get("duration") or 0) or max((w[2] for w in words if w[2] is not None), default=0.0)
    except (TypeError, KeyError, ValueError, AttributeError) as e:
        yield *none, f"not a transcript: {type(e).__name__}"
        return
    yield f"upgraded from {version}" if version < 3 else "read", length, words, quiet, None


def unsafe(member: str) -> bool:
    """Whether a member's name would lead out of the folder that an archive is unpacked to."""
    plain = posixpath.normpath(member.replace("\\", "/"))
    return plain.startswith(("/", "../")) or plain in ("..", ".") or ":" in plain.split("/")[0]


def archive_rows(raw: bytes) -> Iterator[tuple]:
    """Members of an archive (SRC14, SRC15): name, size, SHA-256, state, content.

    The state is ``ok``, ``changed`` where the manifest has another checksum,
    ``unlisted`` or ``missing`` where it and the archive differ, ``unsafe`` for names
    that lead elsewhere, ``damaged`` for what cannot be read; the manifest itself is ``manifest``.
    """
    try:
        z = zipfile.ZipFile(io.BytesIO(raw))
        sums = json.loads(z.read("manifest.json")).get("checksums") or {}
    except (zipfile.BadZipFile, KeyError, ValueError, AttributeError, EOFError, OSError):
        yield None, None, None, "damaged", None
        return
    for info in z.infolist():
        if info.is_dir():
            continue
        if unsafe(info.filename):
            yield info.filename, info.file_size, None, "unsafe", None
            continue
        try:
            data = z.read(info)
        except Exception:  # zlib and zipfile tell of broken data in several ways
            yield info.filename, info.file_size, None, "damaged", None
            continue
        digest = hashlib.sha256(data).hexdigest()
        said = sums.get(info.filename)
        state = "manifest" if info.filename == "manifest.json" else "unlisted" if said is None else "ok" if said == f"sha256:{digest}" else "changed"
        yield info.filename, len(data), digest, state, data
    for name in sorted(set(sums) - set(z.namelist())):
        yield name, None, None, "missing", None


def packed(title: str, members: list[tuple[str, bytes]]) -> bytes:
    """An archive of the members with a manifest that has the checksum of each (SRC12, SRC15); the same members give the same bytes."""
    box = io.BytesIO()
    sums = {name: f"sha256:{hashlib.sha256(data).hexdigest()}" for name, data in members}
    manifest = {"format": "abook", "version": 1, "title": title, "chapters": [{"index": i, "text": name} for i, (name, _) in enumerate(members)], "checksums": sums}
    with zipfile.ZipFile(box, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in [("manifest.json", json.dumps(manifest, indent=2, sort_keys=True).encode()), *members]:
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data, zipfile.ZIP_DEFLATED)
    return box.getvalue()


def pack(chapters: DataFrame, root: str, work: str) -> DataFrame:
    """Write an archive for each work under ``root`` (SRC12, SRC15): work, path, size.

    ``chapters``: work, idx, title and html.  A work is packed by one task, under a
    name of its own that is changed last; packing it again replaces it.
    """

    def write(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        members = [(f"text/chapter-{i:03d}.html", html.encode()) for i, html in enumerate(pdf["html"], 1)]
        data = packed(str(pdf["title"].iloc[0]), members)
        files, at = opened(root)
        files.create_dir(at, recursive=True)
        path = f"{at}/{key[0]}.abook"
        building = f"{path}.{uuid.uuid4().hex}"
        with files.open_output_stream(building) as f:
            f.write(data)
        files.move(building, path)
        return pd.DataFrame({work: [key[0]], "path": [path], "size": [len(data)]})

    kind = dict(chapters.dtypes)[work]
    return chapters.groupBy(work).applyInPandas(write, f"{work} {kind}, path string, size long")


def unpack(archives: DataFrame, target: str) -> DataFrame:
    """Write the members of archives that were read with their content under ``target`` (SRC15): path, members, refused.

    An archive with an unsafe, damaged or changed member is refused as a whole.
    """
    bad = archives.where(~F.col("state").isin("ok", "manifest", "unlisted")).groupBy("path").agg(F.concat_ws(", ", F.sort_array(F.collect_set("state"))).alias("refused"))
    good = archives.join(bad, "path", "left_anti").where("content is not null")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, at = opened(target)
        for pdf in batches:
            for path, member, content in zip(pdf["path"], pdf["member"], pdf["content"], strict=True):
                to = f"{at}/{posixpath.basename(path)}/{posixpath.normpath(member)}"
                files.create_dir(posixpath.dirname(to), recursive=True)
                with files.open_output_stream(to) as f:
                    f.write(bytes(content))
            yield pdf[["path"]]

    written = good.select("path", "member", "content").mapInPandas(write, "path string").groupBy("path").agg(F.count("*").alias("members"))
    return archives.select("path").distinct().join(written, "path", "left").join(bad, "path", "left").select("path", F.coalesce("members", F.lit(0).cast("long")).alias("members"), "refused")
