"""Documents in archives, directory listings, wiki dumps, and archives written from documents."""

from __future__ import annotations

import io
import os
import tarfile
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions import text as T
from termloom.functions import values as V
from termloom.operators.lineage import numbered
from termloom.sources import scratch


#: Members are handed on once they are so many bytes together.
FRAME_BYTES = 4 << 20


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, file_id): files in path order, ids from 0. File contents are not read."""
    return numbered(spark.read.format("binaryFile").load(path).select("path", "length"), ["path"], "file_id")


def _members(raw: pa.Buffer):
    if zipfile.is_zipfile(pa.BufferReader(raw)):
        with zipfile.ZipFile(pa.BufferReader(raw)) as z:
            for i in z.infolist():
                if not i.is_dir():
                    with z.open(i) as f:
                        yield i.filename, f.read(T.MAX_BYTES)
        return
    with tarfile.open(fileobj=pa.BufferReader(raw)) as t:  # any compression
        for i in t:
            if i.isfile():
                yield i.name, t.extractfile(i).read(T.MAX_BYTES)


def _frames(path: str, raw: pa.Buffer):
    """(archive, member, raw) of an archive's members, FRAME_BYTES and the last member at most at once."""
    names, raws, size = [], [], 0
    for m, r in _members(raw):
        names.append(m)
        raws.append(r)
        size += len(r)
        if size >= FRAME_BYTES:
            yield pa.RecordBatch.from_pydict({"archive": [path] * len(names), "member": names, "raw": pa.array(raws, pa.binary())})
            names, raws, size = [], [], 0
    if names:
        yield pa.RecordBatch.from_pydict({"archive": [path] * len(names), "member": names, "raw": pa.array(raws, pa.binary())})


def scan(spark: SparkSession, path: str) -> DataFrame:
    """(archive, member, doc_id, text) of the members of zip and tar archives; empty texts are left out.

    Archives are read where Arrow has put them, without a copy; only members of a frame are unpacked.
    """

    def run(batches):
        for b in batches:
            for p, c in zip(b.column("path"), b.column("content"), strict=True):
                yield from _frames(p.as_py(), c.as_buffer())

    members = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "archive string, member string, raw binary")
    out = members.select("archive", "member", V.member_doc_id(F.col("member")).alias("doc_id"), T.normalised(F.col("raw")).alias("text"))
    return out.where("text is not null")


def wiki_pages(spark: SparkSession, path: str) -> DataFrame:
    """(title, text) of the pages of an XML dump."""
    pages = spark.read.format("xml").option("rowTag", "page").schema("title string, revision struct<text: string>").load(path)
    return pages.select("title", F.col("revision.text").alias("text"))


def articles(pages: DataFrame, least: int = 500) -> DataFrame:
    """(n, title, text): cleaned texts of more than ``least`` code points, numbered from 1 by title."""
    # Written once: the filter, the sampling for the range sort and the sort would each clean the texts anew.
    spark, path = pages.sparkSession, scratch.folder(pages.sparkSession, "articles")
    pages.select("title", T.plain_text(F.col("text")).alias("text")).write.parquet(f"{path}/cleaned")
    kept = spark.read.parquet(f"{path}/cleaned").where(F.char_length("text") > least)
    return numbered(kept, ["title", "text"], "n", 1).select("n", "title", "text")


def _packed(batches, threshold: int):
    """(name, documents, content) of one archive after the other, of batches of (n, title, text)."""
    seq, buf, z, n = 0, None, None, 0
    part = os.urandom(4).hex()

    def close():
        z.close()
        return f"coll-{part}-{seq:06d}-{n:06d}.zip", n, buf.getbuffer()

    for b in batches:
        for i, title, text in zip(b.column("n"), b.column("title"), b.column("text"), strict=True):
            if z is None:
                buf = io.BytesIO()
                z, n = zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED), 0
            z.writestr(f"doc-{i.as_py()}-{title.as_py()}", text.as_py() or "")
            n += 1
            if buf.tell() > threshold:
                yield close()
                seq, z = seq + 1, None
    if z is not None:
        yield close()


def pack(docs: DataFrame, threshold: int = 66_060_288) -> DataFrame:
    """(archive, n_docs, content): deflated zips of members doc-<n>-<title>, from (n, title, text).

    An archive is closed once its size passes the threshold. Each partition rolls over on its own,
    so the number of archives, not their content, depends on the partitioning. Empty ones are left out.
    """

    def run(batches):
        for name, n, raw in _packed(batches, threshold):
            yield pa.RecordBatch.from_pydict({"archive": [name], "n_docs": [n], "content": pa.array([raw], pa.binary())})

    return docs.select("n", "title", "text").mapInArrow(run, "archive string, n_docs long, content binary")


def write(docs: DataFrame, folder: str, threshold: int = 66_060_288) -> None:
    """The archives of ``pack`` as files of a folder, given by its address, that all executors reach;
    written by the worker that packs them and moved into place when whole."""
    from pyarrow import fs

    def run(batches):
        files, root = fs.FileSystem.from_uri(folder)
        for name, _, raw in _packed(batches, threshold):
            with files.open_output_stream(f"{root}/.{name}") as f:
                f.write(raw)
            files.move(f"{root}/.{name}", f"{root}/{name}")
        yield pa.RecordBatch.from_pydict({"ok": [True]})

    files, root = fs.FileSystem.from_uri(folder)
    files.create_dir(root)
    docs.select("n", "title", "text").mapInArrow(run, "ok boolean").count()
