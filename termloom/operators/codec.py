"""The binary index record: u32 length, term, u32 df, df pairs (u32 doc_id, u32 tf), line end."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A file is closed once it is so large; readers hold whole files.
FILE_BYTES = 16 << 20
#: Postings that are encoded or decoded at once, and the most records; a record stays whole.
_POSTINGS, _RECORDS = 1 << 19, 1 << 16


def encode_record(term: str, postings: list[tuple[int, int]]) -> bytes:
    raw = term.encode()
    flat = [x for p in postings for x in p]
    return struct.pack("<I", len(raw)) + raw + struct.pack(f"<I{len(flat)}I", len(postings), *flat) + b"\n"


def _records(raw) -> Iterator[tuple[bytes, int, int]]:
    """(term, df, place of its postings) of each record. ValueError where a record's end is wrong or missing."""
    at, u32 = 0, struct.Struct("<I").unpack_from
    while at < len(raw):
        try:
            (n,) = u32(raw, at)
            (df,) = u32(raw, at + 4 + n)
        except struct.error:
            raise ValueError(f"record at byte {at} is cut short") from None
        start = at + 8 + n
        end = start + 8 * df
        if end > len(raw):
            raise ValueError(f"record at byte {at} is cut short")
        if raw[end : end + 1] != b"\n":
            raise ValueError(f"no record end at byte {end}")
        yield bytes(raw[at + 4 : at + 4 + n]), df, start
        at = end + 1


def decode_records(raw: bytes) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """ValueError where a record's end is wrong or missing."""
    for term, df, start in _records(raw):
        flat = struct.unpack_from(f"<{2 * df}I", raw, start)
        yield term.decode(), list(zip(flat[::2], flat[1::2], strict=True))


def _encoded(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """(shard, term, record) of (shard, term, postings), without a Python object for a posting."""
    lists = b.column("postings")
    ends = lists.offsets.to_numpy()
    u32 = struct.Struct("<I").pack
    lo = 0
    while lo < len(b):
        hi = max(int(np.searchsorted(ends, ends[lo] + _POSTINGS, "right")) - 1, lo + 1)
        pairs = lists.slice(lo, hi - lo).flatten()
        pairs = np.stack([pairs.field(i).to_numpy() for i in range(2)], 1)
        if pairs.size and not 0 <= pairs.min() <= pairs.max() < 1 << 32:
            raise ValueError("a posting doesn't fit 32 bits")
        flat = pairs.astype("<u4").tobytes()
        at = ((ends[lo : hi + 1] - ends[lo]) * 8).tolist()
        terms = [t.encode() for t in b.column("term").slice(lo, hi - lo).to_pylist()]
        records = [b"".join((u32(len(t)), t, u32((e - s) >> 3), flat[s:e], b"\n")) for t, s, e in zip(terms, at, at[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([b.column("shard").slice(lo, hi - lo), b.column("term").slice(lo, hi - lo), pa.array(records, pa.binary())], ["shard", "term", "record"])
        lo = hi


def _decoded(shard: int, raw) -> Iterator[pa.RecordBatch]:
    """(shard, term, df, postings) of the records of a file, a block at a time."""

    def block():
        ends = np.concatenate(([0], np.cumsum(dfs))).astype(np.int32)
        flat = np.frombuffer(b"".join(parts), "<u4").astype(np.int64).reshape(-1, 2)
        pairs = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, i])) for i in range(2)], ["doc_id", "tf"])
        return pa.RecordBatch.from_arrays([pa.array([shard] * len(terms), pa.int32()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(dfs, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pairs)], ["shard", "term", "df", "postings"])

    terms, dfs, parts, n = [], [], [], 0
    for term, df, start in _records(raw):
        terms.append(term)
        dfs.append(df)
        parts.append(raw[start : start + 8 * df])
        n += df
        if n >= _POSTINGS or len(terms) >= _RECORDS:
            yield block()
            terms, dfs, parts, n = [], [], [], 0
    if terms:
        yield block()


def encode(index: DataFrame) -> DataFrame:
    """(shard, term, record binary) of (shard, term, postings)."""

    def run(batches):
        for b in batches:
            yield from _encoded(b)

    return index.select("shard", "term", "postings").mapInArrow(run, "shard int, term string, record binary")


def decode(files: DataFrame) -> DataFrame:
    """(shard, term, df, postings) of (shard, content binary)."""

    def run(batches):
        for b in batches:
            for s, c in zip(b.column("shard"), b.column("content"), strict=True):
                yield from _decoded(s.as_py(), memoryview(c.as_buffer()))

    return files.select("shard", "content").mapInArrow(run, "shard int, term string, df long, postings array<struct<doc_id:long,tf:long>>")


def read(spark, path: str) -> DataFrame:
    """An index of binary files named output-r<shard>-p<file id>."""
    from termloom.functions import values as V

    files = spark.read.format("binaryFile").load(path)
    name = V.parsed_file_name(F.element_at(F.split("path", "/"), -1))
    return decode(files.select(name["shard"].cast("int").alias("shard"), "content"))


def write(index: DataFrame, folder: str, file_id: int = 0, file_bytes: int = FILE_BYTES) -> None:
    """Files of term ranges of a shard, numbered from ``file_id`` on, moved into place when whole.

    ``folder`` is the address of one that all executors reach. A file is closed once it passes ``file_bytes``.
    A task that is run again overwrites its own files.
    """
    from pyarrow import fs
    from pyspark import TaskContext

    def run(batches):
        files, root = fs.FileSystem.from_uri(folder)
        out, now, name, made = None, None, None, 0

        def close():
            out.close()
            files.move(name + ".part", name)

        for b in batches:
            shards, records = b.column("shard").to_pylist(), b.column("record")
            for s, r in zip(shards, records, strict=True):
                if out and (s != now or out.tell() >= file_bytes):
                    close()
                    out = None
                if not out:
                    now, name = s, f"{root}/output-r{s:06d}-p{file_id + (TaskContext.get().partitionId() << 20) + made:018d}"
                    out, made = files.open_output_stream(name + ".part", buffer_size=1 << 20), made + 1
                out.write(r.as_buffer())
        if out:
            close()
        yield pa.RecordBatch.from_pydict({"ok": [True]})

    files, root = fs.FileSystem.from_uri(folder)
    files.create_dir(root)
    encode(index).repartitionByRange("shard", "term").sortWithinPartitions("shard", "term").mapInArrow(run, "ok boolean").count()
