"""Best-fit packing of documents into sequences of bounded length (operator 6).

Bulk-synchronous best fit over the whole table, one packing at any size. A round takes the pieces of
one length, longest first, and the gaps, each range-sorted: pieces by (length, doc_id, piece), gaps
by size. Pieces of one length are alike for the match, and so are gaps of one size; both are runs
(length, count), so that a round's successor sweep, which gives the runs the smallest gaps that hold
them, updates the gaps and repeats, handles at most ``length`` runs of pieces however many rows they
stand for. Pieces that want gaps of one size take them by rank. The sweep over the rows is
distributed: each range partition walks its sorted pieces against the sorted runs of gaps, finds a
piece's run by binary search on its rank, and its sequence and offset by its rank within the run.

Through the driver go one count for each length (at most ``length``) and one for each partition; the
runs of gaps that every task gets are a few for each length, whatever the number of documents.
"""

from __future__ import annotations

import bisect
import json
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm import bpe
from termloom.llm import common as C

LENGTH, END = 4096, 1
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"

#: The pre-tokenizer's pattern, and the same for texts of ASCII alone.
_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_SPLIT_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+", re.A)


def old_code_points() -> str:
    """Inside of a character class: the code points below U+10000 that Unicode 3.2 assigns."""
    old = unicodedata.ucd_3_2_0.category
    known = np.array([old(chr(c)) not in ("Cn", "Cs", "Co") for c in range(0x10000)])
    edges = np.flatnonzero(np.diff(np.concatenate(([0], known.astype(np.int8), [0]))))
    return "".join(f"\\u{a:04x}-\\u{b - 1:04x}" for a, b in edges.reshape(-1, 2).tolist())


class Ids:
    """Ids of the word-splitting tokenizer file as little-endian unsigned 32-bit bytes.

    Each distinct word is encoded once a worker. Texts that hold an added token's string, a sigma
    (whose lower case Python makes depend on what is around it), one of the control characters that
    Python and the tokenizer class differently, or a code point that is not in the first plane of
    Unicode 3.2 (later ones are in the tables of one and not of the other) go through the library
    whole.
    """

    def __init__(self, path: str):
        self.tok = bpe.Tokenizer.from_file(str(path))
        self.tok.no_truncation()
        self.tok.no_padding()
        added = [re.escape(t.content) for t in self.tok.get_added_tokens_decoder().values()]
        self.whole = re.compile("|".join(["[\x1c-\x1f\u03a3]", f"[^{old_code_points()}]", *added]))
        kind = json.loads(self.tok.to_str())
        patterns = [x["pattern"].get("Regex") for x in (kind["pre_tokenizer"] or {}).get("pretokenizers", []) if x["type"] == "Split"]
        self.known = patterns == [_SPLIT.pattern] and [x["type"] for x in (kind["normalizer"] or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        self.four = [i.to_bytes(4, "little") for i in range(self.tok.get_vocab_size(with_added_tokens=True))]
        self.memo = bpe.Memo(self._piece)

    def _piece(self, piece: str) -> bytes:
        mapped = piece.encode().decode("latin-1").translate(bpe._ALPHABET)
        return b"".join([self.four[t.id] for t in self.tok.model.tokenize(mapped)])

    def __call__(self, text: str) -> bytes:
        if not self.known or self.whole.search(text):
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if text.isascii():
            return b"".join(list(map(self.memo.__getitem__, _SPLIT_ASCII.findall(text.lower()))))
        return b"".join(list(map(self.memo.__getitem__, _SPLIT.findall(unicodedata.normalize("NFC", text).lower()))))


_loaded: dict[str, Ids] = {}


def pieces(docs: DataFrame, path: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each row's ids, cut only where longer than ``length``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _loaded:
            _loaded[path] = Ids(path)
        ids, close = _loaded[path], np.array([end], "<u4").tobytes()
        for t in batches:
            rows = []
            for d, x in zip(t.column(0).to_pylist(), t.column(1), strict=True):
                raw = memoryview(ids(x.as_py() or "") + close)
                for i, s in enumerate(range(0, len(raw) // 4, length)):
                    part = raw[4 * s : 4 * (s + length)]
                    rows.append((d, i, s, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()], strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).mapInArrow(C.trimmed(run), PIECE)


def gap_runs(counts: np.ndarray, length: int) -> np.ndarray:
    """Where the pieces go: rows (first place, sequence, pieces a sequence, offset, size) of best fit.

    counts[s] is the number of pieces of size s. Pieces stand in one order, longest first. The piece
    at place p of the row's first place f is in sequence + (p - f) // pieces, at offset + size *
    ((p - f) % pieces). A gap run is (sequence, number of sequences, gap); gaps of one size stand in
    one stack. For each size the smallest gap that holds it is filled as often as it can be.
    """
    out: list[tuple[int, int, int, int, int]] = []
    stacks: list[list[tuple[int, int]]] = [[] for _ in range(length + 1)]
    sizes: list[int] = []  # those whose stack isn't empty, ascending
    place = opened = 0

    def put(sequence: int, number: int, gap: int) -> None:
        if gap and number:
            if not stacks[gap]:
                bisect.insort(sizes, gap)
            stacks[gap].append((sequence, number))

    for size in range(length, 0, -1):
        left = int(counts[size])
        while left:
            at = bisect.bisect_left(sizes, size)
            if at == len(sizes):  # nothing holds it: as many sequences open as the rest needs
                put(opened, -(-left // (length // size)), length)
                opened += -(-left // (length // size))
                continue
            gap = sizes[at]
            sequence, number = stacks[gap].pop()
            if not stacks[gap]:
                del sizes[at]
            each = gap // size
            full = min(number, left // each)
            if full:
                out.append((place, sequence, each, length - gap, size))
                put(sequence, full, gap - each * size)
            else:  # the last of a size, fewer than the gap holds
                each, full = left, 1
                out.append((place, sequence, each, length - gap, size))
                put(sequence, 1, gap - each * size)
            put(sequence + full, number - full, gap)
            place, left = place + full * each, left - full * each
    return np.array(out, np.int64).reshape(-1, 5)


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the range partition's number and the row's place in it."""
    part, n = TaskContext.get().partitionId(), 0
    for t in batches:
        yield pa.RecordBatch.from_arrays([*t.columns[:5], pa.array(np.full(len(t), part, np.int32)), pa.array(np.arange(n, n + len(t)))], [*t.schema.names[:5], "_p", "_i"])
        n += len(t)


def _swept(first: dict[int, int], runs: np.ndarray):
    """The rows of range partitions, whose first places are given, with sequence_id and offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            parts, at = np.unique(t.column(5).to_numpy(), return_inverse=True)
            place = np.array([first[p] for p in parts.tolist()], np.int64)[at] + t.column(6).to_numpy()
            f, sequence, each, offset, size = runs[np.searchsorted(runs[:, 0], place, "right") - 1].T
            k = place - f
            yield pa.RecordBatch.from_arrays([*t.columns[:5], pa.array(sequence + k // each), pa.array(offset + k % each * size)], [*t.schema.names[:5], "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, path: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of (doc_id, text).

    A document is its ids and ``end``. Null or empty text: the end id alone. doc_id may be null or
    repeat; each row is a document. Documents of up to ``length`` ids stay whole. Offsets of a
    sequence start at 0 and leave no gap. Ties between pieces of a length go by doc_id and piece;
    rows alike in those take what is left in any order. Other columns, whatever their names, are
    ignored; an empty table gives no rows. A text of any length is one row's ids in memory.
    """
    # the row's place in its file spreads rows that repeat a doc_id over the ranges
    place = C.mark()
    p = C.keep(pieces(docs, path, length, end)).withColumn("_row", F.monotonically_increasing_id())
    order = [F.col("length").desc(), "doc_id", "piece", "_row"]
    ranged = C.keep(p.repartitionByRange(*order).sortWithinPartitions(*order).drop("_row").mapInArrow(_in_order, PIECE + ", _p int, _i long"))
    C.settle(place, ranged)
    counts = np.zeros(length + 1, np.int64)
    for size, n in C.collect(ranged.groupBy("length").agg(F.count("*"))):
        counts[size] = n
    first, at = {}, 0
    for part, n in sorted(C.collect(ranged.groupBy("_p").agg(F.count("*")))):
        first[part], at = at, at + n
    return ranged.mapInArrow(_swept(first, gap_runs(counts, length)), PIECE + ", sequence_id long, offset long")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(C.documents(spark, sf_dir), bpe.default_path("word_bpe_49k.json"))
