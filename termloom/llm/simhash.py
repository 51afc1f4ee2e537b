"""SimHash document fingerprints and their Hamming neighbours (operator 10).

The terms are the pairs of neighbouring words, weighted by their number in the text; each term's
128-bit hash votes on every bit. Neighbours within a radius are found through block tables: the
fingerprint is cut into one block more than the radius, each block is the key of its own table
(the permutation that brings it first), and fingerprints that agree in a block are compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm import common as C

BITS = 128
_PART = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]


def fingerprints(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """documents x 2 words of 64 bits; all bits 0 for a text without words."""
    h, doc = C.words(data, offs)
    docs = len(offs) - 1
    out = np.zeros((docs, BITS // 64), np.uint64)
    if not len(h):
        return out
    term = C.mix(h[:-1] * np.uint64(0xA24BAED4963EE407) + h[1:])
    inside = doc[1:] == doc[:-1]
    first = np.concatenate(([True], ~inside))
    alone = first & np.concatenate((~inside, [True]))  # the one word of its text
    term = np.concatenate((term[inside], C.mix(h[alone])))
    owner = np.concatenate((doc[1:][inside], doc[alone]))
    if alone.any():
        by = np.argsort(owner, kind="stable")
        term, owner = term[by], owner[by]
    votes = np.zeros((docs, BITS), np.int64)
    total = np.bincount(owner, minlength=docs)
    step = 1 << 15
    for a in range(0, len(term), step):
        x, o = term[a : a + step], owner[a : a + step]
        words = np.stack([C.mix(x ^ p) for p in _PART], axis=1)
        bits = np.unpackbits(words.view(np.uint8), axis=1)
        at = np.flatnonzero(np.concatenate(([True], o[1:] != o[:-1])))
        ends = np.concatenate((at[1:], [len(o)]))
        for s, e in zip(at, ends, strict=True):
            votes[o[s]] += bits[s:e].sum(axis=0, dtype=np.int32) if e - s < 255 else _sum(bits[s:e])
    return np.packbits(2 * votes > total[:, None], axis=1).view(np.uint64)


def _sum(bits: np.ndarray) -> np.ndarray:
    """Column sums of a 0/1 matrix: bytes first, 255 rows at a time, then integers."""
    n = len(bits) // 255 * 255
    low = np.add.reduce(bits[:n].reshape(-1, 255, bits.shape[1]), axis=1, dtype=np.uint8)
    return low.sum(axis=0, dtype=np.int64) + bits[n:].sum(axis=0, dtype=np.int64)


def _prints(texts: pa.Array) -> np.ndarray:
    """Fingerprints of a column, a few MB of text at a time, as signed words."""
    data, offs = C.column_bytes(texts)
    parts = [fingerprints(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]) for a, b in C.pieces(data, offs)]
    return (np.concatenate(parts) if parts else np.zeros((0, BITS // 64), np.uint64)).view(np.int64)


def hexed(name: str):
    return F.lower(F.concat(*(F.lpad(F.hex(F.col(f"{name}_{i}")), 16, "0") for i in range(2))))


def likeness(a: str, b: str):
    """Share of equal bits."""
    return 1 - (F.bit_count(F.col(f"{a}_0").bitwiseXOR(F.col(f"{b}_0"))) + F.bit_count(F.col(f"{a}_1").bitwiseXOR(F.col(f"{b}_1")))) / F.lit(float(BITS))


def neighbours(prints: DataFrame, radius: int = 3) -> DataFrame:
    """Pairs (a, b), a < b, of ids of (id, f_0, f_1) whose fingerprints differ in 1..radius bits.

    Give distinct fingerprints (class representatives); equal ones are not linked here. Exact for
    radius 0..7: with radius + 1 blocks at least one block of such a pair is equal.
    """
    blocks = radius + 1
    if not 0 <= radius <= 7:
        raise ValueError("radius must be 0..7")
    bits = F.concat(*(F.lpad(F.conv(F.hex(f"f_{i}"), 16, 2), 64, "0") for i in range(2)))
    cut = [BITS * i // blocks for i in range(blocks + 1)]
    keys = F.array(*(F.xxhash64(F.lit(i), F.substring("_bits", cut[i] + 1, cut[i + 1] - cut[i])) for i in range(blocks)))
    rows = prints.withColumn("_bits", bits).withColumn("key", F.explode(keys)).select("key", "id", F.lit(True).alias("asks"), "f_0", "f_1")
    return C.near_in_buckets(rows, f"bit_count(x.f_0 ^ y.f_0) + bit_count(x.f_1 ^ y.f_1) between 1 and {radius}", 4096)


#: A run of rows alike in doc_id and text: their number, what they hold, and what follows them.
ROW = "copies long, doc_id long, key long, n long, edited_sha256 string, f_0 long, f_1 long, e_0 long, e_1 long, next_0 long, next_1 long"
EDGE = "p int, copies long, doc_id long, key long, f_0 long, f_1 long, text string, first_0 long, first_1 long, first_text string"
_ROW_TYPES = [pa.int64()] * 4 + [pa.string()] + [pa.int64()] * 6
_EDGE_TYPES = [pa.int32()] + [pa.int64()] * 5 + [pa.string()] + [pa.int64()] * 2 + [pa.string()]


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _edited(runs: list[tuple], following: list[tuple]) -> list[pa.Array]:
    """Columns of ROW for runs (copies, doc_id, key, f_0, f_1, text) whose next are (f_0, f_1, text)."""
    texts = [r[5][: len(r[5]) - len(r[5]) // 4] + x[2][: len(r[5]) // 4] for r, x in zip(runs, following, strict=True)]
    e = _prints(pa.array(texts, pa.large_string()))
    digests = [hashlib.sha256(x.encode()).hexdigest() for x in texts]
    cols = [[r[0] for r in runs], [r[1] for r in runs], [r[2] for r in runs], [len(r[5]) for r in runs], digests, [r[3] for r in runs], [r[4] for r in runs], e[:, 0], e[:, 1], [x[0] for x in following], [x[1] for x in following]]
    return [pa.array(c, k) for c, k in zip(cols, _ROW_TYPES, strict=True)]


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, key, text) of one range partition in order -> ROW of all runs but the last, and
    at the end the partition's EDGE. Held at a time: one batch and one run's text."""
    head, open_ = None, None
    rows, edges = _names(ROW), _names(EDGE)
    kind = pa.struct([pa.field(n, k) for n, k in zip(edges, _EDGE_TYPES, strict=True)])
    for t in batches:
        f = _prints(t.column(2))
        runs = [open_] if open_ else []
        ids, keys = t.column(0).to_pylist(), t.column(1).to_pylist()
        for i, (d, k) in enumerate(zip(ids, keys, strict=True)):
            if runs and runs[-1][2] == k:
                runs[-1] = (runs[-1][0] + 1, *runs[-1][1:])
            else:
                runs.append((1, d, k, int(f[i, 0]), int(f[i, 1]), t.column(2)[i].as_py()))
        if not runs:
            continue
        head = head or runs[0]
        open_ = runs.pop()
        if runs:
            got = _edited(runs, [r[3:] for r in [*runs[1:], open_]])
            yield pa.RecordBatch.from_arrays([*got, pa.nulls(len(runs), kind)], [*rows, "edge"])
    if open_:
        values = (TaskContext.get().partitionId(), *open_, *head[3:])
        edge = pa.StructArray.from_arrays([pa.array([v], k) for v, k in zip(values, _EDGE_TYPES, strict=True)], edges)
        yield pa.RecordBatch.from_arrays([*(pa.nulls(1, k) for k in _ROW_TYPES), edge], [*rows, "edge"])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """ROW of each partition's last run, from its columns and those of the next partition's first."""
    for t in batches:
        x = list(zip(*(c.to_pylist() for c in t.columns), strict=True))
        yield pa.RecordBatch.from_arrays(_edited([r[:6] for r in x], [r[6:] for r in x]), _names(ROW))


def edited_chain(rows: DataFrame) -> DataFrame:
    """ROW of every run of (doc_id, key, text), which go in the order (doc_id, key).

    The last one's next is the first. The texts move once, range-sorted; a sweep of each partition
    edits, digests and fingerprints all runs but the last. Those meet the next partition's first run
    by partition number; only the numbers of the partitions that have rows go through the driver.
    """
    spark = rows.sparkSession
    ordered = rows.select("doc_id", "key", "text").repartitionByRange("doc_id", "key").sortWithinPartitions("doc_id", "key")
    swept = C.keep(ordered.mapInArrow(C.trimmed(_sweep), f"{ROW}, edge struct<{EDGE.replace(' ', ':').replace(',:', ',')}>"))
    edges = swept.where("edge is not null").select("edge.*")
    order = sorted(r[0] for r in C.collect(edges.select("p")))
    after = spark.createDataFrame(list(zip(order, order[1:] + order[:1], strict=True)), "p int, q int")
    first = edges.select(F.col("p").alias("q"), F.col("first_0").alias("next_0"), F.col("first_1").alias("next_1"), F.col("first_text").alias("next_text"))
    pairs = edges.drop("first_0", "first_1", "first_text").join(after, "p").join(first, "q")
    last = pairs.select("copies", "doc_id", "key", "f_0", "f_1", "text", "next_0", "next_1", "next_text").mapInArrow(_meet, ROW)
    return swept.where("edge is null").drop("edge").unionByName(last)


def compare_edited(docs: DataFrame, radius: int = 3) -> DataFrame:
    """Fingerprints of each text of (doc_id, text) and of its edited form, and their likeness.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (32 hex digits), near_edited,
    near_next, and n_near: other distinct fingerprints within ``radius`` bits of the row's.
    The edited text has its last floor(n_chars / 4) code points replaced by the first as many of the
    next document in ascending (doc_id, key), the last one's next being the first. Null text: empty.
    Rows that repeat both doc_id and text are one document and get equal rows; null doc_ids come
    first. Other columns are ignored; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", text).alias("key"), text.alias("text"))
    place = C.mark()
    chain = C.keep(edited_chain(rows))
    C.settle(place, chain)
    classes = C.keep(chain.groupBy("f_0", "f_1").agg(F.min("key").alias("id")))
    links = neighbours(classes, radius)
    n_near = links.union(links.select("b", "a")).groupBy(F.col("a").alias("id")).agg(F.count("*").alias("n_near"))
    near = classes.join(n_near, "id").select("f_0", "f_1", "n_near")
    out = chain.withColumn("_copy", F.explode(F.sequence(F.lit(1), "copies"))).join(near, ["f_0", "f_1"], "left")
    return out.select("doc_id", F.col("n").alias("n_chars"), "edited_sha256", hexed("f").alias("fingerprint"), hexed("e").alias("edited_fingerprint"), likeness("f", "e").alias("near_edited"), likeness("f", "next").alias("near_next"), F.coalesce("n_near", F.lit(0)).alias("n_near"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edited(C.documents(spark, sf_dir))
