"""Near-duplicate documents by MinHash bands, odd sketches and full-set confirmation (operator 9).

Plan. One Arrow pass turns each text into a digest of its shingle set, band keys of 32 bands of 5
MinHash values, and two odd sketches: 512 bits from the 160 MinHash values, and 1024 bits from the
whole set. Documents with equal sets collapse to a class (aggregation, so a group of copies of any
size is one row). Class representatives meet in bands. Links only matter between groups that are
not yet connected, so a bucket is never expanded into all its pairs:
1. every member of a bucket is paired with the bucket's most central member (the one whose
   buckets hold most documents);
2. buckets that still hold several components are compared in blocks, those outside the largest
   component against all, by the sketches; of the pairs that pass a spanning forest is kept;
3. pairs across components that pass the sketches are all taken.
After each step the pairs are confirmed on the full shingle sets and the components renewed.

The whole-set sketch loses nothing: its differing bits never outnumber the symmetric difference of
the sets, which two linked sets bound. The sample sketch, which tells large sets apart, refuses at an
estimate over 7 standard deviations below the threshold. A link at similarity 0.8 shares no band
with probability 3e-6.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm import common as C

BANDS, ROWS, SKETCH_WORDS, ODD_WORDS = 32, 5, 8, 16
BLOCK_ROWS, LARGE = 512, 64
_rng = np.random.default_rng(9)
_MUL = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_XOR = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_SALT = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
DIGEST = "doc_id long, n long, h1 long, h2 long, bands array<long>, sketch array<long>, odd array<long>"


def _minhash(h: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """documents x (BANDS * ROWS) minima; every document has at least one hash."""
    x = (h >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(offs) - 1, len(_MUL)), np.uint32)
    for a, b in C.pieces(x, offs, 1 << 16):  # stays in the cache
        y, at = x[offs[a] : offs[b]], offs[a:b] - offs[a]
        for i in range(len(_MUL)):
            z = y ^ _XOR[i]
            z *= _MUL[i]
            out[a:b, i] = np.minimum.reduceat(z, at)
    return out


def digest_batch(ids: np.ndarray, data: np.ndarray, offs: np.ndarray, k: int) -> dict[str, np.ndarray]:
    """Columns of DIGEST for the documents that have a word; flat arrays for bands and sketch."""
    h, at = C.shingles(data, offs, k)
    n = np.diff(at)
    full = np.flatnonzero(n)
    at = np.concatenate((at[:-1][full], at[-1:]))
    if not len(full):
        z = np.zeros(0, np.uint64)
        return {"ids": ids[full], "n": n[full], "h1": z, "h2": z, "bands": z.reshape(0, BANDS), "sketch": z.reshape(0, SKETCH_WORDS), "odd": z.reshape(0, ODD_WORDS)}
    h1 = np.add.reduceat(C.mix(h ^ np.uint64(0x1234567)), at[:-1])
    h2 = np.add.reduceat(C.mix(h + np.uint64(0xABCDEF987)), at[:-1])
    m = _minhash(h, at).astype(np.uint64)
    bands = np.zeros((len(full), BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
    r = m.reshape(len(full), BANDS, ROWS)
    for j in range(ROWS):
        bands = C.mix(bands * np.uint64(0x9E3779B97F4A7C15) + r[:, :, j])
    bit = C.mix((m << np.uint64(8)) ^ _SALT) & np.uint64(64 * SKETCH_WORDS - 1)
    sketch = _parity(np.arange(len(full))[:, None], bit, len(full), SKETCH_WORDS)
    bit = C.mix(h ^ np.uint64(0x5EED)) & np.uint64(64 * ODD_WORDS - 1)
    odd = _parity(np.repeat(np.arange(len(full)), n[full]), bit, len(full), ODD_WORDS)
    return {"ids": ids[full], "n": n[full], "h1": h1, "h2": h2, "bands": bands, "sketch": sketch, "odd": odd}


def _parity(row: np.ndarray, bit: np.ndarray, rows: int, words: int) -> np.ndarray:
    """rows x words bitmaps: each bit's parity of the number of times it is named."""
    flat = (row * (64 * words) + bit.astype(np.int64)).ravel()
    odd = (np.bincount(flat, minlength=rows * 64 * words) & 1).astype(np.uint8).reshape(rows, -1)
    return np.packbits(odd, axis=1).view(np.uint64)


def _list(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(np.ascontiguousarray(x).view(np.int64).ravel()))


def digests(docs: DataFrame, k: int) -> DataFrame:
    """DIGEST of every document that has a word, from (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            data, offs = C.column_bytes(t.column(1))
            ids = t.column(0).to_numpy(zero_copy_only=False)
            for a, b in C.pieces(data, offs):
                d = digest_batch(ids[a:b], data[offs[a] : offs[b]], offs[a : b + 1] - offs[a], k)
                if len(d["ids"]):
                    yield pa.RecordBatch.from_arrays([pa.array(d["ids"].astype(np.int64)), pa.array(d["n"].astype(np.int64)), pa.array(d["h1"].view(np.int64)), pa.array(d["h2"].view(np.int64)), _list(d["bands"]), _list(d["sketch"]), _list(d["odd"])], ["doc_id", "n", "h1", "h2", "bands", "sketch", "odd"])

    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text").mapInArrow(C.trimmed(run), DIGEST)


def shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    """(id, set): the ascending distinct shingle hashes of each document, packed as binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            data, offs = C.column_bytes(t.column(1))
            for a, b in C.pieces(data, offs):
                h, at = C.shingles(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a], k)
                packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer((at * 8).tobytes()), pa.py_buffer(h.tobytes())])
                yield pa.RecordBatch.from_arrays([t.column(0).slice(a, b - a), packed.cast(pa.binary())], ["id", "set"])

    return docs.select(F.col("doc_id").alias("id"), "text").mapInArrow(C.trimmed(run), "id long, set binary")


def confirmed(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union on their full shingle sets."""
    wanted = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    sets = C.keep(shingle_sets(docs.select("doc_id", "text").where("text is not null").join(wanted, "doc_id", "left_semi"), k))
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            x, xo = C.column_bytes(t.column(2))
            y, yo = C.column_bytes(t.column(3))
            x, y = x.view(np.uint64), y.view(np.uint64)
            ok = np.zeros(len(t), bool)
            for i in range(len(t)):
                p, q = x[xo[i] // 8 : xo[i + 1] // 8], y[yo[i] // 8 : yo[i + 1] // 8]
                z = np.sort(np.concatenate((p, q)), kind="stable")
                same = int(np.count_nonzero(z[1:] == z[:-1]))
                ok[i] = same > 0 and 100 * same >= percent * (len(p) + len(q) - same)
            yield t.select([0, 1]).filter(pa.array(ok))

    return both.select("a", "b", "x", "y").mapInArrow(C.trimmed(run), "a long, b long")


def _most_apart(percent: int) -> int:
    """Differing sample-sketch bits beyond which a pair is refused.

    Symmetric difference d of two sample sets folded into N bits: E[differing bits] =
    N/2 (1 - (1 - 2/N)^d), and d = 2 K (1 - J) for K samples.
    """
    bits = 64 * SKETCH_WORDS
    d = 2 * BANDS * ROWS * (1 - max(0.0, percent / 100 - 0.25))
    return int(bits / 2 * (1 - (1 - 2 / bits) ** d))


def _close(percent: int) -> str:
    """Whether sizes and sketches leave the pair x, y possible. Sets with J >= p/100 have a symmetric
    difference of at most (|x| + |y|) (100 - p) / (100 + p)."""
    differ = "aggregate(zip_with(x.{0}, y.{0}, (p, q) -> bit_count(p ^ q)), 0, (s, v) -> s + v)"
    return f"100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n) and {100 + percent} * {differ.format('odd')} <= {100 - percent} * (x.n + y.n) and {differ.format('sketch')} <= {_most_apart(percent)}"


def forest(ids: np.ndarray, comp: np.ndarray, n: np.ndarray, odd: np.ndarray, sketch: np.ndarray, minor: np.ndarray, own: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs (a, b), a > b, that pass the sketches and would join the components of a block.

    Rows marked ``minor`` are compared with the rows marked ``own``; closest pairs come first.
    """
    x, y = np.flatnonzero(minor), np.flatnonzero(own)
    parent = {c: c for c in comp.tolist()}

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    out = []
    for s in range(0, len(x), 256):
        p = x[s : s + 256]
        apart = np.bitwise_count(odd[p][:, None, :] ^ odd[y][None, :, :]).sum(axis=2, dtype=np.int64)
        total = n[p][:, None] + n[y][None, :]
        ok = (comp[p][:, None] != comp[y][None, :]) & ((100 + percent) * apart <= (100 - percent) * total)
        ok &= 100 * np.minimum(n[p][:, None], n[y][None, :]) >= percent * np.maximum(n[p][:, None], n[y][None, :])
        i, j = np.nonzero(ok)
        for k in np.argsort(apart[i, j] / total[i, j], kind="stable"):
            u, v = p[i[k]], y[j[k]]
            a, b = root(int(comp[u])), root(int(comp[v]))
            if a != b and np.bitwise_count(sketch[u] ^ sketch[v]).sum() <= _most_apart(percent):
                parent[max(a, b)] = min(a, b)
                out.append((int(max(ids[u], ids[v])), int(min(ids[u], ids[v]))))
    return out


def _forests(percent: int):
    def run(t: pa.Table) -> pa.Table:
        col = {c: t.column(c).to_numpy() for c in ("id", "comp", "n", "minor", "own")}
        odd, sketch = (np.ascontiguousarray(t.column(c).combine_chunks().flatten().to_numpy()).view(np.uint64).reshape(t.num_rows, -1) for c in ("odd", "sketch"))
        got = forest(col["id"], col["comp"], col["n"], odd, sketch, col["minor"].astype(bool), col["own"].astype(bool), percent)
        return pa.table({"a": pa.array([a for a, _ in got], pa.int64()), "b": pa.array([b for _, b in got], pa.int64())})

    return run


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document of (doc_id, text).

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lowered; a document's set is its distinct k-word
    shingles, or its whole word sequence if shorter. Documents whose sets have a Jaccard similarity
    of at least ``percent`` hundredths are linked; component_id is the smallest doc_id of the
    connected group and ``kept`` marks that document. Null, empty or blank text: n_shingles 0,
    linked with nothing. Equal texts always share a component. Rows that repeat a doc_id repeat in
    the result; if their texts differ, with the largest set size and the least component of them. Null doc_id: returned alone, with component_id null and kept true. Other columns,
    whatever their names, are ignored; an empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    place = C.mark()
    t = C.keep(digests(docs, k))
    classes = C.keep(t.groupBy("h1", "h2").agg(F.min_by(F.struct("doc_id", "n", "bands", "sketch", "odd"), "doc_id").alias("r")).select("h1", "h2", "r.*"))
    keys = classes.select(F.col("doc_id").alias("id"), F.explode("bands").alias("key"))
    node = classes.select(F.col("doc_id").alias("id"), "n", "sketch", "odd")
    # what is joined by bucket is written first: Spark can split a hot bucket only in a plain join
    sizes = C.keep(keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"))
    met = C.keep(keys.join(sizes, "key").select("key", "id", "size"))
    rank = met.groupBy("id").agg(F.sum("size").alias("rank"))
    centre = C.keep(met.join(rank, "id").groupBy("key").agg(F.max_by("id", F.struct("rank", -F.col("id"))).alias("b")))
    star = met.join(centre, "key").where("id <> b").select(F.greatest("id", "b").alias("a"), F.least("id", "b").alias("b")).distinct()
    star = star.join(node.alias("x"), F.col("a") == F.col("x.id")).join(node.alias("y"), F.col("b") == F.col("y.id")).where(F.expr(_close(percent))).select("a", "b")
    tried = C.keep(star)
    links = C.keep(confirmed(tried, docs, k, percent))
    for step in ("forest", "rest"):
        label = C.keep(C.components(links))
        named = met.where("size > 2").join(label, "id", "left").select("key", "id", "size", F.coalesce("component", "id").alias("comp"))
        # of every bucket the number of rows in each component, and the largest component
        parts = named.groupBy("key", "comp").agg(F.count("*").alias("c"))
        mixed = C.keep(parts.groupBy("key").agg(F.max_by("comp", F.struct("c", "comp")).alias("major"), F.count("*").alias("kinds")).where("kinds > 1").drop("kinds"))
        open_ = C.keep(named.join(mixed, "key").withColumn("minor", F.col("comp") != F.col("major")).select("key", "id", "size", "comp", "minor"))
        if step == "forest":
            blocks = F.ceil(F.col("size") / BLOCK_ROWS).cast("int")
            own = F.pmod(F.xxhash64("id"), blocks).cast("int")
            large = open_.where(f"size > {LARGE}").withColumn("_own", own)
            every = large.where("minor").withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumn("own", F.col("_own") == F.col("block"))
            dealt = every.select("key", "block", "id", "comp", "minor", "own").union(large.where("not minor").select("key", "_own", "id", "comp", "minor", F.lit(True)))
            found = dealt.join(node, "id").groupBy("key", "block").applyInArrow(_forests(percent), "a long, b long").distinct()
        else:
            found = C.near_in_buckets(open_.join(node, "id").select("key", "id", "comp", F.col("minor").alias("asks"), "n", "sketch", "odd"), "x.comp <> y.comp and " + _close(percent), BLOCK_ROWS)
            found = found.select(F.col("b").alias("a"), F.col("a").alias("b"))
        found = C.keep(found.join(tried, ["a", "b"], "left_anti"))
        links = C.keep(links.union(confirmed(found, docs, k, percent)))
        tried = tried.union(found)
    label = C.keep(C.components(links))
    C.settle(place, t, classes, label)
    named = classes.select("h1", "h2", "doc_id").join(label.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("h1", "h2", F.coalesce("component", "doc_id").alias("component_id"))
    known = t.select("doc_id", "n", "h1", "h2").distinct().join(named, ["h1", "h2"]).groupBy("doc_id").agg(F.max("n").alias("n"), F.min("component_id").alias("component_id"))
    out = docs.select("doc_id").join(known, "doc_id", "left")
    return out.select("doc_id", F.coalesce("n", F.lit(0)).alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(C.documents(spark, sf_dir), k=2, percent=80)
