"""What the operators of this subpackage share.

Texts are handled as Arrow buffers: a batch is one byte array plus document offsets, and words,
shingles and windows are hashed with whole-array numpy operations, never word by word in Python.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
BLOCK = 1 << 20  # bytes hashed at once
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


#: A random 64-bit value for each byte, so that the polynomial hash doesn't see the bytes themselves.
BYTE_VALUE = mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of the base and of its inverse modulo 2**64."""
    have = _powers.get(0)
    if have is None or len(have[0]) < n:
        n = max(n, BLOCK + 1)
        out = []
        for b in (_BASE, _INV):
            x = np.full(n, U64(b))
            x[0] = 1
            out.append(np.multiply.accumulate(x))
        have = _powers[0] = (out[0], out[1])
    return have


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """P with len(data) + 1 entries; bytes s..e hash to (P[e] - P[s]) * inverse_power[s]."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, U64)
    np.cumsum(BYTE_VALUE[data] * up[: len(data)], out=out[1:])
    return out


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    kind = pa.large_binary()
    if col.type != kind:
        col = (col.cast(pa.large_string()) if pa.types.is_string(col.type) else col).cast(kind)
    if col.null_count:
        col = col.fill_null(b"")
    offs = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8)
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document number) of every word ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case."""
    n = len(data)
    if not n:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    brk = np.zeros(n + 1, bool)
    brk[offs] = True
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1] | brk[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | brk[1:n]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    h = np.empty(len(s), U64)
    a = 0
    while a < len(s):  # blocks of whole words
        lo = s[a]
        b = max(int(np.searchsorted(e, lo + BLOCK, "right")), a + 1)
        p = prefix_hash(_LOWER[data[lo : e[b - 1]]])
        down = powers(e[b - 1] - lo + 1)[1]
        h[a:b] = (p[e[a:b] - lo] - p[s[a:b] - lo]) * down[s[a:b] - lo]
        a = b
    doc = np.searchsorted(offs, s, "right") - 1
    return mix(h ^ (e - s).astype(U64)), doc


def shingles(data: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct hashes, offsets by document) of the k-word shingles of each document.

    A document of fewer than k words has its whole word sequence as its one shingle, one without
    words has none. The hashes of a document are ascending.
    """
    h, doc = words(data, offs)
    docs = len(offs) - 1
    bound = np.searchsorted(doc, np.arange(docs + 1))
    acc = np.zeros(max(len(h) - k + 1, 0), U64)
    for j in range(k):
        acc = mix(acc * U64(0xA24BAED4963EE407) + h[j : len(h) - k + 1 + j] + U64(j + 1))
    parts, sizes = [], np.zeros(docs + 1, np.int64)
    for d in range(docs):
        lo, hi = bound[d], bound[d + 1]
        if hi - lo >= k:
            x = np.sort(acc[lo : hi - k + 1])
            if len(x) > 1:
                x = x[np.concatenate(([True], x[1:] != x[:-1]))]
        elif hi > lo:
            y = np.full(1, U64(hi - lo))
            for v in h[lo:hi]:
                y = mix(y * U64(0x9FB21C651E98DF25) + v)
            x = y
        else:
            continue
        parts.append(x)
        sizes[d + 1] = len(x)
    return np.concatenate(parts) if parts else np.zeros(0, U64), np.cumsum(sizes)


def distinct(x: np.ndarray) -> np.ndarray:
    """Ascending distinct values, by sorting: numpy's own way without further results is a hash table."""
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def pieces(data: np.ndarray, offs: np.ndarray, most: int = 4 * BLOCK):
    """(first document, one past the last) of runs of documents of about ``most`` bytes together."""
    a, n = 0, len(offs) - 1
    while a < n:
        b = max(int(np.searchsorted(offs, offs[a] + most, "right")) - 1, a + 1)
        yield a, b
        a = b


def pack_keys(x: np.ndarray) -> bytes:
    """Ascending keys as differences, byte planes apart: the high planes are nearly all zero."""
    d = np.diff(x, prepend=np.uint64(0))
    return np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application below spark.checkpoint.dir, on any file system that Spark writes to.

    Where that is unset, a local session gets a temporary folder and a cluster an error.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not d:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        d = "file://" + tempfile.mkdtemp(prefix="termloom-")
        spark.conf.set("spark.checkpoint.dir", d)
    return f"{d.rstrip('/')}/termloom-{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone
            return


def mark() -> int:
    """The place in the list of kept tables, for ``since`` and ``settle``."""
    return len(_written)


def since(place: int) -> list[tuple[SparkSession, str]]:
    return _written[place:]


def discard(tables: list[tuple[SparkSession, str]]) -> None:
    """Deletes kept tables that no frame yet to be run reads."""
    for spark, path in tables:
        _delete(spark, path)
    gone = {path for _, path in tables}
    _written[:] = [x for x in _written if x[1] not in gone]


def settle(place: int, *kept: DataFrame) -> None:
    """Of the tables kept since ``place`` only those of the frames ``kept`` stay."""
    stay = {x.kept_in for x in kept}
    discard([x for x in since(place) if x[1] not in stay])


#: Shuffle files of a query go when it ends; texts come to Python a few MB at a time.
_ONCE = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


@contextlib.contextmanager
def once(spark: SparkSession):
    """Settings for queries that nothing runs again."""
    before = {k: spark.conf.get(k) for k in _ONCE}
    try:
        for k, v in _ONCE.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def trimmed(run):
    """``run`` over batches; at the end of a task what it has freed goes back to the system.

    Python workers live on from stage to stage, and their heaps would add to the next ones'.
    """

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # not every C library has it
            ctypes.CDLL(None).malloc_trim(0)

    return inner


def keep(df: DataFrame) -> DataFrame:
    """The rows written once to the shared checkpoint folder and read back: cuts the lineage.

    Unlike ``checkpoint()`` this runs the plan a single time, and its shuffle files go at once. The
    table is deleted by ``discard`` or ``settle``, at the latest when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    with once(spark):
        df.write.parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_in = path
    return out


def collect(df: DataFrame) -> list:
    """Rows of a result of bounded size, whose shuffle files go at once."""
    with once(df.sparkSession):
        return df.select("*").collect()  # a new query, which the setting holds for


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every node in links(a, b): the smallest id that it reaches.

    Alternating large-star and small-star passes; each pass is a min-aggregation and a join back,
    so a node with very many neighbours is pre-aggregated and its join can be split. Every pass is
    written to the shared folder. Ends when a pass changes nothing. Self links and repeats are
    allowed; null ends are ignored; no links give no rows.
    """
    e = keep(links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    place, state = mark() - 1, None
    while True:
        both = e.union(e.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.union(low.where("a > m").select("a", F.col("m").alias("b"))).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = keep(small.union(low.select("a", F.col("m").alias("b"))).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        settle(place, e)
        now = collect(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))))[0]
        if now == state or now[0] == 0:
            break
        state = tuple(now)
    low = e.groupBy("a").agg(F.min("b").alias("component"))
    roots = e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct().join(low.select(F.col("a").alias("id")), "id", "left_anti")
    return low.select(F.col("a").alias("id"), "component").union(roots)


def near_in_buckets(rows: DataFrame, condition: str, block: int = 512) -> DataFrame:
    """Distinct (a, b), a < b, of rows x and y of (key, id, asks, ...) in one bucket for which
    ``condition``, which must not depend on their order, holds and one of which asks.

    Buckets are cut into blocks of about ``block`` rows. A row lies in its own block, one that asks
    is sent to all blocks of its bucket, so a large bucket is spread over many tasks; the condition
    is part of the join, so pairs that fail it are never made. Bucket sizes are written first: the
    join that deals the rows out then reads plain shuffles, and Spark can split a hot bucket.
    """
    size = keep(rows.groupBy("key").agg(F.count("*").alias("_n")).where("_n > 1").select("key", F.ceil(F.col("_n") / block).cast("int").alias("_blocks")))
    own = rows.join(size, "key").withColumn("_own", F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int"))
    lie = own.withColumn("_b", F.col("_own")).drop("_own", "_blocks")
    ask = own.where("asks").withColumn("_b", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).drop("_own", "_blocks")
    met = lie.alias("x").join(ask.alias("y"), F.expr(f"x.key = y.key and x._b = y._b and x.id <> y.id and (not x.asks or x.id < y.id) and {condition}"))
    return met.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()
