"""Cropped or edited copies of images by local descriptors (operator 1).

A media column is a binary column of portable grey or colour maps (P5/P6 files). Corners are found on
several scales, each gets an orientation from the intensity centroid of its patch, and pairwise
intensity tests in the turned patch give a 128-bit descriptor. Descriptors meet in Hamming tables
(equal blocks of bits are join keys, the distance is checked in the join); of a pair of images the
matches must then agree on one similarity transform. Equal files collapse to a class beforehand.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm import common as C

SCALES = (1.0, 1.4, 2.0)
#: The strongest corners of a scale in each tile of SIDE pixels, so their number grows with the area.
CORNERS, SIDE = 16, 96
BITS, RADIUS, TURNS = 128, 9, 32
#: Corners match up to MOST_APART bits; a pair of images is judged if any two of its corners are NEAR.
#: Chance meetings grow with the square of the input: 3 in 1,000 pairs of pictures at 12 bits, 24 at 15.
MOST_APART, NEAR, INLIERS, REACH = 24, 12, 8, 5.0
#: Width of a table's block, at any size of the input. A query also asks for the keys one bit from its
#: own: of eight blocks one has at most one of up to 15 different bits, so corners so near always meet.
BLOCK_BITS = 16

_rng = np.random.default_rng(128)
#: Two points near each other, all over the patch: far pairs would all tell the corner's bright side.
_first = _rng.uniform(-0.68 * RADIUS, 0.68 * RADIUS, (BITS, 2))
_tests = np.concatenate((_first, _first + _rng.normal(0, 3.0, (BITS, 2))), axis=1)
_yy, _xx = np.mgrid[-RADIUS : RADIUS + 1, -RADIUS : RADIUS + 1]
_disc = _yy**2 + _xx**2 <= RADIUS**2


def _turned() -> np.ndarray:
    """TURNS x BITS x 4 integer offsets (y, x, y, x)."""
    out = np.empty((TURNS, BITS, 4), np.int64)
    for t in range(TURNS):
        a = 2 * np.pi * t / TURNS
        c, s = np.cos(a), np.sin(a)
        for k in (0, 2):
            y, x = _tests[:, k], _tests[:, k + 1]
            out[t, :, k], out[t, :, k + 1] = np.rint(s * x + c * y), np.rint(c * x - s * y)
    return out


_TURNED = _turned()


def encode_pgm(image: np.ndarray) -> bytes:
    return b"P5 %d %d 255\n" % (image.shape[1], image.shape[0]) + np.ascontiguousarray(image, np.uint8).tobytes()


def decode_pnm(raw: bytes | None) -> np.ndarray | None:
    """Grey float image of a P5 or P6 file of 8 bits a sample; None if it isn't a whole one."""
    if not raw:
        return None
    head, at = [], 0
    while len(head) < 4 and at < len(raw):
        if raw[at : at + 1] == b"#":
            at = raw.find(b"\n", at) + 1 or len(raw)
        elif raw[at : at + 1].isspace():
            at += 1
        else:
            end = at
            while end < len(raw) and not raw[end : end + 1].isspace():
                end += 1
            head.append(raw[at:end])
            at = end
    if len(head) < 4 or head[0] not in (b"P5", b"P6") or not all(x.isdigit() for x in head[1:]):
        return None
    w, h, most = map(int, head[1:])
    planes = 3 if head[0] == b"P6" else 1
    body = raw[at + 1 : at + 1 + w * h * planes]
    if not 0 < most < 256 or w < 1 or h < 1 or len(body) < w * h * planes:
        return None
    x = np.frombuffer(body, np.uint8).reshape(h, w, planes).astype(np.float32) * (255 / most)
    return x.mean(axis=2)


def _box(x: np.ndarray, r: int) -> np.ndarray:
    """Mean over (2 r + 1) squared, edges repeated."""
    n, c = 2 * r + 1, np.cumsum(np.pad(x, r, mode="edge"), axis=0, dtype=np.float32)
    p = c[n - 1 :]
    p[1:] = p[1:] - c[:-n]
    c = np.cumsum(p / n, axis=1, dtype=np.float32)
    p = c[:, n - 1 :].copy()
    p[:, 1:] -= c[:, :-n]
    return p / n


def resize(x: np.ndarray, factor: float) -> np.ndarray:
    """Bilinear, smaller by ``factor``."""
    h, w = max(int(x.shape[0] / factor), 1), max(int(x.shape[1] / factor), 1)
    y, z = (np.minimum((np.arange(n) + 0.5) * factor - 0.5, m - 1).clip(0) for n, m in ((h, x.shape[0]), (w, x.shape[1])))
    a, b = y.astype(int), z.astype(int)
    fy, fz = (y - a)[:, None], (z - b)[None, :]
    c, d = np.minimum(a + 1, x.shape[0] - 1), np.minimum(b + 1, x.shape[1] - 1)
    return (x[np.ix_(a, b)] * (1 - fy) * (1 - fz) + x[np.ix_(a, d)] * (1 - fy) * fz + x[np.ix_(c, b)] * fy * (1 - fz) + x[np.ix_(c, d)] * fy * fz).astype(np.float32)


def describe(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(k x 4: x, y, scale, turn; k x 2 words of 64 bits) of the corners of a grey image."""
    points, codes = [], []
    for s in SCALES:
        x = image if s == 1.0 else resize(_box(image, 1), s)
        h, w = x.shape
        m = RADIUS + 1
        if h <= 2 * m or w <= 2 * m:
            continue
        x = _box(x, 1)
        gy, gx = np.zeros_like(x), np.zeros_like(x)
        gy[1:-1], gx[:, 1:-1] = x[2:] - x[:-2], x[:, 2:] - x[:, :-2]
        a, b, c = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
        r = a * b - c * c - 0.05 * (a + b) ** 2
        inner = r[m : h - m, m : w - m]
        top = inner.copy()
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                np.maximum(top, r[m + dy : h - m + dy, m + dx : w - m + dx], out=top)
        y0, x0 = np.nonzero((inner == top) & (inner > 1.0))
        tile = (y0 + m) // SIDE * (w // SIDE + 1) + (x0 + m) // SIDE
        best = np.lexsort((-inner[y0, x0], tile))
        rank = np.arange(len(best)) - np.searchsorted(tile[best], tile[best])
        best = best[rank < CORNERS]
        y0, x0 = y0[best] + m, x0[best] + m
        if not len(y0):
            continue
        patch = x[y0[:, None, None] + _yy, x0[:, None, None] + _xx] * _disc
        angle = np.arctan2((patch * _yy).sum(axis=(1, 2)), (patch * _xx).sum(axis=(1, 2)))
        turn = np.rint(angle / (2 * np.pi) * TURNS).astype(int) % TURNS
        o = _TURNED[turn]
        smooth = _box(x, 1)
        yy, xx = y0[:, None], x0[:, None]
        lim = lambda v, n: np.clip(v, 0, n - 1)
        bits = smooth[lim(yy + o[:, :, 0], h), lim(xx + o[:, :, 1], w)] < smooth[lim(yy + o[:, :, 2], h), lim(xx + o[:, :, 3], w)]
        codes.append(np.packbits(bits, axis=1).view(np.uint64))
        points.append(np.stack(((x0 + 0.5) * s, (y0 + 0.5) * s, np.full(len(x0), s), angle), axis=1))
    if not points:
        return np.zeros((0, 4)), np.zeros((0, 2), np.uint64)
    return np.concatenate(points), np.concatenate(codes)


DESCRIBED = "id long, sha binary, n int, points binary, codes binary"
TABLE = "key long, id long, no int, d_0 long, d_1 long"
MEMO = 4096


def described(images: DataFrame) -> DataFrame:
    """DESCRIBED of each image of (id, image binary); null and broken files have none.

    An image's corners are one row: n x 4 float32 (x, y, scale, turn) and n x 2 words of 64 bits.
    Equal files of a task are described once (the memo holds a fixed number of images).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, tuple[int, bytes, bytes] | None] = {}
        for t in batches:
            rows = []
            for i, x in zip(t.column(0).to_pylist(), t.column(1), strict=True):
                raw = x.as_py()
                if not raw:
                    continue
                sha = hashlib.sha256(raw).digest()
                if sha not in memo:
                    image = decode_pnm(raw)
                    p, c = describe(image) if image is not None else (None, None)
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[sha] = (len(p), p.astype(np.float32).tobytes(), c.tobytes()) if p is not None else None
                if memo[sha]:
                    rows.append((i, sha, *memo[sha]))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["id", "sha", "n", "points", "codes"])

    return images.where("id is not null").select(F.col("id").cast("long"), F.col("image").cast("binary")).mapInArrow(run, DESCRIBED)


def tables(images: DataFrame, near: bool = False, only: int | None = None) -> DataFrame:
    """TABLE of (id, codes): a row for each corner and table, whose block of BLOCK_BITS bits is in the key.

    With ``near`` also rows for the keys one bit from it; with ``only`` the rows of that table alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, count = 1 << np.arange(BLOCK_BITS, dtype=np.int64), BITS // BLOCK_BITS
        flips = np.concatenate(([0], weight)) if near else np.zeros(1, np.int64)
        nos = np.arange(count) if only is None else np.array([only])
        rows, step = len(nos) * len(flips), (1 << 16) // (len(nos) * len(flips))
        for t in batches:
            raw, offs = C.column_bytes(t.column(1))
            code, size = raw.view(np.uint64).reshape(-1, 2), np.diff(offs) // 16
            no = np.arange(len(code)) - np.repeat(offs[:-1] // 16, size)
            ids = np.repeat(t.column(0).to_numpy(), size)
            for a in range(0, len(code), step):
                x = code[a : a + step]
                b = np.unpackbits(x.view(np.uint8), axis=1).reshape(len(x), count, BLOCK_BITS)[:, nos]
                key = ((b @ weight)[:, :, None] ^ flips | (nos.astype(np.int64) << 40)[:, None]).ravel()
                y, at = np.repeat(x.view(np.int64), rows, axis=0), slice(a, a + len(x))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.repeat(ids[at], rows)), pa.array(np.repeat(no[at], rows).astype(np.int32)), pa.array(y[:, 0].copy()), pa.array(y[:, 1].copy())], ["key", "id", "no", "d_0", "d_1"])

    return images.select("id", "codes").mapInArrow(run, TABLE)


def consensus(q: np.ndarray, m: np.ndarray) -> int:
    """Most matches (rows x, y, scale, angle) that agree with one match's similarity transform."""
    ratio, turn = m[:, 2] / q[:, 2], m[:, 3] - q[:, 3]
    best = 0
    for k in range(len(q)):
        c, s = ratio[k] * np.cos(turn[k]), ratio[k] * np.sin(turn[k])
        dx, dy = q[:, 0] - q[k, 0], q[:, 1] - q[k, 1]
        off = np.hypot(m[k, 0] + c * dx - s * dy - m[:, 0], m[k, 1] + s * dx + c * dy - m[:, 1])
        good = (off < REACH) & (np.abs((turn - turn[k] + np.pi) % (2 * np.pi) - np.pi) < 0.5) & (np.abs(np.log(ratio / ratio[k])) < 0.4)
        best = max(best, len(set(map(tuple, np.rint(m[good, :2] / 3).tolist()))))
    return best


def matches(q_codes: bytes, m_codes: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Numbers (query corner, image corner) of all pairs at most MOST_APART bits apart."""
    q, m = (np.frombuffer(x, np.uint64).reshape(-1, 2) for x in (q_codes, m_codes))
    apart = np.bitwise_count(q[:, None, :] ^ m[None, :, :]).sum(axis=2, dtype=np.int64)
    return np.nonzero(apart <= MOST_APART)


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(query_id, image_id, q points, m points, q codes, m codes) -> with n_matches, n_inliers in place of the last four."""
    for t in batches:
        n, n_in = [], []
        for p, r, x, y in zip(*(t.column(i).to_pylist() for i in range(2, 6)), strict=True):
            i, j = matches(x, y)
            q, m = (np.frombuffer(z, np.float32).reshape(-1, 4).astype(float) for z in (p, r))
            n.append(len(i))
            n_in.append(consensus(q[i], m[j]))
        yield pa.RecordBatch.from_arrays([t.column(0), t.column(1), pa.array(n, pa.int64()), pa.array(n_in, pa.int64())], ["query_id", "image_id", "n_matches", "n_inliers"])


def find_copies(queries: DataFrame, images: DataFrame) -> DataFrame:
    """(query_id, image_id, n_copies, n_matches, n_inliers) for each image class that a query is a copy of.

    Both are (id, image). image_id is the smallest id of the images with equal bytes; n_copies says
    how many there are. Equal files always match, with all their corners as matches, also those
    without corners, which match nothing else. Null or broken files and null ids are left out. A query
    id with several images gets the figures of the best of them for each match. Ties between
    transforms change no figure. Other columns are ignored. Empty tables: no rows. An image of any
    size is one row's corners in memory.

    The tables find every two corners NEAR bits apart, at any size. A pair of images with such corners
    is judged on all its corners, up to MOST_APART bits, so its figures are those of a search without
    tables. Missed are copies without a near corner: of pictures of check_s none of 60 cropped, with
    other contrast or smaller ones, 2 of 60 turned by 20 or 45 degrees, 4 of 60 turned by 10.
    """
    index = C.keep(described(images).groupBy("sha").agg(F.min_by(F.struct("id", "n", "points", "codes"), "id").alias("r"), F.count("*").alias("n_copies")).select("sha", "r.*", "n_copies"))
    # a query is one file under one id
    asked = C.keep(described(queries).withColumn("query_id", F.col("id")).withColumn("id", F.xxhash64("id", "sha")).dropDuplicates(["id"]))
    near = f"q.key = m.key and bit_count(q.d_0 ^ m.d_0) + bit_count(q.d_1 ^ m.d_1) <= {NEAR}"
    pairs = None
    for i in range(BITS // BLOCK_BITS):  # one table after the other: only one's rows are on disk
        # merged at any size: what a query asks for is far larger than the file that Spark would judge it
        # by. A large bucket is split by Spark: what follows the join is dealt by other keys.
        met = tables(asked, True, i).alias("q").join(tables(index, False, i).alias("m").hint("merge"), F.expr(near))
        met = C.keep(met.select(F.col("q.id").alias("q"), F.col("m.id").alias("m")).distinct())
        pairs = met if pairs is None else pairs.union(met)
    pairs = pairs.distinct()
    pairs = pairs.join(asked.select(F.col("id").alias("q"), "query_id", F.col("points").alias("q_points"), F.col("codes").alias("q_codes")), "q").join(index.select(F.col("id").alias("m"), F.col("points").alias("m_points"), F.col("codes").alias("m_codes")), "m")
    got = pairs.select("query_id", F.col("m").alias("image_id"), "q_points", "m_points", "q_codes", "m_codes").mapInArrow(_agreeing, "query_id long, image_id long, n_matches long, n_inliers long")
    equal = asked.select("sha", "query_id").join(index.select("sha", F.col("id").alias("image_id"), F.col("n").cast("long").alias("n_matches")), "sha").select("query_id", "image_id", "n_matches", F.col("n_matches").alias("n_inliers"))
    best = got.where(f"n_inliers >= {INLIERS}").union(equal).groupBy("query_id", "image_id").agg(F.max("n_matches").alias("n_matches"), F.max("n_inliers").alias("n_inliers"))
    return best.join(index.select(F.col("id").alias("image_id"), "n_copies"), "image_id").select("query_id", "image_id", "n_copies", "n_matches", "n_inliers")


def render(vector: list[float] | None) -> np.ndarray | None:
    """A picture that is a function of the vector: shaded boxes over a rough ground; None if empty."""
    v = np.array([0.0 if x is None else x for x in vector or []], np.float32)
    if not len(v):
        return None
    v = np.nan_to_num(v)
    seed = C.mix(np.frombuffer(np.resize(v, -(-len(v) // 2) * 2).tobytes(), np.uint64)).sum(dtype=np.uint64)
    r = C.mix(seed + np.arange(1, 40 * 4 + 1, dtype=np.uint64)).reshape(-1, 4)
    ground = (C.mix(seed + np.arange(1000, 1000 + 24 * 24, dtype=np.uint64)) & np.uint64(255)).astype(np.float32).reshape(24, 24)
    out = resize(ground, 24 / SIDE) * 0.6 + 50
    top = np.abs(v).max() or 1.0
    for k in range(len(r)):
        x, y = (int(q % np.uint64(SIDE - 8)) for q in r[k, :2])
        w, h = (6 + int(q % np.uint64(22)) for q in r[k, 2:])
        out[y : y + h, x : x + w] = out[y : y + h, x : x + w] * 0.4 + 0.6 * (128 + 120 * v[k % len(v)] / top)
    return np.clip(out, 0, 255).astype(np.uint8)


def edited(image: np.ndarray, key: int) -> np.ndarray:
    """A copy cut to four fifths of its sides, with other contrast and brightness and some noise."""
    r = np.random.default_rng(key)
    h, w = image.shape[0] * 4 // 5, image.shape[1] * 4 // 5
    y, x = r.integers(0, image.shape[0] - h + 1), r.integers(0, image.shape[1] - w + 1)
    part = image[y : y + h, x : x + w].astype(np.float32)
    return np.clip(part * r.uniform(0.8, 1.1) + r.uniform(-15, 15) + r.normal(0, 2, part.shape), 0, 255).astype(np.uint8)


def rendered(vectors: DataFrame, copies: bool = False) -> DataFrame:
    """(id, image): the picture of each (id, vector), or with ``copies`` an edited copy of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            out = []
            for i, v in zip(t.column(0).to_pylist(), t.column(1).to_pylist(), strict=True):
                x = render(v)
                out.append(None if x is None else encode_pgm(edited(x, i or 0) if copies else x))
            yield pa.RecordBatch.from_arrays([t.column(0), pa.array(out, pa.binary())], ["id", "image"])

    return vectors.mapInArrow(run, "id long, image binary")


def op1_media_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no pictures: those drawn from all rows of embeddings stand in for them.

    Queries are the edited pictures of every row whose id is divisible by 100.
    """
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("vector"))
    return find_copies(rendered(v.where("id % 100 = 0"), copies=True), rendered(v))
