"""Removal of repeated byte strings by sharded suffix arrays (operator 3).

Plan.
1. Anchors: of every ``window``-byte string the 64-byte gram with the least hash is an anchor, so
   equal strings hold the same anchor at the same place. An anchor whose hash occurs once in the
   corpus can't lie in a repeated string. Anchors with equal surroundings (all strings through the
   anchor equal) are settled by counting alone. What is left are the borders of
   repeated passages: every string through an anchor whose surroundings occur
   once, also one that another anchor has settled, for other copies may hold it without that one.
2. Shards: documents with such borders are taken in shards of bounded size. Each shard builds the
   suffix array of its border regions (Larsson-Sadakane prefix doubling that sorts only groups that
   are still tied), common prefixes of neighbours (Kasai's permuted form: only irreducible
   positions are compared, the rest follow by subtraction), and marks strings seen twice in it.
3. Cross-shard merge: each shard sends its distinct strings as sorted 64-bit fingerprints, cut into
   ranges. A range task finds those of two or more shards and looks each shard's list up by binary
   search; the hits go back to the shard, which removes the covered bytes.

No step groups by a text key: a passage that a third of all documents hold is one aggregation row
in step 1 and one fingerprint of each shard in step 3. Probability that two different strings share
a fingerprint among n of them: n**2 / 3.7e19.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm import common as C

WINDOW, GRAM = 400, 64
SHARD_BORDER, SHARD_TEXT = 1 << 21, 1 << 23
RANGE_ROWS = 1_000_000


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Suffix array of t (small non-negative integers below 257) by Larsson-Sadakane refinement."""
    n = len(t)
    if n < 2:
        return np.arange(n)
    pad = np.zeros(n + 7, np.int64)
    pad[:n] = t.astype(np.int64) + 1
    key = np.zeros(n, np.int64)
    for j in range(7):
        key = key * 258 + pad[j : j + n]
    order = np.argsort(key, kind="stable")
    new = np.concatenate(([True], key[order[1:]] != key[order[:-1]]))
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    last = np.concatenate((new[1:], [True]))
    at = np.flatnonzero(~(new & last))  # places in order that are still tied
    h = 7
    while len(at):
        pos = order[at]
        nxt = pos + h
        key = rank[pos] * (n + 1) + np.where(nxt < n, rank[np.minimum(nxt, n - 1)] + 1, 0)
        by = np.argsort(key, kind="stable")
        pos, key = pos[by], key[by]
        order[at] = pos
        new = np.concatenate(([True], key[1:] != key[:-1]))
        rank[pos] = np.maximum.accumulate(np.where(new, at, 0))
        last = np.concatenate((new[1:], [True]))
        at = at[~(new & last)]
        h *= 2
    return order


def common_prefixes(t: np.ndarray, order: np.ndarray) -> np.ndarray:
    """lcp[i]: common prefix of the suffixes at order[i - 1] and order[i]; lcp[0] = 0."""
    n = len(t)
    if n < 2:
        return np.zeros(n, np.int64)
    phi = np.empty(n, np.int64)
    phi[order[1:]] = order[:-1]
    phi[order[0]] = -1
    i = np.arange(1, n)
    p = phi[1:]
    irreducible = np.ones(n, bool)
    irreducible[1:] = (p <= 0) | (t[i - 1] != t[np.maximum(p - 1, 0)])
    heads = np.flatnonzero(irreducible)
    plcp = np.zeros(n, np.int64)
    act = heads[phi[heads] >= 0]
    a, b = act.copy(), phi[act].copy()
    step = 1
    pad = np.concatenate((t.astype(np.int16), np.full(64, -1, np.int16)))
    while len(act):
        offs = np.arange(step)
        ok = np.minimum(a, n)[:, None] + offs, np.minimum(b, n)[:, None] + offs
        x, y = pad[ok[0]], pad[ok[1]]
        eq = (x == y) & (x >= 0)
        run = np.where(eq.all(axis=1), step, np.argmin(eq, axis=1))
        plcp[act] += run
        go = run == step
        act, a, b = act[go], a[go] + step, b[go] + step
        step = min(step * 2, 64)
    src = np.maximum.accumulate(np.where(irreducible, np.arange(n), 0))
    plcp = np.maximum(plcp[src] - (np.arange(n) - src), 0)
    lcp = plcp[order]
    lcp[0] = 0
    return lcp


def _windows(data: np.ndarray, offs: np.ndarray, window: int, gram: int):
    """Anchors of the windows of each document, for at most a few MB: (position, hash)."""
    n, w = len(data), window - gram + 1
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    p = C.prefix_hash(data)
    down = C.powers(n + 1)[1]
    g = C.mix((p[gram:] - p[:-gram]) * down[: n - gram + 1])
    key = (g & ~np.uint64((1 << 22) - 1)) | np.arange(len(g), dtype=np.uint64)
    m = -(-len(g) // w) * w
    k = np.full(m, np.uint64(0xFFFFFFFFFFFFFFFF))
    k[: len(g)] = key
    k = k.reshape(-1, w)
    left = np.minimum.accumulate(k, axis=1).ravel()
    right = np.minimum.accumulate(k[:, ::-1], axis=1)[:, ::-1].ravel()
    low = np.minimum(right[: n - window + 1], left[w - 1 : w - 1 + n - window + 1])
    ends = np.repeat(offs[1:], np.diff(offs))
    low = low[np.arange(len(low)) + window <= ends[: len(low)]]
    low = low[np.concatenate(([True], low[1:] != low[:-1]))] if len(low) else low
    at = (low & np.uint64((1 << 22) - 1)).astype(np.int64)
    at = at[np.concatenate(([True], at[1:] != at[:-1]))] if len(at) else at
    return at, g[at]


def anchors(data: np.ndarray, offs: np.ndarray, window: int = WINDOW, gram: int = GRAM):
    """(document, place in it, gram hash, hash of all windows through it) of every anchor."""
    d, q, h, g = [], [], [], []
    reach = window - gram
    for a, b in C.pieces(data, offs, C.BLOCK):
        lo, hi = int(offs[a]), int(offs[b])
        for s in range(lo, max(hi - window, lo) + 1, C.BLOCK - window + 1) if hi - lo > C.BLOCK else [lo]:
            e = min(s + C.BLOCK, hi) if hi - lo > C.BLOCK else hi
            inner = np.clip(offs[a : b + 1], s, e) - s
            at, gh = _windows(data[s:e], inner, window, gram)
            if not len(at):
                continue
            doc = a + np.searchsorted(inner, at, "right") - 1
            d.append(doc)
            q.append(at + s - offs[doc])
            h.append(gh)
    if not d:
        z = np.zeros(0, np.int64)
        return z, z, z.astype(np.uint64), z.astype(np.uint64)
    d, q, h = np.concatenate(d), np.concatenate(q), np.concatenate(h)
    if len(data) > C.BLOCK:  # blocks of a long document overlap
        order = np.lexsort((q, d))
        d, q, h = d[order], q[order], h[order]
        first = np.concatenate(([True], (d[1:] != d[:-1]) | (q[1:] != q[:-1])))
        d, q, h = d[first], q[first], h[first]
    g = np.empty(len(d), np.uint64)
    size = np.diff(offs)
    i = 0
    base = offs[d] + q
    lo, hi = np.maximum(q - reach, 0) + offs[d], np.minimum(q + window, size[d]) + offs[d]
    while i < len(d):
        j = max(int(np.searchsorted(lo, lo[i] + C.BLOCK - 2 * window, "right")), i + 1)
        s, e = lo[i], hi[i:j].max()
        p, down = C.prefix_hash(data[s:e]), C.powers(e - s + 1)[1]
        x = (p[hi[i:j] - s] - p[lo[i:j] - s]) * down[lo[i:j] - s]
        g[i:j] = C.mix(x ^ C.mix(((hi - base)[i:j] * 65536 + (base - lo)[i:j]).astype(np.uint64)))
        i = j
    return d, q, h, g


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) of the runs of true in x."""
    y = np.diff(np.concatenate(([0], x.astype(np.int8), [0])))
    return np.flatnonzero(y == 1), np.flatnonzero(y == -1) - 1


def _window_hashes(data: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """Fingerprints of the windows at ascending starts."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(int(np.searchsorted(starts, starts[i] + C.BLOCK - window, "right")), i + 1)
        s, e = starts[i], starts[j - 1] + window
        p, down = C.prefix_hash(data[s:e]), C.powers(e - s + 1)[1]
        at = starts[i:j] - s
        out[i:j] = C.mix((p[at + window] - p[at]) * down[at])
        i = j
    return out


def shard_marks(texts: list[np.ndarray], lists: list[tuple[np.ndarray, ...]], window: int, gram: int):
    """Of a shard: for each document which windows are known to repeat and which are open, and the
    sorted distinct fingerprints of the shard's border windows."""
    marks, opens, regions, owner = [], [], [], []
    for i, (t, (places, full, probe)) in enumerate(zip(texts, lists, strict=True)):
        m = max(len(t) - window + 1, 0)
        # settled and suspect windows, by difference arrays
        y = np.zeros((3, m + 1), np.int32)
        for row, sel in enumerate((full, ~full, probe)):
            lo, hi = np.maximum(places[sel] - (window - gram), 0), np.minimum(places[sel] + 1, m)
            ok = lo < hi
            np.add.at(y[row], lo[ok], 1)
            np.add.at(y[row], hi[ok], -1)
        cov = np.cumsum(y, axis=1)[:, :m] > 0
        marks.append(cov[0])
        # also settled ones: a text that lacks the settled anchor has only this one to meet them by
        border = cov[2] | cov[1]
        opens.append(border)
        for s, e in zip(*_runs(border), strict=True):
            regions.append((i, s, e))
    if not regions:
        return marks, opens, np.zeros(0, np.uint64)
    length = np.array([e - s + window + 1 for _, s, e in regions])
    begin = np.cumsum(length) - length
    buf = np.zeros(int(length.sum()), np.int16)
    valid = np.zeros(len(buf), bool)
    for (i, s, e), b in zip(regions, begin, strict=True):
        buf[b : b + e - s + window] = texts[i][s : e + window].astype(np.int16) + 1
        valid[b : b + e - s + 1] = True
    order = suffix_array(buf)
    lcp = common_prefixes(buf, order)
    del buf
    long_ = np.concatenate((lcp >= window, [False]))
    # a common prefix that runs over a separator is cut there; within a window there is none
    twice = np.zeros(len(valid), bool)
    twice[order] = long_[:-1] | long_[1:]
    twice &= valid
    prints = []
    found: dict[int, list[tuple[int, int, int]]] = {}
    for (i, s, e), b in zip(regions, begin, strict=True):
        found.setdefault(i, []).append((s, e, b))
    for i, t in enumerate(texts):
        if i not in found:
            continue
        starts = np.concatenate([np.arange(s, e + 1) for s, e, _ in found[i]])
        seen = np.concatenate([twice[b : b + e - s + 1] for s, e, b in found[i]])
        prints.append(_window_hashes(t, starts, window))
        marks[i][starts[seen]] = True
        opens[i] &= ~marks[i]
    return marks, opens, C.distinct(np.concatenate(prints))


def _spans(mark: np.ndarray, window: int, n: int) -> np.ndarray:
    """Maximal removed byte runs, k x 2, from marked window starts."""
    s, e = _runs(mark)
    if not len(s):
        return np.zeros((0, 2), np.int64)
    e = e + window
    gap = np.concatenate(([True], s[1:] > e[:-1]))
    first = np.flatnonzero(gap)
    last = np.concatenate((first[1:] - 1, [len(s) - 1]))
    return np.stack((s[first], e[last]), axis=1)


SHARD = "shard string, key long, text binary, known binary, asks binary, prints binary"


def _shards(window: int, gram: int):
    import uuid

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, texts, lists, border, size = [], [], [], 0, 0

        def flush() -> pa.RecordBatch:
            name = uuid.uuid4().hex
            marks, pending, prints = shard_marks(texts, lists, window, gram)
            rows = [(name, k, t.tobytes(), *(np.stack(_runs(x)).tobytes() for x in (m, p)), None) for k, t, m, p in zip(keys, texts, marks, pending, strict=True)]
            rows.append((name, None, None, None, None, C.pack_keys(prints)))
            cols = list(zip(*rows, strict=True))
            kinds = [pa.string(), pa.int64(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["shard", "key", "text", "known", "asks", "prints"])

        for batch in batches:
            data, offs = C.column_bytes(batch.column(1))
            places = batch.column(2)
            values, bound = places.flatten(), np.concatenate(([0], np.cumsum(np.array([len(x) for x in places], np.int64))))
            v = values.to_numpy(zero_copy_only=False)
            for i in range(len(batch)):
                x = v[bound[i] : bound[i + 1]]
                keys.append(batch.column(0)[i].as_py())
                texts.append(data[offs[i] : offs[i + 1]])
                lists.append((x >> 2, (x & 1) == 1, (x & 2) == 2))
                border += int(np.count_nonzero(x & 3 != 1)) * 2 * window
                size += int(offs[i + 1] - offs[i])
                if border >= SHARD_BORDER or size >= SHARD_TEXT:
                    yield flush()
                    keys, texts, lists, border, size = [], [], [], 0, 0
        if keys:
            yield flush()

    return run


def _split(ranges: int):
    """Each shard's sorted fingerprints in ``ranges`` rows (range, shard, prints)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for i in range(len(t)):
                x = C.unpack_keys(t.column(1)[i].as_py())
                if not len(x):
                    continue
                cuts = np.searchsorted(x, np.array([(r << 64) // ranges for r in range(1, ranges)], np.uint64))
                got = [(r, p) for r, p in enumerate(np.split(x, cuts)) if len(p)]
                yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in got], pa.int32()), pa.array([t.column(0)[i].as_py()] * len(got)), pa.array([C.pack_keys(p) for _, p in got])], ["r", "shard", "prints"])

    return run


def _merge(t: pa.Table) -> pa.Table:
    """Fingerprints that two or more shards hold, back to each of them."""
    own = [C.unpack_keys(x) for x in t.column("prints").to_pylist()]
    x = np.sort(np.concatenate(own))
    twice = C.distinct(x[1:][x[1:] == x[:-1]])
    out = []
    for p in own:
        at = np.searchsorted(twice, p)
        hit = p[(at < len(twice)) & (twice[np.minimum(at, max(len(twice) - 1, 0))] == p)] if len(twice) else p[:0]
        out.append(C.pack_keys(hit))
    some = pa.array([bool(x) for x in out])
    return pa.table({"shard": t.column("shard"), "hits": pa.array(out, pa.binary())}).filter(some)


OUT = "key long, n_removed long, n_spans long, kept_sha256 string"


def _finish(window: int, texts: bool):
    def run(docs: pa.Table, hits: pa.Table) -> pa.Table:
        known = C.distinct(np.concatenate([np.zeros(0, np.uint64), *(C.unpack_keys(x) for x in hits.column("hits").to_pylist())]))
        rows = []
        for key, raw, known_runs, ask_runs in zip(*(docs.column(c).to_pylist() for c in ("key", "text", "known", "asks")), strict=True):
            mark = np.zeros(max(len(raw) - window + 1, 0), bool)
            for s, e in np.frombuffer(known_runs, np.int64).reshape(2, -1).T:
                mark[s : e + 1] = True
            asks = [np.arange(s, e + 1) for s, e in np.frombuffer(ask_runs, np.int64).reshape(2, -1).T]
            if asks and len(known):
                starts = np.concatenate(asks)
                p = _window_hashes(np.frombuffer(raw, np.uint8), starts, window)
                at = np.minimum(np.searchsorted(known, p), len(known) - 1)
                mark[starts[known[at] == p]] = True
            spans = _spans(mark, window, len(raw))
            left, at = [], 0
            for s, e in spans.tolist():
                left.append(raw[at:s])
                at = e
            left = b"".join([*left, raw[at:]])
            row = [key, len(raw) - len(left), len(spans), hashlib.sha256(left).hexdigest()]
            rows.append(row + ([left.decode("utf-8", "ignore"), spans.tolist()] if texts else []))
        names = ["key", "n_removed", "n_spans", "kept_sha256", *(["text", "spans"] if texts else [])]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.list_(pa.int64()))]
        cols = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds[: len(names)], strict=True)], names=names)

    return run


def repeats(docs: DataFrame, window: int = WINDOW, texts: bool = False) -> DataFrame:
    """Result by text key, for the texts of (key, text) that hold a suspect string.

    key, n_removed, n_spans, kept_sha256 and, with ``texts``, the remaining text (characters that
    a cut splits are dropped) and the removed byte spans. Rows of equal key must have equal text
    and count as separate documents.
    """
    gram = min(GRAM, max(window // 3, 1))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            data, offs = C.column_bytes(t.column(1))
            key = t.column(0).to_numpy(zero_copy_only=False)
            for a, b in C.pieces(data, offs, 4 * C.BLOCK):
                d, q, h, g = anchors(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a], window, gram)
                yield pa.RecordBatch.from_arrays([pa.array(key[a:b][d]), pa.array(q), pa.array(h.view(np.int64)), pa.array(g.view(np.int64))], ["key", "place", "h", "g"])

    place = C.mark()
    at = docs.select("key", "text").mapInArrow(C.trimmed(find), "key long, place long, h long, g long")
    at = C.keep(at)
    # both written first: the joins below then shuffle their sides plainly and Spark can split a hot anchor
    same = C.keep(at.groupBy("h", "g").agg(F.count("*").alias("c")))
    often = C.keep(same.groupBy("h").agg(F.sum("c").alias("n"), F.count("*").alias("kinds")).where("n > 1").select("h", (F.col("kinds") > 1).alias("varied")))
    same = C.keep(same.join(often, "h").select("h", "g", (F.col("c") > 1).alias("full"), "varied"))
    met = C.keep(at.join(same, ["h", "g"]).select("key", "place", "h", "g", "full", "varied"))
    C.settle(place, met)
    # One copy of a settled group stands for it wherever other surroundings of the anchor exist.
    one = met.where("full and varied").groupBy("h", "g").agg(F.min(F.struct("key", "place")).alias("one"))
    codes = met.select("key", (F.col("place") * 4 + F.col("full").cast("int")).alias("code")).union(one.select("one.key", F.col("one.place") * 4 + 3))
    lists = codes.groupBy("key").agg(F.collect_set("code").alias("places"))
    suspects = docs.dropDuplicates(["key"]).select("key", "text").join(lists, "key").select("key", F.col("text").cast("binary").alias("text"), "places")
    shards = C.keep(suspects.mapInArrow(C.trimmed(_shards(window, gram)), SHARD))
    C.settle(place, shards)
    own = shards.where("key is null").select("shard", "prints")
    total = C.collect(own.agg(F.sum(F.octet_length("prints"))))[0][0] or 0  # 8 bytes each
    ranges = max(1, -(-total // (8 * RANGE_ROWS)))
    ranges = max(ranges, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) if total > 8 * RANGE_ROWS else 1)
    hits = own.mapInArrow(_split(ranges), "r int, shard string, prints binary").groupBy("r").applyInArrow(_merge, "shard string, hits binary")
    schema = OUT + (", text string, spans array<array<long>>" if texts else "")
    return shards.where("key is not null").groupBy("shard").cogroup(hits.groupBy("shard")).applyInArrow(_finish(window, texts), schema)


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.xxhash64("doc_id", text).alias("key"))


def remove_repeats(docs: DataFrame, window: int = WINDOW, columns: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` (doc_id, text and ``columns``) with each repeated ``window``-byte string cut out.

    Null text counts as empty and stays null; other rows and columns are kept as they are.
    """
    d = docs.select(*dict.fromkeys(["doc_id", "text", *columns]))
    d = d.withColumn("_key", F.xxhash64("doc_id", F.coalesce(F.col("text").cast("string"), F.lit(""))))
    cut = repeats(_keyed(docs), window, texts=True).where("n_removed > 0").select(F.col("key").alias("_key"), F.col("text").alias("_cut"))
    return d.join(cut, "_key", "left").withColumn("text", F.coalesce("_cut", "text")).drop("_key", "_cut")


def digest(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of (doc_id, text).

    A byte goes if a ``window``-byte string over it also starts anywhere else, in the same document
    or another, judged on the whole input. Null text: empty. Texts under ``window`` bytes lose
    nothing. Repeated rows are separate documents and so lose what is long enough in them. doc_id
    may be null or repeat. Other columns are ignored. An empty table gives no rows.
    """
    keyed = _keyed(docs)
    base = keyed.select("doc_id", "key", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("whole"))
    got = repeats(keyed, window)
    return base.join(got, "key", "left").select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("kept_sha256", "whole").alias("kept_sha256"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(C.documents(spark, sf_dir))
