"""Word language model with deleted interpolation (operator 7).

P(v | u) = l2 c(u,v)/c(u) + l1 c(v)/N + l0/(V + 1), with weights l by the frequency bucket of the
context u. Counts come from the whole training corpus. The weights are learned by expectation-
maximisation on held-out counts: every training document is judged with its own counts deleted.
EM reads a histogram of those judgements, whose probabilities are rounded to an eighth of an octave.

Plan. Texts are dealt into shards of bounded size. A shard sends its distinct words and word pairs,
with its training counts, as sorted packed keys cut into ranges; a range task sums the counts of
all shards and answers each shard's list by binary search. Nothing is collected but two totals for
each range and a histogram of bounded size for the weights. A frequent word costs one entry a shard.
Shards grow with the root of the input, up to a bound, so that a shard's row for a range keeps many
keys; beyond that bound rows get shorter, down to one key as in a plain shuffle by key. Rows alike
in doc_id and text are in one shard.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm import common as C

FOLDS, HELD = 7, 2
#: Bytes of text in a shard: a few at least, at most what a task holds.
LEAST_SHARD, MOST_SHARD = 5 << 20, 32 << 20
STEPS = 60  # of EM
BUCKETS, STEP = 24, 8  # context-frequency buckets by powers of two; eighths of a power of two
BEGIN, CLOSE = np.uint64(0x5BD1E995DEADBEEF), np.uint64(0x27D4EB2F165667C5)


def pack_counts(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype(np.uint64).view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack_counts(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(np.uint64).ravel().astype(np.int64)


def token_arrays(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, context pair, document) of all documents: the words of each, then its end."""
    h, doc = C.words(data, offs)
    docs = len(offs) - 1
    n = np.bincount(doc, minlength=docs) + 1
    end = np.cumsum(n) - 1
    tok = np.empty(len(h) + docs, np.uint64)
    at = np.ones(len(tok), bool)
    at[end] = False
    tok[at], tok[end] = h, CLOSE
    before = np.empty_like(tok)
    before[1:] = tok[:-1]
    before[end - n + 1] = BEGIN
    owner = np.repeat(np.arange(docs), n)
    return tok, before, owner


def pair_key(before: np.ndarray, tok: np.ndarray) -> np.ndarray:
    return C.mix(before * np.uint64(0xA24BAED4963EE407) + tok)


def _counted(keys: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and how many of each are in training."""
    order = np.argsort(keys)
    k = keys[order]
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, np.int64)
    c = np.add.reduceat(train[order].astype(np.int64), first) if len(k) else np.zeros(0, np.int64)
    return k[first], c


def _ask(ranges: int):
    edges = np.array([(r << 64) // ranges for r in range(1, ranges)], np.uint64)

    def run(t: pa.Table) -> pa.Table:
        data, offs = C.column_bytes(t.column("text"))
        shard = t.column("shard")[0].as_py()
        tok, before, owner = token_arrays(data, offs)
        train = t.column("train").to_numpy(zero_copy_only=False).astype(bool)
        mine = train[owner]
        opens = before == BEGIN
        rows = []
        for kind, (k, c) in enumerate((_counted(np.concatenate((tok, before[opens])), np.concatenate((mine, mine[opens]))), _counted(pair_key(before, tok), mine))):
            cut = np.searchsorted(k, edges)
            for r, (x, y) in enumerate(zip(np.split(k, cut), np.split(c, cut), strict=True)):
                if len(x):
                    rows.append((r, shard, kind, C.pack_keys(x), pack_counts(y)))
        cols = list(zip(*rows, strict=True))
        return pa.table([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["r", "shard", "kind", "keys", "counts"])

    return run


def _answer(t: pa.Table) -> pa.Table:
    out, r = [], t.column("r")[0].as_py()
    shard, kinds = t.column("shard").to_pylist(), t.column("kind").to_pylist()
    for kind in (0, 1):
        rows = [i for i, k in enumerate(kinds) if k == kind]
        if not rows:
            continue
        own = [C.unpack_keys(t.column("keys")[i].as_py()) for i in rows]
        keys = np.concatenate(own)
        counts = np.concatenate([unpack_counts(t.column("counts")[i].as_py()) for i in rows])
        keys, counts = _counted(keys, counts)
        out += [(r, shard[i], kind, pack_counts(counts[np.searchsorted(keys, k)]), None, None) for i, k in zip(rows, own, strict=True)]
        if kind == 0:
            words = keys != BEGIN
            out.append((r, -1, kind, None, int(np.count_nonzero(counts[words])), int(counts[words].sum())))
    cols = list(zip(*out, strict=True))
    return pa.table([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64()), strict=True)], names=["r", "shard", "kind", "counts", "types", "tokens"])


ANSWER = "r int, shard int, kind int, counts binary, types long, tokens long"


def _looked_up(t: pa.Table, answers: pa.Table):
    """token arrays of a shard and the corpus counts: of the token, of its context, of the pair."""
    data, offs = C.column_bytes(t.column("text"))
    tok, before, owner = token_arrays(data, offs)
    got = {}
    for r, kind, raw in zip(*(answers.column(c).to_pylist() for c in ("r", "kind", "counts")), strict=True):
        got.setdefault(kind, []).append((r, raw))
    uni, pair = (np.concatenate([unpack_counts(raw) for _, raw in sorted(got[k])]) for k in (0, 1))
    at = np.unique(np.concatenate((tok, [BEGIN])), return_inverse=True)[1]
    pk = pair_key(before, tok)
    c_v = uni[at[:-1]]
    return offs, tok, before, owner, pk, c_v, shifted(c_v, before, uni[at[-1]]), pair[np.unique(pk, return_inverse=True)[1]]


def shifted(of_token: np.ndarray, before: np.ndarray, of_begin) -> np.ndarray:
    """What holds for each token's context, from what holds for the tokens."""
    out = np.empty_like(of_token)
    out[1:] = of_token[:-1]
    out[before == BEGIN] = of_begin
    return out


def _bucket(c: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(c, 0) + 1).astype(np.int64), BUCKETS - 1)


def own_counts(key: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """How often each entry's key occurs in its document."""
    _, at, n = np.unique(C.mix(key ^ C.mix(owner.astype(np.uint64) + np.uint64(1))), return_inverse=True, return_counts=True)
    return n[at]


def deleted(tok, before, owner, pk, c_v, c_u, c_uv, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context count, pair estimate, word estimate) of each token without its own document's counts."""
    size = np.bincount(owner)[owner] if len(owner) else owner
    own = own_counts(tok, owner)
    c_u, c_v, c_uv = c_u - shifted(own, before, 1), c_v - own, c_uv - own_counts(pk, owner)
    return c_u, np.where(c_u > 0, c_uv / np.maximum(c_u, 1), 0.0), c_v / np.maximum(total - size, 1)


def rounded(p: np.ndarray) -> np.ndarray:
    """Eighths of an octave as integers from 0 (for 1.0) up; 0xFFFF for 0."""
    return np.where(p > 0, np.minimum(-np.rint(STEP * np.log2(np.maximum(p, 1e-300))), 0xFFFE), 0xFFFF).astype(np.int64)


def _held_out(total: int):
    def run(t: pa.Table, answers: pa.Table) -> pa.Table:
        _, tok, before, owner, pk, c_v, c_u, c_uv = _looked_up(t, answers)
        x = t.column("train").to_numpy(zero_copy_only=False).astype(bool)[owner]
        tok, before, owner, pk, c_v, c_u, c_uv = (y[x] for y in (tok, before, owner, pk, c_v, c_u, c_uv))
        c_u, p2, p1 = deleted(tok, before, owner, pk, c_v, c_u, c_uv, total)
        code, n = np.unique((_bucket(c_u) << 32) | (rounded(p2) << 16) | rounded(p1), return_counts=True)
        return pa.table({"code": pa.array(code, pa.int64()), "n": pa.array(n, pa.int64())})

    return run


def interpolation(rows: list[tuple[int, int]], types: int) -> np.ndarray:
    """BUCKETS x 3 weights (pair, word, uniform), each row's sum 1, by EM over (code, count) rows.

    A bucket starts from even shares. One without any held-out token takes the weights of the
    nearest lower one that has some, the even shares if none has. The first bucket holds contexts
    that were not seen: they have no pairs. Where nothing was held out the words' share goes too
    if there is no word.
    """
    lam = np.full((BUCKETS, 3), 1 / 3)
    code, n = (np.array([r[i] for r in rows], np.int64) for i in (0, 1))
    b, q = code >> 32, [code >> 16 & 0xFFFF, code & 0xFFFF]
    if len(rows):
        p = np.stack([np.where(x == 0xFFFF, 0.0, 2.0 ** (-x / STEP)) for x in q] + [np.full(len(b), 1 / (types + 1))], axis=1)
        for _ in range(STEPS):
            share = lam[b] * p
            share *= (n / share.sum(axis=1))[:, None]
            new = np.stack([np.bincount(b, share[:, k], BUCKETS) for k in range(3)], axis=1) + [0.0, 0.0, 1e-3]
            has = np.bincount(b, n, BUCKETS) > 0
            lam = np.where(has[:, None], new / new.sum(axis=1, keepdims=True), lam)
    last = None
    for i in range(BUCKETS):
        if np.any(b == i):
            last = lam[i].copy()
        elif last is not None:
            lam[i] = last
    lam[0, 0] = 0.0
    if not types:
        lam[:, :2] = 0.0
    lam[lam.sum(axis=1) == 0, 2] = 1.0
    return lam / lam.sum(axis=1, keepdims=True)


def _score(lam: np.ndarray, total: int, types: int):
    def run(t: pa.Table, answers: pa.Table) -> pa.Table:
        _, _, _, owner, _, c_v, c_u, c_uv = _looked_up(t, answers)
        w = lam[_bucket(c_u)]
        p = w[:, 0] * c_uv / np.maximum(c_u, 1) + w[:, 1] * c_v / max(total, 1) + w[:, 2] / (types + 1)
        docs = t.num_rows
        sums = [np.bincount(owner, x, docs) for x in (np.log10((c_v + 1) / (total + types + 1)), np.log10(p))]
        n = np.bincount(owner, minlength=docs)
        known = np.bincount(owner[c_v > 0], minlength=docs)
        return pa.table([t.column("doc_id"), t.column("held_out"), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(docs, total), pa.int64()), pa.array(sums[0]), pa.array(sums[1])], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of (doc_id, text).

    Learns from rows whose crc32(doc_id as text) mod 7 is not 2. Words are
    ``[^\\x20\\x09-\\x0D]+`` with A-Z lowered; each text ends in one more token. Null or empty
    text: that token alone. A null doc_id is in training. Repeated rows count and score as often as
    they occur. Other columns are ignored; an empty table gives no rows. Without any training row
    all counts are 0 and every token has the uniform probability.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS)) == HELD, F.lit(False))
    rows = rows.withColumn("held_out", held).withColumn("train", ~F.col("held_out"))
    size = C.collect(rows.agg(F.sum(F.octet_length("text").cast("long") + 64)))[0][0] or 0
    shards = max(1, -(-size // min(max(LEAST_SHARD, math.isqrt(2560 * size)), MOST_SHARD)))
    # the text is part of the key: rows that repeat a doc_id spread
    main = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)).cast("int"))
    asked = main.select("shard", "text", "train").groupBy("shard").applyInArrow(_ask(2 * shards), "r int, shard int, kind int, keys binary, counts binary")
    answers = C.keep(asked.groupBy("r").applyInArrow(_answer, ANSWER))
    types, total = C.collect(answers.where("shard = -1").agg(F.coalesce(F.sum("types"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))))[0]
    answers = answers.where("shard >= 0").select("shard", "r", "kind", "counts").groupBy("shard")
    seen = main.select("shard", "text", "train").groupBy("shard").cogroup(answers).applyInArrow(_held_out(total), "code long, n long")
    lam = interpolation([tuple(r) for r in C.collect(seen.groupBy("code").agg(F.sum("n")))], types)
    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return main.select("shard", "doc_id", "held_out", "text").groupBy("shard").cogroup(answers).applyInArrow(_score(lam, total, types), out)


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(C.documents(spark, sf_dir))
