"""Language identification by compression (operator 8).

A text is compressed once per language by zstandard with a raw-content dictionary of that language;
the language whose dictionary gives the fewest bytes wins. Texts are compressed in blocks, so that
also in a long text every block leans on the dictionary and not on what was read before. A narrow
margin between the best and the second, as a share of the best, is a rejection: texts in a language
that was not learned, mixed texts and junk have one. Of very short texts the sizes may tie: then
the text is compressed once more behind a part of the dictionary that is compressed along with it,
so that its single letters are coded by the language's letter frequencies; only a clear lead of that
measure is not a rejection.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm import common as C

#: Bounds of the training sample: rows taken a language, and bytes of a dictionary.
SAMPLE_ROWS, DICTIONARY_BYTES = 200, 1 << 15
BLOCK_BYTES, LEVEL, CONTEXT_BYTES = 4096, 6, 1 << 13
#: A prediction is rejected if the second language needs less than this share of bytes more; of texts
#: whose sizes tie, if it needs less than CLEAR more by the second measure. On check_s the margin of
#: texts told right is 0.18 in the middle and above 0.02 for 99 of 100; of texts in a language left
#: out of learning it is 0.005 to 0.011 in the middle.
MARGIN, CLEAR = 0.02, 0.05
PIECE_BYTES = 256
FOLDS = 5


def spread(raw: bytes, share: int) -> bytes:
    """``share`` bytes of a text, in pieces of about PIECE_BYTES evenly spread from its start to its end."""
    if share >= len(raw):
        return raw
    n = max(1, share // PIECE_BYTES)
    at = [(len(raw) - share // n) * i // max(n - 1, 1) for i in range(n)]
    return b" ".join(raw[x : x + share // n] for x in at)


def shares(lengths: list[int], size: int) -> list[int]:
    """Bytes to take of each text: the same of all that are long enough, all of the others."""
    out, left = [0] * len(lengths), size
    for k, i in enumerate(sorted(range(len(lengths)), key=lengths.__getitem__)):
        out[i] = min(lengths[i], left // (len(lengths) - k))
        left -= out[i]
    return out


def learn(docs: DataFrame, rows: int = SAMPLE_ROWS, size: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """A dictionary per non-null lang of (doc_id, text, lang), from a bounded sample.

    Of each language the ``rows`` distinct rows of least hash are taken; pieces spread over the whole
    of each of them fill the dictionary's ``size`` bytes, the same share of each text, short texts
    whole. Texts without a letter and null texts are left out; a null doc_id is as good as any. The
    driver holds ``rows`` hashes and ``size`` bytes a language. No labelled text: no dictionary.
    """
    from pyspark.sql import Window

    low = F.lower(F.col("text").cast("string"))
    good = docs.where("lang is not null").where(F.col("text").rlike("\\p{L}")).select(F.col("lang").cast("string").alias("lang"), low.alias("text"), F.xxhash64("doc_id", "text").alias("h"))
    counts = dict(tuple(r) for r in C.collect(good.groupBy("lang").agg(F.count("*"))))
    if not counts:
        return {}
    # the least hashes of each language lie, but for one case in very many, in this part of their range
    part = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 8 * rows / n))))
    least = good.where(F.col("h").cast("double") < (F.element_at(part, F.col("lang")) * 2 - 1) * float(1 << 63))
    least = least.groupBy("lang", "h").agg(F.min(F.octet_length("text")).alias("n"))
    top = C.collect(least.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("r") <= rows).select("lang", "h", "n"))
    taken: dict[tuple[str, int], int] = {}
    for lang in counts:
        own = sorted((r["h"], r["n"]) for r in top if r["lang"] == lang)
        taken |= {(lang, h): k for (h, _), k in zip(own, shares([n for _, n in own], size - len(own)), strict=True)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            keys = zip(t.column(0).to_pylist(), t.column(1).to_pylist(), strict=True)
            raw = [spread(x.as_py(), taken.get(k, 0)) for k, x in zip(keys, t.column(2).cast(pa.large_binary()), strict=True)]
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1), pa.array(raw, pa.binary())], ["lang", "h", "raw"])

    sample = good.where(F.col("h").isin([h for _, h in taken])).groupBy("lang", "h").agg(F.first("text").alias("text"))
    parts: dict[str, list[tuple[int, bytes]]] = {}
    for r in sample.mapInArrow(run, "lang string, h long, raw binary").toLocalIterator():
        parts.setdefault(r["lang"], []).append((r["h"], bytes(r["raw"])))
    return {lang: b"\n".join(x for _, x in sorted(got))[:size] for lang, got in sorted(parts.items())}


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes]):
        self.langs = list(dictionaries)
        params = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=0, write_checksum=0, write_dict_id=0)

        def coder(raw: bytes, params=params) -> zstandard.ZstdCompressor:
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=params)
            return zstandard.ZstdCompressor(dict_data=d, compression_params=params)

        self.coders = [coder(raw) for raw in dictionaries.values()]
        close = zstandard.ZstdCompressionParameters.from_level(LEVEL, min_match=3, write_content_size=0, write_checksum=0, write_dict_id=0)
        self.behind = []
        for raw in dictionaries.values():
            c, part = coder(raw[CONTEXT_BYTES:] or raw, close), raw[:CONTEXT_BYTES]
            self.behind.append((c, part, len(c.compress(part))))

    def sizes(self, raw: bytes) -> np.ndarray:
        blocks = [raw[i : i + BLOCK_BYTES] for i in range(0, len(raw), BLOCK_BYTES)]
        if len(blocks) > 1 and len(blocks[-1]) < BLOCK_BYTES // 4:
            blocks[-2:] = [blocks[-2] + blocks[-1]]
        return np.array([sum(len(c.compress(b)) for b in blocks) for c in self.coders], np.int64)

    def predict(self, raw: bytes) -> tuple[str, float, bool]:
        """(language, score, rejected). Exact ties go to the first language and are rejected.

        The score is m / (m + MARGIN) for the margin m, so one half where rejection begins.
        """
        if len(self.langs) == 1:
            return self.langs[0], 1.0, False
        s, bound = self.sizes(raw), MARGIN
        order = np.argsort(s, kind="stable")
        if s[order[0]] == s[order[1]]:
            more = np.array([len(c.compress(part + raw)) - own for c, part, own in self.behind], np.int64)
            order, bound = np.lexsort((more, s)), CLEAR
            s = np.maximum(more, 1)
        margin = (s[order[1]] - s[order[0]]) / s[order[0]]
        return self.langs[order[0]], float(margin / (margin + bound)), bool(margin < bound)


def identify(docs: DataFrame, dictionaries: dict[str, bytes], columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``columns`` of (text, ...) with lang_pred, score (0 to 1) and rejected.

    lang_pred is one of the dictionaries' names, or ``und`` with score 0 and rejected where the
    text is null, empty, has no letter, or nothing was learned. Texts are read whole, a block at a
    time. The model is bounded by the number of languages times the dictionary size. Rows are kept
    one to one, repeated ones too; an empty table gives none. ``columns`` may have any names but
    lang_pred, score and rejected; other columns are ignored.
    """
    has = F.coalesce(F.col("text").cast("string").rlike("\\p{L}"), F.lit(False))
    d = docs.select(*columns, F.when(has, F.lower(F.col("text").cast("string"))))
    kinds = d.schema.fields[:-1]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kinds] + ["lang_pred string", "score double", "rejected boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(dictionaries) if dictionaries else None
        for t in batches:
            at = t.num_columns - 1
            got = []
            for x in t.column(at).cast(pa.large_binary()):
                raw = x.as_py()
                got.append(("und", 0.0, True) if raw is None or model is None else model.predict(raw))
            a, b, c = zip(*got, strict=True) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([*(t.column(i) for i in range(at)), pa.array(a, pa.string()), pa.array(b, pa.float64()), pa.array(c, pa.bool_())], [*t.schema.names[:at], "lang_pred", "score", "rejected"])

    return d.mapInArrow(C.trimmed(run), schema)


def fold(folds: int = FOLDS):
    """The row's fold: crc32 of doc_id as text, modulo ``folds``; null for a null doc_id."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir)
    model = learn(docs.where(fold() != 0))
    out = identify(docs.withColumn("held_out", F.coalesce(fold() == 0, F.lit(False))), model, ("doc_id", "held_out"))
    return out.select("doc_id", "held_out", "lang_pred", "score", "rejected")
