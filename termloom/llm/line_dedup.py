"""Removal of repeated and nearly repeated lines by a deletion-neighbourhood join (operator 2).

Lines of at least ``min_chars`` code points are compared, with ``short`` also shorter ones that aren't
blank, for equality alone. Two lines are alike if they are equal or one edit (insertion, deletion,
substitution of a code point) apart. Equal lines collapse by aggregation.
For the rest, each line emits every variant with one code point deleted as a hashed key: an insertion or deletion makes one line equal a variant of the other, a substitution makes two
variants with the deletion at one place equal. Lines of a key and place are joined to the earliest
of them only, and so are a line and the variants that equal it (for one edit that loses nothing: all
of them are within the bound), and the edit distance is verified. A line goes if an earlier one is
alike.

Only lines that share their first or second half with another line can be one edit apart, so the
variants are emitted for those alone (a lossless filter by aggregation).

The joins with all texts and all lines are merge joins at any size: their other sides grow with the
input, and the plan stays the one that is measured.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm import common as C

MIN_CHARS = 10


def variant_keys(line: str) -> tuple[np.ndarray, int]:
    """(keys of the variants by the place of deletion, key of the line itself)."""
    c = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(c)
    up, down = C.powers(n + 1)
    term = C.mix(c + np.uint64(1)) * up[:n]
    p = np.zeros(n + 1, np.uint64)
    np.cumsum(term, out=p[1:])
    less = p[:-1] + (p[n] - p[1:]) * down[1]
    return C.mix(less ^ np.uint64(n - 1)), int(C.mix(p[n : n + 1] ^ np.uint64(n))[0])


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, line) -> (key, place, id): place is the deleted code point's, -1 for the line itself."""
    for t in batches:
        for i in range(len(t)):
            less, own = variant_keys(t.column(1)[i].as_py())
            key = np.concatenate(([np.uint64(own)], less)).view(np.int64)
            place = np.arange(-1, len(less), dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(place), t.column(0).slice(i, 1).take(pa.array(np.zeros(len(key), np.int32)))], ["key", "place", "id"])


def _lines(docs: DataFrame, min_chars: int, short: bool) -> DataFrame:
    rows = docs.where("text is not null").select("_ord", "_key", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    compared = F.char_length("line") >= min_chars
    if short:
        compared = compared | F.col("line").rlike("\\S")
    return rows.where(compared).select(F.struct(F.coalesce("_ord", F.lit(-(1 << 63))).alias("d"), F.col("_key").alias("k"), "pos").alias("at"), "line", F.xxhash64("line").alias("id"), F.xxhash64(F.lit(1), "line").alias("id2"))


def _halves():
    """Keys of which two lines one edit apart share one: both halves, at the line's length and one less."""
    n = F.char_length("line")
    return F.array(
        F.xxhash64(n, F.lit("a"), F.expr("left(line, char_length(line) div 2)")),
        F.xxhash64(n, F.lit("b"), F.expr("right(line, char_length(line) - char_length(line) div 2)")),
        F.xxhash64(n - 1, F.lit("a"), F.expr("left(line, (char_length(line) - 1) div 2)")),
        F.xxhash64(n - 1, F.lit("b"), F.expr("right(line, char_length(line) - 1 - (char_length(line) - 1) div 2)")),
    )


def _suspects(docs: DataFrame, once: DataFrame) -> DataFrame:
    """(id, first, line) of the distinct lines that share a half with another; texts move once."""
    keys = once.select("id", F.explode("halves").alias("half"))
    shared = keys.groupBy("half").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("half")
    ids = keys.join(shared, "half", "left_semi").select("id").distinct()
    where = C.keep(once.join(ids, "id", "left_semi").select("id", "first", F.col("first.k").alias("_key")))
    found = docs.select("_key", "text").join(where.hint("merge"), "_key").select("id", "first", F.expr("split(text, '\\n', -1)[first.pos]").alias("line"))
    return C.keep(found)


def _alike(texts: DataFrame) -> DataFrame:
    """ids of the lines that have an earlier one within one edit, of (id, first, line)."""
    from pyspark.sql import Window

    texts = texts.dropDuplicates(["id"])
    # Distinct lines with one variant are bounded by its length times the alphabet: no key is hot.
    w = Window.partitionBy("key")
    v = texts.select("id", "line").mapInArrow(C.trimmed(_variants), "key long, place int, id long").repartition("key")
    v = v.select("*", F.min("id").over(w).alias("lo"), F.max("id").over(w).alias("hi")).where("lo < hi").drop("lo", "hi")
    v = C.keep(v.join(texts.select("id", "first"), "id"))
    # a deletion at one place of both is a substitution, a deletion that gives a line is an insertion
    one = F.struct("first", "id")
    by_place = v.where("place >= 0").groupBy("key", "place").agg(F.min(one).alias("m"), F.count("*").alias("c")).where("c > 1").drop("c")
    line, less = (v.where(c).groupBy("key").agg(F.min(one).alias("m")) for c in ("place < 0", "place >= 0"))
    pick = lambda x: x.where("m.first < first").select("id", F.col("m.id").alias("other"))
    met = pick(v.join(by_place, ["key", "place"])).union(pick(v.where("place >= 0").join(line, "key"))).union(pick(v.where("place < 0").join(less, "key"))).distinct()
    a, b = texts.select("id", "line"), texts.select(F.col("id").alias("other"), F.col("line").alias("before"))
    return met.join(a, "id").join(b, "other").where(F.levenshtein("line", "before", 1) >= 0).select("id").distinct()


def drops(docs: DataFrame, min_chars: int = MIN_CHARS, short: bool = False) -> DataFrame:
    """(_key, gone): ascending numbers of the lines to remove from each text of (_ord, _key, text)."""
    place, lines = C.mark(), _lines(docs, min_chars, short)
    halves = F.when(F.char_length("line") >= min_chars, _halves())  # null: no one-edit match
    once = C.keep(lines.groupBy("id", "id2").agg(F.count("*").alias("n"), F.min("at").alias("first"), F.min(halves).alias("halves")))
    texts = _suspects(docs, once)
    alike = _alike(texts).withColumn("near", F.lit(True))
    bad = once.join(alike, "id", "left").where("n > 1 or near").select("id", "id2", "first", F.coalesce("near", F.lit(False)).alias("near"))
    gone = lines.select("at", "id", "id2").join(bad.hint("merge"), ["id", "id2"]).where("near or first < at")
    gone = C.keep(gone.groupBy(F.col("at.k").alias("_key")).agg(F.array_sort(F.collect_set("at.pos")).alias("gone")))
    C.settle(place, gone)
    return gone


def _cut(columns: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """columns, text, gone -> columns, text without those lines, n_lines, n_dropped."""
        for t in batches:
            out, lines, dropped = [], [], []
            for x, gone in zip(t.column(columns), t.column(columns + 1), strict=True):
                x, g = x.as_py(), gone.as_py()
                lines.append(0 if x is None else x.count("\n") + 1)
                dropped.append(len(g or ()))
                if g:
                    g = set(g)
                    x = "\n".join(y for i, y in enumerate(x.split("\n")) if i not in g)
                out.append(x)
            yield pa.RecordBatch.from_arrays([*t.columns[:columns], pa.array(out, pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], [*t.schema.names[:columns], "text", "n_lines", "n_dropped"])

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_ord", F.col("doc_id").cast("long")).withColumn("_key", F.xxhash64("doc_id", F.coalesce(F.col("text"), F.lit(""))))


def remove_lines(docs: DataFrame, min_chars: int = MIN_CHARS, columns: tuple[str, ...] = (), short: bool = False) -> DataFrame:
    """``docs`` (doc_id, text and ``columns``) without its repeated lines, and n_lines, n_dropped.

    Lines end at \\n. Order is (doc_id, text key, line number); the earliest line stays. Lines
    shorter than ``min_chars`` stay; with ``short`` those that aren't blank go if an earlier line is
    equal. Null text stays null with 0 lines; an empty text has one
    empty line. Rows that repeat both doc_id and text count as one document and lose the same lines.
    Null doc_ids come first. Other columns are untouched; an empty table gives no rows.
    """
    names = list(dict.fromkeys(["doc_id", "text", *columns]))
    d = _keyed(docs.select(*names).withColumn("text", F.col("text").cast("string")))
    gone = drops(d.select("_ord", "_key", "text"), min_chars, short)
    rest = [c for c in names if c != "text"]
    schema = ", ".join([f"`{c}` {t}" for c, t in d.select(*rest).dtypes] + ["text string, n_lines long, n_dropped long"])
    out = d.join(gone.hint("merge"), "_key", "left").select(*rest, "text", "gone").mapInArrow(C.trimmed(_cut(len(rest))), schema)
    return out.select(*names, "n_lines", "n_dropped")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_lines(C.documents(spark, sf_dir), short=True)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
