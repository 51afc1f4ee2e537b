"""From raw documents to packed training sequences.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns the documents
that it keeps with the columns of documents, but for the last, which returns packed pieces. Each
result is written as Parquet and read again as the next one's docs. So when a stage begins, what
the one before it kept in the shared folder is read no more, and it is deleted then.

All stages: docs has the columns of documents; other columns, whatever their names, are dropped.
doc_id, lang and source may be null or repeat and are passed on as they are; repeated rows are
separate documents. Texts of any length are read whole. n_chars follows the text where a stage
changes it. An empty table gives an empty table.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from termloom.llm import bpe, language_id, line_dedup, near_dedup, packing, suffix_dedup
from termloom.llm import common as C

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Bytes that a repeated passage must have to be cut: those of over 50 words have more, also where
#: words are short. On check_s 0.997 of the documents that hold such a passage lose it, of 400 bytes
#: (what operator 3's query is asked for) 0.786.
PASSAGE = 250


#: What the stage that ran last has kept.
_left: list = []


def stage(f):
    @functools.wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        C.discard(_left)
        place = C.mark()
        out = f(spark, docs, sf_dir)
        _left[:] = C.since(place)
        return out

    return run_stage


def _with_length(docs: DataFrame) -> DataFrame:
    """n_chars follows the text."""
    return docs.selectExpr("doc_id", "text", "lang", "source", "cast(char_length(text) as bigint) as n_chars")


@stage
def stage_language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told without a narrow margin; others, null texts and those without
    a letter among them, go. The model learns from a bounded sample of all labelled rows; without a
    labelled text every document stays. Exact ties are a narrow margin."""
    model = language_id.learn(docs)
    return language_id.identify(docs, model, COLUMNS).where("not rejected").select(*COLUMNS) if model else docs.select(*COLUMNS)


@stage
def stage_line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that an earlier one repeats up to one edit, the earliest by (doc_id,
    text key, line) staying; documents left without text go, those that had none and lost nothing
    (null, empty) stay. Lines of under 10 code points stay."""
    out = line_dedup.remove_lines(docs, columns=COLUMNS)
    return _with_length(out.where("n_dropped = 0 or trim(text) <> ''"))


@stage
def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with similar sets of five-word shingles, that of least doc_id, stays.

    Of rows that repeat a doc_id all stay or go. Null doc_ids and texts without a word stay."""
    gone = near_dedup.near_duplicates(docs, k=5, percent=80).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


@stage
def stage_suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without byte strings of PASSAGE that also start elsewhere, in this document or another, every
    copy of them; documents left without text go, null, empty and blank texts among them."""
    out = suffix_dedup.remove_repeats(docs, PASSAGE, COLUMNS)
    return _with_length(out.where("trim(text) <> ''"))


@stage
def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4,096 tokens, as few as best fit makes; each row is a
    document, null and empty texts the end token alone. Ties between equally long pieces go by doc_id."""
    return packing.pack(docs, bpe.default_path("word_bpe_49k.json"))


STAGES = [
    ("language_id", stage_language_id),
    ("line_dedup", stage_line_dedup),
    ("near_dedup", stage_near_dedup),
    ("suffix_dedup", stage_suffix_dedup),
    ("packing", stage_packing),
]
#: Compression, byte windows and tokenizers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir)
    for _, apply in STAGES:
        docs = C.keep(apply(spark, docs, sf_dir))
    C.discard(_left)
    _left.clear()
    return docs
