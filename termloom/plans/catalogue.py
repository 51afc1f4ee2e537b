"""Registered queries, named by the operator they show, and their SQL for DuckDB."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions import stemmers
from termloom.functions import text as T
from termloom.functions import values as V
from termloom.operators import codec, index, lineage, mapreduce, status
from termloom.sources import archives, config, scratch
from termloom.streaming import incremental

SHARDS = 8
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_TOK = r"""tok AS (SELECT doc_id, lower(substring(w, 1, 65)) AS term FROM (
  SELECT doc_id, unnest(regexp_extract_all(text, '([\p{L}\p{Nd}_-]+)[^\p{L}\p{Nd}_-]', 1)) AS w FROM documents))"""
_TF = f"{_TOK}, tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL)"
_INDEX = f"""WITH {_TF} SELECT CAST(doc_id % {SHARDS} AS INTEGER) AS shard, term, count(*) AS df,
  string_agg(doc_id || ':' || tf, ' ' ORDER BY doc_id) AS postings FROM tf GROUP BY ALL"""


def _words(spark, sf_dir):
    return index.tokens(table(spark, sf_dir, "documents"))


def _built(spark, sf_dir):
    return index.of_documents(table(spark, sf_dir, "documents"), SHARDS)


@query(_INDEX)
def index_postings(spark, sf_dir):
    return index.as_text(_built(spark, sf_dir))


@query(f"WITH {_TOK} SELECT doc_id, count(*) AS n_tokens FROM tok GROUP BY ALL")
def o17_tokens_per_doc(spark, sf_dir):
    return _words(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n_tokens"))


@query(r"""SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{Nd}_-]+')) AS n_tokens FROM documents""")
def o17_tokens_flushed(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.tokens(F.col("text"), flush_tail=True)).cast("long").alias("n_tokens"))


@query(r"""SELECT lower(substring(w, 1, 5)) AS term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '([\p{L}\p{Nd}_-]+)[^\p{L}\p{Nd}_-]', 1)) AS w FROM documents) GROUP BY ALL""")
def o18_capped_tokens(spark, sf_dir):
    return index.tokens(table(spark, sf_dir, "documents"), max_word=5).groupBy("term").agg(F.count("*").alias("n"))


@query(r"""SELECT CASE WHEN regexp_matches(c, '^[a-z]$') THEN 'ascii_lower' WHEN regexp_matches(c, '^[A-Z]$') THEN 'ascii_upper' WHEN regexp_matches(c, '^\p{Nd}$') THEN 'number'
  WHEN c = '-' THEN 'hyphen' WHEN c = '_' THEN 'underscore' WHEN regexp_matches(c, '^\p{Lu}$') THEN 'alpha_upper' WHEN regexp_matches(c, '^\p{L}$') THEN 'alpha_lower' ELSE 'ignore' END AS class, count(*) AS n
  FROM (SELECT unnest(string_split(text, '')) AS c FROM conversations) WHERE c <> '' GROUP BY ALL""")
def o16_char_classes(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.explode(F.split("text", "")).alias("c")).where("c <> ''")
    # few characters: count them first, class them once
    return c.groupBy("c").agg(F.count("*").alias("k")).groupBy(T.char_class(F.col("c")).alias("class")).agg(F.sum("k").alias("n"))


@query(r"""SELECT doc_id, length(text) AS n_chars FROM documents WHERE text <> ''""")
def o14_normalised_texts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", T.normalised(F.col("text").cast("binary")).alias("text"))
    return d.where("text is not null").select("doc_id", F.char_length("text").cast("long").alias("n_chars"))


@query("SELECT doc_id, least(strlen(text), 1000) AS n_bytes FROM documents")
def o15_capped_bytes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.octet_length(T.capped_bytes(F.col("text").cast("binary"), 1000)).cast("long").alias("n_bytes"))


@query(r"""SELECT lower(w) AS term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[\p{L}\p{Nd}_-]+')) AS w FROM conversations) GROUP BY ALL""")
def o19_fold_exact(spark, sf_dir):
    """Distinct words are folded, then counted under their folded form."""
    words = table(spark, sf_dir, "conversations").select(F.explode(T.tokens(F.col("text"), flush_tail=True)).alias("w")).groupBy("w").agg(F.count("*").alias("k"))
    return words.groupBy(T.fold_exact("w").alias("term")).agg(F.sum("k").alias("n"))


@query("SELECT doc_id, text FROM documents")
def o22_to_unicode(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.to_unicode(F.col("text").cast("binary"), "ignore").alias("text"))


@query(f"WITH {_TF} SELECT doc_id, term, tf FROM tf")
def o41_tf_per_doc(spark, sf_dir):
    return index.term_counts(_words(spark, sf_dir))


@query(f"WITH {_TF} SELECT term, count(*) AS df FROM tf GROUP BY ALL")
def o44_df_global(spark, sf_dir):
    return index.document_frequency(index.term_counts(_words(spark, sf_dir)))


@query(f"""WITH {_TF} SELECT CAST(doc_id % {SHARDS} AS INTEGER) AS shard, count(DISTINCT term) AS n_terms, count(*) AS n_postings, CAST(sum(tf) AS BIGINT) AS n_tokens FROM tf GROUP BY ALL""")
def o44_shard_stats(spark, sf_dir):
    return index.shard_stats(index.term_counts(_words(spark, sf_dir)), SHARDS)


@query(_INDEX)
def o46_merge_partials(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    split = F.pmod(F.xxhash64("source"), F.lit(3))
    return index.as_text(index.merge(*(index.of_documents(docs.where(split == i), SHARDS) for i in range(3))))


@query(f"WITH {_TOK} SELECT DISTINCT term FROM tok")
def o51_distinct_terms(spark, sf_dir):
    return _words(spark, sf_dir).select("term").distinct()


@query(f"""WITH {_TF}, terms AS (SELECT DISTINCT CAST(doc_id % {SHARDS} AS INTEGER) AS shard, term FROM tf)
  SELECT shard, term, row_number() OVER (PARTITION BY shard ORDER BY term COLLATE "C") AS place FROM terms""".replace(' COLLATE "C"', ""))
def o58_terms_in_order(spark, sf_dir):
    from pyspark.sql import Window

    terms = _words(spark, sf_dir).select(V.shard_of(F.col("doc_id"), SHARDS).alias("shard"), "term").distinct()
    return terms.select("shard", "term", F.row_number().over(Window.partitionBy("shard").orderBy("term")).cast("long").alias("place"))


@query("SELECT page_id, regexp_replace(html, '(?s)<!--.*?-->', '', 'g') AS text FROM pages")
def o25_strip_comments(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.strip_comments(F.col("html")).alias("text"))


@query("SELECT page_id, regexp_replace(html, '(?s)<.*?>', '', 'g') AS text FROM pages")
def o29_strip_tags(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.strip_tags(F.col("html")).alias("text"))


_MARKED = "'{{note|' || source || '}} ' || text || ' [[' || lang || '|' || source || ']] [http://x.org/' || doc_id || ' see]'"


def _marked(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.expr(f"concat({', '.join(_MARKED.split(' || '))})".replace("doc_id", "cast(doc_id as string)")).alias("text"))


@query(rf"SELECT doc_id, regexp_replace(regexp_replace({_MARKED}, '\{{\{{[^}}{{]*\}}\}}', '', 'g'), '\{{\{{[^}}]*\}}\}}', '', 'g') AS text FROM documents")
def o30_strip_templates(spark, sf_dir):
    return _marked(spark, sf_dir).select("doc_id", T.strip_templates(F.col("text")).alias("text"))


@query(rf"SELECT doc_id, regexp_replace({_MARKED}, '\[([^\]\[]*)\|([^\]\[]*)\]', '\2', 'g') AS text FROM documents")
def o33_link_labels(spark, sf_dir):
    return _marked(spark, sf_dir).select("doc_id", F.regexp_replace("text", *map(F.lit, T.ROUND[10])).alias("text"))


#: A text with each kind of markup, from literals and columns of documents.
_WIKI = ["'= '", "source", """' =<ref name="n">cited</ref> a<ref name="m"/> b<nowiki>[[x]]</nowiki> <math>x^2</math> '""", "lang", "'\n[[Image:a.png|thumb|'", "lang", "' caption]] text\n[[File:b.png|left|'", "source", "']]\n{| class=t\n|-\n| a '", "'|'", "'| b\n! c\n|}\n[] end'"]
_WIKI_SQL = " || ".join(x.replace("\n", "' || chr(10) || '") for x in _WIKI)


def _wiki(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(*(F.lit(x[1:-1]) if x[0] == "'" else F.col(x) for x in _WIKI)).alias("text"))


def _markup_query(name: str, step: int):
    pattern, new = T.ROUND[step]

    def run(spark, sf_dir):
        return _wiki(spark, sf_dir).select("doc_id", F.regexp_replace("text", F.lit(pattern), F.lit(new)).alias("text"))

    run.__name__ = name
    quoted = lambda x: x.replace("(?d)", "").replace("$", "\\")
    new_sql = " || ".join("chr(10)" if x == "\n" else f"'{quoted(x)}'" for x in re.split("(\n)", new) if x) or "''"
    query(f"SELECT doc_id, regexp_replace({_WIKI_SQL}, '{quoted(pattern)}', {new_sql}, 'g') AS text FROM documents")(run)


for _name, _step in (("o26_strip_footnotes", 1), ("o27_strip_nowiki", 2), ("o28_strip_math", 3), ("o32_image_captions", 8), ("o32_file_captions", 9), ("o34_table_cells", 11), ("o36_cell_markers", 13), ("o37_empty_brackets", 14)):
    _markup_query(_name, _step)


#: One round as DuckDB's patterns, written for it: [text -> text].
_LINES_SQL = "array_to_string([CASE WHEN i > 1 AND i < len(string_split({0}, chr(10))) AND regexp_matches(string_split({0}, chr(10))[i], '^([{{][|]|[|]-|[|][}}])') THEN '' ELSE string_split({0}, chr(10))[i] END for i in range(1, len(string_split({0}, chr(10))) + 1)], chr(10))"
_ROUND_SQL = [
    *(f"regexp_replace({{0}}, '(?s){p}', '', 'g')" for p in ("<!--.*?-->", "<ref[> ].*?(</ref>|/>)", "<nowiki[> ].*?(</nowiki>|/>)", "<math[> ].*?(</math>|/>)", "<.*?>")),
    "regexp_replace({0}, '[{{][{{][^}}{{]*[}}][}}]', '', 'g')",
    "regexp_replace({0}, '[{{][{{][^}}]*[}}][}}]', '', 'g')",
    "regexp_replace({0}, '\\[\\w+://[^ \\]\\n]*( ([^\\]\\n]*))?\\]', '\\1', 'g')",
    "regexp_replace({0}, '\\n\\[\\[[iI]mage[^\\n]*?([|][^\\n]*?)*[|]([^\\n]*?)\\]\\]', chr(10) || '\\2', 'g')",
    "regexp_replace({0}, '\\n\\[\\[[fF]ile[^\\n]*?([|][^\\n]*?)*[|]([^\\n]*?)\\]\\]', chr(10) || '\\2', 'g')",
    "regexp_replace({0}, '\\[([^\\]\\[]*)[|]([^\\]\\[]*)\\]', '\\2', 'g')",
    "replace({0}, '||', chr(10) || '|')",
    _LINES_SQL,
    "regexp_replace({0}, '\\n[|!]([^\\n]*[|])?', chr(10), 'g')",
    "replace({0}, '[]', '')",
]
_LANGUAGES_SQL = "regexp_replace({0}, '(\\n\\[\\[[a-z][a-z][\\w-]*:[^:\\]]+\\]\\])+$', '')"


def _clean_sql(source: str) -> str:
    """SELECT of (doc_id, title, text) with cleaned texts, of a SELECT of (doc_id, title, text): a step a level."""
    for step in [_LANGUAGES_SQL, *_ROUND_SQL * 3, "replace(replace({0}, '[', ''), ']', '')"]:
        source = f"SELECT doc_id, title, {step.format('text')} AS text FROM ({source})"
    return source


@query(f"SELECT doc_id, text FROM ({_clean_sql(f'SELECT doc_id, NULL AS title, {_MARKED} AS text FROM documents')})")
def o38_plain_text(spark, sf_dir):
    return _marked(spark, sf_dir).select("doc_id", T.plain_text(F.col("text")).alias("text"))


@query(f"SELECT doc_id, text FROM ({_clean_sql(f'SELECT doc_id, NULL AS title, {_WIKI_SQL} AS text FROM documents')})")
def o38_all_markup(spark, sf_dir):
    return _wiki(spark, sf_dir).select("doc_id", T.plain_text(F.col("text")).alias("text"))


@query(f"SELECT doc_id, {_LANGUAGES_SQL.format('text')} AS text FROM (SELECT doc_id, text || chr(10) || '[[' || lang || ':' || source || ']]' || chr(10) || '[[zh-yue:x]]' AS text FROM documents)")
def o24_trailing_languages(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.expr("concat(text, '\n[[', lang, ':', source, ']]\n[[zh-yue:x]]')").alias("text"))
    return d.select("doc_id", T.strip_languages(F.col("text")).alias("text"))


def _step_query(name: str, step: int, sql: str):
    def run(spark, sf_dir):
        return _wiki(spark, sf_dir).select("doc_id", F.regexp_replace("text", *map(F.lit, T.ROUND[step])).alias("text"))

    run.__name__ = name
    query(f"SELECT doc_id, {sql.format('text')} AS text FROM (SELECT doc_id, {_WIKI_SQL} AS text FROM documents)")(run)


_step_query("o35_table_lines", 12, _ROUND_SQL[12])


@query(f"SELECT doc_id, {_ROUND_SQL[7].format('text')} AS text FROM (SELECT doc_id, {_MARKED} || '[ftp://' || lang || '.org]' AS text FROM documents)")
def o31_external_links(spark, sf_dir):
    d = _marked(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").select("doc_id", F.concat("text", F.lit("[ftp://"), "lang", F.lit(".org]")).alias("text"))
    return d.select("doc_id", F.regexp_replace("text", *map(F.lit, T.ROUND[7])).alias("text"))


@query("SELECT doc_id, replace(replace(replace(t, '&lt;', '<'), '&#39;', ''''), '&amp;', '&') AS text FROM (SELECT doc_id, source || ' &lt; ' || lang || '&#39;s &amp; ' || doc_id AS t FROM documents)")
def o23_entities(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.expr("concat(source, ' &lt; ', lang, '&#39;s &amp; ', cast(doc_id as string))").alias("t"))
    return d.select("doc_id", T.decode_entities(F.col("t")).alias("text"))


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS n FROM documents WHERE length(text) > 500")
def o40_long_docs_numbered(spark, sf_dir):
    return lineage.numbered(table(spark, sf_dir, "documents").where(F.char_length("text") > 500).select("doc_id"), ["doc_id"], "n", 1)


@query("SELECT doc_id, doc_id AS member_id FROM documents")
def o05_member_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", V.member_doc_id(F.expr("concat('doc-', cast(doc_id as string), '-', source)")).alias("member_id"))


def _folder_of_archives(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("n"), F.col("source").alias("title"), "text")
    folder = scratch.folder(spark, "archives")
    archives.write(d, folder, 1 << 20)
    return folder


@query("SELECT doc_id, length(text) AS n_chars FROM documents WHERE text <> ''")
def o04_archive_scan(spark, sf_dir):
    """Also writes: the archives that it scans are made from documents."""
    return archives.scan(spark, _folder_of_archives(spark, sf_dir)).select("doc_id", F.char_length("text").cast("long").alias("n_chars"))


@query("SELECT 'doc-' || doc_id || '-' || source AS member, text FROM documents WHERE text <> ''")
def o13_archive_writer(spark, sf_dir):
    """The members of the archives that are written, read back."""
    return archives.scan(spark, _folder_of_archives(spark, sf_dir)).select("member", "text")


@query()
def o02_directory_listing(spark, sf_dir):
    return archives.listing(spark, _folder_of_archives(spark, sf_dir)).select("file_id", "length")


@query(f"SELECT row_number() OVER (ORDER BY title, text) AS n, title, length(text) AS n_chars FROM ({_clean_sql("SELECT doc_id, source || '-' || doc_id AS title, text FROM documents")}) WHERE length(text) > 500")
def o06_wiki_dump(spark, sf_dir):
    folder = scratch.folder(spark, "dump")
    pages = table(spark, sf_dir, "documents").select(F.concat_ws("-", "source", F.col("doc_id").cast("string")).alias("title"), F.struct("text").alias("revision"))
    pages.write.mode("overwrite").format("xml").option("rowTag", "page").option("rootTag", "mediawiki").save(folder)
    return archives.articles(archives.wiki_pages(spark, folder)).select("n", "title", F.char_length("text").alias("n_chars"))


@query(_INDEX)
def o07_codec_round_trip(spark, sf_dir):
    folder = scratch.folder(spark, "codec")
    codec.write(_built(spark, sf_dir), folder)
    return index.as_text(codec.read(spark, folder))


@query(_INDEX)
def o10_partitioned_writer(spark, sf_dir):
    """The whole content of the written index, read back."""
    folder = scratch.folder(spark, "index")
    index.write(_built(spark, sf_dir), folder)
    return index.as_text(spark.read.parquet(folder))


@query(f"WITH {_TF} SELECT CAST(doc_id % {SHARDS} AS INTEGER) AS shard, CAST(sum(n) AS BIGINT) AS bytes FROM (SELECT doc_id % {SHARDS} AS doc_id, term, 4 + strlen(term) + 4 + 8 * count(*) + 1 AS n FROM tf GROUP BY doc_id % {SHARDS}, term) GROUP BY ALL")
def o13c_result_listing(spark, sf_dir):
    """Bytes of the listed files of each shard: those of its records."""
    folder = scratch.folder(spark, "listed")
    codec.write(_built(spark, sf_dir), folder)
    files = archives.listing(spark, folder)
    return files.groupBy(V.parsed_file_name(F.element_at(F.split("path", "/"), -1))["shard"].cast("int").alias("shard")).agg(F.sum("length").alias("bytes"))


@query(_INDEX)
def o96_stream_index(spark, sf_dir):
    """Documents arrive in four files; the merged index of all micro-batches."""
    folder = scratch.folder(spark, "stream")
    table(spark, sf_dir, "documents").select("doc_id", "text").repartition(4).write.parquet(f"{folder}/in")
    incremental.run(incremental.document_stream(spark, f"{folder}/in"), f"{folder}", SHARDS)
    return index.as_text(incremental.merged(spark, f"{folder}"))


class _WordMapper:
    schema = "term string, n long"

    def execute(self, batch):
        words = batch["text"].fillna("").str.findall(r"[A-Za-z]+").explode().dropna().str.lower()
        c = words.value_counts()
        yield pd.DataFrame({"term": c.index, "n": c.to_numpy()})


class _SumReducer:
    schema = "term string, n long"

    def execute(self, key, rows):
        return pd.DataFrame({"term": [key[0]], "n": [rows["n"].sum()]})


@query("SELECT lower(w) AS term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM benchmark) GROUP BY ALL")
def o101_map_reduce(spark, sf_dir):
    """A user's map and re-reducible reduce function, reduced in two levels."""
    mapped = mapreduce.run_map(table(spark, sf_dir, "benchmark").select("text"), _WordMapper())
    return mapreduce.run_reduce_twice(mapped, ["term"], _SumReducer(), 2)


class _Lines:
    schema = "text string"

    def input(self):
        yield from ((f"{chr(97 + i % 7)} and 12",) for i in range(100))


class _KeyedSum(_SumReducer):
    key = ("term",)


@query("SELECT chr(CAST(97 + i % 7 AS INTEGER)) AS term, count(*) AS n FROM range(100) t(i) GROUP BY ALL UNION ALL SELECT 'and', 100")
def o09_configured_job(spark, sf_dir):
    """A job given as JSON, whose modules are loaded by name."""
    place = __name__
    return config.JobConfig.parse(json.dumps({"num-reducer": 2, "input-module": f"{place}._Lines", "map-module": f"{place}._WordMapper", "reduce-module": f"{place}._KeyedSum"})).run(spark)


class _CountPostings:
    schema = "term string, df long, total long"

    def __init__(self):
        self.now = None

    def posting(self, shard, term, doc_id, tf):
        if self.now and self.now[0] == term:
            self.now = (term, self.now[1] + 1, self.now[2] + tf)
            return
        yield from self.finish()
        self.now = (term, 1, tf)

    def finish(self):
        if self.now:
            yield self.now
        self.now = None


@query(f"WITH {_TF} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total FROM tf GROUP BY ALL")
def o103_posting_callback(spark, sf_dir):
    rows = index.term_counts(_words(spark, sf_dir)).withColumn("shard", F.lit(0))
    return mapreduce.run_callback(rows, _CountPostings)


@query("SELECT 'part-' || s_suppkey AS name, CAST(s_suppkey % 8 AS INTEGER) AS shard, s_suppkey * 10 AS bytes FROM supplier")
def o104_executable(spark, sf_dir):
    """An executable that answers each line with the report of a file it made."""
    keys = table(spark, sf_dir, "supplier").select("s_suppkey")
    return mapreduce.reported_files(mapreduce.pipe(keys, ["awk", '{print "log line"; print "=> part-" $1 " " $1 % 8 " " $1 * 10}']))


class _Squares:
    def input(self):
        yield from ((i, i * i) for i in range(100))


@query("SELECT i, i * i AS square FROM range(100) t(i)")
def o100_user_source(spark, sf_dir):
    return mapreduce.source(spark, _Squares(), "i long, square long")


@query("SELECT o_orderkey AS file_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def o54_active_files(spark, sf_dir):
    made = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file_id"))
    return lineage.active_files(made, table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("file_id")))


@query("SELECT l_orderkey AS file_id, l_linenumber AS line FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F')")
def o55_orphan_acks(spark, sf_dir):
    made = table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("file_id"))
    return lineage.orphan_acks(made, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file_id"), F.col("l_linenumber").alias("line")))


@query("SELECT o_orderkey AS tag, o_custkey AS nick FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') ")
def o56_pending_works(spark, sf_dir):
    works = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("tag"))
    asked = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("tag"))
    return lineage.pending(works, asked).select(F.col("o_orderkey").alias("tag"), F.col("tag").alias("nick"))


@query("""SELECT CAST(o_custkey % 64 AS INTEGER) AS shard, count(*) AS n_files, CAST(sum(floor(o_totalprice)) AS BIGINT) AS bytes, string_agg(o_orderkey::VARCHAR, ' ' ORDER BY o_orderkey) AS file_ids FROM orders GROUP BY ALL""")
def o53_files_by_shard(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(V.shard_of(F.col("o_custkey"), 64).alias("shard"), F.col("o_orderkey").alias("file_id"), F.floor("o_totalprice").alias("bytes"), "o_orderstatus")
    got = lineage.files_by_shard(*(o.where(c).drop("o_orderstatus") for c in ("o_orderstatus = 'F'", "o_orderstatus <> 'F'")))
    return got.withColumn("file_ids", F.array_join(F.transform("file_ids", lambda x: x.cast("string")), " "))


@query("SELECT o_orderkey AS file_id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'heir' ELSE 'm' || o_custkey END AS nick FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def o57_recovery(spark, sf_dir):
    nick = lambda c: F.concat(F.lit("m"), F.col(c).cast("string")).alias("nick")
    dead = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(nick("c_custkey"))
    return lineage.reassigned(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file_id"), nick("o_custkey")), dead, "heir").select("file_id", "nick")


@query("SELECT shard, file_id FROM (SELECT CAST(o_custkey AS INTEGER) AS shard, o_orderkey AS file_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) WHERE r <= 3")
def o62_first_files(spark, sf_dir):
    return lineage.first_files(table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("int").alias("shard"), F.col("o_orderkey").alias("file_id")), 3)


@query("SELECT s_suppkey, CAST((row_number() OVER (ORDER BY s_suppkey) - 1) % 7 AS INTEGER) AS owner FROM supplier")
def o64_round_robin(spark, sf_dir):
    return lineage.round_robin(table(spark, sf_dir, "supplier").select("s_suppkey"), ["s_suppkey"], 7)


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_name, p_partkey) AS tag FROM part")
def o65_sequence_numbers(spark, sf_dir):
    return lineage.numbered(table(spark, sf_dir, "part").select("p_name", "p_partkey"), ["p_name", "p_partkey"], "tag", 1).select("p_partkey", "tag")


@query("SELECT CAST(doc_id % 16 AS INTEGER) AS shard, count(*) AS n FROM documents GROUP BY ALL")
def o66_shards(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(V.shard_of(F.col("doc_id"), 16).alias("shard")).agg(F.count("*").alias("n"))


def _acks(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.col("event_type").alias("nick"), F.floor(F.abs(F.col("value")) * 1000).alias("bytes"), (F.pmod("event_id", F.lit(17)) + 1).alias("seconds"))


_ACKS = "acks AS (SELECT event_id, event_type AS nick, CAST(floor(abs(value) * 1000) AS BIGINT) AS bytes, event_id % 17 + 1 AS seconds FROM events)"


@query(f"WITH {_ACKS} SELECT nick, count(*) AS n_acks, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(seconds) AS BIGINT) AS seconds FROM acks GROUP BY ALL")
def o48_ack_totals(spark, sf_dir):
    return status.totals(_acks(spark, sf_dir), "nick")


@query(f"WITH {_ACKS} SELECT count(*) AS n_acks, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(seconds) AS BIGINT) AS seconds FROM acks")
def o49_process_totals(spark, sf_dir):
    return status.totals(_acks(spark, sf_dir))


@query("SELECT nick, row_number() OVER (ORDER BY nick) AS place FROM (SELECT DISTINCT event_type AS nick FROM events)")
def o60_masters_by_nick(spark, sf_dir):
    return lineage.numbered(_acks(spark, sf_dir).select("nick").distinct(), ["nick"], "place", 1)


@query()
def o108_job_status(spark, sf_dir):
    """Active jobs, stages and tasks of the session as one row of JSON."""
    return spark.createDataFrame([(json.dumps(status.job_status(spark.sparkContext.statusTracker())),)], "status string")


@query(f"WITH {_ACKS} SELECT nick, round(sum(bytes) / (sum(seconds) * 1048576), 9) AS mib_s FROM acks GROUP BY ALL")
def o50_throughput(spark, sf_dir):
    return status.throughput(_acks(spark, sf_dir), "nick").select("nick", F.round("mib_s", 9).alias("mib_s"))


@query(f"WITH {_ACKS} SELECT * FROM (SELECT nick, event_id, bytes, CAST(sum(bytes) OVER (PARTITION BY nick ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM acks) WHERE bytes <> 0")
def o67_running_throughput(spark, sf_dir):
    return status.running_total(_acks(spark, sf_dir), "nick", ["event_id"]).select("nick", "event_id", "bytes", "total")


@query("SELECT event_id, printf('%02d:%02d:%02d', s // 3600, s // 60 % 60, s % 60) AS elapsed FROM (SELECT event_id, event_id * 37 AS s FROM events)")
def o68_elapsed(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", V.elapsed(F.col("event_id") * 37).alias("elapsed"))


@query("SELECT event_id, printf('%d files, %d.00 MBs', event_id % 9, event_id * 12345 // 1048576) AS size FROM events")
def o69_size(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", V.files_and_size(F.col("event_id") % 9, F.col("event_id") * 12345).alias("size"))


@query("SELECT o_orderkey, printf('%.2f/%.2f/%.2f', a, b, a + b) AS sizes FROM (SELECT o_orderkey, o_orderkey * 16384 / 1048576 AS a, o_custkey * 32768 / 1048576 AS b FROM orders)")
def o70_size_triple(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", V.size_triple(F.col("o_orderkey") * 16384, F.col("o_custkey") * 32768).alias("sizes"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'MAP' WHEN 1 THEN 'REDUCE' WHEN 2 THEN 'MERGE' END AS phase FROM events")
def o72_phase(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", V.phase_name((F.col("event_id") % 4).cast("int")).alias("phase"))


@query("SELECT o_orderkey, printf('output-r%06d-p%018d', o_custkey % 64, o_orderkey) AS name, o_custkey % 64 AS shard, o_orderkey AS file_id FROM orders")
def o73_file_names(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", V.index_file_name(F.col("o_custkey") % 64, F.col("o_orderkey")).alias("name"))
    p = V.parsed_file_name(F.col("name"))
    return o.select("o_orderkey", "name", p["shard"].alias("shard"), p["file_id"].alias("file_id"))


@query("""SELECT event_id, '{"nick":"' || event_type || '","n":' || event_id || '}' AS message, event_type AS nick FROM events""")
def o74_messages(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.to_json(F.struct(F.col("event_type").alias("nick"), F.col("event_id").alias("n"))).alias("message"))
    return e.select("event_id", "message", F.from_json("message", "nick string, n long")["nick"].alias("nick"))


@query(r"""SELECT page_id, regexp_extract(url, '^(\w+)://', 1) AS scheme, regexp_extract(url, '^\w+://([^/:?#]*)', 1) AS host, regexp_extract(url, '^\w+://[^/]*:(\d+)', 1) AS port, regexp_extract(url, '^\w+://[^/?#]*([^?#]*)', 1) AS path FROM pages""")
def o75_url_parts(spark, sf_dir):
    p = V.url_parts(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", *(F.coalesce(p[k], F.lit("")).alias(k) for k in ("scheme", "host", "port", "path")))


@query("SELECT s_suppkey, s_name AS host, CASE WHEN s_suppkey % 3 = 0 THEN 1 ELSE CAST(s_suppkey % 5 AS INTEGER) END AS slots FROM supplier WHERE s_suppkey % 7 <> 0")
def o76_machine_lines(spark, sf_dir):
    line = F.expr("case when s_suppkey % 7 = 0 then concat('# ', s_name) when s_suppkey % 3 = 0 then s_name else concat(s_name, ':', cast(s_suppkey % 5 as string)) end")
    got = table(spark, sf_dir, "supplier").select("s_suppkey", V.machine_line(line).alias("m")).where("m is not null")
    return got.select("s_suppkey", "m.host", "m.slots")


@query("SELECT l_orderkey, l_linenumber, l_orderkey % 7 AS m, least(l_quantity, l_tax * 100) AS low, greatest(l_quantity, l_tax * 100) AS high, abs(l_quantity - 25) AS off FROM lineitem")
def o77_math(spark, sf_dir):
    q, t = F.col("l_quantity"), F.col("l_tax") * 100
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.pmod("l_orderkey", F.lit(7)).alias("m"), F.least(q, t).alias("low"), F.greatest(q, t).alias("high"), F.abs(q - 25).alias("off"))


@query("SELECT event_id, event_type AS nick, 'MAP' AS phase FROM events")
def o78_status_defaults(spark, sf_dir):
    defaults = F.create_map(F.lit("nick"), F.lit("?"), F.lit("phase"), F.lit("MAP"))
    update = F.create_map(F.lit("nick"), F.col("event_type"), F.lit("odd"), F.lit("x"))
    got = table(spark, sf_dir, "events").select("event_id", V.known_keys_merged(defaults, update).alias("m"))
    return got.select("event_id", F.col("m")["nick"].alias("nick"), F.col("m")["phase"].alias("phase"))


@query(f"""WITH {_TF}, df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL), n AS (SELECT count(*) AS n FROM documents), s AS (SELECT doc_id, term, tf, tf * ln(n::DOUBLE / df) AS score FROM tf JOIN df USING (term), n)
  SELECT doc_id, term, tf, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term) AS rank FROM s) WHERE rank <= 3""")
def tfidf_topk(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    top = index.tfidf_top_of(index.of_documents(docs, SHARDS), docs.count(), 3)
    return top.withColumn("score", F.round("score", 6)).withColumn("rank", F.col("rank").cast("long"))


@query()
def index_stemmed(spark, sf_dir):
    return index.as_text(index.stemmed(_built(spark, sf_dir)))


def _stem_query(number: int, language: str):
    def run(spark, sf_dir):
        return _words(spark, sf_dir).select("term").distinct().withColumn("stem", T.stem_udf(language)("term"))

    run.__name__ = f"o{number}_stem_{language}"
    QUERIES[run.__name__] = run


for _i, _language in enumerate(["english", "porter", *(x for x in stemmers.algorithms() if x not in ("english", "porter"))]):
    _stem_query(79 + _i, _language)
