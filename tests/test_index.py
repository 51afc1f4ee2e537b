"""Index, codec, archives, lineage, map-reduce and stream on small tables."""

import collections
import io
import tarfile
import types
import zipfile

import pandas as pd
import pytest

from termloom.functions import stemmers
from termloom.operators import codec, index, lineage, mapreduce
from termloom.sources import archives, config, scratch
from termloom.streaming import incremental


def partial(spark, rows, shard=0):
    return spark.createDataFrame([(shard, t, len(p), p) for t, p in rows], "shard int, term string, df long, postings array<struct<doc_id:long,tf:long>>")


def flat(df):
    return {(r.shard, r.term): (r.df, [tuple(p) for p in r.postings]) for r in df.collect()}


def test_merge(spark):
    a = partial(spark, [("car", [(2, 1)]), ("card", [(4, 1)]), ("x", [(6, 2)])])
    b = partial(spark, [("car", [(4, 2)]), ("card", [(2, 5)]), ("x", [(6, 3)])])
    want = {(0, "car"): (2, [(2, 1), (4, 2)]), (0, "card"): (2, [(2, 5), (4, 1)]), (0, "x"): (1, [(6, 5)])}
    assert flat(index.merge(a, b)) == want
    assert flat(index.merge(index.merge(a), b)) == want


def docs(spark):
    return spark.createDataFrame([(1, "a b a. C "), (2, "b "), (3, None), (4, ""), (5, "a\0b "), (1, "a ")], "doc_id long, text string")


def test_build_has_only_real_postings(spark):
    got = flat(index.build(index.tokens(docs(spark)), 2))
    assert got == {(1, "a"): (1, [(1, 3)]), (1, "b"): (1, [(1, 1)]), (1, "c"): (1, [(1, 1)]), (0, "b"): (1, [(2, 1)])}
    one = flat(index.build(index.tokens(docs(spark)), 1))
    assert sum(f for _, ps in one.values() for _, f in ps) == sum(f for _, ps in got.values() for _, f in ps) == 6
    assert index.build(index.tokens(docs(spark).where("false")), 2).count() == 0


def test_codec(tmp_path, spark):
    assert codec.encode_record("cat", [(2, 1), (4, 3)]).hex() == "03000000636174" + "02000000" + "0200000001000000" + "0400000003000000" + "0a"
    raw = codec.encode_record("é", [(1, 2)]) + codec.encode_record("x", [])
    assert list(codec.decode_records(raw)) == [("é", [(1, 2)]), ("x", [])]
    for bad in (raw[:-1], raw[:5], raw.replace(b"\n", b"x")):
        with pytest.raises(ValueError):
            list(codec.decode_records(bad))
    built = index.build(index.tokens(docs(spark)), 2)
    codec.write(built, str(tmp_path / "i"))
    assert flat(codec.read(spark, f"file://{tmp_path}/i")) == flat(built)


def test_a_shard_has_several_files(tmp_path, spark):
    words = spark.range(3000).selectExpr("id % 50 * 2 as doc_id", "concat('w', id % 700) as term")
    built = index.build(words, 2)  # all in shard 0
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        codec.write(built, f"file://{tmp_path}/i")
        index.write(built, f"file://{tmp_path}/p")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "i").glob("output-r000000-p*"))) > 1 and len(list((tmp_path / "p" / "shard=0").glob("*.parquet"))) > 1
    assert flat(codec.read(spark, f"file://{tmp_path}/i")) == flat(spark.read.parquet(f"file://{tmp_path}/p")) == flat(built)


def test_stemmed_counts_equal_brute_force(spark):
    d = spark.createDataFrame([(1, "running runs run runner. "), (2, "Runs RUNNING hopping hoped "), (1, "run "), (3, None)], "doc_id long, text string")
    want = collections.Counter((r.doc_id, stemmers.stem(r.term, "english")) for r in index.tokens(d).collect())
    assert {(r.doc_id, r.term): r.tf for r in index.stemmed_counts(index.tokens(d)).collect()} == want


def test_configured_job_and_shared_folders(spark):
    with pytest.raises(ValueError):
        config.JobConfig.parse('{"num-reducer": 0}')
    place = "termloom.plans.catalogue"
    job = config.JobConfig.parse(f'{{"input-module": "{place}._Lines", "map_module": "{place}._WordMapper"}}')
    assert sum(r.n for r in job.run(spark).collect()) == 200
    assert scratch.folder(spark, "x").rpartition("/")[0] == scratch.folder(spark, "y").rpartition("/")[0]
    bare = types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda k, d=None: d), sparkContext=types.SimpleNamespace(master="spark://x", getConf=dict))
    with pytest.raises(ValueError, match="checkpoint"):
        scratch.folder(bare, "z")


def test_archives(tmp_path, spark):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("doc-7-t", "seven ")
        z.writestr("doc-8-t", b"caf\xc3\xa9\xff")
        z.writestr("doc-9-t", b"\xff")
    with tarfile.open(tmp_path / "b.tar.gz", "w:gz") as t:
        info = tarfile.TarInfo("doc-x-t")
        info.size = 3
        t.addfile(info, io.BytesIO(b"tar"))
    got = {(r.doc_id, r.text) for r in archives.scan(spark, f"file://{tmp_path}").collect()}
    assert got == {(7, "seven "), (8, "café"), (0, "tar")}
    names = [(r.file_id, r.path.rsplit("/", 1)[1]) for r in archives.listing(spark, f"file://{tmp_path}").orderBy("file_id").collect()]
    assert names == [(0, "a.zip"), (1, "b.tar.gz")]


def test_archive_writer_rolls_over(spark):
    rows = [(i, f"t{i}", "word " * 400 + str(i)) for i in range(30)]
    out = archives.pack(spark.createDataFrame(rows, "n long, title string, text string").coalesce(1), 400).collect()
    assert len(out) > 3 and sum(r.n_docs for r in out) == 30 and all(r.archive.endswith(f"-{r.n_docs:06d}.zip") for r in out)
    assert archives.pack(spark.createDataFrame([], "n long, title string, text string")).count() == 0


def test_lineage(spark):
    files = spark.createDataFrame([(0, 0, 10), (0, 1, 7), (0, 3, 250), (1, 5, 64), (1, 6, 12)], "shard int, file_id long, bytes long")
    got = {r.shard: (r.n_files, r.bytes, list(r.file_ids)) for r in lineage.files_by_shard(files.where("file_id < 3"), files.where("file_id >= 3")).collect()}
    assert got == {0: (3, 267, [0, 1, 3]), 1: (2, 76, [5, 6])}
    used = spark.createDataFrame([(1,), (9,), (1,)], "file_id long")
    assert sorted(r.file_id for r in lineage.active_files(files, used).collect()) == [0, 3, 5, 6]
    assert [r.file_id for r in lineage.orphan_acks(files, used).collect()] == [9]
    n = lineage.numbered(files.repartition(3), ["file_id"], "n", 1).orderBy("n").collect()
    assert [(r.n, r.file_id) for r in n] == [(1, 0), (2, 1), (3, 3), (4, 5), (5, 6)]
    assert lineage.numbered(files.where("false"), ["file_id"]).count() == 0


def test_map_reduce(spark):
    class Sum:
        schema = "k string, n long"

        def execute(self, key, rows):
            return pd.DataFrame({"k": [key[0]], "n": [rows["n"].sum()]})

    df = spark.createDataFrame([("a", i) for i in range(50)] + [("b", 1)], "k string, n long")
    assert {tuple(r) for r in mapreduce.run_reduce(df, ["k"], Sum()).collect()} == {tuple(r) for r in mapreduce.run_reduce_twice(df, ["k"], Sum()).collect()} == {("a", 1225), ("b", 1)}
    assert mapreduce.load("termloom.operators.index.build") is index.build
    lines = mapreduce.pipe(df.select("k").coalesce(1), ["sort", "-u"])
    assert [r.line for r in lines.collect()] == ["a", "b"]
    with pytest.raises(Exception, match="ended with"):
        mapreduce.pipe(df, ["false"]).collect()


def test_stream_equals_batch(tmp_path, spark):
    d = docs(spark)
    d.repartition(3).write.parquet(f"file://{tmp_path}/in")
    seen = []
    stream = incremental.document_stream(spark, f"file://{tmp_path}/in")
    incremental.run(stream, f"file://{tmp_path}", 2, on_map_finished=seen.append)
    want = flat(index.build(index.tokens(d), 2))
    assert flat(incremental.merged(spark, f"file://{tmp_path}")) == want and len(seen) > 1
    incremental.run(stream, f"file://{tmp_path}", 2)  # nothing new
    done = []
    again = incremental.compact(spark, f"file://{tmp_path}", f"file://{tmp_path}/one", done.append)
    assert flat(again.select("shard", "term", "df", "postings")) == want and len(done) == 1
    assert {r.shard for r in lineage.result_files(f"file://{tmp_path}/one", spark).collect()} == {0, 1}


def test_tfidf(spark):
    top = index.tfidf_top(index.term_counts(index.tokens(docs(spark))), 6, 1)
    got = collections.Counter(r.doc_id for r in top.collect())
    assert got == {1: 1, 2: 1}


def test_map_side_index_equals_brute_force(spark):
    rows = [(1, "a b a. C "), (2, "b "), (3, None), (4, ""), (5, "a\0b "), (1, "a x"), (None, "a b "), (None, "a "), (9, "ΑΣ-ΣΑ İx Ǆ_1 ٣ �;"), (10, "é" * 64 + "Ab" + "c" * 9 + " A "), (11, "z" * 200_000)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    short = d.where("doc_id <> 11 or doc_id is null")
    for flush in (False, True):
        want = flat(index.build(index.tokens(short, flush), 2))
        assert flat(index.of_documents(short, 2, flush)) == want
    assert flat(index.of_documents(d, 2)) == flat(index.build(index.tokens(short), 2))
    assert flat(index.of_documents(d.where("false"), 2)) == {}
    texts = {(r.shard, r.term): r.postings for r in index.as_text(index.of_documents(short, 2)).collect()}
    assert texts[1, "a"] == "1:3" and texts[None, "a"] == "2"


def test_lists_of_blocks():
    import pyarrow as pa

    h = [1] * 4 + [2] * 3 + [3] * 5  # "y" and "x" share a hash
    rows = {"_h": h, "shard": pa.array([0] * 12, pa.int32()), "term": list("yxyx") + ["p"] * 3 + ["q"] * 5, "doc_id": [9, 4, 2, 4, 7, 7, 1, 5, 4, 3, 2, 1], "tf": [1] * 12}
    table = pa.table(rows)
    want = {"x": [(4, 2)], "y": [(2, 1), (9, 1)], "p": [(1, 1), (7, 2)], "q": [(i, 1) for i in range(1, 6)]}
    got = {r["term"]: [(p["doc_id"], p["tf"]) for p in r["postings"]] for r in index._lists(table).to_pylist()}
    assert got == want
    for size in (1, 2, 3, 5):  # a block never cuts a run of equal hashes
        for most in (1, 3, 100):
            old, index._BLOCK = index._BLOCK, most
            try:
                blocks = list(index._blocks(iter(table.to_batches(size))))
            finally:
                index._BLOCK = old
            assert sum(b.num_rows for b in blocks) == 12 and len(blocks) == (1 if most == 100 else len(blocks))
            assert {r["term"]: [(p["doc_id"], p["tf"]) for p in r["postings"]] for b in blocks for r in index._lists(b).to_pylist()} == want


def test_index_is_dealt_out_once_and_in_blocks(spark):
    d = spark.range(400).selectExpr("id * 2 as doc_id", "'the same words ' as text").coalesce(1)
    built = index.of_documents(d, 2)
    plan = built._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "ObjectHashAggregate" not in plan
    assert flat(built) == {(0, t): (400, [(2 * i, 1) for i in range(400)]) for t in ("the", "same", "words")}


def test_stemmed_index(spark):
    d = spark.createDataFrame([(1, "running runs run runner. "), (2, "Runs RUNNING hopping hoped "), (1, "run "), (3, None)], "doc_id long, text string")
    got = index.stemmed(index.of_documents(d, 2))
    assert flat(got) == flat(index.from_counts(index.stemmed_counts(index.tokens(d)), 2))
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_stats_and_best_terms_make_no_join(spark):
    words = index.term_counts(index.tokens(docs(spark)))
    assert {tuple(r) for r in index.shard_stats(words, 2).collect()} == {(0, 1, 1, 1), (1, 3, 3, 5)}
    assert {tuple(r) for r in index.document_frequency(words).collect()} == {("a", 1), ("b", 2), ("c", 1)}
    top = index.tfidf_top_of(index.of_documents(docs(spark), 2), 6, 2)
    assert "Join" not in top._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in top.collect()} == {tuple(r) for r in index.tfidf_top(words, 6, 2).collect()}


def test_codec_files_and_blocks_are_bounded(tmp_path, spark):
    words = spark.range(6000).selectExpr("id div 3 * 2 as doc_id", "concat('w', id % 7) as term")
    built = index.build(words, 2)
    codec.write(built, f"file://{tmp_path}/i", file_bytes=2000)
    assert len(list((tmp_path / "i").glob("output-r000000-p*"))) >= 7
    assert flat(codec.read(spark, f"file://{tmp_path}/i")) == flat(built)
    raw = b"".join(codec.encode_record(f"t{i}", [(j, i) for j in range(i)]) for i in range(50))
    old, codec._POSTINGS = codec._POSTINGS, 100
    try:
        blocks = [b for b in codec._decoded(3, memoryview(raw))]
        again = [r["record"] for b in blocks for e in codec._encoded(b) for r in e.to_pylist()]
    finally:
        codec._POSTINGS = old
    assert len(blocks) > 8 and max(len(b.column("postings").flatten()) for b in blocks) < 150
    assert b"".join(again) == raw
    with pytest.raises(Exception, match="32 bits"):
        codec.encode(partial(spark, [("x", [(-1, 1)])])).collect()


def test_archives_are_packed_and_unpacked_in_one_worker(tmp_path, spark, monkeypatch):
    import pyarrow as pa

    d = spark.range(200).selectExpr("id as n", "concat('t', id) as title", "case when id % 5 <> 0 then repeat(concat('w', id, ' '), 50) end as text")
    archives.write(d, f"file://{tmp_path}/z", 3000)
    got = archives.scan(spark, f"file://{tmp_path}/z")
    assert len(list((tmp_path / "z").glob("*.zip"))) > 2
    assert got._jdf.queryExecution().executedPlan().toString().count("Python") + got._jdf.queryExecution().executedPlan().toString().count("MapIn") == 1
    assert {(r.member, r.doc_id, r.text) for r in got.collect()} == {(f"doc-{r.n}-{r.title}", r.n, r.text) for r in d.where("text is not null").collect()}
    monkeypatch.setattr(archives, "FRAME_BYTES", 500)
    raw = pa.py_buffer((sorted((tmp_path / "z").glob("*.zip"))[0]).read_bytes())
    sizes = [sum(map(len, b.column("raw").to_pylist())) for b in archives._frames("p", raw)]
    assert len(sizes) > 2 and max(sizes) < 1000
