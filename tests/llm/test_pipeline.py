"""Each stage of the pipeline against brute force on what the stage before it kept."""

import random
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
from test_dedup import naive_near
from test_ops import naive_lines

from termloom.llm import bpe, language_id

SF = "/root/testdata/sf0.001"


def cut(texts, window):
    at = Counter()
    for t in texts:
        at.update(t[i : i + window] for i in range(len(t) - window + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - window + 1):
            if at[t[i : i + window]] > 1:
                gone[i : i + window] = True
        out.append(np.frombuffer(t, np.uint8)[~gone].tobytes().decode("utf-8", "ignore"))
    return out


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    odd = [(900001, None, "en", "x", None), (900002, "", None, None, 0), (900003, "12 34", "en", "x", 5), (900004, "Of the and that with one of them is here.", None, None, 41)]
    docs = docs.union(spark.createDataFrame(odd, docs.schema))
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    now = spark.read.parquet(f"file://{tmp_path}/documents.parquet")
    kept = {}
    for name, apply in corpus_pipeline.STAGES:
        apply(spark, now, str(tmp_path)).write.parquet(f"file://{tmp_path}/{name}")
        before, now = now, spark.read.parquet(f"file://{tmp_path}/{name}")
        rows, got = [(r.doc_id, r.text) for r in before.select("doc_id", "text").collect()], now.collect()
        kept[name] = len({r.doc_id for r in got})
        if name != "packing":
            assert set(now.columns) == set(corpus_pipeline.COLUMNS)
            assert all(r.n_chars == len(r.text) for r in got if name in ("line_dedup", "suffix_dedup"))
            got = {r.doc_id: r.text for r in got}
        if name == "language_id":
            model = language_id.Classifier(language_id.learn(before))
            want = {d: t for d, t in rows if t and any(c.isalpha() for c in t) and not model.predict(t.lower().encode())[2]}
            assert 900004 in want and len(rows) - 12 <= len(want) <= len(rows) - 3
        elif name == "line_dedup":
            want = {d: t for d, (_, n, t) in naive_lines(rows, 10).items() if not n or t.strip(" ")}
        elif name == "near_dedup":
            first = naive_near(rows, 5, 80)
            want = {d: t for d, t in rows if first[d][2]}
        elif name == "suffix_dedup":
            want = {d: t for (d, _), t in zip(rows, cut([t.encode() for _, t in rows], corpus_pipeline.PASSAGE), strict=True) if t.strip(" ")}
        else:
            lib = bpe.Tokenizer.from_file(bpe.default_path("word_bpe_49k.json"))
            want, sequences = {d: len(lib.encode(t, add_special_tokens=False).ids) + 1 for d, t in rows}, defaultdict(int)
            sizes = defaultdict(int)
            for r in got:
                sizes[r.doc_id] += r.length
                sequences[r.sequence_id] += r.length
            got = dict(sizes)
            assert max(sequences.values()) <= 4096 and len(sequences) <= -(-sum(want.values()) // 4096) + 2
        assert got == want, name
    assert kept["packing"] == kept["suffix_dedup"] < kept["near_dedup"] <= kept["line_dedup"] <= kept["language_id"]


def test_passages_of_over_50_words_are_cut(spark, tmp_path):
    """In two documents or more, amid other words; documents that share shorter ones stay whole."""
    r = random.Random(9)
    word = lambda: "".join(r.choice("aeinorst") for _ in range(r.choice((2, 3, 4, 5, 6, 8))))
    text = lambda n: " ".join(word() for _ in range(n))
    long, short = [text(51) for _ in range(20)], [text(15) for _ in range(20)]
    rows = [(i, f"{text(60)} {(long if i < 60 else short)[i % 20]} {text(60)}", "en", "s", 0) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {x.doc_id: x.text for x in corpus_pipeline.stage_suffix_dedup(spark, docs, str(tmp_path)).collect()}
    assert all(long[i % 20][5:-5] not in got[i] and len(got[i].split()) <= 122 for i in range(60))
    assert all(got[i] == rows[i][1] for i in range(60, 120))


def test_run_equals_its_stages_on_an_empty_table(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*corpus_pipeline.COLUMNS).where("false")
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0
