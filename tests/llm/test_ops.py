"""Operators 2, 4, 5, 6, 7, 8, 10 against brute force or the library."""

import bisect
import collections
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
import zstandard

from termloom.llm import bpe, common, html_text, language_id, language_model, line_dedup, packing, simhash

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    odd = [(900001, None, "en"), (900002, "", None), (900003, " \n\t", "en"), (900004, "I'll  say it　́ <|endoftext|> é\x1c!\x1cA  \n\n x", "en"), (900005, "Σας ΟΔΟΣ İ ﬁ 👍🏽 \x00 ", None), (900006, "a" * 9000 + " b" * 9000, "en"), (900006, "a", "en")]
    return df.union(spark.createDataFrame(odd, df.schema)).repartition(3)


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_bpe_equals_library(spark, docs):
    path = bpe.default_path("byte_bpe_50k.json")
    lib = bpe.Tokenizer.from_file(path)
    want = collections.Counter()
    for d, t in rows_of(docs):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want[d, len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False))] += 1
    assert collections.Counter(map(tuple, bpe.digest(docs, path).collect())) == want
    back = bpe.decode(bpe.encode(docs, path), path)
    assert collections.Counter((r.doc_id, r.text) for r in back.collect()) == collections.Counter((d, t or "") for d, t in rows_of(docs))
    f = bpe.loaded(path)
    r = random.Random(4)
    for _ in range(3000):
        t = "".join(r.choice("ab 'sS\n\t\x0b\u0085  1é!?-ßĠ中👍́") for _ in range(r.randint(0, 14)))
        assert f.encode(t) == lib.encode(t, add_special_tokens=False).ids, repr(t)


def test_packing(spark, docs):
    path = bpe.default_path("word_bpe_49k.json")
    lib = bpe.Tokenizer.from_file(path)
    r = random.Random(4)
    ids = packing.Ids(path)
    for _ in range(3000):
        t = "".join(r.choice("abAB 'sS\n\t\x0b\u0085 1é!?-ßΣİ中👍́") for _ in range(r.randint(0, 14)))
        assert np.frombuffer(ids(t), "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids, repr(t)
    got = packing.pack(docs, path).collect()
    want = collections.Counter()
    for d, t in rows_of(docs):
        x = lib.encode(t or "", add_special_tokens=False).ids + [1]
        for i in range(0, len(x), 4096):
            p = x[i : i + 4096]
            want[d, i // 4096, i, len(p), zlib.crc32(np.array(p, "<u4").tobytes())] += 1
    assert collections.Counter(tuple(x)[:5] for x in got) == want
    seqs = collections.defaultdict(list)
    for x in got:
        seqs[x.sequence_id].append((x.offset, x.length))
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 4096
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), path).count() == 0


def best_fit_counts(sizes, length):
    """Gaps left by best fit one piece at a time, longest first."""
    gaps = []
    for s in sorted(sizes, reverse=True):
        at = bisect.bisect_left(gaps, s)
        gap = gaps.pop(at) if at < len(gaps) else length
        bisect.insort(gaps, gap - s)
    return gaps


def test_gap_runs_equal_best_fit_piece_by_piece():
    r = np.random.default_rng(3)
    for length, sizes in ((4096, r.integers(1, 4097, 3000)), (4096, np.minimum(r.lognormal(6, 1, 9000).astype(int) + 1, 4096)), (4096, np.full(100, 1366)), (50, r.integers(1, 51, 400)), (9, np.ones(5, int)), (7, np.array([7, 7, 3])), (5, np.zeros(0, int))):
        runs = packing.gap_runs(np.bincount(sizes, minlength=length + 1), length)
        order = np.sort(sizes)[::-1]
        filled = collections.defaultdict(list)
        for place, size in enumerate(order.tolist()):
            f, sequence, each, offset, own = runs[np.searchsorted(runs[:, 0], place, "right") - 1].tolist()
            assert own == size
            filled[sequence + (place - f) // each].append((offset + (place - f) % each * size, size))
        for parts in filled.values():
            parts.sort()
            assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))]
        assert sorted(length - sum(n for _, n in x) for x in filled.values()) == best_fit_counts(sizes.tolist(), length)


def test_packing_of_equal_pieces_over_partitions(spark):
    """Rows alike in all columns, clashing names, null ids: one packing, no sequence wasted."""
    path = bpe.default_path("word_bpe_49k.json")
    rows = [(None if i % 50 == 0 else i % 7, "same words here " * (1 + i % 3 * 300), 5, "x", 1) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length int, _p string, piece int").repartition(7)
    got = packing.pack(df, path).collect()
    sizes = [x.length for x in got]
    lib = bpe.Tokenizer.from_file(path)
    size = {t: len(lib.encode(t, add_special_tokens=False).ids) + 1 for t in {x[1] for x in rows}}
    assert collections.Counter(sizes) == collections.Counter(size[x[1]] for x in rows)
    assert len({(x.sequence_id, x.offset) for x in got}) == len(got)
    assert len({x.sequence_id for x in got}) == len(best_fit_counts(sizes, 4096))


def test_packing_ids_of_all_code_points():
    """Those that the library may class otherwise go through it; the others are compared in context."""
    ids = packing.Ids(bpe.default_path("word_bpe_49k.json"))
    own = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and not ids.whole.search(chr(c))]
    assert 40_000 < len(own) < 60_000 and max(own) < 0x10000
    for at in range(0, len(own), 8000):
        texts = [" | ".join(x.format(chr(c)) for x in ("{}", "a{}b", "1{}2", "!{}!", " {} ", "e{}", "'{}s", "{}\u0301", "A{0}{0}Z")) for c in own[at : at + 8000]]
        for t, e in zip(texts, ids.tok.encode_batch(texts, add_special_tokens=False), strict=True):
            assert np.frombuffer(ids(t), "<u4").tolist() == e.ids, repr(t)


def naive_lines(rows, least):
    order = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0))
    seen, out = [], {}

    def alike(a, b):
        if abs(len(a) - len(b)) > 1:
            return False
        i = 0
        while i < min(len(a), len(b)) and a[i] == b[i]:
            i += 1
        return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :] or a == b

    for d, t in order:
        if t is None:
            out[d] = (0, 0, None)
            continue
        left, parts = [], t.split("\n")
        for x in parts:
            if len(x) >= least and any(alike(x, y) for y in seen):
                seen.append(x)
                continue
            if len(x) >= least:
                seen.append(x)
            left.append(x)
        out[d] = (len(parts), len(parts) - len(left), "\n".join(left))
    return out


def test_line_dedup_equals_brute_force(spark):
    r = random.Random(8)
    base = ["".join(r.choice("aab ") for _ in range(r.randint(3, 14))) for _ in range(25)]

    def edit(x):
        for _ in range(r.choice((0, 0, 1, 1, 2))):
            i = r.randrange(len(x) + 1)
            x = r.choice((x[:i] + r.choice("ab👍é") + x[i:], x[:i] + x[i + 1 :], x[:i] + "c" + x[i + 1 :]))
        return x

    rows = [(i, "\n".join(edit(r.choice(base)) for _ in range(r.randint(1, 7)))) for i in range(60)]
    rows += [(60, None), (61, ""), (62, "\n\n"), (63, "x" * 5000), (64, "x" * 5001)]
    df = spark.createDataFrame([(i, t, 5, "z") for i, t in rows], "doc_id long, text string, id int, line string").repartition(3)
    got = {x.doc_id: (x.n_lines, x.n_dropped, x.text) for x in line_dedup.remove_lines(df, 6).collect()}
    want = naive_lines(rows, 6)
    assert got == want and sum(x[1] for x in want.values()) > 30
    assert line_dedup.remove_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_line_dedup_of_short_lines(spark):
    texts = [(1, "Les.\nLes\n\n \nLes."), (2, "Les\n\n \nLess\nThe same line"), (3, "Less\n👍\n👍\nThe same lin"), (4, "abcdefghi\nabcdefghij"), (5, None)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    got = {x.doc_id: (x.n_lines, x.n_dropped, x.text) for x in line_dedup.remove_lines(df, short=True).collect()}
    assert got == {1: (5, 1, "Les.\nLes\n\n "), 2: (5, 1, "\n \nLess\nThe same line"), 3: (4, 3, "👍"), 4: (2, 0, "abcdefghi\nabcdefghij"), 5: (0, 0, None)}


def test_line_dedup_query_drops_every_exact_repeat(spark):
    seen, want = set(), {}
    for d, t in sorted(rows_of(spark.read.parquet(f"{SF}/documents.parquet"))):
        lines = (t or "").split("\n")
        want[d] = sum(x in seen or seen.add(x) is not None for x in lines if x.strip())
    got = {x.doc_id: x.n_dropped for x in line_dedup.op2_line_dedup(spark, SF).collect()}
    assert set(got) == set(want) and all(got[d] >= n for d, n in want.items()) and sum(want.values()) > 0


def naive_lm(rows):
    tok = {}
    for i, (d, t) in enumerate(rows):
        tok[i] = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]
    train = [i for i, (d, _) in enumerate(rows) if zlib.crc32(str(d).encode()) % 7 != 2]
    c = collections.Counter(w for i in train for w in tok[i])
    return tok, c, sum(c.values()), len(c)


def test_language_model(spark, docs):
    rows = rows_of(docs)
    tok, c, n, v = naive_lm(rows)
    want = collections.Counter()
    for i, (d, _) in enumerate(rows):
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tok[i])
        want[d, zlib.crc32(str(d).encode()) % 7 == 2, len(tok[i]), sum(c[w] > 0 for w in tok[i]), n, round(base, 4)] += 1
    got = language_model.scores(docs).collect()
    assert collections.Counter((*tuple(r)[:5], round(r.base_score, 4)) for r in got) == want
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert language_model.scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def naive_scores(rows):
    """Score of each row by deleted interpolation over plain dictionaries; weights by unrounded EM as well."""
    tok, c, n, v = naive_lm(rows)
    train = [i for i, (d, _) in enumerate(rows) if zlib.crc32(str(d).encode()) % 7 != 2]
    pairs = {i: list(zip(["<"] + tok[i][:-1], tok[i], strict=True)) for i in tok}
    c2, cu = collections.Counter(), collections.Counter()
    for i in train:
        c2.update(pairs[i])
        cu.update(u for u, _ in pairs[i])
    bucket = lambda k: min(int(math.log2(k + 1)), language_model.BUCKETS - 1)
    held, codes = [], collections.Counter()
    for i in train:
        own2, ownu, own = collections.Counter(pairs[i]), collections.Counter(u for u, _ in pairs[i]), collections.Counter(tok[i])
        for u, w in pairs[i]:
            k = cu[u] - ownu[u]
            p = (c2[u, w] - own2[u, w]) / k if k else 0.0, (c[w] - own[w]) / max(n - len(tok[i]), 1)
            held.append((bucket(k), *p))
            q = [int(language_model.rounded(np.array([x]))[0]) for x in p]
            codes[bucket(k) << 32 | q[0] << 16 | q[1]] += 1
    lam = language_model.interpolation(list(codes.items()), v)
    b, p = np.array([x[0] for x in held]), np.array([(*x[1:], 1 / (v + 1)) for x in held])
    exact = np.full((language_model.BUCKETS, 3), 1 / 3)
    for _ in range(language_model.STEPS):
        share = exact[b] * p
        share /= share.sum(axis=1)[:, None]
        new = np.stack([np.bincount(b, share[:, k], language_model.BUCKETS) for k in range(3)], axis=1) + [0, 0, 1e-3]
        exact = new / new.sum(axis=1)[:, None]
    out = collections.Counter()
    for i, (d, _) in enumerate(rows):
        x = 0.0
        for u, w in pairs[i]:
            a = lam[bucket(cu[u])]
            x += math.log10(a[0] * c2[u, w] / max(cu[u], 1) + a[1] * c[w] / n + a[2] / (v + 1))
        out[d, round(x, 4)] += 1
    return out, lam, exact, np.bincount(b, minlength=language_model.BUCKETS)


def test_language_model_scores_equal_brute_force(spark, docs):
    want, lam, exact, held = naive_scores(rows_of(docs))
    assert collections.Counter((r.doc_id, round(r.score, 4)) for r in language_model.scores(docs).collect()) == want
    # rounding moves the weights little
    many = held > 500
    assert many.sum() > 5 and np.abs(lam - exact)[many].max() < 0.02


def test_language_model_probabilities():
    x = np.sort(np.random.default_rng(0).integers(0, 1 << 63, 500).astype(np.uint64))
    assert (common.unpack_keys(common.pack_keys(x)) == x).all()
    lam = language_model.interpolation([((3 << 32) | (9 << 16) | 30, 50), ((3 << 32) | 30, 50), (0xFFFF << 16 | 40, 5)], 1000)
    assert np.allclose(lam.sum(axis=1), 1) and lam[0, 0] == 0 and (lam >= 0).all() and lam[3, 0] > 0.2
    # with and without held-out rows the probabilities of all words after any context add up to 1
    c = np.array([5, 3, 2])
    for lam in (lam, language_model.interpolation([], 3), language_model.interpolation([(0, 5)], 3)):
        for seen in (np.zeros(3), np.array([1, 0, 0]), np.array([2, 1, 0])):
            w = lam[language_model._bucket(np.array([seen.sum()]).astype(int))[0]]
            p = w[0] * seen / max(seen.sum(), 1) + w[1] * c / c.sum()
            assert abs(p.sum() + w[2] - 1) < 1e-12
    assert (language_model.interpolation([], 0)[:, 2] == 1).all()


def test_language_model_edges(spark):
    """Null ids train, repeated rows count each, a table without training rows is uniform."""
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    rows = [(None, "a b a", "x", 1), (None, "a b a", "x", 1), (held, "a b", "y", 2), (held, None, None, 3), (1 if held != 1 else 3, "", "z", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, train string, shard int").repartition(3)
    got = language_model.scores(df).collect()
    assert sorted((r.doc_id is None, r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in got) == sorted([(True, False, 4, 4, 9)] * 2 + [(False, True, 3, 3, 9), (False, True, 1, 1, 9), (False, False, 1, 1, 9)])
    none = language_model.scores(df.where(f"doc_id = {held}")).collect()
    assert sorted(r.score for r in none) == [0.0, 0.0] and {r.train_tokens for r in none} == {0}


def test_language_id(spark, docs):
    model = language_id.learn(docs.where(language_id.fold() != 0))
    assert set(model) <= {"en", "de", "fr", "es"} and all(len(x) <= language_id.DICTIONARY_BYTES for x in model.values())
    got = language_id.identify(docs, model, ("doc_id", "lang", "text")).collect()
    assert len(got) == docs.count()
    assert all(0 <= r.score <= 1 for r in got)
    assert all((r.lang_pred == "und") == (not any(ch.isalpha() for ch in r.text or "")) for r in got)
    known = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and r.lang and r.text and len(r.text) > 100]
    assert sum(r.lang == r.lang_pred for r in known) >= 0.95 * len(known)
    assert {r.lang_pred for r in language_id.identify(docs, {}, ("doc_id",)).collect()} == {"und"}


def plain_sizes(model, raw):
    """By one-shot compressions with fresh compressors."""
    n, out = language_id.BLOCK_BYTES, []
    parts = [raw[i : i + n] for i in range(0, len(raw), n)]
    if len(parts) > 1 and len(parts[-1]) < n // 4:
        parts[-2:] = [parts[-2] + parts[-1]]
    for d in model.values():
        d = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        p = zstandard.ZstdCompressionParameters.from_level(language_id.LEVEL, write_content_size=0, write_checksum=0, write_dict_id=0)
        d.precompute_compress(compression_params=p)
        out.append(sum(len(zstandard.ZstdCompressor(dict_data=d, compression_params=p).compress(x)) for x in parts))
    return out


def test_language_id_equals_plain_recompression(spark, docs):
    model = language_id.learn(docs.where(language_id.fold() != 0))
    names, checked = list(model), 0
    for r in language_id.identify(docs, model, ("doc_id", "text")).collect():
        if r.lang_pred == "und":
            continue
        s = plain_sizes(model, r.text.lower().encode())
        a, b = sorted(s)[:2]
        if a < b:
            m = (b - a) / a
            assert r.lang_pred == names[s.index(a)] and r.rejected == (m < language_id.MARGIN) and abs(r.score - m / (m + language_id.MARGIN)) < 1e-12
            checked += 1
    assert checked > 100


def test_language_id_rejects_what_was_not_learned(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("char_length(text) > 300")
    kept = {}
    for left in (None, "de", "es"):
        model = language_id.learn(docs.where(language_id.fold() != 0).where(f"lang <> '{left}'" if left else "true"))
        asked = docs.where(language_id.fold() == 0).where(f"lang = '{left}'" if left else "true")
        got = language_id.identify(asked, model, ("doc_id",)).collect()
        kept[left] = sum(not r.rejected for r in got) / len(got)
    assert kept[None] > 0.97 and max(kept["de"], kept["es"]) < 0.15
    model = language_id.Classifier(language_id.learn(docs))
    texts = {r.lang: r.text for r in docs.groupBy("lang").agg({"text": "min"}).toDF("lang", "text").collect()}
    mixed = "".join(texts[lang][i : i + 40] for i in range(0, 240, 40) for lang in ("de", "en", "es", "fr"))
    assert model.predict(mixed.lower().encode())[1] < 0.8


def test_language_id_learns_from_whole_texts():
    assert language_id.shares([10, 1000, 5000, 3], 1013) == [10, 500, 500, 3] and language_id.shares([], 9) == []
    raw = bytes(range(256)) * 40
    got = language_id.spread(raw, 2048)
    assert got[:256] == raw[:256] and got[-256:] == raw[-256:] and len(got) == 8 * 256 + 7 and language_id.spread(b"ab", 9) == b"ab"


def test_language_id_edges(spark):
    rows = [(1, "Der Hund und die Katze.", "de", "a", 1.0), (None, "The cat and the dog.", "en", "b", 2.0), (1, "Der Hund und die Katze.", "de", "a", 1.0), (2, None, None, "c", 3.0), (3, "", "en", None, 4.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, _text string, h double").repartition(2)
    model = language_id.learn(df)
    assert model == {"de": b"der hund und die katze.", "en": b"the cat and the dog."}
    got = language_id.identify(df, model, ("doc_id", "_text", "h")).collect()
    assert sorted((r._text or "", r.lang_pred) for r in got) == [("", "und"), ("a", "de"), ("a", "de"), ("b", "en"), ("c", "und")]
    assert language_id.learn(df.where("lang is null")) == {} and language_id.learn(df.where("false")) == {}
    assert language_id.identify(df.where("false"), model).count() == 0


def test_html():
    w = html_text.Weights(iter(["<body><nav><a>x y</a></nav><article><h1>A b c</h1><p>d e f g</article><footer>q r s t</footer></body>"] * 5))
    page = """<!DOCTYPE html><html><head><title>T x</title><script>var a="</p><article>";</script></head><body><nav><ul><li><a href="/a">menu one</a></li></ul></nav>
    <div class="ad">Buy this now, it is a very long advertisement indeed.</div><article><h1>Head&nbsp;line</h1><p>One <b>bo</b>ld &amp; two
    lines<br>more<p>Second &lt;par&gt;.<aside>side note</aside><ul><li>i1<li>i2</ul><pre>a  b</pre></article><section class="comments"><p>A reader says some words here.</p></section><form>name <input></form><footer>&copy; all of it, every word</footer>"""
    assert html_text.extract(page, w) == "Head line\nOne bold & two lines more\nSecond <par>.\ni1\ni2\na b"
    assert html_text.extract(None, w) == html_text.extract("", w) == html_text.extract("<p></p>", w) == ""
    assert html_text.best_region([-1, 2, 3, -1, 2, -9, 5]) == (1, 5)


def test_html_of_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r.text for r in html_text.main_text(pages, html_text.learn(pages)).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)(?:</article>|\Z)", r.html, re.S)[1]
        blocks = [" ".join(html_text.html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert got[r.page_id] == "\n".join(x for x in blocks if x)


ARTICLE = "<h1>Title of it</h1><p>One two three four five six seven eight nine ten. And many more words follow here so that it is an article of some size.</p><p>Second paragraph with words and words and words, at least as many as are in the first one.</p>"
ARTICLE_TEXT = "\n".join(re.findall(r">([^<]+)<", ARTICLE))
MENU = '<nav><ul><li><a href="/a">menu one</a></li><li><a href="/b">menu two</a></li></ul></nav>'


@pytest.fixture(scope="module")
def weights(spark):
    return html_text.learn(spark.read.parquet(f"{SF}/pages.parquet"))


@pytest.mark.parametrize("around", ['<div class="content has-sidebar">', '<div class="no-sidebar main-content">', '<div class="entry search-result">', '<div class="post-header-wrap">', '<div class="share-price-article">', '<div class="navigation-guide">', '<section class="comments-open post">', '<form id="aspnetForm">', "<div>", "<article>", '<main id="main">', '<div hidden class="page">', '<div id="articleBody">'])
def test_html_of_named_containers(weights, around):
    name = re.match(r"<(\w+)", around)[1]
    plain = MENU, "<footer>copy right words</footer>"
    more = '<div id="header"><a>Site name</a></div>' + MENU, '<div class="sidebar"><p>some words at the side</p></div><div id="comments"><p>A reader says that this is all very good and so on.</p></div><div class="cookie-notice">We use cookies</div><div class="newsletterSignup">Get it</div><article class="comment"><p>Me too.</p></article>'
    for before, after in (plain, more):
        assert html_text.extract(f"<html><body>{before}{around}{ARTICLE}</{name}>{after}</body></html>", weights) == ARTICLE_TEXT


def test_html_of_two_articles(weights):
    links = "<ul>" + '<li><a href="/x">other link</a></li>' * 6 + "</ul>"
    got = html_text.extract(f"<body>{MENU}<article>{ARTICLE}{ARTICLE}</article>{links}<article>{ARTICLE}</article><footer>end</footer></body>", weights)
    assert got.count("Title of it") == 3


def test_html_of_malformed_tags(weights):
    p = "<p>Enough words to be kept as one paragraph of the page, whatever comes.</p>"
    for page, want in (
        ('<p>a < b and c <d> e &lt;f</p>', "a < b and c e <f"),
        ("<p title=\"a > b\" data-x='<b>x</b>'>one <b class=x>two</b></p>", "one two"),
        ('<p>one <a title="x>link</a> two</p>', "one link two"),
        ('<p>one <a title="x>link</a> two <a href="y">three</a></p>', "one link two three"),
        ("<p>one</p><!-- two --><!--> three <!-- four", "one\nthree"),
        ("<p>one<script>if (a < b) { '</p>' }</SCRIPT > two<style>p", "one two"),
        ("<p>one</b></i> two</x><br/>three</p", "one two three"),
        ("<ul><li>one<li>two<b>!</ul>", "one\ntwo!"),
        ("<p>one<![CDATA[ <b>x ]]> two<?php x ?> three</>", "one two three"),
    ):
        assert html_text.extract(page, html_text.Weights()) == want, page
        assert html_text.extract(p + page, weights).startswith("Enough words")


def test_html_in_linear_time(weights):
    for page in ("<a " * 350_000 + '"', '<a t="' * 180_000, "<a t='x\">" * 120_000, "<div>" * 90_000 + "</b>" * 90_000, "<b>" * 100_000 + "<div>" + "</b>" * 100_000 + "<p>x" * 50_000, "<!--" * 250_000, "<" * 1_000_000, "<ul><li>" * 60_000 + "</ul>" * 60_000, "<script>" * 120_000, "&amp;" * 200_000):
        start = time.perf_counter()
        html_text.extract(page, weights)
        assert time.perf_counter() - start < 8
    assert html_text.extract("<p>" + "word " * 300_000 + "</p>", weights) == "word " * 299_999 + "word"


def test_html_scan_equals_brute_force():
    r = random.Random(3)
    for _ in range(300):
        x = [r.randint(-5, 5) for _ in range(r.randint(0, 12))]
        a, b = html_text.best_region(x)
        sums = [sum(x[i:j]) for i in range(len(x)) for j in range(i + 1, len(x) + 1)]
        assert sum(x[a:b]) == max([0, *sums])


def test_html_rows(spark, weights):
    rows = [(1, "u", "<p>one two</p>", "x"), (1, "u", "<p>one two</p>", "x"), (None, None, None, "y"), (2, None, "", "z"), (3, "v", "<nav>a</nav>", "w")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(3)
    got = collections.Counter(map(tuple, html_text.main_text(df, weights).collect()))
    assert got == collections.Counter({(1, "u", "one two", 7): 2, (None, None, "", 0): 1, (2, None, "", 0): 1, (3, "v", "", 0): 1})
    empty = df.where("false")
    assert html_text.main_text(empty, html_text.learn(empty)).count() == 0


def test_simhash(spark, docs):
    got = simhash.compare_edited(docs.select("doc_id", "text", "lang")).collect()
    rows = {(d, t or "") for d, t in rows_of(docs)}
    assert len(got) == docs.count()
    by_id = collections.defaultdict(set)
    for d, t in rows:
        by_id[d].add(t)
    single = sorted(d for d in by_id if len(by_id[d]) == 1)
    res = {r.doc_id: r for r in got}
    ids = sorted(by_id)
    for d in single:
        nxt = ids[(ids.index(d) + 1) % len(ids)]
        if len(by_id[nxt]) > 1:
            continue
        t, u = next(iter(by_id[d])), next(iter(by_id[nxt]))
        q = len(t) // 4
        assert (res[d].n_chars, res[d].edited_sha256) == (len(t), sha(t[: len(t) - q] + u[:q]))
    assert sum(r.near_edited > r.near_next for r in got) > 0.9 * len(got)


def test_simhash_neighbours_equal_brute_force(spark):
    r = random.Random(2)
    prints = []
    for _ in range(40):
        x = r.getrandbits(128)
        prints += [x ^ sum(1 << r.randrange(128) for _ in range(r.choice((0, 1, 2, 5)))) for _ in range(3)]
    prints = list(dict.fromkeys(prints))
    sign = lambda v: v - (1 << 64) if v >> 63 else v
    df = spark.createDataFrame([(i, sign(x >> 64), sign(x & (1 << 64) - 1)) for i, x in enumerate(prints)], "id long, f_0 long, f_1 long")
    got = {tuple(x) for x in simhash.neighbours(df, 3).collect()}
    assert got == {(i, j) for i in range(len(prints)) for j in range(i + 1, len(prints)) if (prints[i] ^ prints[j]).bit_count() <= 3}


def test_edited_chain_equals_brute_force_over_partitions(spark):
    r = random.Random(6)
    texts = ["".join(r.choice("ab é👍\n") for _ in range(r.randint(0, 30))) for _ in range(30)]
    rows = [(None if i < 2 else i // 2, r.choice([None, *texts]), "x") for i in range(60)] + [(5, "same text", "y")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, key string").repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = collections.Counter((x.doc_id, x.n_chars, x.edited_sha256) for x in simhash.compare_edited(df).collect())
        assert simhash.compare_edited(df.where("doc_id = 5 and text = 'same text'")).select("near_next").distinct().collect()[0][0] == 1.0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    keyed = {(d, k): t or "" for d, t, k in ((x.doc_id, x.text, x.k) for x in df.selectExpr("doc_id", "text", "xxhash64(doc_id, coalesce(text, '')) k").collect())}
    order = sorted(keyed, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    edited = {}
    for a, b in zip(order, order[1:] + order[:1], strict=True):
        t, q = keyed[a], len(keyed[a]) // 4
        edited[a[0], t] = sha(t[: len(t) - q] + keyed[b][:q])
    assert got == collections.Counter((d, len(t or ""), edited[d, t or ""]) for d, t, _ in rows)
    assert simhash.compare_edited(df.where("false")).count() == 0
