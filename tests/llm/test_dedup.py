"""Operators 3 and 9 against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np

from termloom.llm import near_dedup, suffix_dedup


def naive_repeats(texts, window):
    at = Counter()
    for t in texts:
        at.update(t[i : i + window] for i in range(len(t) - window + 1))
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - window + 1):
            if at[t[i : i + window]] > 1:
                gone[i : i + window] = [True] * window
        left = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(t), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return out


def corpus(seed, n=40):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 6)))
    text = lambda k: " ".join(word() for _ in range(k))
    shared = [text(30), text(60), text(25)]
    rows = []
    for i in range(n):
        parts = [text(r.randint(0, 80))]
        for s in shared:
            if r.random() < 0.4:
                parts += [s[r.randint(0, 9) :], text(r.randint(0, 20))]
        rows.append((i, " ".join(parts)))
    rows += [(n, None), (n + 1, ""), (n + 2, "ab" * 400), (n + 3, rows[0][1]), (n + 4, "x"), (n + 5, rows[1][1][:90] + rows[1][1])]
    return rows


def test_suffix_array_and_prefixes():
    r = np.random.default_rng(1)
    for size, letters in ((1, 2), (2, 1), (50, 1), (300, 2), (400, 5)):
        t = r.integers(0, letters, size).astype(np.int16)
        want = sorted(range(size), key=lambda i: t[i:].tolist())
        got = suffix_dedup.suffix_array(t)
        assert got.tolist() == want
        lcp = suffix_dedup.common_prefixes(t, got)
        for k in range(1, size):
            a, b = t[want[k - 1] :], t[want[k] :]
            m = min(len(a), len(b))
            same = np.flatnonzero(a[:m] != b[:m])
            assert lcp[k] == (same[0] if len(same) else m)


def test_repeats_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SHARD_TEXT", 900)
    monkeypatch.setattr(suffix_dedup, "RANGE_ROWS", 200)
    for window in (60, 400):
        rows = corpus(window)
        df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, key string, g string").repartition(3)
        got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.digest(df, window).collect()}
        want = naive_repeats([(t or "").encode() for _, t in rows], window)
        assert [got[i] for i, _ in rows] == want
        assert sum(w[1] for w in want) > 0


def test_repeats_of_a_part_of_a_passage_held_in_full_by_others(spark):
    """Groups of two full copies of a passage and a text with a part of it: all are cut in full."""
    rows, r = [], random.Random(3)
    text = lambda n: "".join(r.choice("abcdefghij ") for _ in range(n))
    for _ in range(120):
        passage = text(r.randint(1000, 1600))
        size = r.randint(400, 700)
        a = r.randint(0, len(passage) - size)
        for part in (passage, passage, passage[a : a + size]):
            rows.append((len(rows), text(r.randint(0, 500)) + part + text(r.randint(0, 500))))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {x.doc_id: tuple(x)[1:] for x in suffix_dedup.digest(df, 400).collect()}
    want = naive_repeats([t.encode() for _, t in rows], 400)
    assert [got[i] for i, _ in rows] == want


def test_repeats_of_long_documents_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup.C, "BLOCK", 2000)
    rows = [(i, " ".join(t or "" for _, t in corpus(i, 12))) for i in range(3)] + [(3, corpus(1, 12)[4][1] * 3)]
    data = [t.encode() for _, t in rows]
    offs = np.concatenate(([0], np.cumsum([len(x) for x in data])))
    a = suffix_dedup.anchors(np.frombuffer(b"".join(data), np.uint8), offs, 60, 20)
    monkeypatch.undo()
    b = suffix_dedup.anchors(np.frombuffer(b"".join(data), np.uint8), offs, 60, 20)
    assert all((x == y).all() for x, y in zip(a, b, strict=True))
    assert suffix_dedup.digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_remove_repeats_keeps_columns(spark):
    rows = corpus(5)
    df = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string")
    out = suffix_dedup.remove_repeats(df, 60, ("doc_id", "text", "source"))
    got = {r.doc_id: r.text for r in out.collect()}
    assert out.columns == ["doc_id", "text", "source"] and len(got) == len(rows)
    assert got[len(rows) - 6] is None and all(len(got[i] or "") <= len(t or "") for i, t in rows)


def sets_of(rows, k):
    out = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    return out


def naive_near(rows, k, percent):
    s = sets_of(rows, k)
    parent = {i: i for i in s}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(s)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            both = len(s[i] & s[j])
            if both and 100 * both >= percent * (len(s[i]) + len(s[j]) - both):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(s[i]), find(i), find(i) == i) for i in s}


def near_rows(seed):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefgß") for _ in range(r.randint(2, 7))) for _ in range(300)]
    rows, i = [], 0
    for _ in range(25):
        base = r.choices(vocabulary, k=r.choice((1, 2, 3, 12, 40, 200)))
        for _ in range(r.choice((1, 2, 6))):
            w = list(base)
            for _ in range(r.choice((0, 0, 1, len(w) // 25, len(w) // 12))):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            rows.append((i, r.choice((" ", "\n")).join(x.upper() if r.random() < 0.2 and x.isascii() else x for x in w)))
            i += 1
    chain = r.choices(vocabulary, k=120)
    for _ in range(12):  # neighbours are linked, ends are not
        rows.append((i, " ".join(chain)))
        i += 1
        for _ in range(3):
            chain[r.randrange(120)] = r.choice(vocabulary)
    rows += [(i, None), (i + 1, ""), (i + 2, " \t\n"), (i + 3, ""), (i + 4, rows[0][1])]
    return rows


def test_near_duplicates_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 3)
    monkeypatch.setattr(near_dedup, "LARGE", 3)
    for seed, k in ((1, 2), (2, 5)):
        rows = near_rows(seed)
        df = spark.createDataFrame([(i, t, 0, "a") for i, t in rows], "doc_id long, text string, n int, key string").repartition(3)
        got = {r.doc_id: tuple(r)[1:] for r in near_dedup.near_duplicates(df, k).collect()}
        assert got == naive_near(rows, k, 80)
    assert near_dedup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
