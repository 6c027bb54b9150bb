import math
import re
from collections import Counter

import numpy as np

from verdigris.llm import lexical as X

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms(text):
    return Counter(re.findall(TERM, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")))


def brute(docs, items, k=10):
    held = [(i, terms(t)) for i, t in docs]
    held = [(i, c, c.total()) for i, c in held if c]
    n_docs, total = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c, n in held:
            m = 10 + 90 * n * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(found)[:k])]
    return out


def key(r):
    return [(x is None, x) for x in r]


def found(spark, docs, items, **named):
    got = X.ranked_search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), **named)
    return sorted((tuple(r) for r in got.collect()), key=key)


def test_against_brute_force(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    got = sorted(tuple(r) for r in X.ranked_search(docs.repartition(3), items).collect())
    assert got == sorted(brute([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()]))


def test_odd_rows(spark, odd, odd_rows, empty):
    items = [(1, "The Quick brown fox"), (2, None), (3, ""), (4, "日本語 é́"), (5, "noterm1234 here"), (5, "same text"), (None, "lead trail"), (6, "text " * 5000)]
    asked = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(r) for r in X.ranked_search(odd, asked).collect()), key=key)
    assert got == sorted(brute([r[:2] for r in odd_rows], items), key=key)
    assert X.ranked_search(empty, asked).count() == 0 and X.ranked_search(odd, asked.limit(0)).count() == 0


def test_ties_and_copies(spark):
    docs = [(i, "one two three" if i % 2 else "one two two") for i in range(500)] + [(7, "one two three")] * 3
    got = found(spark, docs, [(1, "three"), (2, "two three"), (3, "one")])
    assert got == sorted(brute(docs, [(1, "three"), (2, "two three"), (3, "one")]), key=key)


def test_long_texts_are_cut_between_terms(monkeypatch):
    monkeypatch.setattr(X, "PIECE", 7)
    for text in ("aa bbbbbbbbbbbbbbbb Cc-dd " * 20, "x" * 50, "é" * 30 + " A" * 9, "fooBarBAZ quxQUX" * 5):
        assert {t.decode(): n for t, n in X.term_counts(text.encode()).items()} == dict(terms(text))


def test_maxscore_leaves_out_nothing():
    """With any bound, exactly the documents at or above it come out, with their whole scores."""
    rng = np.random.default_rng(3)
    for _ in range(200):
        n = int(rng.integers(1, 60))
        lists = []
        for _ in range(int(rng.integers(0, 9))):
            docs = np.flatnonzero(rng.random(n) < rng.random())
            gains = rng.integers(0, 50, len(docs)) * int(rng.integers(1, 20))
            if len(docs):
                lists.append((docs, gains, int(gains.max())))
        whole = np.zeros(n, np.int64)
        for docs, gains, _ in lists:
            whole[docs] += gains
        least = int(rng.integers(0, whole.max() + 2))
        at, scores = X.best_of_shard(lists, n, least)
        assert at.tolist() == np.flatnonzero(whole >= max(1, least)).tolist() and (scores == whole[at]).all()


def test_many_shards_and_blocks(spark, sf, monkeypatch):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").limit(80).collect()]
    items = [(i, docs[i][1]) for i in range(0, 40, 3)]
    monkeypatch.setattr(X, "BLOCK_QUERIES", 4)
    monkeypatch.setattr(X, "SHARD_DOCS", 5)
    monkeypatch.setattr(X, "BROADCAST_BYTES", 10)
    assert found(spark, docs, items, k=3) == sorted(brute(docs, items, 3), key=key)
