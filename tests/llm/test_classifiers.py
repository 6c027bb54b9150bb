import numpy as np
import pytest

from verdigris.llm import quality as Q
from verdigris.llm import toxicity as T

from .conftest import sentence


def test_unseen_spellings_share_ngrams():
    clean = [sentence(i, 60) for i in range(120)]
    toxic = [" ".join(clean[i].split()[:30]) + f" you {w} " + " ".join(clean[i].split()[30:]) for i, w in enumerate(["horribleidiot", "worthlessidiot", "idiotic"] * 20)]
    table, bias = T.train(clean + toxic, np.array([0] * 120 + [1] * 60))
    from verdigris.llm.common import words_of

    seen, unseen, *other = T.word_values(words_of(["horribleidiot terribleidiot fox12 quick33 dog5 lazy90"]), table)
    assert seen > unseen > 5 and unseen > 2 * max(other)
    score = T.score_texts([clean[100], toxic[0], "", "..."], table, bias)
    assert score[0] < 0.5 < score[1] and score[2] == score[3] == 0.0


def test_toxicity_of_odd_rows(spark, odd, empty, odd_rows):
    labels = spark.createDataFrame([(100 + i, i % 2, "x") for i in range(40)] + [(None, 1, "y"), (5000, 1, None)], "doc_id long, toxic int, text string")
    rows = T.toxicity_scores(odd, labels).collect()
    assert len(rows) == len(odd_rows) and all(0 <= r["score"] <= 1 for r in rows)
    assert T.toxicity_scores(empty, labels).count() == 0
    nothing = T.toxicity_scores(odd, labels.filter("toxic = 9")).collect()
    assert {r["score"] for r in nothing} <= {0.0, 0.5}


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    for report, label, least in ((T.toxicity_report, "toxic", 0.95), (Q.quality_report, "quality", 0.95)):
        rows = report(docs, labels).filter("held_out").join(labels, "doc_id").collect()
        pos, neg = ([r["score"] for r in rows if r[label] == y] for y in (1, 0))
        auc = np.mean([[(p > n) + 0.5 * (p == n) for n in neg] for p in pos])
        assert auc > least
        right = np.mean([r["predicted"] == r[label] for r in rows])
        assert right > 0.95


def test_pu_learning_recovers_the_prior():
    rng = np.random.default_rng(5)
    pos = rng.normal(1.5, 1, (800, 6))
    unl = np.concatenate([rng.normal(1.5, 1, (700, 6)), rng.normal(-1.5, 1, (300, 6))])
    net, prior = Q.train(pos, unl)
    assert 0.55 < prior < 0.85
    assert net.score(rng.normal(1.5, 1, (200, 6))).mean() > 0.8 and net.score(rng.normal(-1.5, 1, (200, 6))).mean() < 0.3


def test_quality_of_odd_rows(spark, odd, empty, odd_rows):
    labels = spark.createDataFrame([(100 + i, 1) for i in range(40)], "doc_id long, quality int")
    rows = {(r["doc_id"]): r["score"] for r in Q.quality_scores(odd, labels).collect()}
    assert rows[1] == rows[2] == 0.0
    assert Q.quality_scores(empty, labels).count() == 0
    assert {r["score"] for r in Q.quality_scores(odd, labels.filter("quality = 0")).collect()} <= {0.0, 0.5}
    assert Q.keep_quality(odd, labels).columns == odd.columns
    assert Q.features(["", "a" * 100000, "\n" * 5, "é" * 9]).shape == (4, Q.N_FEATURES)
    assert np.isfinite(Q.features([r[1] or "" for r in odd_rows])).all()


@pytest.mark.parametrize("word", ["a", "straße", "日本", "x" * 5000])
def test_subwords_of_any_word(word):
    from verdigris.llm.common import words_of

    parts = list(T.subwords(words_of([word])))
    assert all((b >= 0).all() and (b < T.BUCKETS).all() for _, b in parts)


def test_toxicity_scores_against_loops():
    """Every word, subword and window by itself, with numbers that a model could have."""
    from verdigris.llm.common import words_of

    rng = np.random.default_rng(1)
    table = rng.normal(0, 1, T.BUCKETS).astype(np.float32)
    full, shift = 1 << 64, 64 - (T.BUCKETS.bit_length() - 1)

    def bucket(h):
        return (h * int(T._K) % full) >> shift

    def word(w):
        codes = [c + 1 for c in b"<" + w.encode() + b">"]
        found = [table[bucket(int(words_of([w]).hash[0]))]]
        for size in T.GRAMS:
            for i in range(len(codes) - size + 1):
                h = codes[i]
                for c in codes[i + 1 : i + size]:
                    h = (h * int(T._P) + c) % full
                found.append(table[bucket((h + size) % full)])
        return np.mean(found)

    import re

    texts = ["One two three", "single", "", "Ärger über straße, idiot!", sentence(3, 50), "a b " * 40]
    for text, got in zip(texts, T.score_texts(texts, table, 0.25)):
        values = [word(w) for w in re.findall(r"[a-z0-9\x80-\U0010ffff]+", text.lower())]
        windows = [np.mean(values[i : i + T.WINDOW]) for i in range(max(1, len(values) - T.WINDOW + 1))] if values else []
        want = 1 / (1 + np.exp(-(max(windows) + 0.25))) if windows else 0.0
        assert abs(got - want) < 1e-5
