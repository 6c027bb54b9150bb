import math
import re

from verdigris.llm import licenses as L


def brute(rows):
    """All blocks against all templates, in plain Python: {place: (n_words, starts, base, labels, score)}."""
    out = []
    for i, text in rows:
        low = (text or "").translate(str.maketrans(L.UPPER, L.LOWER))
        words = re.findall(L.WORD, low)
        starts, base, more, most = [], set(), set(), 0.0
        for phrase, label in L.PHRASES.items():
            own = phrase.split()
            at = [k for k in range(len(words)) if words[k : k + len(own)] == own]
            starts += at
            base |= {label} if at else set()
        for block in re.split(L.CUT, low):
            own = set(re.findall(L.WORD, block))
            for label, template in L.TEMPLATES:
                t = L.words_in(template)
                found = len(own & set(t))
                if found >= math.ceil(L.THRESHOLD * len(t) - 1e-9):
                    more.add(label)
                    most = max(most, found / len(t))
        out.append((i, len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)), 1.0 if starts else most))
    return out


def key(r):
    return [(x is None, x) for x in r]


def test_against_all_pairs(spark, sf, odd, odd_rows, empty):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = [tuple(r) for r in L.license_report(docs).collect()]
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert sorted(got, key=key) == sorted(want, key=key) and any(r[6] != r[5] for r in got)
    assert sorted([tuple(r) for r in L.license_report(odd).collect()], key=key) == sorted(brute([r[:2] for r in odd_rows]), key=key)
    assert L.license_report(empty).count() == 0 and L.license_report(odd, templates=(), phrases={}).filter("labels != '' OR score != 0").count() == 0


def test_shapes_of_notices(spark):
    gpl = "you can redistribute it and modify it under terms of the GNU General Public Licence as published by the Free Software Foundation"
    long = "word " * 200_000
    rows = [
        (1, "x RELEASED under the\nMIT License. more"), (2, "Released. Under the MIT? License"), (3, f"{long} {gpl} {long}"), (4, "mit-license and Apache   License apache license"),
        (5, "general public\tlicense general public public license"), (6, "Lizenz mit License. Licensed under the Apache License"), (7, "cc by nc 4 0 under licensed"), (8, "mit"), (9, "license"), (10, "MIT LICENSE"), (11, "mıt license MİT license"),
    ]
    got = {r[0]: tuple(r) for r in L.license_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {r[0]: r for r in brute(rows)}
    assert got[1][6] == "mit" and got[2][6] == "mit" and got[3][6] == "gpl" and 0.9 <= got[3][7] < 1 and got[4][2:4] == (3, 0) and got[7][6] == "cc-by-nc" and got[10][2] == 1


def test_no_python_and_few_pairs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plan = L.license_report(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|ExistingRDD", plan)


def test_other_templates_and_thresholds(spark):
    """Sets of many sizes and thresholds against all pairs, so prefixes and places of all lengths occur."""
    import random

    rng = random.Random(2)
    words = [f"w{i}" for i in range(30)]
    templates = tuple((f"t{i}", " ".join(rng.sample(words, rng.randint(1, 14)))) for i in range(40))
    blocks = [(i, k, sorted(rng.sample(words, rng.randint(1, 20)))) for i in range(60) for k in range(3)]
    df = spark.createDataFrame(blocks, "uid long, block int, words array<string>")
    for threshold in (0.3, 0.6, 0.85, 1.0):
        got = sorted((r["uid"], r["block"], r["template"], round(r["containment"], 9)) for r in L.template_pairs(df, templates, threshold).collect())
        want = []
        for uid, k, own in blocks:
            for number, (_, t) in enumerate(templates):
                t = L.words_in(t)
                found = len(set(own) & set(t))
                if found >= math.ceil(threshold * len(t) - 1e-9):
                    want.append((uid, k, number, round(found / len(t), 9)))
        assert got == sorted(want) and len(got) > 20
