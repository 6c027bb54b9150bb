import math
from collections import Counter

import numpy as np

from verdigris.llm import jaccard_join as J
from verdigris.llm.common import forest

from .conftest import sentence


def brute(rows, threshold=0.8):
    sets = [set(s.tolist()) for s in J.shingle_sets([t or "" for _, t in rows])]
    links, root = Counter(), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and len(a & b) >= threshold * len(a | b) - 1e-9:
                links[i] += 1
                links[j] += 1
                root[max(find(i), find(j))] = min(find(i), find(j))
    members = {}
    for i, (k, _) in enumerate(rows):
        members.setdefault(find(i), []).append(k)
    return sorted((k is None, k or 0, min((m for m in members[find(i)] if m is not None), default=-1), links[i]) for i, (k, _) in enumerate(rows))


def got(df):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, -1 if r["class_id"] is None else r["class_id"], r["links"]) for r in J.jaccard_report(df).collect())


def test_odd_rows(odd, odd_rows, empty):
    assert got(odd) == brute([r[:2] for r in odd_rows])
    assert J.jaccard_report(empty).count() == 0
    left = J.keep_one_of_each(odd)
    assert left.columns == odd.columns and left.count() == len(odd_rows) - 5  # a repeated row, two equal texts, two near copies


def test_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert got(docs) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_hot_group_goes_through_blocks(spark, monkeypatch):
    monkeypatch.setattr(J, "BUCKET_BLOCK", 8)
    monkeypatch.setattr(J, "VERIFY_BLOCK", 6)
    base = sentence(1, 120).split()
    rows = []
    for i in range(40):
        words = list(base)
        words[(i * 3) % 120] = f"new{i}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, sentence(50 + i, 60)) for i in range(20)] + [(200 + i, " ".join(base)) for i in range(15)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df) == brute(rows)


def test_pruning_keeps_what_reaches_the_threshold():
    needed = J.least_matches()
    assert (np.diff(needed) >= 0).all() and needed[16] < 16 and needed[J.HASHES] > 0.5 * J.HASHES
    rng = np.random.default_rng(1)
    kept = 0
    for _ in range(300):
        common, own = rng.integers(0, 2**63, 160, dtype=np.uint64), rng.integers(0, 2**63, (2, 20), dtype=np.uint64)
        sets = [np.unique(np.concatenate([common, o])) for o in own]  # similarity 0.8
        sig = np.stack([J.signature(s) for s in sets])
        kept += J.survivors(sig, np.array([len(s) for s in sets]), np.full(2, -1), 0.8, needed)[0, 1]
    assert kept == 300


def test_intersections_and_forest():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 9000, 700).astype(np.uint64)) for _ in range(12)]
    found = J.intersections(sets)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if i != j:
                assert found[i, j] == len(np.intersect1d(a, b))
    linked = np.zeros((6, 6), bool)
    linked[0, 1] = linked[1, 0] = linked[1, 2] = linked[2, 1] = linked[4, 5] = linked[5, 4] = True
    assert len(forest(linked)) == 3


def test_chance_of_losing_a_pair():
    """Of pairs of exactly the threshold, over all ten steps, as many equal values as a binomial gives."""
    needed, at, lost = J.least_matches(), {0: 1.0}, 0.0
    for n in range(J.STEP, J.HASHES + 1, J.STEP):
        after = {}
        for m, p in at.items():
            for k in range(J.STEP + 1):
                after[m + k] = after.get(m + k, 0) + p * math.comb(J.STEP, k) * 0.8**k * 0.2 ** (J.STEP - k)
        lost += sum(p for m, p in after.items() if m < needed[n])
        at = {m: p for m, p in after.items() if m >= needed[n]}
    assert lost < 1e-5


def test_dropped_pairs_are_not_verified():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 2**40, 300).astype(np.uint64)) for _ in range(2)]
    sets += [sets[0][:-5], sets[1][:-5], sets[0]]
    left = np.zeros((5, 5), bool)
    left[0, 2] = left[2, 0] = left[0, 1] = left[1, 0] = True
    found = J.reaching(sets, left, 0.8)
    assert found[0, 2] and found.sum() == 2
    assert J.reaching(sets, ~np.eye(5, dtype=bool), 0.8).sum() == 8


def test_recall_near_the_threshold(spark):
    """All pairs of similarity 0.8 to 0.85 are found, among string ids."""
    rows = []
    for i in range(150):
        words = [f"{c}{i}w{j}" for j, c in enumerate("ab" * 60)]
        rows.append((f"a{i:03d}", " ".join(words)))
        rows.append((f"b{i:03d}", " ".join([*words[:-6], *[f"new{i}x{j}" for j in range(6 + i % 4)]])))
    sets = list(J.shingle_sets([t for _, t in rows]))
    near = {i for i in range(150) if 0.8 <= len(np.intersect1d(sets[2 * i], sets[2 * i + 1])) / len(np.union1d(sets[2 * i], sets[2 * i + 1])) < 0.9}
    got = {r["doc_id"]: r["class_id"] for r in J.jaccard_report(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert len(near) > 50 and all(got[f"b{i:03d}"] == f"a{i:03d}" for i in near)
