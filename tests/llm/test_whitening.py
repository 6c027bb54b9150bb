import numpy as np
import pytest

from verdigris.llm import whitening as W


def numbers(rows):
    return [(i, [int(np.floor(1024 * float(c))) + 100_000 for c in v]) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]


def test_jacobi_against_numpy():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 40):
        a = rng.normal(size=(n, n))
        a = a @ a.T
        values, vectors = W.jacobi(a)
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], rtol=1e-10) and np.allclose(vectors @ np.diag(values) @ vectors.T, a, atol=1e-10 * np.abs(a).max())
        assert np.allclose(vectors.T @ vectors, np.eye(n), atol=1e-13)
    scaled = np.diag(10.0 ** -np.arange(0, 12, 2)) @ (np.eye(6) + 0.1) @ np.diag(10.0 ** -np.arange(0, 12, 2))
    exact = 1e-20 * np.linalg.det(np.eye(6) + 0.1) / np.linalg.det((np.eye(6) + 0.1)[:5, :5])  # of the last given the others
    assert W.jacobi(scaled)[0][-1] == pytest.approx(exact, rel=1e-6)  # twenty orders below the largest
    assert (W.jacobi(np.zeros((3, 3)))[0] == 0).all()


def test_against_brute_force(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = numbers([(r["vec_id"], r["embedding"]) for r in df.collect()])
    x = np.array([v for _, v in rows], np.int64)
    n, s = len(x), x.sum(axis=0)
    off = x - s / n
    values, vectors = np.linalg.eigh(off.T @ off / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    white = off @ vectors[:, :8] / np.sqrt(values[:8])
    deviation = ((n * x - s) ** 2).sum(axis=1)
    got = W.whitening_report(df).collect()
    assert len(got) == 8 * n
    place = {i: k for k, (i, _) in enumerate(rows)}
    signs = {}
    for r in got:
        k, c = place[r["vec_id"]], r["component"] - 1
        want = white[k, c] * signs.setdefault(c, np.sign(white[k, c] * r["whitened"]))
        assert r["whitened"] == pytest.approx(want, abs=1e-7) and r["deviation"] == deviation[k] and r["n"] == n
        assert r["explained"] == pytest.approx(values[c] / values.sum(), rel=1e-9) and r["identity_error"] < 1e-9


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0, 3.0], 7), (2, None, 1), (3, [], 1), (4, [1.0, None, 2.0], 1), (5, [nan, 1.0, 1.0], 1), (6, [inf, 1.0, 1.0], None), (None, [0.5, -1.0, 3.0], 1), (1, [1.0, 2.0, 3.0], 7), (8, [0.25, 5.0, 3.0], 1), (9, [1.0, 2.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, x int")
    got = W.whitening_report(df).collect()
    # the third entry is constant, so there are two components; repeated rows and null ids are rows like others
    assert sorted((r["vec_id"] or 0, r["component"]) for r in got) == sorted((i, c) for i in (0, 1, 1, 8) for c in (1, 2))
    assert {r["n"] for r in got} == {4} and all(r["identity_error"] < 1e-9 for r in got)
    assert W.whitening_report(df.filter("vec_id = 8")).count() == 0 and W.whitening_report(df.limit(0)).count() == 0
    white, fit = W.whiten(df.filter("vec_id = 8"))
    assert white.count() == 1 and fit["n"] == 1 and fit["matrix"].shape == (3, 0)
    far = spark.createDataFrame([(1, [1e30, 0.0]), (2, [-1e300, 1.0]), (3, [2.0, 2.0])], "vec_id int, embedding array<double>")
    assert all(r["deviation"] is None or r["deviation"] >= 0 for r in W.whitening_report(far).collect())


def test_exact_deviations_of_large_sums(spark):
    rows = [(i, [float(i * 1000), float(-i)]) for i in range(200)]
    got = {r["vec_id"]: r["deviation"] for r in W.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))[0].withColumnRenamed("id", "vec_id").collect()}
    x = [[int(c * 1024) + 100_000 for c in v] for _, v in rows]
    s = [sum(c) for c in zip(*x)]
    want = {i: sum((200 * c - t) ** 2 for c, t in zip(v, s)) for (i, _), v in zip(rows, x)}
    assert got == {i: d if d < 1 << 63 else None for i, d in want.items()} and 0 < list(got.values()).count(None) < 200
