"""Whitening of embeddings with a cyclic Jacobi eigensolver.

1. One pass counts the vectors and sums their whole-number entries, exactly.
2. One pass sums the centred products: entries are taken off the nearest whole number to their mean, so products are
   whole numbers too and their sums in double precision are exact below 2^53; what the rounded mean is off is taken
   from the sum afterwards. Each task sends the upper triangle, which Spark adds up by cell.
3. The driver, which sees nothing but that matrix, applies Jacobi rotations in cyclic order until every entry off the
   diagonal is nothing beside the two on it. That stop is relative to the pair, so small eigenvalues are accurate too.
4. The whitening matrix, one column for each component, is broadcast and every vector is projected on it.
"""

from __future__ import annotations

from decimal import Decimal
from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_table

#: An entry of a vector becomes floor(SCALE * entry) + OFFSET.
SCALE, OFFSET = 1024, 100_000
#: Beyond this, entries are held to it, so they and their differences fit in a long.
FAR = 1 << 61
#: Entries of more than so many dimensions are refused: the driver and every task hold a square matrix of them.
MOST_DIMENSIONS = 4096
SWEEPS, EPS = 60, np.finfo(np.float64).eps
#: An eigenvalue below this part of the largest is taken for none: its component has no direction of its own.
NO_VALUE = 1e-13


def jacobi(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and its unit eigenvectors in the columns of a second matrix."""
    a = np.array(matrix, np.float64)
    n = len(a)
    vectors = np.eye(n)
    least = np.finfo(np.float64).tiny
    for _ in range(SWEEPS):
        turned = False
        for p in range(n - 1):
            for q in range(p + 1, n):
                x = a[p, q]
                if abs(x) <= EPS * np.sqrt(abs(a[p, p] * a[q, q])) or abs(x) <= least:
                    continue
                turned = True
                theta = (a[q, q] - a[p, p]) / (2 * x)
                t = np.copysign(1.0, theta) / (abs(theta) + np.hypot(theta, 1.0))
                c = 1 / np.hypot(t, 1.0)
                turn = np.array([[c, t * c], [-t * c, c]])
                end_p, end_q = a[p, p] - t * x, a[q, q] + t * x
                a[:, [p, q]] = a[:, [p, q]] @ turn
                a[[p, q], :] = a[:, [p, q]].T
                a[p, p], a[q, q], a[p, q], a[q, p] = end_p, end_q, 0.0, 0.0
                vectors[:, [p, q]] = vectors[:, [p, q]] @ turn
        if not turned:
            break
    values = np.diag(a)
    order = np.argsort(-values, kind="stable")
    vectors = vectors[:, order]
    return values[order], vectors / np.linalg.norm(vectors, axis=0)


def whole_numbers(vector: Column) -> Column:
    """The entries as whole numbers; null for a vector that is null or has a null, a non-finite or no entry."""
    def whole(c: Column) -> Column:
        return F.least(F.greatest(F.floor(c.cast("double") * SCALE), F.lit(-FAR)), F.lit(FAR)) + OFFSET

    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    return F.when((F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True)), F.transform(vector, whole))


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _sums(batches):
    """Sums of whole numbers over a task: one row for each dimension."""
    import pyarrow as pa

    total = None
    for b in batches:
        if b.num_rows:
            x = _matrix(b.column(0))
            s = (x if np.abs(x).max() * len(x) < FAR else x.astype(object)).sum(axis=0).tolist()
            total = s if total is None else [t + v for t, v in zip(total, s)]
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(map(Decimal, total), pa.decimal128(38, 0))], names=["i", "s"])


def _products(center: np.ndarray, batches):
    """Sums of centred products over a task: one row for each cell of the upper triangle."""
    import pyarrow as pa

    total = None
    for b in batches:
        if b.num_rows:
            y = (_matrix(b.column(0)) - center).astype(np.float64)
            total = y.T @ y if total is None else total + y.T @ y
    if total is not None:
        i, j = np.triu_indices(len(total))
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], names=["i", "j", "value"])


def _projected(n: int, whole: np.ndarray, rest: np.ndarray, matrix, batches):
    """``whole`` are the means, rounded, and ``rest`` is n times what they are off."""
    import pyarrow as pa

    w = matrix.value
    for b in batches:
        y = _matrix(b.column(1)) - whole
        white = (y - rest / n) @ w
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * w.shape[1], pa.int32()), pa.array(white.ravel()))
        most = (float(np.abs(y).max(initial=0)) + 1) * n
        far = ((y if most**2 * max(1, y.shape[1]) < FAR else y.astype(object)) * n - rest) ** 2
        off = [d if d < 1 << 63 else None for d in far.sum(axis=1).tolist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(off, pa.int64()), lists], names=["id", "deviation", "white"])


def _symmetric(cells: list, d: int) -> np.ndarray:
    out = np.zeros((d, d))
    for r in cells:
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["value"]
    return out


def _scatter(numbers: DataFrame, column: str, center: np.ndarray) -> list:
    cells = numbers.select(column).mapInArrow(partial(_products, center), "i int, j int, value double")
    return cells.groupBy("i", "j").agg(F.sum("value").alias("value")).collect()  # a square of the dimensions


def whiten(df: DataFrame, vector: str = "embedding", row_id: str = "vec_id", components: int = 8) -> tuple[DataFrame, dict]:
    """Whitened vectors of ``df``: (id, deviation, white), and what was fitted.

    x has a vector's entries as whole numbers. white has its first components, each with mean 0 and variance 1 over all
    rows; deviation is the sum over all dimensions of (n * x - sum of x) squared, exact (null where beyond a long). The
    fit has n, sums (of x), values and vectors (all eigenvalues and unit eigenvectors of the covariance, falling),
    explained (shares of its trace) and matrix.

    Rows drop out whose vector is null or empty, holds a null or non-finite entry, or hasn't the length that most
    vectors have (the longer one, where two are as frequent). Entries beyond ``FAR`` are held to it. Ids may be null and
    repeat; each row is fitted and returned by itself. Components without variance (of constant dimensions, or of fewer
    vectors than dimensions) are left out, so one vector has none. An empty table gives no rows. Other columns,
    whatever their names, are ignored.
    """
    kind = df.schema[row_id].dataType.simpleString()
    rows = df.select(F.col(row_id).alias("id"), whole_numbers(F.col(vector)).alias("x")).filter("x IS NOT NULL")
    rows = shared_table(rows, "vectors")
    lengths = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    d, n = (lengths["d"], lengths["n"]) if lengths else (0, 0)
    if d > MOST_DIMENSIONS:
        raise ValueError(f"vectors have {d} entries; at most {MOST_DIMENSIONS} can be whitened")
    rows = rows.filter(F.size("x") == d)
    sums = [0] * d
    for r in rows.select("x").mapInArrow(_sums, "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s")).collect():
        sums[r["i"]] = int(r["s"])
    whole = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
    rest = np.array([s - n * int(m) for s, m in zip(sums, whole)], np.int64)
    covariance = _symmetric(_scatter(rows, "x", whole), d) / max(1, n) - np.outer(rest / max(1, n), rest / max(1, n))
    values, vectors = jacobi(covariance)
    trace = float(np.trace(covariance))
    kept = min(components, int((values > NO_VALUE * max([0.0, *values[:1]])).sum()))
    matrix = vectors[:, :kept] / np.sqrt(values[:kept])
    fit = {"n": n, "sums": sums, "values": values, "vectors": vectors, "explained": values / trace if trace > 0 else values, "matrix": matrix}
    white = rows.mapInArrow(partial(_projected, n, whole, rest, df.sparkSession.sparkContext.broadcast(matrix)), f"id {kind}, deviation bigint, white array<double>")
    return white, fit


def identity_error(white: DataFrame, n: int, components: int) -> float:
    """The largest absolute entry of the covariance of whitened vectors, less the identity."""
    if not components:
        return 0.0
    sums = white.select(F.posexplode("white").alias("i", "c")).groupBy("i").agg(F.sum("c").alias("s")).collect()
    mean = np.zeros(components)
    for r in sums:
        mean[r["i"]] = r["s"] / n
    covariance = _symmetric(_scatter(white, "white", mean), components) / n
    return float(np.abs(covariance - np.eye(components)).max())


def whitening_report(df: DataFrame, vector: str = "embedding", row_id: str = "vec_id", components: int = 8) -> DataFrame:
    """(row_id, component, n, deviation, whitened, explained, identity_error) of each row and component.

    Rows are treated as by ``whiten``.
    """
    white, fit = whiten(df, vector, row_id, components)
    white = shared_table(white, "whitened")
    kept = fit["matrix"].shape[1]
    error = identity_error(white, fit["n"], kept)
    out = white.select("id", "deviation", F.posexplode("white").alias("c", "whitened"))
    explained = F.array(*[F.lit(float(e)) for e in fit["explained"][:kept]]).cast("array<double>")
    facts = [F.lit(fit["n"]).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("c")).alias("explained"), F.lit(error).alias("identity_error")]
    return out.select(F.col("id").alias(row_id), (F.col("c") + 1).alias("component"), *facts)
