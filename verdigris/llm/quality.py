"""Text quality by learning from trusted positives and unlabelled text (non-negative PU learning).

A text is described by some thirty shape statistics: kinds of characters, word lengths, repetition, line structure.
A small network (one hidden layer) minimises the non-negative risk of Kiryo et al. 2017,

    prior * E_P[loss(+g)] + max(0, E_U[loss(-g)] - prior * E_P[loss(-g)]),

from trusted positives P and unlabelled web text U; no negative label is used. The share of positives in U is
estimated from the scores of a first classifier of P against U: for the best top part of the scores, the share of U
in it divided by the share of P (Garg et al. 2021). As that is too high while the classifier is poor, it is estimated
again from the scores of networks trained with the estimates so far. Both samples are bounded and taken by a hash of
the id; tasks send their statistics only, and scoring covers every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, bounded_batches, joined_bytes, slices, text_batches
from .toxicity import held_out, labelled_sample

MOST_POSITIVE, MOST_UNLABELLED = 3000, 6000
HIDDEN = 24
STEPS, RATE, DECAY = 500, 0.02, 1e-4
#: Times that the share of positives is estimated again.
AGAIN = 2
KEEP = 0.3

_UPPER = np.array([65 <= b <= 90 for b in range(256)])
_LOWER = np.array([97 <= b <= 122 or b >= 128 for b in range(256)])
_DIGIT = np.array([48 <= b <= 57 for b in range(256)])
_BLANK = np.array([b in b" \t\r\x0b\x0c" for b in range(256)])
_STOP = np.array([b in b".,;:?" for b in range(256)])
_ODD = np.array([33 <= b < 127 and not chr(b).isalnum() and chr(b) not in ".,;:?'\"-()" for b in range(256)])
N_FEATURES = 29


def features(texts: list[str]) -> np.ndarray:
    """Shape statistics of whole texts, one row each; an empty text has zeros."""
    parts = [_features(texts[lo:hi]) for lo, hi in slices(texts)]
    return np.concatenate(parts) if parts else np.zeros((0, N_FEATURES))


def _features(texts: list[str]) -> np.ndarray:
    data, ends = joined_bytes(texts)
    size = np.diff(ends).astype(float)

    def share(flag: np.ndarray) -> np.ndarray:
        total = np.append(0, np.cumsum(flag))
        return (total[ends[1:]] - total[ends[:-1]]) / np.maximum(size, 1)

    w = Words(data, ends)
    n = np.diff(w.bounds).astype(float)
    doc = np.repeat(np.arange(len(texts)), np.diff(w.bounds))

    def per_word(value: np.ndarray) -> np.ndarray:
        return np.bincount(doc, value, len(texts)) / np.maximum(n, 1)

    length = w.length.astype(float)
    mean = per_word(length)
    same_doc = doc[1:] == doc[:-1]
    again = np.append(False, same_doc & (w.hash[1:] == w.hash[:-1])) if len(doc) else np.zeros(0, bool)
    pair = w.hash[1:] * np.uint64(31) + w.hash[:-1] if len(doc) else w.hash

    def variety(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct values and the count of the most frequent, for each text."""
        if not len(value):
            return np.zeros(len(texts)), np.zeros(len(texts))
        order = np.lexsort((value, doc))
        d, v = doc[order], value[order]
        begins = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (v[1:] != v[:-1])))
        counts = np.diff(np.append(begins, len(v)))
        most = np.zeros(len(texts))
        np.maximum.at(most, d[begins], counts)
        return np.bincount(d[begins], minlength=len(texts)).astype(float), most

    distinct, most = variety(doc, w.hash)
    pairs, most_pair = variety(doc[1:][same_doc], pair[same_doc]) if len(doc) else (np.zeros(len(texts)),) * 2
    first = data[w.start] if len(w.start) else np.zeros(0, np.uint8)
    follows = np.minimum(w.start + w.length, len(data) - 1) if len(data) else w.start
    after = data[follows] if len(w.start) else first
    line = data == 10
    nonspace = ~_BLANK[data] & ~line
    columns = [
        np.log1p(size), np.log1p(n), mean, np.sqrt(np.maximum(0, per_word(length**2) - mean**2)),
        share(_UPPER[data]), share(_LOWER[data]), share(_DIGIT[data]), share(_BLANK[data]), share(_STOP[data]), share(_ODD[data]),
        share(data == ord("|")), share(data == ord("!")), share(line), share(data >= 128), share(nonspace),
        per_word(length == 1), per_word(length <= 3), per_word(length > 12), per_word(_UPPER[first]), per_word(_DIGIT[first]),
        per_word(_ODD[after]), per_word(_STOP[after]), per_word(again),
        distinct / np.maximum(n, 1), np.log1p(distinct) / np.log1p(np.maximum(n, 1)), most / np.maximum(n, 1),
        pairs / np.maximum(n - 1, 1), most_pair / np.maximum(n - 1, 1), np.log1p(n) / np.log1p(np.maximum(share(line) * size, 1)),
    ]
    out = np.stack(columns, 1)
    out[size == 0] = 0
    return out


class Network:
    """One hidden layer of leaky units. A statistic is read near its middle as it is and far from it, on either side,
    by its logarithm, so that texts far from all others differ still."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        n = 3 * len(mean)
        self.p = [rng.normal(0, n**-0.5, (n, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]

    def inputs(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        tails = [np.minimum(np.log1p(np.maximum(s * z, 0)), 8) / 2 for s in (1, -1)]
        return np.concatenate([np.clip(z, -2, 2) / 2, *tails], 1)

    def forward(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = z @ self.p[0] + self.p[1]
        h = np.maximum(h, 0.1 * h)
        return h, h @ self.p[2] + self.p[3][0]

    def gradient(self, z: np.ndarray, h: np.ndarray, g: np.ndarray) -> list[np.ndarray]:
        back = np.outer(g, self.p[2]) * np.where(h > 0, 1.0, 0.1)
        return [z.T @ back, back.sum(0), h.T @ g, np.array([g.sum()])]

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.forward(self.inputs(x))[1])


def _sigmoid(g: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(g, -40, 40)))


def _fit(net: Network, pos: np.ndarray, unl: np.ndarray, prior: float | None, steps: int) -> Network:
    """Adam on the non-negative risk of both whole samples; without a prior, on plain P against U.

    The sign of the risk of negatives decides each step, so it is taken over all rows: over a part it is mostly noise.
    """
    zp, zu = net.inputs(pos), net.inputs(unl)
    m, v = [np.zeros_like(p) for p in net.p], [np.zeros_like(p) for p in net.p]
    for step in range(1, steps + 1):
        (hp, gp), (hu, gu) = net.forward(zp), net.forward(zu)
        sp, su = _sigmoid(gp), _sigmoid(gu)
        if prior is None:
            dp, du = (sp - 1) / len(sp), su / len(su)
        elif np.logaddexp(0, gu).mean() >= prior * np.logaddexp(0, gp).mean():
            dp, du = (prior * (sp - 1) - prior * sp) / len(sp), su / len(su)
        else:  # the risk of negatives went below zero: step back from it
            dp, du = prior * sp / len(sp), -su / len(su)
        grads = [a + b + DECAY * p for a, b, p in zip(net.gradient(zp, hp, dp), net.gradient(zu, hu, du), net.p)]
        rate = RATE * min(1.0, 2 * (1 - step / steps) + 0.02)
        for i, g in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * g * g
            net.p[i] = net.p[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)
    return net


def class_prior(score_p: np.ndarray, score_u: np.ndarray) -> float:
    """Share of positives in U: the least ratio of the top parts of U and P over all thresholds, with its error."""
    cuts = np.quantile(score_p, np.linspace(0.05, 0.95, 37))
    p = np.array([(score_p >= c).mean() for c in cuts])
    u = np.array([(score_u >= c).mean() for c in cuts])
    slack = np.sqrt(np.log(40) / 2) * (1 / np.sqrt(len(score_p)) + 1 / np.sqrt(len(score_u)))
    best = np.argmin((u + slack) / np.maximum(p, 1e-9))
    return float(np.clip(u[best] / p[best], 0.02, 0.98))


def train(pos: np.ndarray, unl: np.ndarray, seed: int = 11) -> tuple[Network, float]:
    """The network and the share of positives in ``unl``; half of either sample is kept from the estimates' networks."""
    low, mean, high = np.quantile(pos, [0.1, 0.5, 0.9], 0)
    scale = (high - low) / 2.56 + 0.02 * np.concatenate([pos, unl]).std(0) + 1e-4
    rng = np.random.default_rng(seed)
    fold_p, fold_u = rng.random(len(pos)) < 0.5, rng.random(len(unl)) < 0.5
    if fold_p.all() or not fold_p.any():
        fold_p = np.arange(len(pos)) % 2 == 0
    if fold_u.all() or not fold_u.any():
        fold_u = np.arange(len(unl)) % 2 == 0
    test_p, test_u = pos[~fold_p] if len(pos) > 1 else pos, unl[~fold_u] if len(unl) > 1 else unl
    prior = None
    for _ in range(1 + AGAIN):
        net = _fit(Network(mean, scale, seed), pos[fold_p], unl[fold_u], prior, STEPS // 2)
        found = class_prior(net.score(test_p), net.score(test_u))
        prior = found if prior is None else min(prior, found)
    return _fit(Network(mean, scale, seed + 1), pos, unl, prior, STEPS), prior


def _describe(batches) -> Iterator:
    import pyarrow as pa

    for b in text_batches(batches, 1):
        x = features([t or "" for t in b.column(1).to_pylist()])
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(x), pa.list_(pa.float64()))], names=["y", "x"])


def _score(shared, batches) -> Iterator:
    import pyarrow as pa

    net = shared.value
    for b in text_batches(batches, 1):
        texts = [t or "" for t in b.column(1).to_pylist()]
        s = net.score(features(texts)) if net is not None else np.full(len(texts), 0.5)
        s = np.where([bool(t) for t in texts], s, 0.0)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], names=["id", "score"])


def quality_model(df: DataFrame, labels: DataFrame, text: str = "text", row_id: str = "doc_id", label: str = "quality", most_positive: int = MOST_POSITIVE, most_unlabelled: int = MOST_UNLABELLED) -> tuple[Network | None, float]:
    """The network and the estimated prior; None without positives or text. Only labels of 1 are read."""
    bounded_batches(df.sparkSession)
    trusted = labelled_sample(labels, row_id, label, 1, most_positive)
    some = df.select(F.col(row_id).alias("id")).dropna().distinct().orderBy(F.xxhash64("id", F.lit(3)), "id").limit(most_unlabelled).withColumn("y", F.lit(0))
    # Both samples have a bounded number of ids, so they are safe to broadcast. Only statistics are sorted and
    # collected; ids that many rows share cannot bring more than twice the bound.
    sample = F.broadcast(trusted.union(some))
    rows = df.select(F.col(row_id).alias("id"), F.col(text).alias("text")).join(sample, "id").select("y", "text")
    found = rows.mapInArrow(_describe, "y int, x array<double>").orderBy("y", "x").limit(2 * (most_positive + most_unlabelled)).collect()
    pos, unl = ([r["x"] for r in found if r["y"] == y] for y in (1, 0))
    if not pos or not unl:
        return None, 0.5
    return train(np.array(pos), np.array(unl))


def quality_scores(df: DataFrame, labels: DataFrame, text: str = "text", row_id: str = "doc_id", **named) -> DataFrame:
    """(row_id, score) of every row of ``df``. Pass only the labels that may be learnt.

    Null and empty texts score 0; equal rows get equal scores; without positives or text to learn from, every other
    text scores 0.5. Other columns are ignored.
    """
    net, _ = quality_model(df, labels, text, row_id, **named)
    shared = df.sparkSession.sparkContext.broadcast(net)
    kind = df.schema[row_id].dataType.simpleString()
    return df.select(F.col(row_id).alias("id"), F.col(text).alias("text")).mapInArrow(partial(_score, shared), f"id {kind}, score double").withColumnRenamed("id", row_id)


def quality_report(df: DataFrame, labels: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """(row_id, held_out, score, predicted): labels are learnt from rows that aren't held out; 0.3 or more is kept.

    Rows are treated as by ``quality_scores``; a null id is not held out.
    """
    out = held_out(F.col(row_id), 5, 0)
    scores = quality_scores(df, labels.filter(~out), text, row_id)
    return scores.select(row_id, out.alias("held_out"), "score", (F.col("score") >= KEEP).cast("int").alias("predicted"))


def _keep(shared, text_at: int, batches) -> Iterator:
    import pyarrow as pa

    net = shared.value
    for b in text_batches(batches, text_at):
        texts = [t or "" for t in b.column(text_at).to_pylist()]
        keep = (net.score(features(texts)) >= KEEP) if net is not None else np.ones(len(texts), bool)
        yield b.filter(pa.array(keep & np.array([bool(t) for t in texts])))


def keep_quality(df: DataFrame, labels: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """The rows of ``df`` whose text scores 0.3 or more; labels are learnt from rows that aren't held out.

    Null and empty texts score 0 and go. Equal rows stay or go together; columns of any name stay; very long texts are
    read whole; an empty table gives no rows. Without positives or text to learn from, all texts but empty ones stay.
    """
    net, _ = quality_model(df, labels.filter(~held_out(F.col(row_id), 5, 0)), text, row_id)
    shared = df.sparkSession.sparkContext.broadcast(net)
    return df.mapInArrow(partial(_keep, shared, df.columns.index(text)), df.schema)
