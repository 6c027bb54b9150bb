"""N-gram Jaccard self-join with Bayesian pruning of candidates (BayesLSH).

Texts are sets of five-word shingles. Texts with equal sets form a class, and the join runs over classes:

1. MinHash signatures (160 values of 16 bits) give 32 bands of five values. At a similarity of 0.8 two sets share a
   band with probability 1 - (1 - 0.8^5)^32 > 0.999996, so no pair that matters is lost here but by that chance.
2. Within a bucket, pairs compare their signatures step by step. After n values, m of them equal, a pair goes on only
   if the posterior probability (uniform prior) of a similarity of at least the threshold is not below the tolerance.
   What leaves a bucket is a spanning forest of its surviving pairs, never the pairs themselves.
3. The connected components of these forests hold every pair worth verifying. Only their classes' texts are read
   again. Within a component, in blocks, the pairs that pruning leaves are verified exactly: where they are many, by
   products of incidence matrices, else one by one. So a pair that was dropped stays dropped, and links are those of
   verified pairs only.
4. Tasks return, for each class, its number of verified links, and a forest of them; components of that are groups.

A bucket or component of more classes than a block is split into pairs of blocks, each a row group of its own, so a
hot group is many tasks. Exact copies are one class and cost nothing; near copies are compared, as each may link.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_scan, bounded_batches, components, forest, grouped, located, mix, powers, row_bitmaps, shared_table, slices, text_batches, with_marks, without_marked, words_of

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 5
HASHES = BANDS * ROWS
#: A candidate is dropped when the probability that it reaches the threshold falls below this. It is asked ten times;
#: a pair of exactly 0.8 is dropped at any of them with a probability below 1e-5 (see the tests).
TOLERANCE = 5e-7
STEP = 16
#: Classes of a bucket, and of a component, that are compared in one piece.
BUCKET_BLOCK, VERIFY_BLOCK = 512, 256

_RNG = np.random.default_rng(99)
_A = (_RNG.integers(1, 2**32, HASHES, dtype=np.uint32) | np.uint32(1))[:, None]
_B = _RNG.integers(0, 2**32, HASHES, dtype=np.uint32)[:, None]
_COMBINE = powers(np.uint64(0xA0761D6478BD642F), SHINGLE)


def shingle_sets(texts: list[str], width: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words has one shingle, of all its words."""
    combine = _COMBINE if width == SHINGLE else powers(np.uint64(0xA0761D6478BD642F), width)
    for lo, hi in slices(texts):
        words = words_of(texts[lo:hi])
        n = max(0, len(words.hash) - width + 1)
        rolled = np.zeros(n, np.uint64)
        for j in range(width):
            rolled += words.hash[j : j + n] * combine[j]
        rolled = mix(rolled)
        for d in range(hi - lo):
            a, b = words.bounds[d], words.bounds[d + 1]
            if b - a >= width:
                yield np.unique(rolled[a : b - width + 1])
            elif b > a:
                yield mix((words.hash[a:b] * combine[: b - a]).sum(keepdims=True) + np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """160 MinHash values, cut to 16 bits."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(x), 4096):
        np.minimum(least, (_A * x[lo : lo + 4096] + _B).min(axis=1), out=least)
    return (mix(least.astype(np.uint64)) & np.uint64(0xFFFF)).astype("<u2")


def least_matches(hashes: int = HASHES, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> np.ndarray:
    """For n = 0..hashes, the fewest equal values with which a pair goes on.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1), and its mass above t is P(Binomial(n + 1, t) <= m).
    """
    out = np.zeros(hashes + 1, np.int64)
    for n in range(hashes + 1):
        mass = 0.0
        for m in range(n + 1):
            mass += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if mass >= tolerance:
                out[n] = m
                break
    return out


def survivors(sig: np.ndarray, sizes: np.ndarray, block: np.ndarray, threshold: float, needed: np.ndarray) -> np.ndarray:
    """The symmetric matrix of pairs that Bayesian pruning leaves; ``block`` is -1 for all pairs, else 0 or 1."""
    n = len(sig)
    linked = np.zeros((n, n), bool)
    i, j = np.triu_indices(n, 1)
    small, large = np.minimum(sizes[i], sizes[j]), np.maximum(sizes[i], sizes[j])
    go = (small >= threshold * large) & ((block[i] < 0) | (block[i] != block[j]))
    i, j = i[go], j[go]
    equal = np.zeros(len(i), np.int64)
    for lo in range(0, sig.shape[1], STEP):
        for a in range(0, len(i), 1 << 16):
            part = slice(a, a + (1 << 16))
            equal[part] += (sig[i[part], lo : lo + STEP] == sig[j[part], lo : lo + STEP]).sum(axis=1)
        go = equal >= needed[min(lo + STEP, sig.shape[1])]
        i, j, equal = i[go], j[go], equal[go]
    linked[i, j] = linked[j, i] = True
    return linked


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, exactly, by slices of the incidence matrix of shared shingles."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(counts > 1) - 1
    shared = counts[column] > 1
    owner, column = owner[shared], number[column[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float64)
    width = 4096
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, (lo, lo + width))
        dense = np.zeros((len(sets), width), np.float32)
        dense[owner[a:b], column[a:b] - lo] = 1
        used = np.flatnonzero(dense.any(axis=1))
        out[np.ix_(used, used)] += dense[used] @ dense[used].T
    return out


def _signatures(batches) -> Iterator:
    import pyarrow as pa

    for b in text_batches(batches, 3):
        texts = [t or "" for t in b.column(3).to_pylist()]
        k1, k2, n, sig = [], [], [], []
        for s in shingle_sets(texts):
            n.append(len(s))
            k1.append(int(mix(s).sum().astype(np.int64)) if len(s) else 0)
            k2.append(int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum().astype(np.int64)) if len(s) else 0)
            sig.append(signature(s).tobytes() if len(s) else b"")
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(n, pa.int32()), pa.array(sig, pa.binary())], names=["_file", "_row", "id", "k1", "k2", "n", "sig"])


def _prune(threshold: float, batches) -> Iterator:
    import pyarrow as pa

    needed = least_matches(HASHES, threshold)
    for t in grouped(batches, ["key", "bi", "bj"]):
        src, dst = [], []
        keys = np.stack([t[c].to_numpy() for c in ("key", "bi", "bj")], 1)
        cid, size, own = t["cid"].to_numpy(), t["n"].to_numpy(), t["own"].to_numpy()
        sig = np.frombuffer(b"".join(t["sig"].to_pylist()), "<u2").reshape(len(cid), HASHES)
        edges = np.append(np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(1))), len(cid))
        for a, b in zip(edges[:-1], edges[1:]):
            same = keys[a, 1] == keys[a, 2]
            block = np.full(b - a, -1) if same else (own[a:b] == keys[a, 1]).astype(np.int64)
            for u, v in forest(survivors(sig[a:b], size[a:b], block, threshold, needed)):
                src.append(cid[a + u])
                dst.append(cid[a + v])
        if src:
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])


def _shingles(batches) -> Iterator:
    import pyarrow as pa

    for b in text_batches(batches, 2):
        sets = [s.tobytes() for s in shingle_sets([t or "" for t in b.column(2).to_pylist()])]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sets, pa.binary())], names=["_file", "_row", "sets"])


def reaching(sets: list[np.ndarray], left: np.ndarray, threshold: float) -> np.ndarray:
    """The symmetric matrix of pairs of ``left`` (a symmetric matrix) whose sets reach the threshold, exactly."""
    n = len(sets)
    linked = np.zeros((n, n), bool)
    i, j = np.nonzero(np.triu(left))
    if not len(i):
        return linked
    if len(i) > 2 * n:
        common = intersections(sets)[i, j]
    else:
        common = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i.tolist(), j.tolist())], np.float64)
    size = np.array([len(s) for s in sets], np.float64)
    reach = common >= threshold * (size[i] + size[j] - common) - 1e-9
    i, j = i[reach], j[reach]
    linked[i, j] = linked[j, i] = True
    return linked


def _verify(threshold: float, batches) -> Iterator:
    import pyarrow as pa

    needed = least_matches(HASHES, threshold)
    for t in grouped(batches, ["component", "bi", "bj"]):
        out: list = []
        keys = np.stack([t[c].to_numpy() for c in ("component", "bi", "bj")], 1)
        cid, own, copies = t["cid"].to_numpy(), t["own"].to_numpy(), t["copies"].to_numpy()
        sets = [np.frombuffer(s, np.uint64) for s in t["sets"].to_pylist()]
        sig = np.frombuffer(b"".join(t["sig"].to_pylist()), "<u2").reshape(len(cid), HASHES)
        size = np.array([len(s) for s in sets])
        edges = np.append(np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(1))), len(cid))
        for a, b in zip(edges[:-1], edges[1:]):
            block = np.full(b - a, -1) if keys[a, 1] == keys[a, 2] else (own[a:b] == keys[a, 1]).astype(np.int64)
            linked = reaching(sets[a:b], survivors(sig[a:b], size[a:b], block, threshold, needed), threshold)
            links, texts = linked @ copies[a:b], linked.sum(1)
            out += [(int(cid[a + u]), int(links[u]), int(texts[u]), None, None) for u in np.flatnonzero(texts)]
            out += [(None, None, None, int(cid[a + u]), int(cid[a + v])) for u, v in forest(linked)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["cid", "links", "texts", "src", "dst"])


def _cells(df: DataFrame, key: str, count: str, block: int, salt: int) -> DataFrame:
    """Deal the members of each key to the pairs of blocks (bi <= bj) that they are in; ``own`` is a member's block."""
    blocks = F.ceil(F.col(count) / block).cast("int")
    df = df.withColumn("_blocks", blocks).withColumn("own", F.pmod(F.xxhash64("cid", F.lit(salt)), F.col("_blocks")).cast("int"))
    df = df.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return df.withColumn("bi", F.least("own", "_other")).withColumn("bj", F.greatest("own", "_other")).drop("_blocks", "_other", count)


def jaccard_groups(df: DataFrame, text: str = "text", row_id: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """Groups and links of similar texts, one row for each row of ``df``.

    Columns: _file, _row, id, uid (unique), cid (the class of equal shingle sets; null for texts without words),
    copies (rows of the class), root (the least cid of the group), links (other rows with a similarity of at least
    the threshold) and linked_texts (other classes with it).

    Words are maximal runs of ASCII letters and digits and of characters beyond ASCII, in lower case. Texts of one to
    four words have one shingle of all their words; null texts and texts without words have no links and are groups
    of their own. Very long texts are read whole. Equal rows are in one class. An empty table gives no rows. Other
    columns, whatever their names, are ignored; ids may be of any type that has an order.
    """
    bounded_batches(df.sparkSession)
    rows = located(as_scan(df), [F.col(row_id).alias("id"), F.col(text).alias("text")])
    kind = df.schema[row_id].dataType.simpleString()
    signed = rows.select("_file", "_row", "id", "text").mapInArrow(_signatures, f"_file string, _row long, id {kind}, k1 long, k2 long, n int, sig binary")
    signed = shared_table(signed.withColumn("uid", F.monotonically_increasing_id()), "signatures")
    classes = signed.filter("n > 0").groupBy("k1", "k2", "n", "sig").agg(F.min("uid").alias("cid"), F.count(F.lit(1)).alias("copies"))
    classes = shared_table(classes, "classes")

    band = F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band")
    bands = classes.select("cid", "sig", band).select("cid", F.xxhash64(F.substring("sig", F.col("band") * (2 * ROWS) + 1, F.lit(2 * ROWS)), "band").alias("key"))
    several = bands.groupBy("key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    dealt = _cells(bands.join(several, "key"), "key", "members", BUCKET_BLOCK, 1)
    dealt = dealt.join(classes.select("cid", "n", "sig"), "cid")
    dealt = dealt.repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj", "cid")
    edges = dealt.select("key", "bi", "bj", "own", "cid", "n", "sig").mapInArrow(partial(_prune, threshold), "src long, dst long")
    candidates = shared_table(components(edges), "candidates")

    # Read again the texts of one row of each class that has a candidate.
    sizes = candidates.groupBy("component").agg(F.count(F.lit(1)).alias("members"))
    wanted = candidates.join(sizes, "component").join(signed.select("_file", "_row", F.col("uid").alias("node")), "node").join(classes.select(F.col("cid").alias("node"), "copies", "sig"), "node")
    wanted = shared_table(wanted.withColumnRenamed("node", "cid"), "wanted")
    bitmaps = shared_table(row_bitmaps(wanted), "marks")
    sets = with_marks(rows, bitmaps).filter("_marked").select("_file", "_row", "text").mapInArrow(_shingles, "_file string, _row long, sets binary")
    dealt = _cells(wanted.join(sets, ["_file", "_row"]), "component", "members", VERIFY_BLOCK, 2)
    dealt = dealt.repartition("component", "bi", "bj").sortWithinPartitions("component", "bi", "bj", "cid")
    verified = dealt.select("component", "bi", "bj", "own", "cid", "copies", "sig", "sets").mapInArrow(partial(_verify, threshold), "cid long, links long, texts long, src long, dst long")
    verified = shared_table(verified, "verified")
    links = verified.filter("cid IS NOT NULL").groupBy("cid").agg(F.sum("links").alias("links"), F.sum("texts").alias("texts"))
    groups = components(verified.filter("src IS NOT NULL").select("src", "dst"))
    facts = classes.select("k1", "k2", F.col("n"), "cid", "copies").join(links, "cid", "left").join(groups.withColumnsRenamed({"node": "cid", "component": "root"}), "cid", "left")
    facts = facts.select("k1", "k2", "n", "cid", "copies", F.coalesce("root", "cid").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("texts", F.lit(0)).alias("linked_texts"))
    facts = shared_table(facts, "classes")
    out = signed.drop("sig").join(facts, ["k1", "k2", "n"], "left")
    zero = F.lit(0).cast("long")
    return out.select("_file", "_row", "id", "uid", "cid", F.coalesce("copies", F.lit(1).cast("long")).alias("copies"), F.coalesce("root", "uid").alias("root"), F.coalesce("links", zero).alias("links"), F.coalesce("linked_texts", zero).alias("linked_texts"))


def jaccard_report(df: DataFrame, text: str = "text", row_id: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """(row_id, class_id, copy_id, copies, links, linked_texts) of every row.

    class_id is the least id of the group that links make, copy_id the least id of the rows with an equal shingle
    set, copies their number, links the number of other rows at or above the threshold. Rows are treated as by
    ``jaccard_groups``; where all ids of a group are null, its class_id is.
    """
    found = shared_table(jaccard_groups(df, text, row_id, threshold), "groups")
    copy = found.groupBy(F.coalesce("cid", "uid").alias("own"), "root").agg(F.min("id").alias("copy_id"))
    group = copy.groupBy("root").agg(F.min("copy_id").alias("class_id"))
    names = shared_table(copy.join(group, "root").drop("root"), "names")
    return found.withColumn("own", F.coalesce("cid", "uid")).join(names, "own").select(F.col("id").alias(row_id), "class_id", "copy_id", "copies", "links", "linked_texts")


def keep_one_of_each(df: DataFrame, text: str = "text", row_id: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """``df`` with one row of each group of similar texts: the one of least id (nulls last), then first in the scan.

    Rows are treated as by ``jaccard_groups``: null texts and texts without words all stay. All columns stay, whatever
    their names.
    """
    df = as_scan(df)
    found = shared_table(jaccard_groups(df, text, row_id, threshold), "groups")
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "uid")).alias("keep")
    keep = found.groupBy("root").agg(best).select(F.col("keep.uid").alias("uid"))
    dropped = found.select("_file", "_row", "uid").join(keep, "uid", "left_anti")
    return without_marked(df, shared_table(row_bitmaps(dropped), "dropped"))
