"""Document fingerprints from closed syncmers.

A k-mer of characters is a closed syncmer when the least of its s-mers, by hash, is its first or its last. Whether
it is chosen depends on its own characters alone, so the same passage gives the same anchors in any document. A
fingerprint keeps the anchors of least hash (a bottom-m sketch), each with the place where it first stands, so two
fingerprints can be compared by position: shared anchors count when they stand in the same order in both texts,
however far edits have shifted them. All texts have the same k: each gets k - 1 marks before and after it, numbered by
their distance from it, so a short text has anchors too, and those of a passage at either edge tell that it is there.

Fingerprints are computed in Arrow batches. For a text and its neighbour in the order of ids, the rows are dealt to
ranges of ids, each with one row more, the first of the next range; no window runs over the whole table.
"""

from __future__ import annotations

import hashlib
import json
import math
from bisect import bisect_left
from collections.abc import Iterator
from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, mix, powers, slices, text_batches

K, S = 14, 6
#: Anchors that a fingerprint keeps. The likeness of two sketches is off from that of all anchors by about
#: sqrt(p * (1 - p) / 48), at most 0.072 (one standard error).
ANCHORS = 48
#: Shifts that differ by less than so many characters count as one diagonal, in any order.
BAND = 32
#: Rows of a range of ids, about, and the most ranges.
RANGE_ROWS, MOST_RANGES = 4000, 65536
_BASE = np.uint64(0xD6E8FEB86659FD93)


def _rolling(codes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n codes."""
    out = np.zeros(max(0, len(codes) - n + 1), np.uint64)
    for j, p in enumerate(powers(_BASE, n)):
        out += codes[j : j + len(out)] * p
    return mix(out)


def _window_min(x: np.ndarray, w: int) -> np.ndarray:
    width = 1
    while width < w:
        step = min(width, w - width)
        x = np.minimum(x[:-step], x[step:])
        width += step
    return x


def _occurrence(h: np.ndarray) -> np.ndarray:
    """How often each value stood before its place."""
    order = np.argsort(h, kind="stable")
    new = np.ones(len(h), bool)
    new[1:] = h[order][1:] != h[order][:-1]
    starts = np.flatnonzero(new)
    out = np.empty(len(h), np.uint64)
    out[order] = np.arange(len(h)) - starts[np.cumsum(new) - 1]
    return out


#: The marks before and after a text, as code points that no text has.
_BEFORE, _AFTER = (np.arange(K - 1, dtype=np.uint32) + np.uint32(0x110000 + i * K) for i in (0, 1))


def anchors(texts: list[str], keep: int = ANCHORS) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text, the 32-bit hashes (ascending) and places of its least ``keep`` closed syncmers.

    A place is counted from the first mark before the text. A syncmer that occurs again counts as another anchor, so
    repetitive texts have as many as others. An empty text has none.
    """
    found = []
    for lo, hi in slices(texts):
        part = texts[lo:hi]
        points = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.array([len(t) for t in part], np.int64)
        ends = np.zeros(len(part) + 1, np.int64)
        np.cumsum(lengths + 2 * (K - 1), out=ends[1:])
        codes = np.empty(ends[-1], np.uint32)
        codes[ends[:-1, None] + np.arange(K - 1)] = _BEFORE
        codes[ends[1:, None] - np.arange(1, K)] = _AFTER
        owner = np.repeat(np.arange(len(part)), lengths)
        codes[np.arange(len(points)) + (2 * owner + 1) * (K - 1)] = points
        codes = mix(codes.astype(np.uint64) + np.uint64(1))
        small = _rolling(codes, S)
        least = _window_min(small, K - S + 1)
        at = np.flatnonzero((least == small[: len(least)]) | (least == small[K - S :]))
        at = at[at + K <= ends[np.searchsorted(ends, at, side="right")]]
        hashes = np.zeros(len(at), np.uint64)
        for j, p in enumerate(powers(_BASE, K)):
            hashes += codes[at + j] * p
        bounds = np.searchsorted(at, ends)
        for d, n in enumerate(lengths):
            h = hashes[bounds[d] : bounds[d + 1]] if n else hashes[:0]
            h, first = np.unique(mix(h + _occurrence(h) * _BASE) >> np.uint64(32), return_index=True)
            found.append((h[:keep], at[bounds[d] : bounds[d + 1]][first[:keep]] - ends[d]))
    return found


def as_text(anchor: tuple[np.ndarray, np.ndarray]) -> str:
    """Anchors as hash@place in hexadecimal, by ascending hash."""
    return " ".join(f"{h:08x}@{p:x}" for h, p in zip(anchor[0].tolist(), anchor[1].tolist()))


def from_text(text: str) -> tuple[np.ndarray, np.ndarray]:
    pairs = [a.split("@") for a in text.split()]
    return np.array([int(h, 16) for h, _ in pairs], np.uint64), np.array([int(p, 16) for _, p in pairs], np.int64)


def _longest_chain(a: np.ndarray, b: np.ndarray) -> int:
    """The most of the pairs of places that ascend in both."""
    ends: list[int] = []
    for p in b[np.argsort(a)].tolist():
        at = bisect_left(ends, p)
        ends[at : at + 1] = [p]
    return len(ends)


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], keep: int = ANCHORS) -> float:
    """Share of the least anchors of both that are common and in the same order; 1 for two empty texts.

    These are the longest chain of anchors that ascend in both texts, so any number of edits may shift them, or those
    on the best diagonal where that has more, as small swaps break a chain.
    """
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    union = np.union1d(a[0], b[0])[:keep]
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    inside = a[0][i] <= union[-1]
    at, to = a[1][i[inside]], b[1][j[inside]]
    shift = np.sort(at - to)
    if not len(shift):
        return 0.0
    aligned = (np.searchsorted(shift, shift + BAND, side="left") - np.arange(len(shift))).max()
    if aligned < len(shift):
        aligned = max(aligned, _longest_chain(at, to))
    return float(aligned) / len(union)


def _literal(values: list, kind: str) -> Column:
    """A literal array, as one constant of the plan."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def id_kind(df: DataFrame, row_id: str) -> str:
    """``long`` or ``string``, for the column of ids."""
    found = df.schema[row_id].dataType.simpleString()
    if found in ("tinyint", "smallint", "int", "bigint"):
        return "long"
    if found == "string":
        return found
    raise TypeError(f"ids must be whole numbers or strings, not {found}")


def with_next(df: DataFrame, text: str, row_id: str) -> tuple[DataFrame, int]:
    """Rows (part, id, row, text), where a part is a range of ids and holds one row more: the first of the next.

    Parts go by descending id, nulls last; after the last row comes the first. Ids may be whole numbers or strings. The
    bounds of the parts, at most ``MOST_RANGES`` ids, are a literal of the plan; those of strings come from a sample.
    """
    kind = id_kind(df, row_id)
    rows = df.select(F.col(row_id).cast(kind).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n = rows.count()
    parts = max(1, min(math.ceil(n / RANGE_ROWS), MOST_RANGES))
    shares = [i / parts for i in range(1, parts)]
    if not shares:
        cuts = []
    elif kind == "long":
        cuts = sorted(set(rows.agg(F.percentile_approx("id", shares, max(10_000, 4 * parts))).first()[0] or []))
    else:
        some = rows.select("id").dropna().filter(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(max(1, n // (16 * parts)))) == 0).limit(64 * parts)
        found = sorted({r["id"] for r in some.collect()})
        cuts = found[:: max(1, len(found) // parts)][1:]
    # Part p has the ids in (cuts[-p - 1], cuts[-p]], so part 0 has the greatest. Bounds are found by halving.
    known = _literal(cuts, kind)
    halvings = max(1, (len(cuts) + 1).bit_length())

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        below = (s["lo"] < s["hi"]) & (F.get(known, mid) < F.col("id"))
        return F.struct(F.when(below, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(below | (s["lo"] >= s["hi"]), s["hi"]).otherwise(mid).alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi"))
    smaller = F.aggregate(F.sequence(F.lit(1), F.lit(halvings)), start, halve)["lo"] if cuts else F.lit(0)
    part = F.when(F.col("id").isNull(), F.lit(len(cuts))).otherwise(F.lit(len(cuts)) - smaller).cast("int")
    rows = rows.withColumn("part", part)
    tops = {r["part"]: r["top"] for r in rows.groupBy("part").agg(F.max("id").alias("top")).collect()}
    full = sorted(tops)
    after = {p: full[(i - 1) % len(full)] for i, p in enumerate(full)}  # the part that needs the first row of p
    tops_sql = F.get(_literal([tops.get(p) for p in range(len(cuts) + 1)], kind), F.col("part"))
    after_sql = F.get(_literal([after.get(p, 0) for p in range(len(cuts) + 1)], "bigint"), F.col("part"))
    is_top = F.col("id").eqNullSafe(tops_sql)
    copies = F.when(is_top, F.array(F.struct(F.col("part").alias("part"), F.lit(0).alias("extra")), F.struct(after_sql.cast("int").alias("part"), F.lit(1).alias("extra")))).otherwise(F.array(F.struct(F.col("part").alias("part"), F.lit(0).alias("extra"))))
    return rows.select("id", "text", F.explode(copies).alias("c")).select("c.part", "c.extra", "id", "text"), len(full)


def _compare(keep: int, batches) -> Iterator:
    import pyarrow as pa

    kind = pa.int64()

    def rows() -> Iterator:
        nonlocal kind
        for b in text_batches(batches, 3):
            kind = b.schema.field(2).type
            yield from zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist())

    def flush(pairs: list):
        texts = [t for _, t, _ in pairs]
        nexts = [t for _, _, t in pairs]
        edited = [t[: len(t) - len(t) // 3] + x[: len(t) // 3] for t, x in zip(texts, nexts)]
        own = anchors(texts, keep)
        ahead = anchors([nexts[-1]], keep)[0]
        changed = anchors(edited, keep)
        # the next text of a row is mostly the text of the row that follows
        following = [own[i + 1] if i + 1 < len(pairs) and nexts[i] is texts[i + 1] else None for i in range(len(pairs))]
        following = [ahead if i == len(pairs) - 1 else f or anchors([nexts[i]], keep)[0] for i, f in enumerate(following)]
        columns = [
            pa.array([i for i, _, _ in pairs], kind),
            pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited]),
            pa.array([as_text(a) for a in own]),
            pa.array([as_text(a) for a in changed]),
            pa.array([likeness(a, b, keep) for a, b in zip(own, changed)], pa.float64()),
            pa.array([likeness(a, b, keep) for a, b in zip(own, following)], pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    part, last, done, pairs, size = None, None, False, [], 0
    for p, extra, i, t in rows():
        if p != part:
            part, last, done = p, None, False
        if last is not None and not done:
            pairs.append((*last, t))
            size += len(t)
            if size > 2_000_000:
                yield flush(pairs)
                pairs, size = [], 0
        if extra:
            done = True
            last = None
        else:
            last = (i, t)
    if pairs:
        yield flush(pairs)


def fingerprints_with_neighbours(df: DataFrame, text: str = "text", row_id: str = "doc_id", keep: int = ANCHORS) -> DataFrame:
    """Fingerprints of every text and of its edited form, with likenesses.

    Columns: row_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. The edited text
    has its last floor(n_chars / 3) code points replaced by the first as many of the next row's, by descending id;
    the last row's next is the first, and a single row is its own next. Null texts are empty; an empty text has an
    empty fingerprint. Rows of equal ids follow each other in the order of their texts; they are one task's work, so
    ids should be nearly unique. Very long texts are read whole.
    Other columns are ignored; an empty table gives no rows. ``keep`` is the number of anchors of a fingerprint; one
    above the length of all texts compares all anchors.
    """
    bounded_batches(df.sparkSession)
    rows, parts = with_next(df, text, row_id)
    dealt = rows.repartition("part").sortWithinPartitions("part", "extra", F.col("id").desc_nulls_last(), "text")
    out = dealt.select("part", "extra", "id", "text").mapInArrow(partial(_compare, keep), f"id {id_kind(df, row_id)}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.withColumnRenamed("id", row_id)


def fingerprints(df: DataFrame, text: str = "text", row_id: str = "doc_id", keep: int = ANCHORS) -> DataFrame:
    """(row_id, fingerprint, n_anchors) of every text, without comparing.

    Null and empty texts have no anchors; equal texts have equal fingerprints, whatever their rows; very long texts are
    read whole; other columns are ignored; an empty table gives no rows.
    """
    import pyarrow as pa

    bounded_batches(df.sparkSession)

    def run(batches):
        for b in text_batches(batches, 1):
            found = anchors([t or "" for t in b.column(1).to_pylist()], keep)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([as_text(a) for a in found]), pa.array([len(a[0]) for a in found], pa.int32())], names=[row_id, "fingerprint", "n_anchors"])

    kind = df.schema[row_id].dataType.simpleString()
    return df.select(row_id, text).mapInArrow(run, f"{row_id} {kind}, fingerprint string, n_anchors int")
