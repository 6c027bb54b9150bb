"""Exact duplicates by an exchange of Golomb-coded fingerprints.

1. Every row gets the SHA-256 of its text without white space; 48 of its bits are its fingerprint.
2. Each chunk of a scan sorts its fingerprints, sends each owner (a range of fingerprints) its part as Golomb-Rice
   coded gaps, and keeps the places of its rows in the same order.
3. An owner decodes what it was sent and answers each chunk with a bitmap of the fingerprints that others sent too.
4. Only rows whose fingerprint is marked are suspects. Their texts are read again and shuffled, already reduced to
   one copy per task and text, and compared byte for byte.

Unique rows - most of a corpus - are never shuffled; of their texts, none are (see ``common.with_marks`` for the bound).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_scan, located, row_bitmaps, shared_table, with_marks, without_marked

#: The white space that equality ignores.
SPACES = " \t\n\x0b\x0c\r"
FP_BITS = 48
CHUNK_ROWS = 65536
#: Fingerprints that one owner holds at once, about.
OWNER_ROWS = 250_000
LEAST_OWNERS = 16


def without_spaces(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    for c in SPACES:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def rice_encode(sorted_values: np.ndarray, base: int, span: int) -> tuple[int, bytes, bytes]:
    """Golomb-Rice code of sorted distinct values in [base, base + span): (remainder bits, unary part, remainders)."""
    gaps = np.diff(sorted_values.astype(np.int64), prepend=np.int64(base))
    bits = max(0, int(np.log2(max(1.0, 0.69 * span / (len(gaps) + 1)))))
    quotients = gaps >> bits
    ends = np.cumsum(quotients + 1) - 1
    unary = np.ones(int(ends[-1]) + 1, np.uint8)
    unary[ends] = 0
    rest = (gaps & ((1 << bits) - 1)).astype(np.uint64)
    planes = (rest[:, None] >> np.arange(bits, dtype=np.uint64)[::-1]) & np.uint64(1)
    return bits, np.packbits(unary).tobytes(), np.packbits(planes.astype(np.uint8).ravel()).tobytes()


def rice_decode(n: int, base: int, bits: int, unary: bytes, rest: bytes) -> np.ndarray:
    zeros = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8)) == 0)[:n]
    quotients = np.diff(zeros, prepend=-1) - 1
    planes = np.unpackbits(np.frombuffer(rest, np.uint8), count=n * bits).reshape(n, bits).astype(np.int64)
    low = planes @ (1 << np.arange(bits, dtype=np.int64)[::-1]) if bits else np.zeros(n, np.int64)
    return base + np.cumsum((quotients.astype(np.int64) << bits) + low)


def _send(owner_bits: int):
    import pyarrow as pa

    shift = FP_BITS - owner_bits

    def emit(file: str, rows: np.ndarray, fps: np.ndarray):
        order = np.argsort(fps, kind="stable")
        base = int(rows.min())  # a task may read the splits of a file in any order
        fps, places = fps[order], rows[order] - base
        values, first, counts = np.unique(fps, return_index=True, return_counts=True)
        owner = values >> shift
        out = []
        for lo, hi in zip(*(lambda s: (s[:-1], s[1:]))(np.append(np.unique(owner, return_index=True)[1], len(values)))):
            o = int(owner[lo])
            bits, unary, rest = rice_encode(values[lo:hi], o << shift, 1 << shift)
            stop = first[hi] if hi < len(values) else len(fps)
            out.append((file, base, o, int(hi - lo), bits, unary, rest, counts[lo:hi].astype(np.uint32).tobytes(), places[first[lo] : stop].tobytes()))
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 4]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["_file", "first", "owner", "n", "bits", "unary", "rest", "counts", "places"])

    def send(batches):
        file, held, held_fps, size = None, [], [], 0
        for b in batches:
            files, rows, fps = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(), b.column(2).to_numpy()
            edges = np.append(np.flatnonzero(np.append(True, files[1:] != files[:-1])), len(files)) if len(files) else [0]
            for lo, hi in zip(edges[:-1], edges[1:]):
                if size and (files[lo] != file or size + hi - lo > CHUNK_ROWS):
                    yield emit(file, np.concatenate(held), np.concatenate(held_fps))
                    held, held_fps, size = [], [], 0
                file = files[lo]
                held.append(rows[lo:hi])
                held_fps.append(fps[lo:hi])
                size += hi - lo
        if size:
            yield emit(file, np.concatenate(held), np.concatenate(held_fps))

    return send


def _answer(owner_bits: int):
    import pandas as pd

    shift = FP_BITS - owner_bits

    def answer(blobs):
        sent = [rice_decode(n, o << shift, bits, unary, rest) for n, o, bits, unary, rest in zip(blobs["n"], blobs["owner"], blobs["bits"], blobs["unary"], blobs["rest"])]
        values, counts = np.unique(np.concatenate(sent), return_counts=True)
        several = values[counts > 1]
        maps = [np.packbits(np.isin(s, several)).tobytes() for s in sent]
        return pd.DataFrame({"_file": blobs["_file"], "first": blobs["first"], "owner": blobs["owner"], "bitmap": maps})

    return answer


def _suspects(batches):
    import pyarrow as pa

    for b in batches:
        for r in b.to_pylist():
            counts = np.frombuffer(r["counts"], np.uint32)
            marked = np.unpackbits(np.frombuffer(r["bitmap"], np.uint8), count=r["n"]).astype(bool) | (counts > 1)
            places = np.frombuffer(r["places"], np.int64)[np.repeat(marked, counts)]
            if len(places):
                yield pa.RecordBatch.from_arrays([pa.array([r["_file"]] * len(places)), pa.array(places + r["first"])], names=["_file", "_row"])


def exact_duplicates(df: DataFrame, text: str = "text", row_id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """The rows of ``df`` in two parts: those with a text of their own, and the judged members of equal texts.

    Both have _file, _row, id, n_chars (code points), sha (32 bytes); the judged ones also group_size, keep_id and
    kept. Null texts count as empty; texts are equal when they are identical without the characters of ``SPACES``.
    In each group the row with the most code points stays, then the least id (null ids last), then the first in the
    scan, so exactly one of several equal rows stays. Other columns are ignored. An empty table gives no rows.
    """
    rows = located(as_scan(df), [F.col(row_id).alias("id"), F.col(text).alias("text")])
    bare = without_spaces(F.col("text"))
    facts = [F.col("_file"), F.col("_row"), F.col("id"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"), F.unhex(F.sha2(F.encode(bare, "UTF-8"), 256)).alias("sha")]
    all_rows = shared_table(rows.select(*facts), "hashes")
    owner_bits = max(LEAST_OWNERS, all_rows.count() // OWNER_ROWS).bit_length() - 1
    fp = F.conv(F.substring(F.hex("sha"), 1, FP_BITS // 4), 16, 10).cast("long")
    runs = all_rows.select("_file", "_row", fp.alias("fp")).mapInArrow(_send(owner_bits), "_file string, first long, owner int, n int, bits int, unary binary, rest binary, counts binary, places binary")
    runs = shared_table(runs, "runs")
    answers = runs.select("_file", "first", "owner", "n", "bits", "unary", "rest").groupBy("owner").applyInPandas(_answer(owner_bits), "_file string, first long, owner int, bitmap binary")
    marks = runs.select("_file", "first", "owner", "n", "counts", "places").join(answers, ["_file", "first", "owner"]).select("_file", "first", "n", "counts", "places", "bitmap").mapInArrow(_suspects, "_file string, _row long")
    bitmaps = shared_table(row_bitmaps(marks), "marks")

    own = with_marks(all_rows, bitmaps, narrow=True).filter(~F.col("_marked")).drop("_marked")
    suspects = with_marks(rows, bitmaps).filter("_marked").select(*facts, bare.alias("bare"), F.monotonically_increasing_id().alias("uid"))
    suspects = shared_table(suspects, "suspects")
    best = F.struct((-F.col("n_chars")).alias("n"), F.col("id").isNull().alias("none"), "id", "uid")
    groups = suspects.groupBy("sha").agg(F.count(F.lit(1)).alias("group_size"), F.min(best).alias("keep"), (F.min("bare") == F.max("bare")).alias("same"))
    groups = groups.filter(F.when(F.col("same"), True).otherwise(F.raise_error(F.lit("different texts have one SHA-256"))).cast("boolean"))
    # Written first, so the join has plain shuffles on both sides and adaptive execution can split a hot group's rows.
    judged = suspects.drop("bare").join(shared_table(groups, "groups"), "sha")
    judged = judged.select("_file", "_row", "id", "n_chars", "sha", "group_size", F.col("keep.id").alias("keep_id"), (F.col("uid") == F.col("keep.uid")).alias("kept"))
    return own, judged


def dedup_report(df: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """(row_id, keep_id, group_size, kept, text_sha256) of every row."""
    own, judged = exact_duplicates(df, text, row_id)
    sha = F.lower(F.hex("sha")).alias("text_sha256")
    alone = own.select(F.col("id").alias(row_id), F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), sha)
    return alone.unionByName(judged.select(F.col("id").alias(row_id), "keep_id", "group_size", "kept", sha))


def drop_exact_duplicates(df: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """``df`` without the rows that a judged group doesn't keep; the other rows stay where they are."""
    df = as_scan(df)
    _, judged = exact_duplicates(df, text, row_id)
    return without_marked(df, shared_table(row_bitmaps(judged.filter(~F.col("kept"))), "dropped"))
