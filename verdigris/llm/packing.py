"""Best-fit decreasing packing of tokenised documents into sequences.

Best fit decreasing depends on the lengths alone, and there are at most ``capacity`` of them. So the plan is made on
the histogram of lengths: lengths go from long to short, and a segment tree over remaining capacities finds the
tightest open bin in logarithmic time. Open bins of one capacity are runs of bin numbers, so one step places as many
documents as such a run takes. The plan, a few runs for each length, gives exactly the bins that placing one document
after another would give. Tokenising, ranking the documents of each length and looking up their places are Spark
work; the driver sees the histogram only.
"""

from __future__ import annotations

import json
import re
import sys
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, ranked, shared_table, text_batches

CAPACITY = 1024
END = 2
#: Pre-tokens whose ids a worker remembers.
MEMORY = 200_000
RANK_ROWS = 50_000

#: Pre-tokens of the byte-level BPE (a fixed value of the format).
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: The same for texts of ASCII and Latin letters only, where the standard module needs no character properties.
_LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_IS_LATIN = re.compile(f"[\t\n\r -~{_LATIN}]*").fullmatch
_CUT_LATIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LATIN}]+| ?[0-9]+| ?[^\s{_LATIN}0-9]+|\s+(?!\S)|\s+").findall


class _Known(dict):
    """Ids of pre-tokens, worked out by the tokenizer's model when they are first asked for."""

    def __init__(self, model):
        self.model = model
        # The alphabet of a byte-level BPE: printable Latin-1 characters stand for their bytes, others are moved up.
        printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        self.alphabet = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in printable)}

    def __missing__(self, token: str) -> bytes:
        if len(self) >= MEMORY:
            self.clear()
        seen = token.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.alphabet)
        found = self[token] = np.array([t.id for t in self.model.tokenize(seen)], "<u4").tobytes()
        return found


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes, remembering the ids of pre-tokens.

    A BPE merges within pre-tokens only, so the ids of a text are those of its pre-tokens. Texts that hold the string
    of a special token are left to the tokenizer as they are. A tokenizer of another kind raises ValueError: only a
    byte-level BPE with the usual pre-tokens, without a normaliser, dropout or a space before the text, can be cut so.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        pre, model = spec["pre_tokenizer"] or {}, spec["model"]
        usual = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        whole = not model.get("dropout") and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
        if spec["normalizer"] is not None or not usual or model["type"] != "BPE" or not whole:
            raise ValueError("the tokenizer is no byte-level BPE whose texts can be cut to pre-tokens")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cut = regex.compile(PRE_TOKEN).findall
        self.known = _Known(self.tokenizer.model)

    def __call__(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.known.__getitem__, (_CUT_LATIN if _IS_LATIN(text) else self.cut)(text)))


def worker_encoder(path: str) -> Encoder:
    """The encoder of this Python worker; it outlives a task."""
    kept = sys.__dict__.setdefault("_verdigris_encoders", {})
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


def pieces_of(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: all have ``capacity`` tokens but the first, which may be shorter."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def _pieces(path: str, capacity: int, keep_ids: bool, batches) -> Iterator:
    import pyarrow as pa

    encoder = worker_encoder(path)
    for b in text_batches(batches, 1):
        rows, numbers, starts, lengths, crcs, ids = [], [], [], [], [], []
        for i, text in enumerate(b.column(1).to_pylist()):
            raw = encoder(text or "") + END.to_bytes(4, "little")
            for number, (start, length) in enumerate(pieces_of(len(raw) // 4, capacity)):
                part = raw[4 * start : 4 * (start + length)]
                rows.append(i)
                numbers.append(number)
                starts.append(start)
                lengths.append(length)
                crcs.append(zlib.crc32(part))
                if keep_ids:
                    ids.append(np.frombuffer(part, "<u4").astype(np.int32))
        columns = [b.column(0).take(pa.array(rows, pa.int64())), pa.array(numbers, pa.int32()), *(pa.array(x, pa.int64()) for x in (starts, lengths, crcs))]
        names = ["id", "piece", "start", "length", "ids_crc32"]
        if keep_ids:
            columns.append(pa.array(ids, pa.list_(pa.int32())))
            names.append("ids")
        yield pa.RecordBatch.from_arrays(columns, names=names)


class Tightest:
    """A segment tree over capacities that finds the least one, not below a length, with open bins."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.open = [False] * (2 * self.size)

    def set(self, capacity: int, is_open: bool) -> None:
        i = capacity + self.size
        self.open[i] = is_open
        while i > 1:
            i //= 2
            self.open[i] = self.open[2 * i] or self.open[2 * i + 1]

    def find(self, least: int) -> int | None:
        i = least + self.size
        if self.open[i]:
            return least
        while i > 1:
            if i % 2 == 0 and self.open[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[dict[int, list[tuple[int, int, int, int]]], int]:
    """For each length, runs (first rank, first bin, documents a bin, offset), and the number of bins.

    The documents of a length whose ranks begin at ``first rank`` fill the bins from ``first bin`` on, so many in
    each, from ``offset``; the next run begins where they end.
    """
    tree, ranges, bins, runs = Tightest(capacity), [[] for _ in range(capacity + 1)], 0, {}

    def release(rest: int, first: int, n: int) -> None:
        if n and rest:
            if not ranges[rest]:
                tree.set(rest, True)
            ranges[rest].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank, own = counts[length], 0, runs.setdefault(length, [])
        while left:
            rest = tree.find(length)
            if rest is None:
                rest, first = capacity, bins
                n = -(-left // (capacity // length))
                bins += n
            else:
                first, n = ranges[rest].pop()
                if not ranges[rest]:
                    tree.set(rest, False)
            each = rest // length
            full = min(n, left // each)
            if full:
                own.append((rank, first, each, capacity - rest))
                release(rest - each * length, first, full)
                rank, left, first, n = rank + full * each, left - full * each, first + full, n - full
            if left and n and left < each:
                own.append((rank, first, left, capacity - rest))
                release(rest - left * length, first, 1)
                left, first, n = 0, first + 1, n - 1
            if n:
                release(rest, first, n)
    return runs, bins


def _place(shared, batches) -> Iterator:
    import pyarrow as pa

    runs = shared.value
    for b in batches:
        length, rank = b.column(b.schema.get_field_index("length")).to_numpy(), b.column(b.schema.get_field_index("rank")).to_numpy()
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for size in np.unique(length):
            which = np.flatnonzero(length == size)
            own = runs[int(size)]
            run = own[np.searchsorted(own[:, 0], rank[which], side="right") - 1]
            within = rank[which] - run[:, 0]
            sequence[which] = run[:, 1] + within // run[:, 2]
            offset[which] = run[:, 3] + within % run[:, 2] * size
        kept = [i for i, n in enumerate(b.schema.names) if n != "rank"]
        yield pa.RecordBatch.from_arrays([*(b.column(i) for i in kept), pa.array(sequence), pa.array(offset)], names=[*(b.schema.names[i] for i in kept), "sequence_id", "offset"])


def pack(df: DataFrame, tokenizer: str, text: str = "text", row_id: str = "doc_id", capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Pieces of all texts and their places in sequences of at most ``capacity`` tokens.

    Columns: row_id, piece, start, length, ids_crc32[, ids], sequence_id, offset. A document is the ids of its text,
    without special tokens, and then id 2; a null or empty text is that id alone. Longer documents are cut into
    pieces of ``capacity``, the first of which may be shorter. Equal rows are packed each; an empty table gives no
    rows; other columns are ignored. Pieces of one length are interchangeable, and take their places in order of a
    hash of id, piece and content.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    kind = df.schema[row_id].dataType.simpleString()
    columns = f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    pieces = df.select(F.col(row_id).alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(partial(_pieces, tokenizer, capacity, keep_ids), columns)
    pieces = shared_table(pieces, "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    runs, _ = plan(counts, capacity)
    shared = spark.sparkContext.broadcast({length: np.array(own, np.int64) for length, own in runs.items()})
    buckets = max(8, -(-max(counts.values(), default=0) // RANK_ROWS))
    numbered = ranked(pieces, ["length"], [F.xxhash64("id", "piece", "ids_crc32")], F.xxhash64("ids_crc32", "id", "piece"), buckets, "rank")
    order = ["id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids]
    placed = numbered.select(*order, "rank").mapInArrow(partial(_place, shared), columns + ", sequence_id long, offset long")
    return placed.withColumnRenamed("id", row_id)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) from the result of ``pack(..., keep_ids=True)``: the ids of each sequence in order."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))
