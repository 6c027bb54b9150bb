"""What the text operators share: tables in the shared folder, row marks, ranks, words and components.

Nothing here sends rows, texts or fingerprints through the driver. A lineage is cut by writing a Parquet table in
the folder named by ``spark.checkpoint.dir``, so a lost executor costs only the tasks it was running.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..operators.components import components  # noqa: F401
from ..tables import shared_dir, shared_table  # noqa: F401

#: Bytes of text that one numpy pass handles at once.
SLICE_BYTES = 1_000_000
#: Bytes of an Arrow batch of texts.
BATCH_BYTES = 8_000_000
#: A broadcast is made only of a table of at most so many bytes; beyond it the same join shuffles.
BROADCAST_BYTES = 64_000_000
#: Rows that one bitmap of row marks covers, and the most parts that bitmaps are dealt to, each broadcast.
BLOCK, MARK_PARTS = 4096, 16


def bounded_batches(spark: SparkSession) -> None:
    """Lower Spark's own bound of the bytes of an Arrow batch to ``BATCH_BYTES``, where it is higher.

    Executors hold a batch in both processes, several times. The setting stays, as results are lazy; it bounds memory
    only and changes no result."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name).rstrip("bB")) > BATCH_BYTES:
        spark.conf.set(name, f"{BATCH_BYTES}b")


def text_batches(batches, column: int, limit: int = SLICE_BYTES) -> Iterator:
    """Arrow batches cut so that each holds about ``limit`` bytes of a text column; a longer text is one of its own.

    Spark bounds the bytes of the batches that it sends; these cuts bound what Python makes of them.
    """
    import pyarrow.compute as pc

    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False)
        start = size = 0
        for i, n in enumerate(sizes.tolist()):
            if i > start and size + n > limit:
                yield b.slice(start, i - start)
                start, size = i, 0
            size += n
        if start < b.num_rows:
            yield b.slice(start)


_PLACE = (("file_path", "_file"), ("row_index", "_row"))


def _is_scan(df: DataFrame) -> bool:
    """Whether each row of ``df`` is a row of one file relation, chosen in the same way each time it is read."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.getClass().getSimpleName() in ("Project", "Filter", "SubqueryAlias", "View") and plan.deterministic():
        plan = plan.children().apply(0)
    return plan.getClass().getSimpleName() == "LogicalRelation" and plan.children().size() == 0


def as_scan(df: DataFrame) -> DataFrame:
    """``df`` if it is a plain scan of files, else a copy in the shared folder that is one.

    Plain are columns and filters that give the same each time over one file relation. Joins, explodes, unions and
    samples are written: they name a file's row several times, or not the same rows in each scan.
    """
    if "_metadata" not in df.columns and _is_scan(df):
        try:
            df.select("_metadata.file_path", "_metadata.row_index")
            return df
        except AnalysisException:
            pass
    return shared_table(df, "input")


def located(df: DataFrame, columns: Iterable[Column]) -> DataFrame:
    """Columns of a scan (see ``as_scan``) with ``_file`` and ``_row``, which name a row of a file in every scan."""
    return df.select(*columns, *[F.col(f"_metadata.{a}").alias(b) for a, b in _PLACE])


def without_marked(df: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """The rows of a scan that aren't marked, with all its columns, whatever their names."""
    rows = located(df, [F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_whole")])
    return with_marks(rows, bitmaps).filter(~F.col("_marked")).select("_whole.*")


def row_bitmaps(marks: DataFrame) -> DataFrame:
    """Bitmaps of the marked rows (``_file``, ``_row``): one row per file and block of 4096 rows, 64 words each."""
    words = marks.select("_file", F.floor(F.col("_row") / BLOCK).alias("_block"), F.floor(F.pmod("_row", F.lit(BLOCK)) / 64).alias("w"), F.expr("shiftleft(1L, cast(pmod(_row, 64) as int))").alias("bit"))
    words = words.groupBy("_file", "_block", "w").agg(F.bit_or("bit").alias("bits"))
    blocks = words.groupBy("_file", "_block").agg(F.map_from_entries(F.collect_list(F.struct("w", "bits"))).alias("m"))
    return blocks.select("_file", "_block", F.transform(F.sequence(F.lit(0), F.lit(BLOCK // 64 - 1)), lambda i: F.coalesce(F.col("m")[i.cast("long")], F.lit(0).cast("long"))).alias("_words"))


def with_marks(rows: DataFrame, bitmaps: DataFrame, name: str = "_marked", narrow: bool = False) -> DataFrame:
    """Add to located ``rows`` whether each is marked. ``bitmaps`` must be a written table.

    The bitmaps (about 520 bytes for 4096 rows) are broadcast while they fit in ``BROADCAST_BYTES``. A larger table is
    dealt by file to parts that fit, each broadcast to a scan of its own files, so no text is shuffled. Only beyond
    ``MARK_PARTS`` parts (some 6 billion rows), or where ``narrow`` says that rows have no text, are rows shuffled on
    file and block. All ways give the same rows.
    """
    def joined(rows: DataFrame, bitmaps: DataFrame, small: bool) -> DataFrame:
        spread = bitmaps.withColumnsRenamed({"_file": "_f", "_block": "_b"})
        spread = F.broadcast(spread) if small else spread
        return rows.join(spread, (rows["_file"] == spread["_f"]) & (F.floor(rows["_row"] / BLOCK) == spread["_b"]), "left")

    most = BROADCAST_BYTES // (8 * BLOCK // 64 + 200)
    blocks, parts = bitmaps.count(), 1
    part = F.pmod(F.xxhash64("_file"), F.lit(parts))
    largest = blocks
    while largest > most and parts < MARK_PARTS and not narrow:
        parts *= 2
        part = F.pmod(F.xxhash64("_file"), F.lit(parts))
        largest = bitmaps.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    if parts > 1 and largest <= most:
        # The filter names only the file, so each scan opens only the files of its part.
        found = reduce(DataFrame.unionByName, [joined(rows.filter(part == i), bitmaps.filter(part == i), True) for i in range(parts)])
    else:
        found = joined(rows, bitmaps, blocks <= most)
    word = F.get("_words", F.floor(F.pmod(F.col("_row"), F.lit(BLOCK)) / 64).cast("int"))
    bit = F.expr("shiftleft(1L, cast(pmod(_row, 64) as int))")
    return found.withColumn(name, F.coalesce(word.bitwiseAND(bit) != 0, F.lit(False))).drop("_f", "_b", "_words")


def ranked(df: DataFrame, keys: list[str], order: list[Column], spread: Column, buckets: int, rank: str) -> DataFrame:
    """Number the rows of each key from 0 without gaps, in order of bucket and then of ``order``.

    A key's rows are numbered in ``buckets`` parts, so a key that holds most rows is not one task's work; only the
    row counts of the parts meet in a second window. ``df`` is read twice.
    """
    from pyspark.sql import Window

    df = df.withColumn("_part", F.pmod(spread, F.lit(buckets)))
    counts = df.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(*keys, "_part").orderBy(*order)
    numbered = df.withColumn("_i", F.row_number().over(within))
    return numbered.join(starts, [*keys, "_part"]).withColumn(rank, F.col("_start") + F.col("_i") - 1).drop("_part", "_i", "_start")


# Numpy helpers, used inside tasks.

_RNG = np.random.default_rng(20240501)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_WORD = np.array([(b < 128 and chr(b).isalnum()) or b >= 128 for b in range(256)])
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.empty(max(n, 1), np.uint64)
    out[0] = 1
    if n > 1:
        out[1:] = base
        np.multiply.accumulate(out, out=out)
    return out


def slices(texts: list[str], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of a batch with about ``limit`` characters each; a longer text is a range of its own."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def joined_bytes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, and where each begins (with the end of the last)."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    ends = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(r) for r in raw], out=ends[1:])
    return np.frombuffer(b"".join(raw), np.uint8), ends


class Words:
    """Words of some texts: maximal runs of ASCII letters and digits and of all characters beyond ASCII.

    ``start`` and ``length`` are in bytes, ``hash`` is a 64-bit hash of each word, and document d has the words from
    ``bounds[d]`` up to ``bounds[d + 1]``.
    """

    def __init__(self, data: np.ndarray, ends: np.ndarray):
        self.data, n = data, len(data)
        if not n:
            self.start = self.length = np.zeros(0, np.int64)
            self.hash, self.bounds = np.zeros(0, np.uint64), np.zeros(len(ends), np.int64)
            return
        is_word = _WORD[data]
        first = is_word.copy()
        first[1:] &= ~is_word[:-1]
        begins = ends[:-1][ends[:-1] < n]
        first[begins] |= is_word[begins]
        at = np.flatnonzero(is_word)
        self.start = np.flatnonzero(first)
        number = np.cumsum(first[at]) - 1
        within = at - self.start[number]
        self.length = np.bincount(number, minlength=len(self.start)) if len(at) else np.zeros(0, np.int64)
        value = _BYTE[data[at]] * powers(_STEP, int(within.max()) + 1 if len(at) else 1)[within]
        self.hash = mix(np.add.reduceat(value, np.flatnonzero(within == 0))) if len(at) else np.zeros(0, np.uint64)
        self.bounds = np.searchsorted(self.start, ends)


def words_of(texts: list[str]) -> Words:
    """Words of the lower-cased texts."""
    return Words(*joined_bytes([t.lower() for t in texts]))


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric boolean matrix."""
    n, edges = len(linked), []
    new = np.ones(n, bool)
    for root in range(n):
        if not new[root]:
            continue
        new[root] = False
        stack = [root]
        while stack:
            u = stack.pop()
            more = np.flatnonzero(linked[u] & new)
            new[more] = False
            edges += [(u, int(v)) for v in more]
            stack += more.tolist()
    return edges


def runs(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal rows of ``keys`` (n x k, sorted) begin, with the end."""
    if not len(keys):
        return np.zeros(1, np.int64)
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]).any(axis=1)
    return np.append(np.flatnonzero(new), len(keys))


def grouped(batches, keys: list[str]):
    """Tables of whole groups from Arrow batches sorted by ``keys``: each holds one or more whole groups.

    A group that goes on in the next batch is kept back, so memory is bounded by a batch and the largest group.
    """
    import pyarrow as pa

    held: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        k = np.stack([t[c].to_numpy() for c in keys], axis=1)
        starts = runs(k)[:-1]
        if held:
            last = tuple(held[-1][c][len(held[-1]) - 1].as_py() for c in keys)
            if last != tuple(k[0].tolist()):
                yield pa.concat_tables(held)
                held = []
        if starts[-1] > 0:
            yield pa.concat_tables([*held, t.slice(0, int(starts[-1]))])
            held = []
        held.append(t.slice(int(starts[-1])))
    if held:
        yield pa.concat_tables(held)
