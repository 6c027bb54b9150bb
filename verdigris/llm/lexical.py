"""Ranked lexical search with MaxScore, shard by shard.

``build_index`` makes shards of some thousand documents; the index is a table with one row for each, which has the
postings of all terms of its documents, and it serves any number of searches. A search

1. sums the documents of each query term over all shards, which gives the terms their weights;
2. puts the queries, with their terms and weights, in blocks, and hands each block to each shard;
3. works out, in a shard, the most that a posting of each term adds (its upper bound), and for each query splits the
   terms, by rising bound, into non-essential ones - together they can't reach the least score that still counts - and
   essential ones. Only documents in essential lists are candidates; the non-essential lists are probed, the one of the
   highest bound first, while a candidate can still qualify. A task carries each query's best scores from shard to
   shard, so bounds tighten as it goes;
4. ranks what the tasks found, at most k documents for each query and task.

All scores are whole numbers, so the order doesn't depend on how documents were dealt.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import partial

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, bounded_batches, shared_table

#: Terms are runs of ASCII letters and digits and of all characters beyond ASCII; only A to Z are lower-cased.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
_END = re.compile(rb"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]")
#: A shard has at most so many documents and about so many bytes of text.
SHARD_DOCS, SHARD_BYTES = 8192, 4_000_000
#: Bytes of a text that are cut to terms at once.
PIECE = 1_000_000
#: Queries of a block, on average.
BLOCK_QUERIES = 512
INDEX = "ids array<{}>, lengths array<int>, terms array<binary>, counts array<int>, docs binary, tfs binary"


def term_counts(text: bytes | None) -> Counter:
    """Terms of a text in UTF-8 with their number."""
    found: Counter = Counter()
    text = text or b""
    start = 0
    while start < len(text):
        cut = _END.search(text, start + PIECE)
        end = cut.start() if cut else len(text)
        found.update(TERM.findall(text[start:end].lower()))
        start = end
    return found


def _index(batches):
    import pandas as pd
    import pyarrow as pa

    ids, lengths, terms, docs, tfs, size = [], [], [], [], [], 0

    def shard():
        codes, names = pd.factorize(np.array(terms, object))
        order = np.argsort(codes, kind="stable")
        counts = np.bincount(codes, minlength=len(names)).astype(np.int32)
        arrays = [pa.array([ids], pa.list_(kind)), pa.array([lengths], pa.list_(pa.int32())), pa.array([names.tolist()], pa.list_(pa.binary())), pa.array([counts.tolist()], pa.list_(pa.int32()))]
        arrays += [pa.array([np.array(x, np.int32)[order].tobytes()], pa.binary()) for x in (docs, tfs)]
        return pa.RecordBatch.from_arrays(arrays, names=["ids", "lengths", "terms", "counts", "docs", "tfs"])

    for b in batches:
        kind = b.column(0).type
        for i, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary())):
            text = text.as_py() or b""
            if ids and (len(ids) == SHARD_DOCS or size + len(text) > SHARD_BYTES):
                yield shard()
                ids, lengths, terms, docs, tfs, size = [], [], [], [], [], 0
            found = term_counts(text)
            docs += [len(ids)] * len(found)
            terms += found.keys()
            tfs += found.values()
            ids.append(i)
            lengths.append(found.total())
            size += len(text)
    if ids:
        yield shard()


def build_index(df: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """The index of all rows of ``df``, a table in the shared folder: one row for each shard.

    Null and empty texts are documents without terms. A very long text is read whole and may be a shard of its own.
    Equal rows are documents of their own, null ids are kept, and other columns are ignored. An empty table gives an
    empty index.
    """
    bounded_batches(df.sparkSession)
    kind = df.schema[row_id].dataType.simpleString()
    rows = df.select(F.col(row_id).alias("id"), F.col(text).alias("text"))
    # A reader holds some thousand rows at once, and these are large.
    return shared_table(rows.mapInArrow(_index, INDEX.format(kind)), "index", maxRecordsPerFile=8)


def _query_terms(batches):
    import pyarrow as pa

    for b in batches:
        found = [sorted(term_counts(t.as_py())) for t in b.column(1).cast(pa.binary())]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.binary()))], names=["qid", "terms"])


def weighted_queries(index: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, term, w) of ``queries`` (qid, text): each term once, with its weight over the documents of the index."""
    terms = queries.mapInArrow(_query_terms, "qid long, terms array<binary>").select("qid", F.explode("terms").alias("term"))
    terms = shared_table(terms, "query_terms")
    wanted = shared_table(terms.select("term").distinct(), "wanted")
    size = wanted.agg(F.sum(F.octet_length("term") + 64)).first()[0] or 0
    wanted = F.broadcast(wanted) if size <= BROADCAST_BYTES else wanted
    held = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("t")).select(F.col("t.terms").alias("term"), F.col("t.counts").alias("n"))
    df = held.join(wanted, "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
    n = totals(index)[0]
    return terms.join(df, "term").select("qid", "term", F.floor(1000 * F.log(F.lit(2.0 * n + 2) / (2 * F.col("df") + 1))).alias("w"))


def totals(index: DataFrame) -> tuple[int, int]:
    """Documents with a term, and all their terms."""
    some = F.aggregate(F.filter("lengths", lambda n: n > 0), F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("l")), lambda a, n: F.struct((a["n"] + 1).alias("n"), (a["l"] + n).alias("l")))
    found = index.select(some.alias("s")).agg(F.sum("s.n").alias("n"), F.sum("s.l").alias("l")).first()
    return found["n"] or 0, found["l"] or 0


def best_of_shard(lists: list[tuple[np.ndarray, np.ndarray, int]], n_docs: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents of a shard whose score is above 0 and at least ``least``, with their scores, by MaxScore.

    ``lists`` has for each term its documents (rising), what each gets from it, and the most of these."""
    lists = sorted(lists, key=lambda x: x[2])
    reach = np.cumsum([x[2] for x in lists]) if lists else np.zeros(0, np.int64)  # of a term and all of lower bounds
    split = int(np.searchsorted(reach, least, side="left"))
    score = np.zeros(n_docs, np.int64)
    for docs, gains, _ in lists[split:]:
        score[docs] += gains
    alive = np.flatnonzero(score)
    for k in range(split - 1, -1, -1):
        alive = alive[score[alive] + reach[k] >= least]
        if not len(alive):
            break
        docs, gains, _ = lists[k]
        at = np.searchsorted(docs, alive)
        hit = at < len(docs)
        hit[hit] = docs[at[hit]] == alive[hit]
        score[alive[hit]] += gains[at[hit]]
    alive = alive[score[alive] >= max(least, 1)]
    return alive, score[alive]


def _order(found: tuple) -> tuple:
    score, i = found
    return -score, i is None, 0 if i is None else i


def _search(n: int, total: int, k: int, batches):
    import pyarrow as pa

    best: dict[int, list[tuple]] = {}
    kind = None
    for b in batches:
        kind = b.schema.field("ids").type.value_type
        for r in range(b.num_rows):
            col = {name: b.column(name)[r] for name in b.schema.names}
            ids = col["ids"].values
            docs, tfs = (np.frombuffer(col[c].as_py(), np.int32) for c in ("docs", "tfs"))
            starts = np.zeros(len(col["counts"]) + 1, np.int64)
            np.cumsum(col["counts"].values.to_numpy(zero_copy_only=False), out=starts[1:])
            place = {t: i for i, t in enumerate(col["terms"].values.to_pylist())}
            room = np.array([10 + 90 * x * n // total for x in col["lengths"].as_py()], np.int64)
            lists: dict[bytes, tuple] = {}
            for q in col["queries"].as_py():
                own = []
                for t, w in zip(q["terms"], q["weights"]):
                    i = place.get(t)
                    if i is None:
                        continue
                    if t not in lists:
                        d, tf = docs[starts[i] : starts[i + 1]], tfs[starts[i] : starts[i + 1]].astype(np.int64)
                        gains = w * (1_000_000_000 * tf // (1000 * tf + 8 * room[d]))
                        lists[t] = d, gains, int(gains.max())
                    own.append(lists[t])
                had = best.get(q["qid"], [])
                at, scores = best_of_shard(own, len(ids), had[k - 1][0] if len(had) >= k else 0)
                if len(at) > k:
                    cut = np.partition(scores, len(scores) - k)[len(scores) - k]
                    at, scores = at[scores >= cut], scores[scores >= cut]
                if len(at):
                    best[q["qid"]] = sorted([*had, *zip(scores.tolist(), ids.take(pa.array(at)).to_pylist())], key=_order)[:k]
    if best:
        flat = [(q, i, s) for q, own in best.items() for s, i in own]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in flat], pa.int64()), pa.array([x[1] for x in flat], kind), pa.array([x[2] for x in flat], pa.int64())], names=["qid", "id", "score"])


def search(index: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(qid, rank, id, score): the ``k`` highest-scoring documents of each of ``queries`` (qid, text).

    Equal scores go by rising id, null ids last; each row of equal ids has a rank of its own. A query without terms,
    or of terms that no document holds, has no rows, and so has one of an empty index.
    """
    n, total = totals(index)
    if not n:
        kind = index.schema["ids"].dataType.elementType.simpleString()
        return queries.sparkSession.createDataFrame([], f"qid long, rank int, id {kind}, score long")
    terms = weighted_queries(index, queries)
    whole = terms.groupBy("qid").agg(F.collect_list(F.struct("term", "w")).alias("t")).select("qid", F.col("t.term").alias("terms"), F.col("t.w").alias("weights"))
    n_blocks = -(-queries.count() // BLOCK_QUERIES)
    blocks = whole.groupBy(F.pmod(F.xxhash64("qid"), F.lit(max(1, n_blocks))).alias("block")).agg(F.collect_list(F.struct("qid", "terms", "weights")).alias("queries"))
    blocks = shared_table(blocks, "queries").select("queries")
    # Every shard answers every block: a stated set of queries against all rows.
    found = index.crossJoin(blocks).mapInArrow(partial(_search, n, total, k), f"qid long, id {index.schema['ids'].dataType.elementType.simpleString()}, score long")
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), F.asc_nulls_last("id")))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("qid", "rank", "id", "score")


def ranked_search(df: DataFrame, items: DataFrame, text: str = "text", row_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text", k: int = 10) -> DataFrame:
    """(item_id, rank, row_id, score) of all ``items`` over all rows of ``df``.

    Rows of ``items`` are searched apart, also where their ids repeat or are null; null texts have no terms. See
    ``build_index`` and ``search`` for odd rows of ``df``.
    """
    index = build_index(df, text, row_id)
    asked = items.select(F.monotonically_increasing_id().alias("qid"), F.col(item_id).alias("item"), F.col(item_text).alias("text"))
    asked = shared_table(asked, "items")
    found = search(index, asked.select("qid", "text"), k)
    return found.join(asked.select("qid", "item"), "qid").select(F.col("item").alias(item_id), "rank", F.col("id").alias(row_id), "score")
