"""Sharding by a k-d tree over metadata, with DataFrame functions only.

The rows are split recursively at weighted medians. Each node of the tree is cut along the dimension in which its
rows spread widest (after scaling every dimension to its range over all rows), where half of its bytes lie on either
side - or, for a node that must give an odd number of shards, the matching share. All nodes of a level are cut
together. A median is found by histograms that narrow down on it: every pass sums the bytes in a fixed number of bins
for each node, and only the bin that holds the median goes on to the next pass. What the driver sees is one row per
node; the texts are read once, to take their sizes, and the passes read a narrow table of sizes and coordinates.

A coordinate is a 20-bit code of the dimension followed by 43 bits that break ties, so a hot source or any other
value that most rows share can be cut anywhere. Numbers are scaled to the code; strings are ranked among the distinct
ones, so it doesn't matter how they begin. Rows of equal texts are a group: its members take the coordinates of its
first row and stay in one shard. A group that weighs more than a hundredth of a shard is a unit that the driver knows
(there are at most a hundred of them for each shard): at each node the units are cut at their own weighted median, and
the other rows where both sides get their share, so units cost no balance. Only a group above a whole shard is cut.

The tree is known to the driver, one entry a node, and goes to the rows as constant arrays in which a row looks up the
node that it is in, so no join and no expression grows with the number of nodes.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ranked, shared_table

#: Bytes that each row counts besides its text.
ROW_BYTES = 16
BINS = 4096
CODES = 1 << 20
TIES = 1 << 43
#: Ties of rows that are no group's, beside 25 bits of the text's hash.
ALONE = 1 << 18
#: The cut of a node that stays whole.
WHOLE = (1 << 63) - 1
#: Levels that rows descend at once, before they are written with the node that they are in.
TREE_LEVELS = 6
#: A median is exact enough when the bin that holds it weighs less than this part of a shard.
EXACT = 1e-4
#: A group of equal texts above this part of a shard is placed as a unit; smaller ones are cut around like rows.
UNIT = 0.01
#: Rows of a shard, and distinct strings of a dimension, that one task numbers.
SLOT_ROWS, RANK_ROWS = 50_000, 500_000


def text_size(text: Column) -> Column:
    """UTF-8 bytes of the text, none for null, and 16 for the row."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES


def ranks(values: DataFrame, name: str) -> tuple[DataFrame, int]:
    """The distinct strings of a column with their rank, from 0, and their number.

    They are dealt to ranges, numbered in each, and moved by the counts of the ranges before."""
    distinct = shared_table(values.select(name).distinct(), "values")
    n = distinct.count()
    parts = max(1, n // RANK_ROWS)
    ranged = shared_table(distinct.repartitionByRange(parts, name).withColumn("part", F.spark_partition_id()), "ranges")
    before = F.sum("n").over(Window.orderBy("part")) - F.col("n")  # one row a range
    starts = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", before.alias("start"))
    within = F.row_number().over(Window.partitionBy("part").orderBy(name))
    return ranged.withColumn("i", within).join(starts, "part").select(name, (F.col("start") + F.col("i") - 1).alias("rank")), n


def constant(values: list, kind: str) -> Column:
    """An array that the driver knows, as one constant of the plan."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def shard_count(sizes: DataFrame, target_bytes: int) -> int:
    total = sizes.agg(F.sum("size")).first()[0] or 0
    return max(1, math.ceil(total / target_bytes))


def kd_shards(df: DataFrame, dimensions: dict[str, Column], n_shards: int | None = None, target_bytes: int | None = None, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """Shards of ``df``: (row_id, size, text_crc32, law, shard, slot, grown_shard), one row for each of its rows.

    Give the number of shards, or the bytes that a shard should have at most on average. ``dimensions`` are columns or
    expressions by name, numbers or strings. Sizes of shards differ by about one row, or one
    group of equal texts that is no unit. Equal texts are in one shard, unless they alone are more than a shard.

    Null texts count 16 bytes and have the CRC of the empty text; null coordinates sort first. Equal rows are told
    apart by their place in the scan, so a large group of them is cut like any others. A very long text is one row,
    which is never split. An empty table gives no rows, and shards stay empty when there are fewer rows than shards.
    Other columns of ``df`` are ignored.
    """
    if (n_shards is None) == (target_bytes is None):
        raise ValueError("give n_shards or target_bytes")
    kinds = [f.dataType.simpleString() for f in df.select(*dimensions.values()).schema]
    # Columns are chosen by position below, so names in df cannot clash with the names used here.
    whole = F.coalesce(F.col(text), F.lit(""))
    values = [F.coalesce(c, F.lit("")).alias(f"d{i}") if kind == "string" else c.cast("double").alias(f"d{i}") for i, (c, kind) in enumerate(zip(dimensions.values(), kinds))]
    base = df.select(F.col(row_id).alias("id"), text_size(F.col(text)).alias("size"), F.crc32(F.encode(whole, "UTF-8")).alias("crc"), F.xxhash64(whole).alias("hash"), *values)
    base = shared_table(base.withColumn("row", F.monotonically_increasing_id()), "sizes")
    if n_shards is None:
        n_shards = shard_count(base, target_bytes)

    ndim = len(dimensions)
    numeric = [i for i in range(ndim) if kinds[i] != "string"]
    span = base.agg(F.sum("size").alias("bytes"), *[f(F.nanvl(f"d{i}", F.lit(None).cast("double"))).alias(f"{n}{i}") for i in numeric for n, f in (("lo", F.min), ("hi", F.max))]).first()
    rows = base
    for i in range(ndim):
        if i in numeric:
            low, width = span[f"lo{i}"], (span[f"hi{i}"] or 0.0) - (span[f"lo{i}"] or 0.0)
            code = F.floor(F.nanvl((F.col(f"d{i}") - low) / width * (CODES - 1), F.lit(0.0))) if width > 0 else F.lit(0)
        else:
            ranking, n = ranks(base, f"d{i}")
            rows = rows.join(ranking.withColumnRenamed("rank", f"r{i}"), f"d{i}")
            code = F.floor(F.col(f"r{i}") / max(1, n - 1) * (CODES - 1))
        rows = rows.withColumn(f"c{i}", F.least(F.greatest(F.coalesce(code.cast("long"), F.lit(0).cast("long")), F.lit(0)), F.lit(CODES - 1)))
    codes = [f"c{i}" for i in range(ndim)]
    rows = shared_table(rows.select("id", "size", "crc", "hash", "row", *codes), "codes")
    group = ["hash", "crc", "size"]
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row", *codes)).alias("first")
    groups = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), first).filter("n > 1")
    leaf = (span["bytes"] or 0) / n_shards
    tie_of_group = F.pmod(F.xxhash64(*group), F.lit(1 << 25)) * ALONE
    weight = (F.col("n") * F.col("size")).alias("weight")
    groups = groups.select(*group, weight, (weight > UNIT * leaf).alias("unit"), *[(F.col(f"first.{c}") * TIES + tie_of_group).alias(f"g{c[1:]}") for c in codes])
    groups = shared_table(groups.filter(F.col("weight") <= leaf), "groups")
    units = [(r.asDict(), 0) for r in groups.filter("unit").collect()]
    # The groups are written, so the rows of a hot group can be split in the join.
    rows = rows.join(groups, group, "left")
    alone = tie_of_group + F.pmod(F.xxhash64("id", "row"), F.lit(ALONE))
    rows = rows.select(*group, "id", "row", F.coalesce("unit", F.lit(False)).alias("unit"), *[F.coalesce(f"g{c[1:]}", F.col(c) * TIES + alone).alias(f"k{c[1:]}") for c in codes], F.lit(0).cast("int").alias("base"))
    placed = shared_table(rows, "coordinates")
    rows = placed.filter("NOT unit").drop("unit", "hash")

    # A node is known by its path; every level doubles the numbers. wanted[node] is its number of shards.
    wanted, splits, base_nodes = [n_shards], [], 1
    while max(wanted) > 1:
        splits.append(_cut_level(rows, splits, base_nodes, wanted, ndim, units))
        wanted = [w for n in wanted for w in ((n, 0) if n <= 1 else (n // 2, n - n // 2))]
        if len(splits) == TREE_LEVELS:
            down = _descend(rows, splits, base_nodes, ndim)
            rows, splits, base_nodes = shared_table(down.drop("base").withColumnRenamed("node", "base"), "nodes"), [], len(wanted)
    shards, shard_of = 0, []
    for n in wanted:
        shard_of.append(shards)
        shards += n
    facts = ["id", "size", F.col("crc").alias("text_crc32"), "row"]
    others = _descend(rows, splits, base_nodes, ndim).select(*facts, F.get(constant(shard_of, "int"), F.col("node")).alias("shard"))
    homes = constant([{"hash": u["hash"], "crc": u["crc"], "size": u["size"], "shard": shard_of[node]} for u, node in units], "struct<hash:bigint,crc:bigint,size:bigint,shard:int>")
    homes = shared_table(df.sparkSession.range(1).select(F.inline(homes)), "homes")
    placed = others.unionByName(placed.filter("unit").join(homes, group).select(*facts, "shard"))
    buckets = max(8, math.ceil(base.count() / n_shards / SLOT_ROWS))
    order = F.xxhash64("text_crc32", "id", "row")
    slots = ranked(placed, ["shard"], [order, F.col("row")], F.xxhash64("row", F.lit(7)), buckets, "slot")
    return slots.select(F.col("id").alias(row_id), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _descend(rows: DataFrame, splits: list[tuple[list[int], list[int]]], base_nodes: int, ndim: int) -> DataFrame:
    """``rows`` with the node that each is in, by the splits of the levels below its base node.

    A base node's subtree is two arrays in the order of levels, so a step down is one comparison."""
    if not splits:
        return rows.withColumn("node", F.col("base"))
    levels = len(splits)
    dims, cuts = ([[x for level, side in enumerate(splits) for x in side[k][b << level : (b + 1) << level]] for b in range(base_nodes)] for k in (0, 1))
    found = rows.withColumns({"dims": F.get(constant(dims, "array<int>"), F.col("base")), "cuts": F.get(constant(cuts, "array<bigint>"), F.col("base"))})
    keys = F.array(*[F.col(f"k{i}") for i in range(ndim)])

    def step(i: Column, _: Column) -> Column:
        return 2 * i + 1 + F.when(F.get(keys, F.get("dims", i)) > F.get("cuts", i), 1).otherwise(0)

    local = F.aggregate(F.sequence(F.lit(1), F.lit(levels)), F.lit(0), step) - ((1 << levels) - 1)
    return found.withColumn("node", (F.col("base") * (1 << levels) + local).cast("int")).drop("dims", "cuts")


def _cut_level(rows: DataFrame, splits: list, base_nodes: int, wanted: list[int], ndim: int, units: list[tuple[dict, int]]) -> tuple[list[int], list[int]]:
    """For each node of a level, the dimension along which it is cut and the last coordinate of its left part.

    ``units`` are groups with the node that each is in; they are moved to the nodes of the next level."""
    nodes = len(wanted)
    rows = _descend(rows, splits, base_nodes, ndim)
    wide = {r["node"]: r for r in rows.groupBy("node").agg(F.sum("size").alias("w"), *[f(f"k{i}").alias(f"{n}{i}") for i in range(ndim) for n, f in (("lo", F.min), ("hi", F.max))]).collect()}
    dims, lo, hi, target, leaf, before = [0] * nodes, [0] * nodes, [0] * nodes, [0.0] * nodes, [0.0] * nodes, [0] * nodes
    cuts = [WHOLE] * nodes
    live, own = set(), [[] for _ in range(nodes)]
    for u, n in units:
        own[n].append(u)
    units.clear()
    for n in range(nodes):
        r = wide.get(n)
        light, heavy = r["w"] if r else 0, sum(u["weight"] for u in own[n])
        if wanted[n] < 2 or not light + heavy:
            units += [(u, 2 * n) for u in own[n]]
            continue
        ends = [[u[f"g{i}"] for u in own[n]] + ([r[f"lo{i}"], r[f"hi{i}"]] if r else []) for i in range(ndim)]
        spread = [max(e) // TIES - min(e) // TIES for e in ends]
        dims[n] = d = spread.index(max(spread))
        share, leaf[n] = (wanted[n] // 2) / wanted[n], (light + heavy) / wanted[n]
        left, misses = 0, heavy * share
        for u in sorted(own[n], key=lambda u: (u[f"g{d}"], u["hash"])):
            at_left = misses >= 0 and abs(heavy * share - left - u["weight"]) <= misses
            misses = heavy * share - left - u["weight"] if at_left else -1
            left += u["weight"] * at_left
            units.append((u, 2 * n + (not at_left)))
        target[n] = min(max((light + heavy) * share - left, 0), light)
        if r and 0 < target[n] < light:
            lo[n], hi[n] = r[f"lo{d}"], r[f"hi{d}"]
            live.add(n)
        elif r and not target[n]:
            cuts[n] = r[f"lo{d}"] - 1
    key = F.get(F.array(*[F.col(f"k{i}") for i in range(ndim)]), F.col("dim"))
    while live:
        step = {n: max(1, -(-(hi[n] - lo[n] + 1) // BINS)) for n in live}
        facts = {"dim": ("int", dims), "lo": ("bigint", lo), "hi": ("bigint", hi), "step": ("bigint", [step.get(n, 1) for n in range(nodes)]), "need": ("double", [t - b for t, b in zip(target, before)])}
        searched = rows.filter(F.get(constant([n in live for n in range(nodes)], "boolean"), F.col("node")))
        searched = searched.withColumns({name: F.get(constant(values, kind), F.col("node")) for name, (kind, values) in facts.items()})
        inside = searched.withColumn("key", key).filter("key BETWEEN lo AND hi")
        bins = inside.groupBy("node", F.expr("(key - lo) DIV step").alias("bin")).agg(F.sum("size").alias("w"), F.count(F.lit(1)).alias("n"), F.first("need").alias("need"))
        up_to = F.sum("w").over(Window.partitionBy("node").orderBy("bin"))
        found = bins.withColumn("cum", up_to).filter("cum >= need").groupBy("node").agg(F.min_by(F.struct("bin", "cum", "w", "n"), "bin").alias("b"))
        for r in found.select("node", "b.*").collect():
            n = r["node"]
            left = before[n] + r["cum"] - r["w"]
            edge = lo[n] + r["bin"] * step[n]
            if step[n] == 1 or r["n"] <= 1 or r["w"] <= EXACT * leaf[n]:
                nearer = target[n] - left < r["w"] / 2  # the whole bin goes to the side that it misses less
                cuts[n] = edge - 1 if nearer else edge + step[n] - 1
                live.discard(n)
            else:
                before[n], lo[n], hi[n] = left, edge, min(hi[n], edge + step[n] - 1)
    return dims, cuts


def document_dimensions() -> dict[str, Column]:
    """Metadata of documents: where they come from, their language, their length (as a power of two) and their id."""
    return {"source": F.col("source"), "lang": F.col("lang"), "length": F.log2(text_size(F.col("text"))), "doc_id": F.col("doc_id")}
