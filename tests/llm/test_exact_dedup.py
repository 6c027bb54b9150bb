import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from .conftest import sentence
from verdigris.llm.exact_dedup import dedup_report, drop_exact_duplicates, rice_decode, rice_encode


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 2**20 - 1), min_size=1, max_size=300))
def test_golomb_round_trip(values):
    v = np.array(sorted(values), np.int64) + (5 << 20)
    bits, unary, rest = rice_encode(v, 5 << 20, 1 << 20)
    assert (rice_decode(len(v), 5 << 20, bits, unary, rest) == v).all()


def brute(rows):
    groups = {}
    for place, (i, t) in enumerate(rows):
        bare = "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")
        groups.setdefault(bare, []).append((-len(t or ""), i is None, i or 0, place, i))
    out = []
    for bare, own in groups.items():
        best = min(own)
        out += [(g[4], best[4], len(own), g[:3] == best[:3], hashlib.sha256(bare.encode()).hexdigest()) for g in own]
    return out


def key(r):
    return tuple((x is None, x or 0) if not isinstance(x, str) else x for x in r)


def test_odd_rows(odd, odd_rows):
    got = [tuple(r) for r in dedup_report(odd).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()]
    expect = brute([r[:2] for r in odd_rows])
    assert sorted(map(key, [(a, b, c, e) for a, b, c, _, e in got])) == sorted(map(key, [(a, b, c, e) for a, b, c, _, e in expect]))
    # exactly one row of each group stays, even of rows that are equal throughout
    kept = [r[4] for r in got if r[3]]
    assert sorted(kept) == sorted({r[4] for r in expect})


def test_columns_stay(odd, empty):
    left = drop_exact_duplicates(odd)
    assert left.columns == odd.columns and left.count() == len(set(r["text_sha256"] for r in dedup_report(odd).collect()))
    assert dedup_report(empty).count() == 0 and drop_exact_duplicates(empty).count() == 0


def test_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = sorted(map(key, [tuple(r) for r in dedup_report(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()]))
    assert got == sorted(map(key, brute([(r["doc_id"], r["text"]) for r in docs.collect()])))


def test_inputs_that_repeat_a_row_of_a_file(spark, sf, tmp_path):
    """Exploded, joined, sampled and united rows are told apart, and each scan sees the same ones."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    twice = spark.createDataFrame([(0,), (1,)], "n int")
    inputs = {
        "exploded": docs.select("doc_id", F.explode(F.split("text", r"[.\n]")).alias("text")).filter("doc_id < 40"),
        "joined": docs.filter("doc_id < 100").join(F.broadcast(twice), F.col("n") >= 0).drop("n"),
        "united": docs.filter("doc_id < 50").union(docs.filter("doc_id < 80")),
        "sampled": docs.sample(0.5, seed=3),
        "filtered": docs.filter("doc_id % 2 = 0").withColumnRenamed("text", "t").select("doc_id", F.upper("t").alias("text")),
    }
    for name, df in inputs.items():
        want = {"".join(c for c in r["text"] or "" if c not in " \t\n\x0b\x0c\r") for r in df.collect()}
        left = [r["text"] for r in drop_exact_duplicates(df).collect()]
        assert len(left) == len(want), name
    random = drop_exact_duplicates(docs.filter(F.rand() < 0.5)).collect()
    assert len({r["text"] for r in random}) == len(random)


def uneven(spark, folder, rows):
    """One file of row groups of unequal length, which tasks read in parts of other orders."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    path, at = f"{folder}/uneven.parquet", 0
    table = pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": [r[1] for r in rows]})
    with pq.ParquetWriter(path, table.schema, compression="none") as w:
        for n in (100, 200, 5000, 5000, 300):
            w.write_table(table.slice(at, n), row_group_size=n)
            at += n
    return spark.read.parquet(path)


def test_row_groups_of_unequal_length(spark, tmp_path):
    from verdigris.llm.jaccard_join import keep_one_of_each

    rows = [(i, f"row {i} " + sentence(i, 60)) for i in range(10_600)]
    for a, b in ((5, 5400), (6, 5500), (120, 10_400), (7000, 10_599), (3, 4)):
        rows[b] = (b, rows[a][1])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("1m", "200k", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            df = uneven(spark, tmp_path, rows)
            got = sorted(map(key, [tuple(r) for r in dedup_report(df).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()]))
            assert got == sorted(map(key, brute(rows)))
            left = {r["doc_id"] for r in drop_exact_duplicates(df).collect()}
            assert left == {i for i, _ in rows} - {5400, 5500, 10_400, 10_599, 4}
        assert {r["doc_id"] for r in keep_one_of_each(df.filter("doc_id % 50 < 7")).collect()}.isdisjoint({5400, 5500, 10_400} & {i for i in range(10_600) if i % 50 < 7})
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_more_marks_than_one_broadcast_takes(spark, sf, tmp_path, monkeypatch):
    """Bitmaps are dealt by file, each part to a scan of its own files, so no text is shuffled."""
    from verdigris.llm import common

    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(12).cache()
    docs.write.parquet(f"{tmp_path}/docs")
    files = spark.read.parquet(f"{tmp_path}/docs")
    whole = {r["doc_id"] for r in drop_exact_duplicates(files).collect()}
    monkeypatch.setattr(common, "BROADCAST_BYTES", 5000)
    found = drop_exact_duplicates(files)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert {r["doc_id"] for r in found.collect()} == whole
    executed = found._jdf.queryExecution().executedPlan().toString()
    assert "Union" in plan and "hashpartitioning" not in executed and "BroadcastHashJoin" in executed
