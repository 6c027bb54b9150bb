"""The pipeline's stages against plain Python, each on what the one before it kept."""

import re

import duckdb
import pytest

import corpus_pipeline as P
from verdigris.llm import quality
from verdigris.llm.packing import pieces_of
from verdigris.llm.queries import ORACLE_SQL, QUERIES

from . import test_exact_dedup, test_jaccard_join


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out, before = {}, docs
    for name, stage in P.STAGES:
        out[name] = P.shared_table(stage(spark, before, sf), name)
        if name != "packing":
            assert out[name].dtypes == docs.dtypes
            before = out[name]
    rows = {n: sorted((r["doc_id"], r["text"]) for r in d.collect()) for n, d in out.items() if n != "packing"}
    good = quality.quality_report(docs, labels).filter("predicted = 1").select("doc_id").collect()
    assert [i for i, _ in rows["quality"]] == sorted(r["doc_id"] for r in good)
    assert [i for i, _ in rows["exact_dedup"]] == sorted(r[0] for r in test_exact_dedup.brute(rows["quality"]) if r[3])
    groups = test_jaccard_join.brute(rows["exact_dedup"])
    assert [i for i, _ in rows["near_dedup"]] == sorted({g[2] for g in groups})
    assert [i for i, _ in rows["pii"]] == [i for i, _ in rows["near_dedup"]]
    private = r"[\w.]+@mail\d+\.example\.com|\+1 \(\d{3}\) 555-\d{4}|\b4\d{15}\b|password=[0-9a-f]{18}"
    for (_, old), (_, new) in zip(rows["near_dedup"], rows["pii"]):
        values = set(re.findall(private, old))
        assert not any(v in new for v in values) and (values or "@" in old or old == new or re.search(r"\d", old))
    pieces = out["packing"].collect()
    assert {r["doc_id"] for r in pieces} == {i for i, _ in rows["pii"]}
    by_doc, used = {}, {}
    for r in pieces:
        by_doc.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(sorted(p) == pieces_of(sum(n for _, n in p)) for p in by_doc.values())
    assert all(sum(n for _, n in p) <= 1024 for p in used.values())


def test_every_operator_has_a_query():
    assert sorted(int(m[1]) for n in QUERIES if (m := re.match(r"op(\d+)_", n))) == list(range(1, 14))
    assert set(ORACLE_SQL) <= set(QUERIES)
    assert [n for n, _ in P.STAGES] == ["quality", "exact_dedup", "near_dedup", "pii", "packing"]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = QUERIES[name](spark, sf), con.sql(ORACLE_SQL[name])
    names = sorted(got.columns)
    assert sorted(want.columns) == names
    at = [want.columns.index(n) for n in names]
    assert sorted(map(repr, map(tuple, got.select(*names).collect()))) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())
