"""From documents to packed training sequences, in five stages; each is written and read again before the next.

1. quality: documents that the quality classifier rejects go.
2. exact_dedup: of equal texts, the one with the most code points stays, then the one of least id.
3. near_dedup: of each group of texts that five-word shingles link at a similarity of 0.8, one stays.
4. pii: personal data and secrets become format-preserving pseudonyms.
5. packing: the ids of all documents are packed into sequences of 1024 tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from verdigris.llm import exact_dedup, jaccard_join, packing, pii, quality
from verdigris.llm.common import shared_table
from verdigris.llm.queries import PSEUDONYM_KEY, tokenizer_path
from verdigris.ship import shipped


@shipped
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps; null and empty texts go (see ``quality.keep_quality``)."""
    return quality.keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@shipped
def drop_exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, white space aside; null texts are empty ones (see ``exact_dedup``)."""
    return exact_dedup.drop_exact_duplicates(docs)


@shipped
def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar texts; texts without words all stay (see ``jaccard_join``)."""
    return jaccard_join.keep_one_of_each(docs)


@shipped
def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The text changes, so n_chars does where a new value is shorter or longer (addresses)."""
    from pyspark.sql import functions as F

    out = pii.pseudonymise(docs, PSEUDONYM_KEY)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


@shipped
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all texts with their sequences and offsets; null texts are empty ones (see ``packing.pack``)."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality", keep_quality),
    ("exact_dedup", drop_exact_duplicates),
    ("near_dedup", keep_one_of_each_group),
    ("pii", pseudonymise),
    ("packing", pack),
]

#: Classifier, pseudonyms and tokenizer have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = shared_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
