"""One query per operator, over its whole table with production parameters, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import exact_dedup, jaccard_join, lexical, licenses, packing, pieces, pii, quality, sharding, syncmers, toxicity, warc, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.kd_shards(table(spark, sf_dir, "documents"), sharding.document_dimensions(), n_shards=40)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the public tokenizers lie on every machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_report(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives_of_pages(table(spark, sf_dir, "pages")).drop("record").withColumnRenamed("id", "page_id")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


#: For the query only: with a real corpus, pass a secret of your own.
PSEUDONYM_KEY = "public demonstration key"


def op7_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.pseudonymise(table(spark, sf_dir, "documents"), PSEUDONYM_KEY, counts="found")
    return out.select("doc_id", "text", *[F.col("found")[k].alias(f"n_{k}") for k in pii.KINDS])


def op8_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoding_report(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), rate=0.1, seed=1)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup_report(table(spark, sf_dir, "documents"))


def op10_closed_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprints_with_neighbours(table(spark, sf_dir, "documents"))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_report(table(spark, sf_dir, "documents"))


def op12_jacobi_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitening_report(table(spark, sf_dir, "embeddings"))


def op13_maxscore_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# What SQL can say of operators whose whole result it can't: their laws, over the whole tables.


def shard_laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of operator 1: the shards' bytes and rows, and whether slots have no gaps and sizes differ by little."""
    shards = op1_kd_shards(spark, sf_dir).groupBy("shard").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"), F.countDistinct("slot").alias("slots"), F.max("slot").alias("last"), F.max("size").alias("largest"))
    gapless = F.bool_and((F.col("slots") == F.col("n")) & (F.col("last") == F.col("n") - 1))
    near = (F.max("bytes") - F.min("bytes")) <= F.max("largest") + sharding.UNIT * F.avg("bytes")
    return shards.agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n_rows"), gapless.alias("gapless"), near.alias("near_equal"))


def shard_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of operator 1: the size of each row."""
    return op1_kd_shards(spark, sf_dir).select("doc_id", "size")


def conversion_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of operator 5: the records of each page, and whether either leads to the other and both to their source."""
    d = op5_warc_derivatives(spark, sf_dir)
    one = d.groupBy("page_id", "target_uri").agg(F.count(F.lit(1)).alias("records"), F.countDistinct("refers_to").alias("sources"), F.countDistinct("payload_digest").alias("payloads"), (F.sort_array(F.collect_set("record_id")) == F.sort_array(F.collect_set("concurrent_to"))).alias("linked"))
    return one.withColumnRenamed("target_uri", "url")


def packing_laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of operator 6: whether each document's pieces follow each other, and its sequences are full without gaps."""
    d = op6_best_fit_packing(spark, sf_dir)
    place = Window.partitionBy("sequence_id").orderBy("offset")
    part = Window.partitionBy("doc_id").orderBy("piece")
    ends = d.withColumn("fits", (F.col("offset") == F.coalesce(F.lag(F.col("offset") + F.col("length")).over(place), F.lit(0))) & (F.col("offset") + F.col("length") <= packing.CAPACITY))
    ends = ends.withColumn("follows", (F.col("start") == F.coalesce(F.lag(F.col("start") + F.col("length")).over(part), F.lit(0))) & ((F.col("piece") == 0) | (F.col("length") == packing.CAPACITY)))
    return ends.groupBy("doc_id").agg(F.bool_and("fits").alias("fits"), F.bool_and("follows").alias("follows"))


def fingerprint_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of operator 10: the lengths and edited texts that likenesses are measured on."""
    return op10_closed_syncmers(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def whitening_deviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of operator 12: how far each vector is from the mean, and the laws of its components."""
    d = op12_jacobi_whitening(spark, sf_dir)
    d = d.withColumn("lower", F.col("explained") <= F.coalesce(F.lag("explained").over(Window.partitionBy("vec_id").orderBy("component")), F.lit(1.0)))
    return d.groupBy("vec_id", "n", "deviation").agg(F.count(F.lit(1)).alias("components"), F.bool_and("lower").alias("falling"), F.bool_and(F.col("identity_error") <= 1e-4).alias("identity"))


QUERIES = {
    "shard_laws": shard_laws,
    "shard_sizes": shard_sizes,
    "conversion_links": conversion_links,
    "packing_laws": packing_laws,
    "fingerprint_edits": fingerprint_edits,
    "whitening_deviations": whitening_deviations,
    "op1_kd_shards": op1_kd_shards,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_toxicity": op3_toxicity,
    "op4_quality": op4_quality,
    "op5_warc_derivatives": op5_warc_derivatives,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_feistel_pseudonyms": op7_feistel_pseudonyms,
    "op8_merge_dropout": op8_merge_dropout,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_closed_syncmers": op10_closed_syncmers,
    "op11_license_scan": op11_license_scan,
    "op12_jacobi_whitening": op12_jacobi_whitening,
    "op13_maxscore_search": op13_maxscore_search,
}


def _license_sql() -> str:
    """All pairs of blocks and templates, without filters."""
    sets = ", ".join(f"('{label}', {licenses.words_in(t)})" for label, t in licenses.TEMPLATES)
    starts = ", ".join(f"list_filter(range(len(words)), lambda i: {' AND '.join(f'words[i + {k + 1}] = {w!r}' for k, w in enumerate(phrase.split()))})" for phrase in licenses.PHRASES)
    base = ", ".join(f"CASE WHEN len(spots[{k + 1}]) > 0 THEN '{label}' END" for k, label in enumerate(licenses.PHRASES.values()))
    return f"""
        WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}') AS low FROM documents),
        w AS (SELECT doc_id, low, regexp_extract_all(low, '{licenses.WORD}') AS words FROM d),
        f AS (SELECT doc_id, len(words) AS n_words, [{starts}] AS spots FROM w),
        b AS (SELECT doc_id, list_distinct(regexp_extract_all(unnest(string_split_regex(low, '{licenses.CUT}')), '{licenses.WORD}')) AS own FROM d),
        t(label, words) AS (VALUES {sets}),
        p AS (SELECT doc_id, label, len(list_intersect(own, words)) / len(words)::DOUBLE AS c FROM b JOIN t ON len(list_intersect(own, words)) >= ceil({licenses.THRESHOLD} * len(words) - 1e-9)),
        best AS (SELECT doc_id, list(DISTINCT label) AS more, max(c) AS most FROM p GROUP BY doc_id),
        l AS (SELECT f.doc_id, n_words, flatten(spots) AS starts, list_filter([{base}], lambda x: x IS NOT NULL) AS base, coalesce(more, []) AS more, most FROM f LEFT JOIN best USING (doc_id))
        SELECT doc_id, n_words, len(starts) AS n_base, list_min(starts) AS first_word, list_max(starts) AS last_word,
            array_to_string(list_sort(list_distinct(base)), ',') AS base_labels, array_to_string(list_sort(list_distinct(base || more)), ',') AS labels,
            CASE WHEN len(starts) > 0 THEN 1.0::DOUBLE ELSE coalesce(most, 0.0)::DOUBLE END AS score
        FROM l
    """


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_WHOLE = f"list_transform(c, lambda x: CAST(floor({whitening.SCALE} * x::DOUBLE) AS BIGINT) + {whitening.OFFSET})"

ORACLE_SQL: dict[str, str] = {
    "shard_laws": "SELECT CAST(sum(strlen(coalesce(text, '')) + 16) AS BIGINT) AS bytes, count(*) AS n_rows, true AS gapless, true AS near_equal FROM documents",
    "shard_sizes": "SELECT doc_id, CAST(strlen(coalesce(text, '')) + 16 AS BIGINT) AS size FROM documents",
    "conversion_links": "SELECT page_id, url, 2::BIGINT AS records, 1::BIGINT AS sources, 1::BIGINT AS payloads, true AS linked FROM pages",
    "packing_laws": "SELECT doc_id, true AS fits, true AS follows FROM documents",
    "fingerprint_edits": """
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        n AS (SELECT doc_id, text, coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC)) AS ahead FROM t)
        SELECT doc_id, length(text) AS n_chars, sha256(left(text, CAST(length(text) - length(text) // 3 AS BIGINT)) || left(ahead, CAST(length(text) // 3 AS BIGINT))) AS edited_sha256 FROM n
    """,
    "whitening_deviations": f"""
        WITH c AS (SELECT row_number() OVER () AS r, vec_id, embedding AS c FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        x AS (SELECT r, vec_id, unnest({_WHOLE}) AS x, unnest(range(len(c))) AS i FROM c),
        s AS (SELECT i, sum(x)::HUGEINT AS s, count(*) AS n FROM x GROUP BY i)
        SELECT vec_id, n, sum((n * x - s) * (n * x - s))::BIGINT AS deviation, 8::BIGINT AS components, true AS falling, true AS identity
        FROM x JOIN s USING (i) GROUP BY r, vec_id, n
    """,
    "op11_license_scan": _license_sql(),
    "op13_maxscore_search": f"""
        WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{licenses.UPPER}', '{licenses.LOWER}'), '{_TERM}')) AS term FROM documents),
        tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
        d AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
        a AS (SELECT count(*) AS N_, sum(n)::BIGINT AS L FROM d),
        q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{licenses.UPPER}', '{licenses.LOWER}'), '{_TERM}')) AS term FROM benchmark),
        w AS (SELECT term, floor(1000 * ln((2 * N_ + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, a GROUP BY term, N_),
        s AS (
            SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * N_) // L))))::BIGINT AS score
            FROM q JOIN w USING (term) JOIN tf USING (term) JOIN d USING (doc_id), a GROUP BY item_id, doc_id
        ),
        r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s WHERE score > 0)
        SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 10
    """,
    "op9_exact_dedup": """
        WITH n AS (
            SELECT doc_id, length(coalesce(text, '')) AS c, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS s
            FROM documents
        ), k AS (
            SELECT doc_id, s, first_value(doc_id) OVER (PARTITION BY s ORDER BY c DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY s) AS group_size
            FROM n
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, s AS text_sha256 FROM k
    """,
}
