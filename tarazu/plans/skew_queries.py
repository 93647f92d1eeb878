"""Problem 5: per-body results where a few bodies hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarazu.operators.skew import capped_per_key, heavy_keys, stitched_aggregate
from tarazu.session import table

HEAVY_SHARE = 0.05
CAP = 25


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").withColumn("at", F.col("doc_id"))


def _extractions(spark: SparkSession, d: str) -> DataFrame:
    # 8 bytes instead of the 64-character key: any order that spreads a body's rows will do.
    return table(spark, d, "extraction_sample").withColumn("at", F.xxhash64("run_id", "sha256"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    parts = [
        heavy_keys(df.select("issuing_body", "at"), "issuing_body", ["at"], HEAVY_SHARE).select(
            F.lit(name).alias("source_table"), "issuing_body"
        )
        for name, df in (("documents", _documents(spark, d)), ("extraction_sample", _extractions(spark, d)))
    ]
    return parts[0].unionByName(parts[1])


def p5_body_documents(spark: SparkSession, d: str) -> DataFrame:
    """Counts and rates per body over documents."""
    got = stitched_aggregate(
        _documents(spark, d),
        "issuing_body",
        ["at"],
        counts={
            "n_failed": F.col("sha256").isNull(),
            "n_blank": F.col("text").isNotNull() & (F.col("n_chars") <= 1),
            "n_typed": F.col("doc_type").isNotNull(),
        },
        sums={"chars": F.col("n_chars"), "bytes": F.col("size_bytes")},
    )
    return got.select(
        "issuing_body", "n", "n_failed", "n_blank", "n_typed", "chars", "bytes",
        F.round(F.col("n_failed") / F.col("n"), 6).alias("failed_rate"),
        F.round(F.col("n_typed") / F.col("n"), 6).alias("typed_rate"),
    )


def p5_body_extractions(spark: SparkSession, d: str) -> DataFrame:
    """Counts and rates per body over extraction_sample."""
    stratum = F.upper(F.trim("stratum"))
    got = stitched_aggregate(
        _extractions(spark, d),
        "issuing_body",
        ["at"],
        counts={
            "n_legacy": stratum == "LEGACY",
            "n_clean": stratum == "CLEAN",
            "n_without_prob": F.col("selection_prob").isNull(),
        },
    )
    return got.select(
        "issuing_body", "n", "n_legacy", "n_clean", "n_without_prob",
        F.round(F.col("n_legacy") / F.col("n"), 6).alias("legacy_rate"),
    )


def p5_body_cap(spark: SparkSession, d: str) -> DataFrame:
    """The first files of every body by arrival, at most CAP of each (a per-body cap)."""
    df = table(spark, d, "documents").where(F.col("issuing_body").isNotNull()).select("issuing_body", "downloaded_at", "doc_id")
    return capped_per_key(df, "issuing_body", ["downloaded_at", "doc_id"], CAP).select(
        "issuing_body", "doc_id", F.col("rank_in_key").cast("long").alias("rank_in_body")
    )


QUERIES = {
    "p5_found": p5_found,
    "p5_body_documents": p5_body_documents,
    "p5_body_extractions": p5_body_extractions,
    "p5_body_cap": p5_body_cap,
}

SQL = {
    "p5_found": """
SELECT 'documents' AS source_table, issuing_body FROM documents WHERE issuing_body IS NOT NULL
GROUP BY issuing_body HAVING count(*) >= 0.05 * (SELECT count(*) FROM documents)
UNION ALL
SELECT 'extraction_sample' AS source_table, issuing_body FROM extraction_sample WHERE issuing_body IS NOT NULL
GROUP BY issuing_body HAVING count(*) >= 0.05 * (SELECT count(*) FROM extraction_sample)
""",
    "p5_body_documents": """
SELECT issuing_body, count(*) AS n, count_if(sha256 IS NULL)::BIGINT AS n_failed,
 count_if(text IS NOT NULL AND n_chars <= 1)::BIGINT AS n_blank, count(doc_type) AS n_typed,
 sum(n_chars)::BIGINT AS chars, sum(size_bytes)::BIGINT AS bytes,
 round(count_if(sha256 IS NULL) / count(*)::DOUBLE, 6) AS failed_rate,
 round(count(doc_type) / count(*)::DOUBLE, 6) AS typed_rate
FROM documents GROUP BY issuing_body
""",
    "p5_body_extractions": """
SELECT issuing_body, count(*) AS n, count_if(upper(trim(stratum)) = 'LEGACY')::BIGINT AS n_legacy,
 count_if(upper(trim(stratum)) = 'CLEAN')::BIGINT AS n_clean, count_if(selection_prob IS NULL)::BIGINT AS n_without_prob,
 round(count_if(upper(trim(stratum)) = 'LEGACY') / count(*)::DOUBLE, 6) AS legacy_rate
FROM extraction_sample GROUP BY issuing_body
""",
    "p5_body_cap": """
SELECT issuing_body, doc_id, rank_in_body FROM (
 SELECT issuing_body, doc_id, row_number() OVER (PARTITION BY issuing_body ORDER BY downloaded_at NULLS FIRST, doc_id) AS rank_in_body
 FROM documents WHERE issuing_body IS NOT NULL) WHERE rank_in_body <= 25
""",
}
