"""Problem 4: consensus labels from annotators who disagree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarazu.functions.labels import SQL_ANNOTATOR, SQL_LABEL
from tarazu.llm.consensus import Consensus, Votes, consensus, votes
from tarazu.session import table

LEAST_ANNOTATORS = 3


def _votes(spark: SparkSession, d: str) -> Votes:
    rows = table(spark, d, "annotation").select("obs_id", "annotator", "label", "round", "annotated_at", "annotation_id")
    return votes(rows, "obs_id", "annotator", "label", ["round", "annotated_at", "annotation_id"])


def _consensus(spark: SparkSession, d: str) -> Consensus:
    return consensus(_votes(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    got = _consensus(spark, d).items
    return got.where(F.col("n_annotators") >= LEAST_ANNOTATORS).select(F.col("item").alias("obs_id"), "label")


def p4_consensus(spark: SparkSession, d: str) -> DataFrame:
    """Every labelled observation with its consensus, agreement and support."""
    got = _consensus(spark, d).items
    return got.select(
        F.col("item").alias("obs_id"), "label", "n_annotators", F.round("agreement", 6).alias("agreement"), F.round("support", 6).alias("support")
    )


def p4_agreement(spark: SparkSession, d: str) -> DataFrame:
    """The part of the consensus that does not depend on weights: votes and their agreement."""
    return p4_consensus(spark, d).select("obs_id", "n_annotators", "agreement")


def p4_annotators(spark: SparkSession, d: str) -> DataFrame:
    """Reliability per annotator."""
    got = _consensus(spark, d)
    shown = got.annotators.select("annotator", "n_votes", F.round("error_rate", 6).alias("error_rate"), F.round("weight", 6).alias("weight"))
    return shown.withColumn("converged", F.lit(got.converged))


def p4_violations(spark: SparkSession, d: str) -> DataFrame:
    """Consensus labels nobody gave, or with an impossible support or agreement; none is to be found."""
    v = _votes(spark, d)
    got = consensus(v).items
    nobody = got.join(v.last.select("item", "label"), ["item", "label"], "left_anti").select("item")
    odd = got.where(~F.col("support").between(0, 1.0000001) | (F.col("support") <= 0) | ~F.coalesce(F.col("agreement").between(0, 1), F.lit(True)) | (F.col("n_annotators") < 1)).select("item")
    return nobody.unionByName(odd).select(F.col("item").alias("obs_id")).distinct()


QUERIES = {"p4_violations": p4_violations, "p4_found": p4_found, "p4_consensus": p4_consensus, "p4_agreement": p4_agreement, "p4_annotators": p4_annotators}
SQL = {
    "p4_violations": "SELECT 0::BIGINT AS obs_id WHERE false",
    "p4_agreement": f"""
WITH v AS (SELECT obs_id, {SQL_ANNOTATOR} AS a, {SQL_LABEL} AS l, round, annotated_at, annotation_id FROM annotation WHERE obs_id IS NOT NULL),
w AS (SELECT obs_id, l, row_number() OVER (PARTITION BY obs_id, a ORDER BY round DESC NULLS LAST, annotated_at DESC NULLS LAST, annotation_id DESC) AS r FROM v WHERE a IS NOT NULL AND l IS NOT NULL),
c AS (SELECT obs_id, l, count(*) AS n FROM w WHERE r = 1 GROUP BY 1, 2),
t AS (SELECT obs_id, sum(n)::BIGINT AS n, sum(n * (n - 1)) AS same FROM c GROUP BY 1)
SELECT obs_id, n AS n_annotators, CASE WHEN n > 1 THEN round(same / (n * (n - 1)), 6) END AS agreement FROM t
"""
}
