"""Problem 8: held-out passages inside the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarazu.llm.containment import contained_items
from tarazu.session import spread, table

RUN = 12  # consecutive words
SHARE = 0.8  # of an item's shingles


def _pairs(spark: SparkSession, d: str, **how) -> DataFrame:
    docs = spread(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return contained_items(docs, "doc_id", "text", table(spark, d, "eval_passage"), "item_id", "text", **how)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d, run=RUN).select("doc_id", "item_id")


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """Which items leaked, into how many documents, and their largest contained part in windows."""
    return _pairs(spark, d, run=RUN).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"), F.max("n_windows").cast("long").alias("most_windows"))


def p8_contained(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold most of an item's shingles, whatever was edited between them."""
    return _pairs(spark, d, run=None, threshold=SHARE).select("doc_id", "item_id", F.round("containment", 6).alias("containment"))


QUERIES = {"p8_found": p8_found, "p8_items": p8_items, "p8_contained": p8_contained}
_WORDS = """
WITH fold AS (SELECT 'd' AS k, doc_id AS id, lower(regexp_replace(text, '\\p{Cf}+', '', 'g')) AS t FROM documents WHERE text IS NOT NULL
 UNION ALL SELECT 'i', item_id, lower(regexp_replace(text, '\\p{Cf}+', '', 'g')) FROM eval_passage WHERE text IS NOT NULL),
w AS (SELECT k, id, list_filter(string_split_regex(t, '[^\\p{L}\\p{M}\\p{Nd}]+'), lambda x: x <> '') AS w FROM fold),
g AS (SELECT DISTINCT k, id, array_to_string(w[i:i+{n}-1], ' ') AS g FROM (SELECT k, id, w, unnest(range(1, len(w) - {n} + 2)) AS i FROM w WHERE len(w) >= {n})),
hits AS (SELECT a.id AS doc_id, b.id AS item_id, count(*) AS n FROM g a JOIN g b ON a.g = b.g AND a.k = 'd' AND b.k = 'i' GROUP BY 1, 2)
"""
SQL = {
    "p8_found": _WORDS.replace("{n}", str(RUN)) + "SELECT doc_id, item_id FROM hits",
    "p8_items": _WORDS.replace("{n}", str(RUN)) + "SELECT item_id, count(*) AS n_documents, max(n) AS most_windows FROM hits GROUP BY 1",
    "p8_contained": _WORDS.replace("{n}", "5")
    + f"""SELECT doc_id, item_id, round(n / m, 6) AS containment FROM hits JOIN (SELECT id AS item_id, count(*) AS m FROM g WHERE k = 'i' GROUP BY 1) USING (item_id)
WHERE n >= {SHARE} * m""",
}
