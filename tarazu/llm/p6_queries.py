"""Problem 6: texts read under a wrong character table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarazu.llm.garble import garbled, train
from tarazu.session import spread, table


def _texts(spark: SparkSession, d: str) -> DataFrame:
    def of(field: str, key, text: str) -> DataFrame:
        name = field.partition(".")[0]
        return spread(table(spark, d, name).select(F.lit(field).alias("field"), key.alias("record_key"), F.col(text).alias("text")), "record_key")

    font_key = F.concat_ws("|", *(F.coalesce(c, F.lit("")) for c in ("run_id", "sha256", "font_name", "arm")))
    return (
        of("transcription.legacy_text", F.col("transcription_id").cast("string"), "legacy_text")
        .unionByName(of("excerpt.text", F.col("excerpt_id").cast("string"), "text"))
        .unionByName(of("font_extraction.text_sample", font_key, "text_sample"))
    )


def _garbled(spark: SparkSession, d: str) -> DataFrame:
    texts = _texts(spark, d)
    model = train(
        table(spark, d, "documents").select(F.col("doc_id").alias("ident"), "lang", "text"),
        texts.select(F.concat("field", F.lit("|"), "record_key").alias("ident"), "text"),
        table(spark, d, "mapping_entry"),
        table(spark, d, "transcription").select(F.col("transcription_id").alias("ident"), "family_id", F.col("legacy_text").alias("text")),
    )
    return garbled(texts, ["field", "record_key"], "text", model)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _garbled(spark, d).select("field", "record_key").distinct()


def p6_restored(spark: SparkSession, d: str) -> DataFrame:
    """The affected records with what was wrong and the text the page shows, where it can be had."""
    return _garbled(spark, d).distinct()


def p6_violations(spark: SparkSession, d: str) -> DataFrame:
    """Reports that contradict themselves; none is to be found.

    A report belongs to a text; what lost signs is not restored; a restored text differs
    from the text, holds no replacement sign, and, if nothing but an encoding was undone,
    is shorter or, for swapped bytes, as long.
    """
    texts = _texts(spark, d).where(F.col("text").isNotNull() & (F.col("text") != ""))
    got = p6_restored(spark, d).join(texts.distinct(), ["field", "record_key"], "left")
    restored = F.col("restored").isNotNull()
    wrong = F.col("text").isNull() | ((F.col("kind") == "lost") & restored) | (restored & ((F.col("restored") == F.col("text")) | F.contains("restored", F.lit("\ufffd"))))
    longer = (F.col("kind") == "encoding") & (F.length("restored") > F.length("text"))
    return got.where(wrong | F.coalesce(longer, F.lit(False))).select("field", "record_key").distinct()


QUERIES = {"p6_found": p6_found, "p6_restored": p6_restored, "p6_violations": p6_violations}
SQL = {"p6_violations": "SELECT '' AS field, '' AS record_key WHERE false"}
