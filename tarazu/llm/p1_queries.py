"""Problem 1: one form for human and OCR readings that look the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarazu.llm.visual_form import visual_form
from tarazu.session import spread, table

COLUMNS = ["human_text", "ocr_text"]


def _plain(c: str):
    return F.regexp_replace(F.regexp_replace(F.col(c), "[ \\t\\r\\n]+", " "), "^ | $", "")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "transcription").where("human_text IS NOT NULL AND ocr_text IS NOT NULL").select("transcription_id", *COLUMNS)
    got = visual_form(spread(rows, "transcription_id"), COLUMNS)
    return got.where((_plain("human_text") != _plain("ocr_text")) & (F.col("human_text_form") == F.col("ocr_text_form"))).select("transcription_id").distinct()


def p1_forms(spark: SparkSession, d: str) -> DataFrame:
    """Both texts of every row in one form."""
    rows = table(spark, d, "transcription").select("transcription_id", *COLUMNS)
    return visual_form(spread(rows, "transcription_id"), COLUMNS).select("transcription_id", "human_text_form", "ocr_text_form").distinct()


def p1_violations(spark: SparkSession, d: str) -> DataFrame:
    """Forms that break a rule; none is to be found.

    Texts that are equal but for the kind and number of blanks have equal forms; a form
    has single spaces between its words, none at its ends, and no sign that draws nothing
    besides a joiner; null has no form and every other text has one.
    """
    rows = table(spark, d, "transcription").select("transcription_id", *COLUMNS)
    got = visual_form(spread(rows, "transcription_id"), COLUMNS)
    apart = (_plain("human_text") == _plain("ocr_text")) & (F.col("human_text_form") != F.col("ocr_text_form"))
    untidy = [F.col(f"{c}_form").rlike("^ | $|  |[\\t\\n\\r\\u00a0\\u200b\\ufeff\\u00ad\\uff01-\\uff5e]") for c in COLUMNS]
    missing = [F.col(c).isNull() != F.col(f"{c}_form").isNull() for c in COLUMNS]
    wrong = F.coalesce(apart, F.lit(False))
    for c in (*untidy, *missing):
        wrong = wrong | F.coalesce(c, F.lit(False))
    return got.where(wrong).select("transcription_id").distinct()


QUERIES = {"p1_found": p1_found, "p1_forms": p1_forms, "p1_violations": p1_violations}
SQL = {"p1_violations": "SELECT 0::BIGINT AS transcription_id WHERE false"}
