"""Release: the personal-data gate, the manifest with its summary, and checksum verification."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarazu.functions import charclass as cc
from tarazu.operators.audit import VERDICTS

# Java's and RE2's \b is ASCII; these are the Unicode word edges around a date of birth and a caste category.
EDGE = "[^\\p{L}\\p{N}_]"
DOB = f"(?:^|{EDGE})\\p{{Nd}}{{1,2}}[-/.]\\p{{Nd}}{{1,2}}[-/.](?:19|20)\\p{{Nd}}{{2}}(?:$|{EDGE})"
CASTE = f"(?:^|{EDGE})(?:SC|ST|OBC|NT|VJ|SBC|EWS)(?:$|{EDGE})"
# Columns that identify a document and may carry free text about it.
IDENTIFIERS = ("sha256", "filename", "source_url", "downloaded_at", "producer", "creator")


def personal_data(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per column outside the identifiers: values with Devanagari, with a date of birth, with a caste category.

    One pass over the rows; nothing is unpivoted before it is counted.
    """
    columns = [c for c in columns or df.columns if c not in IDENTIFIERS]
    text = lambda c: F.col(f"`{c}`").cast("string")
    rules = {"devanagari": cc.java(cc.DEVANAGARI), "dob": DOB, "caste": CASTE}
    counted = df.agg(*(F.count_if(text(c).rlike(rx)).alias(f"{i}_{k}") for i, c in enumerate(columns) for k, rx in rules.items()))
    rows = F.array(*(F.struct(F.lit(c).alias("column"), *(F.col(f"{i}_{k}").alias(k) for k in rules)) for i, c in enumerate(columns)))
    return counted.select(F.explode(rows).alias("x")).select("x.*")


class PersonalDataError(ValueError):
    """The gate found values that look like quoted document text."""


def gate(df: DataFrame, columns: Sequence[str] | None = None) -> None:
    """Abort an export whose columns quote documents."""
    found = [r.asDict() for r in personal_data(df, columns).where("devanagari > 0 OR dob > 0 OR caste > 0").collect()]
    if found:
        raise PersonalDataError("; ".join(f"{r['column']}: {r}" for r in found))


def manifest(documents: DataFrame, audit: DataFrame) -> DataFrame:
    """Documents with their verdict and measures, in the order of body and time of download."""
    measures = audit.select("sha256", "verdict", "pages", "chars", "dev_chars", "invalid_rate_per_1k", "n_fonts")
    rows = documents.select("sha256", "doc_id", "filename", "source_url", "issuing_body", "doc_type", "lang", "downloaded_at").join(measures, "sha256", "left")
    return rows.orderBy(F.col("issuing_body").asc_nulls_first(), "downloaded_at", "doc_id")


def summary(manifest_rows: DataFrame) -> DataFrame:
    """Documents by body and verdict, one column per verdict."""
    v = F.coalesce("verdict", F.lit("NONE"))
    return manifest_rows.groupBy("issuing_body").agg(F.count(F.lit(1)).alias("n"), *(F.count_if(v == x).alias(x.lower()) for x in (*VERDICTS, "NONE")))


def utc_now() -> Column:
    """The time of the query as text: 2025-01-31T23:59:59Z."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def write_release(documents: DataFrame, audit: DataFrame, out: str) -> None:
    """manifest.csv and summary.json under ``out``; refused if a column quotes documents."""
    rows = manifest(documents, audit)
    gate(rows.drop("downloaded_at"))
    rows.write.mode("overwrite").option("header", True).csv(f"{out}/manifest.csv")
    summary(rows).withColumn("exported_at", utc_now()).coalesce(1).write.mode("overwrite").json(f"{out}/summary.json")


def summary_json(summary_rows: DataFrame) -> str:
    """The summary as one JSON text; bodies are few by nature, beyond 100,000 it is refused."""
    got = summary_rows.limit(100_001).collect()
    if len(got) > 100_000:
        raise ValueError("too many bodies for one JSON text; write the table instead")
    return json.dumps({r["issuing_body"] or "(unknown)": {k: v for k, v in r.asDict().items() if k != "issuing_body"} for r in got}, ensure_ascii=False)


def verify_rebuild(manifest_rows: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Manifest rows against rebuilt content: verified, changed or unreachable.

    ``rebuilt``: doc_id, content_hash (null where the download failed).
    """
    got = manifest_rows.select("doc_id", F.col("content_hash").alias("want")).join(rebuilt.select("doc_id", "content_hash"), "doc_id", "left")
    status: Column = F.when(F.col("content_hash").isNull(), "unreachable").when(F.col("content_hash") == F.col("want"), "verified").otherwise("changed")
    return got.select("doc_id", status.alias("status"))
