"""The document audit: signals, font evidence, the verdict cascade and its reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarazu.functions import fonts as fn
from tarazu.functions import signals as s

VERDICTS = ("SCAN", "LEGACY", "SUSPECT", "UNCLASSIFIED", "CLEAN")
PAGE_BREAK = "\f"


def page_count(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(PAGE_BREAK), F.lit(""))) + 1).cast("long")


def files(documents: DataFrame) -> DataFrame:
    """One row per content hash with its document signals; the first doc_id's provenance wins.

    The signals are taken before the shuffle, so the texts themselves do not move. Every
    column is picked on its own, so a report computes only the signals it needs.
    """
    got = documents.where(F.col("sha256").isNotNull() & F.col("doc_id").isNotNull())
    narrow = ["doc_id", "sha256", "source_key", "issuing_body", "doc_type", "lang", "source"]
    measured = s.with_document_signals(got.select(*narrow, "text"), "text").withColumn("pages", F.coalesce(page_count(F.col("text")), F.lit(1))).drop("text")
    first = [F.min_by(c, "doc_id").alias(c) for c in measured.columns if c not in ("sha256", "doc_id")]
    return measured.groupBy("sha256").agg(F.min("doc_id").alias("doc_id"), *first)


def font_evidence(observations: DataFrame) -> DataFrame:
    """Per file: fonts seen, named as legacy, convicted by their output, and unknown ones without a Unicode map."""
    o = observations.dropDuplicates(["obs_id"])
    legacy = fn.matches(F.col("font_name"), fn.LEGACY_PATTERNS)
    unknown = ~legacy & ~fn.matches(F.col("font_name"), fn.KNOWN_GOOD) & (F.col("embedded") == 1) & (F.col("has_tounicode") == 0)
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return o.groupBy("sha256").agg(
        F.count(F.lit(1)).alias("n_fonts"),
        count(legacy).alias("n_legacy_names"),
        count(F.col("detector_label").isin(*fn.CONVICTED_BY_OUTPUT)).alias("n_legacy_by_output"),
        count(unknown).alias("n_unknown"),
        F.coalesce(F.bool_or(F.col("signals_version").endswith("+deep")), F.lit(False)).alias("is_deep"),
    )


def verdict() -> Column:
    """First match wins."""
    return (
        F.when((F.col("n_fonts") == 0) | (F.col("chars") / F.greatest("pages", F.lit(1)) < s.SCAN_CHARS_PER_PAGE), "SCAN")
        .when((F.col("n_legacy_names") > 0) | (F.col("n_legacy_by_output") > 0), "LEGACY")
        .when((F.col("invalid_rate_per_1k") >= s.SUSPECT_RATE_PER_1K) & (F.col("invalid_matras") >= s.SUSPECT_MIN_ABS), "SUSPECT")
        .when(F.col("n_unknown") > 0, "UNCLASSIFIED")
        .otherwise("CLEAN")
    )


def audited(documents: DataFrame, observations: DataFrame) -> DataFrame:
    """Every file with its signals, font evidence and verdict."""
    got = files(documents).join(font_evidence(observations), "sha256", "left")
    counts = ("n_fonts", "n_legacy_names", "n_legacy_by_output", "n_unknown")
    got = got.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in counts} | {"is_deep": F.coalesce("is_deep", F.lit(False))})
    return got.withColumn("verdict", verdict())


def breakdown(audit: DataFrame, column: str) -> DataFrame:
    """Rows and verdict percentages by one column of provenance."""
    return audit.groupBy(column).agg(
        F.count(F.lit(1)).alias("n"),
        *(F.round(100.0 * F.count_if(F.col("verdict") == v) / F.count(F.lit(1)), 6).alias(f"pct_{v.lower()}") for v in VERDICTS),
    )


def macro_pooled(rows: DataFrame, group: str, hit: Column, among: Column | None = None) -> DataFrame:
    """One row: the mean of the groups' rates, the pooled rate, and the largest group's share.

    Groups without a scored row do not count. A null group is a group.
    """
    scored = F.lit(True) if among is None else F.coalesce(among, F.lit(False))
    per = rows.groupBy(group).agg(
        F.count_if(scored).alias("den"), F.count_if(scored & F.coalesce(hit, F.lit(False))).alias("num")
    ).where("den > 0")
    return per.agg(
        F.count(F.lit(1)).alias("n_groups"),
        F.sum("den").alias("n"),
        F.round(F.avg(F.col("num") / F.col("den")), 6).alias("macro"),
        F.round(F.sum("num") / F.sum("den"), 6).alias("pooled"),
        F.round(F.max("den") / F.sum("den"), 6).alias("largest_share"),
    )


def decision(audit: DataFrame) -> DataFrame:
    """GO, PIVOT or INSPECT from the shares of affected and unidentified files."""
    n = F.count(F.lit(1))
    row = audit.agg(
        n.alias("n"),
        F.round(100.0 * F.count_if(F.col("verdict").isin("LEGACY", "SUSPECT")) / n, 6).alias("affected_pct"),
        F.round(100.0 * F.count_if(F.col("verdict") == "UNCLASSIFIED") / n, 6).alias("unclassified_pct"),
    )
    a, u = F.col("affected_pct"), F.col("unclassified_pct")
    return row.withColumn("decision", F.when((a >= 15) | ((a >= 5) & (u >= 15)), "GO").when(a + u < 10, "PIVOT").otherwise("INSPECT"))
