"""The label workflow as pure transitions of DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarazu.functions import labels as lb
from tarazu.operators.dedupe import pick


def judgements(annotation: DataFrame) -> DataFrame:
    """Comparable judgements: one per (observation, annotator, round), the last written; empty ones left out."""
    rows = annotation.select(
        "annotation_id", "obs_id", "sample_id", lb.same_annotator(F.col("annotator")).alias("annotator"), "round",
        lb.same_label(F.col("label")).alias("label"), "confidence", "annotated_at",
    ).where("obs_id IS NOT NULL AND annotator IS NOT NULL AND label IS NOT NULL")
    return pick(rows, ["obs_id", "annotator", "round"], ["annotated_at", "annotation_id"], last=True)


def verdicts(votes: DataFrame) -> DataFrame:
    """Per observation: n, number of different labels, basis (single, unanimous, disagreed) and label or null."""
    n, k = F.count(F.lit(1)), F.count_distinct("label")
    basis = F.when(n == 1, "single").when(k == 1, "unanimous").otherwise("disagreed")
    return votes.groupBy("obs_id").agg(n.alias("n"), k.alias("n_labels"), basis.alias("basis"), F.when(k == 1, F.min("label")).alias("final_label"))


def next_state(current: DataFrame, verdict: DataFrame, include_single: bool = False) -> DataFrame:
    """The adjudication table after one automatic pass: obs_id, final_label, basis, adjudicator.

    Settled rows (any basis but single) stay. Unanimous observations are written, single
    ones only on request; a provisional single row is withdrawn where passes disagree.
    """
    old = current.select("obs_id", F.col("final_label").alias("o_label"), F.col("basis").alias("o_basis"), F.col("adjudicator").alias("o_by"))
    both = old.join(verdict.select("obs_id", "final_label", "basis"), "obs_id", "full_outer")
    settled = F.col("o_basis").isNotNull() & (F.col("o_basis") != "single")
    written = F.coalesce((F.col("basis") == "unanimous") | ((F.col("basis") == "single") & F.lit(include_single)), F.lit(False))
    withdrawn = F.coalesce(F.col("basis") == "disagreed", F.lit(False))
    keep = settled | (~written & ~withdrawn & F.col("o_basis").isNotNull())
    return both.where(keep | (written & ~settled)).select(
        "obs_id",
        F.when(keep, F.col("o_label")).otherwise(F.col("final_label")).alias("final_label"),
        F.when(keep, F.col("o_basis")).otherwise(F.col("basis")).alias("basis"),
        F.when(keep, F.col("o_by")).otherwise(F.lit("auto")).alias("adjudicator"),
    )


def resolve(current: DataFrame, decisions: DataFrame) -> DataFrame:
    """Manual decisions over the table; a decision needs a valid label and a note, others are ignored."""
    valid = decisions.where(F.col("final_label").isin(*lb.LABELS) & F.col("note").isNotNull() & (F.trim("note") != ""))
    new = valid.select("obs_id", "final_label", F.lit("adjudicated").alias("basis"), "adjudicator").dropDuplicates(["obs_id"])
    return current.join(new, "obs_id", "left_anti").unionByName(new)


def pending(frame: DataFrame, votes: DataFrame, annotator: str, round_: int) -> DataFrame:
    """Observations an annotator still has to judge: unseen ones in round 1, seen ones later."""
    own = votes.where(F.col("annotator") == annotator)
    todo = frame.select("obs_id").distinct()
    if round_ > 1:
        todo = todo.join(own.where("round = 1").select("obs_id"), "obs_id", "left_semi")
    return todo.join(own.where(F.col("round") == round_).select("obs_id"), "obs_id", "left_anti")


def card_order(round_: int) -> list[Column]:
    """Round 1 by observation; later rounds in a hashed order that differs from it."""
    hashed = F.substring((F.col("obs_id") * F.lit(2654435761)).cast("string"), -4, 4)
    return [F.col("obs_id")] if round_ == 1 else [hashed, F.col("obs_id")]


def validated(new: DataFrame) -> DataFrame:
    """New judgements with the reason they are refused, null where they are fine."""
    reason = (
        F.when(F.col("obs_id").isNull(), "no observation")
        .when(lb.same_annotator(F.col("annotator")).isNull(), "no annotator")
        .when(lb.same_label(F.col("label")).isNull(), "no label")
        .when(~lb.same_label(F.col("label")).isin(*lb.LABELS), "unknown label")
        .when(F.col("script").isNotNull() & ~F.lower(F.trim("script")).isin(*lb.SCRIPTS), "unknown script")
    )
    return new.withColumn("refused", reason)


#: Which label of its fonts a document takes: the first that occurs.
DOCUMENT_PRIORITY = ("LEGACY_8BIT", "LEGACY_ASCII", "LEGACY_SYMBOL", "CMAP_INVALID", "PARTIAL", "CORRECT", "NO_LINGUISTIC_TEXT", "UNDECIDABLE")


def document_truth(font_labels: DataFrame) -> DataFrame:
    """``sha256, label`` from rows of ``sha256, final_label``."""
    rank = F.create_map(*(x for i, v in enumerate(DOCUMENT_PRIORITY) for x in (F.lit(v), F.lit(i))))[F.col("final_label")]
    return font_labels.where(F.col("final_label").isNotNull()).groupBy("sha256").agg(F.min_by("final_label", F.coalesce(rank, F.lit(99))).alias("label"))
