"""Evaluation statistics: agreement, detector scores, sweeps and weighted estimates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarazu.functions.fonts import POSITIVE
from tarazu.session import cut

KAPPA_FLOOR = 0.7
SIGNAL_TARGET = {
    "mojibake_ratio": "LEGACY_8BIT",
    "ascii_k_ratio": "LEGACY_ASCII",
    "symbol_per_1k": "LEGACY_SYMBOL",
    "invalid_rate_per_1k": "CMAP_INVALID",
    "invalid_matras": "CMAP_INVALID",
}


def _kappa(observed: Column, expected: Column) -> Column:
    return F.when(expected < 1.0 - 1e-12, F.round((observed - expected) / (1.0 - expected), 6))


def kappa(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per group: n, agreement and Cohen's kappa of the columns a and b.

    Kappa is null where chance agreement is 1 (a single label throughout). The pairs are
    counted once per label combination; all else works on these counts.
    """
    if not by:
        return kappa(pairs.withColumn("__all", F.lit(1)), ["__all"]).drop("__all")
    by = list(by)
    # One small row per label combination, used several times below: counted once.
    cells = cut(pairs.groupBy(*by, "a", "b").agg(F.count(F.lit(1)).alias("n")))
    sides = cells.select(*by, F.explode(F.array(F.struct(F.col("a").alias("label"), F.col("n").alias("na"), F.lit(0).cast("long").alias("nb")), F.struct(F.col("b").alias("label"), F.lit(0).cast("long").alias("na"), F.col("n").alias("nb")))).alias("s"))
    marginal = sides.groupBy(*by, "s.label").agg(F.sum("s.na").alias("na"), F.sum("s.nb").alias("nb"))
    chance = marginal.groupBy(*by).agg(F.sum(F.col("na") * F.col("nb")).alias("chance"))
    total = cells.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    both = total.join(chance, by)
    n = F.col("n").cast("double")
    observed, expected = F.col("same") / n, F.col("chance") / (n * n)
    return both.select(*by, "n", F.round(observed, 6).alias("agreement"), _kappa(observed, expected).alias("kappa"))


def kappa_per_class(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per group: one-vs-rest kappa of each class; ``n`` counts the pairs where either side has it."""
    if not by:
        return kappa_per_class(pairs.withColumn("__all", F.lit(1)), ["__all"]).drop("__all")
    by = list(by)
    cells = cut(pairs.groupBy(*by, "a", "b").agg(F.count(F.lit(1)).alias("n")))
    total = cells.groupBy(*by).agg(F.sum("n").alias("total"))
    a = cells.groupBy(*by, F.col("a").alias("label")).agg(F.sum("n").alias("na"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("both"))
    b = cells.groupBy(*by, F.col("b").alias("label")).agg(F.sum("n").alias("nb"))
    z = F.lit(0).cast("long")
    got = a.join(b, [*by, "label"], "full_outer").select(*by, "label", *(F.coalesce(c, z).alias(c) for c in ("na", "nb", "both"))).join(total, by)
    n = F.col("total").cast("double")
    observed = (n - F.col("na") - F.col("nb") + 2 * F.col("both")) / n
    expected = (F.col("na") / n) * (F.col("nb") / n) + ((n - F.col("na")) / n) * ((n - F.col("nb")) / n)
    got = got.select(*by, "label", (F.col("na") + F.col("nb") - F.col("both")).alias("n"), _kappa(observed, expected).alias("kappa"))
    return got.withColumn("below_floor", F.coalesce(F.col("kappa") < KAPPA_FLOOR, F.lit(False)))


def prf(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """Precision, recall, F1; 0 on a zero denominator."""
    p = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(0.0))
    r = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(F.lit(0.0))
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))
    return {"precision": F.round(p, 6), "recall": F.round(r, 6), "f1": F.round(f1, 6)}


def binary_score(rows: DataFrame, said: Column, truth: Column) -> DataFrame:
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    s, t = F.coalesce(said, F.lit(False)), F.coalesce(truth, F.lit(False))
    got = rows.agg(count(s & t).alias("tp"), count(s & ~t).alias("fp"), count(~s & t).alias("fn"), count(~s & ~t).alias("tn"))
    return got.withColumns(prf(F.col("tp"), F.col("fp"), F.col("fn")))


def per_class_score(rows: DataFrame) -> DataFrame:
    """Scores of ``detector_label`` for each label that occurs in ``final_label``."""
    cells = cut(rows.groupBy("detector_label", "final_label").agg(F.count(F.lit(1)).alias("k")))
    hit = F.coalesce(F.col("detector_label") == F.col("final_label"), F.lit(False))
    truth = cells.groupBy(F.col("final_label").alias("label")).agg(F.sum("k").alias("n"), F.sum(F.when(hit, F.col("k")).otherwise(0)).alias("tp"))
    said = cells.groupBy(F.col("detector_label").alias("label")).agg(F.sum("k").alias("said"))
    got = truth.join(said, "label", "left").withColumn("said", F.coalesce("said", F.lit(0)))
    tp = F.col("tp")
    return got.select("label", "n", *(v.alias(k) for k, v in prf(tp, F.col("said") - tp, F.col("n") - tp).items()))


def confusion(rows: DataFrame, top: int = 10) -> DataFrame:
    """The most common disagreements; no evidence on a correct font is none."""
    apart = rows.where((F.col("detector_label") != F.col("final_label")) & ~((F.col("detector_label") == "NO_EVIDENCE") & (F.col("final_label") == "CORRECT")))
    return apart.groupBy("detector_label", "final_label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "detector_label", "final_label").limit(top)


def sweep(rows: DataFrame, signal: str, steps: int = 20) -> DataFrame:
    """Precision and recall of ``signal >= threshold`` at ``steps + 1`` thresholds between its extremes.

    Scored against the class the signal is meant for. Every row is put into one of the
    steps first; the scores are running sums over at most ``steps + 2`` counts.
    """
    target = SIGNAL_TARGET.get(signal)
    hit = F.col("final_label") == target if target else F.col("final_label").isin(*POSITIVE)
    kept = rows.where(F.col(signal).isNotNull()).select(F.col(signal).cast("double").alias("v"), hit.alias("hit"))
    # Read once: what follows needs the counts per value several times.
    r = cut(kept.groupBy("v").agg(F.count_if("hit").alias("pos"), F.count_if(~F.col("hit")).alias("neg")))
    lo, hi = r.agg(F.min("v")).scalar(), r.agg(F.max("v")).scalar()
    at = lambda i: lo + (hi - lo) * i / steps
    guess = F.floor((F.col("v") - lo) / (hi - lo) * steps).cast("int")
    # The last step whose threshold the value reaches; the guess may be one off by rounding.
    step = F.when(F.col("v") < at(guess), guess - 1).when((guess < steps) & (F.col("v") >= at(guess + 1)), guess + 1).otherwise(guess)
    counts = r.where(hi > lo).groupBy(step.alias("step")).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    levels = r.agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 0) & (hi > lo)).select(F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("step"))
    above = Window.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)  # over steps + 1 rows
    got = levels.join(counts, "step", "left").select(
        "step", at(F.col("step")).alias("t"), F.coalesce(F.sum("pos").over(above), F.lit(0)).alias("tp"), F.coalesce(F.sum("neg").over(above), F.lit(0)).alias("fp")
    )
    got = got.withColumn("fn", r.agg(F.sum("pos")).scalar() - F.col("tp"))
    return got.select(F.col("step").cast("int").alias("step"), F.round("t", 9).alias("threshold"), "tp", "fp", "fn", *(v.alias(k) for k, v in prf(F.col("tp"), F.col("fp"), F.col("fn")).items()))


def stratified_estimate(strata: DataFrame) -> DataFrame:
    """The population rate and its standard error from rows of stratum_size, drawn, positive.

    Each stratum weighs by its size; the finite-population correction applies. No strata
    give one row of zeros.
    """
    strata = cut(strata)  # one row per stratum
    total = strata.agg(F.sum("stratum_size")).scalar()
    share, p = F.col("stratum_size") / total, F.col("positive") / F.col("drawn")
    fpc = F.when(F.col("stratum_size") > 0, 1 - F.col("drawn") / F.col("stratum_size")).otherwise(F.lit(0.0))
    drawn = F.col("drawn") > 0
    rate = F.sum(F.when(drawn, share * p).otherwise(0.0))
    var = F.sum(F.when(F.col("drawn") > 1, share * share * (p * (1 - p) / F.col("drawn")) * fpc).otherwise(0.0))
    got = strata.agg(F.count(F.lit(1)).alias("n_strata"), F.coalesce(rate, F.lit(0.0)).alias("rate"), F.sqrt(F.coalesce(var, F.lit(0.0))).alias("se"))
    return got.select("n_strata", F.round("rate", 6).alias("rate"), F.round("se", 6).alias("se"), F.round(1.96 * F.col("se"), 6).alias("half_width_95"))
