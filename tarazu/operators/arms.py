"""Comparison of extraction arms page by page: loss, script, structure, agreement.

The input is long: one row per (doc_id, page, arm) with the page measures, the arm being
a value. ``body`` is the group of the macro averages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarazu.functions import signals as s

REFERENCE = "ocr"
OCR_DEVA_PRESENT, ARM_DEVA_ABSENT, INVALID_MAX = 0.30, 0.10, 2.0
# The thresholds of the gate sweeps.
RATIO_GRID = (0.0, 0.001, 0.005, 0.01, 0.02, 0.05, 0.10, 0.20, 0.30, 0.50)
CHARS_GRID = (0, 10, 25, 50, 100, 200, 400, 800)


_YES = lambda c: F.coalesce(c, F.lit(False))


def _by_body(rows: DataFrame, hit: Column, among: Column, **sums: Column) -> DataFrame:
    """Sums per arm and body: ``n`` rows, ``den`` scored ones, ``num`` hits among them, and whatever else is asked for.

    A report rolls these up by arm, so that pages are measured in one pass for the pooled
    figures and for the macro averages.
    """
    return rows.groupBy("arm", "body").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(_YES(among)).alias("den"), F.count_if(_YES(among) & _YES(hit)).alias("num"), *(c.alias(k) for k, c in sums.items())
    )


def _macro() -> Column:
    """The mean over bodies of the rate of hits; bodies without a scored page do not count."""
    return F.round(F.avg(F.when(F.col("den") > 0, F.col("num") / F.col("den"))), 6)


def loss_report(pages: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """Per arm: pages, characters a page, shares of empty pages, lost and control characters, failures, errors.

    ``errors`` has a row with its ``arm`` for each document the arm could not read; such
    documents have no pages and are counted beside them.
    """
    per = _by_body(
        pages, F.col("loss").isNotNull(), F.lit(True), chars=F.sum(F.coalesce("n_chars", F.lit(0))), empty=F.count_if(_YES(F.col("loss") == "empty")),
        replaced=F.sum("replacement_chars"), control=F.sum("control_chars"),
    )
    n, chars = F.sum("n"), F.greatest(F.sum("chars"), F.lit(1))
    got = per.groupBy("arm").agg(
        n.alias("pages"),
        F.round(F.sum("chars") / n, 6).alias("chars_per_page"),
        F.round(F.sum("empty") / n, 6).alias("empty_share"),
        F.round(F.sum("replaced") / chars, 9).alias("replacement_share"),
        F.round(F.sum("control") / chars, 9).alias("control_share"),
        F.round(F.sum("num") / n, 6).alias("fail_share"),
        _macro().alias("fail_macro"),
    )
    zero = F.lit(0).cast("long")
    if errors is None:
        return got.withColumn("errors", zero)
    return got.join(errors.groupBy("arm").agg(F.count(F.lit(1)).alias("errors")), "arm", "left").withColumn("errors", F.coalesce("errors", zero))


def gate_sweep(pages: DataFrame, column: str) -> DataFrame:
    """Share of an arm's pages that a gate would fail at each threshold; ``n_chars`` fails below, ratios above."""
    grid = CHARS_GRID if column == "n_chars" else RATIO_GRID
    fails = lambda t: (F.coalesce(column, F.lit(0)) < t) if column == "n_chars" else (F.coalesce(column, F.lit(0.0)) >= t)
    shares = pages.groupBy("arm").agg(*(F.round(F.count_if(fails(t)) / F.count(F.lit(1)), 6).alias(f"t{i}") for i, t in enumerate(grid)))
    rows = F.array(*(F.struct(F.lit(float(t)).alias("threshold"), F.col(f"t{i}").alias("fail_share")) for i, t in enumerate(grid)))
    return shares.select("arm", F.explode(rows).alias("x")).select("arm", "x.*")


def concordance(pages: DataFrame) -> DataFrame:
    """Each page of an arm against the reference arm's page: the class of its script.

    A page's arms meet in one partition, so pages are measured once and not joined with
    one another. A page has one row for each arm, which bounds the window.
    """
    page = Window.partitionBy("doc_id", "page")
    is_ref = F.col("arm") == REFERENCE
    of_ref = lambda c: F.max(F.when(is_ref, c)).over(page)
    seen = pages.withColumns({"dev_share_ref": of_ref(F.col("dev_share")), "loss_ref": of_ref(F.col("loss")), "has_ref": of_ref(F.lit(True))})
    got = seen.where(~is_ref)
    arm, od = F.coalesce("dev_share", F.lit(0.0)), F.coalesce("dev_share_ref", F.lit(0.0))
    kind = (
        F.when(F.col("loss").isNotNull(), "loss")
        .when(F.col("has_ref").isNull() | F.col("loss_ref").isNotNull(), "no_reference")
        .when((od >= OCR_DEVA_PRESENT) & (arm < ARM_DEVA_ABSENT), "script_mismatch")
        .when((od < ARM_DEVA_ABSENT) & (arm >= OCR_DEVA_PRESENT), "script_excess")
        .otherwise("match")
    )
    return got.withColumn("concordance", kind).drop("has_ref", "loss_ref")


SCORED = ("match", "script_mismatch", "script_excess")


def concordance_report(pairs: DataFrame) -> DataFrame:
    c = lambda *v: F.count_if(_YES(F.col("concordance").isin(*v)))
    kind = F.col("concordance")
    per = _by_body(pairs, kind == "script_mismatch", kind.isin(*SCORED), matched=c("match"), excess=c("script_excess"), unreferenced=c("no_reference"), lost=c("loss"))
    scored = F.greatest(F.sum("den"), F.lit(1))
    return per.groupBy("arm").agg(
        F.sum("den").alias("scored"),
        F.round(F.sum("matched") / scored, 6).alias("match_share"),
        F.round(F.sum("num") / scored, 6).alias("mismatch_share"),
        F.round(F.sum("excess") / scored, 6).alias("excess_share"),
        F.sum("unreferenced").alias("no_reference"),
        F.sum("lost").alias("loss"),
        _macro().alias("mismatch_macro"),
    )


def structural_report(pages: DataFrame) -> DataFrame:
    """Pages that pass the loss gate and hold enough Devanagari: how many are structurally invalid."""
    scored = _YES(F.col("loss").isNull() & (F.col("dev_chars") >= s.MIN_DEV_CHARS))
    bad = F.col("invalid_rate_per_1k") >= INVALID_MAX
    spurious = F.count_if(scored & _YES(F.col("invalid_matras") > F.col("invalid_matras_nospace")))
    # Conditions stand in the sums, not in a filter below which the measures would be taken twice.
    per = _by_body(pages, bad, scored, rate=F.sum(F.when(scored, F.col("invalid_rate_per_1k"))), spurious=spurious)
    n = F.sum("den")
    got = per.groupBy("arm").agg(
        n.alias("scored"), F.round(F.sum("num") / n, 6).alias("invalid_share"), F.round(F.sum("rate") / n, 6).alias("mean_rate"),
        F.round(F.sum("spurious") / n, 6).alias("spurious_space_share"), _macro().alias("invalid_macro"),
    )
    return got.where("scored > 0")


def pairwise_agreement(pages: DataFrame) -> DataFrame:
    """Each pair of arms on the pages both survive: identical, same characters, or different.

    The arms of a page are gathered in one row (there are a handful of arms), so no pages
    are joined with one another.
    """
    # No filter by loss, below which the measures would be taken twice.
    arm = F.when(F.col("loss").isNull(), F.struct("arm", "text_hash", "bag_hash"))
    per = pages.where(F.col("arm") != REFERENCE).groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(arm)).alias("a"))
    pairs = F.flatten(F.transform("a", lambda x, i: F.transform(F.slice(F.col("a"), i + 2, F.size("a")), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    got = per.select(F.explode(pairs).alias("p")).select(
        F.col("p.x.arm").alias("arm_a"), F.col("p.y.arm").alias("arm_b"),
        (F.col("p.x.text_hash") == F.col("p.y.text_hash")).alias("same"), (F.col("p.x.bag_hash") == F.col("p.y.bag_hash")).alias("bag"),
    )
    n = F.count(F.lit(1))
    return got.groupBy("arm_a", "arm_b").agg(
        n.alias("pages"), F.count_if("same").alias("identical"), F.count_if(~F.col("same") & F.col("bag")).alias("same_characters"),
        F.count_if(~F.col("same") & ~F.col("bag")).alias("differ"),
    )


def all_arms_identical(pages: DataFrame) -> DataFrame:
    kept = F.when(F.col("loss").isNull(), F.col("text_hash"))
    per = pages.where(F.col("arm") != REFERENCE).groupBy("doc_id", "page").agg(F.count(kept).alias("k"), F.size(F.collect_set(kept)).alias("h")).where("k >= 2")
    return per.agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("h") == 1).alias("identical"))


def usable_pages(pairs: DataFrame) -> DataFrame:
    """Per arm: pages that pass loss, script and structure, and what the others fail first.

    A page without a reference does not fail the script test.
    """
    structural = (F.coalesce("dev_chars", F.lit(0)) >= s.MIN_DEV_CHARS) & (F.coalesce("invalid_rate_per_1k", F.lit(0.0)) >= INVALID_MAX)
    why = F.when(F.col("loss").isNotNull(), "loss").when(F.col("concordance").isin("script_mismatch", "script_excess"), "script").when(structural, "structural").otherwise("usable")
    rows = pairs.withColumn("why", why)
    per = _by_body(rows, F.col("why") == "usable", F.lit(True), **{f"by_{w}": F.count_if(F.col("why") == w) for w in ("loss", "script", "structural")})
    n = F.sum("n")
    return per.groupBy("arm").agg(
        n.alias("pages"), F.round(F.sum("num") / n, 6).alias("usable_share"), *(F.sum(f"by_{w}").alias(f"by_{w}") for w in ("loss", "script", "structural")), _macro().alias("usable_macro")
    )


def font_agreement(fonts: DataFrame, labels: DataFrame) -> DataFrame:
    """Two arms at font grain by the font's label; ``fonts``: key, arm, text_hash, bag_hash; ``labels``: key, label."""
    per = fonts.groupBy("key").agg(F.count_distinct("arm").alias("k"), F.count_distinct("text_hash").alias("h"), F.count_distinct("bag_hash").alias("b"))
    got = per.join(labels, "key", "left").groupBy(F.coalesce("label", F.lit("(unlabelled)")).alias("label"))
    two = F.col("k") >= 2
    return got.agg(
        F.count(F.lit(1)).alias("fonts"), F.count_if(two & (F.col("h") == 1)).alias("identical"), F.count_if(two & (F.col("h") > 1) & (F.col("b") == 1)).alias("same_characters"),
        F.count_if(two & (F.col("h") > 1) & (F.col("b") > 1)).alias("differ"), F.count_if(~two).alias("one_arm"),
    )
