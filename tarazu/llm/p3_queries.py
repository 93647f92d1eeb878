"""Problem 3: smaller samples of the draws with wanted shares per stratum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarazu.llm.quota_sample import quota_sample, quotas
from tarazu.session import cut, table

SEED = 20250601
OBS, FILES = "annotation_sample", "extraction_sample"


def _norm(stratum: Column) -> Column:
    return F.lower(F.trim(stratum))


def _draws(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(members, targets) of both tables; a draw is "table:draw_id", members are distinct in a draw."""
    draw = lambda name, c: F.concat(F.lit(name + ":"), F.col(c)).alias("draw")
    targets = table(spark, d, "sample_target").select(
        F.concat_ws(":", "source_table", "draw_id").alias("draw"), F.col("stratum").alias("written"), _norm(F.col("stratum")).alias("stratum"),
        "size_permille", "share_permille", "min_count",
    )
    wanted = targets.select("draw").distinct()
    obs = table(spark, d, OBS).select(draw(OBS, "sample_id"), F.col("obs_id").cast("string").alias("member"), "stratum", "created_at")
    files = table(spark, d, FILES).select(draw(FILES, "run_id"), F.col("sha256").alias("member"), "stratum", F.lit(None).cast("timestamp").alias("created_at"))
    # Draws without a target are dropped in the scan's stage, before any shuffle.
    rows = obs.unionByName(files).where(F.col("member").isNotNull()).join(wanted, "draw", "left_semi")
    latest = F.max(F.struct(F.col("created_at"), F.col("stratum")))["stratum"]
    members = rows.groupBy("draw", "member").agg(_norm(latest).alias("stratum")).where(F.col("stratum").isNotNull())
    return members, targets


def _named(df: DataFrame) -> DataFrame:
    at = F.instr("draw", ":")
    return df.withColumns({"source_table": F.substring_index("draw", ":", 1), "draw_id": F.col("draw").substr(at + 1, F.length("draw"))})


def _report(spark: SparkSession, d: str) -> DataFrame:
    members, targets = _draws(spark, d)
    spelled = targets.select("draw", "stratum", F.col("written")).distinct()
    return _named(quotas(members, targets.drop("written")).join(spelled, ["draw", "stratum"])).withColumn("stratum", F.col("written"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _report(spark, d).where("shortfall > 0").select("source_table", "draw_id", "stratum")


def p3_quotas(spark: SparkSession, d: str) -> DataFrame:
    """What every target row asks for, what is there, what it gets and what it misses."""
    return _report(spark, d).select("source_table", "draw_id", "stratum", "n_draw", "available", "target", "quota", "shortfall", "missed")


def p3_targets(spark: SparkSession, d: str) -> DataFrame:
    """The part of the report that does not depend on how quotas are allocated."""
    return p3_quotas(spark, d).drop("quota", "missed")


def p3_sample(spark: SparkSession, d: str) -> DataFrame:
    """The chosen rows with their new selection probability."""
    members, targets = _draws(spark, d)
    got = _named(quota_sample(members, quotas(members, targets.drop("written")), "member", SEED))
    return got.select("source_table", "draw_id", "stratum", "member", F.round("selection_prob", 9).alias("selection_prob"))


def p3_violations(spark: SparkSession, d: str) -> DataFrame:
    """Strata whose quota or sample breaks a rule; none is to be found.

    A quota lies between the floor, or what is available, and what is available; the
    quotas of a draw add up to its size if floors and available members allow it; as many
    members are chosen as the quota says, each once and from its stratum.
    """
    members, targets = _draws(spark, d)
    quota = cut(quotas(members, targets.drop("written")))
    chosen = quota_sample(members, quota, "member", SEED)
    n = chosen.groupBy("draw", "stratum").agg(F.count(F.lit(1)).alias("chosen"), F.count_distinct("member").alias("different"))
    at_home = chosen.join(members, ["draw", "stratum", "member"], "left_semi").groupBy("draw", "stratum").agg(F.count(F.lit(1)).alias("at_home"))
    size = targets.groupBy("draw").agg(F.max("size_permille").alias("permille"))
    low = F.least("floor", "available")
    able = F.when(F.col("share_permille") > 0, F.col("available")).otherwise(low)
    shares = targets.groupBy("draw", "stratum").agg(F.max("share_permille").alias("share_permille"))
    rows = quota.join(shares, ["draw", "stratum"]).join(size, "draw").join(n, ["draw", "stratum"], "left").join(at_home, ["draw", "stratum"], "left").na.fill(0)
    sums = rows.groupBy("draw").agg(F.sum("quota").alias("given"), F.sum(low).alias("low"), F.sum(able).alias("able"), F.max(F.floor(F.col("n_draw") * F.col("permille") / 1000)).alias("size"))
    wrong_sum = (F.col("size").between(F.col("low"), F.col("able"))) & (F.col("given") != F.col("size"))
    wrong = (F.col("quota") > F.col("available")) | (F.col("quota") < low) | (F.col("chosen") != F.col("quota")) | (F.col("different") != F.col("quota")) | (F.col("at_home") != F.col("quota"))
    return rows.join(sums, "draw").where(wrong | wrong_sum).select("draw", "stratum", "quota", "available", "chosen")


_COUNTS = """
WITH t AS (SELECT *, lower(trim(stratum)) AS st FROM sample_target),
o AS (SELECT sample_id AS draw_id, stratum, row_number() OVER (PARTITION BY sample_id, obs_id ORDER BY created_at DESC) AS rn FROM annotation_sample WHERE obs_id IS NOT NULL),
m AS (SELECT 'annotation_sample' AS source_table, draw_id, lower(trim(stratum)) AS st FROM o WHERE rn = 1 AND stratum IS NOT NULL
 UNION ALL SELECT 'extraction_sample', run_id, lower(trim(stratum)) FROM (SELECT run_id, sha256, max(stratum) AS stratum FROM extraction_sample WHERE sha256 IS NOT NULL GROUP BY 1, 2) WHERE stratum IS NOT NULL),
n AS (SELECT source_table, draw_id, count(*) AS n FROM m GROUP BY 1, 2),
c AS (SELECT source_table, draw_id, st, count(*) AS c FROM m GROUP BY 1, 2, 3),
r AS (SELECT t.source_table, t.draw_id, t.stratum, coalesce(n.n, 0) AS n_draw, coalesce(c.c, 0) AS available,
 greatest(t.min_count, coalesce(n.n, 0) * t.size_permille * t.share_permille // 1000000) AS target
 FROM t LEFT JOIN n USING (source_table, draw_id) LEFT JOIN c USING (source_table, draw_id, st))
"""
SQL = {
    "p3_found": _COUNTS + "SELECT source_table, draw_id, stratum FROM r WHERE available < target",
    "p3_targets": _COUNTS + "SELECT *, greatest(0, target - available) AS shortfall FROM r",
    "p3_violations": "SELECT '' AS draw, '' AS stratum, 0::BIGINT AS quota, 0::BIGINT AS available, 0::BIGINT AS chosen WHERE false",
}
QUERIES = {"p3_found": p3_found, "p3_quotas": p3_quotas, "p3_targets": p3_targets, "p3_sample": p3_sample, "p3_violations": p3_violations}
