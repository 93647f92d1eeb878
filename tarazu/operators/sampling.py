"""Seeded draws that do not depend on row order: capped, stratified, tiered, with their frames.

The random order of a member is ``md5(seed:group:member)``. Ranks inside a group come
from ``stitched_rank``, so a stratum or source that holds most rows is no single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarazu.operators.skew import stitched_rank


def draw_key(seed: int | str, group: Column, member: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), group.cast("string"), member.cast("string")))


def ranked(df: DataFrame, group: str, member: str, seed: int | str) -> DataFrame:
    """All rows with ``draw_rank``, their place in the seeded order of their group."""
    keyed = df.withColumn("draw_key", draw_key(seed, F.col(group), F.col(member)))
    return stitched_rank(keyed, group, ["draw_key", member], "draw_rank").drop("draw_key")


def capped_sample(df: DataFrame, group: str, member: str, cap: int, seed: int | str) -> DataFrame:
    """At most ``cap`` members of each group; smaller groups are taken whole. Members must be distinct."""
    return ranked(df, group, member, seed).where(F.col("draw_rank") <= cap).drop("draw_rank")


def stratified_draw(df: DataFrame, stratum: str, member: str, quotas: dict[str, int], seed: int | str, default: int = 0) -> DataFrame:
    """``member, stratum, stratum_size, drawn, selection_prob`` of the drawn members.

    A stratum smaller than its quota is taken whole at probability 1. Null strata are
    not drawn from. Members must be distinct.
    """
    rows = df.where(F.col(stratum).isNotNull()).select(F.col(member), F.col(stratum))
    want = F.coalesce(F.create_map(*(x for k, v in quotas.items() for x in (F.lit(k), F.lit(v))))[F.col(stratum)], F.lit(default)) if quotas else F.lit(default)
    sizes = rows.groupBy(stratum).agg(F.count(F.lit(1)).alias("stratum_size"))
    got = ranked(rows, stratum, member, seed).where(F.col("draw_rank") <= want).drop("draw_rank")
    drawn = F.least(want.cast("long"), F.col("stratum_size"))
    return got.join(sizes, stratum).select(member, stratum, "stratum_size", drawn.alias("drawn"), (drawn / F.col("stratum_size")).alias("selection_prob"))


def frame(selected: DataFrame, pool: DataFrame, group: str) -> DataFrame:
    """Per group: members in the pool, members drawn, and the selection probability."""
    size = pool.groupBy(group).agg(F.count(F.lit(1)).alias("stratum_size"))
    drawn = selected.groupBy(group).agg(F.count(F.lit(1)).alias("drawn"))
    got = size.join(drawn, size[group].eqNullSafe(drawn[group]), "left").select(size[group], "stratum_size", F.coalesce("drawn", F.lit(0)).cast("long").alias("drawn"))
    return got.withColumn("selection_prob", F.col("drawn") / F.col("stratum_size"))
