"""A sample that matches target shares per category.

Per draw: count the categories, give each an integer quota by the largest-remainder
rule with a minimum floor and a cap at what is available, take the members with the
smallest random keys, and report the categories that fall short of their target.

The members with the smallest keys are found without sorting a whole category in
one task: a histogram of the uniform 32-hex-digit keys over their first three
digits (4,096 buckets a category) tells the bucket in which the quota is reached;
whole buckets below it are taken, and only that bucket is ranked.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarazu.session import cut

BUCKET_DIGITS = 3
QUOTA_SCHEMA = (
    "draw string, stratum string, n_draw long, available long, target long, floor long, quota long, shortfall long, missed long"
)


def largest_remainder(total: int, shares: list[int], floors: list[int], caps: list[int]) -> list[int]:
    """Integer quotas that sum to ``total`` where floors and caps allow it.

    Floors come first (never above the cap), then the shares of ``total`` by largest
    remainder over the categories that are neither at their floor nor at their cap;
    what a capped category cannot take goes to the others in proportion. Ties go to
    the earlier category. With zero shares everywhere only floors are given.
    """
    n = len(shares)
    fixed: dict[int, int] = {i: 0 for i in range(n) if caps[i] <= 0}
    while True:
        free = [i for i in range(n) if i not in fixed]
        weight = sum(shares[i] for i in free)
        left = max(0, total - sum(fixed.values()))
        if not free or weight <= 0:
            break
        over = [i for i in free if left * shares[i] >= caps[i] * weight]
        under = [i for i in free if left * shares[i] < min(floors[i], caps[i]) * weight]
        # Of the two violations fix the one that weighs more, as the other may then vanish.
        excess = sum(left * shares[i] - caps[i] * weight for i in over)
        lack = sum(min(floors[i], caps[i]) * weight - left * shares[i] for i in under)
        if not over and not under:
            break
        if under and (not over or lack >= excess):
            fixed |= {i: min(floors[i], caps[i]) for i in under}
        else:
            fixed |= {i: caps[i] for i in over}
    quotas = [fixed.get(i, 0) for i in range(n)]
    if free and weight > 0:
        for i in free:
            quotas[i] = left * shares[i] // weight
        rest = left - sum(quotas[i] for i in free)
        for i in sorted(free, key=lambda i: (-(left * shares[i] % weight), i))[:rest]:
            quotas[i] += 1
    elif free:
        for i in free:
            quotas[i] = min(floors[i], caps[i])
    return quotas


def _allocate(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in pdfs:
        for draw, g in pdf.groupby("draw", sort=True):
            g = g.sort_values("stratum")
            n_draw = int(g["n_draw"].iloc[0])
            size = n_draw * int(g["size_permille"].max()) // 1000
            shares = [int(x) for x in g["share_permille"]]
            floors = [int(x) for x in g["min_count"]]
            caps = [int(x) for x in g["available"]]
            quotas = largest_remainder(size, shares, floors, caps)
            wanted = [max(f, n_draw * int(p) * s // 1_000_000) for f, p, s in zip(floors, g["size_permille"], shares)]
            yield pd.DataFrame(
                {
                    "draw": draw,
                    "stratum": g["stratum"].to_numpy(),
                    "n_draw": n_draw,
                    "available": caps,
                    "target": wanted,
                    "floor": floors,
                    "quota": quotas,
                    "shortfall": [max(0, w - a) for w, a in zip(wanted, caps)],
                    "missed": [max(0, w - q) for w, q in zip(wanted, quotas)],
                }
            )


def quotas(members: DataFrame, targets: DataFrame) -> DataFrame:
    """Quota, shortfall and missed target per target row.

    ``shortfall`` is what a stratum lacks in members, ``missed`` what its quota lacks of
    its target for whatever reason: too few members, or floors of other strata that take
    the room.

    ``members``: draw, stratum (normalized, not null), one row per member. ``targets``:
    draw, stratum, size_permille, share_permille, min_count; a target's stratum need
    not occur, repeated targets count once, null numbers count as 0. A draw without
    members gets quotas of 0. Members of strata without a target are counted in the
    size of the draw but get no quota.
    """
    # A row per stratum, written once and read twice.
    counts = cut(members.groupBy("draw", "stratum").agg(F.count(F.lit(1)).alias("available")))
    sizes = counts.groupBy("draw").agg(F.sum("available").alias("n_draw"))
    wanted = targets.groupBy("draw", "stratum").agg(
        *(F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in ("size_permille", "share_permille", "min_count"))
    )
    zero = F.lit(0).cast("long")
    rows = (
        wanted.join(counts, ["draw", "stratum"], "left")
        .join(sizes, "draw", "left")
        .withColumns({"available": F.coalesce("available", zero), "n_draw": F.coalesce("n_draw", zero)})
    )
    # One row per target: the table of targets is what is grouped here, never the members.
    return rows.groupBy("draw").applyInPandas(lambda pdf: next(_allocate(iter([pdf]))), QUOTA_SCHEMA)


def quota_sample(members: DataFrame, quota: DataFrame, ident: str, seed: int) -> DataFrame:
    """The chosen members: draw, stratum, ``ident`` and their new ``selection_prob``.

    The random key of a member is md5(seed, draw, member), so the choice does not
    depend on row order or partitions; ties of keys are broken by the member.
    Members must be distinct within a draw.
    """
    keyed = members.select(
        "draw", "stratum", ident,
        F.md5(F.concat_ws(":", F.lit(str(seed)), "draw", F.col(ident).cast("string"))).alias("key"),
    ).withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))
    hist = keyed.groupBy("draw", "stratum", "bucket").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("draw", "stratum").orderBy("bucket")
    cum = hist.withColumn("before", F.sum("n").over(upto) - F.col("n"))
    edge = (
        cum.join(quota.where("quota > 0").select("draw", "stratum", "quota", "available"), ["draw", "stratum"])
        .where("before < quota")
        .groupBy("draw", "stratum", "quota", "available")
        .agg(F.max("bucket").alias("edge"), F.max_by(F.col("quota") - F.col("before"), "bucket").alias("from_edge"))
    )
    near = keyed.join(edge, ["draw", "stratum"]).where(F.col("bucket") <= F.col("edge"))
    ranked = near.where(F.col("bucket") == F.col("edge")).withColumn(
        "rank", F.row_number().over(Window.partitionBy("draw", "stratum").orderBy("key", ident))
    )
    out = [ident, "draw", "stratum", "quota", "available"]
    chosen = near.where(F.col("bucket") < F.col("edge")).select(*out).unionByName(ranked.where(F.col("rank") <= F.col("from_edge")).select(*out))
    return chosen.select("draw", "stratum", ident, (F.col("quota") / F.col("available")).alias("selection_prob"))
