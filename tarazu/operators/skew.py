"""Per-key results when a few keys hold most rows.

Rows are range-partitioned on (key, secondary order) with Spark's sampled
quantiles, so a heavy key is cut into as many ranges as its share of the rows asks
for and every task gets about the same number of rows. Each partition yields one
partial state per key it holds; the states of a key that crosses partition
boundaries are stitched in partition order. There are at most
``keys + partitions`` states, so stitching is small whatever the skew.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarazu.session import cut

_PID, _MID = "__range_id", "__row_id"


def range_partition(df: DataFrame, key: str, order: Sequence[str], partitions: int | None = None) -> DataFrame:
    """Range-partition on (key, order...), heavy keys split across partitions."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, F.col(key), *(F.col(c) for c in order))


def stitched_aggregate(
    df: DataFrame,
    key: str,
    order: Sequence[str],
    counts: dict[str, Column] | None = None,
    sums: dict[str, Column] | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """One row per key: ``n`` rows, ``counts`` (rows where the condition holds), ``sums``.

    ``n_ranges`` tells across how many partitions the key was split. A null key is
    a group of its own; a null condition does not count; an empty table gives no
    rows; repeated rows count as often as they occur. Input columns may have any
    name: only the key, the order and the given expressions are read.
    """
    counts, sums = counts or {}, sums or {}
    narrow = df.select(
        F.col(key).alias("k"),
        *(F.col(c).alias(f"o{i}") for i, c in enumerate(order)),
        *(F.coalesce(c, F.lit(False)).cast("long").alias(f"c{i}") for i, c in enumerate(counts.values())),
        *(c.alias(f"s{i}") for i, c in enumerate(sums.values())),
    )
    ranged = range_partition(narrow, "k", [f"o{i}" for i in range(len(order))], partitions)
    states = ranged.withColumn(_PID, F.spark_partition_id()).groupBy("k", _PID).agg(
        F.count(F.lit(1)).alias("n"),
        *(F.sum(f"c{i}").alias(f"c{i}") for i in range(len(counts))),
        *(F.sum(f"s{i}").alias(f"s{i}") for i in range(len(sums))),
    )
    return states.groupBy("k").agg(
        F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("n_ranges"),
        *(F.sum(f"c{i}").alias(name) for i, name in enumerate(counts)),
        *(F.sum(f"s{i}").alias(name) for i, name in enumerate(sums)),
    ).withColumnRenamed("k", key)


def heavy_keys(df: DataFrame, key: str, order: Sequence[str], share: float, partitions: int | None = None) -> DataFrame:
    """Keys other than null that hold at least ``share`` of all rows (null rows count in the total)."""
    # One row per key; both the total and the keys come from it, so the input is ranged once.
    per_key = cut(stitched_aggregate(df, key, order, partitions=partitions))
    total = per_key.agg(F.sum("n")).scalar()
    return per_key.where(F.col(key).isNotNull() & (F.col("n") >= F.lit(share) * total)).select(
        key, "n", (F.col("n") / total).alias("share"), "n_ranges"
    )


def stitched_rank(
    df: DataFrame, key: str, order: Sequence[str], name: str = "rank_in_key", partitions: int | None = None
) -> DataFrame:
    """All rows with their 1-based rank within the key in the given order.

    Ties in ``order`` get distinct ranks; give a unique last order column for a
    result that is the same on every run. Nulls sort first. The ranged rows are
    written once to the shared checkpoint folder, since both the partial states and
    the rows themselves must see the same ranges.
    """
    kept = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("__row"), F.col(key).alias("__k"), *(F.col(c).alias(f"__o{i}") for i, c in enumerate(order)))
    cols = [f"__o{i}" for i in range(len(order))]
    ranged = range_partition(kept, "__k", cols, partitions).sortWithinPartitions("__k", *cols)
    rows = cut(ranged.select("__row", "__k", F.monotonically_increasing_id().alias(_MID)))
    pid = F.shiftright(_MID, 33).alias(_PID)
    states = rows.groupBy(F.col("__k"), pid).agg(F.count(F.lit(1)).alias("n"), F.min(_MID).alias("first"))
    before = Window.partitionBy("__k").orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    offsets = states.select(
        F.col("__k").alias("__sk"),
        F.col(_PID).alias("__sp"),
        (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"),
    )
    return rows.withColumn(_PID, pid).join(
        offsets, F.col("__k").eqNullSafe(F.col("__sk")) & (F.col(_PID) == F.col("__sp"))
    ).select("__row.*", (F.col(_MID) + F.col("shift") + 1).alias(name))


def capped_per_key(df: DataFrame, key: str, order: Sequence[str], cap: int, partitions: int | None = None) -> DataFrame:
    """The first ``cap`` rows of every key in the given order (the operator is the cap)."""
    return stitched_rank(df, key, order, "rank_in_key", partitions).where(F.col("rank_in_key") <= cap)
