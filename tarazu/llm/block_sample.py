"""A reproducible sample that keeps its members as the data grow.

Randomised block selection. Every key owns a persistent sequence number, handed out once
when the key first arrives. The number line is divided into fixed blocks of ``POSITIONS``
numbers. For each block, a hash of (seed, block number) decides in advance which ``take``
positions are chosen, whether numbers in it have been handed out or not: the hash keys a
permutation of the positions, and a position is chosen when its image is below ``take``.

* The result does not depend on reruns, row order, copies or partitions.
* A key that is chosen stays chosen whatever arrives later: its number stays, and what
  is chosen in a block does not depend on how far the block is filled.
* A full block holds exactly ``take`` chosen keys, so the sample's size hardly varies.

A record number that the source hands out on arrival serves as the sequence number: a
key's number is its smallest one, which later rows cannot undercut. Where they can, a
ledger (``record``) pins each number for good.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import batched

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_BITS = 8
POSITIONS = 1 << BLOCK_BITS
#: Seeds drawn in one pass; more are drawn in several.
SEEDS_A_PASS = 256


def sequence_numbers(df: DataFrame, key: str, arrival: str, ledger: DataFrame | None = None) -> DataFrame:
    """``key, number``: each key's smallest arrival number, or the number the ledger has for it.

    Null keys have no number; neither have keys all of whose arrival numbers are null or
    negative, unless the ledger has one. Repeated rows count once.
    """
    fresh = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.min(F.when(F.col(arrival) >= 0, F.col(arrival))).cast("long").alias("number"))
    if ledger is not None:
        fresh = fresh.join(ledger.select("key", F.col("number").alias("pinned")), "key", "left").select("key", F.coalesce("pinned", "number").alias("number"))
    return fresh.where(F.col("number").isNotNull())


def record(numbers: DataFrame, path: str) -> DataFrame:
    """Append the numbers of keys the ledger at ``path`` does not have yet; returns the ledger."""
    spark = numbers.sparkSession
    try:
        known = spark.read.schema("key string, number long").parquet(path)
        known.limit(1).count()
        numbers = numbers.join(known, "key", "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    numbers.select(F.col("key").cast("string").alias("key"), "number").write.mode("append").parquet(path)
    return spark.read.schema("key string, number long").parquet(path)


def _hex(c: Column, start: int, digits: int) -> Column:
    return F.conv(F.substring(c, start, digits), 16, 10).cast("long")


def image(seed: Column, block: Column, position: Column) -> Column:
    """Where the permutation of a block, keyed by (seed, block number), sends a position."""
    mixed = F.md5(F.concat_ws(":", seed.cast("string"), block.cast("string")))
    at = position
    for k in range(3):  # odd factors and shifted bits: each step is a bijection
        at = (_hex(mixed, 8 * k + 1, 4).bitwiseOR(F.lit(1)) * at + _hex(mixed, 8 * k + 5, 4)).bitwiseAND(F.lit(POSITIONS - 1))
        if k < 2:
            at = at.bitwiseXOR(F.shiftright(at, BLOCK_BITS // 2))
    return at


def block_sample(numbers: DataFrame, seeds: DataFrame | list[int], take: int) -> DataFrame:
    """The chosen keys: ``key, seed, block, position, selection_prob``.

    ``numbers`` has distinct keys with their ``number``; ``seeds`` is a list, or a table
    whose first column is the seed (null and repeated seeds do not count). ``take`` 0
    chooses none, ``POSITIONS`` every key; an empty table or no seed gives no row. Keys
    are mapped one by one and not shuffled.
    """
    if not 0 <= take <= POSITIONS:
        raise ValueError(f"take must lie between 0 and {POSITIONS}")
    rows = numbers.select("key", F.shiftright("number", BLOCK_BITS).alias("block"), F.col("number").bitwiseAND(F.lit(POSITIONS - 1)).alias("position"))
    parts = []
    for group in batched(_distinct(seeds), SEEDS_A_PASS):
        drawn = rows.withColumn("seed", F.explode(F.array(*(F.lit(s).cast("long") for s in group))))
        parts.append(drawn.where(image(F.col("seed"), F.col("block"), F.col("position")) < take))
    got = reduce(DataFrame.unionByName, parts) if parts else rows.withColumn("seed", F.lit(0).cast("long")).where("false")
    return got.select("key", "seed", "block", "position", F.lit(take / POSITIONS).alias("selection_prob"))


def _distinct(seeds: DataFrame | list[int]) -> Iterator[int]:
    if isinstance(seeds, list):
        return iter(sorted(set(seeds)))
    c = F.col(f"`{seeds.columns[0]}`").cast("long").alias("seed")
    return (r[0] for r in seeds.select(c).where(F.col("seed").isNotNull()).distinct().orderBy("seed").toLocalIterator())
