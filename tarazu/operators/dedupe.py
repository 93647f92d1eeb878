"""Keyed dedupe and the sinks built on it: first wins, last wins, insert-ignore, append-only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pick(df: DataFrame, keys: Sequence[str], order: Sequence[str], last: bool = False) -> DataFrame:
    """One row per key: the first (or last) by ``order``. Map-side combined, no window, no sort of a hot key.

    Nulls sort first. Give an order that ends in a unique column.
    """
    by = F.struct(*(F.col(c) for c in order))
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    chosen = (F.max_by if last else F.min_by)(row, by)
    return df.groupBy(*keys).agg(chosen.alias("__row")).select("__row.*")


def upsert(current: DataFrame, changes: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Latest wins over the union; a column that one side lacks is null there."""
    return pick(current.unionByName(changes, allowMissingColumns=True), keys, order, last=True)


def insert_ignore(current: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of ``new`` whose key ``current`` does not have; of repeated new keys one row stays."""
    return new.join(current.select(*keys), list(keys), "left_anti").dropDuplicates(list(keys))


def append_unique(current: DataFrame, new: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows to append, rows refused because their key is taken)."""
    return insert_ignore(current, new, keys), new.join(current.select(*keys), list(keys), "left_semi")


def replace_children(current: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """Delete the children of every parent that has new ones, then add these."""
    return current.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new, allowMissingColumns=True)
