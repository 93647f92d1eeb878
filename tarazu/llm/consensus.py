"""Consensus labels, agreement and annotator reliability by confidence-aware truth discovery.

Alternating minimisation of the weighted label distance: labels are the weighted
majority, and an annotator's weight is the inverse of an upper bound of their error
variance, ``chi2(alpha / 2, n) / sum of distances``. The chi-squared quantile makes the
bound wide for annotators with few votes (the long tail), so these do not gain weight
by a lucky streak. The distance of a vote is taken to the weighted majority of the
*other* votes on the item (0 equal, 1 different, 1/2 tied): measured against a consensus
that contains the vote itself, one annotator's weight grows without end.

The source is read once: spellings are folded, repeated judgements dropped, and what is
left is written. One more shuffle makes one row per item (its votes, one per annotator,
as integer codes). Equal vote sets are then counted once, and every round is a map over
these patterns plus a sum per annotator, so a round costs by patterns, not by items.
Beyond ``MOST_ANNOTATORS`` or ``MOST_LABELS`` codes and weights are not held on the
driver; the same rounds then run as joins of the votes with a table of weights.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarazu.functions.labels import same_annotator, same_label
from tarazu.session import cut

MOST_ANNOTATORS, MOST_LABELS = 1_000_000, 100_000
EPS = 1e-9


def chi2_quantile(n: np.ndarray, z: float) -> np.ndarray:
    """The chi-squared quantile at the normal quantile ``z`` (Wilson and Hilferty)."""
    n = np.maximum(n, 1.0)
    return n * np.maximum(1 - 2 / (9 * n) + z * np.sqrt(2 / (9 * n)), 0.05) ** 3


@dataclass
class Votes:
    """``last``: item, annotator, label, one row per vote. ``items``: the votes of an item, coded
    ``annotator * len(labels) + label``; None where there are too many names to hold them here."""

    last: DataFrame
    items: DataFrame | None
    annotators: list[str]
    labels: list[str]


def votes(df: DataFrame, item: str, annotator: str, label: str, latest: list[str]) -> Votes:
    """Fold repeated judgements: of one annotator's votes on an item the last by ``latest`` counts.

    Rows without item, annotator or label are left out; repeated rows count once. An
    item has at most as many votes as there are annotators, which bounds its row.
    """
    rows = df.select(
        F.col(item).alias("item"), same_annotator(F.col(annotator)).alias("annotator"), same_label(F.col(label)).alias("label"), *(F.col(c).alias(f"t{i}") for i, c in enumerate(latest))
    ).where(F.col("item").isNotNull() & F.col("annotator").isNotNull() & F.col("label").isNotNull())
    last = cut(rows.groupBy("item", "annotator").agg(F.max(F.struct(*(f"t{i}" for i in range(len(latest))), "label"))["label"].alias("label")))
    names = sorted(r[0] for r in last.select("annotator").distinct().limit(MOST_ANNOTATORS + 1).collect())
    # More frequent labels first: of equally supported labels the more frequent one wins.
    by_label = last.groupBy("label").count().orderBy(F.desc("count"), "label").limit(MOST_LABELS + 1).collect()
    labels = [r[0] for r in by_label]
    if len(names) > MOST_ANNOTATORS or len(labels) > MOST_LABELS:
        return Votes(last, None, [], [])
    spark = df.sparkSession
    # Codes are joined on, whatever their number; Spark broadcasts them if they are small.
    coded = lambda values, c, n: spark.createDataFrame(list(zip(values, range(len(values)))), f"{c} string, {n} long")
    items = (
        last.join(coded(names, "annotator", "a"), "annotator")
        .join(coded(labels, "label", "l"), "label")
        .select("item", (F.col("a") * len(labels) + F.col("l")).alias("vote"))
        .groupBy("item")
        .agg(F.sort_array(F.collect_list("vote")).alias("votes"))
    )
    return Votes(last, cut(items), names, labels)


@dataclass
class _Scores:
    """Support of the labels voted for in a batch: cells are (row, label), sorted by row and label."""

    row: np.ndarray  # of each vote
    annotator: np.ndarray
    cell: np.ndarray
    cell_row: np.ndarray
    cell_label: np.ndarray
    support: np.ndarray

    @classmethod
    def of(cls, col: pa.ListArray, k: int, w: np.ndarray) -> _Scores:
        col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
        code = col.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(col)), np.diff(col.offsets.to_numpy()))
        a, label = np.divmod(code, k)
        cells, cell = np.unique(row * k + label, return_inverse=True)
        return cls(row, a, cell, *np.divmod(cells, k), np.bincount(cell, weights=w[a], minlength=len(cells)))

    def best(self) -> tuple[np.ndarray, np.ndarray]:
        """(best cell, support of the second best or -1) by row; equal support goes to the smaller label. No row is without a vote."""
        order = np.lexsort((self.cell_label, -self.support, self.cell_row))
        first = np.nonzero(np.diff(self.cell_row[order], prepend=-1))[0]
        alone = np.diff(first, append=len(order)) == 1
        second = np.where(alone, -1.0, self.support[order[np.minimum(first + 1, len(order) - 1)]])
        return order[first], second


def _round(patterns: DataFrame, k: int, m: int, w: np.ndarray, own_vote: bool) -> tuple[np.ndarray, np.ndarray]:
    """Summed distances and numbers of scored votes per annotator."""
    shared = patterns.sparkSession.sparkContext.broadcast(w)

    def distances(batches):
        err, n = np.zeros(m), np.zeros(m)
        for b in batches:
            if not len(b):
                continue
            s = _Scores.of(b.column(0), k, shared.value)
            times = b.column(1).to_numpy().astype(float)
            top, second = s.best()
            if own_vote:
                d = (s.cell != top[s.row]).astype(float)
            else:
                others = np.where(s.cell == top[s.row], second[s.row], s.support[top[s.row]])
                rest = others - (s.support[s.cell] - shared.value[s.annotator])
                d = np.where(rest > EPS, 1.0, np.where(rest < -EPS, 0.0, 0.5))
            votes_in_row = np.bincount(s.row, minlength=len(times))
            weight = np.where(votes_in_row[s.row] > 1, times[s.row], 0.0)  # a lone vote has nobody to be compared with
            err += np.bincount(s.annotator, weights=d * weight, minlength=m)
            n += np.bincount(s.annotator, weights=weight, minlength=m)
        some = np.nonzero(n)[0]
        yield pa.RecordBatch.from_pydict({"a": pa.array(some, pa.int32()), "err": err[some], "n": n[some]})

    out = patterns.mapInArrow(distances, "a int, err double, n double").groupBy("a").agg(F.sum("err"), F.sum("n")).collect()
    err, n = np.zeros(m), np.zeros(m)
    for a, e, c in out:
        err[a], n[a] = round(e, 6), c
    shared.unpersist()
    return err, n


@dataclass
class Consensus:
    """``items``: item, label, n_annotators, agreement, support. ``annotators``: annotator, n_votes, error_rate, weight.

    ``converged`` is False where ``rounds`` were not enough for the weights to settle.
    """

    items: DataFrame
    annotators: DataFrame
    rounds: int
    converged: bool


ANNOTATORS = "annotator string, n_votes long, error_rate double, weight double"


def consensus(v: Votes, rounds: int = 25, alpha: float = 0.05, tolerance: float = 1e-4, own_vote: bool = False) -> Consensus:
    """Alternate labels and weights until the weights change by less than ``tolerance``.

    ``agreement`` is the share of pairs of votes on the item that are equal (null for a
    single vote), ``support`` the weighted share of the votes for the label. No votes
    give no rows. The result does not depend on row order or partitions. With
    ``own_vote`` distances are taken to a majority that contains the vote itself.
    """
    if v.items is None:
        return _joined(v, rounds, alpha, tolerance, own_vote)
    spark = v.last.sparkSession
    k, m = max(1, len(v.labels)), len(v.annotators)
    z = NormalDist().inv_cdf(alpha / 2)
    w = np.ones(m)
    err = n = np.zeros(m)
    done, used = m == 0, 0
    if m:
        patterns = cut(v.items.groupBy("votes").agg(F.count(F.lit(1)).alias("times")))
        while not done and used < rounds:
            err, n = _round(patterns, k, m, w, own_vote)
            new = chi2_quantile(n, z) / (err + 1.0)  # one error more than seen: nobody is without fault
            new = np.where(n > 0, new, np.median(new[n > 0]) if (n > 0).any() else 1.0)
            done = float(np.abs(new - w).max()) < tolerance
            w, used = new, used + 1
    _report(done, used)
    labels, shared = list(v.labels), spark.sparkContext.broadcast(w)

    def decide(batches):
        for b in batches:
            if not len(b):
                continue
            s = _Scores.of(b.column(1), k, shared.value)
            top, _ = s.best()
            n_votes = np.bincount(s.row, minlength=len(b))
            each = np.bincount(s.cell, minlength=len(s.cell_row))
            pairs = n_votes * (n_votes - 1)
            agree = np.divide(np.bincount(s.cell_row, weights=each * (each - 1), minlength=len(b)), pairs, out=np.full(len(b), np.nan), where=pairs > 0)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([labels[i] for i in s.cell_label[top]], pa.string()),
                    pa.array(n_votes, pa.int64()),
                    pa.array(agree, pa.float64(), from_pandas=True),
                    pa.array(s.support[top] / np.bincount(s.cell_row, weights=s.support, minlength=len(b)), pa.float64()),
                ],
                ["item", "label", "n_annotators", "agreement", "support"],
            )

    kind = dict(v.last.dtypes)["item"]
    schema = f"item {kind}, label string, n_annotators long, agreement double, support double"
    items = v.items.mapInArrow(decide, schema) if m else spark.createDataFrame([], schema)
    rows = [(a, int(n[i]), float(err[i] / n[i]) if n[i] else math.nan, float(w[i])) for i, a in enumerate(v.annotators)]
    return Consensus(items, spark.createDataFrame(rows, ANNOTATORS), used, done)


def _report(done: bool, used: int) -> None:
    if not done:
        warnings.warn(f"the weights of the annotators did not settle in {used} rounds", stacklevel=3)


def _joined(v: Votes, rounds: int, alpha: float, tolerance: float, own_vote: bool) -> Consensus:
    """The same rounds as joins: votes, support of labels and weights are tables, whatever their number."""
    last, z = v.last, NormalDist().inv_cdf(alpha / 2)
    rank = last.groupBy("label").agg(F.count(F.lit(1)).alias("often"))
    weights = cut(last.select("annotator").distinct().select("annotator", F.lit(0.0).alias("n"), F.lit(0.0).alias("err"), F.lit(1.0).alias("w")))
    by_item = Window.partitionBy("item")
    done, used = False, 0

    def supported(weights: DataFrame) -> tuple[DataFrame, DataFrame]:
        voted = last.join(weights.select("annotator", "w"), "annotator")
        cells = voted.groupBy("item", "label").agg(F.sum("w").alias("support"), F.count(F.lit(1)).alias("each")).join(rank, "label")
        place = F.row_number().over(by_item.orderBy(F.desc(F.round("support", 9)), F.desc("often"), "label"))
        return voted, cells.withColumns({"place": place, "n_votes": F.sum("each").over(by_item), "total": F.sum("support").over(by_item)})

    while not done and used < rounds:
        voted, cells = supported(weights)
        tops = cells.groupBy("item").agg(F.max(F.when(F.col("place") == 1, F.col("support"))).alias("first"), F.max(F.when(F.col("place") == 2, F.col("support"))).alias("second"))
        each = voted.join(cells.select("item", "label", "support", "place", "n_votes"), ["item", "label"]).join(tops, "item").where("n_votes > 1")
        rest = F.when(F.col("place") == 1, F.coalesce("second", F.lit(-1.0))).otherwise(F.col("first")) - (F.col("support") - F.col("w"))
        far = (F.col("place") != 1).cast("double") if own_vote else F.when(rest > EPS, 1.0).when(rest < -EPS, 0.0).otherwise(0.5)
        sums = each.groupBy("annotator").agg(F.count(F.lit(1)).cast("double").alias("n"), F.round(F.sum(far), 6).alias("err"))
        spread = 1 - 2 / (9 * F.col("n")) + z * F.sqrt(2 / (9 * F.col("n")))
        new = cut(sums.withColumn("w", F.col("n") * F.pow(F.greatest(spread, F.lit(0.05)), F.lit(3)) / (F.col("err") + 1)))
        middle = new.agg(F.median("w")).first()[0] or 1.0
        zero = F.lit(0.0)
        joined = weights.select("annotator", F.col("w").alias("old")).join(new, "annotator", "left")
        weights = cut(joined.select("annotator", F.coalesce("n", zero).alias("n"), F.coalesce("err", zero).alias("err"), F.coalesce("w", F.lit(middle)).alias("w"), "old"))
        done = (weights.agg(F.max(F.abs(F.col("w") - F.col("old")))).first()[0] or 0.0) < tolerance
        weights, used = weights.drop("old"), used + 1
    _report(done, used)
    _, cells = supported(weights)
    pairs = F.col("n_annotators") * (F.col("n_annotators") - 1)
    items = cells.groupBy("item").agg(
        F.max(F.when(F.col("place") == 1, F.col("label"))).alias("label"),
        F.max("n_votes").alias("n_annotators"),
        F.sum(F.col("each") * (F.col("each") - 1)).alias("equal"),
        (F.max(F.when(F.col("place") == 1, F.col("support"))) / F.max("total")).alias("support"),
    )
    items = items.select("item", "label", "n_annotators", F.when(pairs > 0, F.col("equal") / pairs).alias("agreement"), "support")
    annotators = weights.select("annotator", F.col("n").cast("long").alias("n_votes"), F.when(F.col("n") > 0, F.col("err") / F.col("n")).otherwise(float("nan")).alias("error_rate"), F.col("w").alias("weight"))
    return Consensus(items, annotators, used, done)
