"""Encoding families: character-frequency signatures, centroids, and greedy clustering."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarazu.functions import charclass as cc
from tarazu.session import cut

MIN_SIGNATURE_CHARS, THRESHOLD = 60, 0.80
CONVERTIBLE = ("LEGACY_8BIT", "LEGACY_ASCII", "LEGACY_SYMBOL")
NOISE = f"[{cc.java(cc.WS)[1:-1]}\\p{{Nd}}]+"


def signatures(df: DataFrame, ident: str, text: str) -> DataFrame:
    """``ident, ch, freq`` in long form; texts of fewer than 60 signs, digits and blanks aside, have none."""
    body = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), NOISE, "")
    rows = df.select(F.col(ident), body.alias("body")).where(F.length("body") >= MIN_SIGNATURE_CHARS)
    signs = rows.select(ident, F.length("body").alias("total"), F.explode(F.split("body", "")).alias("ch"))
    return signs.groupBy(ident, "total", "ch").agg(F.count(F.lit(1)).alias("n")).select(ident, "ch", (F.col("n") / F.col("total")).alias("freq"))


def centroids(sig: DataFrame, ident: str, family: str) -> DataFrame:
    """``family, ch, freq``: the mean frequency over the family's signatures, absent signs counting 0."""
    sizes = sig.select(family, ident).distinct().groupBy(family).agg(F.count(F.lit(1)).alias("size"))
    return sig.groupBy(family, "ch").agg(F.sum("freq").alias("s")).join(sizes, family).select(family, "ch", (F.col("s") / F.col("size")).alias("freq"))


def cosines(a: DataFrame, a_key: str, b: DataFrame, b_key: str) -> DataFrame:
    """``a_key, b_key, cosine`` of all pairs that share a sign, joined sign by sign.

    One side is a small set of centroids; pairs without a common sign have cosine 0 and
    are left out.
    """
    norm = lambda df, k, name: df.groupBy(k).agg(F.sqrt(F.sum(F.col("freq") * F.col("freq"))).alias(name))
    dot = a.select(a_key, "ch", F.col("freq").alias("fa")).join(b.select(b_key, "ch", F.col("freq").alias("fb")), "ch").groupBy(a_key, b_key).agg(F.sum(F.col("fa") * F.col("fb")).alias("dot"))
    return dot.join(norm(a, a_key, "na"), a_key).join(norm(b, b_key, "nb"), b_key).select(a_key, b_key, (F.col("dot") / (F.col("na") * F.col("nb"))).alias("cosine"))


#: Signs of centroids, and cells of their table, that are sent to the executors (below 100 MB); more are joined sign by sign.
MOST_CENTROID_SIGNS, MOST_CELLS = 500_000, 10_000_000


def nearest(sig: DataFrame, ident: str, cents: DataFrame, family: str) -> DataFrame:
    """``ident, nearest, cosine``; of equal cosines (to nine digits) the smaller family name wins.

    Signatures that share no sign with any centroid are left out.
    """
    few = cents.where(F.col(family).isNotNull()).select(family, "ch", "freq").limit(MOST_CENTROID_SIGNS + 1).collect()
    if len(few) > MOST_CENTROID_SIGNS or len({r[0] for r in few}) * len({r[1] for r in few}) > MOST_CELLS:
        c = cosines(sig, ident, cents.withColumnRenamed(family, "nearest"), "nearest").withColumn("cosine", F.round("cosine", 9))
        best = F.min_by(F.struct("nearest", "cosine"), F.struct(-F.col("cosine"), F.col("nearest")))
        return c.groupBy(ident).agg(best.alias("x")).select(ident, "x.*")
    # A text has as many different signs as its script, so its row is short.
    rows = sig.groupBy(F.col(ident).alias("item")).agg(F.collect_list(F.struct("ch", "freq")).alias("s"))
    rows = rows.select("item", F.col("s.ch").alias("ch"), F.col("s.freq").alias("freq"))
    names = sorted({r[0] for r in few})
    signs = {ch: i for i, ch in enumerate(sorted({r[1] for r in few}))}
    shared = sig.sparkSession.sparkContext.broadcast((names, signs, [(names.index(f), signs[ch], x) for f, ch, x in few]))
    kind = dict(rows.dtypes)["item"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, signs, cells = shared.value
        c = np.zeros((len(names), len(signs) + 1))
        for f, ch, x in cells:
            c[f, ch] = x
        norms = np.linalg.norm(c, axis=1)
        for whole in batches:
            for lo in range(0, len(whole), 1024):
                b = whole.slice(lo, 1024)
                of = np.repeat(np.arange(len(b)), b.column(1).value_lengths().to_numpy(zero_copy_only=False))
                at = np.array([signs.get(x, len(signs)) for x in b.column(1).flatten().to_pylist()], np.int64)
                freq = b.column(2).flatten().to_numpy(zero_copy_only=False)
                norm = np.sqrt(np.bincount(of, weights=freq * freq, minlength=len(b)))
                cell, of_cell = np.unique(of * (len(signs) + 1) + at, return_inverse=True)
                rows_ = np.zeros(len(b) * (len(signs) + 1))
                rows_[cell] = np.bincount(of_cell, weights=freq)
                rows_ = rows_.reshape(len(b), -1)
                rows_[:, -1] = 0.0
                cosine = np.round(rows_ @ c.T / np.maximum(np.outer(norm, norms), 1e-300), 9)
                best = cosine.argmax(1)
                some = np.nonzero((rows_ > 0).any(1) & (cosine.max(1) > 0))[0]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(some)), pa.array([names[k] for k in best[some]], pa.string()), pa.array(cosine[some, best[some]])], ["item", "nearest", "cosine"])

    schema = f"item {kind}, nearest string, cosine double"
    found = rows.mapInArrow(run, schema) if names else sig.sparkSession.createDataFrame([], schema)
    return found.withColumnRenamed("item", ident)


class _Greedy:
    """The running clusters of the single pass: the first whose centroid is near enough takes the next signature."""

    def __init__(self, threshold: float):
        self.threshold, self.k = threshold, 0
        self.sign: dict[str, int] = {}
        self.sums, self.norms = np.zeros((16, 256)), np.zeros(16)
        self.leaders: list = []

    def columns(self, signs: list[str]) -> np.ndarray:
        """The column of each sign; signs not met before get new ones."""
        at = np.array([self.sign.setdefault(ch, len(self.sign)) for ch in signs], np.int64)
        if len(self.sign) > (width := self.sums.shape[1]):
            self.sums = np.pad(self.sums, ((0, 0), (0, max(len(self.sign) - width, width))))
        return at

    def add(self, item, at: np.ndarray, freq: np.ndarray) -> tuple[int, float]:
        """The cluster of the next signature and its similarity to the centroid it met."""
        size, found, sim = math.sqrt(float(freq @ freq)), -1, 1.0
        if self.k and size:
            # A cluster's sum points where its centroid points.
            s = (self.sums[: self.k, at] @ freq) / np.maximum(self.norms[: self.k] * size, 1e-300)
            hits = np.nonzero(s >= self.threshold)[0]
            if len(hits):
                found, sim = int(hits[0]), float(s[hits[0]])
        if found < 0:
            if self.k == len(self.norms):
                self.sums = np.pad(self.sums, ((0, self.k), (0, 0)))
                self.norms = np.pad(self.norms, (0, self.k))
            found, self.k = self.k, self.k + 1
            self.leaders.append(item)
        row = self.sums[found]
        row[at] += freq
        self.norms[found] = math.sqrt(float(row @ row))
        return found, sim


def greedy_families(sig: DataFrame, ident: str, threshold: float = THRESHOLD, block: int = 4000) -> DataFrame:
    """``ident, family, similarity`` by greedy single-pass clustering in the order of the identifier.

    Every signature goes to the first cluster whose running centroid is near enough, at
    any number of signatures: they are sorted (on disk where they are many) and streamed
    past the centroids by one task, since each decision depends on all before it. The
    task holds the centroids and ``block`` signatures at a time, which changes nothing in
    the result. Families are numbered by size, then by first member.
    """
    # Signs in order, so that sums do not depend on how the rows were gathered.
    signs = F.array_sort(F.collect_list(F.struct("ch", "freq")))
    items = sig.groupBy(ident).agg(signs.alias("sig")).select(F.col(ident).alias("item"), F.col("sig.ch").alias("ch"), F.col("sig.freq").alias("freq"))
    kind = dict(items.dtypes)["item"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pass_ = _Greedy(threshold)
        for whole in batches:
            for lo in range(0, len(whole), block):
                b = whole.slice(lo, block)
                chars = b.column(1).flatten().dictionary_encode()
                at = pass_.columns(chars.dictionary.to_pylist())[chars.indices.to_numpy()]
                freq = b.column(2).flatten().to_numpy()
                ends = np.cumsum([0, *b.column(1).value_lengths().to_pylist()])
                names = b.column(0).to_pylist()
                got = [pass_.add(names[i], at[ends[i] : ends[i + 1]], freq[ends[i] : ends[i + 1]]) for i in range(len(b))]
                leaders = pa.array([pass_.leaders[c] for c, _ in got], b.schema.field(0).type)
                yield pa.RecordBatch.from_arrays([b.column(0), leaders, pa.array([x for _, x in got], pa.float64())], ["item", "leader", "similarity"])

    ordered = items.repartition(1).sortWithinPartitions(F.asc_nulls_last("item"))
    path = cut(ordered.mapInArrow(run, f"item {kind}, leader {kind}, similarity double"))
    sizes = path.groupBy("leader").agg(F.count(F.lit(1)).alias("size"))
    # Ranks run over the families, one row each.
    named = sizes.withColumn("family", F.format_string("fam-%02d", F.row_number().over(Window.orderBy(F.desc("size"), "leader"))))
    return path.join(named, "leader").select(F.col("item").alias(ident), "family", F.round("similarity", 9).alias("similarity"))


def family_slug(rank: str, top_name: str):
    """``fam-01-<name>``: up to 12 letters and digits of the commonest font name, or unnamed."""
    slug = F.substring(F.regexp_replace(F.lower(F.col(top_name)), "[^a-z0-9]+", ""), 1, 12)
    return F.format_string("fam-%02d-%s", F.col(rank), F.when(slug != "", slug).otherwise("unnamed"))


def family_stats(members: DataFrame) -> DataFrame:
    """Per family: size, files, commonest label and its share, four commonest names, longest text.

    ``members``: family, obs_id, sha256, label, font_name, text. Names are counted before
    they are gathered, so a family that holds most rows is no single task.
    """
    count = F.count(F.lit(1))
    base = members.groupBy("family").agg(count.alias("n"), F.count_distinct("sha256").alias("n_files"), F.max(F.length("text")).cast("long").alias("longest"))
    labels = members.groupBy("family", "label").agg(count.alias("k")).groupBy("family").agg(F.min_by("label", F.struct(-F.col("k"), F.col("label"))).alias("label"), F.max("k").alias("k"))
    names = members.groupBy("family", "font_name").agg(count.alias("k"))
    top = names.withColumn("r", F.row_number().over(Window.partitionBy("family").orderBy(F.desc("k"), "font_name"))).where("r <= 4")
    shown = top.groupBy("family").agg(F.array_join(F.array_sort(F.collect_list(F.struct("r", "font_name"))).getField("font_name"), ", ").alias("names"))
    got = base.join(labels, "family").join(shown, "family", "left")
    return got.select("family", "n", "n_files", "label", F.round(F.col("k") / F.col("n"), 6).alias("purity"), "names", "longest")
