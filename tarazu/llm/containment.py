"""Which documents contain passages of a set of test items, whole, in part or edited.

Size-partitioned MinHash containment search, verified by exact shingle containment. A
short item inside a long document has a tiny Jaccard similarity, so the search is
asymmetric: only the items are sketched, and the documents are streamed past the sketches
as what they are, sets of five-word shingles.

* Items are put into partitions by size, their number of shingles, doubling from one to
  the next. An item's sketch holds the MinHash of each of its windows; the width of the
  windows is the partition's, so that every item is represented by about ``SKETCH``
  minima or more, and never wider than the shingles of ``run`` words. A document with
  ``run`` consecutive words of an item therefore holds a whole window and its MinHash
  without fail; one with the share t of the item's shingles misses all minima with a
  probability of about (1 - t) ** SKETCH (0.00002 at 0.5).
* A document that holds a MinHash of an item is a candidate for it. For candidates the
  exact containment is counted, the share of the item's different shingles that the
  document has, and the longest run of words both have in order; what is reported is
  compared word by word, not by hashes.

Items are sent to the executors in blocks of ``BLOCK_WORDS`` words, each block against
all documents, whatever the number of blocks; texts of documents are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarazu.llm.words import WordHashes, shingle_hashes, sliding_min, words

SHINGLE = 5
#: Minima an item of any size is represented by, if it has so many shingles.
SKETCH = 16
#: Words of items sent to the executors at a time: below 50 MB.
BLOCK_WORDS = 1_000_000
#: Matches of shingles looked at together.
MOST_MATCHES = 2_000_000
_FILTER_BITS = 22


def window_width(n: int, run: int | None) -> int:
    """Shingles in a window of an item of ``n`` shingles, equal for all sizes of a partition."""
    least = 1 << max(0, (n - 1).bit_length() - 1)  # the partition's smallest size
    width = max(1, 2 * least // SKETCH - 1)
    return min(width, n, run - SHINGLE + 1) if run else min(width, n)


def sketch(shingles: np.ndarray, run: int | None) -> np.ndarray:
    """The different MinHashes of all windows of an item."""
    n = len(np.unique(shingles))
    return np.unique(sliding_min(shingles, window_width(n, run))) if n else shingles


def _expand(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of each range, number inside it) over all ranges."""
    n = hi - lo
    of = np.repeat(np.arange(len(lo)), n)
    return of, np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


class ItemBlock:
    """Sketches and shingles of some items, and the search of documents for them."""

    def __init__(self, texts: list[str], run: int | None, threshold: float | None):
        self.run, self.threshold = run, threshold
        self.hashes = hashes = WordHashes()
        self.words = [t.split() for t in texts]
        shingles = [shingle_hashes(hashes.of(w), SHINGLE) for w in self.words]
        self.sizes = np.array([len(np.unique(s)) for s in shingles], np.int64)
        self.hash, self.item, self.at = self._sorted(shingles)
        self.min_hash, self.min_item, _ = self._sorted([sketch(s, run) for s in shingles])
        self.table = np.zeros(1 << _FILTER_BITS, bool)
        self.table[self._low(self.min_hash)] = True
        # Windows of ``run`` words with the same words count as one.
        self.window_start = np.cumsum([0, *(len(w) for w in self.words)])
        self.window = np.arange(self.window_start[-1])
        for i, w in enumerate(self.words) if run else ():
            _, first, same = np.unique(shingle_hashes(hashes.of(w), run), return_index=True, return_inverse=True)
            self.window[self.window_start[i] : self.window_start[i] + len(same)] = self.window_start[i] + first[same]

    @staticmethod
    def _low(h: np.ndarray) -> np.ndarray:
        return (h & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)

    @staticmethod
    def _sorted(hashes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, item, place in the item), by hash."""
        sizes = [len(h) for h in hashes]
        flat = np.concatenate([np.zeros(0, np.uint64), *hashes])
        item = np.repeat(np.arange(len(hashes)), sizes)
        place = np.concatenate([np.zeros(0, np.int64), *map(np.arange, sizes)])
        order = np.argsort(flat, kind="stable")
        return flat[order], item[order], place[order]

    def candidates(self, shingles: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Pairs ``owner * number of items + item`` of which the owner has a MinHash of the item."""
        near = np.nonzero(self.table[self._low(shingles)])[0]
        found = shingles[near]
        lo, hi = np.searchsorted(self.min_hash, found), np.searchsorted(self.min_hash, found, "right")
        some = hi > lo
        of, j = _expand(lo[some], hi[some])
        return np.unique(owner[near[some]][of] * len(self.words) + self.min_item[j])

    def search(self, texts: list[str]) -> list[tuple[int, int, int, int, float]]:
        """(text, item, longest run in words, windows of the item, containment) of every pair to report."""
        listed: list[str] = []
        ends = np.zeros(len(texts) + 1, np.int64)
        for i, t in enumerate(texts):
            listed += words(t)
            ends[i + 1] = len(listed)
        if len(listed) < SHINGLE or not len(self.min_hash):
            return []
        shingles = shingle_hashes(self.hashes.of(listed), SHINGLE)
        owner = np.repeat(np.arange(len(texts)), np.diff(ends))
        inside = np.nonzero(owner[: len(shingles)] == owner[SHINGLE - 1 :])[0]
        pairs = self.candidates(shingles[inside], owner[inside])
        if not len(pairs):
            return []
        m = len(self.words)
        inside = inside[np.isin(owner[inside], np.unique(pairs // m))]
        lo, hi = np.searchsorted(self.hash, shingles[inside]), np.searchsorted(self.hash, shingles[inside], "right")
        some = hi > lo
        inside, lo, hi = inside[some], lo[some], hi[some]
        # A document's matches stay together: parts begin where a document begins.
        upto = np.cumsum(hi - lo)
        first = np.nonzero(np.diff(owner[inside], prepend=-1))[0]
        part = (upto[first] - (hi - lo)[first]) // MOST_MATCHES if len(first) else first
        cuts = [*first[np.nonzero(np.diff(part, prepend=-1))[0]], len(inside)]
        out = []
        for a, b in zip(cuts, cuts[1:]):
            of, j = _expand(lo[a:b], hi[a:b])
            where = inside[a:b][of]
            pair = owner[where] * m + self.item[j]
            keep = np.isin(pair, pairs)
            out += self._measure(pair[keep], where[keep], j[keep], listed)
        return out

    def _measure(self, pair: np.ndarray, where: np.ndarray, j: np.ndarray, listed: list[str]) -> list[tuple[int, int, int, int, float]]:
        m, out = len(self.words), []
        at = self.at[j]
        order = np.lexsort((at, where - at, pair))
        pair, where, at, j = pair[order], where[order], at[order], j[order]
        new_pair = np.diff(pair, prepend=-1) != 0
        start = np.nonzero(new_pair | (np.diff(where - at, prepend=0) != 0) | (np.diff(at, prepend=0) != 1))[0]
        length = np.diff(start, append=len(pair))
        bounds = np.nonzero(new_pair)[0]
        run_bounds = np.searchsorted(start, [*bounds, len(pair)])
        need = self.run - SHINGLE + 1 if self.run else None
        for k, a in enumerate(bounds.tolist()):
            z = int(bounds[k + 1]) if k + 1 < len(bounds) else len(pair)
            text, item = divmod(int(pair[a]), m)
            runs = slice(int(run_bounds[k]), int(run_bounds[k + 1]))
            longest, windows = 0, set()
            n_common = len(np.unique(self.hash[j[a:z]]))
            by_share = self.threshold is not None and n_common >= self.threshold * self.sizes[item] - 1e-9
            if not by_share and (need is None or int(length[runs].max()) < need):
                continue
            # What is reported is compared word by word.
            own = self.words[item]
            equal = {int(at[q]) for q in range(a, z) if listed[where[q] : where[q] + SHINGLE] == own[at[q] : at[q] + SHINGLE]}
            share = len({tuple(own[x : x + SHINGLE]) for x in equal}) / int(self.sizes[item])
            for s, n in zip(start[runs].tolist(), length[runs].tolist()):
                x, y, n = int(where[s]), int(at[s]), n + SHINGLE - 1
                if listed[x : x + n] == own[y : y + n]:
                    longest = max(longest, n)
                    if self.run and n >= self.run:
                        windows.update(self.window[self.window_start[item] + y : self.window_start[item] + y + n - self.run + 1].tolist())
            if windows or (self.threshold is not None and share >= self.threshold - 1e-9):
                out.append((text, item, longest, len(windows), share))
        return out


def _folded(df: DataFrame, ident: str, text: str) -> DataFrame:
    """``ident, key, folded, n``: the words of each item of at least five words, and a hash of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, w) for i, t in enumerate(b.column(1).to_pylist()) if len(w := words(t)) >= SHINGLE]
            if rows:
                at, listed = zip(*rows)
                text = [" ".join(w) for w in listed]
                cols = [pa.array([xxhash.xxh3_128_hexdigest(t) for t in text]), pa.array(text), pa.array(map(len, listed), pa.int64())]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), *cols], ["ident", "key", "folded", "n"])

    kind = df.schema[ident].dataType.simpleString()
    rows = df.select(F.col(ident).alias("ident"), F.col(text).alias("text")).where(F.col("ident").isNotNull() & F.col("text").isNotNull())
    return rows.mapInArrow(run, f"ident {kind}, key string, folded string, n long")


def _blocks(passages: DataFrame) -> Iterator[list[tuple[str, str]]]:
    """Passages in blocks of about ``BLOCK_WORDS`` words; the driver holds one block at a time."""
    block: list[tuple[str, str]] = []
    held = 0
    for key, folded, n in passages.orderBy("key").toLocalIterator():
        if block and held + n > BLOCK_WORDS:
            yield block
            block, held = [], 0
        block.append((key, folded))
        held += n
    if block:
        yield block


def contained_items(
    documents: DataFrame, doc_id: str, doc_text: str, items: DataFrame, item_id: str, item_text: str, run: int | None = 12, threshold: float | None = None
) -> DataFrame:
    """``doc_id, item_id, longest_run, n_windows, containment`` of every document and item it contains.

    A document contains an item if it has ``run`` consecutive words of it, or at least
    the share ``threshold`` of its different five-word shingles; either may be None.
    Words are runs of letters, marks and digits; case, punctuation, blanks and signs that
    draw nothing do not count. ``longest_run`` is the longest run of words both have,
    ``n_windows`` the number of different windows of ``run`` words of the item that occur
    in the document, ``containment`` the share of its shingles. Null texts and
    identifiers and texts of fewer than five words match nothing; repeated rows count
    once, and of rows with one identifier and different texts the largest figures count.
    Items with equal words are searched once and reported each. Other columns are dropped.
    """
    if run is not None and run < SHINGLE:
        raise ValueError(f"run must be at least {SHINGLE} words")
    if run is None and threshold is None:
        raise ValueError("give run, threshold or both")
    spark = documents.sparkSession
    listed = _folded(items, item_id, item_text)
    kind = documents.schema[doc_id].dataType.simpleString()
    schema = f"doc {kind}, key string, longest_run int, n_windows int, containment double"
    rows = documents.select(F.col(doc_id).alias("doc"), F.col(doc_text).alias("text")).where(F.col("doc").isNotNull() & F.col("text").isNotNull())
    parts = []
    for block in _blocks(listed.groupBy("key").agg(F.min("folded").alias("folded"), F.min("n").alias("n"))):
        keys = [k for k, _ in block]
        shared = spark.sparkContext.broadcast((keys, [t for _, t in block], run, threshold))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            keys, look = _made(shared.value)
            for whole in batches:
                for lo in range(0, len(whole), 256):  # bounds the memory for long texts
                    b = whole.slice(lo, 256)
                    found = look.search(b.column(1).to_pylist())
                    if found:
                        at, item, longest, windows, share = zip(*found)
                        cols = [pa.array([keys[i] for i in item]), pa.array(longest, pa.int32()), pa.array(windows, pa.int32()), pa.array(share, pa.float64())]
                        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), *cols], ["doc", "key", "longest_run", "n_windows", "containment"])

        parts.append(rows.mapInArrow(search, schema))
    found = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)
    members = listed.select("key", F.col("ident").alias("item"))
    measures = [F.max(c).alias(c) for c in ("longest_run", "n_windows", "containment")]
    return found.join(members, "key").groupBy(F.col("doc").alias(doc_id), F.col("item").alias(item_id)).agg(*measures)


_kept: list = []


def _made(value: tuple) -> tuple[list[str], ItemBlock]:
    """The block at hand, made once in a Python worker."""
    if not _kept or _kept[0] is not value:
        keys, texts, run, threshold = value
        _kept[:] = [value, ItemBlock(texts, run, threshold)]
    return value[0], _kept[1]
