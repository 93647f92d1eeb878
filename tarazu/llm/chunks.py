"""Cutting texts above a token limit into pieces at natural boundaries, by their content.

Content-defined chunking. A rolling hash over the last words marks landmarks: of a
stretch that is too long for a piece, the landmark is the place of the smallest hash that
leaves at least the least size on both sides. It snaps to the nearest natural boundary
around it, a paragraph before a line, a sentence, a word, and the stretch is divided
there; both sides are divided likewise until they fit. Which landmarks count depends on
the words around them and not on how many pieces lie before them, so an edit alters the
pieces beside it and no others. Words too long for a piece are divided by the same rule:
between the tokenizer's own parts, and inside long runs of letters at landmarks of a
rolling hash over characters.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarazu.llm.tokens import DEFAULT_RANKS, PATTERN, TokenCounter, atoms_of, counter, read_ranks
from tarazu.llm.words import WordHashes, mix, shingle_hashes, sliding_min

ROLL = 4  # words of a landmark
CHARS, NEAR = 6, 8  # characters of a landmark inside a word, and to either side of it without a smaller hash
KINDS = ("inside", "word", "sentence", "line", "paragraph", "end")
_STOPS = np.array([ord(c) for c in ".!?।॥…"], np.uint32)
_CLOSERS = np.array([ord(c) for c in "\"')]}”’»"], np.uint32)
_PAGES = np.array([0x0B, 0x0C, 0x1C, 0x1D, 0x1E, 0x2029], np.uint32)
_PIECES = regex.compile(PATTERN)


@dataclass(frozen=True)
class Sizes:
    """Limits in tokens. A piece of ``limit`` holds up to ``overlap`` tokens of the piece before it."""

    limit: int = 1024
    overlap: int = 96
    least: int = 448

    @property
    def most(self) -> int:
        return self.limit - self.overlap

    def __post_init__(self):
        if not 0 <= self.overlap < self.limit or not 0 < self.least <= self.most or self.most < 16:
            raise ValueError("sizes must satisfy 0 < least <= limit - overlap, and limit - overlap >= 16")


def _inseparable(ch: str) -> bool:
    """No part begins with a mark or a joiner."""
    return unicodedata.category(ch)[0] == "M" or ch in "\u200c\u200d"


def _pinched(run: str, most: int) -> list[str]:
    """A run of letters in parts of at most ``most`` characters, divided where a rolling hash is least among its neighbours."""
    codes = np.frombuffer(run.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    rolled = shingle_hashes(mix(codes), CHARS)
    near = min(NEAR, most // 2)
    inf = np.full(near, np.iinfo(np.uint64).max, np.uint64)
    around = sliding_min(np.concatenate((inf, rolled, inf)), 2 * near + 1)
    cuts, at = [], 0
    for c in (np.nonzero(rolled == around)[0] + CHARS).tolist() + [len(run)] if near and len(rolled) else [len(run)]:
        while c - at > most:  # no landmark, as where all characters are equal
            cuts.append(at := at + most)
        if c - at >= max(1, near) or c == len(run):
            cuts.append(at := c)
    while cuts and cuts[-1] >= len(run):
        cuts.pop()
    edges = [0, *(c for c in cuts if not _inseparable(run[c])), len(run)]
    return [run[a:z] for a, z in zip(edges, edges[1:])]


def _apart(atom: str, most: int, tokens: TokenCounter) -> list[str]:
    """A word above the limit in parts of at most ``most`` tokens, never before a mark or a joiner if that can be."""
    parts: list[str] = []
    for p in _PIECES.findall(atom):
        # As many tokens as bytes at worst.
        for q in [p] if len(p.encode()) <= most else _pinched(p, max(1, most // 4)):
            if parts and _inseparable(q[0]) and len(parts[-1].encode()) + len(q.encode()) <= most:
                parts[-1] += q
            else:
                parts.append(q)
    return parts


def _levels(text: str, ends: np.ndarray, lengths: np.ndarray, split: np.ndarray) -> np.ndarray:
    """The kind of boundary after each atom, as an index into KINDS."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    lines, pages = np.cumsum(codes == 10), np.cumsum(np.isin(codes, _PAGES))
    at = ends - 1
    new_lines, new_pages = np.diff(lines[at], append=lines[-1]), np.diff(pages[at], append=pages[-1])
    last = codes[at]
    closed = np.isin(last, _CLOSERS) & (lengths > 1)
    last = np.where(closed, codes[np.maximum(at - 1, 0)], last)
    # "No." and the like end no sentence.
    stop = np.isin(last, _STOPS) & ((lengths > 5) | (last != ord(".")))
    level = np.where(stop, 2, 1)
    level = np.where(new_lines == 1, 3, level)
    level = np.where((new_lines > 1) | (new_pages > 0), 4, level)
    level[split] = 0
    level[-1] = 5
    return level


def cut(text: str, sizes: Sizes, tokens: TokenCounter, hashes: WordHashes) -> list[tuple[int, int, int, int, str]]:
    """(start, end, tokens, tokens of overlap, kind of the end) of each piece; one piece if the text fits."""
    atoms = atoms_of(text)
    if not atoms:
        return []
    n = tokens.each(atoms)
    if int(n.sum()) <= sizes.limit:
        return [(0, len(text), int(n.sum()), 0, "end")]
    inside: list[int] = []
    part_limit = max(8, sizes.most // 4)
    if int(n.max()) > part_limit:
        finer: list[str] = []
        for a, k in zip(atoms, n.tolist()):
            parts = _apart(a, part_limit, tokens) if k > part_limit else [a]
            inside += range(len(finer), len(finer) + len(parts) - 1)
            finer += parts
        atoms, n = finer, tokens.each(finer)
    lengths = np.fromiter(map(len, atoms), np.int64, len(atoms))
    ends = np.cumsum(lengths)
    upto = np.concatenate(([0], np.cumsum(n)))
    level = _levels(text, ends, lengths, np.array(inside, np.int64))
    rolled = shingle_hashes(hashes.of(atoms), ROLL)
    rolled = np.concatenate((np.full(len(atoms) - len(rolled), np.iinfo(np.uint64).max, np.uint64), rolled))
    out: list[tuple[int, int, int, int, str]] = []
    todo = _stretches(upto, level, rolled, sizes)[::-1]
    while todo:
        start, stop = todo.pop()
        back = start
        if out and sizes.overlap:
            back = int(np.searchsorted(upto, upto[start] - sizes.overlap))
        first = int(ends[back - 1]) if back else 0
        size = int(upto[stop] - upto[back])
        if inside:  # parts of one word may count differently together
            size = tokens.count(text[first : int(ends[stop - 1])])
            while size > sizes.limit and back < start:
                back += 1
                first = int(ends[back - 1])
                size = tokens.count(text[first : int(ends[stop - 1])])
            if size > sizes.limit and stop > start + 1:
                todo += [((start + stop) // 2, stop), (start, (start + stop) // 2)]
                continue
        out.append((first, int(ends[stop - 1]), size, int(upto[start] - upto[back]), KINDS[level[stop - 1]]))
    return out


def _stretches(upto: np.ndarray, level: np.ndarray, rolled: np.ndarray, sizes: Sizes) -> list[tuple[int, int]]:
    """Stretches of atoms of at most ``sizes.most`` tokens, divided at the least landmark again and again."""
    done, todo = [], [(0, len(level))]
    around = sizes.most // 4
    while todo:
        a, z = todo.pop()
        if upto[z] - upto[a] <= sizes.most or z - a < 2:
            done.append((a, z))
            continue
        # A cut at g ends the left side after atom g - 1.
        lo = max(a + 1, int(np.searchsorted(upto, upto[a] + sizes.least)))
        hi = min(z - 1, int(np.searchsorted(upto, upto[z] - sizes.least, "right")) - 1)
        if lo > hi:  # one long word lies across all places
            lo = hi = min(max(a + 1, hi), z - 1)
        landmark = lo + int(np.argmin(rolled[lo - 1 : hi]))
        near = slice(max(lo, int(np.searchsorted(upto, upto[landmark] - around))), min(hi, int(np.searchsorted(upto, upto[landmark] + around, "right")) - 1) + 1)
        if level[near.start - 1 : near.stop - 1].max() < 2:
            near = slice(lo, hi + 1)  # no sentence ends around it: look as far as the sizes allow
        kinds = level[near.start - 1 : near.stop - 1]
        best = near.start + np.nonzero(kinds == min(kinds.max(), 4))[0]
        g = int(best[np.argmin(np.abs(upto[best] - upto[landmark]))])
        todo += [(g, z), (a, g)]
    return done


def pieces(df: DataFrame, ident: str, text: str, sizes: Sizes = Sizes(), ranks: str = DEFAULT_RANKS, oversized_only: bool = False) -> DataFrame:
    """``ident, piece, char_start, char_end, n_tokens, overlap_tokens, ends_at, text`` for each text.

    The pieces of a text cover it completely and in order; ``char_start`` of a piece lies
    ``overlap_tokens`` before the end of the piece before it. ``ends_at`` is paragraph,
    line, sentence, word, inside (only in words above the limit) or end. Texts that fit
    are one piece, or left out with ``oversized_only``. Null, empty texts give no pieces;
    repeated rows are cut as often as they occur; other columns are dropped.
    """
    shared = df.sparkSession.sparkContext.broadcast(read_ranks(ranks))
    kind = df.schema[ident].dataType.simpleString()
    names = ["ident", "piece", "char_start", "char_end", "n_tokens", "overlap_tokens", "ends_at", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, hashes = counter(shared.value), WordHashes()
        for whole in batches:
            for lo in range(0, len(whole), 128):
                b = whole.slice(lo, 128)
                rows = []
                for i, t in enumerate(b.column(1).to_pylist()):
                    found = cut(t, sizes, tokens, hashes)
                    if len(found) > 1 or not oversized_only:
                        rows += [(i, k, *p, t[p[0] : p[1]]) for k, p in enumerate(found)]
                if rows:
                    at, *cols = zip(*rows)
                    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), *map(pa.array, cols, kinds)], names)

    rows = df.select(F.col(ident).alias("ident"), F.col(text).alias("text")).where(F.col("text").isNotNull() & (F.col("text") != ""))
    if oversized_only:  # a token has at least one byte
        rows = rows.where(F.octet_length("text") > sizes.limit)
    schema = f"ident {kind}, piece int, char_start long, char_end long, n_tokens long, overlap_tokens long, ends_at string, text string"
    return rows.mapInArrow(run, schema).withColumnRenamed("ident", ident)
