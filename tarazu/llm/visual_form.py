"""One consistent form for text that looks the same but differs in its characters.

The vocabulary holds the frequent proper spellings of the corpus, words of one script in
composed characters, in one trie per script. A token is led through a trie by a weighted
edit automaton in which replacing look-alikes and skipping ignorable signs costs nothing
and every other edit costs 1; with the cost limit 0 (the default) it is matched exactly
when it looks like a vocabulary word, and takes that word's spelling. So the corpus
decides how letters that look alike are written: of several spellings that look the
same, one Latin and one Cyrillic say, the most frequent one is canonical.

Tokens without a match are normalized by the table: encodings of one sign, widths, kinds
of blanks and hyphens and signs that draw nothing have one form each, and look-alike
letters follow the script of the token's other letters, or are Latin if there are none.
Both ways give one spelling to all tokens that look the same, so equal readings always
end in equal characters.

Letter case, raised figures, fractions, the script of figures and a joiner directly
after a virama are visible and therefore kept.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters of other scripts that look like a Latin letter (Unicode confusables).
LOOK_ALIKES = {
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p",
    "ԛ": "q", "ѕ": "s", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "А": "A", "В": "B", "С": "C", "Е": "E",
    "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X",
    "Ү": "Y", "У": "Y", "Ԛ": "Q", "Ԝ": "W", "Ԁ": "D", "Ѵ": "V",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "ο": "o", "ρ": "p", "ν": "v", "ϲ": "c", "ϳ": "j",
    "ɑ": "a", "ɡ": "g", "ɩ": "ı", "µ": "μ",
}
# Devanagari sequences drawn like one vowel letter or sign.
SEQUENCES = {
    "अाे": "ओ", "अाै": "औ", "अाॅ": "ऑ",
    "अो": "ओ", "अौ": "औ", "अॉ": "ऑ", "अा": "आ",
    "आे": "ओ", "आै": "औ", "आॅ": "ऑ", "अॅ": "ॲ",
    "एे": "ऐ", "एॅ": "ऍ", "र्इ": "ई",
    "ाे": "ो", "ाै": "ौ", "ाॅ": "ॉ",
}
HYPHENS = "‐‑﹣－"
VIRAMA, JOINERS = "्", "‌‍"


def _is_blank(ch: str) -> bool:
    return ch in "\t\n\v\f\r\x1c\x1d\x1e\x1f\x85  " or unicodedata.category(ch) == "Zs"


def _is_ignorable(ch: str) -> bool:
    c = ord(ch)
    return (
        unicodedata.category(ch) == "Cf" and not 0x600 <= c <= 0x605 and c not in (0x6DD, 0x70F, 0x8E2, 0x110BD, 0x110CD)
    ) or c in (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0) or 0x180B <= c <= 0x180F or 0xFE00 <= c <= 0xFE0F or 0xE0100 <= c <= 0xE01EF


@cache
def char_form(ch: str) -> str:
    """The look of one character, as the canonical characters that stand for it."""
    if _is_blank(ch):
        return " "
    if _is_ignorable(ch):
        return ""
    if ch in HYPHENS:
        return "-"
    if ch in LOOK_ALIKES:
        return LOOK_ALIKES[ch]
    parts = unicodedata.decomposition(ch).split()
    if not parts:
        return ch
    kind = parts.pop(0) if parts[0].startswith("<") else ""
    whole = "".join(chr(int(x, 16)) for x in parts)
    same = kind in ("", "<wide>", "<narrow>", "<isolated>", "<initial>", "<medial>", "<final>", "<noBreak>") or (
        kind == "<compat>" and (0xFB00 <= ord(ch) <= 0xFB06 or 0x2160 <= ord(ch) <= 0x217F or 0x2024 <= ord(ch) <= 0x2026)
    )
    return "".join(map(char_form, whole)) if same else ch


def look(token: str) -> str:
    """What a reader sees: the same characters for all tokens that look the same, look-alikes as Latin letters.

    Idempotent. The empty token stays empty, blanks inside become single spaces,
    joiners stay only directly after a virama.
    """
    if token.isascii() and token.isalnum():
        return token
    out: list[str] = []
    last = ""
    for ch in token:
        out.append(ch if ch in JOINERS and last == VIRAMA else char_form(ch))
        last = ch
    form = unicodedata.normalize("NFC", "".join(out))
    form = "".join(ch if ch in JOINERS else char_form(ch) for ch in form)
    before = ""
    while before != form and ("अ" in form or "आ" in form or "ए" in form or "ा" in form or "इ" in form):
        before = form
        for a, b in SEQUENCES.items():
            if a in form:
                form = form.replace(a, b)
    return unicodedata.normalize("NFC", form) if not form.isascii() else form


#: Script -> Latin letter -> the letter of the script that looks like it.
COUNTERPARTS = {
    "cyrl": {b: a for a, b in LOOK_ALIKES.items() if "\u0400" <= a <= "\u052f"},
    "grek": {b: a for a, b in LOOK_ALIKES.items() if "\u0370" <= a <= "\u03ff"},
}
_AMBIGUOUS = frozenset(x for table in COUNTERPARTS.values() for x in table)


def _letter_script(ch: str) -> str:
    """The script of a letter that looks like no letter of another script; "" for all other signs."""
    if ch in _AMBIGUOUS or not ch.isalpha():
        return ""
    return "latn" if ch < "\u0250" else "grek" if "\u0370" <= ch <= "\u03ff" or "\u1f00" <= ch <= "\u1fff" else "cyrl" if "\u0400" <= ch <= "\u052f" else ""


def _written(parts: str, script: str) -> str:
    table = COUNTERPARTS[script]
    return unicodedata.normalize("NFC", "".join(table.get(ch, ch) for ch in parts))


def spellings(seen: str) -> tuple[str, ...]:
    """The proper spellings of a look, the table's choice first.

    A look with letters that belong to one script only is written in that script; one
    without such letters may be written in any script that has all of its letters.
    """
    if seen.isascii() and not any(ch in _AMBIGUOUS for ch in seen):
        return (seen,)
    parts = unicodedata.normalize("NFD", seen)
    scripts = {x for x in map(_letter_script, parts) if x}
    if len(scripts) > 1 or scripts == {"latn"}:
        return (seen,)
    if scripts:
        return (_written(parts, *scripts),)
    letters = [ch for ch in parts if ch in _AMBIGUOUS]
    return (seen, *(_written(parts, k) for k, table in COUNTERPARTS.items() if letters and all(ch in table for ch in letters)))


def table_form(token: str) -> str:
    """The canonical characters of a token by the table alone. Idempotent."""
    return spellings(look(token))[0]


def is_proper(token: str) -> bool:
    """Written in composed characters of one script, without signs that draw nothing."""
    return token in spellings(look(token))


class VocabularyTries:
    """One trie per script over the vocabulary, searched by a weighted edit automaton.

    The edges are looks, so that all spellings of a word end in one node. It keeps the
    first of them: ``words`` come by falling frequency.
    """

    def __init__(self, words: Iterable[str], max_cost: int = 0):
        self.max_cost = max_cost
        self.roots: dict[str, dict] = {}
        self.canonical: set[str] = set()
        for w in words:
            seen = look(w)
            node = self.roots.setdefault(self._script(w), {})
            for ch in seen:
                node = node.setdefault(ch, {})
            if node.setdefault("", w) == w:
                self.canonical.add(w)
        # Sequences are matched as edges that consume several characters at no cost.
        self.starts: dict[str, list[tuple[str, str]]] = {}
        for a, b in SEQUENCES.items():
            self.starts.setdefault(a[0], []).append((a, b))

    @staticmethod
    def _script(word: str) -> str:
        for ch in word:
            form = unicodedata.normalize("NFD", char_form(ch))
            if form and form != " ":
                return "deva" if "ऀ" <= form[0] <= "ॿ" else "latn" if form[0].isascii() and form[0].isalpha() else "other"
        return "other"

    def _moves(self, token: str, i: int) -> list[tuple[str, int]]:
        """(characters to find on the trie's edges, characters consumed), all at no cost."""
        ch = token[i]
        if ch in JOINERS:
            return [(ch, 1)]
        form = char_form(ch)
        # A sign as it stands, composed, and in parts.
        moves = [(x, 1) for x in dict.fromkeys((form, unicodedata.normalize("NFC", form), unicodedata.normalize("NFD", form)))]
        for a, b in self.starts.get(ch, ()):
            if token.startswith(a, i):
                moves.append((b, len(a)))
        j = i + 1  # a letter and the marks that follow it, composed
        while j < len(token) and unicodedata.combining(token[j]):
            j += 1
            moves.append((unicodedata.normalize("NFC", "".join(map(char_form, token[i:j]))), j - i))
        return moves

    def match(self, token: str) -> str | None:
        """The nearest vocabulary word within the cost limit; ties go to the smaller word."""
        root = self.roots.get(self._script(token))
        if root is None:
            return None
        # Signs that draw nothing are skipped wherever they stand, also inside a sequence.
        token = "".join(ch for i, ch in enumerate(token) if char_form(ch) or (ch in JOINERS and i and token[i - 1] == VIRAMA))
        best: tuple[int, str] | None = None
        todo = [(0, root, 0)]
        seen: dict[tuple[int, int], int] = {}
        while todo:
            i, node, cost = todo.pop()
            key = (i, id(node))
            if seen.get(key, self.max_cost + 1) <= cost:
                continue
            seen[key] = cost
            if i == len(token):
                if "" in node and (best is None or (cost, node[""]) < best):
                    best = (cost, node[""])
            else:
                for edges, used in self._moves(token, i):
                    at = node
                    for ch in edges:
                        at = at.get(ch)
                        if at is None:
                            break
                    if at is not None:
                        todo.append((i + used, at, cost))
            if cost < self.max_cost:
                nexts = [n for ch, n in node.items() if ch]
                todo += [(i, n, cost + 1) for n in nexts]
                if i < len(token):
                    todo += [(i + 1, node, cost + 1), *((i + 1, n, cost + 1) for n in nexts)]
        return best[1] if best else None


class Canonicalizer:
    """Text -> canonical text, with the tokens met so far remembered."""

    REMEMBER = 300_000

    def __init__(self, words: Iterable[str], max_cost: int = 0):
        self.tries = VocabularyTries(words, max_cost)
        self.known: dict[str, str] = {}

    def token(self, token: str) -> str:
        got = self.known.get(token)
        if got is None:
            got = token if token in self.tries.canonical else self.tries.match(token)
            if got is None:
                got = table_form(token)
            if len(self.known) >= self.REMEMBER:
                self.known.clear()
            self.known[token] = got
        return got

    def text(self, text: str) -> str:
        """Blank runs become one space, none at the ends; tokens that draw nothing vanish."""
        return " ".join(x for x in map(self.token, text.translate(_BLANKS).split()) if x)


_BLANKS = {c: " " for c in (*range(9, 14), *range(0x1C, 0x20), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)}
BLANK_CLASS = "[\\u0009-\\u000d\\u001c-\\u0020\\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+"


def vocabulary(df: DataFrame, columns: list[str], size: int, min_count: int = 2) -> list[str]:
    """The ``size`` most frequent tokens that are proper spellings, by falling frequency.

    Counts run over all rows; only the ``size`` winners reach the driver, which bounds
    what is sent to the executors. Tokens outside are normalized by the table.
    """

    @F.pandas_udf(T.BooleanType())
    def proper(tokens: pd.Series) -> pd.Series:
        return tokens.map(is_proper)

    texts = df.select(F.explode(F.array(*(F.col(f"`{c}`").cast("string") for c in columns))).alias("t")).where(F.col("t").isNotNull())
    tokens = texts.select(F.explode(F.split("t", BLANK_CLASS)).alias("token")).where(F.length("token").between(2, 64))
    counts = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)
    # Not deterministic, so that it is not pushed below the count and asked for every occurrence.
    top = counts.where(proper.asNondeterministic()("token")).orderBy(F.desc("n"), "token").limit(size)
    return [r[0] for r in top.select("token").collect()]


def visual_form(df: DataFrame, columns: list[str], vocabulary_size: int = 50_000, max_cost: int = 0, suffix: str = "_form") -> DataFrame:
    """Add the canonical form of each text column under the name ``<column><suffix>``.

    Null stays null, the empty text and a text of blanks become empty. All rows and
    columns are kept, repeated rows too; a result column that exists already is
    replaced. Texts are not shuffled: one job counts tokens, then each row is mapped.
    Of equally frequent spellings that look the same the smaller one is canonical.
    """
    words = vocabulary(df, columns, vocabulary_size)
    shared = df.sparkSession.sparkContext.broadcast((words, max_cost))

    @F.pandas_udf(T.StringType())
    def form(texts: pd.Series) -> pd.Series:
        made = _canonicalizer(shared)
        return texts.map(made.text, na_action="ignore")

    return df.withColumns({f"{c}{suffix}": form(F.col(f"`{c}`").cast("string")) for c in columns})


_made: list = []


def _canonicalizer(shared) -> Canonicalizer:
    """One per Python worker: the tries are built once, not for each batch."""
    value = shared.value
    if not _made or _made[0] is not value:
        _made[:] = [value, Canonicalizer(*value)]
    return _made[1]


def forms(texts: Iterator[str], words: Iterable[str] = ()) -> list[str]:
    """Canonical forms on the driver, for tests and small lists."""
    made = Canonicalizer(words)
    return [made.text(t) for t in texts]
