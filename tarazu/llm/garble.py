"""Texts read under a wrong character table: find them and restore what can be restored.

Every candidate decoding of a stretch of text is compressed with one zstandard
dictionary per language; the description length is the compressed size plus the cost
of the chain of decodings, and the shortest description wins. If that is the text as
it stands, the text stays unchanged.

* Encodings: UTF-8 bytes read as one of several 8-bit tables, once or repeatedly, in
  whole or in stretches, and UTF-16 with swapped bytes. A chain undoes one step after
  the other; a step exists only where the signs are valid UTF-8 under its table, so
  sound text has no candidate.
* Glyph codes: a font family's codes taken for characters. Families with rules are
  converted and described in the languages; families that are known only by example
  (and have no rules) are described by a dictionary of their own codes, which can win
  as a description but restores nothing.
* What was lost on the way (replacement and control characters) is reported, too.

The dictionaries are trained on samples whose sizes are the parameters of ``Trainer``:
passages of so many texts a language and a family, chosen by a hash of the identifier. No
language or family is left out for its number. Everything else looks at whole texts and
all rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import groupby

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarazu.session import cut

LEVEL = 3
#: Bytes a step of a chain costs, and bytes by which glyph codes must win over the text as it stands.
STEP_COST, MARGIN = 1, 1
#: A family's conversion names its family and table; glyph dictionaries win only with a clear lead.
FAMILY_COST, UNKNOWN_COST = 4, 6
#: A text that was misread and holds glyph codes besides is rare.
BOTH_COST = 10
#: Bytes per 100 characters up to which a description counts as short.
SHORT = 58
CHUNK = 6  # words looked at together where a stretch is not of one kind
FEW = 3  # words looked at together for where a run of codes begins and ends
LOST = re.compile("[�\x80-\x84\x86-\x9f]")
DEVA, LETTER = re.compile("[ऀ-ॿ]"), re.compile("[^\\W\\d_]|[ऀ-ॿ]")

#: Any step shows each byte above 127 as a sign of its own, so at least two stand together.
PAIR = re.compile("[^\\x00-\\x7f\u0900-\u097f]{2}")
#: Each costs a byte more in a language's description, for leaving its script.
FOREIGN_SIGNS = re.compile("[^\\x00-\\x7f\u0900-\u097f]+")
FOREIGN = re.compile("[^\\x00-\\x7f\u0900-\u097f]{2,}")

TABLES = ("cp1252", "mac_roman", "cp437", "koi8_r", "cp850", "cp1251")


def _signs(table: str) -> dict[int, str]:
    """Byte -> characters that show it under the table, as a regular expression class body."""
    out: dict[int, str] = {}
    for b in range(0x80, 0x100):
        try:
            ch = bytes([b]).decode(table)
        except UnicodeDecodeError:
            ch = ""
        # The 1252 family is often read leniently: unassigned bytes stay as C1 controls.
        both = ch + chr(b) if table == "cp1252" and b < 0xA0 else ch
        out[b] = both
    return out


def _plausible() -> frozenset[str]:
    """Signs a step may lead to: Devanagari, Latin and Greek, general signs, and what the tables themselves show."""
    blocks = ((0xA0, 0x180), (0x391, 0x3CA), (0x900, 0x980), (0x2000, 0x2070), (0x20A0, 0x20C0), (0x2100, 0x2150), (0x2190, 0x2300))
    shown = "".join(s for t in TABLES for s in _signs(t).values())
    return frozenset(shown) | frozenset(chr(c) for lo, hi in blocks for c in range(lo, hi)) | {"\ufeff", "\ufb01", "\ufb02"}


class Table:
    """Undoes one reading of UTF-8 bytes under an 8-bit table."""

    def __init__(self, name: str):
        self.name = name
        signs = _signs(name)
        self.byte = {ord(ch): b for b, s in signs.items() for ch in s}
        cls = lambda lo, hi: "[" + "".join(re.escape(ch) for b in range(lo, hi) for ch in signs[b]) + "]"
        more = cls(0x80, 0xC0)
        self.found = re.compile(f"{cls(0xC2, 0xE0)}{more}|{cls(0xE0, 0xF0)}{more}{more}|{cls(0xF0, 0xF5)}{more}{more}{more}")
        self.to_bytes = {c: chr(b) for c, b in self.byte.items()}
        self.leads = frozenset("".join(signs[b] for b in range(0xC2, 0xF5)))

    def undo(self, text: str, runs: list[tuple[int, int]]) -> str:
        """Undo the reading in every run of foreign signs of which at least half was read so."""
        if self.leads.isdisjoint(text):
            return text
        likely, k, a, z, matched = [], -1, 0, 0, 0
        for at, end in map(re.Match.span, self.found.finditer(text)):  # every match lies inside a run
            if at >= z:
                if matched * 2 >= z - a and k >= 0:
                    likely.append((a, z))
                k += 1
                while runs[k][1] <= at:
                    k += 1
                (a, z), matched = runs[k], 0
            matched += end - at
        if k >= 0 and matched * 2 >= z - a:
            likely.append((a, z))
        out, done = [], 0
        for a, z in likely:
            parts, at, undone = [], a, 0
            for f in self.found.finditer(text, a, z):
                try:
                    got = f[0].translate(self.to_bytes).encode("latin-1").decode("utf-8")
                except UnicodeDecodeError:
                    continue
                if got in PLAUSIBLE:
                    parts += (text[at : f.start()], got)
                    at = f.end()
                    undone += len(f[0])
            if undone * 2 >= z - a:
                out += (text[done:a], *parts, text[at:z])
                done = z
        return "".join(out) + text[done:] if out else text


class SwappedPairs:
    """Undoes UTF-16 read with swapped bytes, for Devanagari and for Latin letters, figures and signs."""

    name = "utf_16_swapped"
    found = re.compile("[" + "".join(re.escape(chr(b << 8 | 9)) for b in range(1, 0x80)) + "".join(re.escape(chr(b << 8)) for b in (*range(0x20, 0x7F), *range(0xA0, 0x100)) if not 0xD8 <= b <= 0xDF) + "]{2,}")

    def undo(self, text: str, runs: list[tuple[int, int]]) -> str:
        return self.found.sub(lambda m: "".join(chr((ord(c) & 255) << 8 | ord(c) >> 8) for c in m[0]), text)


PLAUSIBLE = _plausible()


def _pairs(text: str) -> int:
    return sum(map(len, FOREIGN.findall(text)))


class _Cover(dict):
    """Which families have the signs of a text: a sign that is no code of a family speaks against it.

    Each sign maps to a number with a lane of 32 bits a family, so that one sum counts for all.
    """

    def __init__(self, signs: list[frozenset[str]]):
        super().__init__()
        self.signs = signs

    def __missing__(self, ch: str) -> int:
        self[ch] = n = sum(1 << 32 * i for i, s in enumerate(self.signs) if ch in s)
        return n

    def of(self, text: str) -> list[int]:
        """The families that have four fifths of the text's signs."""
        shown = text.replace(" ", "")
        counts, need = sum(map(self.__getitem__, shown)), 8 * len(shown)
        return [i for i in range(len(self.signs)) if (counts >> 32 * i & 0xFFFFFFFF) * 10 >= need]


def _has_deva(word: str) -> bool:
    return DEVA.search(word) is not None


def decoders() -> list:
    return [*map(Table, TABLES), SwappedPairs()]


class Family:
    """Glyph codes -> characters. No source begins with another, so the parse is unique."""

    def __init__(self, name: str, rules: dict[str, str]):
        self.name, self.rules = name, rules
        long = sorted(s for s in rules if len(s) > 1)
        self.long = re.compile("|".join(map(re.escape, long))) if long else None
        self.single = {ord(s): t for s, t in rules.items() if len(s) == 1}
        self.signs = frozenset("".join(rules))

    def convert(self, text: str) -> str:
        if self.long:
            text = self.long.sub(lambda m: self.rules[m[0]], text)
        return text.translate(self.single)


@dataclass
class Model:
    """What is sent to the executors: a few dictionaries of bounded size, the rules, the family names."""

    languages: dict[str, bytes]
    devanagari: frozenset[str] = frozenset()  # languages written in it; all others describe texts without it
    families: dict[str, dict[str, str]] = field(default_factory=dict)
    glyphs: dict[str, bytes] = field(default_factory=dict)
    glyph_signs: dict[str, str] = field(default_factory=dict)


class Describer:
    """Description lengths under the dictionaries of a model, and the choice among readings."""

    def __init__(self, model: Model):
        def ready(raw: bytes) -> zstandard.ZstdCompressor:
            d = zstandard.ZstdCompressionDict(raw)
            d.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)

        self.languages = {k: ready(v) for k, v in sorted(model.languages.items())}
        every = list(self.languages.values())
        latin = [c for k, c in self.languages.items() if k not in model.devanagari]
        self.by_script = {True: [c for k, c in self.languages.items() if k in model.devanagari] or every, False: latin or every}
        self.families = [Family(k, v) for k, v in sorted(model.families.items())]
        self.glyphs = [(k, ready(v)) for k, v in sorted(model.glyphs.items())]
        self.cover = _Cover([f.signs for f in self.families] + [frozenset(model.glyph_signs[k]) for k, _ in self.glyphs])
        self.decoders = decoders()
        self.frame = min(len(c.compress(b"")) for c in every)
        self.seen: dict[str, tuple[int, dict[str, int]]] = {}

    def length(self, text: str) -> int:
        """The shortest description of a text as sound text of some language, in bytes."""
        if text.isascii():
            raw = text.encode()
            return min([len(c.compress(raw)) for c in self.by_script[False]])
        raw = text.encode("utf-8", "surrogatepass")
        least = min([len(c.compress(raw)) for c in self.by_script[DEVA.search(text) is not None]])
        return least + len("".join(FOREIGN_SIGNS.findall(text)))

    def unexplained(self, text: str) -> bool:
        """Neither sound nor restorable: no reading is short for the length of the text."""
        most = 0.6 * len(text)
        return all(self.described(got)[0] > most for got, _ in self.readings(text))

    # Encodings

    def chains(self, text: str) -> Iterator[tuple[str, tuple[str, ...]]]:
        """All readings of the text after undoing one or more steps."""
        todo, seen = [(text, ())], {text}
        while todo:
            at, chain = todo.pop(0)
            if not PAIR.search(at):
                continue
            runs = [m.span() for m in FOREIGN.finditer(at)]
            for d in self.decoders:
                # Only runs that were read so throughout are undone: glyph codes happen to look like UTF-8 here and there.
                got = d.undo(at, runs)
                if got not in seen:
                    seen.add(got)
                    todo.append((got, (*chain, d.name)))
                    yield got, (*chain, d.name)

    def readings(self, text: str) -> list[tuple[str, tuple[str, ...]]]:
        """The text as it stands and every reading after undoing one or more steps."""
        return [(text, ()), *self.chains(text)]

    # Glyph codes

    def reading(self, stretch: str) -> tuple[int, str, str]:
        """(description length, restored stretch or "", family or "" for sound text) of the best reading."""
        now = self.length(stretch)
        best = (now, stretch, "")
        if len(stretch) < 8 or now <= 8 + len(stretch) // 8:  # too little to tell, or shorter than any conversion can be
            return best
        raw = stretch.encode("utf-8", "surrogatepass")
        for i in self.cover.of(stretch):
            if i < len(self.families):
                f = self.families[i]
                got = f.convert(stretch)
                if DEVA.search(got):
                    best = min(best, (self.length(got) + FAMILY_COST, got, f.name), key=lambda x: x[0])
            else:
                name, c = self.glyphs[i - len(self.families)]
                best = min(best, (len(c.compress(raw)) + UNKNOWN_COST, "", name), key=lambda x: x[0])
        return (best[0], "", UNKNOWN) if not best[2] and now > len(stretch) and _symbols_for_letters(stretch) else best

    def described(self, text: str, compared: bool = True) -> tuple[int, str, tuple[str, ...], bool]:
        """(description length, text with glyph codes restored, families met, whether all was restored).

        The length is needed, and complete, only where several readings are compared.
        """
        met: list[str] = []
        whole, total = True, 0
        out: list[str] = []
        for deva, words in groupby(text.split(" "), _has_deva):
            words = list(words)
            if deva:
                out += words
                if compared:
                    total += self.length(" ".join(words))
                continue
            for n, got, family, part in self._even(words):
                total += n
                if family:
                    met.append(family)
                    whole &= got != ""
                out.append(got or part)
        return total, " ".join(out), tuple(dict.fromkeys(met)), whole

    def _even(self, words: list[str]) -> list[tuple[int, str, str, str]]:
        """Readings of the stretch as one, of chunks of a few words, or of runs of codes and what lies between them.

        Chunks are tried where no reading of the whole is short for its length; runs of
        codes everywhere, since a long sound stretch hides them in its average.
        """
        one = " ".join(words)
        n, got, family = self.reading(one)
        whole = [(n, got, family, one)]
        if len(words) > CHUNK and n * 100 > SHORT * len(one):
            parts = [words[k : k + CHUNK] for k in range(0, len(words), CHUNK)]
            if len(parts[-1]) < CHUNK // 2:
                parts[-2:] = [parts[-2] + parts[-1]]
            split = [(*self.reading(p), p) for p in map(" ".join, parts)]
            if n > sum(x[0] for x in split):
                return split
        return whole if family else self._apart(words, n) or whole

    def _by_family(self, part: str) -> dict[str, int]:
        """Description lengths by the families that have the part's signs."""
        out: dict[str, int] = {}
        for i in self.cover.of(part):
            if i >= len(self.families):
                name, c = self.glyphs[i - len(self.families)]
                out[name] = len(c.compress(part.encode("utf-8", "surrogatepass")))
            elif DEVA.search(to := self.families[i].convert(part)):
                out[self.families[i].name] = self.length(to)
        return out

    def _word(self, part: str) -> tuple[int, dict[str, int]]:
        """Description length of a word or a few as they stand, and those by the families that have their signs.

        Several words that are described shortly as they stand are no codes.
        """
        got = self.seen.get(part)
        if got is None:
            now = self.length(part)
            plain = not part or (" " in part and (now - self.frame) * 100 <= SHORT * len(part))
            if len(self.seen) >= 200_000:
                self.seen.clear()
            got = self.seen[part] = now, {} if plain else self._by_family(part)
        return got

    def _runs(self, words: list[str]) -> list[tuple[int, int]]:
        """Runs of words that one family describes better, by the cheapest sequence of sound text and families."""
        costs = [self._word(w) for w in words]
        # Words of ASCII codes say too little alone; a few together do.
        for i in range(len(words) - FEW + 1):
            part = " ".join(words[i : i + FEW])
            now, by = self._word(part)
            if by:
                for k, n in by.items():
                    if n < now:
                        for j in range(i, i + FEW):
                            alone, by = costs[j]
                            costs[j] = alone, by | {k: min(by.get(k, 1 << 30), alone - (now - n) / FEW)}
        if not any(n < now for now, by in costs for n in by.values()):
            return []
        paths: dict[str, float] = {"": 0}
        back: list[dict[str, str]] = []
        for now, by in costs:
            least = min(paths, key=lambda k: (paths[k], k))
            step, came = {}, {}
            for state, n in (("", now), *by.items()):
                switch = paths[least] + (FAMILY_COST if state else 0)
                stay = paths.get(state, 1 << 30)
                step[state], came[state] = (stay + n, state) if stay <= switch else (switch + n, least)
            paths = step
            back.append(came)
        state = min(paths, key=lambda k: (paths[k], k))
        out: list[tuple[int, int]] = []
        end = len(words)
        for i in range(len(words) - 1, -1, -1):
            before = back[i][state]
            if before != state or i == 0:
                if state:
                    out.append((i, end))
                end = i
            state = before
        return out[::-1]

    def _between(self, words: list[str], at: int, lo: int, hi: int) -> tuple:
        """(description length, lo, hi, reading of the run, lengths before and after) with a run of codes set apart; all pieces stand in one frame."""
        read = self.reading(" ".join(words[lo:hi]))
        a, b = (self.length(" ".join(x)) if x else 0 for x in (words[at:lo], words[hi:]))
        n = a + read[0] + b - self.frame * ((lo > at) + (hi < len(words)))
        return n if read[2] else 1 << 30, lo, hi, read, a, b

    def _apart(self, words: list[str], n: int) -> list[tuple[int, str, str, str]]:
        """The stretch divided at the runs of codes that make its description shorter; empty if none does."""
        out: list[tuple[int, str, str, str]] = []
        at, rest = 0, n  # what follows the last run taken, and its description
        for lo, hi in self._runs(words):
            if hi <= at:
                continue
            best = self._between(words, at, max(lo, at), hi)
            while True:  # the ends may lie a few words further in or out
                lo, hi = best[1:3]
                ends = [(lo + k, hi) for k in range(-FEW, FEW + 1)] + [(lo, hi + k) for k in range(-FEW, FEW + 1)]
                tried = min((self._between(words, at, x, y) for x, y in ends if at <= x < y <= len(words)), key=lambda t: t[0])
                if tried[0] >= best[0]:
                    break
                best = tried
            total, lo, hi, read, a, b = best
            if read[2] and total + MARGIN < rest:
                left = " ".join(words[at:lo])
                out += [(a, left, "", left)] * (lo > at) + [(*read, " ".join(words[lo:hi]))]
                at, rest = hi, b
        if out and at < len(words):
            tail = " ".join(words[at:])
            out.append((rest, tail, "", tail))
        return [(x[0] - self.frame * (i > 0), *x[1:]) for i, x in enumerate(out)]

    def _lost(self, text: str) -> bool:
        """Whether the text is described better without the signs that stand for what was lost."""
        return self.described(LOST.sub("", text))[0] + STEP_COST < self.described(text)[0]

    def examine(self, text: str) -> tuple[str, str, str | None] | None:
        """(kind, chain, restored or None) for an affected text, None for a sound one."""
        if PAIR.search(text) is None and not _OUTSIDE.search(text):
            return None  # Devanagari throughout: nothing that could be decoded or converted
        readings = self.readings(text)
        best = None
        for got, chain in readings:
            reading = got
            n, got, families, whole = self.described(reading, len(readings) > 1)
            n += STEP_COST * len(chain) + BOTH_COST * bool(chain and families) + MARGIN * bool(families)
            if best is None or n < best[0]:
                best = (n, got, chain, families, whole, reading)
        _, got, chain, families, whole, reading = best
        lost = LOST.search(got) is not None
        if not chain and not families and not (lost and self._lost(reading)):
            return None
        kind = "lost" if lost else "encoding" if not families else "glyph codes"
        return kind, " ".join((*chain, *families)), got if whole and not lost and got != text else None


UNKNOWN = "unknown"


def _symbols_for_letters(stretch: str) -> bool:
    """Words made of Latin letters and of signs that no language writes inside words: codes of a family never met."""
    signs = [ch for ch in stretch if ch > "\x7f" and not ch.isspace()]
    if len(signs) < 16 or len(signs) * 2 < len(stretch.replace(" ", "")) or any(ch > "\u2fff" for ch in signs):
        return False
    odd = sum(unicodedata.category(ch) in ("Sc", "Sk", "So", "Sm", "No", "Pi", "Pf", "Lo") and ch < "\u0250" or "\u2010" <= ch < "\u2150" for ch in signs)
    return odd * 5 >= len(signs)


#: A word of glyph codes or of another script beside Devanagari.
_OUTSIDE = re.compile("[A-Za-z\x80-\u08ff\u0980-\uffff]|[!-/:-@\\[-`{-~]{3}")


@dataclass
class Trainer:
    """Bounds of what the dictionaries are trained on."""

    texts_a_language: int = 3000
    texts_of_all_languages: int = 60_000
    least_texts: int = 8  # of a language
    text_chars: int = 600  # of a passage
    examples_a_family: int = 1500
    dictionary_bytes: int = 96 * 1024
    bytes_of_all_families: int = 64 << 20
    least_examples: int = 12
    undetermined: tuple[str, ...] = ("", "und")

    def dictionary(self, texts: Iterable[str], most: int | None = None) -> bytes:
        most = most or self.dictionary_bytes
        samples = [t[: self.text_chars].encode("utf-8", "surrogatepass") for t in texts if t]
        if sum(map(len, samples)) < 8 * 1024:
            samples = samples or [b" "]
        try:
            return zstandard.train_dictionary(most, samples, level=LEVEL, k=64, d=8).as_bytes()
        except zstandard.ZstdError:  # too little to train on: the texts themselves
            return b"".join(samples)[-most:]

    def languages(self, sound: dict[str, list[str]], rules: dict[str, dict[str, str]], more: Iterable[str] = ()) -> Model:
        """``sound``: texts by language; ``more``: unlabelled texts.

        Of the unlabelled texts those are added to a language that have no candidate
        decoding and are described well by it, so that its dictionary knows the signs
        and names that the labelled texts lack. Labelled texts that have a candidate
        decoding are left out, so that no dictionary knows misread names.
        """
        deva = frozenset(k for k, v in sound.items() if 2 * sum(len(DEVA.findall(t)) for t in v) > sum(len(LETTER.findall(t)) for t in v))
        base = Model({k: self.dictionary(v) for k, v in sound.items() if v} or {"en": b" "}, deva, dict(rules))
        look = Describer(base)
        doubtful = lambda t: LOST.search(t) is not None or next(look.chains(t), None) is not None
        added = {k: [t for t in v if not doubtful(t)] or list(v) for k, v in sound.items()}
        for t in more:
            if doubtful(t) or look.length(t) * 100 > 60 * len(t):
                continue
            raw = t.encode("utf-8", "surrogatepass")
            best = min(look.languages, key=lambda k: (len(look.languages[k].compress(raw)), k))
            added.setdefault(best, []).append(t)
        # The texts at hand come last: short distances are cheaper.
        return Model({k: self.dictionary(v) for k, v in added.items() if v} or base.languages, deva, dict(rules))

    def family(self, look: Describer, texts: list[str], most: int | None = None) -> tuple[bytes, str] | None:
        """(dictionary, signs) of a family without rules, from texts that may carry its name wrongly; None for too few."""
        odd = [t for t in texts if t and len(DEVA.findall(t)) * 20 <= len(t) and not LOST.search(t) and look.unexplained(t)]
        if len(odd) < self.least_examples:
            return None
        seen = Counter("".join(odd))
        return self.dictionary(odd, most), "".join(sorted(ch for ch, n in seen.items() if n * 1000 >= seen.total() and ch != " "))

    def model(self, sound: dict[str, list[str]], rules: dict[str, dict[str, str]], examples: dict[str, list[str]], more: Iterable[str] = ()) -> Model:
        """Both on the driver, for tests and small lists; ``examples``: texts by family label."""
        made = self.languages(sound, rules, more)
        look = Describer(made)
        found = {name: got for name, texts in examples.items() if name not in rules and (got := self.family(look, texts))}
        return Model(made.languages, made.devanagari, dict(rules), {k: v[0] for k, v in found.items()}, {k: v[1] for k, v in found.items()})


def _passage(ident: Column, text: Column, chars: int) -> Column:
    """A passage of the text at a place that the identifier decides; the whole text if it is short."""
    room = F.greatest(F.length(text) - chars + 1, F.lit(1))
    return F.substring(text, (F.pmod(F.xxhash64(ident), room) + 1).cast("int"), F.lit(chars))


def _sampled(df: DataFrame, most: int, sizes: DataFrame) -> DataFrame:
    """About ``most`` rows of each ``group``, the same on every run: a hash of ``ident`` decides."""
    share = F.least(F.lit(1 << 20), F.floor(F.lit(most << 20) / F.col("n")) + 1)
    return df.join(sizes, "group").where(F.pmod(F.xxhash64("ident"), F.lit(1 << 20)) < share).drop("n")


def train(
    labelled: DataFrame, unlabelled: DataFrame, rules: DataFrame, examples: DataFrame, trainer: Trainer | None = None
) -> Model:
    """Fit the dictionaries on bounded samples.

    ``labelled``: ident, lang, text (sound); ``unlabelled``: ident, text; ``rules``:
    family_id, source, target; ``examples``: ident, family_id, text (labels may be wrong).
    Languages are trained on the driver, families each in a task of their own.
    """
    t = trainer or Trainer()
    spark = labelled.sparkSession

    def rows(df: DataFrame, group: Column) -> DataFrame:
        ident = F.col("ident").cast("string")
        full = df.where(F.col("text").isNotNull() & (F.col("text") != "") & group.isNotNull() & F.col("ident").isNotNull())
        return full.select(ident.alias("ident"), group.alias("group"), _passage(ident, F.col("text"), t.text_chars).alias("text"))

    def sizes(df: DataFrame) -> DataFrame:
        return df.groupBy("group").agg(F.count(F.lit(1)).alias("n"))

    def texts(df: DataFrame, most: int, n: DataFrame, groups: int) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for g, _, x in sorted(tuple(r) for r in _sampled(df, most, n).select("group", "ident", "text").limit(2 * most * max(1, groups)).collect()):
            out.setdefault(g, []).append(x)
        return {g: xs[:most] for g, xs in sorted(out.items())}

    spoken = rows(labelled.where(~F.coalesce(F.lower(F.trim("lang")), F.lit("")).isin(*t.undetermined)), F.col("lang"))
    n_spoken = cut(sizes(spoken).where(F.col("n") >= t.least_texts))
    languages = n_spoken.count()
    a_language = min(t.texts_a_language, t.texts_of_all_languages // max(1, languages))
    sound = texts(spoken, a_language, n_spoken, languages)
    any_text = rows(unlabelled, F.lit("all"))
    more = texts(any_text, t.texts_a_language, sizes(any_text), 1).get("all", [])
    table: dict[str, dict[str, str]] = {}
    for family, source, target in rules.where("family_id IS NOT NULL AND source IS NOT NULL AND source != ''").select("family_id", "source", F.coalesce("target", F.lit(""))).distinct().limit(MOST_RULES + 1).collect():
        table.setdefault(family, {})[source] = target
    if sum(map(len, table.values())) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    made = t.languages(sound, table, more)
    shown = rows(examples, F.col("family_id"))
    n_shown = cut(sizes(shown))
    most = max(2048, min(t.dictionary_bytes, t.bytes_of_all_families // max(1, n_shown.count())))
    shared = spark.sparkContext.broadcast(made)

    def family(pdf: pd.DataFrame) -> pd.DataFrame:
        name = pdf["group"].iloc[0]
        got = None if name in shared.value.families else t.family(_describer(shared.value), pdf.sort_values(["ident", "text"])["text"].tolist(), most)
        return pd.DataFrame([(name, *got)] if got else [], columns=["name", "dictionary", "signs"])

    found = sorted(_sampled(shown, t.examples_a_family, n_shown).groupBy("group").applyInPandas(family, "name string, dictionary binary, signs string").collect())
    return Model(made.languages, made.devanagari, table, {k: bytes(d) for k, d, _ in found}, {k: x for k, _, x in found})


MOST_RULES = 200_000


def garbled(df: DataFrame, key: list[str], text: str, model: Model) -> DataFrame:
    """The affected rows: ``key..., kind, chain, restored``.

    ``kind`` is "encoding", "glyph codes" or "lost"; ``chain`` names the steps undone and
    the families met; ``restored`` is null where something was lost or the family has no
    rules. Null and empty texts are sound; repeated rows are reported as often as they
    occur; other columns are dropped. Texts are not shuffled.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = _describer(shared.value)
        for b in batches:
            found = [(i, *r) for i, t in enumerate(b.column(len(key)).to_pylist()) if (r := look.examine(t))]
            if found:
                at, kinds, chains, restored = zip(*found)
                cols = [b.column(i).take(pa.array(at)) for i in range(len(key))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(kinds), pa.array(chains), pa.array(restored, pa.string())], [*key, "kind", "chain", "restored"])

    rows = df.select(*(F.col(k) for k in key), F.col(text).alias("__text")).where(F.col("__text").isNotNull() & (F.col("__text") != ""))
    kinds = ", ".join(f"`{k}` {t}" for k, t in rows.dtypes[:-1])
    return rows.mapInArrow(run, f"{kinds}, kind string, chain string, restored string")


_made: list = []


def _describer(model: Model) -> Describer:
    """One per Python worker."""
    if not _made or _made[0] is not model:
        _made[:] = [model, Describer(model)]
    return _made[1]
