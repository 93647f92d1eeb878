"""Character classes, spelled for Java (Spark) and for RE2 (DuckDB).

Classes are lists of code point ranges, so that no editor or shell can compose or
decompose them. Python's ``\\s`` is Unicode-aware while Java's and RE2's defaults are
not; ``WS`` is the explicit class.
"""

from __future__ import annotations

Ranges = list[tuple[int, int]]

CONSONANT: Ranges = [(0x915, 0x939), (0x958, 0x95F), (0x978, 0x97F)]
MATRA: Ranges = [(0x93A, 0x93B), (0x93E, 0x94C), (0x94E, 0x94F), (0x962, 0x963)]
VIRAMA: Ranges = [(0x94D, 0x94D)]
NUKTA: Ranges = [(0x93C, 0x93C)]
DEVANAGARI: Ranges = [(0x900, 0x97F)]
DEV_DIGIT: Ranges = [(0x966, 0x96F)]
MOJIBAKE: Ranges = [(0xA1, 0x24F), (0x300, 0x36F), (0x2018, 0x2030)]
CONTROL: Ranges = [(0x00, 0x08), (0x0B, 0x0B), (0x0E, 0x1F), (0x7F, 0x7F)]
REPLACEMENT: Ranges = [(0xFFFD, 0xFFFD)]
SYMBOL: Ranges = [(0x24, 0x24), (0xA4, 0xA5), (0xA7, 0xA7), (0xAB, 0xAB), (0xB0, 0xB0), (0xBA, 0xBB)]
WS: Ranges = [
    (0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A),
    (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000),
]


def _body(ranges: Ranges, form: str) -> str:
    show = lambda c: form.format(c)
    return "".join(show(a) if a == b else f"{show(a)}-{show(b)}" for a, b in ranges)


def java(*classes: Ranges, negated: bool = False) -> str:
    """A bracket expression for Spark."""
    return "[" + "^" * negated + "".join(_body(c, "\\u{:04X}") for c in classes) + "]"


def re2(*classes: Ranges, negated: bool = False) -> str:
    """The same for DuckDB."""
    return "[" + "^" * negated + "".join(_body(c, "\\x{{{:04X}}}") for c in classes) + "]"
