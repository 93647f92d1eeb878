"""Font names: normalization, pattern lists, axes and the detector's labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarazu.functions import signals as s

# Name patterns of fonts that map their glyphs onto other characters.
LEGACY_PATTERNS = [
    "shree-dev", "shree dev", "shreedev",
    "kruti", "krutidev",
    "dv-tt", "dvtt", "surekh", "divyae", "divya",
    "chanakya", "shivaji", "yogeshweb", "yogesh",
    "aksharyogini", "millennium", "walkman",
    "agra", "amruta", "shusha", "ism",
    "dvbw", "dvot", "dvb-tt",
    "mgshree", "mg-shree", "sakal",
    "bhima", "radhika",
    "kiran",
    "aps-c-dv", "aps-dv", "apsdv",
    "akruti",
]
# Name patterns of fonts that can be vouched for.
KNOWN_GOOD = [
    "arial", "helvetica", "times new roman", "times", "courier", "calibri",
    "cambria", "candara", "consolas", "constantia", "corbel", "georgia",
    "verdana", "tahoma", "trebuchet", "segoe", "garamond", "book antiqua",
    "bookman", "century", "franklin", "futura", "gill sans", "impact",
    "lucida", "palatino", "rockwell", "symbol", "wingdings", "webdings",
    "zapfdingbats", "liberation", "dejavu", "roboto", "open sans", "lato",
    "montserrat", "poppins", "nunito", "raleway", "source sans", "pt sans",
    "ms mincho", "ms gothic", "mincho", "gothic", "batang", "simsun",
    "microsoft sans serif", "aptos", "adobefangsong", "fangsong",
    "malgun", "meiryo", "yu gothic", "sitka", "selawik", "leelawadee",
    "bahnschrift", "ink free", "javanese", "myanmar", "nirmala ui",
    "myriad", "minion", "frutiger", "univers", "optima", "baskerville",
    "gabriola", "angsana", "cordia", "browallia", "adobe devanagari",
    "adobe fan", "adobe song", "adobe ming", "kokila", "raavi", "vrinda",
    "tw cen", "berlin sans", "castellar", "copperplate", "eras", "perpetua",
    "algerian", "mv boli", "mvboli", "romant",
    "mangal", "aparajita", "nirmala", "kokila", "utsaah", "sanskrit text",
    "arial unicode", "noto sans devanagari", "noto serif devanagari",
    "noto sans", "noto serif", "kohinoor", "shobhika", "annapurna",
    "samyak", "lohit", "gargi", "chandas", "uttara", "sarai", "kalimati",
    "devanagari mt", "devanagari sangam", "itf devanagari", "murty",
]
POSITIVE = ("LEGACY_8BIT", "LEGACY_ASCII", "LEGACY_SYMBOL", "CMAP_INVALID")
CONVICTED_BY_OUTPUT = ("LEGACY_8BIT", "LEGACY_ASCII", "LEGACY_SYMBOL")


def normalize_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def _normal(patterns: Sequence[str]) -> list[str]:
    return list(dict.fromkeys("".join(ch for ch in p.lower() if ch.isascii() and ch.isalnum()) for p in patterns))


def pattern_rx(patterns: Sequence[str]) -> str:
    """All patterns as one alternation over normalized names."""
    return "|".join(_normal(patterns))


def matches(name: Column, patterns: Sequence[str]) -> Column:
    return normalize_name(name).rlike(pattern_rx(patterns))


def matching(name: Column, patterns: Sequence[str]) -> Column:
    """All patterns that occur in the name."""
    low = normalize_name(name)
    return F.filter(F.array(*map(F.lit, _normal(patterns))), lambda p: F.contains(low, p))


def base_name(raw: Column) -> Column:
    """Without the subset prefix: what follows the first "+", if one stands in the first eight characters."""
    at = F.instr(raw, "+")
    return F.when(at.between(1, 8), F.substring(raw, at + 1, F.length(raw))).otherwise(raw)


def name_axis(name: Column) -> Column:
    return F.when(matches(name, LEGACY_PATTERNS), "name_legacy").when(matches(name, KNOWN_GOOD), "name_known_good").otherwise("name_uninformative")


def detector_axis(label: Column) -> Column:
    return F.when(label.isin(*POSITIVE), "positive").when(label == "NO_EVIDENCE", "no_evidence")


def fixed(x: Column, digits: int) -> Column:
    """A number with so many decimals, rounded by its exact binary value; ``format_string`` rounds its shortest decimal form."""
    return F.replace(F.format_number(x, digits), F.lit(","), F.lit(""))


def output_reason(m: dict[str, Column] | None = None) -> Column:
    """Why one font's output is convicted, or null; silence is no evidence, not a finding."""
    c = m or {k: F.col(k) for k in ("sampled_chars", "dev_chars", "mojibake_ratio", "ascii_k_eligible", "ascii_k_ratio", "symbol_per_1k", "english_ratio")}
    judged = (c["sampled_chars"] >= s.PERFONT_MIN_CHARS) & (c["dev_chars"] <= 20)
    return F.when(
        judged,
        F.when(c["mojibake_ratio"] >= s.PERFONT_MOJIBAKE, F.concat(F.lit("8bit("), fixed(c["mojibake_ratio"], 2), F.lit(")")))
        .when(c["ascii_k_eligible"].cast("boolean") & (c["ascii_k_ratio"] >= s.PERFONT_ASCII_K), F.concat(F.lit("ascii-remap(k="), fixed(c["ascii_k_ratio"], 3), F.lit(")")))
        .when((c["symbol_per_1k"] >= s.PERFONT_SYMBOL) & (c["english_ratio"] < s.PERFONT_ENGLISH), F.concat(F.lit("symbol-remap("), fixed(c["symbol_per_1k"], 0), F.lit("/1k)"))),
    )


def output_label(reason: Column) -> Column:
    """The label of an observation from its reason and its measures."""
    kind = F.substring_index(reason, "(", 1)
    return (
        F.when(kind == "8bit", "LEGACY_8BIT")
        .when(kind == "ascii-remap", "LEGACY_ASCII")
        .when(kind == "symbol-remap", "LEGACY_SYMBOL")
        .when(reason.isNotNull(), "UNDECIDABLE")
        .when(F.col("sampled_chars") < s.PERFONT_MIN_CHARS, "UNDECIDABLE")
        .when(
            (F.col("dev_chars") >= s.MIN_DEV_CHARS) & (F.col("invalid_rate_per_1k") >= s.SUSPECT_RATE_PER_1K) & (F.col("invalid_matras") >= s.SUSPECT_MIN_ABS),
            "CMAP_INVALID",
        )
        .otherwise("NO_EVIDENCE")
    )


SQL_REASON_KIND = f"""CASE WHEN sampled_chars >= {s.PERFONT_MIN_CHARS} AND dev_chars <= 20 THEN
 CASE WHEN mojibake_ratio >= {s.PERFONT_MOJIBAKE} THEN '8bit' WHEN ascii_k_eligible::INT = 1 AND ascii_k_ratio >= {s.PERFONT_ASCII_K} THEN 'ascii-remap'
 WHEN symbol_per_1k >= {s.PERFONT_SYMBOL} AND english_ratio < {s.PERFONT_ENGLISH} THEN 'symbol-remap' END END"""
SQL_LABEL = f"""CASE WHEN kind = '8bit' THEN 'LEGACY_8BIT' WHEN kind = 'ascii-remap' THEN 'LEGACY_ASCII' WHEN kind = 'symbol-remap' THEN 'LEGACY_SYMBOL'
 WHEN sampled_chars < {s.PERFONT_MIN_CHARS} THEN 'UNDECIDABLE' WHEN dev_chars >= {s.MIN_DEV_CHARS} AND invalid_rate_per_1k >= {s.SUSPECT_RATE_PER_1K} AND invalid_matras >= {s.SUSPECT_MIN_ABS} THEN 'CMAP_INVALID' ELSE 'NO_EVIDENCE' END"""
SQL_NORMAL_NAME = "regexp_replace(lower(font_name), '[^a-z0-9]', '', 'g')"
SQL_IS_LEGACY = f"regexp_matches({SQL_NORMAL_NAME}, '{pattern_rx(LEGACY_PATTERNS)}')"
SQL_IS_GOOD = f"regexp_matches({SQL_NORMAL_NAME}, '{pattern_rx(KNOWN_GOOD)}')"
