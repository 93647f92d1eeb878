"""The text-signal battery as native expressions.

``FONT_SIGNALS`` holds the measures at font and page grain, ``document_signals`` those of
a whole document, which rounds before anything is compared. Dense classes are counted
by stripping their complement, sparse ones by ``regexp_count``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarazu.functions import charclass as cc

# Stop words that confirm English.
COMMON_ENGLISH = (
    "the of and to in for a is on at by with as from or be this that shall will not "
    "are was were which any such other all no notice tender date name department "
    "office corporation municipal work works city road water public list sr page "
    "total amount rate item description year month day time signature government "
    "india state district ward zone plan report annexure form application account "
    "balance schedule contents table"
).split()

# Thresholds.
PERFONT_MIN_CHARS, PERFONT_ASCII_MIN_LETTERS, DOCUMENT_ASCII_MIN_LETTERS = 200, 200, 300
PERFONT_MOJIBAKE, PERFONT_ASCII_K, PERFONT_SYMBOL, PERFONT_ENGLISH = 0.15, 0.05, 10.0, 0.15
SUSPECT_RATE_PER_1K, SUSPECT_MIN_ABS, MIN_DEV_CHARS, SCAN_CHARS_PER_PAGE = 2.0, 5, 100, 25
HEAD_CHARS = 600
LOSS_MIN_CHARS, LOSS_MAX_REPLACEMENT, LOSS_MAX_CONTROL = 25, 0.05, 0.05

C, M, V, N, D, WS = cc.CONSONANT, cc.MATRA, cc.VIRAMA, cc.NUKTA, cc.DEVANAGARI, cc.WS
INVALID_MATRA = f"(?<!{cc.java(C, N)}){cc.java(M)}"
WORD_INITIAL = f"(?<!{cc.java(D)}){cc.java(M)}"
ADJACENT = f"{cc.java(M)}{cc.java(M)}"
VIRAMA_THEN = f"{cc.java(V)}{cc.java(M)}"
DETACHED = f"{cc.java(WS)}{cc.java(M, V)}"
SYMBOL_IN_WORD = f"[A-Za-z]{cc.java(cc.SYMBOL)}[A-Za-z]"


def count(text: Column, pattern: str) -> Column:
    """Non-overlapping matches; for patterns that match rarely."""
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def count_dense(text: Column, *classes: cc.Ranges) -> Column:
    """Characters of a class that makes up much of the text."""
    return F.length(F.regexp_replace(text, cc.java(*classes, negated=True) + "+", "")).cast("long")


def body(text: Column) -> Column:
    """The text without white space."""
    return F.regexp_replace(text, cc.java(WS) + "+", "")


def ratio(a: Column, b: Column, scale: float = 1.0) -> Column:
    """``scale * a / b``, 0 where ``b`` is 0."""
    return F.when(b > 0, F.lit(scale) * a / b).otherwise(F.lit(0.0))


def bag_hash(text: Column) -> Column:
    """Hash of the sorted characters: equal for texts that differ in the order of their characters only."""
    return F.substring(F.sha2(F.array_join(F.sort_array(F.split(text, "")), ""), 256), 1, 16)


def with_text_signals(df: DataFrame, text: str) -> DataFrame:
    """Add the signals of one font's or one page's text. Null is measured as empty text."""
    t, b = F.col("__t"), F.col("__b")
    letters = F.regexp_replace(t, "[^A-Za-z]+", "")
    words = F.array(*map(F.lit, COMMON_ENGLISH))
    counts = {
        "sampled_chars": F.length(b).cast("long"),
        "dev_chars": count_dense(t, D),
        "latin_letters": F.length("__l").cast("long"),
        "n_tokens": F.size("__w").cast("long"),
        "n_mojibake": count_dense(b, cc.MOJIBAKE),
        "n_k": (F.length("__l") - F.length(F.replace(F.col("__l"), F.lit("k"), F.lit("")))).cast("long"),
        "n_symbols": count(t, SYMBOL_IN_WORD),
        "n_english": F.size(F.filter("__w", lambda w: F.array_contains(words, w))).cast("long"),
        "invalid_matras": count(t, INVALID_MATRA),
        "word_initial_matras": count(t, WORD_INITIAL),
        "adjacent_matras": count(t, ADJACENT),
        "virama_then_matra": count(t, VIRAMA_THEN),
        "detached_matras": count(t, DETACHED),
        "invalid_matras_nospace": count(b, INVALID_MATRA),
    }
    ratios = {
        "mojibake_ratio": ratio(F.col("n_mojibake"), F.col("sampled_chars")),
        "ascii_k_ratio": ratio(F.col("n_k"), F.col("latin_letters")),
        "ascii_k_eligible": F.col("latin_letters") >= PERFONT_ASCII_MIN_LETTERS,
        "symbol_per_1k": ratio(F.col("n_symbols"), F.col("sampled_chars"), 1000.0),
        "english_ratio": F.when(F.col("n_tokens") >= 20, F.col("n_english") / F.col("n_tokens")).otherwise(F.lit(0.0)),
        "invalid_rate_per_1k": ratio(F.col("invalid_matras"), F.col("dev_chars"), 1000.0),
    }
    staged = df.withColumn("__t", F.coalesce(F.col(text), F.lit(""))).withColumns(
        {"__b": body(t), "__l": letters, "__w": F.regexp_extract_all(F.lower(t), F.lit("[a-z]{2,}"), F.lit(0))}
    )
    return staged.withColumns(counts).withColumns(ratios).drop("__t", "__b", "__l", "__w")


def with_page_measures(df: DataFrame, text: str) -> DataFrame:
    """Add what an extractor comparison needs: loss counts and ratios, dev share, hashes, the loss verdict, and the first characters for display."""
    b = F.col("__b")
    staged = df.withColumn("__b", body(F.coalesce(F.col(text), F.lit(""))))
    counts = {
        "n_chars": F.length(b).cast("long"),
        "replacement_chars": count(b, cc.java(cc.REPLACEMENT)),
        "control_chars": count(b, cc.java(cc.CONTROL)),
        "body_dev_chars": count_dense(b, D),
        "text_hash": F.substring(F.sha2(b, 256), 1, 16),
        "bag_hash": bag_hash(b),
        "head": F.substring(F.coalesce(F.col(text), F.lit("")), 1, HEAD_CHARS),
    }
    n = F.col("n_chars")
    out = staged.withColumns(counts).withColumns(
        {
            "replacement_ratio": ratio(F.col("replacement_chars"), n),
            "control_ratio": ratio(F.col("control_chars"), n),
            "dev_share": ratio(F.col("body_dev_chars"), n),
        }
    )
    return out.withColumn("loss", loss_verdict()).drop("__b")


def loss_verdict() -> Column:
    """empty, replacement, control or null: the first gate a page fails."""
    return (
        F.when(F.coalesce(F.col("n_chars"), F.lit(0)) < LOSS_MIN_CHARS, "empty")
        .when(F.col("replacement_ratio") >= LOSS_MAX_REPLACEMENT, "replacement")
        .when(F.col("control_ratio") >= LOSS_MAX_CONTROL, "control")
    )


def with_document_signals(df: DataFrame, text: str) -> DataFrame:
    """Document grain: ratios are rounded before they are compared, the k ratio needs 300 letters."""
    t, b = F.col("__t"), F.col("__b")
    letters = F.regexp_replace(t, "[^A-Za-z]+", "")
    staged = df.withColumn("__t", F.coalesce(F.col(text), F.lit(""))).withColumns({"__b": body(t), "__l": letters})
    counted = staged.withColumns(
        {
            "chars": F.length(t).cast("long"),
            "dev_chars": count_dense(t, D),
            "dev_digits": count(t, cc.java(cc.DEV_DIGIT)),
            "ascii_digits": count(t, "[0-9]"),
            "invalid_matras": count(t, INVALID_MATRA),
            "word_initial_matras": count(t, WORD_INITIAL),
            "adjacent_matras": count(t, ADJACENT),
            "virama_then_matra": count(t, VIRAMA_THEN),
            "detached_matras": count(t, DETACHED),
            "mojibake_ratio": F.round(ratio(count_dense(b, cc.MOJIBAKE), F.length(b)), 3),
            "ascii_k_ratio": F.round(
                F.when(F.length("__l") >= DOCUMENT_ASCII_MIN_LETTERS, ratio(F.length("__l") - F.length(F.replace(F.col("__l"), F.lit("k"), F.lit(""))), F.length("__l"))).otherwise(0.0), 4
            ),
        }
    )
    rate = F.when(F.col("dev_chars") >= MIN_DEV_CHARS, F.round(1000.0 * F.col("invalid_matras") / F.col("dev_chars"), 2)).otherwise(F.lit(0.0))
    return counted.withColumn("invalid_rate_per_1k", rate).drop("__t", "__b", "__l")


# The same measures for DuckDB, which has no look-behind: a matra is invalid unless a
# consonant or nukta stands before it, and the two classes are disjoint.


def _sql(pattern: str) -> str:
    return pattern.replace("'", "''")


def sql_count(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, '{_sql(pattern)}'))::BIGINT"


def sql_body(text: str) -> str:
    return f"regexp_replace({text}, '{cc.re2(WS)}+', '', 'g')"


def sql_invalid(text: str) -> str:
    return f"({sql_count(text, cc.re2(M))} - {sql_count(text, cc.re2(C, N) + cc.re2(M))})"


SQL_WORD_INITIAL = f"(?:^|{cc.re2(D, negated=True)}){cc.re2(M)}"
SQL_ADJACENT = cc.re2(M) + cc.re2(M)
SQL_VIRAMA_THEN = cc.re2(V) + cc.re2(M)
SQL_DETACHED = cc.re2(WS) + cc.re2(M, V)
SQL_SYMBOL = f"[A-Za-z]{cc.re2(cc.SYMBOL)}[A-Za-z]"


def sql_ratio(a: str, b: str, scale: str = "1.0::DOUBLE") -> str:
    return f"(CASE WHEN {b} > 0 THEN {scale} * {a} / {b} ELSE 0.0::DOUBLE END)"


def sql_text_signals(source: str, text: str) -> str:
    """SELECT of all columns of ``source`` and the text signals, as WITH-free nested SQL."""
    words = ", ".join(f"'{w}'" for w in COMMON_ENGLISH)
    return f"""(SELECT *, {sql_ratio('n_mojibake', 'sampled_chars')} AS mojibake_ratio, {sql_ratio('n_k', 'latin_letters')} AS ascii_k_ratio,
 latin_letters >= {PERFONT_ASCII_MIN_LETTERS} AS ascii_k_eligible, {sql_ratio('n_symbols', 'sampled_chars', '1000.0::DOUBLE')} AS symbol_per_1k,
 CASE WHEN n_tokens >= 20 THEN n_english / n_tokens::DOUBLE ELSE 0.0::DOUBLE END AS english_ratio, {sql_ratio('invalid_matras', 'dev_chars', '1000.0::DOUBLE')} AS invalid_rate_per_1k
 FROM (SELECT *, length(b_)::BIGINT AS sampled_chars, {sql_count('t_', cc.re2(D))} AS dev_chars, length(l_)::BIGINT AS latin_letters, len(w_)::BIGINT AS n_tokens,
 {sql_count('b_', cc.re2(cc.MOJIBAKE))} AS n_mojibake, (length(l_) - length(replace(l_, 'k', '')))::BIGINT AS n_k, {sql_count('t_', SQL_SYMBOL)} AS n_symbols,
 len(list_filter(w_, lambda w: w IN ({words})))::BIGINT AS n_english, {sql_invalid('t_')} AS invalid_matras, {sql_count('t_', SQL_WORD_INITIAL)} AS word_initial_matras,
 {sql_count('t_', SQL_ADJACENT)} AS adjacent_matras, {sql_count('t_', SQL_VIRAMA_THEN)} AS virama_then_matra, {sql_count('t_', SQL_DETACHED)} AS detached_matras,
 {sql_invalid('b_')} AS invalid_matras_nospace
 FROM (SELECT *, {sql_body('t_')} AS b_, regexp_replace(t_, '[^A-Za-z]+', '', 'g') AS l_, regexp_extract_all(lower(t_), '[a-z]{{2,}}') AS w_
 FROM (SELECT *, coalesce({text}, '') AS t_ FROM {source}))))"""


def sql_page_measures(source: str, text: str) -> str:
    return f"""(SELECT *, CASE WHEN n_chars < {LOSS_MIN_CHARS} THEN 'empty' WHEN replacement_ratio >= {LOSS_MAX_REPLACEMENT} THEN 'replacement' WHEN control_ratio >= {LOSS_MAX_CONTROL} THEN 'control' END AS loss
 FROM (SELECT *, {sql_ratio('replacement_chars', 'n_chars')} AS replacement_ratio, {sql_ratio('control_chars', 'n_chars')} AS control_ratio, {sql_ratio('body_dev_chars', 'n_chars')} AS dev_share
 FROM (SELECT *, length(b_)::BIGINT AS n_chars, {sql_count('b_', cc.re2(cc.REPLACEMENT))} AS replacement_chars, {sql_count('b_', cc.re2(cc.CONTROL))} AS control_chars, {sql_count('b_', cc.re2(D))} AS body_dev_chars,
 substr(sha256(b_), 1, 16) AS text_hash, substr(sha256(array_to_string(list_sort(regexp_extract_all(b_, '(?s).')), '')), 1, 16) AS bag_hash
 FROM (SELECT *, {sql_body(f"coalesce({text}, '')")} AS b_ FROM {source}))))"""


def sql_document_signals(source: str, text: str) -> str:
    return f"""(SELECT *, CASE WHEN dev_chars >= {MIN_DEV_CHARS} THEN round(1000.0::DOUBLE * invalid_matras / dev_chars, 2) ELSE 0.0::DOUBLE END AS invalid_rate_per_1k
 FROM (SELECT *, length(t_)::BIGINT AS chars, {sql_count('t_', cc.re2(D))} AS dev_chars, {sql_count('t_', cc.re2(cc.DEV_DIGIT))} AS dev_digits, {sql_count('t_', '[0-9]')} AS ascii_digits,
 {sql_invalid('t_')} AS invalid_matras, {sql_count('t_', SQL_WORD_INITIAL)} AS word_initial_matras, {sql_count('t_', SQL_ADJACENT)} AS adjacent_matras,
 {sql_count('t_', SQL_VIRAMA_THEN)} AS virama_then_matra, {sql_count('t_', SQL_DETACHED)} AS detached_matras,
 round({sql_ratio(sql_count('b_', cc.re2(cc.MOJIBAKE)), 'length(b_)')}, 3) AS mojibake_ratio,
 round(CASE WHEN length(l_) >= {DOCUMENT_ASCII_MIN_LETTERS} THEN (length(l_) - length(replace(l_, 'k', ''))) / length(l_)::DOUBLE ELSE 0.0::DOUBLE END, 4) AS ascii_k_ratio
 FROM (SELECT *, {sql_body('t_')} AS b_, regexp_replace(t_, '[^A-Za-z]+', '', 'g') AS l_ FROM (SELECT *, coalesce({text}, '') AS t_ FROM {source}))))"""
