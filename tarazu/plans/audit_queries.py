"""Signals, verdicts and breakdowns over documents and their fonts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarazu.functions import charclass as cc
from tarazu.functions import fonts as fn
from tarazu.functions import signals as s
from tarazu.operators import audit as au
from tarazu.session import spread, table


def _docs(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    df = table(spark, d, "documents")
    return spread(df.select(*columns) if columns else df, "doc_id")


def _audit(spark: SparkSession, d: str) -> DataFrame:
    return au.audited(_docs(spark, d), table(spark, d, "font_observation"))


def audit_files(spark: SparkSession, d: str) -> DataFrame:
    return _audit(spark, d).select(
        "sha256", "pages", "chars", "dev_chars", "dev_digits", "ascii_digits", "invalid_matras", "invalid_rate_per_1k",
        "mojibake_ratio", "ascii_k_ratio", "n_fonts", "n_legacy_names", "n_legacy_by_output", "n_unknown", "verdict",
    )


def verdict_by_source(spark: SparkSession, d: str) -> DataFrame:
    return au.breakdown(_audit(spark, d), "source")


def verdict_by_body(spark: SparkSession, d: str) -> DataFrame:
    return au.breakdown(_audit(spark, d), "issuing_body")


def verdict_by_doc_type(spark: SparkSession, d: str) -> DataFrame:
    return au.breakdown(_audit(spark, d), "doc_type")


def prevalence_macro_pooled(spark: SparkSession, d: str) -> DataFrame:
    return au.macro_pooled(_audit(spark, d), "issuing_body", F.col("verdict").isin("LEGACY", "SUSPECT"))


def go_no_go_decision(spark: SparkSession, d: str) -> DataFrame:
    return au.decision(_audit(spark, d))


def _signals(*columns: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        got = s.with_text_signals(_docs(spark, d, "doc_id", "text"), "text")
        return got.select("doc_id", *(F.round(c, 9).alias(c) if c.endswith(("ratio", "1k")) else F.col(c) for c in columns))

    return run


SIGNALS = {
    "signals_mojibake": ["sampled_chars", "n_mojibake", "mojibake_ratio"],
    "signals_ascii_k": ["latin_letters", "n_k", "ascii_k_ratio", "ascii_k_eligible"],
    "signals_symbol": ["n_symbols", "symbol_per_1k"],
    "signals_english": ["n_tokens", "n_english", "english_ratio"],
    "signals_structural": ["dev_chars", "invalid_matras", "invalid_rate_per_1k", "word_initial_matras", "adjacent_matras", "virama_then_matra", "detached_matras"],
    "signals_nospace_delta": ["invalid_matras", "invalid_matras_nospace"],
}


def excerpt_structural(spark: SparkSession, d: str) -> DataFrame:
    """Structural damage of the excerpts by kind, where misplaced vowel signs occur."""
    x = spread(table(spark, d, "excerpt").dropDuplicates(["excerpt_id"]).select("excerpt_id", "kind", "text"), "excerpt_id")
    got = s.with_text_signals(x, "text")
    return got.groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("invalid_matras") > 0).alias("n_invalid"),
        *(F.sum(c).alias(c) for c in ("dev_chars", "invalid_matras", "word_initial_matras", "adjacent_matras", "virama_then_matra", "detached_matras", "invalid_matras_nospace")),
    )


def pages_of(df: DataFrame) -> DataFrame:
    """doc_id, page (from 1), page_text."""
    split = F.split(F.coalesce("text", F.lit("")), au.PAGE_BREAK)
    return df.select("doc_id", F.posexplode(split).alias("page", "page_text")).withColumn("page", F.col("page") + 1)


def page_measure_loss(spark: SparkSession, d: str) -> DataFrame:
    return s.with_page_measures(pages_of(_docs(spark, d, "doc_id", "text")), "page_text").select(
        "doc_id", "page", "n_chars", "replacement_chars", "control_chars", F.round("dev_share", 9).alias("dev_share"), "loss"
    )


def page_hashes(spark: SparkSession, d: str) -> DataFrame:
    return s.with_page_measures(pages_of(_docs(spark, d, "doc_id", "text")), "page_text").select("doc_id", "page", "text_hash", "bag_hash")


def content_dedupe_first_wins(spark: SparkSession, d: str) -> DataFrame:
    from tarazu.operators.dedupe import pick

    rows = table(spark, d, "documents").where("sha256 IS NOT NULL").select("sha256", "doc_id", "source_url", "filename")
    return pick(rows, ["sha256"], ["doc_id"])


def _spans(spark: SparkSession, d: str) -> DataFrame:
    """Lines as spans of four alternating fonts, eight lines a page; the first eight pages are read."""
    lines = _docs(spark, d, "doc_id", "text").where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.select(
        "doc_id", "pos", (F.floor(F.col("pos") / 8) + 1).cast("int").alias("page"),
        F.concat(F.lit("F"), (F.col("pos") % 4).cast("string")).alias("font_name"), F.concat("line", F.lit(" ")).alias("piece"),
    )


CAP_CHARS, CAP_PAGES = 2500, 8


def accumulate_spans(spans: DataFrame, cap: int = CAP_CHARS, pages: int = CAP_PAGES) -> DataFrame:
    """Per document and font: the pieces of the first pages joined until ``cap`` characters are reached.

    The piece that reaches the cap is kept whole. A window runs over the spans of one
    font in one document, which the page limit bounds.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id", "font_name").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.length("piece")).over(w), F.lit(0))
    read = spans.where(F.col("page") <= pages).withColumn("before", before)
    kept = F.collect_list(F.when(F.col("before") < cap, F.struct("pos", "piece", "page", "before")))
    got = read.groupBy("doc_id", "font_name").agg(F.array_sort(kept).alias("p"), F.count_distinct("page").alias("n_pages_seen"))
    return got.select(
        "doc_id", "font_name", "n_pages_seen", F.array_join("p.piece", "").alias("text"),
        F.transform("p", lambda x: F.struct(x.page.alias("page"), x.before.alias("char_start"), F.length(x.piece).alias("len"))).alias("chunks"),
    )


def font_spans_capped(spark: SparkSession, d: str) -> DataFrame:
    got = accumulate_spans(_spans(spark, d))
    return got.select("doc_id", "font_name", "n_pages_seen", F.length("text").cast("long").alias("n_chars"), F.size("chunks").cast("long").alias("n_pieces"), F.md5("text").alias("text_md5"))


def font_observation_measured(spark: SparkSession, d: str) -> DataFrame:
    """Spans -> signals -> reason -> label, all at font grain."""
    got = s.with_text_signals(accumulate_spans(_spans(spark, d)), "text").withColumn("reason", fn.output_reason())
    return got.select("doc_id", "font_name", "sampled_chars", "dev_chars", "invalid_matras", F.substring_index("reason", "(", 1).alias("kind"), fn.output_label(F.col("reason")).alias("label"))


def font_aggregate_xrefs(spark: SparkSession, d: str) -> DataFrame:
    """Observations of one face in one file collapsed over spellings of its name."""
    o = table(spark, d, "font_observation").dropDuplicates(["obs_id"]).where("font_name IS NOT NULL")
    return o.groupBy("sha256", fn.normalize_name(F.col("font_name")).alias("face")).agg(
        F.sum("n_xrefs").alias("n_xrefs"), F.max("embedded").alias("embedded"), F.min("has_tounicode").alias("has_tounicode"),
        F.min("first_page").alias("first_page"), F.min_by("raw_font_name", "obs_id").alias("raw_font_name"),
    )


def _relabelled(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "font_observation").dropDuplicates(["obs_id"]).withColumn("reason", fn.output_reason())
    return o.withColumn("relabel", fn.output_label(F.col("reason")))


def reconcile_fonts_vs_audit(spark: SparkSession, d: str) -> DataFrame:
    """Fonts convicted by the stored labels against those convicted by the stored signals, per file."""
    got = _relabelled(spark, d).groupBy("sha256").agg(
        F.count_if(F.col("detector_label").isin(*fn.CONVICTED_BY_OUTPUT)).alias("stored"),
        F.count_if(F.col("relabel").isin(*fn.CONVICTED_BY_OUTPUT)).alias("now"),
        F.coalesce(F.bool_or(F.col("signals_version").endswith("+deep")), F.lit(False)).alias("deep"),
    )
    what = F.when(F.col("stored") == F.col("now"), "equal").when(~F.col("deep"), "mismatch").when(F.col("now") > F.col("stored"), "deep_extra").otherwise("deep_shortfall")
    return got.groupBy(what.alias("outcome")).agg(F.count(F.lit(1)).alias("n_files"), F.sum(F.abs(F.col("now") - F.col("stored"))).alias("fonts_apart"))


def rebucket_transitions(spark: SparkSession, d: str) -> DataFrame:
    """Labels decided again from the stored signals, against the stored labels."""
    return _relabelled(spark, d).groupBy(F.col("detector_label").alias("old"), F.col("relabel").alias("new")).agg(F.count(F.lit(1)).alias("n"))


def _relabelled_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Every file's audit with the convictions by stored labels and by labels decided again."""
    again = _relabelled(spark, d).groupBy("sha256").agg(
        F.count_if(F.col("relabel").isin(*fn.CONVICTED_BY_OUTPUT)).alias("now_by_output"), F.coalesce(F.bool_or(F.col("signals_version").endswith("+deep")), F.lit(False)).alias("deep")
    )
    got = _audit(spark, d).drop("is_deep").join(again, "sha256", "left")
    return got.withColumns({"now_by_output": F.coalesce("now_by_output", F.lit(0)).cast("long"), "deep": F.coalesce("deep", F.lit(False))})


def rebucket_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts decided again from the stored signals, against the stored verdicts."""
    got = _relabelled_evidence(spark, d)
    again = got.withColumnRenamed("verdict", "old").withColumn("n_legacy_by_output", F.col("now_by_output")).withColumn("new", au.verdict())
    return again.groupBy("old", "new").agg(F.count(F.lit(1)).alias("n"))


def reconcile_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Per verdict: files whose convicted fonts agree with the audit, exceed it or fall short of it."""
    got = _relabelled_evidence(spark, d)
    a, b = F.col("n_legacy_by_output"), F.col("now_by_output")
    what = F.when(a == b, "equal").when(~F.col("deep"), "mismatch").when(b > a, "deep_extra").otherwise("deep_shortfall")
    return got.groupBy("verdict", what.alias("outcome")).agg(F.count(F.lit(1)).alias("n_files"))


def font_lists(spark: SparkSession, d: str) -> DataFrame:
    """Each file's fonts in one text: "name|type" in order, joined by ";"."""
    o = table(spark, d, "font_observation").dropDuplicates(["obs_id"]).where("font_name IS NOT NULL")
    entry = F.concat_ws("|", F.regexp_replace("font_name", ";", " "), F.coalesce("font_type", F.lit("?")))
    # A file's fonts are a handful.
    return o.groupBy("sha256").agg(F.array_join(F.sort_array(F.collect_set(entry)), ";").alias("fonts"))


def fonts_from_lists(spark: SparkSession, d: str) -> DataFrame:
    """The lists taken apart again: distinct fonts, named up to the last bar, typed after it."""
    got = font_lists(spark, d).select("sha256", F.explode(F.split("fonts", ";")).alias("entry"))
    name, kind = F.regexp_extract("entry", "^(.*)\\|([^|]*)$", 1), F.regexp_extract("entry", "^(.*)\\|([^|]*)$", 2)
    return got.groupBy(name.alias("font_name"), kind.alias("font_type")).agg(F.count_distinct("sha256").alias("n_files"))


def reasons_formatted(spark: SparkSession, d: str) -> DataFrame:
    """Reasons with their figures, decided again from the stored signals."""
    return _relabelled(spark, d).where("reason IS NOT NULL").select("obs_id", "reason")


def doc_types_json(spark: SparkSession, d: str) -> DataFrame:
    """Per source: documents by type as a JSON object with sorted keys."""
    n = _docs(spark, d, "source", "doc_type", "doc_id").groupBy("source", F.coalesce("doc_type", F.lit("none")).alias("doc_type")).agg(F.count(F.lit(1)).alias("n"))
    pairs = F.map_from_entries(F.sort_array(F.collect_list(F.struct("doc_type", "n"))))
    return n.groupBy("source").agg(F.to_json(pairs).alias("types"))


def doc_types_from_json(spark: SparkSession, d: str) -> DataFrame:
    """The objects read back."""
    got = doc_types_json(spark, d).select("source", F.explode(F.from_json("types", "map<string, bigint>")).alias("doc_type", "n"))
    return got.select("source", "doc_type", "n")


def json_records(spark: SparkSession, d: str) -> DataFrame:
    """Pages of an interface ({"data": [...], "links": {...}}) navigated to their records."""
    rows = _docs(spark, d, "doc_id", "filename", "issuing_body", "source_url").withColumn("page", F.floor(F.col("doc_id") / 50).cast("long"))
    item = F.struct(F.col("doc_id").alias("id"), F.struct(F.col("filename").alias("title"), F.struct(F.col("issuing_body").alias("name")).alias("body")).alias("attributes"))
    payload = F.to_json(F.struct(F.collect_list(item).alias("data"), F.struct(F.struct(F.max("source_url").alias("href")).alias("next")).alias("links")))
    pages = rows.groupBy("page").agg(payload.alias("payload"))
    schema = "data array<struct<id: bigint, attributes: struct<title: string, body: struct<name: string>>>>, links struct<next: struct<href: string>>"
    got = pages.select(F.from_json("payload", schema).alias("p")).select(F.explode("p.data").alias("x"))
    return got.select(F.col("x.id").alias("doc_id"), F.col("x.attributes.title").alias("title"), F.col("x.attributes.body.name").alias("body"))


def collapsed_text(spark: SparkSession, d: str) -> DataFrame:
    """Texts for display: every run of white space one blank, none at the ends, 200 characters."""
    ws = cc.java(cc.WS) + "+"
    flat = F.regexp_replace(F.regexp_replace("text", f"^{ws}|{ws}$", ""), ws, " ")
    return _docs(spark, d, "doc_id", "text").where("text IS NOT NULL").select("doc_id", F.md5(flat).alias("flat_md5"), F.md5(F.substring(flat, 1, 200)).alias("shown_md5"))


def detector_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Which kinds of evidence fire together on a file."""
    a = _audit(spark, d)
    flags = F.array(
        F.when(F.col("n_legacy_names") > 0, "name"),
        F.when(F.col("mojibake_ratio") >= s.PERFONT_MOJIBAKE, "doc-mojibake"),
        F.when(F.col("ascii_k_ratio") >= s.PERFONT_ASCII_K, "doc-ascii"),
        F.when(F.col("n_legacy_by_output") > 0, "per-font"),
    )
    combo = F.array_join(F.array_sort(F.array_compact(flags)), "+")
    return a.groupBy(combo.alias("fired")).agg(F.count(F.lit(1)).alias("n"))


def name_axis_counts(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "font_observation").dropDuplicates(["obs_id"])
    return o.groupBy(fn.name_axis(F.col("font_name")).alias("name_axis"), fn.detector_axis(F.col("detector_label")).alias("detector_axis")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("font_name").alias("n_names")
    )


def distinct_fonts(spark: SparkSession, d: str) -> DataFrame:
    """Distinct names on the legacy list or unknown without a Unicode map, with the patterns they match."""
    o = table(spark, d, "font_observation").dropDuplicates(["obs_id"]).where("font_name IS NOT NULL")
    axis = fn.name_axis(F.col("font_name"))
    unknown = (axis == "name_uninformative") & (F.col("embedded") == 1) & (F.col("has_tounicode") == 0)
    got = o.select("font_name", F.when(axis == "name_legacy", "legacy").when(unknown, "unknown").alias("kind"), F.size(fn.matching(F.col("font_name"), fn.LEGACY_PATTERNS)).cast("long").alias("n_patterns"))
    return got.where("kind IS NOT NULL").distinct()


def base_names(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "font_observation").dropDuplicates(["obs_id"])
    return o.groupBy(fn.base_name(F.col("raw_font_name")).alias("base_name")).agg(F.count(F.lit(1)).alias("n"))


def under_sampled_fonts(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "font_observation").dropDuplicates(["obs_id"])
    return o.where((F.col("sampled_chars") < s.PERFONT_MIN_CHARS) & (F.col("n_pages_declared") >= 5)).select("obs_id", "sha256", "sampled_chars", "n_pages_declared")


QUERIES = {
    f.__name__: f
    for f in (
        verdict_by_source, audit_files, verdict_by_body, verdict_by_doc_type, prevalence_macro_pooled, go_no_go_decision, excerpt_structural,
        page_measure_loss, page_hashes, content_dedupe_first_wins, font_spans_capped, font_observation_measured, font_aggregate_xrefs,
        reconcile_fonts_vs_audit, rebucket_transitions, rebucket_verdicts, reconcile_verdicts, font_lists, fonts_from_lists, reasons_formatted,
        doc_types_json, doc_types_from_json, json_records, collapsed_text, detector_overlap, name_axis_counts, distinct_fonts, base_names, under_sampled_fonts,
    )
} | {name: _signals(*columns) for name, columns in SIGNALS.items()}

OBS = "(SELECT DISTINCT ON (obs_id) * FROM font_observation)"
AUDIT = f"""files AS (SELECT *, coalesce(len(text) - len(replace(text, chr(12), '')) + 1, 1)::BIGINT AS pages FROM {s.sql_document_signals("(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sha256 ORDER BY doc_id) AS rn FROM documents WHERE sha256 IS NOT NULL) WHERE rn = 1)", 'text')}),
fonts AS (SELECT sha256, count(*) AS n_fonts, count_if({fn.SQL_IS_LEGACY}) AS n_legacy_names, count_if(detector_label IN {fn.CONVICTED_BY_OUTPUT}) AS n_legacy_by_output,
 count_if(NOT {fn.SQL_IS_LEGACY} AND NOT {fn.SQL_IS_GOOD} AND embedded = 1 AND has_tounicode = 0) AS n_unknown FROM {OBS} GROUP BY sha256),
evid AS (SELECT files.* EXCLUDE (t_, b_, l_, text), coalesce(n_fonts, 0)::BIGINT AS n_fonts, coalesce(n_legacy_names, 0)::BIGINT AS n_legacy_names, coalesce(n_legacy_by_output, 0)::BIGINT AS n_legacy_by_output, coalesce(n_unknown, 0)::BIGINT AS n_unknown FROM files LEFT JOIN fonts USING (sha256)),
audit AS (SELECT *, CASE WHEN n_fonts = 0 OR chars / pages::DOUBLE < {s.SCAN_CHARS_PER_PAGE} THEN 'SCAN' WHEN n_legacy_names > 0 OR n_legacy_by_output > 0 THEN 'LEGACY'
 WHEN invalid_rate_per_1k >= {s.SUSPECT_RATE_PER_1K} AND invalid_matras >= {s.SUSPECT_MIN_ABS} THEN 'SUSPECT' WHEN n_unknown > 0 THEN 'UNCLASSIFIED' ELSE 'CLEAN' END AS verdict FROM evid)"""


def _sql_breakdown(column: str) -> str:
    pct = ", ".join(f"round(100.0::DOUBLE * count_if(verdict = '{v}') / count(*), 6) AS pct_{v.lower()}" for v in au.VERDICTS)
    return f"WITH {AUDIT} SELECT {column}, count(*) AS n, {pct} FROM audit GROUP BY {column}"


def _sql_signals(columns: list[str]) -> str:
    show = ", ".join(f"round({c}, 9) AS {c}" if c.endswith(("ratio", "1k")) else c for c in columns)
    return f"SELECT doc_id, {show} FROM {s.sql_text_signals('documents', 'text')}"


PAGES = "(SELECT doc_id, unnest(range(1, len(p) + 1))::INT AS page, unnest(p) AS page_text FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(12)) AS p FROM documents))"
_SPANS = f"""spans AS (SELECT doc_id, pos, pos // 8 + 1 AS page, 'F' || (pos % 4) AS font_name, line || ' ' AS piece FROM
 (SELECT doc_id, unnest(range(0, len(l))) AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL))),
run AS (SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY doc_id, font_name ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM spans WHERE page <= {CAP_PAGES}),
capped AS (SELECT doc_id, font_name, count(DISTINCT page) AS n_pages_seen, string_agg(piece, '' ORDER BY pos) FILTER (before < {CAP_CHARS}) AS text, count(*) FILTER (before < {CAP_CHARS}) AS n_pieces FROM run GROUP BY doc_id, font_name)"""
_RELABEL = f"(SELECT *, {fn.SQL_LABEL} AS relabel FROM (SELECT *, {fn.SQL_REASON_KIND} AS kind FROM {OBS}))"

_CASE = AUDIT[AUDIT.index("audit AS (SELECT *, ") + len("audit AS (SELECT *, ") : AUDIT.rindex(" AS verdict FROM evid)")]
_AGAIN = f"""{AUDIT}, again AS (SELECT sha256, count_if(relabel IN {fn.CONVICTED_BY_OUTPUT}) AS now_by_output, coalesce(bool_or(signals_version LIKE '%+deep'), false) AS deep FROM {_RELABEL} GROUP BY 1),
both_ AS (SELECT audit.*, coalesce(now_by_output, 0) AS now_by_output, coalesce(deep, false) AS deep FROM audit LEFT JOIN again USING (sha256))"""
_LISTS = "SELECT sha256, string_agg(DISTINCT e, ';' ORDER BY e) AS fonts FROM (SELECT sha256, replace(font_name, ';', ' ') || '|' || coalesce(font_type, '?') AS e FROM " + OBS + " WHERE font_name IS NOT NULL) GROUP BY 1"
_WSQ = cc.re2(cc.WS) + "+"
_FLAT = f"regexp_replace(regexp_replace(text, '^{_WSQ}|{_WSQ}$', '', 'g'), '{_WSQ}', ' ', 'g')"
_TYPES = "(SELECT source, coalesce(doc_type, 'none') AS doc_type, count(*) AS n FROM documents GROUP BY 1, 2)"

SQL = {
    "rebucket_verdicts": f'WITH {_AGAIN} SELECT old, "new", count(*) AS n FROM (SELECT verdict AS old, {_CASE.replace("n_legacy_by_output", "now_by_output")} AS "new" FROM both_) GROUP BY 1, 2',
    "reconcile_verdicts": f"""WITH {_AGAIN} SELECT verdict, CASE WHEN n_legacy_by_output = now_by_output THEN 'equal' WHEN NOT deep THEN 'mismatch' WHEN now_by_output > n_legacy_by_output THEN 'deep_extra' ELSE 'deep_shortfall' END AS outcome, count(*) AS n_files FROM both_ GROUP BY 1, 2""",
    "font_lists": _LISTS,
    "fonts_from_lists": f"SELECT regexp_extract(e, '^(.*)\\|([^|]*)$', 1) AS font_name, regexp_extract(e, '^(.*)\\|([^|]*)$', 2) AS font_type, count(DISTINCT sha256) AS n_files FROM (SELECT sha256, unnest(string_split(fonts, ';')) AS e FROM ({_LISTS})) GROUP BY 1, 2",
    "reasons_formatted": f"""SELECT obs_id, CASE kind WHEN '8bit' THEN printf('8bit(%.2f)', mojibake_ratio) WHEN 'ascii-remap' THEN printf('ascii-remap(k=%.3f)', ascii_k_ratio) ELSE printf('symbol-remap(%.0f/1k)', symbol_per_1k) END AS reason
 FROM (SELECT *, {fn.SQL_REASON_KIND} AS kind FROM {OBS}) WHERE kind IS NOT NULL""",
    "doc_types_json": f"""SELECT source, '{{' || string_agg('"' || doc_type || '":' || n, ',' ORDER BY doc_type) || '}}' AS types FROM {_TYPES} GROUP BY 1""",
    "doc_types_from_json": f"SELECT source, doc_type, n FROM {_TYPES}",
    "json_records": "SELECT doc_id, filename AS title, issuing_body AS body FROM documents",
    "collapsed_text": f"SELECT doc_id, md5({_FLAT}) AS flat_md5, md5(substr({_FLAT}, 1, 200)) AS shown_md5 FROM documents WHERE text IS NOT NULL",
    "audit_files": f"WITH {AUDIT} SELECT sha256, pages, chars, dev_chars, dev_digits, ascii_digits, invalid_matras, invalid_rate_per_1k, mojibake_ratio, ascii_k_ratio, n_fonts, n_legacy_names, n_legacy_by_output, n_unknown, verdict FROM audit",
    "verdict_by_source": _sql_breakdown("source"),
    "verdict_by_body": _sql_breakdown("issuing_body"),
    "verdict_by_doc_type": _sql_breakdown("doc_type"),
    "prevalence_macro_pooled": f"""WITH {AUDIT}, per AS (SELECT issuing_body, count(*) AS den, count_if(verdict IN ('LEGACY', 'SUSPECT')) AS num FROM audit GROUP BY 1)
SELECT count(*) AS n_groups, sum(den)::BIGINT AS n, round(avg(num / den::DOUBLE), 6) AS macro, round(sum(num) / sum(den)::DOUBLE, 6) AS pooled, round(max(den) / sum(den)::DOUBLE, 6) AS largest_share FROM per""",
    "go_no_go_decision": f"""WITH {AUDIT}, r AS (SELECT count(*) AS n, round(100.0::DOUBLE * count_if(verdict IN ('LEGACY', 'SUSPECT')) / count(*), 6) AS affected_pct, round(100.0::DOUBLE * count_if(verdict = 'UNCLASSIFIED') / count(*), 6) AS unclassified_pct FROM audit)
SELECT *, CASE WHEN affected_pct >= 15 OR (affected_pct >= 5 AND unclassified_pct >= 15) THEN 'GO' WHEN affected_pct + unclassified_pct < 10 THEN 'PIVOT' ELSE 'INSPECT' END AS decision FROM r""",
    "excerpt_structural": f"""SELECT kind, count(*) AS n, count_if(invalid_matras > 0)::BIGINT AS n_invalid, {', '.join(f'sum({c})::BIGINT AS {c}' for c in ('dev_chars', 'invalid_matras', 'word_initial_matras', 'adjacent_matras', 'virama_then_matra', 'detached_matras', 'invalid_matras_nospace'))}
FROM {s.sql_text_signals('(SELECT DISTINCT ON (excerpt_id) * FROM excerpt)', 'text')} GROUP BY kind""",
    "page_measure_loss": f"SELECT doc_id, page, n_chars, replacement_chars, control_chars, round(dev_share, 9) AS dev_share, loss FROM {s.sql_page_measures(PAGES, 'page_text')}",
    "page_hashes": f"SELECT doc_id, page, text_hash, bag_hash FROM {s.sql_page_measures(PAGES, 'page_text')}",
    "content_dedupe_first_wins": "SELECT sha256, doc_id, source_url, filename FROM (SELECT *, row_number() OVER (PARTITION BY sha256 ORDER BY doc_id) AS rn FROM documents WHERE sha256 IS NOT NULL) WHERE rn = 1",
    "font_spans_capped": f"WITH {_SPANS} SELECT doc_id, font_name, n_pages_seen, length(text)::BIGINT AS n_chars, n_pieces, md5(text) AS text_md5 FROM capped",
    "font_observation_measured": f"WITH {_SPANS} SELECT doc_id, font_name, sampled_chars, dev_chars, invalid_matras, kind, {fn.SQL_LABEL} AS label FROM (SELECT *, {fn.SQL_REASON_KIND} AS kind FROM {s.sql_text_signals('capped', 'text')})",
    "font_aggregate_xrefs": f"""SELECT sha256, {fn.SQL_NORMAL_NAME} AS face, sum(n_xrefs)::BIGINT AS n_xrefs, max(embedded) AS embedded, min(has_tounicode) AS has_tounicode, min(first_page) AS first_page, arg_min_null(raw_font_name, obs_id) AS raw_font_name
FROM {OBS} WHERE font_name IS NOT NULL GROUP BY 1, 2""",
    "reconcile_fonts_vs_audit": f"""WITH f AS (SELECT sha256, count_if(detector_label IN {fn.CONVICTED_BY_OUTPUT}) AS stored, count_if(relabel IN {fn.CONVICTED_BY_OUTPUT}) AS now, coalesce(bool_or(signals_version LIKE '%+deep'), false) AS deep FROM {_RELABEL} GROUP BY 1)
SELECT CASE WHEN stored = now THEN 'equal' WHEN NOT deep THEN 'mismatch' WHEN now > stored THEN 'deep_extra' ELSE 'deep_shortfall' END AS outcome, count(*) AS n_files, sum(abs(now - stored))::BIGINT AS fonts_apart FROM f GROUP BY 1""",
    "rebucket_transitions": f'SELECT detector_label AS old, relabel AS "new", count(*) AS n FROM {_RELABEL} GROUP BY 1, 2',
    "detector_overlap": f"""WITH {AUDIT} SELECT array_to_string(list_sort(list_filter([CASE WHEN n_legacy_names > 0 THEN 'name' END, CASE WHEN mojibake_ratio >= {s.PERFONT_MOJIBAKE} THEN 'doc-mojibake' END, CASE WHEN ascii_k_ratio >= {s.PERFONT_ASCII_K} THEN 'doc-ascii' END,
 CASE WHEN n_legacy_by_output > 0 THEN 'per-font' END], lambda x: x IS NOT NULL)), '+') AS fired, count(*) AS n FROM audit GROUP BY 1""",
    "name_axis_counts": f"""SELECT CASE WHEN {fn.SQL_IS_LEGACY} THEN 'name_legacy' WHEN {fn.SQL_IS_GOOD} THEN 'name_known_good' ELSE 'name_uninformative' END AS name_axis,
 CASE WHEN detector_label IN {fn.POSITIVE} THEN 'positive' WHEN detector_label = 'NO_EVIDENCE' THEN 'no_evidence' END AS detector_axis, count(*) AS n, count(DISTINCT font_name) AS n_names FROM {OBS} GROUP BY 1, 2""",
    "distinct_fonts": f"""SELECT DISTINCT font_name, kind, n_patterns FROM (SELECT font_name, CASE WHEN {fn.SQL_IS_LEGACY} THEN 'legacy' WHEN NOT {fn.SQL_IS_GOOD} AND embedded = 1 AND has_tounicode = 0 THEN 'unknown' END AS kind,
 len(list_filter({fn._normal(fn.LEGACY_PATTERNS)}, lambda p: contains({fn.SQL_NORMAL_NAME}, p)))::BIGINT AS n_patterns FROM {OBS} WHERE font_name IS NOT NULL) WHERE kind IS NOT NULL""",
    "base_names": f"SELECT CASE WHEN instr(raw_font_name, '+') BETWEEN 1 AND 8 THEN substr(raw_font_name, instr(raw_font_name, '+') + 1) ELSE raw_font_name END AS base_name, count(*) AS n FROM {OBS} GROUP BY 1",
    "under_sampled_fonts": f"SELECT obs_id, sha256, sampled_chars, n_pages_declared FROM {OBS} WHERE sampled_chars < {s.PERFONT_MIN_CHARS} AND n_pages_declared >= 5",
} | {name: _sql_signals(columns) for name, columns in SIGNALS.items()}
