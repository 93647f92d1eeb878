"""Extraction arms compared over pages and over fonts.

Real arms: the text layer, the OCR and the typed text of each page of transcription
(``page_*`` queries), and the two arms of font_extraction. As no table holds the output
of more extractors for the pages of documents, the other queries derive five arms from
each page: the text as it is, with its non-ASCII signs lost, its lines in reverse order,
its white space collapsed, and a reference that reads Devanagari throughout.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarazu.functions import signals as s
from tarazu.operators import arms as ar
from tarazu.operators import inventory as fi
from tarazu.plans.audit_queries import AUDIT, PAGES, _audit
from tarazu.plans.label_queries import _V, _observations, _verdicts
from tarazu.session import spread, table

ARMS = ("as_is", "ascii_only", "lines_reversed", "blanks_collapsed", "ocr")
LATIN, DEVA = "aeioukmnprst", "".join(chr(0x915 + i) for i in range(12))


def _arms(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents").select("doc_id", "issuing_body", "lang", "text"), "doc_id")
    bodies = docs.select("doc_id", F.coalesce("issuing_body", F.lit("unknown")).alias("body"), "lang", "text")
    t = F.coalesce("page_text", F.lit(""))
    arms = {
        "as_is": t,
        "ascii_only": F.regexp_replace(t, "[^\\x00-\\x7F]", "�"),
        "lines_reversed": F.array_join(F.reverse(F.split(t, "\n")), "\n"),
        "blanks_collapsed": F.regexp_replace(t, "[ \\t\\n]+", " "),
        "ocr": F.when(F.col("lang") == "en", t).otherwise(F.translate(t, LATIN, DEVA)),
    }
    pages = bodies.select("doc_id", "body", "lang", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\f")).alias("page", "page_text"))
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("arm"), v.alias("arm_text")) for k, v in arms.items())))
    return pages.select("doc_id", "body", (F.col("page") + 1).alias("page"), each.alias("x")).select("doc_id", "body", "page", "x.*")


def _measured(spark: SparkSession, d: str) -> DataFrame:
    return s.with_page_measures(_arms(spark, d), "arm_text")


def _structured(spark: SparkSession, d: str) -> DataFrame:
    got = s.with_text_signals(_measured(spark, d), "arm_text")
    return got.drop("arm_text")


def _failed(docs: DataFrame, text: str, *arms: str) -> DataFrame:
    """Error rows: documents that could not be read, once for each arm that tried."""
    return docs.where(F.col(text).isNull()).select(F.explode(F.array(*map(F.lit, arms))).alias("arm"))


def arm_loss_report(spark: SparkSession, d: str) -> DataFrame:
    return ar.loss_report(_measured(spark, d), _failed(table(spark, d, "documents"), "text", *ARMS))


PAGE_ARMS = {"text": "legacy_text", "ocr": "ocr_text", "typed": "human_text"}


def _page_arms(spark: SparkSession, d: str) -> DataFrame:
    """The texts of each transcribed page, one row an arm; an arm that gave none has no row."""
    t = spread(table(spark, d, "transcription").dropDuplicates(["transcription_id"]).select("transcription_id", "page", "family_id", *PAGE_ARMS.values()), "transcription_id")
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("arm"), F.col(c).alias("arm_text")) for k, c in PAGE_ARMS.items())))
    rows = t.select(F.col("transcription_id").alias("doc_id"), F.coalesce("page", F.lit(0)).alias("page"), F.coalesce("family_id", F.lit("unknown")).alias("body"), each.alias("x"))
    return rows.select("doc_id", "page", "body", "x.*").where("arm_text IS NOT NULL")


def _page_measured(spark: SparkSession, d: str) -> DataFrame:
    return s.with_page_measures(_page_arms(spark, d), "arm_text")


def page_loss_report(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "transcription").dropDuplicates(["transcription_id"])
    errors = [_failed(t, c, k) for k, c in PAGE_ARMS.items()]
    return ar.loss_report(_page_measured(spark, d), errors[0].unionByName(errors[1]).unionByName(errors[2]))


def page_concordance_report(spark: SparkSession, d: str) -> DataFrame:
    return ar.concordance_report(ar.concordance(_page_measured(spark, d)))


def page_structural_report(spark: SparkSession, d: str) -> DataFrame:
    return ar.structural_report(s.with_text_signals(_page_measured(spark, d), "arm_text").drop("arm_text"))


def page_pairwise_agreement(spark: SparkSession, d: str) -> DataFrame:
    return ar.pairwise_agreement(_page_measured(spark, d))


def page_usable(spark: SparkSession, d: str) -> DataFrame:
    return ar.usable_pages(ar.concordance(s.with_text_signals(_page_measured(spark, d), "arm_text").drop("arm_text")))


def font_extraction_measured(spark: SparkSession, d: str) -> DataFrame:
    """The samples of both font arms measured again: characters, share of Devanagari, hash, loss."""
    key = ["run_id", "sha256", "font_name", "arm"]
    rows = spread(table(spark, d, "font_extraction").dropDuplicates(key).select(*key, "text_sample"), "sha256")
    got = s.with_page_measures(rows, "text_sample")
    # Shown beside the figures: the first characters, here as a hash.
    return got.select(*key, F.col("n_chars").alias("sample_chars"), F.round("dev_share", 9).alias("dev_share"), "text_hash", "loss", F.md5("head").alias("head_md5"))


def extraction_with_sample(spark: SparkSession, d: str) -> DataFrame:
    """Font extractions by the stratum their file was drawn under in the same run, drawn or not."""
    key = ["run_id", "sha256"]
    drawn = table(spark, d, "extraction_sample").groupBy(*key).agg(F.max(F.lower(F.trim("stratum"))).alias("stratum"))
    rows = table(spark, d, "font_extraction").select(*key, "font_name", "arm").distinct()
    got = rows.join(drawn.withColumn("in_sample", F.lit(True)), key, "left")
    return got.groupBy("run_id", "stratum").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("in_sample", F.lit(False))).alias("n_drawn"))


def inventory_vs_spans(spark: SparkSession, d: str) -> DataFrame:
    """Fonts of the inventory against fonts whose text was read, by name in a file: both, or one of them."""
    inventory = fi.collapse(table(spark, d, "font_observation").dropDuplicates(["obs_id"]), "obs_id")
    spans = table(spark, d, "font_extraction").groupBy("sha256", "font_name").agg(F.max("n_chars").alias("n_chars"))
    got = fi.observed(inventory, spans)
    return got.groupBy("seen").agg(F.count(F.lit(1)).alias("n_fonts"), F.sum(F.coalesce("n_chars", F.lit(0))).alias("n_chars"), F.sum(F.coalesce("n_pages", F.lit(0))).alias("n_pages"))


def arm_gate_sweep_ratio(spark: SparkSession, d: str) -> DataFrame:
    return ar.gate_sweep(_measured(spark, d), "replacement_ratio")


def arm_gate_sweep_chars(spark: SparkSession, d: str) -> DataFrame:
    return ar.gate_sweep(_measured(spark, d), "n_chars")


def concordance_pairs(spark: SparkSession, d: str) -> DataFrame:
    got = ar.concordance(_measured(spark, d))
    return got.select("doc_id", "page", "arm", F.round("dev_share", 9).alias("dev_share"), F.round("dev_share_ref", 9).alias("dev_share_ref"), "concordance")


def concordance_report(spark: SparkSession, d: str) -> DataFrame:
    return ar.concordance_report(ar.concordance(_measured(spark, d)))


def concordance_vs_verdict(spark: SparkSession, d: str) -> DataFrame:
    """Script mismatches of one arm by the verdict of the page's file."""
    pairs = ar.concordance(_measured(spark, d)).where((F.col("arm") == "ascii_only") & F.col("concordance").isin(*ar.SCORED))
    files = table(spark, d, "documents").select("doc_id", "sha256").join(_audit(spark, d).select("sha256", "verdict"), "sha256", "left").select("doc_id", "verdict")
    got = pairs.join(files, "doc_id", "left").groupBy(F.coalesce("verdict", F.lit("?")).alias("verdict"))
    return got.agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("concordance") == "script_mismatch").alias("mismatch"))


def structural_report(spark: SparkSession, d: str) -> DataFrame:
    return ar.structural_report(_structured(spark, d))


def pairwise_agreement(spark: SparkSession, d: str) -> DataFrame:
    return ar.pairwise_agreement(_measured(spark, d))


def all_arms_identical(spark: SparkSession, d: str) -> DataFrame:
    return ar.all_arms_identical(_measured(spark, d))


def composite_usable_pages(spark: SparkSession, d: str) -> DataFrame:
    return ar.usable_pages(ar.concordance(_structured(spark, d)))


def font_arm_agreement_by_label(spark: SparkSession, d: str) -> DataFrame:
    """The two arms of font_extraction by the adjudicated label of the font."""
    key = F.concat_ws("|", "sha256", "font_name")
    fonts = table(spark, d, "font_extraction").select(F.concat_ws("|", "run_id", "sha256", "font_name").alias("k0"), key.alias("font"), "arm", "text_hash", "bag_hash").distinct()
    truth = _observations(spark, d).join(_verdicts(spark, d).where("final_label IS NOT NULL"), "obs_id").select(key.alias("font"), F.col("final_label").alias("label"))
    labels = fonts.select("font", F.col("k0").alias("key")).distinct().join(truth, "font").select("key", "label")
    return ar.font_agreement(fonts.withColumnRenamed("k0", "key"), labels)


QUERIES = {
    f.__name__: f
    for f in (
        arm_loss_report, arm_gate_sweep_ratio, arm_gate_sweep_chars, concordance_pairs, concordance_report, concordance_vs_verdict,
        structural_report, pairwise_agreement, all_arms_identical, composite_usable_pages, font_arm_agreement_by_label,
        page_loss_report, page_concordance_report, page_structural_report, page_pairwise_agreement, page_usable,
        font_extraction_measured, extraction_with_sample, inventory_vs_spans,
    )
}

_ARMS = f"""arms AS (SELECT doc_id, page, coalesce(issuing_body, 'unknown') AS body, arm, CASE arm WHEN 'as_is' THEN t WHEN 'ascii_only' THEN regexp_replace(t, '[^\\x00-\\x7F]', chr(65533), 'g')
 WHEN 'lines_reversed' THEN array_to_string(list_reverse(string_split(t, chr(10))), chr(10)) WHEN 'blanks_collapsed' THEN regexp_replace(t, '[ \\t\\n]+', ' ', 'g') ELSE CASE WHEN lang = 'en' THEN t ELSE translate(t, '{LATIN}', '{DEVA}') END END AS arm_text
 FROM (SELECT p.doc_id, p.page, page_text AS t, d.issuing_body, d.lang, unnest(['as_is', 'ascii_only', 'lines_reversed', 'blanks_collapsed', 'ocr']) AS arm FROM {PAGES} p JOIN documents d USING (doc_id)))"""
_TR = "(SELECT DISTINCT ON (transcription_id) * FROM transcription)"
_PAGE_ARMS = "arms AS (" + " UNION ALL ".join(f"SELECT transcription_id AS doc_id, coalesce(page, 0) AS page, coalesce(family_id, 'unknown') AS body, '{k}' AS arm, {c} AS arm_text FROM {_TR} WHERE {c} IS NOT NULL" for k, c in PAGE_ARMS.items()) + ")"
_M = f"{_ARMS}, m AS (SELECT * EXCLUDE (b_) FROM {s.sql_page_measures('arms', 'arm_text')})"
_S = f"{_ARMS}, m AS (SELECT * FROM {s.sql_text_signals('(SELECT * EXCLUDE (b_) FROM ' + s.sql_page_measures('arms', 'arm_text') + ')', 'arm_text')})"
_CONC = f"""r AS (SELECT doc_id, page, dev_share AS dev_share_ref, loss AS loss_ref, true AS has_ref FROM m WHERE arm = 'ocr'),
c AS (SELECT m.*, dev_share_ref, CASE WHEN loss IS NOT NULL THEN 'loss' WHEN has_ref IS NULL OR loss_ref IS NOT NULL THEN 'no_reference' WHEN dev_share_ref >= {ar.OCR_DEVA_PRESENT} AND dev_share < {ar.ARM_DEVA_ABSENT} THEN 'script_mismatch'
 WHEN dev_share_ref < {ar.ARM_DEVA_ABSENT} AND dev_share >= {ar.OCR_DEVA_PRESENT} THEN 'script_excess' ELSE 'match' END AS concordance FROM m LEFT JOIN r USING (doc_id, page) WHERE arm <> 'ocr')"""


_DOC_ERRORS = f"er AS (SELECT arm, count(*) AS errors FROM documents, (SELECT unnest({list(ARMS)}) AS arm) WHERE text IS NULL GROUP BY arm)"
_PAGE_ERRORS = "er AS (" + " UNION ALL ".join(f"SELECT '{k}' AS arm, count(*) AS errors FROM {_TR} WHERE {c} IS NULL" for k, c in PAGE_ARMS.items()) + ")"


def _sql_macro(rows: str, hit: str, among: str, name: str) -> str:
    return f"(SELECT arm, round(avg(num / den::DOUBLE), 6) AS {name} FROM (SELECT arm, body, count_if({among}) AS den, count_if({among} AND {hit}) AS num FROM {rows} GROUP BY 1, 2) WHERE den > 0 GROUP BY arm)"


def _sql_gate(column: str) -> str:
    grid = ar.CHARS_GRID if column == "n_chars" else ar.RATIO_GRID
    op = "<" if column == "n_chars" else ">="
    return f"WITH {_M} SELECT arm, t AS threshold, round(count_if({column} {op} t) / count(*)::DOUBLE, 6) AS fail_share FROM m, (SELECT unnest({[float(x) for x in grid]}::DOUBLE[]) AS t) GROUP BY arm, t"


SQL = {
    "arm_loss_report": f"""WITH {_M}, {_DOC_ERRORS} SELECT a.*, fail_macro, coalesce(errors, 0)::BIGINT AS errors FROM (SELECT arm, count(*) AS pages, round(sum(n_chars) / count(*)::DOUBLE, 6) AS chars_per_page, round(count_if(coalesce(loss = 'empty', false)) / count(*)::DOUBLE, 6) AS empty_share,
 round(sum(replacement_chars) / greatest(sum(n_chars), 1)::DOUBLE, 9) AS replacement_share, round(sum(control_chars) / greatest(sum(n_chars), 1)::DOUBLE, 9) AS control_share, round(count_if(loss IS NOT NULL) / count(*)::DOUBLE, 6) AS fail_share FROM m GROUP BY arm) a
 JOIN {_sql_macro('m', 'loss IS NOT NULL', 'true', 'fail_macro')} USING (arm) LEFT JOIN er USING (arm)""",
    "arm_gate_sweep_ratio": _sql_gate("replacement_ratio"),
    "arm_gate_sweep_chars": _sql_gate("n_chars"),
    "concordance_pairs": f"WITH {_M}, {_CONC} SELECT doc_id, page, arm, round(dev_share, 9) AS dev_share, round(dev_share_ref, 9) AS dev_share_ref, concordance FROM c",
    "concordance_report": f"""WITH {_M}, {_CONC}, g AS (SELECT arm, count_if(concordance IN {ar.SCORED})::BIGINT AS scored, count_if(concordance = 'match') AS k, count_if(concordance = 'script_mismatch') AS x, count_if(concordance = 'script_excess') AS e,
 count_if(concordance = 'no_reference')::BIGINT AS no_reference, count_if(concordance = 'loss')::BIGINT AS loss FROM c GROUP BY arm)
SELECT arm, scored, round(k / greatest(scored, 1)::DOUBLE, 6) AS match_share, round(x / greatest(scored, 1)::DOUBLE, 6) AS mismatch_share, round(e / greatest(scored, 1)::DOUBLE, 6) AS excess_share, no_reference, loss, mismatch_macro
FROM g LEFT JOIN {_sql_macro('c', "concordance = 'script_mismatch'", f'concordance IN {ar.SCORED}', 'mismatch_macro')} USING (arm)""",
    "concordance_vs_verdict": f"""WITH {_M}, {_CONC}, {AUDIT} SELECT coalesce(verdict, '?') AS verdict, count(*) AS pages, count_if(concordance = 'script_mismatch')::BIGINT AS mismatch
FROM c JOIN (SELECT doc_id, sha256 FROM documents) USING (doc_id) LEFT JOIN (SELECT sha256, verdict FROM audit) USING (sha256) WHERE arm = 'ascii_only' AND concordance IN {ar.SCORED} GROUP BY 1""",
    "structural_report": f"""WITH {_S}, k AS (SELECT * FROM m WHERE loss IS NULL AND dev_chars >= {s.MIN_DEV_CHARS}) SELECT a.*, invalid_macro FROM (SELECT arm, count(*) AS scored, round(count_if(invalid_rate_per_1k >= {ar.INVALID_MAX}) / count(*)::DOUBLE, 6) AS invalid_share,
 round(avg(invalid_rate_per_1k), 6) AS mean_rate, round(count_if(invalid_matras > invalid_matras_nospace) / count(*)::DOUBLE, 6) AS spurious_space_share FROM k GROUP BY arm) a JOIN {_sql_macro('k', f'invalid_rate_per_1k >= {ar.INVALID_MAX}', 'true', 'invalid_macro')} USING (arm)""",
    "pairwise_agreement": f"""WITH {_M}, k AS (SELECT * FROM m WHERE arm <> 'ocr' AND loss IS NULL) SELECT x.arm AS arm_a, y.arm AS arm_b, count(*) AS pages, count_if(x.text_hash = y.text_hash)::BIGINT AS identical,
 count_if(x.text_hash <> y.text_hash AND x.bag_hash = y.bag_hash)::BIGINT AS same_characters, count_if(x.text_hash <> y.text_hash AND x.bag_hash <> y.bag_hash)::BIGINT AS differ FROM k x JOIN k y ON x.doc_id = y.doc_id AND x.page = y.page AND x.arm < y.arm GROUP BY 1, 2""",
    "all_arms_identical": f"WITH {_M} SELECT count(*) AS pages, count_if(h = 1)::BIGINT AS identical FROM (SELECT count(*) AS k, count(DISTINCT text_hash) AS h FROM m WHERE arm <> 'ocr' AND loss IS NULL GROUP BY doc_id, page) WHERE k >= 2",
    "composite_usable_pages": f"""WITH {_S}, {_CONC}, w AS (SELECT arm, body, CASE WHEN loss IS NOT NULL THEN 'loss' WHEN concordance IN ('script_mismatch', 'script_excess') THEN 'script' WHEN dev_chars >= {s.MIN_DEV_CHARS} AND invalid_rate_per_1k >= {ar.INVALID_MAX} THEN 'structural' ELSE 'usable' END AS why FROM c)
SELECT a.*, usable_macro FROM (SELECT arm, count(*) AS pages, round(count_if(why = 'usable') / count(*)::DOUBLE, 6) AS usable_share, count_if(why = 'loss')::BIGINT AS by_loss, count_if(why = 'script')::BIGINT AS by_script, count_if(why = 'structural')::BIGINT AS by_structural FROM w GROUP BY arm) a
JOIN {_sql_macro('w', "why = 'usable'", 'true', 'usable_macro')} USING (arm)""",
    "font_arm_agreement_by_label": f"""WITH {_V}, f AS (SELECT DISTINCT run_id, sha256, font_name, arm, text_hash, bag_hash FROM font_extraction),
per AS (SELECT run_id, sha256, font_name, count(DISTINCT arm) AS k, count(DISTINCT text_hash) AS h, count(DISTINCT bag_hash) AS b FROM f GROUP BY 1, 2, 3),
l AS (SELECT sha256, font_name, final_label FROM (SELECT DISTINCT ON (obs_id) * FROM font_observation) JOIN v USING (obs_id) WHERE final_label IS NOT NULL)
SELECT coalesce(final_label, '(unlabelled)') AS label, count(*) AS fonts, count_if(k >= 2 AND h = 1)::BIGINT AS identical, count_if(k >= 2 AND h > 1 AND b = 1)::BIGINT AS same_characters, count_if(k >= 2 AND h > 1 AND b > 1)::BIGINT AS differ, count_if(k < 2)::BIGINT AS one_arm
FROM per LEFT JOIN l USING (sha256, font_name) GROUP BY 1""",
}


def _of_pages(name: str) -> str:
    """The same SQL over the real arms of the pages."""
    return SQL[name].replace(_ARMS, _PAGE_ARMS).replace(_DOC_ERRORS, _PAGE_ERRORS)


SQL |= {
    "page_loss_report": _of_pages("arm_loss_report"),
    "page_concordance_report": _of_pages("concordance_report"),
    "page_structural_report": _of_pages("structural_report"),
    "page_pairwise_agreement": _of_pages("pairwise_agreement"),
    "page_usable": _of_pages("composite_usable_pages"),
    "font_extraction_measured": f"SELECT run_id, sha256, font_name, arm, n_chars AS sample_chars, round(dev_share, 9) AS dev_share, text_hash, loss, md5(substr(coalesce(text_sample, ''), 1, {s.HEAD_CHARS})) AS head_md5 FROM {s.sql_page_measures('(SELECT DISTINCT ON (run_id, sha256, font_name, arm) run_id, sha256, font_name, arm, text_sample FROM font_extraction)', 'text_sample')}",
    "extraction_with_sample": """SELECT run_id, stratum, count(*) AS n, count_if(coalesce(x, false))::BIGINT AS n_drawn FROM (SELECT DISTINCT run_id, sha256, font_name, arm FROM font_extraction)
LEFT JOIN (SELECT run_id, sha256, max(lower(trim(stratum))) AS stratum, true AS x FROM extraction_sample GROUP BY 1, 2) USING (run_id, sha256) GROUP BY 1, 2""",
    "inventory_vs_spans": f"""WITH i AS (SELECT sha256, font_name, sum(n_pages_seen)::BIGINT AS n_pages FROM (SELECT DISTINCT ON (obs_id) * FROM font_observation) GROUP BY 1, 2),
s AS (SELECT sha256, font_name, max(n_chars) AS n_chars FROM font_extraction GROUP BY 1, 2),
j AS (SELECT n_pages, n_chars, i.sha256 IS NOT NULL AS a, s.sha256 IS NOT NULL AS b FROM i FULL JOIN s ON i.sha256 = s.sha256 AND i.font_name IS NOT DISTINCT FROM s.font_name)
SELECT CASE WHEN a AND b THEN 'both' WHEN a THEN 'inventory only' ELSE 'spans only' END AS seen, count(*) AS n_fonts, sum(coalesce(n_chars, 0))::BIGINT AS n_chars, sum(coalesce(n_pages, 0))::BIGINT AS n_pages FROM j GROUP BY 1""",
}
