"""Draws, the label workflow, and evaluation against adjudicated labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarazu.functions import fonts as fn
from tarazu.functions import labels as lb
from tarazu.operators import labels as wf
from tarazu.operators import sampling as sp
from tarazu.operators import stats as st
from tarazu.operators.dedupe import pick
from tarazu.session import table

SEED, SAMPLE, ANNOTATOR = 20250301, "gt-v1", "ann-01"
# How many observations each stratum is drawn.
QUOTAS = {
    "positive/name_legacy": 50,
    "positive/name_known_good": 50,
    "positive/name_uninformative": 100,
    "no_evidence/name_legacy": 50,
    "no_evidence/name_known_good": 100,
    "no_evidence/name_uninformative": 100,
}
CAP = 40


def _observations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "font_observation").dropDuplicates(["obs_id"])


def _judgements(spark: SparkSession, d: str) -> DataFrame:
    return wf.judgements(table(spark, d, "annotation"))


def _frame(spark: SparkSession, d: str) -> DataFrame:
    """Per draw and observation the stratum it was last drawn under."""
    rows = table(spark, d, "annotation_sample").select("sample_id", "obs_id", lb.same_stratum(F.col("stratum")).alias("stratum"), "stratum_size", "created_at")
    return pick(rows, ["sample_id", "obs_id"], ["created_at", "stratum"], last=True)


def _verdicts(spark: SparkSession, d: str) -> DataFrame:
    return wf.verdicts(_judgements(spark, d).where("round = 1"))


def _truth(spark: SparkSession, d: str) -> DataFrame:
    """Observations with an uncontested label: the ground truth of the detector scores."""
    return _observations(spark, d).join(_verdicts(spark, d).where("final_label IS NOT NULL").select("obs_id", "final_label", "basis"), "obs_id")


def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    o = _observations(spark, d)
    stratum = F.concat_ws("/", fn.detector_axis(F.col("detector_label")), fn.name_axis(F.col("font_name")))
    rows = o.where(fn.detector_axis(F.col("detector_label")).isNotNull()).select("obs_id", stratum.alias("stratum"))
    got = sp.stratified_draw(rows, "stratum", "obs_id", QUOTAS, SEED)
    return got.withColumn("selection_prob", F.round("selection_prob", 9))


def per_source_capped_sample(spark: SparkSession, d: str) -> DataFrame:
    """One row per file, at most CAP files of each source key."""
    f = pick(table(spark, d, "documents").where("sha256 IS NOT NULL AND source_key IS NOT NULL").select("sha256", "source_key", "doc_id"), ["sha256"], ["doc_id"])
    return sp.capped_sample(f, "source_key", "sha256", CAP, SEED).select("source_key", "sha256", "doc_id")


def sample_frame(spark: SparkSession, d: str) -> DataFrame:
    f = pick(table(spark, d, "documents").where("sha256 IS NOT NULL AND issuing_body IS NOT NULL").select("sha256", "issuing_body", "doc_id"), ["sha256"], ["doc_id"])
    got = sp.frame(sp.capped_sample(f, "issuing_body", "sha256", CAP, SEED), f, "issuing_body")
    return got.withColumn("selection_prob", F.round("selection_prob", 9))


def tiered_selection(spark: SparkSession, d: str) -> DataFrame:
    """Files with a labelled observation first (whole), then a capped draw of the others per body."""
    f = pick(table(spark, d, "documents").where("sha256 IS NOT NULL AND issuing_body IS NOT NULL").select("sha256", "issuing_body", "doc_id"), ["sha256"], ["doc_id"])
    labelled = _frame(spark, d).where(F.col("sample_id") == SAMPLE).select("obs_id").join(_observations(spark, d).select("obs_id", "sha256"), "obs_id").select("sha256").distinct()
    first = f.join(labelled, "sha256", "left_semi").select("sha256", F.lit("labelled").alias("tier"))
    rest = sp.capped_sample(f.join(labelled, "sha256", "left_anti"), "issuing_body", "sha256", 5, SEED).select("sha256", F.lit("coverage").alias("tier"))
    return first.unionByName(rest)


def discard_and_redraw(spark: SparkSession, d: str) -> DataFrame:
    """Drop one source's files and draw it again under another seed; other sources stay."""
    f = pick(table(spark, d, "documents").where("sha256 IS NOT NULL AND source_key IS NOT NULL").select("sha256", "source_key", "source", "doc_id"), ["sha256"], ["doc_id"])
    old = sp.capped_sample(f, "source", "sha256", CAP, SEED)
    new = sp.capped_sample(f.where("source = 'portal'"), "source", "sha256", CAP, SEED + 1)
    return old.where("source != 'portal'").unionByName(new).select("source", "sha256")


def pending_anti_join(spark: SparkSession, d: str) -> DataFrame:
    frame = _frame(spark, d).where(F.col("sample_id") == SAMPLE)
    return wf.pending(frame, _judgements(spark, d), ANNOTATOR, 1)


def deep_semi_join(spark: SparkSession, d: str) -> DataFrame:
    """Observations of files that have at least one deeply read font."""
    o = _observations(spark, d)
    deep = o.where(F.col("signals_version").endswith("+deep")).select("sha256").distinct()
    return o.join(deep, "sha256", "left_semi").select("obs_id", "sha256", "signals_version")


def next_card_round2(spark: SparkSession, d: str) -> DataFrame:
    """The next 20 cards of the second round (a top-k)."""
    frame = _frame(spark, d).where(F.col("sample_id") == SAMPLE)
    got = wf.pending(frame, _judgements(spark, d), ANNOTATOR, 2).join(_observations(spark, d).select("obs_id", "sampled_chars", "n_pages_seen"), "obs_id")
    return got.orderBy(*wf.card_order(2)).limit(20)


def adjudication_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return _verdicts(spark, d)


def _rounds(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(table after the first draw's pass with single labels, verdicts of all votes)."""
    j = _judgements(spark, d)
    early = wf.verdicts(j.where("round = 1 AND sample_id = 'gt-v1'"))
    empty = early.select("obs_id", "final_label", "basis", F.lit(None).cast("string").alias("adjudicator")).where("false")
    return wf.next_state(empty, early, include_single=True), wf.verdicts(j.where("round = 1"))


def adjudication_next_state(spark: SparkSession, d: str) -> DataFrame:
    return wf.next_state(*_rounds(spark, d))


def next_disagreement(spark: SparkSession, d: str) -> DataFrame:
    """The first 20 observations that wait for an adjudicator (a top-k)."""
    return _verdicts(spark, d).where("basis = 'disagreed'").orderBy("obs_id").limit(20).select("obs_id", "n", "n_labels")


def adjudication_progress(spark: SparkSession, d: str) -> DataFrame:
    frame = _frame(spark, d).select("sample_id", "obs_id")
    got = frame.join(_verdicts(spark, d), "obs_id", "left")
    return got.groupBy("sample_id", F.coalesce("basis", F.lit("pending")).alias("basis")).agg(F.count(F.lit(1)).alias("n"))


def labelling_progress(spark: SparkSession, d: str) -> DataFrame:
    own = _judgements(spark, d).where((F.col("annotator") == ANNOTATOR) & (F.col("round") == 1)).select("obs_id", F.lit(1).alias("done"))
    return _frame(spark, d).join(own, "obs_id", "left").groupBy("sample_id", "stratum").agg(F.count(F.lit(1)).alias("n"), F.count("done").alias("done"))


def label_distribution(spark: SparkSession, d: str) -> DataFrame:
    return _judgements(spark, d).groupBy("annotator", "round", "label").agg(F.count(F.lit(1)).alias("n"))


def judgement_validation(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "annotation").dropDuplicates(["annotation_id"])
    return wf.validated(rows).groupBy(F.coalesce("refused", F.lit("accepted")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def document_truth(spark: SparkSession, d: str) -> DataFrame:
    return wf.document_truth(_truth(spark, d).select("sha256", "final_label"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    j = _judgements(spark, d).where("round = 1")
    a = j.where(F.col("annotator") == ANNOTATOR).select("obs_id", F.col("label").alias("a"))
    return a.join(j.where(F.col("annotator") != ANNOTATOR).select("obs_id", F.col("annotator").alias("other"), F.col("label").alias("b")), "obs_id")


def kappa_overall(spark: SparkSession, d: str) -> DataFrame:
    """One annotator against each other one, round 1."""
    return st.kappa(_pairs(spark, d), ["other"])


def _round_pairs(spark: SparkSession, d: str) -> DataFrame:
    j = _judgements(spark, d)
    a = j.where("round = 1").select("obs_id", "annotator", F.col("label").alias("a"))
    return a.join(j.where("round = 2").select("obs_id", "annotator", F.col("label").alias("b")), ["obs_id", "annotator"])


def kappa_intra(spark: SparkSession, d: str) -> DataFrame:
    """Every annotator's second round against their first."""
    return st.kappa(_round_pairs(spark, d), ["annotator"])


def kappa_per_class_all(spark: SparkSession, d: str) -> DataFrame:
    """Per class: one annotator against each other one in round 1, and every annotator's second round against their first."""
    inter = _pairs(spark, d).select(F.lit(ANNOTATOR).alias("annotator"), "other", F.lit("between").alias("kind"), "a", "b")
    intra = _round_pairs(spark, d).select("annotator", F.col("annotator").alias("other"), F.lit("rounds").alias("kind"), "a", "b")
    return st.kappa_per_class(inter.unionByName(intra), ["kind", "annotator", "other"])


def kappa_per_class(spark: SparkSession, d: str) -> DataFrame:
    """One annotator against all others together; ``kappa_per_class_all`` has each pair and both rounds."""
    return st.kappa_per_class(_pairs(spark, d))


def manual_resolution(spark: SparkSession, d: str) -> DataFrame:
    """The adjudication table after disagreements were settled by hand, as the first annotator labelled them."""
    v = _verdicts(spark, d)
    current = v.where("final_label IS NOT NULL").select("obs_id", "final_label", "basis", F.lit("auto").alias("adjudicator"))
    own = _judgements(spark, d).where((F.col("annotator") == ANNOTATOR) & (F.col("round") == 1)).select("obs_id", F.col("label").alias("final_label"))
    by_hand = v.where("final_label IS NULL").select("obs_id").join(own, "obs_id").withColumns({"adjudicator": F.lit(ANNOTATOR), "note": F.lit("looked at again")})
    return wf.resolve(current, by_hand)


def ground_truth_view(spark: SparkSession, d: str) -> DataFrame:
    """Uncontested observations with their label and the draws they came from, if any."""
    t = _truth(spark, d).select("obs_id", "detector_label", "final_label", "basis")
    return t.join(_frame(spark, d).select("obs_id", "sample_id", "stratum"), "obs_id", "left")


def detector_binary_prf(spark: SparkSession, d: str) -> DataFrame:
    return st.binary_score(_truth(spark, d), F.col("detector_label").isin(*fn.POSITIVE), F.col("final_label").isin(*fn.POSITIVE))


def detector_per_class_prf(spark: SparkSession, d: str) -> DataFrame:
    return st.per_class_score(_truth(spark, d))


def confusion_top(spark: SparkSession, d: str) -> DataFrame:
    return st.confusion(_truth(spark, d))


def _sweep(signal: str):
    return lambda spark, d: st.sweep(_truth(spark, d), signal)


SWEEPS = {f"threshold_sweep_{x}": x for x in st.SIGNAL_TARGET}


def stratified_estimate(spark: SparkSession, d: str) -> DataFrame:
    """The rate of affected observations, weighted back from the first draw's strata."""
    v = _verdicts(spark, d).where("final_label IS NOT NULL").select("obs_id", "final_label")
    rows = _frame(spark, d).where((F.col("sample_id") == SAMPLE) & F.col("stratum").isNotNull()).join(v, "obs_id")
    strata = rows.groupBy("stratum").agg(F.max("stratum_size").alias("stratum_size"), F.count(F.lit(1)).alias("drawn"), F.count_if(F.col("final_label").isin(*fn.POSITIVE)).alias("positive"))
    return st.stratified_estimate(strata)


QUERIES = {
    f.__name__: f
    for f in (
        stratified_sample, per_source_capped_sample, sample_frame, tiered_selection, discard_and_redraw, pending_anti_join, deep_semi_join, next_card_round2,
        adjudication_verdicts, adjudication_next_state, next_disagreement, adjudication_progress, labelling_progress, label_distribution, judgement_validation,
        document_truth, kappa_overall, kappa_intra, kappa_per_class, kappa_per_class_all, ground_truth_view, manual_resolution, detector_binary_prf, detector_per_class_prf, confusion_top, stratified_estimate,
    )
} | {name: _sweep(x) for name, x in SWEEPS.items()}

OBS = "(SELECT DISTINCT ON (obs_id) * FROM font_observation)"
_FILES = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sha256 ORDER BY doc_id) AS rn FROM documents WHERE sha256 IS NOT NULL{}) WHERE rn = 1"
_JUDGED = f"""j AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY obs_id, annotator, round ORDER BY annotated_at DESC NULLS LAST, annotation_id DESC) AS rn FROM
 (SELECT annotation_id, obs_id, sample_id, {lb.SQL_ANNOTATOR} AS annotator, round, {lb.SQL_LABEL} AS label, annotated_at FROM annotation) WHERE obs_id IS NOT NULL AND annotator IS NOT NULL AND label IS NOT NULL) WHERE rn = 1)"""
_FRAME = """fr AS (SELECT sample_id, obs_id, stratum, stratum_size FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, obs_id ORDER BY created_at DESC, stratum DESC NULLS LAST) AS rn FROM
 (SELECT sample_id, obs_id, lower(trim(stratum)) AS stratum, stratum_size, created_at FROM annotation_sample)) WHERE rn = 1)"""


def _sql_verdicts(name: str, where: str) -> str:
    return f"""{name} AS (SELECT obs_id, count(*) AS n, count(DISTINCT label) AS n_labels, CASE WHEN count(*) = 1 THEN 'single' WHEN count(DISTINCT label) = 1 THEN 'unanimous' ELSE 'disagreed' END AS basis,
 CASE WHEN count(DISTINCT label) = 1 THEN min(label) END AS final_label FROM j WHERE {where} GROUP BY obs_id)"""


_V = f"{_JUDGED}, {_sql_verdicts('v', 'round = 1')}"
_T = f"{_V}, truth AS (SELECT o.*, v.final_label, v.basis FROM {OBS} o JOIN v USING (obs_id) WHERE v.final_label IS NOT NULL)"


def _sql_ranked(rows: str, group: str, member: str, seed: int) -> str:
    return f"(SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY md5('{seed}:' || {group} || ':' || {member}), {member}) AS draw_rank FROM ({rows}))"


def _sql_prf(tp: str, fp: str, fn_: str) -> str:
    p = f"(CASE WHEN {tp} + {fp} > 0 THEN {tp} / ({tp} + {fp})::DOUBLE ELSE 0.0::DOUBLE END)"
    r = f"(CASE WHEN {tp} + {fn_} > 0 THEN {tp} / ({tp} + {fn_})::DOUBLE ELSE 0.0::DOUBLE END)"
    return f'round({p}, 6) AS "precision", round({r}, 6) AS recall, round(CASE WHEN {p} + {r} > 0 THEN 2 * {p} * {r} / ({p} + {r}) ELSE 0.0::DOUBLE END, 6) AS f1'


def _sql_kappa(pairs: str, by: str) -> str:
    return f"""WITH {_JUDGED}, pairs AS ({pairs}),
t AS (SELECT {by}, count(*) AS n, count_if(a = b) AS same FROM pairs GROUP BY {by}),
m AS (SELECT {by}, label, sum(x) AS na, sum(y) AS nb FROM (SELECT {by}, a AS label, 1 AS x, 0 AS y FROM pairs UNION ALL SELECT {by}, b, 0, 1 FROM pairs) GROUP BY {by}, label),
c AS (SELECT {by}, sum(na * nb) AS chance FROM m GROUP BY {by}),
k AS (SELECT {by}, n, same / n::DOUBLE AS o, chance / (n * n)::DOUBLE AS e FROM t JOIN c USING ({by}))
SELECT {by}, n, round(o, 6) AS agreement, CASE WHEN e < 1 - 1e-12 THEN round((o - e) / (1 - e), 6) END AS kappa FROM k"""


_PAIRS = f"SELECT x.obs_id, y.annotator AS other, x.label AS a, y.label AS b FROM j x JOIN j y USING (obs_id) WHERE x.annotator = '{ANNOTATOR}' AND y.annotator <> '{ANNOTATOR}' AND x.round = 1 AND y.round = 1"


def _sql_sweep(signal: str) -> str:
    hit = f"final_label = '{st.SIGNAL_TARGET[signal]}'"
    return f"""WITH {_T}, r AS (SELECT {signal}::DOUBLE AS v, {hit} AS hit FROM truth WHERE {signal} IS NOT NULL), e AS (SELECT min(v) AS lo, max(v) AS hi, count_if(hit) AS total FROM r),
l AS (SELECT s::INT AS step, lo + (hi - lo) * s / 20 AS t, total FROM e, range(0, 21) x(s) WHERE hi > lo),
g AS (SELECT step, t, total, count_if(v >= t AND hit)::BIGINT AS tp, count_if(v >= t AND NOT hit)::BIGINT AS fp FROM l, r GROUP BY ALL)
SELECT step, round(t, 9) AS threshold, tp, fp, (total - tp)::BIGINT AS fn, {_sql_prf('tp', 'fp', '(total - tp)')} FROM g"""


_STRATUM = f"""(SELECT obs_id, CASE WHEN detector_label IN {fn.POSITIVE} THEN 'positive' ELSE 'no_evidence' END || '/' ||
 CASE WHEN {fn.SQL_IS_LEGACY} THEN 'name_legacy' WHEN {fn.SQL_IS_GOOD} THEN 'name_known_good' ELSE 'name_uninformative' END AS stratum FROM {OBS} WHERE detector_label IN {(*fn.POSITIVE, 'NO_EVIDENCE')})"""
_QUOTA = "CASE stratum " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in QUOTAS.items()) + " ELSE 0 END"
_CAPPED = _sql_ranked("SELECT sha256, issuing_body FROM (" + _FILES.format(" AND issuing_body IS NOT NULL") + ")", "issuing_body", "sha256", SEED)
_NEXT = f"""WITH {_JUDGED}, {_sql_verdicts('e', "round = 1 AND sample_id = 'gt-v1'")}, {_sql_verdicts('v', 'round = 1')},
old AS (SELECT obs_id, final_label, basis FROM e WHERE basis <> 'disagreed'),
b AS (SELECT coalesce(old.obs_id, v.obs_id) AS obs_id, old.final_label AS ol, old.basis AS ob, v.final_label AS vl, v.basis AS vb FROM old FULL JOIN v ON old.obs_id = v.obs_id)
SELECT obs_id, CASE WHEN ob = 'unanimous' OR (ob = 'single' AND coalesce(vb, 'single') = 'single') THEN ol ELSE vl END AS final_label,
 CASE WHEN ob = 'unanimous' OR (ob = 'single' AND coalesce(vb, 'single') = 'single') THEN ob ELSE vb END AS basis, 'auto' AS adjudicator
FROM b WHERE ob = 'unanimous' OR (ob = 'single' AND coalesce(vb, 'single') = 'single') OR vb = 'unanimous'"""

SQL = {
    "stratified_sample": f"""SELECT obs_id, stratum, stratum_size, least({_QUOTA}, stratum_size)::BIGINT AS drawn, round(least({_QUOTA}, stratum_size) / stratum_size::DOUBLE, 9) AS selection_prob
FROM (SELECT *, count(*) OVER (PARTITION BY stratum) AS stratum_size FROM {_sql_ranked(f'SELECT * FROM {_STRATUM}', 'stratum', 'obs_id', SEED)}) WHERE draw_rank <= {_QUOTA}""",
    "per_source_capped_sample": f"SELECT source_key, sha256, doc_id FROM {_sql_ranked('SELECT source_key, sha256, doc_id FROM (' + _FILES.format(' AND source_key IS NOT NULL') + ')', 'source_key', 'sha256', SEED)} WHERE draw_rank <= {CAP}",
    "sample_frame": f"SELECT issuing_body, count(*) AS stratum_size, count_if(draw_rank <= {CAP})::BIGINT AS drawn, round(count_if(draw_rank <= {CAP}) / count(*)::DOUBLE, 9) AS selection_prob FROM {_CAPPED} GROUP BY 1",
    "tiered_selection": f"""WITH {_FRAME}, f AS ({_FILES.format(' AND issuing_body IS NOT NULL')}), l AS (SELECT DISTINCT sha256 FROM fr JOIN {OBS} USING (obs_id) WHERE sample_id = '{SAMPLE}'),
rest AS (SELECT * FROM {_sql_ranked('SELECT sha256, issuing_body FROM f WHERE sha256 NOT IN (SELECT sha256 FROM l WHERE sha256 IS NOT NULL)', 'issuing_body', 'sha256', SEED)} WHERE draw_rank <= 5)
SELECT sha256, 'labelled' AS tier FROM f WHERE sha256 IN (SELECT sha256 FROM l) UNION ALL SELECT sha256, 'coverage' FROM rest""",
    "discard_and_redraw": f"""WITH f AS (SELECT sha256, source FROM ({_FILES.format(' AND source_key IS NOT NULL')}))
SELECT source, sha256 FROM {_sql_ranked("SELECT * FROM f WHERE source <> 'portal'", 'source', 'sha256', SEED)} WHERE draw_rank <= {CAP} UNION ALL SELECT source, sha256 FROM {_sql_ranked("SELECT * FROM f WHERE source = 'portal'", 'source', 'sha256', SEED + 1)} WHERE draw_rank <= {CAP}""",
    "pending_anti_join": f"WITH {_JUDGED}, {_FRAME} SELECT DISTINCT obs_id FROM fr WHERE sample_id = '{SAMPLE}' AND obs_id NOT IN (SELECT obs_id FROM j WHERE annotator = '{ANNOTATOR}' AND round = 1)",
    "deep_semi_join": f"SELECT obs_id, sha256, signals_version FROM {OBS} WHERE sha256 IN (SELECT sha256 FROM font_observation WHERE signals_version LIKE '%+deep')",
    "next_card_round2": f"""WITH {_JUDGED}, {_FRAME} SELECT obs_id, sampled_chars, n_pages_seen FROM (SELECT DISTINCT obs_id FROM fr WHERE sample_id = '{SAMPLE}') JOIN {OBS} USING (obs_id)
WHERE obs_id IN (SELECT obs_id FROM j WHERE annotator = '{ANNOTATOR}' AND round = 1) AND obs_id NOT IN (SELECT obs_id FROM j WHERE annotator = '{ANNOTATOR}' AND round = 2) ORDER BY substr((obs_id * 2654435761)::VARCHAR, -4), obs_id LIMIT 20""",
    "adjudication_verdicts": f"WITH {_V} SELECT * FROM v",
    "adjudication_next_state": _NEXT,
    "next_disagreement": f"WITH {_V} SELECT obs_id, n, n_labels FROM v WHERE basis = 'disagreed' ORDER BY obs_id LIMIT 20",
    "adjudication_progress": f"WITH {_V}, {_FRAME} SELECT sample_id, coalesce(basis, 'pending') AS basis, count(*) AS n FROM fr LEFT JOIN v USING (obs_id) GROUP BY 1, 2",
    "labelling_progress": f"WITH {_JUDGED}, {_FRAME} SELECT fr.sample_id, stratum, count(*) AS n, count(j.label) AS done FROM fr LEFT JOIN j ON j.obs_id = fr.obs_id AND j.annotator = '{ANNOTATOR}' AND j.round = 1 GROUP BY 1, 2",
    "label_distribution": f"WITH {_JUDGED} SELECT annotator, round, label, count(*) AS n FROM j GROUP BY 1, 2, 3",
    "judgement_validation": f"""SELECT CASE WHEN obs_id IS NULL THEN 'no observation' WHEN {lb.SQL_ANNOTATOR} IS NULL THEN 'no annotator' WHEN {lb.SQL_LABEL} IS NULL THEN 'no label' WHEN {lb.SQL_LABEL} NOT IN {lb.LABELS} THEN 'unknown label'
 WHEN script IS NOT NULL AND lower(trim(script)) NOT IN {lb.SCRIPTS} THEN 'unknown script' ELSE 'accepted' END AS outcome, count(*) AS n FROM (SELECT DISTINCT ON (annotation_id) * FROM annotation) GROUP BY 1""",
    "document_truth": f"WITH {_T} SELECT sha256, arg_min(final_label, list_position({list(wf.DOCUMENT_PRIORITY)}, final_label)) AS label FROM truth GROUP BY sha256",
    "kappa_overall": _sql_kappa(_PAIRS, "other"),
    "kappa_intra": _sql_kappa("SELECT x.annotator, x.label AS a, y.label AS b FROM j x JOIN j y ON x.obs_id = y.obs_id AND x.annotator = y.annotator WHERE x.round = 1 AND y.round = 2", "annotator"),
    "kappa_per_class": f"""WITH {_JUDGED}, pairs AS (SELECT a, b FROM ({_PAIRS})), l AS (SELECT a AS label FROM pairs UNION SELECT b FROM pairs),
g AS (SELECT label, count(*)::DOUBLE AS n, count_if(a = label OR b = label)::BIGINT AS k, count_if((a = label) = (b = label)) AS same, count_if(a = label) AS na, count_if(b = label) AS nb FROM l, pairs GROUP BY label),
e AS (SELECT label, k, same / n AS o, (na / n) * (nb / n) + ((n - na) / n) * ((n - nb) / n) AS e FROM g),
r AS (SELECT label, k AS n, CASE WHEN e < 1 - 1e-12 THEN round((o - e) / (1 - e), 6) END AS kappa FROM e) SELECT *, coalesce(kappa < 0.7, false) AS below_floor FROM r""",
    "kappa_per_class_all": f"""WITH {_JUDGED}, pairs AS (SELECT 'between' AS kind, '{ANNOTATOR}' AS annotator, other, a, b FROM ({_PAIRS})
 UNION ALL SELECT 'rounds', x.annotator, x.annotator, x.label, y.label FROM j x JOIN j y ON x.obs_id = y.obs_id AND x.annotator = y.annotator WHERE x.round = 1 AND y.round = 2),
l AS (SELECT kind, annotator, other, a AS label FROM pairs UNION SELECT kind, annotator, other, b FROM pairs),
g AS (SELECT kind, annotator, other, label, count(*)::DOUBLE AS n, count_if(a = label OR b = label)::BIGINT AS k, count_if((a = label) = (b = label)) AS same, count_if(a = label) AS na, count_if(b = label) AS nb FROM l JOIN pairs USING (kind, annotator, other) GROUP BY 1, 2, 3, 4),
e AS (SELECT kind, annotator, other, label, k, same / n AS o, (na / n) * (nb / n) + ((n - na) / n) * ((n - nb) / n) AS e FROM g),
r AS (SELECT kind, annotator, other, label, k AS n, CASE WHEN e < 1 - 1e-12 THEN round((o - e) / (1 - e), 6) END AS kappa FROM e) SELECT *, coalesce(kappa < 0.7, false) AS below_floor FROM r""",
    "manual_resolution": f"""WITH {_V} SELECT obs_id, final_label, basis, 'auto' AS adjudicator FROM v WHERE final_label IS NOT NULL
UNION ALL SELECT obs_id, label, 'adjudicated', '{ANNOTATOR}' FROM v JOIN j USING (obs_id) WHERE final_label IS NULL AND annotator = '{ANNOTATOR}' AND round = 1 AND label IN {lb.LABELS}""",
    "ground_truth_view": f"WITH {_T}, {_FRAME} SELECT obs_id, detector_label, final_label, basis, sample_id, stratum FROM truth LEFT JOIN fr USING (obs_id)",
    "detector_binary_prf": f"""WITH {_T}, c AS (SELECT count_if(s AND t)::BIGINT AS tp, count_if(s AND NOT t)::BIGINT AS fp, count_if(NOT s AND t)::BIGINT AS fn, count_if(NOT s AND NOT t)::BIGINT AS tn
 FROM (SELECT coalesce(detector_label IN {fn.POSITIVE}, false) AS s, final_label IN {fn.POSITIVE} AS t FROM truth)) SELECT *, {_sql_prf('tp', 'fp', 'fn')} FROM c""",
    "detector_per_class_prf": f"""WITH {_T}, c AS (SELECT label, count_if(final_label = label)::BIGINT AS n, count_if(final_label = label AND detector_label = label)::BIGINT AS tp, count_if(coalesce(detector_label = label, false))::BIGINT AS said
 FROM truth, (SELECT DISTINCT final_label AS label FROM truth) GROUP BY label) SELECT label, n, {_sql_prf('tp', '(said - tp)', '(n - tp)')} FROM c""",
    "confusion_top": f"WITH {_T} SELECT detector_label, final_label, count(*) AS n FROM truth WHERE detector_label <> final_label AND NOT (detector_label = 'NO_EVIDENCE' AND final_label = 'CORRECT') GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 10",
    "stratified_estimate": f"""WITH {_V}, {_FRAME}, st AS (SELECT stratum, max(stratum_size) AS size, count(*) AS drawn, count_if(final_label IN {fn.POSITIVE}) AS pos FROM fr JOIN v USING (obs_id) WHERE sample_id = '{SAMPLE}' AND stratum IS NOT NULL AND final_label IS NOT NULL GROUP BY 1),
x AS (SELECT *, size / (SELECT sum(size) FROM st)::DOUBLE AS share, pos / drawn::DOUBLE AS p, 1 - drawn / size::DOUBLE AS fpc FROM st),
r AS (SELECT count(*) AS n_strata, sum(share * p) AS rate, sqrt(sum(CASE WHEN drawn > 1 THEN share * share * (p * (1 - p) / drawn) * fpc ELSE 0 END)) AS se FROM x)
SELECT n_strata, round(rate, 6) AS rate, round(se, 6) AS se, round(1.96 * se, 6) AS half_width_95 FROM r""",
} | {name: _sql_sweep(x) for name, x in SWEEPS.items()}
