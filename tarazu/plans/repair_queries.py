"""Encoding families, reverse mapping and its evaluation over the real tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarazu.functions import charclass as cc
from tarazu.functions import signals as s
from tarazu.operators import convert as cv
from tarazu.operators import families as fa
from tarazu.operators import mapping as mp
from tarazu.operators.sampling import capped_sample
from tarazu.session import cut, spread, table

TRAIN_SHARE = 70


def _transcriptions(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "transcription").dropDuplicates(["transcription_id"]), "transcription_id")


def _excerpts(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "excerpt").dropDuplicates(["excerpt_id"]), "excerpt_id")


def char_signatures(spark: SparkSession, d: str) -> DataFrame:
    sig = fa.signatures(_transcriptions(spark, d), "transcription_id", "legacy_text")
    return sig.groupBy("transcription_id").agg(F.count(F.lit(1)).alias("n_signs"), F.round(F.sqrt(F.sum(F.col("freq") * F.col("freq"))), 9).alias("norm"), F.round(F.max("freq"), 9).alias("top"))


def signature_cosine(spark: SparkSession, d: str) -> DataFrame:
    """How alike the legacy and the OCR text of a page are in their signs."""
    t = _transcriptions(spark, d)
    a = fa.signatures(t, "transcription_id", "legacy_text")
    b = fa.signatures(t, "transcription_id", "ocr_text")
    dot = a.alias("a").join(b.alias("b"), ["transcription_id", "ch"], "full_outer").groupBy("transcription_id").agg(
        F.coalesce(F.sum(F.col("a.freq") * F.col("b.freq")), F.lit(0.0)).alias("dot"),
        F.sqrt(F.sum(F.col("a.freq") * F.col("a.freq"))).alias("na"), F.sqrt(F.sum(F.col("b.freq") * F.col("b.freq"))).alias("nb"),
    )
    return dot.where("na IS NOT NULL AND nb IS NOT NULL").select("transcription_id", F.round(F.col("dot") / (F.col("na") * F.col("nb")), 9).alias("cosine"))


def _page_signatures(spark: SparkSession, d: str) -> DataFrame:
    t = _transcriptions(spark, d).where("family_id IS NOT NULL").select("transcription_id", "family_id", "legacy_text")
    return fa.signatures(t, "transcription_id", "legacy_text").join(t.select("transcription_id", "family_id"), "transcription_id")


def centroid_by_family(spark: SparkSession, d: str) -> DataFrame:
    got = fa.centroids(_page_signatures(spark, d), "transcription_id", "family_id")
    return got.select("family_id", "ch", F.round("freq", 9).alias("freq"))


def nearest_centroid(spark: SparkSession, d: str) -> DataFrame:
    """Each page's family by its own signature, beside the family it was drawn under."""
    t = _transcriptions(spark, d).select("transcription_id", "family_id", "legacy_text")
    sig = cut(fa.signatures(t, "transcription_id", "legacy_text"))  # read by the centroids and by the search
    fams = t.where("family_id IS NOT NULL").select("transcription_id", "family_id")
    cents = fa.centroids(sig.join(fams, "transcription_id"), "transcription_id", "family_id")
    return fa.nearest(sig, "transcription_id", cents, "family_id").select("transcription_id", F.col("nearest").alias("family_id"), F.round("cosine", 6).alias("cosine"))


def grain_drift(spark: SparkSession, d: str) -> DataFrame:
    """Per family: cosine of the centroid from pages and the centroid from excerpts of the same files."""
    pages = fa.centroids(_page_signatures(spark, d), "transcription_id", "family_id")
    fams = _transcriptions(spark, d).where("family_id IS NOT NULL").select("sha256", "family_id").distinct()
    o = table(spark, d, "font_observation").dropDuplicates(["obs_id"]).where(F.col("detector_label").isin(*fa.CONVERTIBLE)).select("obs_id", "sha256")
    x = _excerpts(spark, d).select("excerpt_id", "obs_id", "text").join(o, "obs_id").join(fams, "sha256")
    x = x.select(F.concat_ws("|", "excerpt_id", "family_id").alias("k"), "family_id", "text")
    exc = fa.centroids(fa.signatures(x, "k", "text").join(x.select("k", "family_id"), "k"), "k", "family_id")
    got = fa.cosines(pages, "family_id", exc.withColumnRenamed("family_id", "other"), "other")
    return got.where("family_id = other").select("family_id", F.round("cosine", 6).alias("cosine"))


def _convicted(spark: SparkSession, d: str) -> DataFrame:
    """Convicted observations with all their excerpt text joined in order."""
    o = table(spark, d, "font_observation").dropDuplicates(["obs_id"]).where(F.col("detector_label").isin(*fa.CONVERTIBLE)).select("obs_id", "sha256", "font_name", F.col("detector_label").alias("label"))
    x = _excerpts(spark, d).where("text IS NOT NULL").groupBy("obs_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("excerpt_id", "text"))).getField("text"), " ").alias("text"))
    return o.join(x, "obs_id")


def excerpt_text_by_observation(spark: SparkSession, d: str) -> DataFrame:
    return _convicted(spark, d).select("obs_id", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


def greedy_families(spark: SparkSession, d: str) -> DataFrame:
    return fa.greedy_families(cut(fa.signatures(_convicted(spark, d), "obs_id", "text")), "obs_id")


def family_purity(spark: SparkSession, d: str) -> DataFrame:
    return fa.family_stats(_convicted(spark, d).join(greedy_families(spark, d).select("obs_id", "family"), "obs_id"))


def family_sizes(spark: SparkSession, d: str) -> DataFrame:
    """What the clusters hold together: every convicted observation with a signature, once."""
    got = greedy_families(spark, d)
    return got.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("obs_id").alias("n_obs"))


def family_slugs(spark: SparkSession, d: str) -> DataFrame:
    """Families of transcription by their pages, named by rank and commonest font of their files."""
    t = _transcriptions(spark, d).where("family_id IS NOT NULL").select("transcription_id", "family_id", "sha256")
    o = table(spark, d, "font_observation").dropDuplicates(["obs_id"]).where("font_name IS NOT NULL").select("sha256", "font_name")
    n = t.groupBy("family_id").agg(F.count(F.lit(1)).alias("n_pages"))
    names = t.join(o, "sha256").groupBy("family_id", "font_name").agg(F.count(F.lit(1)).alias("k"))
    top = names.groupBy("family_id").agg(F.min_by("font_name", F.struct(-F.col("k"), F.col("font_name"))).alias("top_name"))
    # One row a family.
    ranked = n.join(top, "family_id", "left").withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n_pages"), "family_id")))
    return ranked.select("family_id", "n_pages", fa.family_slug("rank", "top_name").alias("slug"))


def matra_reorder_repha(spark: SparkSession, d: str) -> DataFrame:
    """Typed text with every repha marked behind its cluster, as a converter leaves it, and put back."""
    t = _transcriptions(spark, d).where("human_text IS NOT NULL")
    moved = F.regexp_replace("human_text", f"{cv.REPHA}({cc.java(cc.CONSONANT)})", "$1" + cv.MARK + cv.REPHA)
    back = cv.reorder_matras(moved)
    return t.select("transcription_id", F.md5(moved).alias("moved_md5"), F.md5(back).alias("back_md5"))


def excerpt_heads(spark: SparkSession, d: str) -> DataFrame:
    """The head of every document's excerpts."""
    got = excerpt_windows(spark, d).where("kind = 'head'")
    return got.select("doc_id", "char_start", F.md5("excerpt").alias("excerpt_md5"))


def visual_order(spark: SparkSession, d: str) -> DataFrame:
    return _transcriptions(spark, d).where("ocr_text IS NOT NULL").select("transcription_id", F.md5(cv.visual_order(F.col("ocr_text"))).alias("visual_md5"))


def matra_reorder(spark: SparkSession, d: str) -> DataFrame:
    """Text brought to visual order, its i-signs marked, and put back: equal where nothing was lost."""
    t = _transcriptions(spark, d).where("ocr_text IS NOT NULL")
    marked = F.replace(cv.visual_order(F.col("ocr_text")), F.lit(cv.I_MATRA), F.lit(cv.MARK + cv.I_MATRA))
    back = cv.reorder_matras(marked)
    return t.select("transcription_id", F.md5(back).alias("back_md5"), (back == F.col("ocr_text")).alias("same"))


def legacy_gate(spark: SparkSession, d: str) -> DataFrame:
    return _excerpts(spark, d).select("excerpt_id", cv.is_legacy_encoded(F.col("text")).alias("legacy"))


def _converted(spark: SparkSession, d: str) -> DataFrame:
    tables = cv.rule_tables(table(spark, d, "mapping_entry"))
    return cv.convert_texts(_transcriptions(spark, d), "family_id", "legacy_text", tables)


def convert_by_family(spark: SparkSession, d: str) -> DataFrame:
    got = _converted(spark, d).where("converted IS NOT NULL")
    return got.select("transcription_id", "family_id", F.round("coverage", 6).alias("coverage"), "converted")


def transcription_scores(spark: SparkSession, d: str) -> DataFrame:
    """Per family: the converter and the OCR against what a person typed."""
    got = _converted(spark, d).where("converted IS NOT NULL AND human_text IS NOT NULL")
    scored = got.select("family_id", cv.best_window_udf("converted", "human_text").alias("c"), cv.best_window_udf("ocr_text", "human_text").alias("o"))
    return scored.groupBy("family_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("c"), 6).alias("converter"), F.round(F.avg("o"), 6).alias("ocr"))


def negative_control(spark: SparkSession, d: str) -> DataFrame:
    """Every family's rules over clean excerpts.

    The gate keeps all rules away from clean Devanagari, so it must change nothing there;
    clean English passes the gate and reaches the rules, which shows what it would cost
    to convert a text that was never coded.
    """
    tables = cv.rule_tables(table(spark, d, "mapping_entry"))
    x = s.with_text_signals(s.with_page_measures(_excerpts(spark, d).select("excerpt_id", "text"), "text"), "text")
    sound = (F.col("english_ratio") >= s.PERFONT_ENGLISH) & (F.col("n_mojibake") == 0) & (F.col("body_dev_chars") == 0)
    script = F.when(F.col("dev_share") > 0.30, "devanagari").when(sound, "latin")
    x = x.where("n_chars >= 25").select("excerpt_id", "text", script.alias("script")).where("script IS NOT NULL")
    rows = x.select("excerpt_id", "text", "script", F.explode(F.array(*map(F.lit, sorted(tables)))).alias("family_id"))
    got = cv.convert_texts(rows, "family_id", "text", tables)
    rate = lambda c: F.regexp_count(c, F.lit(s.INVALID_MATRA))
    return got.groupBy("family_id", "script").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("converted") == F.col("text")).alias("unchanged"),
        F.count_if(rate(F.col("converted")) > rate(F.col("text"))).alias("worse"), F.round(F.avg("coverage"), 6).alias("mean_coverage"),
    )


def negative_control_frame(spark: SparkSession, d: str) -> DataFrame:
    """How many clean excerpts each family's rules are tried on, and that Devanagari stays as it is."""
    got = negative_control(spark, d)
    return got.select("family_id", "script", "n", (F.col("unchanged") == F.col("n")).alias("kept")).withColumn("kept", F.when(F.col("script") == "devanagari", F.col("kept")))


def _bucket(sha: str):
    return F.conv(F.substring(F.sha2(F.col(sha), 256), 1, 8), 16, 10).cast("long") % 100


def hash_train_test_split(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "documents").where("sha256 IS NOT NULL").select("sha256").distinct()
    return f.select("sha256", F.when(_bucket("sha256") < TRAIN_SHARE, "train").otherwise("test").alias("split"))


MIN_PAGE_CHARS, MAX_TEXT_DEV, MIN_OCR_DEV = 200, 0.05, 0.40


def _pages(spark: SparkSession, d: str, least_ocr_dev: float | None) -> DataFrame:
    """Pages with a family whose text layer holds no Devanagari, both arms of more than 200 characters.

    With ``least_ocr_dev`` the OCR must show Devanagari. A family without a page of that
    length is represented by its shorter ones.
    """
    t = _transcriptions(spark, d).where("family_id IS NOT NULL AND legacy_text IS NOT NULL AND ocr_text IS NOT NULL")
    dev = lambda c: s.ratio(s.count_dense(s.body(F.col(c)), cc.DEVANAGARI), F.length(s.body(F.col(c))))
    t = t.where(dev("legacy_text") < MAX_TEXT_DEV)
    if least_ocr_dev is not None:
        t = t.where(dev("ocr_text") > least_ocr_dev)
    long = (F.length("legacy_text") > MIN_PAGE_CHARS) & (F.length("ocr_text") > MIN_PAGE_CHARS)
    t = t.select("transcription_id", "sha256", "family_id", "legacy_text", "ocr_text", (_bucket("sha256") < TRAIN_SHARE).alias("train"), long.alias("long"))
    return t.join(t.groupBy("family_id").agg(F.bool_or("long").alias("any_long")), "family_id").where("long OR NOT any_long").drop("long", "any_long")


def _scorable(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d, MIN_OCR_DEV)


def evaluation_pages(spark: SparkSession, d: str) -> DataFrame:
    """The pages a conversion is scored on: as those it is learned from, whatever the OCR shows."""
    return _pages(spark, d, None).select("transcription_id", "family_id", "train")


def _pairs(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("family_id").alias("family"), F.col("sha256").alias("doc"), F.col("legacy_text").alias("codes"), F.col("ocr_text").alias("text"))


def scorable_pages(spark: SparkSession, d: str) -> DataFrame:
    return _scorable(spark, d).select("transcription_id", "family_id", "train")


def training_pages(spark: SparkSession, d: str) -> DataFrame:
    """Full pages with both arms of documents in any family: what rules can be learned from."""
    t = _transcriptions(spark, d).where("legacy_text IS NOT NULL AND ocr_text IS NOT NULL AND page > 0")
    fams = t.where("family_id IS NOT NULL").select("sha256").distinct()
    got = t.join(fams, "sha256", "left_semi")
    return got.select("transcription_id", "sha256", "page", F.length("legacy_text").cast("long").alias("n_text"), F.length("ocr_text").cast("long").alias("n_ocr"))


def table_totals(spark: SparkSession, d: str) -> DataFrame:
    """Rows and characters of the training pages."""
    return training_pages(spark, d).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n_text"), F.lit(0)).alias("n_text"), F.coalesce(F.sum("n_ocr"), F.lit(0)).alias("n_ocr"))


DRAWN_A_FAMILY, DRAW_SEED, SIGNATURE_MIN = 10, 4242, 0.70


def transcription_draw(spark: SparkSession, d: str) -> DataFrame:
    """Pages to be typed: of each family by the page's own signature, those with the smallest seeded keys."""
    got = nearest_centroid(spark, d).select("family_id", "transcription_id")
    return capped_sample(got, "family_id", "transcription_id", DRAWN_A_FAMILY, DRAW_SEED)


def transcription_relabel(spark: SparkSession, d: str) -> DataFrame:
    """Pages by the family they were drawn under and the family their signature shows."""
    t = _transcriptions(spark, d).select("transcription_id", F.col("family_id").alias("drawn"))
    got = nearest_centroid(spark, d).withColumnRenamed("family_id", "shown").join(t, "transcription_id")
    return got.groupBy("drawn", "shown").agg(F.count(F.lit(1)).alias("n"))


def page_signature_filter(spark: SparkSession, d: str) -> DataFrame:
    """Training pages that keep near their family's centroid (cosine of 0.70 or more)."""
    t = _transcriptions(spark, d).where("family_id IS NOT NULL").select("transcription_id", "family_id")
    sig = fa.signatures(_transcriptions(spark, d), "transcription_id", "legacy_text")
    own = t.join(fa.centroids(_page_signatures(spark, d), "transcription_id", "family_id").withColumnRenamed("freq", "fc"), "family_id")
    dot = sig.join(own, ["transcription_id", "ch"]).groupBy("transcription_id", "family_id").agg(F.sum(F.col("freq") * F.col("fc")).alias("dot"))
    norms = sig.groupBy("transcription_id").agg(F.sqrt(F.sum(F.col("freq") * F.col("freq"))).alias("na"))
    sizes = fa.centroids(_page_signatures(spark, d), "transcription_id", "family_id").groupBy("family_id").agg(F.sqrt(F.sum(F.col("freq") * F.col("freq"))).alias("nb"))
    got = dot.join(norms, "transcription_id").join(sizes, "family_id").withColumn("cosine", F.round(F.col("dot") / (F.col("na") * F.col("nb")), 6))
    return got.where(F.col("cosine") >= SIGNATURE_MIN).select("transcription_id", "family_id", "cosine")


def em_mapping_rules_seeded(spark: SparkSession, d: str) -> DataFrame:
    """Rules learned with a third of each family's known rules as hand-made seeds."""
    known = table(spark, d, "mapping_entry").where("family_id IS NOT NULL AND source IS NOT NULL AND target IS NOT NULL")
    share = F.pmod(F.xxhash64("family_id", "source"), F.lit(3)) == 0
    seeds: dict[str, dict[str, str]] = {}
    for family, source, target in sorted(known.where(share).select("family_id", "source", "target").distinct().limit(cv.MOST_RULES).collect()):
        seeds.setdefault(family, {})[source] = target
    return mp.learn(_pairs(_scorable(spark, d)), seeds=seeds)


def em_mapping_rules(spark: SparkSession, d: str) -> DataFrame:
    return mp.learn(_pairs(_scorable(spark, d)))


def heldout_conversion_report(spark: SparkSession, d: str) -> DataFrame:
    """Rules learned on the scorable pages of the training files, scored on all evaluation pages: per family and part.

    ``valid_before`` and ``valid_after`` are the shares of pages whose text is structurally
    valid as it stands and converted.
    """
    rules = mp.learn(_pairs(_scorable(spark, d).where("train")))
    tables = cv.rule_tables(rules)
    got = cut(cv.convert_texts(_pages(spark, d, None), "family_id", "legacy_text", tables).where("converted IS NOT NULL"))
    rated = lambda df, c, name: s.with_text_signals(df, c).withColumn(name, F.round("invalid_rate_per_1k", 2)).select(*df.columns, name)
    t = rated(rated(got.withColumn("sim", F.round(cv.similarity_udf("converted", "ocr_text"), 4)), "legacy_text", "before"), "converted", "rate")
    valid = lambda c: F.round(F.count_if(F.col(c) < s.SUSPECT_RATE_PER_1K) / F.count(F.lit(1)), 6)
    under = [F.round(F.count_if(F.col("rate") < k) / F.count(F.lit(1)), 6).alias(f"under_{k}") for k in (2, 10, 25, 50)]
    return t.groupBy("family_id", F.when(F.col("train"), "train").otherwise("test").alias("split")).agg(
        F.count(F.lit(1)).alias("pages"), F.round(F.avg("coverage"), 6).alias("coverage"), F.round(F.avg("sim"), 6).alias("mean_similarity"),
        cv.upper_median("sim").alias("median_similarity"), F.round(F.avg("rate"), 6).alias("mean_rate"), cv.upper_median("rate").alias("median_rate"),
        valid("before").alias("valid_before"), valid("rate").alias("valid_after"), *under,
    )


def excerpt_windows(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return cv.excerpt_windows(docs, "doc_id", "text")


QUERIES = {
    f.__name__: f
    for f in (
        char_signatures, signature_cosine, centroid_by_family, nearest_centroid, grain_drift, excerpt_text_by_observation, greedy_families, family_purity,
        visual_order, matra_reorder, legacy_gate, convert_by_family, transcription_scores, negative_control, hash_train_test_split, scorable_pages,
        em_mapping_rules, em_mapping_rules_seeded, heldout_conversion_report, excerpt_windows, evaluation_pages, training_pages, table_totals,
        transcription_draw, transcription_relabel, page_signature_filter, negative_control_frame, family_slugs, family_sizes, excerpt_heads, matra_reorder_repha,
    )
}

_TR = "(SELECT DISTINCT ON (transcription_id) * FROM transcription)"
_EX = "(SELECT DISTINCT ON (excerpt_id) * FROM excerpt)"
_NOISE = f"[{cc.re2(cc.WS)[1:-1]}\\p{{Nd}}]+"


def _sql_sig(name: str, rows: str, key: str, text: str) -> str:
    """Long signatures: key, ch, freq."""
    return f"""{name} AS (SELECT {key}, ch, count(*) / any_value(total)::DOUBLE AS freq FROM (SELECT {key}, length(b) AS total, unnest(regexp_extract_all(b, '(?s).')) AS ch
 FROM (SELECT {key}, regexp_replace(coalesce({text}, ''), '{_NOISE}', '', 'g') AS b FROM {rows}) WHERE length(b) >= {fa.MIN_SIGNATURE_CHARS}) GROUP BY {key}, ch)"""


def _sql_visual(c: str) -> str:
    for a, b in cv.SPLIT_MATRAS.items():
        c = f"replace({c}, '{a}', '{b}')"
    cons = cc.re2(cc.CONSONANT)
    return f"regexp_replace({c}, '((?:{cons}\\x{{094D}})*{cons}\\x{{093C}}?)\\x{{093F}}', chr(2367) || '\\1', 'g')"


def _sql_reorder(c: str) -> str:
    cons, signs = cc.re2(cc.CONSONANT), cc.re2(cc.MATRA, cc.NUKTA, cc.VIRAMA)
    c = f"regexp_replace({c}, '\\x{{E000}}\\x{{093F}}((?:{cons}\\x{{094D}})*{cons}\\x{{093C}}?)', '\\1' || chr(2367), 'g')"
    c = f"regexp_replace({c}, '({cons}(?:\\x{{094D}}{cons})*{signs}*?)\\x{{E000}}\\x{{0930}}\\x{{094D}}', chr(2352) || chr(2381) || '\\1', 'g')"
    return f"replace({c}, chr(57344), '')"


_CENT = f"""{_sql_sig('sg', _TR, 'transcription_id', 'legacy_text')}, fm AS (SELECT transcription_id, family_id FROM {_TR} WHERE family_id IS NOT NULL),
cent AS (SELECT family_id, ch, sum(freq) / any_value(size) AS freq FROM sg JOIN fm USING (transcription_id) JOIN (SELECT family_id, count(DISTINCT transcription_id) AS size FROM sg JOIN fm USING (transcription_id) GROUP BY 1) USING (family_id) GROUP BY family_id, ch)"""
_CONV = f"SELECT o.obs_id, sha256, font_name, detector_label AS label, x.text FROM (SELECT DISTINCT ON (obs_id) * FROM font_observation) o JOIN (SELECT obs_id, string_agg(text, ' ' ORDER BY excerpt_id) AS text FROM {_EX} WHERE text IS NOT NULL GROUP BY obs_id) x USING (obs_id) WHERE detector_label IN {fa.CONVERTIBLE}"
_DEVSHARE = lambda c: f"(CASE WHEN length({s.sql_body(c)}) > 0 THEN {s.sql_count(s.sql_body(c), cc.re2(cc.DEVANAGARI))} / length({s.sql_body(c)})::DOUBLE ELSE 0 END)"
_SPLIT = "('0x' || substr(sha256(sha256), 1, 8))::BIGINT % 100 < 70"

def _sql_pages(more: str) -> str:
    return f"""WITH p AS (SELECT *, length(legacy_text) > {MIN_PAGE_CHARS} AND length(ocr_text) > {MIN_PAGE_CHARS} AS long FROM {_TR} WHERE family_id IS NOT NULL AND legacy_text IS NOT NULL AND ocr_text IS NOT NULL AND {_DEVSHARE('legacy_text')} < {MAX_TEXT_DEV} {more})
SELECT transcription_id, family_id, {_SPLIT} AS train FROM p JOIN (SELECT family_id, bool_or(long) AS any_long FROM p GROUP BY 1) USING (family_id) WHERE long OR NOT any_long"""


_TRAINING = f"FROM {_TR} WHERE legacy_text IS NOT NULL AND ocr_text IS NOT NULL AND page > 0 AND sha256 IN (SELECT sha256 FROM {_TR} WHERE family_id IS NOT NULL AND legacy_text IS NOT NULL AND ocr_text IS NOT NULL AND page > 0)"
SQL = {
    "char_signatures": f"WITH {_sql_sig('sg', _TR, 'transcription_id', 'legacy_text')} SELECT transcription_id, count(*) AS n_signs, round(sqrt(sum(freq * freq)), 9) AS norm, round(max(freq), 9) AS top FROM sg GROUP BY 1",
    "signature_cosine": f"""WITH {_sql_sig('a', _TR, 'transcription_id', 'legacy_text')}, {_sql_sig('b', _TR, 'transcription_id', 'ocr_text')},
na AS (SELECT transcription_id, sqrt(sum(freq * freq)) AS na FROM a GROUP BY 1), nb AS (SELECT transcription_id, sqrt(sum(freq * freq)) AS nb FROM b GROUP BY 1),
dt AS (SELECT transcription_id, sum(a.freq * b.freq) AS dot FROM a JOIN b USING (transcription_id, ch) GROUP BY 1)
SELECT transcription_id, round(coalesce(dot, 0) / (na * nb), 9) AS cosine FROM na JOIN nb USING (transcription_id) LEFT JOIN dt USING (transcription_id)""",
    "centroid_by_family": f"WITH {_CENT} SELECT family_id, ch, round(freq, 9) AS freq FROM cent",
    "nearest_centroid": f"""WITH {_CENT}, n AS (SELECT family_id, sqrt(sum(freq * freq)) AS nb FROM cent GROUP BY 1), m AS (SELECT transcription_id, sqrt(sum(freq * freq)) AS na FROM sg GROUP BY 1),
c AS (SELECT transcription_id, family_id, round(sum(sg.freq * cent.freq) / any_value(na * nb), 9) AS cosine FROM sg JOIN cent USING (ch) JOIN n USING (family_id) JOIN m USING (transcription_id) GROUP BY 1, 2)
SELECT transcription_id, family_id, round(cosine, 6) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY transcription_id ORDER BY cosine DESC, family_id) AS r FROM c) WHERE r = 1""",
    "grain_drift": f"""WITH {_CENT}, fams AS (SELECT DISTINCT sha256, family_id FROM {_TR} WHERE family_id IS NOT NULL),
x AS (SELECT e.excerpt_id || '|' || family_id AS k, family_id, e.text FROM {_EX} e JOIN (SELECT DISTINCT ON (obs_id) obs_id, sha256, detector_label FROM font_observation) USING (obs_id) JOIN fams USING (sha256) WHERE detector_label IN {fa.CONVERTIBLE}),
{_sql_sig('xs', 'x', 'k', 'text')}, xc AS (SELECT family_id, ch, sum(freq) / any_value(size) AS freq FROM xs JOIN (SELECT k, family_id FROM x) USING (k) JOIN (SELECT family_id, count(DISTINCT k) AS size FROM xs JOIN (SELECT k, family_id FROM x) USING (k) GROUP BY 1) USING (family_id) GROUP BY family_id, ch)
SELECT family_id, round(d / (a * b), 6) AS cosine FROM (SELECT family_id, sum(cent.freq * xc.freq) AS d FROM cent JOIN xc USING (family_id, ch) GROUP BY 1) JOIN (SELECT family_id, sqrt(sum(freq * freq)) AS a FROM cent GROUP BY 1) USING (family_id) JOIN (SELECT family_id, sqrt(sum(freq * freq)) AS b FROM xc GROUP BY 1) USING (family_id)""",
    "excerpt_text_by_observation": f"SELECT obs_id, length(text)::BIGINT AS n_chars, md5(text) AS text_md5 FROM ({_CONV})",
    "visual_order": f"SELECT transcription_id, md5({_sql_visual('ocr_text')}) AS visual_md5 FROM {_TR} WHERE ocr_text IS NOT NULL",
    "matra_reorder": f"SELECT transcription_id, md5(b) AS back_md5, b = ocr_text AS same FROM (SELECT transcription_id, ocr_text, {_sql_reorder('replace(' + _sql_visual('ocr_text') + ', chr(2367), chr(57344) || chr(2367))')} AS b FROM {_TR} WHERE ocr_text IS NOT NULL)",
    "legacy_gate": f"SELECT excerpt_id, length(b) > 0 AND {s.sql_count('b', cc.re2(cc.DEVANAGARI))} <= {cv.MAX_DEV_SHARE} * length(b) AS legacy FROM (SELECT excerpt_id, {s.sql_body(chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')')} AS b FROM {_EX})",
    "hash_train_test_split": f"SELECT sha256, CASE WHEN {_SPLIT} THEN 'train' ELSE 'test' END AS split FROM (SELECT DISTINCT sha256 FROM documents WHERE sha256 IS NOT NULL)",
    "scorable_pages": _sql_pages(f"AND {_DEVSHARE('ocr_text')} > {MIN_OCR_DEV}"),
    "evaluation_pages": _sql_pages(""),
    "training_pages": f"SELECT transcription_id, sha256, page, length(legacy_text)::BIGINT AS n_text, length(ocr_text)::BIGINT AS n_ocr {_TRAINING}",
    "table_totals": f"SELECT count(*) AS n, coalesce(sum(length(legacy_text)), 0)::BIGINT AS n_text, coalesce(sum(length(ocr_text)), 0)::BIGINT AS n_ocr {_TRAINING}",
    "negative_control_frame": f"""SELECT family_id, script, count(*) AS n, CASE WHEN script = 'devanagari' THEN true END AS kept FROM (SELECT *, CASE WHEN dev_share > 0.30 THEN 'devanagari' WHEN english_ratio >= {s.PERFONT_ENGLISH} AND n_mojibake = 0 AND body_dev_chars = 0 THEN 'latin' END AS script
 FROM {s.sql_text_signals('(SELECT * EXCLUDE (b_) FROM ' + s.sql_page_measures('(SELECT excerpt_id, text FROM ' + _EX + ')', 'text') + ')', 'text')} WHERE n_chars >= 25), (SELECT DISTINCT family_id FROM mapping_entry WHERE family_id IS NOT NULL AND source IS NOT NULL) WHERE script IS NOT NULL GROUP BY 1, 2""",
    "family_sizes": f"SELECT count(*) AS n, count(DISTINCT obs_id) AS n_obs FROM ({_CONV}) WHERE length(regexp_replace(coalesce(text, ''), '{_NOISE}', '', 'g')) >= {fa.MIN_SIGNATURE_CHARS}",
    "family_slugs": f"""WITH t AS (SELECT transcription_id, family_id, sha256 FROM {_TR} WHERE family_id IS NOT NULL), n AS (SELECT family_id, count(*) AS n_pages FROM t GROUP BY 1),
k AS (SELECT family_id, font_name, row_number() OVER (PARTITION BY family_id ORDER BY count(*) DESC, font_name) AS r FROM t JOIN (SELECT DISTINCT ON (obs_id) obs_id, sha256, font_name FROM font_observation) USING (sha256) WHERE font_name IS NOT NULL GROUP BY 1, 2)
SELECT family_id, n_pages, printf('fam-%02d-%s', row_number() OVER (ORDER BY n_pages DESC, family_id), coalesce(nullif(substr(regexp_replace(lower(font_name), '[^a-z0-9]+', '', 'g'), 1, 12), ''), 'unnamed')) AS slug FROM n LEFT JOIN (SELECT * FROM k WHERE r = 1) USING (family_id)""",
    "matra_reorder_repha": f"SELECT transcription_id, md5(m) AS moved_md5, md5({_sql_reorder('m')}) AS back_md5 FROM (SELECT transcription_id, regexp_replace(human_text, '\\x{{0930}}\\x{{094D}}(' || '{cc.re2(cc.CONSONANT)}' || ')', '\\1' || chr(57344) || chr(2352) || chr(2381), 'g') AS m FROM {_TR} WHERE human_text IS NOT NULL)",
    "excerpt_heads": "SELECT doc_id, 0::BIGINT AS char_start, md5(e) AS excerpt_md5 FROM (SELECT doc_id, regexp_replace(regexp_replace(substr(text, 1, 240), '^[\\s\\x{001C}-\\x{001F}\\x{0085}\\x{00A0}]+', ''), '[\\s\\x{001C}-\\x{001F}\\x{0085}\\x{00A0}]+$', '') AS e FROM documents WHERE text IS NOT NULL) WHERE e <> ''",
}

_NEAREST = SQL["nearest_centroid"]
SQL |= {
    "transcription_draw": f"SELECT family_id, transcription_id FROM (SELECT family_id, transcription_id, row_number() OVER (PARTITION BY family_id ORDER BY md5('{DRAW_SEED}:' || family_id || ':' || transcription_id), transcription_id) AS r FROM ({_NEAREST})) WHERE r <= {DRAWN_A_FAMILY}",
    "transcription_relabel": f"SELECT t.family_id AS drawn, n.family_id AS shown, count(*) AS n FROM ({_NEAREST}) n JOIN {_TR} t USING (transcription_id) GROUP BY 1, 2",
    "page_signature_filter": f"""WITH {_CENT}, n AS (SELECT family_id, sqrt(sum(freq * freq)) AS nb FROM cent GROUP BY 1), m AS (SELECT transcription_id, sqrt(sum(freq * freq)) AS na FROM sg GROUP BY 1)
SELECT * FROM (SELECT transcription_id, family_id, round(sum(sg.freq * cent.freq) / any_value(na * nb), 6) AS cosine FROM sg JOIN fm USING (transcription_id) JOIN cent USING (family_id, ch) JOIN n USING (family_id) JOIN m USING (transcription_id) GROUP BY 1, 2) WHERE cosine >= {SIGNATURE_MIN}""",
}
