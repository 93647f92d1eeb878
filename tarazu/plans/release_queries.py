"""Sinks, exports, gates and link discovery over the real tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarazu.functions import charclass as cc
from tarazu.functions import labels as lb
from tarazu.operators import dedupe as dd
from tarazu.operators import links as lk
from tarazu.operators import release as rl
from tarazu.plans.audit_queries import AUDIT, CAP_CHARS, _audit, _docs, _spans, _SPANS, accumulate_spans
from tarazu.session import cut, table

GATED = ["source_key", "issuing_body", "doc_type", "lang", "source", "content_type", "note", "text"]


def pii_gate(spark: SparkSession, d: str) -> DataFrame:
    """The gate's counts over manifest columns; ``text`` is there to show that it fires."""
    return rl.personal_data(_docs(spark, d, "doc_id", *GATED), GATED)


def manifest_export(spark: SparkSession, d: str) -> DataFrame:
    return rl.manifest(table(spark, d, "documents"), _audit(spark, d)).drop("downloaded_at")


def summary_pivot(spark: SparkSession, d: str) -> DataFrame:
    return rl.summary(rl.manifest(table(spark, d, "documents"), _audit(spark, d)))


def mapping_export(spark: SparkSession, d: str) -> DataFrame:
    """Rules with their family's pages and files, by family and attestation."""
    t = table(spark, d, "transcription").dropDuplicates(["transcription_id"]).where("family_id IS NOT NULL")
    fams = t.groupBy("family_id").agg(F.count(F.lit(1)).alias("n_pages"), F.count_distinct("sha256").alias("n_files"))
    m = table(spark, d, "mapping_entry").select("family_id", "source", "target", "origin", "n_attested", "n_documents", "confidence")
    return m.join(fams, "family_id", "left").orderBy("family_id", F.desc("n_attested"), "source")


def latest_wins_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Judgements of later rounds written over those of the first, per observation and annotator."""
    a = table(spark, d, "annotation").dropDuplicates(["annotation_id"]).select("annotation_id", "obs_id", lb.same_annotator(F.col("annotator")).alias("annotator"), "round", "label")
    got = dd.upsert(a.where("round = 1"), a.where("round > 1"), ["obs_id", "annotator"], ["round", "annotation_id"])
    return got.select("obs_id", "annotator", "annotation_id", "round")


def insert_ignore(spark: SparkSession, d: str) -> DataFrame:
    """Observations of the later draws that the first draw does not hold."""
    s = table(spark, d, "annotation_sample").select("sample_id", "obs_id").distinct()
    return dd.insert_ignore(s.where("sample_id = 'gt-v1'"), s.where("sample_id != 'gt-v1'").select("obs_id"), ["obs_id"])


def append_only_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Second-round judgements appended to the first round's log: accepted and refused."""
    a = table(spark, d, "annotation").dropDuplicates(["annotation_id"]).select("annotation_id", "obs_id", lb.same_annotator(F.col("annotator")).alias("annotator"), "round")
    fresh, refused = dd.append_unique(a.where("round = 1"), a.where("round = 2"), ["obs_id", "annotator"])
    rows = fresh.select("obs_id", "annotator", F.lit("appended").alias("outcome")).unionByName(refused.select("obs_id", "annotator", F.lit("refused").alias("outcome")))
    return rows.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def replace_children(spark: SparkSession, d: str) -> DataFrame:
    """Excerpts of observations that have a violation excerpt replaced by these alone."""
    x = table(spark, d, "excerpt").dropDuplicates(["excerpt_id"]).select("excerpt_id", "obs_id", "kind")
    return dd.replace_children(x, x.where("kind = 'violation'"), "obs_id").groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("obs_id").alias("n_obs"))


def verify_rebuild(spark: SparkSession, d: str) -> DataFrame:
    """What is found under a file name now against what was first found under it."""
    docs = _docs(spark, d, "doc_id", "filename", "text").select("doc_id", "filename", F.when(F.col("text").isNotNull(), F.sha2("text", 256)).alias("content_hash"))
    first = dd.pick(docs.where("filename IS NOT NULL AND content_hash IS NOT NULL"), ["filename"], ["doc_id"]).select("filename", F.col("content_hash").alias("first_hash"))
    want = docs.join(first, "filename", "left").select("doc_id", F.coalesce("first_hash", F.lit("")).alias("content_hash"))
    return rl.verify_rebuild(want, docs).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def _web(spark: SparkSession, d: str) -> DataFrame:
    """A small web over the documents' hosts: index -> five lists -> an archive each -> a cellar each.

    Lists hold files with an even doc_id, archives a quarter of the files, cellars the
    rest; addresses are written in several ways, with other links between them.
    """
    u = table(spark, d, "documents").where("source_url IS NOT NULL").select(
        F.regexp_extract("source_url", "^(https?://[^/]+)", 1).alias("host"), F.regexp_extract("source_url", "^https?://[^/]+(/.*)$", 1).alias("path"), "doc_id", (F.col("doc_id") % 5).alias("k")
    )
    lists = F.concat_ws("", *(F.lit(f"<li><a title=x href='board/tender-{k}.html#top'>Tenders {k}</a></li>") for k in range(5)))
    noise = F.lit("<a href='mailto:x@y.example'>Mail</a> <a href='https://elsewhere.example/a.pdf'>Other</a> <a href='javascript:void(0)'>Menu</a>")
    index = u.select("host").distinct().select(F.concat("host", F.lit("/index.html")).alias("url"), F.concat(F.lit("<ul>"), lists, noise, F.lit("</ul>")).alias("html"))
    hrefs = [F.concat(F.lit("<a href='"), F.col("path"), F.lit("#p1'>File</a>")), F.concat(F.lit('<A class="f" HREF="..'), F.col("path"), F.lit('">PDF</A>')), F.concat(F.lit("<a href='"), F.col("host"), F.col("path"), F.lit("'>Link</a>"))]
    link = F.when(F.col("doc_id") % 3 == 0, hrefs[0]).when(F.col("doc_id") % 3 == 1, hrefs[1]).otherwise(hrefs[2])
    def board(name: str, which: Column, onward: str) -> DataFrame:
        # A host's list of files is one page of HTML, as on a real host.
        held = u.groupBy("host", "k").agg(F.array_join(F.sort_array(F.collect_list(F.when(which, link))), "\n").alias("body"))
        return held.select(F.concat("host", F.lit(f"/board/{name}-"), "k", F.lit(".html")).alias("url"), F.concat("body", F.lit(onward[0]), "k", F.lit(onward[1])).alias("html"))

    rest = F.col("doc_id") % 4
    deeper = lambda name: (f"<p><a href='./{name}-", ".html'>Archive of notices</a></p>")
    boards = board("tender", rest % 2 == 0, deeper("archive")).unionByName(board("archive", rest == 1, deeper("cellar"))).unionByName(board("cellar", rest == 3, ("", "")))
    return index.unionByName(boards)


def link_discovery(spark: SparkSession, d: str) -> DataFrame:
    """What each page of the small web links: documents and pages to follow."""
    return lk.discovered(_web(spark, d), "url", "html").select("url", "kind")


def crawled_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents within two steps of the index pages."""
    web = cut(_web(spark, d))
    return lk.crawl(web, web.select("url").where("url LIKE '%/index.html'")).select("url", "depth")


def link_status_counts(spark: SparkSession, d: str) -> DataFrame:
    """Downloads by host and outcome."""
    status = F.when(F.col("http_status").between(200, 299) & F.col("sha256").isNotNull(), "downloaded").when(F.col("http_status").isNull(), "pending").otherwise("failed")
    host = F.parse_url("source_url", F.lit("HOST"))
    return table(spark, d, "documents").groupBy(host.alias("host"), status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def page_of_offset(spark: SparkSession, d: str) -> DataFrame:
    """The page on which character 500 of each font's accumulated text stands."""
    got = accumulate_spans(_spans(spark, d))
    at = F.element_at(F.filter("chunks", lambda c: c.char_start <= 500), -1)
    return got.select("doc_id", "font_name", at.getField("page").alias("page"))


QUERIES = {
    f.__name__: f
    for f in (
        pii_gate, manifest_export, summary_pivot, mapping_export, latest_wins_upsert, insert_ignore, append_only_conflicts, replace_children,
        verify_rebuild, link_discovery, crawled_documents, link_status_counts, page_of_offset,
    )
}

_ANN = f"(SELECT DISTINCT ON (annotation_id) annotation_id, obs_id, {lb.SQL_ANNOTATOR} AS annotator, round, label FROM annotation)"
_MANIFEST = f"{AUDIT}, man AS (SELECT d.sha256, doc_id, filename, source_url, d.issuing_body, d.doc_type, d.lang, a.verdict, a.pages, a.chars, a.dev_chars, a.invalid_rate_per_1k, a.n_fonts FROM documents d LEFT JOIN (SELECT sha256, verdict, pages, chars, dev_chars, invalid_rate_per_1k, n_fonts FROM audit) a USING (sha256))"
_PII = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count_if(regexp_matches({c}, '{cc.re2(cc.DEVANAGARI)}'))::BIGINT AS devanagari, count_if(regexp_matches({c}, '{rl.DOB}'))::BIGINT AS dob, count_if(regexp_matches({c}, '{rl.CASTE}'))::BIGINT AS caste FROM documents"
    for c in GATED
)
_WEB = "u AS (SELECT regexp_extract(source_url, '^(https?://[^/]+)', 1) AS host, regexp_extract(source_url, '^https?://[^/]+(/.*)$', 1) AS path, doc_id, doc_id % 5 AS k FROM documents WHERE source_url IS NOT NULL)"
SQL = {
    "pii_gate": _PII,
    "manifest_export": f"WITH {_MANIFEST} SELECT * FROM man",
    "summary_pivot": f"WITH {_MANIFEST} SELECT issuing_body, count(*) AS n, "
    + ", ".join(f"count_if(coalesce(verdict, 'NONE') = '{v}')::BIGINT AS {v.lower()}" for v in (*rl.VERDICTS, "NONE"))
    + " FROM man GROUP BY issuing_body",
    "mapping_export": """SELECT m.family_id, source, target, origin, n_attested, n_documents, confidence, n_pages, n_files FROM mapping_entry m
LEFT JOIN (SELECT family_id, count(*) AS n_pages, count(DISTINCT sha256) AS n_files FROM (SELECT DISTINCT ON (transcription_id) * FROM transcription) WHERE family_id IS NOT NULL GROUP BY 1) USING (family_id)""",
    "latest_wins_upsert": f"SELECT obs_id, annotator, annotation_id, round FROM (SELECT *, row_number() OVER (PARTITION BY obs_id, annotator ORDER BY round DESC, annotation_id DESC) AS rn FROM {_ANN}) WHERE rn = 1",
    "insert_ignore": "SELECT DISTINCT obs_id FROM annotation_sample WHERE sample_id <> 'gt-v1' AND obs_id NOT IN (SELECT obs_id FROM annotation_sample WHERE sample_id = 'gt-v1')",
    "append_only_conflicts": f"""WITH a AS (SELECT * FROM {_ANN}), o AS (SELECT DISTINCT obs_id, annotator FROM a WHERE round = 1), n AS (SELECT * FROM a WHERE round = 2)
SELECT 'refused' AS outcome, count(*) AS n FROM n SEMI JOIN o USING (obs_id, annotator) UNION ALL SELECT 'appended', count(*) FROM (SELECT DISTINCT obs_id, annotator FROM n ANTI JOIN o USING (obs_id, annotator)) HAVING count(*) > 0""",
    "replace_children": """WITH x AS (SELECT DISTINCT ON (excerpt_id) excerpt_id, obs_id, kind FROM excerpt), v AS (SELECT DISTINCT obs_id FROM x WHERE kind = 'violation')
SELECT kind, count(*) AS n, count(DISTINCT obs_id) AS n_obs FROM (SELECT * FROM x ANTI JOIN v USING (obs_id) UNION ALL SELECT * FROM x WHERE kind = 'violation') GROUP BY kind""",
    "verify_rebuild": """WITH h AS (SELECT doc_id, filename, sha256(text) AS c FROM documents), f AS (SELECT filename, c AS first FROM (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY doc_id) AS rn FROM h WHERE filename IS NOT NULL AND c IS NOT NULL) WHERE rn = 1)
SELECT CASE WHEN c IS NULL THEN 'unreachable' WHEN c = coalesce(first, '') THEN 'verified' ELSE 'changed' END AS status, count(*) AS n FROM h LEFT JOIN f USING (filename) GROUP BY 1""",
    "link_discovery": f"""WITH {_WEB} SELECT DISTINCT host || path AS url, 'document' AS kind FROM u UNION SELECT DISTINCT host || '/board/tender-' || k || '.html', 'page' FROM (SELECT DISTINCT host, unnest(range(5)) AS k FROM u)
 UNION SELECT DISTINCT host || '/board/' || p || '-' || k || '.html', 'page' FROM u, (SELECT unnest(['archive', 'cellar']) AS p)""",
    "crawled_documents": f"WITH {_WEB} SELECT host || path AS url, min(CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 2 END)::INT AS depth FROM u WHERE doc_id % 4 <> 3 GROUP BY 1",
    "link_status_counts": """SELECT regexp_extract(source_url, '^https?://([^/]+)', 1) AS host, CASE WHEN http_status BETWEEN 200 AND 299 AND sha256 IS NOT NULL THEN 'downloaded' WHEN http_status IS NULL THEN 'pending' ELSE 'failed' END AS status, count(*) AS n FROM documents GROUP BY 1, 2""",
    "page_of_offset": f"WITH {_SPANS} SELECT doc_id, font_name, arg_max(page, before) FILTER (before <= 500 AND before < {CAP_CHARS})::INT AS page FROM run GROUP BY 1, 2",
}
