"""Links to documents in the HTML of crawled pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarazu.operators.skew import stitched_rank
from tarazu.session import cut

# Words that mark a page worth following.
HINTS = (
    "tender", "budget", "download", "notice", "circular", "report", "rti",
    "document", "publication", "act", "rule", "policy", "scheme", "archive",
    "citizen", "department", "annual", "resolution", "gr", "advertisement",
    "recruitment", "quotation", "nit", "eoi", "dpr", "minutes",
)
#: Addresses that stand where a link will be, or that only act in a browser.
PLACEHOLDERS = "^(javascript|about|data):|^(undefined|null|#)$|\\{\\{|%7b%7b"
MOST_UP = 6
_ANCHOR = "(?is)<a\\s[^>]*?href\\s*=\\s*[\"']([^\"']*)[\"'][^>]*>(.*?)</a>"


def discovered(pages: DataFrame, url: str, html: str, document: str = ".pdf") -> DataFrame:
    """``url, from_url, kind``: documents and pages to follow, each URL once, the first page that links it wins.

    Relative links are resolved against the page ("../", "./" and "?query" too), fragments
    dropped, other schemes and placeholder addresses ignored; links must stay on the page's host. ``kind`` is "document" where the link
    holds ``document``, else "page" where the link or its text holds a hint.
    """
    rows = pages.select(F.col(url).alias("from_url"), F.col(html).alias("html")).where("from_url IS NOT NULL AND html IS NOT NULL")
    hrefs, texts = F.regexp_extract_all("html", F.lit(_ANCHOR), F.lit(1)), F.regexp_extract_all("html", F.lit(_ANCHOR), F.lit(2))
    links = rows.select("from_url", F.posexplode(F.arrays_zip(hrefs.alias("href"), texts.alias("label"))).alias("pos", "x")).select(
        "from_url", "pos", F.trim("x.href").alias("href"), F.lower(F.concat_ws(" ", "x.href", "x.label")).alias("blob")
    )
    host = F.regexp_extract("from_url", "^(https?://[^/?#]+)", 1)
    folder = F.regexp_extract("from_url", "^(https?://[^/?#]+(?:/[^?#]*/|/)?)", 1)
    h = F.col("href")
    full = (
        F.when(h.rlike("^(?i)https?://"), h)
        .when(h.startswith("//"), F.concat(F.regexp_extract("from_url", "^(https?:)", 1), h))
        .when(h.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:") | h.startswith("#") | (h == ""), None)
        .when(h.startswith("/"), F.concat(host, h))
        .when(h.startswith("?"), F.concat(F.regexp_extract("from_url", "^([^?#]*)", 1), h))
        .otherwise(F.concat(F.regexp_replace(folder, "([^/])$", "$1/"), h))
    )
    url_, query = F.regexp_extract(full, "^([^?#]*)", 1), F.regexp_extract(full, "^[^?#]*(\\?[^#]*)?", 1)
    url_ = F.regexp_replace(url_, "/(?:\\./)+", "/")
    for _ in range(MOST_UP):  # one step up a time, from the left
        url_ = F.regexp_replace(url_, "^(https?://[^/]+(?:/[^/]+)*?)/(?!\\.\\./)[^/]+/\\.\\./", "$1/")
    url_ = F.regexp_replace(url_, "^(https?://[^/]+)/(?:\\.\\./)+", "$1/")  # above the root is the root
    got = links.withColumns({"url": F.concat(url_, query), "host": host}).where(full.isNotNull() & ~F.lower("href").rlike(PLACEHOLDERS))
    got = got.where(F.regexp_extract("url", "^(https?://[^/?#]+)", 1) == F.col("host"))
    hint = F.lit(False)
    for w in HINTS:
        hint = hint | F.contains("blob", F.lit(w))
    kind = F.when(F.contains(F.lower("href"), F.lit(document)), "document").when(hint, "page")
    got = got.withColumn("kind", kind).where(F.col("kind").isNotNull())
    return got.groupBy("url").agg(F.min(F.struct("from_url", "pos", "kind")).alias("x")).select("url", "x.from_url", "x.kind")


def crawl(pages: DataFrame, seeds: DataFrame, depth: int = 2, most_pages: int = 40, document: str = ".pdf") -> DataFrame:
    """``url, from_url, depth``: the documents linked by pages within ``depth`` steps of the seeds.

    ``pages``: url, html, one row per fetched page; ``seeds``: url. Level by level: the
    pages of the frontier are opened, what they link is new frontier unless it was opened
    before, and a host opens at most ``most_pages`` pages, earlier levels and smaller
    addresses first. Each document counts at its least depth, then its smallest page.
    """
    host = F.regexp_extract("url", "^(https?://[^/?#]+)", 1)
    frontier = seeds.select("url").where("url IS NOT NULL").distinct()
    opened, found = None, None
    for level in range(depth + 1):
        ranked = stitched_rank(frontier.withColumn("host", host), "host", ["url"], "place")
        if opened is not None:
            used = opened.groupBy("host").agg(F.count(F.lit(1)).alias("used"))
            ranked = ranked.join(used, "host", "left").withColumn("place", F.col("place") + F.coalesce("used", F.lit(0)))
        now = cut(ranked.where(F.col("place") <= most_pages).select("url", "host"))
        links = cut(discovered(pages.join(now.select("url"), "url", "left_semi"), "url", "html", document))
        docs = links.where("kind = 'document'").select("url", "from_url", F.lit(level).alias("depth"))
        found = docs if found is None else found.unionByName(docs)
        opened = now if opened is None else cut(opened.unionByName(now))
        frontier = links.where("kind = 'page'").select("url").join(opened.select("url"), "url", "left_anti")
    return found.groupBy("url").agg(F.min(F.struct("depth", "from_url")).alias("x")).select("url", "x.from_url", "x.depth")
