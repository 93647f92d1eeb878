import json
import zlib
from email.message import Message
from urllib.error import HTTPError

import pytest
from pyspark.sql import functions as F

from tarazu.operators import arms as ar
from tarazu.operators import inventory as fi
from tarazu.operators import links as lk
from tarazu.sources import extract as ex
from tarazu.sources import paged, tables
from tarazu.sources.pdf import Pdf, parse
from tarazu.streaming import incremental as inc


def pdf(pages=(("Hello",),), title=b"(A title)", packed=True, encrypt=False):
    """A PDF with one font in two pages' resources, an embedded one with a Unicode map on the first page."""
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 4: b"<< /Type /Font /Subtype /Type1 /BaseFont /ABCDEF+Helv /Encoding /WinAnsiEncoding >>"}
    cmap = b"beginbfchar <01> <0915> endbfchar beginbfrange <02> <03> <093F> endbfrange"
    objects[5] = b"<< /Type /Font /Subtype /TrueType /BaseFont /Deva /FontDescriptor 6 0 R /ToUnicode 7 0 R >>"
    objects[6] = b"<< /Type /FontDescriptor /FontName /Deva /FontFile2 7 0 R >>"
    objects[7] = b"<< /Length %d >>\nstream\n%s\nendstream" % (len(cmap), cmap)
    objects[8] = b"<< /Title %s /Producer (made by \\(hand\\) \\101) >>" % title
    kids = []
    for i, lines in enumerate(pages):
        body = b"BT /F1 12 Tf " + b" T* ".join(b"(%s) Tj" % x.encode("cp1252") for x in lines) + b" ET"
        if i == 0:
            body += b" BT /F2 9 Tf [<01> -10 <02>] TJ ET"
        data = zlib.compress(body) if packed else body
        page, stream = 10 + 2 * i, 11 + 2 * i
        extra = b" /Filter /FlateDecode" if packed else b""
        objects[stream] = b"<< /Length %d%s >>\nstream\n%s\nendstream" % (len(data), extra, data)
        fonts = b"/F1 4 0 R /F2 5 0 R" if i == 0 else b"/F1 4 0 R"
        objects[page] = b"<< /Type /Page /Parent 2 0 R /Resources << /Font << %s >> >> /Contents %d 0 R >>" % (fonts, stream)
        kids.append(b"%d 0 R" % page)
    objects[2] = b"<< /Type /Pages /Count %d /Kids [%s] >>" % (len(kids), b" ".join(kids))
    raw = b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, v) for n, v in objects.items())
    return raw + b"trailer << /Root 1 0 R /Info 8 0 R" + (b" /Encrypt 9 0 R" if encrypt else b"") + b" >>\n%%EOF"


def test_values():
    assert parse(b"<< /A 1 /B [2.5 (x\\)\\n(y)) <41 4> 3 0 R] /C#20D true >>")[0] == {"A": 1, "B": [2.5, b"x)\n(y)", b"A@", 3], "C D": "true"}
    assert parse(b"")[0] is None and parse(b"  % only a comment")[0] is None


@pytest.mark.parametrize("packed", [True, False])
def test_pdf_structure(packed):
    doc = Pdf(pdf((("One", "two é"), ("Second",)), packed=packed))
    assert [doc.text(p) for p in doc.pages()] == ["One\ntwo é\nकि", "Second"]
    fonts = {f["raw_font_name"]: f for f in doc.inventory()}
    assert (fonts["ABCDEF+Helv"]["pages"], fonts["ABCDEF+Helv"]["embedded"], fonts["ABCDEF+Helv"]["has_tounicode"]) == ([1, 2], 0, 0)
    assert (fonts["Deva"]["pages"], fonts["Deva"]["embedded"], fonts["Deva"]["has_tounicode"], fonts["Deva"]["xref"]) == ([1], 1, 1, 5)
    assert doc.info() == {"Title": "A title", "Producer": "made by (hand) A"}
    for bad in (b"", b"text", pdf(encrypt=True)):
        with pytest.raises(ValueError):
            Pdf(bad)


def test_object_streams():
    inner = b"4 0 9 30 << /Type /Font /BaseFont /X >>    << /Title (packed) >>"
    raw = b"%%PDF-1.5\n3 0 obj << /Type /ObjStm /N 2 /First 9 /Length %d >>\nstream\n%s\nendstream endobj\ntrailer << /Info 9 0 R >>" % (len(inner), inner)
    doc = Pdf(raw)
    assert doc.objects[4]["BaseFont"] == "X" and doc.info() == {"Title": "packed"}


def test_audit_source_and_inventory(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(pdf([("p%d" % i,) for i in range(70)], title=b"(" + b"t" * 200 + b")"))
    (tmp_path / "b.pdf").write_bytes(pdf(encrypt=True))
    (tmp_path / "c.pdf").write_bytes(b"junk")
    (tmp_path / "d.pdf").write_bytes(pdf(title=b"<FEFFD83D>"))
    found = ex.files(spark, str(tmp_path))
    rows = {r["path"][-5]: r for r in ex.audit_source(found).collect()}
    assert {k: r["status"] for k, r in rows.items()} == {"a": "OK", "b": "ERROR", "c": "ERROR", "d": "OK"}
    assert rows["b"]["error"] == "ValueError: encrypted" and rows["b"]["text"] is None
    a = rows["a"]
    assert (a["n_pages"], a["sampled_pages"], len(a["title"])) == (70, 30, 60)
    sampled = a["text"].split("\f")
    assert len(sampled) == 30 and sampled[0].startswith("p0") and sampled[-1] == "p67"
    assert rows["d"]["title"] == ""  # an unpaired surrogate is dropped
    inventory = ex.font_inventory(found)
    names = {(r["font_name"], r["n_xrefs"], r["n_pages"], r["first_page"]) for r in fi.collapse(inventory, "xref").collect()}
    assert names == {("Helv", 1, 70, 1), ("Deva", 1, 1, 1), ("Helv", 1, 1, 1)}
    spans = ex.font_spans(found).groupBy("sha256", "font_name").agg(F.concat_ws("", F.collect_list("piece")).alias("text"))
    seen = fi.observed(fi.collapse(inventory.withColumn("font_name", F.col("raw_font_name")), "xref"), spans)
    assert {r["seen"] for r in seen.collect()} == {"both"} and seen.count() == 4


def test_inventory_outer_join(spark):
    refs = spark.createDataFrame([("s", 1, "A", "X+A", 0, 1, [1, 2]), ("s", 2, "A", "A", 1, 0, [2, 3]), ("s", 3, None, None, 0, 1, [9])], "sha256 string, xref int, font_name string, raw_font_name string, embedded int, has_tounicode int, pages array<int>")
    one = {r["font_name"]: r for r in fi.collapse(refs, "xref").collect()}
    assert tuple(one["A"])[2:] == (2, 1, 0, 3, 1, "X+A")
    spans = spark.createDataFrame([("s", "A", 5), ("s", "B", 7), ("t", None, 1)], "sha256 string, font_name string, n_chars int")
    got = {(r["sha256"], r["font_name"]): r["seen"] for r in fi.observed(fi.collapse(refs, "xref"), spans).collect()}
    assert got == {("s", "A"): "both", ("s", None): "inventory only", ("s", "B"): "spans only", ("t", None): "spans only"}


def test_arms_on_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(pdf())
    (tmp_path / "b.pdf").write_bytes(pdf(encrypt=True))
    got = ex.extract(ex.files(spark, str(tmp_path)), {"content": ex.content}).collect()
    assert {(r["page"], r["text"], r["error"]) for r in got} == {(1, "Hello\nकि", None), (0, None, "ValueError: encrypted")}
    errors = spark.createDataFrame([("x",), ("x",)], "arm string")
    pages = spark.createDataFrame([(1, 1, "b", "x", 9, 0, 0, None), (1, 1, "b", "y", 9, 0, 0, None)], "doc_id int, page int, body string, arm string, n_chars long, replacement_chars long, control_chars long, loss string")
    assert {r["arm"]: r["errors"] for r in ar.loss_report(pages, errors).collect()} == {"x": 2, "y": 0}
    assert {r["errors"] for r in ar.loss_report(pages).collect()} == {0}


def test_missing_files(spark):
    assert ex.is_missing(FileNotFoundError("x")) and ex.is_missing(RuntimeError("cannot open: No such file")) and not ex.is_missing(ValueError("encrypted"))
    df = spark.createDataFrame([("FileNotFoundError: x",), ("ValueError: encrypted",), (None,)], "e string")
    assert [r[0] for r in df.select(ex.missing(F.col("e"))).collect()] == [True, False, False]


def test_surrogates():
    assert ex.sanitized("a\ud83db") == "ab" and ex.sanitized("😀") == "😀" and ex.sanitized(None) is None and ex.sanitized("abc", 2) == "ab"


def error(code, after=None):
    head = Message()
    if after:
        head["Retry-After"] = after
    return HTTPError("u", code, "", head, None)


def polite(answers, robots=False):
    waits, calls = [], []

    def fetch(url):
        calls.append(url)
        if url.endswith("/robots.txt"):
            return b"User-agent: *\nDisallow: /private\nCrawl-delay: 7"
        x = answers.pop(0)
        if isinstance(x, Exception):
            raise x
        return x

    return paged.Polite(fetch, waits.append, lambda: 0.0, robots), waits, calls


def test_refusals_and_retries():
    p, waits, calls = polite([error(429, "11"), error(503), b"ok"])
    assert p.get("https://h.example/x") == b"ok" and 11.0 in waits
    p, _, calls = polite([error(503)] * 3)
    with pytest.raises(paged.Refused):
        p.get("https://h.example/x")
    p, _, calls = polite([error(404)])
    with pytest.raises(HTTPError):
        p.get("https://h.example/x")
    assert len(calls) == 1
    p, _, calls = polite([OSError()] * 3 + [b"secure"])
    assert p.get("http://h.example/x") == b"secure" and calls[-1] == "https://h.example/x"


def test_robots():
    p, waits, calls = polite([b"ok"], robots=True)
    assert p.get("https://h.example/open") == b"ok" and 7.0 in waits and calls[0] == "https://h.example/robots.txt"
    with pytest.raises(paged.Refused):
        p.get("https://h.example/private/x")
    assert calls.count("https://h.example/robots.txt") == 1


def test_offline_labels(spark, tmp_path):
    rows = [(1, "CORRECT", "deva", "succeeded"), (2, "legacy-8bit", None, "succeeded"), (3, "NONSENSE", "deva", "succeeded"), (4, "CORRECT", "klingon", "succeeded"), (5, "CORRECT", "deva", "refused")]
    (tmp_path / "l.jsonl").write_text("\n".join(json.dumps({"obs_id": a, "annotator": "m", "round": 1, "label": b, "script": c, "status": d}) for a, b, c, d in rows))
    assert {r["obs_id"] for r in tables.offline_labels(spark, str(tmp_path / "l.jsonl")).collect()} == {1, 2}


def test_retry_and_breaker(spark, tmp_path):
    src, sink, state = (str(tmp_path / x) for x in ("src", "sink", "state"))
    rows = spark.range(12).selectExpr("id AS k")
    rows.write.parquet(src)
    gone = lambda df: df.withColumn("error", F.lit("FileNotFoundError: disk"))
    with pytest.raises(Exception, match="files are missing"):
        inc.run_pass(spark, src, sink, state, ["k"], gone, error="error", missing=ex.missing)
    some = lambda df: df.withColumn("error", F.when(F.col("k") < 3, "ValueError: encrypted"))
    inc.run_pass(spark, src, sink, state, ["k"], some, error="error", missing=ex.missing)
    assert spark.read.parquet(sink).count() == 12
    later = lambda df: df.withColumn("error", F.when(F.col("k") == 0, "ValueError: still"))
    assert inc.retry(spark, rows, sink, ["k"], later, "error") == 3
    assert inc.retry(spark, rows, sink, ["k"], later, "error") == 1
    got = inc.latest_success(spark.read.parquet(sink), ["k"], "error").collect()
    assert len(got) == 12 and [r["k"] for r in got if r["error"]] == [0]
    assert inc.retry(spark, rows, str(tmp_path / "none"), ["k"], later, "error") == 0


@pytest.mark.parametrize(
    "href,want",
    [("../a.pdf", "https://h.example/a.pdf"), ("../../../a.pdf", "https://h.example/a.pdf"), ("./a.pdf?x=1#p", "https://h.example/d/a.pdf?x=1"), ("?f=a.pdf", "https://h.example/d/i.html?f=a.pdf"), ("e/../f/./a.pdf", "https://h.example/d/f/a.pdf"), ("javascript:a.pdf", None), ("{{file}}.pdf", None)],
)
def test_relative_links(spark, href, want):
    df = spark.createDataFrame([("https://h.example/d/i.html", f"<a href='{href}'>x</a>")], "u string, h string")
    assert [r["url"] for r in lk.discovered(df, "u", "h").collect()] == ([want] if want else [])


def test_crawl_depth_and_cap(spark):
    page = lambda *links: " ".join(f"<a href='{x}'>notice</a>" for x in links)
    web = [
        ("https://h.example/", page("a.html", "b.html", "r.pdf")), ("https://h.example/a.html", page("a1.html", "a.pdf", "/")), ("https://h.example/a1.html", page("a2.html", "a1.pdf", "a.pdf")),
        ("https://h.example/a2.html", page("a2.pdf")), ("https://h.example/b.html", page("b.pdf")),
    ]
    pages, seeds = spark.createDataFrame(web, "url string, html string"), spark.createDataFrame([("https://h.example/",)], "url string")
    at = lambda df: {r["url"].rsplit("/", 1)[1]: r["depth"] for r in df.collect()}
    assert at(lk.crawl(pages, seeds)) == {"r.pdf": 0, "a.pdf": 1, "b.pdf": 1, "a1.pdf": 2}
    assert at(lk.crawl(pages, seeds, most_pages=2)) == {"r.pdf": 0, "a.pdf": 1}
    assert at(lk.crawl(pages, seeds.where("false"))) == {}


def test_downloads_by_content():
    bodies, kept, known = {"a": [b"on", b"e"], "b": [b"one"], "c": [b"x" * 9] * 9}, {}, set()
    got = [paged.download(u, lambda u: iter(bodies[u]), kept.__setitem__, known, 50) for u in "ab"]
    assert got[0][0] == got[1][0] and [x[1:] for x in got] == [(3, True), (3, False)] and list(kept.values()) == [b"one"]
    with pytest.raises(paged.TooLarge):
        paged.download("c", lambda u: iter(bodies[u]), kept.__setitem__, known, 50)
