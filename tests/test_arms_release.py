import json

import pytest

from tarazu.functions import signals as s
from tarazu.operators import arms as ar
from tarazu.operators import dedupe as dd
from tarazu.operators import links as lk
from tarazu.operators import release as rl
from tarazu.sources import extract as ex
from tarazu.sources import paged, tables
from tarazu.streaming.incremental import run_pass

L8 = "xÉÉÊ¶ÉEò ¨É½þÉxÉMÉ®ú{ÉÉÊ±ÉEòÉ " * 12
DEV = "नाशिक महानगरपालिका " * 20
EN = "the tender notice for the municipal corporation of the city " * 6


@pytest.mark.parametrize(
    "arm,ref,want",
    [(L8, DEV, "script_mismatch"), (DEV, DEV, "match"), (EN, EN, "match"), ("", DEV, "loss"), (DEV, None, "no_reference"), (DEV, "", "no_reference"), (DEV, EN, "script_excess")],
)
def test_concordance(spark, arm, ref, want):
    rows = [(1, 1, "b", "pymupdf", arm)] + ([(1, 1, "b", "ocr", ref)] if ref is not None else [])
    df = s.with_page_measures(spark.createDataFrame(rows, "doc_id long, page int, body string, arm string, t string"), "t")
    assert ar.concordance(df).first()["concordance"] == want


def test_agreement(spark):
    base = "abcdefghijklmnopqrstuvwxyz"
    rows = [(1, 1, "b", a, t) for a, t in (("x", base), ("y", base[::-1]), ("z", base + " "))] + [(2, 1, "b", "x", base)]
    df = s.with_page_measures(spark.createDataFrame(rows, "doc_id long, page int, body string, arm string, t string"), "t")
    got = {(r["arm_a"], r["arm_b"]): (r["identical"], r["same_characters"], r["differ"]) for r in ar.pairwise_agreement(df).collect()}
    assert got == {("x", "y"): (0, 1, 0), ("x", "z"): (1, 0, 0), ("y", "z"): (0, 1, 0)}
    assert tuple(ar.all_arms_identical(df).first()) == (1, 0)


def test_personal_data_gate(spark):
    df = spark.createDataFrame([("ok", "born 01-02-1980", "SC"), ("नमस्ते", "1/1/2001x", "DISC")], "a string, b string, c string")
    got = {r["column"]: (r["devanagari"], r["dob"], r["caste"]) for r in rl.personal_data(df).collect()}
    assert got == {"a": (1, 0, 0), "b": (0, 1, 0), "c": (0, 0, 1)}
    with pytest.raises(rl.PersonalDataError):
        rl.gate(df)
    rl.gate(df.selectExpr("'plain' AS a"))


def test_sinks(spark):
    a = spark.createDataFrame([(1, 1, "x"), (2, 1, "y")], "k int, t int, v string")
    b = spark.createDataFrame([(2, 2, "z"), (3, 1, "w"), (3, 1, "w")], "k int, t int, v string")
    assert {(r["k"], r["v"]) for r in dd.upsert(a, b, ["k"], ["t", "v"]).collect()} == {(1, "x"), (2, "z"), (3, "w")}
    assert [r["k"] for r in dd.insert_ignore(a, b, ["k"]).collect()] == [3]
    fresh, refused = dd.append_unique(a, b, ["k"])
    assert ([r["k"] for r in fresh.collect()], [r["k"] for r in refused.collect()]) == ([3], [2])
    assert sorted(r["k"] for r in dd.replace_children(a, b, "k").collect()) == [1, 2, 3, 3]


def test_links(spark):
    html = """<a href="/x/One.PDF#p">One</a><a href='two.html'>Annual budget</a><a href="mailto:a@b">m</a>
<a href="https://other.example/z.pdf">o</a><a href="plain.html">nothing</a><a href="/x/One.PDF">again</a><a href="//h.example/y.pdf">y</a>"""
    df = spark.createDataFrame([("https://h.example/dir/index.html", html), ("https://h.example", None)], "u string, h string")
    got = {(r["url"], r["kind"]) for r in lk.discovered(df, "u", "h").collect()}
    assert got == {("https://h.example/x/One.PDF", "document"), ("https://h.example/dir/two.html", "page"), ("https://h.example/y.pdf", "document")}


def test_extraction_rows(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("one\ftwo".encode())
    (tmp_path / "b.txt").write_bytes(b"\xff\xfe")
    got = ex.extract(ex.files(spark, str(tmp_path), "*.txt"), {"plain": ex.plain_text}).collect()
    assert {(r["page"], r["text"]) for r in got if r["error"] is None} == {(1, "one"), (2, "two")}
    bad = [r for r in got if r["error"]]
    assert len(bad) == 1 and bad[0]["page"] == 0 and bad[0]["error"].startswith("UnicodeDecodeError")


def test_paged_source(spark, tmp_path):
    for i in range(3):
        page = {"data": [{"id": f"{i}-{k}"} for k in range(2)], "links": {"next": f"p{i + 1}.json" if i < 2 else None}}
        (tmp_path / f"p{i}.json").write_text(json.dumps(page))
    spark.dataSource.register(paged.PagedJson)
    got = spark.read.format("paged_json").option("start", f"file://{tmp_path}/p0.json").load().collect()
    assert [json.loads(r["record"])["id"] for r in got] == ["0-0", "0-1", "1-0", "1-1", "2-0", "2-1"]


def test_offsets_and_politeness():
    for n in (0, 1, 2, 17, 1000):
        assert paged.pool_size(lambda i, n=n: i < n) == n
    assert paged.draw_offsets(10, 3, 1) == paged.draw_offsets(10, 3, 1) and len(paged.draw_offsets(2, 5, 1)) == 2
    waits, calls = [], []

    def fetch(url):
        calls.append(url)
        if len(calls) == 1:
            raise OSError
        return b"ok"

    p = paged.Polite(fetch, waits.append, lambda: 0.0)
    assert p.get("https://h.example/x") == b"ok" and len(calls) == 2
    p.get("https://h.example/y")
    assert all(0 < w <= paged.Polite.CAP_S for w in waits) and len(waits) >= 2


def test_schema_and_union(spark):
    a = spark.createDataFrame([(1, "x")], "b int, a string")
    got = tables.conformed(a, "a string, b long, c double")
    assert got.dtypes == [("a", "string"), ("b", "bigint"), ("c", "double")] and got.first()["c"] is None
    assert tables.union_by_keys([a, spark.createDataFrame([(2.0,)], "z double")]).columns == ["a", "b", "z"]


def test_incremental_pass(spark, tmp_path):
    src, sink, state = (str(tmp_path / x) for x in ("src", "sink", "state"))
    spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "k int, v string").write.parquet(src)
    run_pass(spark, src, sink, state, ["k"], lambda df: df)
    assert spark.read.parquet(sink).count() == 2
    spark.createDataFrame([(2, "again"), (3, "c")], "k int, v string").write.mode("append").parquet(src)
    run_pass(spark, src, sink, state, ["k"], lambda df: df)
    run_pass(spark, src, sink, state, ["k"], lambda df: df)
    assert {(r["k"], r["v"]) for r in spark.read.parquet(sink).collect()} == {(1, "a"), (2, "b"), (3, "c")}


def test_time_of_export(spark):
    now = spark.range(1).select(rl.utc_now().alias("t")).first()["t"]
    assert len(now) == 20 and now[10] == "T" and now[-1] == "Z"
