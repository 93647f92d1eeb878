import random

import pytest
from pyspark.sql import functions as F

from tarazu.operators import convert as cv
from tarazu.operators import families as fa
from tarazu.operators import mapping as mp

T1, T2 = cv.Converter(cv.HAND_TABLES["dvttdhruv"]), cv.Converter(cv.HAND_TABLES["apscdv"])


@pytest.mark.parametrize(
    "table,text,want",
    [
        (T1, "xÉÉÊ¶ÉEò", "नाशिक"),
        (T1, "¨É½þÉxÉMÉ®ú{ÉÉÊ±ÉEòÉ", "महानगरपालिका"),
        (T1, "Eò®úhÉä", "करणे"),
        (T2, "ãä½ãß‡ãŠ¦ã", "मिळकत"),
        (T2, "¶ãØãÀ", "नगर"),
        (T2, "½ãìŒ¾ã", "मुख्य"),
        (T2, "ØãðÖãä¶ã½ããÃ¥ã", "गृहनिर्माण"),
    ],
)
def test_anchor_words(table, text, want):
    assert table.convert(text) == (want, 1.0)


def test_conversion_properties():
    assert cv.Converter({"a": "x", "ab": "y"}).convert("ab")[0] == "y"
    assert cv.Converter({"a": "b", "b": "c"}).convert("ab")[0] == "bc"  # output is not processed again
    assert cv.Converter({"a": "x"}).convert("zq") == ("zq", 0.0)
    assert cv.Converter({"a": "x"}).convert("") == ("", 0.0)
    assert cv.Converter({}).convert("abc") == ("abc", 0.0)
    clean = "नाशिक महानगरपालिका"
    assert T1.convert(clean) == (clean, 0.0)
    assert cv.reorder(clean) == clean and cv.reorder(cv.reorder("कि")) == "कि"
    assert cv.MARK not in T1.convert("xÉÉÊ¶ÉEò Ê")[0]
    assert cv.legacy_gate("a" * 99 + "क") and not cv.legacy_gate("a" * 9 + "क") and not cv.legacy_gate(" \n")


def test_similarity_and_window():
    assert cv.similarity("a b", "ab") == 1.0 and cv.similarity("", "x") == 0.0
    assert cv.best_window("xxxxabcdxxxx", "abcd") == 1.0
    assert cv.best_window("", "a") == 0.0 and cv.best_window("ab", "abcd") > 0.5


def test_native_and_python_reorder_agree(spark):
    rng = random.Random(5)
    parts = ["क", "ष", "र", "्", "ि", "ा", "़", cv.MARK + cv.I_MATRA, cv.MARK + cv.REPHA, " "]
    texts = ["".join(rng.choices(parts, k=12)) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(cv.reorder_matras(F.col("t"))).collect()] == [cv.reorder(t) for t in texts]


def test_upper_median(spark):
    for values in ([1.0, 2.0], [3.0, 1.0, 2.0], [5.0], [1.0, 1.0, 2.0, 4.0]):
        got = spark.createDataFrame([(v,) for v in values], "x double").agg(cv.upper_median("x")).first()[0]
        assert got == sorted(values)[len(values) // 2]


def test_excerpts(spark):
    text = "अ" + "ा" + " शब्द" * 200
    df = spark.createDataFrame([(1, text), (2, "short"), (3, " "), (4, None), (2, "short")], "i long, t string")
    got = cv.excerpt_windows(df, "i", "t").collect()
    assert {r["kind"] for r in got if r["i"] == 1} == {"head", "random", "violation"}
    assert [r["excerpt"] for r in got if r["i"] == 2] == ["short", "short"]
    assert not [r for r in got if r["i"] in (3, 4)]
    for r in got:
        assert r["excerpt"] in (text if r["i"] == 1 else "short")


def long_signatures(rows, spark):
    return fa.signatures(spark.createDataFrame(rows, "i long, t string"), "i", "t")


def test_signatures_and_clusters(spark):
    rng = random.Random(2)
    make = lambda signs: "".join(rng.choices(signs, k=300))
    rows = [(i, make("abcd" if i % 2 else "wxyz")) for i in range(40)] + [(99, "too short"), (100, None)]
    sig = long_signatures(rows, spark)
    assert {r[0] for r in sig.select("i").distinct().collect()} == set(range(40))
    assert all(abs(r[1] - 1) < 1e-9 for r in sig.groupBy("i").agg(F.sum("freq")).collect())
    got = {r["i"]: r["family"] for r in fa.greedy_families(sig, "i").collect()}
    assert len(set(got.values())) == 2 and len({got[i] for i in range(0, 40, 2)}) == 1
    blocks = {r["i"]: r["family"] for r in fa.greedy_families(sig, "i", block=9).collect()}
    assert len(set(blocks.values())) == 2 and len({blocks[i] for i in range(1, 40, 2)}) == 1


def single_pass(signatures, threshold):
    """The rule as written down: the first cluster whose running centroid is near enough, in the order given."""
    clusters, out = [], {}
    for item, sig in signatures:
        for cl in clusters:
            dot = sum(v * cl["sum"].get(ch, 0.0) for ch, v in sig.items())
            sim = dot / (sum(v * v for v in sig.values()) * sum(v * v for v in cl["sum"].values())) ** 0.5
            if sim >= threshold:
                for ch, v in sig.items():
                    cl["sum"][ch] = cl["sum"].get(ch, 0.0) + v
                break
        else:
            clusters.append(cl := {"leader": item, "sum": dict(sig)})
            sim = 1.0
        out[item] = cl["leader"], sim
    return out


def test_clusters_follow_the_single_pass_at_any_size(spark):
    rng = random.Random(8)
    signs = "abcdefghijklmnop"
    rows = [(i, "".join(rng.choices(signs[(at := rng.randrange(10)) : at + rng.randrange(2, 7)], k=80))) for i in range(120)]
    sig = long_signatures(rows, spark)
    by: dict = {}
    for r in sorted(sig.collect(), key=lambda r: (r["i"], r["ch"])):
        by.setdefault(r["i"], {})[r["ch"]] = r["freq"]
    want = single_pass(sorted(by.items()), fa.THRESHOLD)
    for block in (9, 4000):
        got = {r["i"]: r for r in fa.greedy_families(sig, "i", block=block).collect()}
        assert got.keys() == want.keys()
        leader = {}
        for i in sorted(got):
            assert leader.setdefault(got[i]["family"], want[i][0]) == want[i][0], i
            assert abs(got[i]["similarity"] - want[i][1]) < 1e-6, i
        assert len(leader) == len({x for x, _ in want.values()})


def test_learning_finds_a_known_cipher(spark):
    rng = random.Random(11)
    cipher = dict(zip("कखगघचछजझटठडतथदधनपबमयरलवसह", "bcdfghjklmnpqrstvwxyzBCDFGHJ"))
    words = ["".join(rng.choices(list(cipher), k=rng.randrange(3, 7))) for _ in range(60)]
    rows = []
    for doc in range(40):
        text = rng.choices(words, k=25)
        rows.append(("f", f"d{doc}", " ".join("".join(cipher[c] for c in w) for w in text), " ".join(text)))
    df = spark.createDataFrame(rows, "family string, doc string, codes string, text string")
    rules = {r["source"]: (r["target"], r["confidence"]) for r in mp.learn(df).collect()}
    learned = cv.Converter(rules)
    # Held-out words made of the same letters: what the rules say letter by letter must carry over.
    unseen = ["".join(rng.choices(list(cipher), k=5)) for _ in range(200)]
    hits = [cv.similarity(learned.convert("".join(cipher[c] for c in w))[0], w) for w in unseen]
    seen = [cv.similarity(learned.convert("".join(cipher[c] for c in w))[0], w) for w in words]
    assert sum(seen) / len(seen) > 0.9, sum(seen) / len(seen)
    assert sum(hits) / len(hits) > 0.6, sum(hits) / len(hits)
    assert mp.learn(df.where("false")).count() == 0


def test_nearest_centroid_both_ways(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(i, "".join(rng.choices("abcdef" if i % 2 else "defghi", k=80))) for i in range(60)] + [(100, "z" * 80), (101, "ab" * 40)]
    sig = long_signatures(rows, spark)
    cents = spark.createDataFrame([("one", "a", 0.5), ("one", "b", 0.5), ("two", "g", 0.4), ("two", "h", 0.6), ("tie", "a", 0.5), ("tie", "b", 0.5), (None, "z", 1.0)], "family string, ch string, freq double")
    show = lambda df: {(r["i"], r["nearest"], round(r["cosine"], 9)) for r in df.collect()}
    a = show(fa.nearest(sig, "i", cents, "family"))
    monkeypatch.setattr(fa, "MOST_CELLS", 3)
    assert show(fa.nearest(sig, "i", cents.where("family IS NOT NULL"), "family")) == a and len(a) == 61
    assert (101, "one", 1.0) in a and 100 not in {x[0] for x in a}
    monkeypatch.undo()
    assert fa.nearest(sig, "i", cents.where("false"), "family").count() == 0
