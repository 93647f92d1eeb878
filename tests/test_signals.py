import random
import re

import pytest
from pyspark.sql import functions as F

from tarazu.functions import fonts as fn
from tarazu.functions import signals as s

L8 = "xÉÉÊ¶ÉEò ¨É½þÉxÉMÉ®ú{ÉÉÊ±ÉEòÉ "
DEV = "नाशिक महानगरपालिका "
LA = "i'kq dY;k.k foHkkx "
EN = "the tender notice for the municipal corporation of the city "


def signals(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = s.with_text_signals(df, "t").withColumn("reason", fn.output_reason())
    return [r.asDict() for r in got.withColumn("label", fn.output_label(F.col("reason"))).orderBy("i").collect()]


def pages(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.asDict() for r in s.with_page_measures(df, "t").orderBy("i").collect()]


def test_output_is_convicted_by_its_own_signs(spark):
    remap = "i'kq dY;k.k foHkkx laf{kIr ifjp; uxj fuxe y[kuÅ ds Ik'kq dY;k.k foHkkx }kjk fu;fer :i ls " * 6
    symbol = "^l.^glmlzaG$l @l_vº$ UVl àdlfG$ mvTn ^glYI`mlzaG$l _l§Ln G$ " * 8
    a, b, c, d, e, f = signals(spark, [L8 * 8, remap, symbol, EN * 8, DEV * 20, L8])
    assert a["label"] == "LEGACY_8BIT" and a["reason"].startswith("8bit(")
    assert b["label"] == "LEGACY_ASCII" and b["ascii_k_ratio"] >= 0.05
    assert c["label"] == "LEGACY_SYMBOL"
    assert d["reason"] is None and d["label"] == "NO_EVIDENCE"
    assert e["reason"] is None
    assert f["label"] == "UNDECIDABLE"


def test_page_gates_and_hashes(spark):
    bad = "�"
    got = pages(spark, [bad * 500, "", None, bad * 4 + "a" * 96, bad * 6 + "b" * 94, "\x00\x01\x02" * 40 + "abc" * 30, "a b\tc" * 20, "abc" * 20, "cab" * 20, DEV * 20])
    assert [g["loss"] for g in got] == ["replacement", "empty", "empty", None, "replacement", "control", None, None, None, None]
    assert got[0]["replacement_ratio"] == 1.0
    assert got[6]["text_hash"] == got[7]["text_hash"]
    assert got[7]["text_hash"] != got[8]["text_hash"] and got[7]["bag_hash"] == got[8]["bag_hash"]
    assert got[9]["dev_share"] > 0.9


def test_structural_counts_against_python(spark):
    rng = random.Random(7)
    alphabet = [chr(c) for c in range(0x900, 0x980)] + list(" ab\u00a0\n")
    texts = ["".join(rng.choices(alphabet, k=60)) for _ in range(150)]
    invalid = re.compile("(?<![\u0915-\u0939\u0958-\u095f\u0978-\u097f\u093c])[\u093a\u093b\u093e-\u094c\u094e\u094f\u0962\u0963]")
    detached = re.compile("\\s[\u093a\u093b\u093e-\u094c\u094e\u094f\u0962\u0963\u094d]")
    for t, g in zip(texts, signals(spark, texts)):
        assert g["invalid_matras"] == len(invalid.findall(t))
        assert g["detached_matras"] == len(detached.findall(t))
        assert g["invalid_matras_nospace"] == len(invalid.findall("".join(t.split())))
        assert g["sampled_chars"] == len("".join(t.split()))


@pytest.mark.parametrize(
    "name,axis",
    [("DVBW-TTSurekh", "name_legacy"), ("Calibri", "name_known_good"), ("TT313t00", "name_uninformative"), ("Z@RAF1C.tmp", "name_uninformative"), ("BookAntiqua", "name_known_good")],
)
def test_name_axis(spark, name, axis):
    df = spark.createDataFrame([(name,)], "n string")
    assert df.select(fn.name_axis(F.col("n"))).first()[0] == axis


def test_base_name(spark):
    df = spark.createDataFrame([("ABCDEF+Mangal",), ("Mangal",), ("LongerName+X",)], "n string")
    assert [r[0] for r in df.select(fn.base_name(F.col("n"))).collect()] == ["Mangal", "Mangal", "LongerName+X"]
