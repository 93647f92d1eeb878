import random

import pytest

from tarazu.llm.visual_form import Canonicalizer, VocabularyTries, is_proper, look, table_form, visual_form

SAME = [
    ("the", "ｔｈｅ"), ("é", "é"), ("a b", "a b"), ("a b", "a　 b"), ("ab", "a​b"), ("ab", "﻿ab‎"), ("sea", "ѕеа"), ("fine", "ﬁne"),
    ("IV", "Ⅳ"), ("a-b", "a‑b"), ("आ", "अा"), ("ओ", "अाे"), ("को", "काे"), ("फ़", "फ़"), ("Ω", "Ω"), ("µ", "μ"), ("क", "क‍"), ("x.", "x．"), ("co­op", "coop"),
]
APART = [("a", "A"), ("2", "²"), ("3/4", "¾"), ("3", "३"), ("क्ष", "क्‍ष"), ("क्‌ष", "क्‍ष"), ("rn", "m"), ("0", "O"), ("कि", "की"), ("ab", "a b"), ("x", "×"), ("a–b", "a-b")]


@pytest.mark.parametrize("a,b", SAME)
def test_looks_the_same(a, b):
    c = Canonicalizer(["the", "fine", "coop", "आ"])
    assert c.text(a) == c.text(b)


@pytest.mark.parametrize("a,b", APART)
def test_looks_different(a, b):
    c = Canonicalizer(["the"])
    assert c.text(a) != c.text(b)


def test_automaton_agrees_with_the_table():
    rng = random.Random(4)
    signs = list("aeoсеоﬁ-‐жλkο") + ["​", "‍", "्", "क", "अ", "ा", "े", "é", "é", "ｆ", "I", "Ⅱ"]
    tokens = ["".join(rng.choices(signs, k=rng.randrange(1, 7))) for _ in range(4000)]
    words = [t for t in tokens[:2000] if t and is_proper(t)]
    words += [t for t in map(table_form, tokens[:2000]) if t]
    tries = VocabularyTries(words)
    first: dict[str, str] = {}
    for w in words:
        first.setdefault(look(w), w)
    found = 0
    for t in tokens:
        assert look(look(t)) == look(t) == look(table_form(t)) and table_form(table_form(t)) == table_form(t)
        got = tries.match(t)
        if got is not None:
            found += 1
            assert got == first[look(t)]
        elif look(t) in first and " " not in look(t):
            raise AssertionError((t, look(t)))
    assert found > 500


def test_words_of_another_script_keep_it():
    c = Canonicalizer([])
    for w in ("Москва", "Αθήνα", "ёлка", "όλοι", "совет"):
        assert c.text(w) == w
    assert c.text("Mocквa") == "Москва" and c.text("cobeт") == "cobeт"  # b is Latin, т Cyrillic: the look stays
    assert c.text("ﬁsh аnd") == "fish and"


def test_the_vocabulary_decides_between_spellings(spark):
    texts = ["сор сор сор", "cop", "cоp​ Москва", "роса", "ΚΟΜΜΑ ΚΟΜΜΑ KOMMA"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    with_it = {r["id"]: r["t_form"] for r in visual_form(df, ["t"]).collect()}
    without = {r["id"]: r["t_form"] for r in visual_form(df, ["t"], vocabulary_size=0).collect()}
    assert with_it == {0: "сор сор сор", 1: "сор", 2: "сор Москва", 3: "poca", 4: "ΚΟΜΜΑ ΚΟΜΜΑ ΚΟΜΜΑ"}
    assert without == {0: "cop cop cop", 1: "cop", 2: "cop Москва", 3: "poca", 4: "KOMMA KOMMA KOMMA"}


def test_weighted_edits():
    tries = VocabularyTries(["notice", "office"], max_cost=1)
    assert tries.match("noticе") == "notice"  # a look-alike costs nothing
    assert tries.match("notlce") == "notice" and tries.match("offce") == "office" and tries.match("offfice") == "office"
    assert tries.match("nothing") is None and VocabularyTries(["notice"]).match("notlce") is None


def test_rows(spark):
    rows = [(1, "ａ​ b", None, "x"), (2, None, "", "y"), (3, "  \n", "a b", None), (1, "ａ​ b", None, "x"), (4, "x" * 30000 + " ‍", "अा " * 9000, "z")]
    df = spark.createDataFrame(rows, "id long, human_text string, ocr_text string, human_text_form string")
    got = visual_form(df, ["human_text", "ocr_text"]).collect()
    assert len(got) == 5
    by = {r["id"]: r for r in got}
    assert (by[1]["human_text_form"], by[1]["ocr_text_form"]) == ("a b", None)
    assert (by[2]["human_text_form"], by[2]["ocr_text_form"]) == (None, "")
    assert (by[3]["human_text_form"], by[3]["ocr_text_form"]) == ("", "a b")
    assert by[4]["ocr_text_form"] == " ".join(["आ"] * 9000)
    assert visual_form(df.where("false"), ["human_text"]).count() == 0


def test_readings_are_equal_whatever_the_vocabulary(spark):
    rows = [(i, w) for i, w in enumerate(["sea ѕеа", "ﬁne fine fine", "sea", "अा आ आ", "ѕеа ѕеа"])]
    df = spark.createDataFrame(rows, "id long, t string")
    for size in (0, 1, 50):
        got = [r["t_form"] for r in visual_form(df, ["t"], vocabulary_size=size).orderBy("id").collect()]
        assert [len(set(x.split())) for x in got] == [1, 1, 1, 1, 1] and got[0].split()[0] == got[2]
