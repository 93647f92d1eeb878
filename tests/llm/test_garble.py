import random

import pytest

from tarazu.llm.garble import FOREIGN, Describer, Trainer, _passage, decoders, garbled, train

NOUNS = "notice tender office ledger bridge drain street water budget record clause pump meter survey permit".split()
VERBS = "was filed|is placed|shall be kept|has been read|was sent|is approved".split("|")
DEVA = "दिनांक पूर्वी विभागाने मंजूर केले आहे प्रभाग समितीने निविदा सूचना रस्त्याचे काम पाणी पुरवठा शाखेने नोंद".split()
LETTERS = sorted({ch for w in DEVA for ch in w})
RULES = {"f1": {ch: chr(0xA1 + i) for i, ch in enumerate(LETTERS)}}
UNRULED = {ch: chr(0xEF - i) for i, ch in enumerate(LETTERS)}


def english(rng):
    return " ".join(f"The {rng.choice(NOUNS)} of the {rng.choice(NOUNS)} {rng.choice(VERBS)} before {rng.randrange(1, 30)} May." for _ in range(2))


def marathi(rng):
    return " ".join(rng.choices(DEVA, k=14)) + "."


def coded(text, table):
    return "".join(table.get(ch, ch) for ch in text)


@pytest.fixture(scope="module")
def look():
    rng = random.Random(1)
    sound = {"en": [english(rng) for _ in range(400)], "mr": [marathi(rng) for _ in range(400)]}
    rules = {"f1": {v: k for k, v in RULES["f1"].items()}}
    examples = {"f1": [], "f9": [coded(marathi(rng), UNRULED) for _ in range(120)]}
    more = [f"M/s Société Marnière and Bjørnvik Ståhl quoted ₹ {i} for ½ inch – see “note”." for i in range(40)]
    return Describer(Trainer().model(sound, rules, examples, more))


def test_sound_text_is_left_alone(look):
    rng = random.Random(2)
    texts = [english(rng), marathi(rng), "M/s Société Marnière quoted ₹ 7 for ½ inch – see “note”.", "Bjørnvik Ståhl", "SÃO", "12 m³", "करवेा िदनांक", "", " ", "क" * 20000, "word " * 20000, "ABC-12/3"]
    for t in texts:
        assert look.examine(t) is None, t[:50]


@pytest.mark.parametrize("table", ["cp1252", "mac_roman", "cp437", "koi8_r", "latin-1"])
def test_one_misreading_is_undone(look, table):
    rng = random.Random(3)
    for t in (marathi(rng), f"M/s Société Marnière quoted ₹ 5 for ½ inch – {english(rng)}"):
        lenient = table == "cp1252"
        raw = t.encode()
        shown = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in raw) if lenient else raw.decode(table)
        kind, chain, restored = look.examine(shown)
        assert (kind, restored) == ("encoding", t), chain


def test_repeated_and_partial_misreading(look):
    rng = random.Random(4)
    t = marathi(rng)
    cp = lambda x: "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in x.encode())
    assert look.examine(cp(cp(t)))[2] == t
    words = t.split(" ")
    mixed = " ".join(words[:4] + [cp(w) for w in words[4:9]] + words[9:])
    assert look.examine(mixed)[2] == t
    swapped = "".join(chr(ord(c) >> 8 | (ord(c) & 255) << 8) if c > "\x7f" else c for c in t)
    assert look.examine(swapped)[2] == t


def test_glyph_codes(look):
    rng = random.Random(5)
    t = marathi(rng)
    kind, family, restored = look.examine(coded(t, RULES["f1"]))
    assert (kind, family, restored) == ("glyph codes", "f1", t)
    beside = marathi(rng) + " " + coded(t, RULES["f1"])
    assert look.examine(beside)[0] == "glyph codes"
    kind, family, restored = look.examine(coded(marathi(rng), UNRULED))
    assert (kind, family, restored) == ("glyph codes", "f9", None)
    never_met = {ch: c for ch, c in zip(UNRULED, random.Random(9).sample([chr(c) for c in range(0xA1, 0xF0)], len(UNRULED)))}
    kind, _, restored = look.examine(coded(marathi(rng) + " " + marathi(rng), never_met))
    assert (kind, restored) == ("glyph codes", None)


@pytest.mark.parametrize("table,family", [(RULES["f1"], "f1"), (UNRULED, "f9")])
def test_codes_inside_long_english(look, table, family):
    rng = random.Random(12)
    for n in (6, 10):
        for _ in range(5):
            before, after, codes = english(rng) + " " + english(rng), english(rng) + " " + english(rng), " ".join(rng.choices(DEVA, k=n))
            assert look.examine(f"{before} {after}") is None
            kind, families, restored = look.examine(f"{before} {coded(codes, table)} {after}")
            assert (kind, families) == ("glyph codes", family)
            assert restored == (f"{before} {codes} {after}" if family == "f1" else None)


def test_other_scripts_are_sound(look):
    for t in ("Το έγγραφο κατατέθηκε στην υπηρεσία πριν από τις δέκα", "Документ подан в отдел до десятого мая", "இந்த ஆவணம் துறைக்கு அனுப்பப்பட்டது", "この文書は部署に提出されました", "Über die Größe der Straße müßte später öfter geübt werden", "€ 5 £ 6 ¥ 7 § 8 ° ± µ"):
        assert look.examine(t) is None, t


def test_lost_text_is_reported_and_not_invented(look):
    rng = random.Random(6)
    t = marathi(rng)
    kind, _, restored = look.examine(t.encode().decode("ascii", "replace"))
    assert (kind, restored) == ("lost", None)


def test_steps_never_touch_plain_text():
    for d in decoders():
        for t in ("plain", "", "Société", "दिनांक", "naïve café — “x”"):
            assert d.undo(t, [m.span() for m in FOREIGN.finditer(t)]) == t


def test_rows(spark):
    rng = random.Random(7)
    docs = [(i, "en" if i % 2 else "mr", english(rng) if i % 2 else marathi(rng)) for i in range(300)] + [(900, None, "x"), (901, "en", None), (902, "en", "")]
    rows = [(1, marathi(rng).encode().decode("koi8_r"), "k"), (2, None, "k"), (3, "", "k"), (4, english(rng), "k"), (1, marathi(rng).encode().decode("koi8_r"), "k")]
    d = spark.createDataFrame(docs, "ident long, lang string, text string")
    u = spark.createDataFrame(rows, "ident long, text string, kind string")
    rules = spark.createDataFrame([("f1", "¡", "अ"), (None, "x", "y"), ("f1", "", "y"), ("f1", "¢", None)], "family_id string, source string, target string")
    none = spark.createDataFrame([], "ident long, family_id string, text string")
    model = train(d, u, rules, none)
    got = garbled(u, ["ident"], "text", model).collect()
    assert [r["ident"] for r in got] == [1, 1] and got[0]["kind"] == "encoding"
    assert garbled(u.where("false"), ["ident"], "text", model).count() == 0
    nothing = train(d.where("false"), u.where("false"), rules.where("false"), none)
    assert garbled(u, ["ident"], "text", nothing).count() == 2


def test_any_number_of_steps(look):
    rng = random.Random(11)
    t = marathi(rng)
    shown = t
    for _ in range(6):
        shown = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in shown.encode())
    assert look.examine(shown) == ("encoding", " ".join(["cp1252"] * 6), t)


def test_swapped_latin_and_devanagari(look):
    rng = random.Random(12)
    for t in (english(rng), marathi(rng).replace("।", "")):
        shown = "".join(chr((ord(c) & 255) << 8 | ord(c) >> 8) for c in t)
        assert look.examine(shown) == ("encoding", "utf_16_swapped", t)


def test_a_misread_stretch_beside_other_scripts(look):
    rng = random.Random(13)
    greek = "Η επιτροπή ενέκρινε τον προϋπολογισμό του δήμου για τις εργασίες "
    wrong = marathi(rng).encode().decode("mac_roman")
    assert look.examine(greek * 4) is None
    assert look.examine(greek * 4 + wrong)[0] == "encoding"


def test_training_covers_every_language_and_family(spark):
    rng = random.Random(14)
    labelled = [(i, lang, f(rng)) for i, (lang, f) in enumerate([("en", english), ("mr", marathi)] * 40)]
    labelled += [(1000 + i, "de", "Die Behörde über Straßen prüft größere Änderungen.") for i in range(20)] + [(2000, "und", "x"), (2001, None, "x"), (2002, "fr", "seul")]
    families = [(i, f"g{i % 70}", coded(marathi(rng), {k: chr(0xA1 + (ord(v) + i % 70) % 94) for k, v in UNRULED.items()})) for i in range(70 * 14)]
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    model = train(
        make(labelled, "ident long, lang string, text string"),
        make([(i, t) for i, _, t in labelled], "ident long, text string"),
        make([("f1", v, k) for k, v in RULES["f1"].items()], "family_id string, source string, target string"),
        make(families, "ident long, family_id string, text string"),
    )
    assert set(model.languages) == {"en", "mr", "de"} and model.devanagari == {"mr"}
    assert len(model.glyphs) == 70


def test_passages_lie_anywhere(spark):
    from pyspark.sql import functions as F

    text = "".join(chr(0x4E00 + i) for i in range(3000))
    df = spark.range(200).select(F.col("id").cast("string").alias("ident"), F.when(F.col("id") == 0, "short").otherwise(text).alias("text"))
    got = {r[0]: r[1] for r in df.select("ident", _passage(F.col("ident"), F.col("text"), 600)).collect()}
    assert got["0"] == "short"
    starts = [text.index(v) for k, v in got.items() if k != "0"]
    assert all(len(v) == 600 for k, v in got.items() if k != "0") and min(starts) < 300 and max(starts) > 2000
