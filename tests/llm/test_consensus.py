import random

import pytest

from tarazu.llm import consensus as cs
from tarazu.llm.consensus import chi2_quantile, consensus, votes

SCHEMA = "id long, obs_id long, annotator string, label string, round int, votes string"


def run(df):
    return consensus(votes(df, "obs_id", "annotator", "label", ["round", "id"]))


def crowd(seed=1, n=400):
    rng = random.Random(seed)
    labels = ["CORRECT", "LEGACY_8BIT", "PARTIAL", "CMAP_INVALID"]
    skill = {"good-1": 0.97, "good-2": 0.95, "fair": 0.8, "guess-1": 0.25, "guess-2": 0.25, "yes": None, "tail": 0.9}
    truth, rows = {}, []
    for obs in range(n):
        truth[obs] = rng.choice(labels)
        for a, p in skill.items():
            if rng.random() < (0.02 if a == "tail" else 0.75):
                label = "CORRECT" if p is None else truth[obs] if rng.random() < p else rng.choice(labels)
                rows.append((len(rows), obs, a, label, 1, "x"))
    return truth, rows


def test_recovers_the_truth_and_ranks_annotators(spark):
    truth, rows = crowd()
    got = run(spark.createDataFrame(rows, SCHEMA))
    items = {r["item"]: r for r in got.items.collect()}
    scored = [items[o]["label"] == t for o, t in truth.items() if o in items and items[o]["n_annotators"] >= 3]
    assert sum(scored) / len(scored) > 0.95
    a = {r["annotator"]: r for r in got.annotators.collect()}
    assert a["good-1"]["weight"] > a["fair"]["weight"] > a["guess-1"]["weight"]
    assert a["guess-1"]["error_rate"] > 0.6 > a["good-1"]["error_rate"]
    # Few votes: the bound on the error variance is wide, so the weight stays below that of as good a long record.
    assert a["tail"]["weight"] < a["good-2"]["weight"]


def test_spelling_rounds_copies_and_gaps(spark):
    rows = [
        (1, 1, "Ann ", "legacy-8bit", 1, "x"), (2, 1, "ann", "CORRECT", 2, "x"), (2, 1, "ann", "CORRECT", 2, "x"), (3, 1, "bob", " Correct", 1, None),
        (4, 1, "cy", "correct ", 1, None), (5, 1, "di", "", 1, None), (6, 1, None, "CORRECT", 1, None), (7, None, "ann", "CORRECT", 1, None),
        (8, 2, "ann", None, 1, None), (9, 3, "ann", "Legacy 8Bit", 1, None),
    ]
    got = {r["item"]: r for r in run(spark.createDataFrame(rows, SCHEMA)).items.collect()}
    assert set(got) == {1, 3}
    assert (got[1]["label"], got[1]["n_annotators"], got[1]["agreement"]) == ("CORRECT", 3, 1.0)
    assert (got[3]["label"], got[3]["n_annotators"], got[3]["agreement"], got[3]["support"]) == ("LEGACY_8BIT", 1, None, 1.0)


def test_order_does_not_matter_and_nothing_is_nothing(spark):
    _, rows = crowd(2, 80)
    df = spark.createDataFrame(rows, SCHEMA)
    a = {r["item"]: (r["label"], round(r["support"], 9)) for r in run(df).items.collect()}
    b = {r["item"]: (r["label"], round(r["support"], 9)) for r in run(df.orderBy("label").repartition(6)).items.collect()}
    assert a == b
    empty = run(df.where("false"))
    assert empty.items.count() == 0 and empty.annotators.count() == 0


def test_ties_go_to_the_more_frequent_label(spark):
    rows = [(i, 5, "a", "PARTIAL", 1, None) for i in range(1)] + [(1, 5, "b", "CORRECT", 1, None), (2, 6, "a", "CORRECT", 1, None), (3, 6, "b", "CORRECT", 1, None)]
    got = {r["item"]: r["label"] for r in run(spark.createDataFrame(rows, SCHEMA)).items.collect()}
    assert got == {5: "CORRECT", 6: "CORRECT"}


@pytest.mark.parametrize("own_vote", [False, True])
def test_joins_give_the_same(spark, monkeypatch, own_vote):
    _, rows = crowd(3, 120)
    df = spark.createDataFrame(rows + [(9000, 900, "lone", "PARTIAL", 1, None)], SCHEMA)
    show = lambda c: ({tuple(map(str, (r[0], r[1], r[2], r[3] and round(r[3], 6), round(r[4], 6)))) for r in c.items.collect()}, {(r[0], r[1], round(r[3], 6)) for r in c.annotators.collect()}, c.rounds, c.converged)
    of = lambda: cs.consensus(votes(df, "obs_id", "annotator", "label", ["round", "id"]), rounds=4, own_vote=own_vote)
    a = show(of())
    monkeypatch.setattr(cs, "MOST_LABELS", 2)
    assert votes(df, "obs_id", "annotator", "label", ["round", "id"]).items is None
    assert show(of()) == a
    with pytest.warns(UserWarning, match="did not settle in 1 rounds"):
        assert not cs.consensus(votes(df, "obs_id", "annotator", "label", ["round", "id"]), rounds=1).converged
    assert show(cs.consensus(votes(df.where("false"), "obs_id", "annotator", "label", ["id"])))[:2] == (set(), set())


def test_chi_squared_quantile():
    assert abs(float(chi2_quantile(30, -1.959964)) - 16.79) < 0.1
