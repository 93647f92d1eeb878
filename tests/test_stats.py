import pytest

from tarazu.operators import labels as wf
from tarazu.operators import sampling as sp
from tarazu.operators import stats as st
from tarazu.operators.audit import macro_pooled
from tarazu.plans import label_queries as lq
from pyspark.sql import functions as F


def kappa(spark, pairs):
    rows = st.kappa(spark.createDataFrame(pairs, "a string, b string")).collect()
    return rows[0] if rows else None


def test_kappa(spark):
    assert kappa(spark, [("A", "A")] * 5 + [("B", "B")] * 5)["kappa"] == 1.0
    assert kappa(spark, [("A", "A"), ("A", "B"), ("B", "A"), ("B", "B")])["kappa"] == 0.0
    got = kappa(spark, [("A", "A")] * 90 + [("A", "B")] * 5 + [("B", "A")] * 5)
    assert got["agreement"] == 0.9 and got["kappa"] < 0.5
    assert kappa(spark, [("A", "A")] * 4)["kappa"] is None
    assert kappa(spark, []) is None


def test_prf(spark):
    def score(tp, fp, fn):
        c = st.prf(F.lit(tp), F.lit(fp), F.lit(fn))
        return tuple(spark.range(1).select(*c.values()).first())

    p, r, f1 = score(8, 2, 4)
    assert (p, r) == (0.8, pytest.approx(2 / 3, abs=1e-6))
    assert score(0, 0, 0) == (0.0, 0.0, 0.0)


def estimate(spark, strata):
    return st.stratified_estimate(spark.createDataFrame(strata, "stratum_size long, drawn long, positive long")).first()


def test_stratified_estimate(spark):
    assert estimate(spark, [(900, 100, 0), (100, 100, 100)])["rate"] == pytest.approx(0.10)
    whole = estimate(spark, [(50, 50, 25)])
    assert (whole["rate"], whole["se"]) == (0.5, 0.0)
    assert estimate(spark, [(10000, 40, 20)])["se"] > estimate(spark, [(10000, 400, 200)])["se"]
    assert tuple(estimate(spark, []))[1:3] == (0.0, 0.0)
    assert tuple(estimate(spark, [(100, 0, 0)]))[1:3] == (0.0, 0.0)


def test_sweep_edges(spark):
    rows = [(0.0, "CORRECT"), (0.1, "CORRECT"), (0.9, "LEGACY_8BIT"), (1.0, "LEGACY_8BIT"), (None, "CORRECT")]
    df = spark.createDataFrame(rows, "mojibake_ratio double, final_label string")
    got = st.sweep(df, "mojibake_ratio").orderBy("step").collect()
    assert len(got) == 21
    assert (got[0]["tp"], got[0]["fp"], got[0]["fn"]) == (2, 2, 0)
    assert (got[20]["tp"], got[20]["fp"], got[20]["fn"]) == (1, 0, 1)
    same = spark.createDataFrame([(0.5, "CORRECT")] * 3, "mojibake_ratio double, final_label string")
    assert st.sweep(same, "mojibake_ratio").count() == 0
    assert st.sweep(df.where("false"), "mojibake_ratio").count() == 0


def test_macro_and_pooled(spark):
    def run(rows):
        return macro_pooled(spark.createDataFrame(rows, "g string, hit boolean"), "g", F.col("hit")).first()

    got = run([("big", True)] * 100 + [("small", False)] * 2)
    assert (got["macro"], got["pooled"]) == (0.5, pytest.approx(100 / 102, abs=1e-6))
    empty = run([])
    assert (empty["macro"], empty["pooled"]) == (None, None)


def verdicts(spark, votes):
    rows = [(1, f"a{i}", 1, v) for i, v in enumerate(votes)]
    got = wf.verdicts(spark.createDataFrame(rows, "obs_id long, annotator string, round int, label string")).collect()
    return (got[0]["basis"], got[0]["final_label"]) if got else None


def test_adjudication(spark):
    assert verdicts(spark, ["A", "A"]) == ("unanimous", "A")
    assert verdicts(spark, ["A", "B"]) == ("disagreed", None)
    assert verdicts(spark, ["A"]) == ("single", "A")
    assert verdicts(spark, []) is None


def test_next_state(spark):
    table = "obs_id long, final_label string, basis string, adjudicator string"
    now = spark.createDataFrame([(1, "A", "single", "auto"), (2, "A", "single", "auto"), (3, "C", "adjudicated", "me")], table)
    seen = spark.createDataFrame([(1, "A", "unanimous"), (2, None, "disagreed"), (3, "B", "unanimous"), (4, "D", "single")], "obs_id long, final_label string, basis string")
    got = {r["obs_id"]: (r["final_label"], r["basis"]) for r in wf.next_state(now, seen).collect()}
    assert got == {1: ("A", "unanimous"), 3: ("C", "adjudicated")}
    with_single = {r["obs_id"] for r in wf.next_state(now, seen, include_single=True).collect()}
    assert with_single == {1, 3, 4}
    done = wf.resolve(now, spark.createDataFrame([(2, "PARTIAL", "seen", "me"), (1, "PARTIAL", " ", "me"), (3, "NONSENSE", "x", "me")], "obs_id long, final_label string, note string, adjudicator string"))
    assert {r["obs_id"]: r["final_label"] for r in done.collect()} == {1: "A", 2: "PARTIAL", 3: "C"}


def test_draw_contract(spark):
    df = spark.createDataFrame([(i, "s" if i < 200 else "t") for i in range(203)], "obs_id long, stratum string")
    got = sp.stratified_draw(df, "stratum", "obs_id", {"s": 50, "t": 100}, 1).collect()
    s = [r for r in got if r["stratum"] == "s"]
    assert len(s) == 50 and {r["selection_prob"] for r in s} == {0.25} and {r["stratum_size"] for r in s} == {200}
    assert {r["selection_prob"] for r in got if r["stratum"] == "t"} == {1.0}
    again = sp.stratified_draw(df.orderBy(F.desc("obs_id")).repartition(7), "stratum", "obs_id", {"s": 50, "t": 100}, 1)
    assert {r["obs_id"] for r in again.collect()} == {r["obs_id"] for r in got}
    other = sp.stratified_draw(df, "stratum", "obs_id", {"s": 50, "t": 100}, 2)
    assert {r["obs_id"] for r in other.collect()} != {r["obs_id"] for r in got}


def test_kappa_per_class_covers_every_annotator_and_both_rounds(spark, tmp_path):
    labels = ["CORRECT", "LEGACY_8BIT", "LEGACY_ASCII"]
    say = {("ann-01", 1): lambda i: labels[i % 3], ("ann-02", 1): lambda i: labels[i % 3], ("ann-03", 1): lambda i: labels[i // 2 % 3], ("ann-03", 2): lambda i: labels[(i + i % 2) % 3]}
    rows = [(f"{who}{rnd}{i}", i, "gt-v1", who, rnd, f(i), None, None, None) for (who, rnd), f in say.items() for i in range(30)]
    kinds = "annotation_id string, obs_id long, sample_id string, annotator string, round int, label string, script string, confidence string, annotated_at timestamp"
    spark.createDataFrame(rows, kinds).write.parquet(f"{tmp_path}/annotation.parquet")
    got = {(r["kind"], r["annotator"], r["other"], r["label"]): r for r in lq.kappa_per_class_all(spark, str(tmp_path)).collect()}
    want = {("between", "ann-01", "ann-02"): (("ann-01", 1), ("ann-02", 1)), ("between", "ann-01", "ann-03"): (("ann-01", 1), ("ann-03", 1)), ("rounds", "ann-03", "ann-03"): (("ann-03", 1), ("ann-03", 2))}
    assert set(got) == {(*k, x) for k in want for x in labels}
    for k, (f, g) in want.items():
        for x in labels:
            pairs = [(say[f](i) == x, say[g](i) == x) for i in range(30)]
            o = sum(a == b for a, b in pairs) / 30
            p, q = sum(a for a, _ in pairs) / 30, sum(b for _, b in pairs) / 30
            e = p * q + (1 - p) * (1 - q)
            r = got[(*k, x)]
            assert abs(r["kappa"] - (o - e) / (1 - e)) < 1e-5 and r["n"] == sum(a or b for a, b in pairs) and r["below_floor"] == (r["kappa"] < 0.7)
    assert any(r["below_floor"] for r in got.values())
