import hashlib
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarazu.llm import block_sample as bs
from tarazu.llm.block_sample import POSITIONS, block_sample, image, record, sequence_numbers
from tarazu.llm.quota_sample import largest_remainder, quota_sample, quotas

KEYS = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(4000)]


def sample(df, seed=7, take=26):
    return {r["key"] for r in block_sample(sequence_numbers(df, "sha256", "doc_id"), [seed], take).collect()}


def files(spark, rows):
    return spark.createDataFrame(rows, "sha256 string, doc_id long").selectExpr("*", "'x' AS seed", "'y' AS number", "1 AS block")


def test_sample_is_stable_and_keeps_its_members(spark):
    rows = [(k, i) for i, k in enumerate(KEYS)]
    whole = sample(files(spark, rows))
    later = [(k, 4000 + i) for i, k in enumerate(random.Random(1).sample(KEYS, 900))]  # downloaded again
    assert sample(files(spark, rows + rows[:500] + later).orderBy(F.rand(3)).repartition(9)) == whole
    early = [r for r in rows if r[1] < 1500]
    assert sample(files(spark, early)) == whole & {k for k, _ in early}
    assert sample(files(spark, rows), seed=8) != whole


def test_full_blocks_hold_exactly_the_chosen_number(spark):
    held = Counter(r["block"] for r in block_sample(sequence_numbers(files(spark, [(k, i) for i, k in enumerate(KEYS)]), "sha256", "doc_id"), [7], 26).collect())
    full = len(KEYS) // POSITIONS
    assert [held[b] for b in range(full)] == [26] * full and held[full] <= 26  # the last block is not full
    holes = [(k, i) for i, k in enumerate(KEYS) if i % 3]
    gaps = Counter(r["block"] for r in block_sample(sequence_numbers(files(spark, holes), "sha256", "doc_id"), [7], 26).collect())
    assert all(gaps[b] <= 26 for b in gaps) and 0.5 < sum(gaps.values()) / sum(held.values()) < 0.8


def test_each_block_is_permuted_evenly(spark):
    at = spark.range(300).select(F.col("id").alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(POSITIONS - 1).cast("long"))).alias("position"))
    got = at.select("block", "position", image(F.lit(5), F.col("block"), F.col("position")).alias("x"))
    assert got.groupBy("block").agg(F.count_distinct("x").alias("n")).where(F.col("n") != POSITIONS).count() == 0
    chosen = {b: set() for b in range(300)}
    for r in got.where("x < 26").collect():
        chosen[r["block"]].add(r["position"])
    often = Counter(p for c in chosen.values() for p in c)
    assert len(often) == POSITIONS and max(often.values()) < 70  # 30.5 expected
    assert len({frozenset(c) for c in chosen.values()}) == 300


def test_ledger_pins_numbers(spark, tmp_path):
    path = str(tmp_path / "ledger")
    first = sequence_numbers(files(spark, [(KEYS[0], 10), (KEYS[1], 11)]), "sha256", "doc_id")
    assert record(first, path).count() == 2
    now = files(spark, [(KEYS[0], 3), (KEYS[1], 11), (KEYS[2], 4)])  # an earlier number arrives late
    pinned = sequence_numbers(now, "sha256", "doc_id", spark.read.parquet(path))
    assert {tuple(r) for r in pinned.collect()} == {(KEYS[0], 10), (KEYS[1], 11), (KEYS[2], 4)}
    assert record(pinned, path).count() == 3 and record(pinned, path).count() == 3


def test_sample_edges(spark, monkeypatch):
    df = files(spark, [(None, 1), ("", 2), (KEYS[0], 3), (KEYS[0], 3), (KEYS[1], None), (KEYS[2], -4), (KEYS[2], 5)])
    assert sample(df, take=0) == set()
    assert sample(df, take=POSITIONS) == {"", KEYS[0], KEYS[2]}
    assert sample(df.where("false")) == set()
    numbers = sequence_numbers(df, "sha256", "doc_id")
    with pytest.raises(ValueError):
        block_sample(numbers, [1], -1)
    seeds = spark.createDataFrame([(1,), (2,), (1,), (None,)], "seed long")
    assert block_sample(numbers, seeds, POSITIONS).count() == 6
    assert block_sample(numbers, seeds.where("false"), POSITIONS).count() == 0
    monkeypatch.setattr(bs, "SEEDS_A_PASS", 7)
    assert block_sample(numbers, spark.range(20), POSITIONS).count() == 60


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 500), st.lists(st.tuples(st.integers(0, 50), st.integers(0, 9), st.integers(0, 200)), min_size=1, max_size=7))
def test_quotas_hold_their_bounds(total, rows):
    shares, floors, caps = (list(x) for x in zip(*rows))
    got = largest_remainder(total, shares, floors, caps)
    low = [min(f, c) for f, c in zip(floors, caps)]
    assert all(a <= q <= c for a, q, c in zip(low, got, caps))
    able = [c if s else a for c, s, a in zip(caps, shares, low)]
    if sum(low) <= total <= sum(able):
        assert sum(got) == total


def test_quotas_by_largest_remainder():
    assert largest_remainder(10, [1, 1, 1], [0, 0, 0], [99] * 3) == [4, 3, 3]
    assert largest_remainder(100, [500, 300, 200], [0, 0, 25], [99] * 3) == [47, 28, 25]
    assert largest_remainder(100, [500, 300, 200], [0, 0, 0], [10, 99, 99]) == [10, 54, 36]
    assert largest_remainder(5, [1, 1], [9, 9], [20, 20]) == [9, 9]
    assert largest_remainder(5, [0, 0], [2, 0], [1, 4]) == [1, 0]


TARGETS = "draw string, stratum string, size_permille long, share_permille long, min_count long"


def test_quota_sample_against_brute_force(spark):
    rng = random.Random(5)
    members = [("d", rng.choice(["hot"] * 6 + ["b", "c"]), f"m{i}") for i in range(5000)] + [("d", "other", "m9999"), ("e", "hot", "m1")]
    m = spark.createDataFrame(members, "draw string, stratum string, member string")
    t = spark.createDataFrame([("d", "hot", 200, 500, 3), ("d", "b", 200, 300, 3), ("d", "c", 200, 200, 3), ("d", "none", 200, 0, 4), ("d", "none", 200, 0, 4), ("f", "x", 100, 1000, None)], TARGETS)
    q = quotas(m, t)
    found = {(r["draw"], r["stratum"]): r for r in q.collect()}
    assert found["d", "none"]["shortfall"] == 4 and found["f", "x"]["quota"] == 0 and found["f", "x"]["shortfall"] == 0
    got = quota_sample(m, q, "member", 11).collect()
    counts = Counter(s for _, s, _ in members)
    for s in ("hot", "b", "c"):
        want = found["d", s]["quota"]
        keys = sorted((hashlib.md5(f"11:d:{x}".encode()).hexdigest(), x) for d, k, x in members if (d, k) == ("d", s))
        assert {r["member"] for r in got if r["stratum"] == s} == {x for _, x in keys[:want]}
        assert all(abs(r["selection_prob"] - want / (counts[s] - (s == "hot"))) < 1e-12 for r in got if r["stratum"] == s)
    again = quota_sample(m.orderBy(F.rand(1)).repartition(5), q, "member", 11).collect()
    assert {r["member"] for r in again} == {r["member"] for r in got}


def test_quota_sample_of_nothing(spark):
    m = spark.createDataFrame([], "draw string, stratum string, member string")
    t = spark.createDataFrame([("d", "x", 100, 1000, 2)], TARGETS)
    q = quotas(m, t)
    assert [(r["quota"], r["shortfall"]) for r in q.collect()] == [(0, 2)]
    assert quota_sample(m, q, "member", 1).count() == 0
    assert quotas(m, t.where("false")).count() == 0


def test_targets_missed_for_the_floors_of_others(spark):
    """The draw has room for 100; two floors of 40 leave 20 of a target of 90."""
    m = spark.range(1000).selectExpr("'d' AS draw", "CASE id % 3 WHEN 0 THEN 'big' WHEN 1 THEN 'b' ELSE 'c' END AS stratum", "CAST(id AS string) AS member")
    t = spark.createDataFrame([("d", "big", 100, 900, 0), ("d", "b", 100, 50, 40), ("d", "c", 100, 50, 40)], TARGETS)
    got = {r["stratum"]: (r["quota"], r["target"], r["shortfall"], r["missed"]) for r in quotas(m, t).collect()}
    assert got == {"big": (20, 90, 0, 70), "b": (40, 40, 0, 0), "c": (40, 40, 0, 0)}
