import random
from collections import Counter

from pyspark.sql import functions as F

from tarazu.operators.skew import capped_per_key, heavy_keys, range_partition, stitched_aggregate, stitched_rank

SCHEMA = "k string, o long, v long, n long"


def rows(n=3000, seed=3):
    rng = random.Random(seed)
    return [(rng.choice(["hot"] * 5 + ["a", "b", None]), i, rng.randrange(9), i % 3) for i in range(n)]


def test_counts_and_sums_like_brute_force(spark):
    data = rows()
    got = stitched_aggregate(spark.createDataFrame(data, SCHEMA), "k", ["o"], {"odd": F.col("v") % 2 == 1}, {"total": F.col("v")}, partitions=8).collect()
    assert {r["k"]: r["n"] for r in got} == dict(Counter(r[0] for r in data))
    assert {r["k"]: r["odd"] for r in got} == {k: sum(r[2] % 2 for r in data if r[0] == k) for k in {r[0] for r in data}}
    assert {r["k"]: r["total"] for r in got} == {k: sum(r[2] for r in data if r[0] == k) for k in {r[0] for r in data}}
    assert next(r for r in got if r["k"] == "hot")["n_ranges"] > 2


def test_no_partition_holds_the_hot_key_alone(spark):
    df = range_partition(spark.createDataFrame(rows(20000), SCHEMA), "k", ["o"], 8)
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 2 * 20000 / 8


def test_rank_across_ranges(spark):
    data = rows()
    got = stitched_rank(spark.createDataFrame(data, SCHEMA), "k", ["o"], "n2", partitions=8).collect()
    assert len(got) == len(data)
    for k in {r[0] for r in data}:
        mine = sorted((r["o"], r["n2"]) for r in got if r["k"] == k)
        assert [x for _, x in mine] == list(range(1, len(mine) + 1))
    assert {c: x for c, x in zip(got[0].asDict(), "kovn")} and "n" in got[0].asDict()  # a column named like inner ones survives


def test_cap_ties_and_repeated_rows(spark):
    df = spark.createDataFrame([("a", 1, 0, 0)] * 5 + [("b", None, None, None)], SCHEMA)
    got = capped_per_key(df, "k", ["o"], 3, partitions=4).collect()
    assert Counter(r["k"] for r in got) == {"a": 3, "b": 1}


def test_heavy_keys_and_empty(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    assert {r["k"] for r in heavy_keys(df, "k", ["o"], 0.3).collect()} == {"hot"}
    assert heavy_keys(df.where("false"), "k", ["o"], 0.05).count() == 0
    assert stitched_rank(df.where("false"), "k", ["o"]).count() == 0
    nulls = spark.createDataFrame([(None, 1, 1, 1)] * 9 + [("x", 1, 1, 1)], SCHEMA)
    assert {r["k"]: r["share"] for r in heavy_keys(nulls, "k", ["o"], 0.05).collect()} == {"x": 0.1}
