import random

from pyspark.sql import functions as F

from turnmill.operators import mining, ordered


def test_bucketed_windows_equal_plain_ones(spark):
    random.seed(3)
    rows = [(i, random.choice(["hot", "hot", "hot", "b", None]), random.choice([None, *range(0, 5000, 7)]), random.choice([None, 1.0, 2.0])) for i in range(400)]
    df = spark.createDataFrame([(i, k, None if o is None else float(o), v) for i, k, o, v in rows], "i long, k string, o double, v double")
    got = {r["i"]: (r["before"], r["run"]) for r in ordered.running_sum(ordered.lagged(df, ["k"], "o", ["i"], "v", "before", 300.0), ["k"], "o", ["i"], F.col("v"), "run", 300.0).collect()}
    for key in ("hot", "b", None):
        part = sorted((r for r in rows if r[1] == key), key=lambda r: (r[2] is not None, r[2] or 0, r[0]))
        total, last = 0.0, None
        for i, _, _, v in part:
            total += v or 0
            assert got[i] == (last, total)
            last = v


def test_gap_turns_inclusive_and_missing(spark):
    df = spark.createDataFrame([(1, "c", 0.0, 10.0), (2, "c", 2010.0, None), (3, "c", 9000.0, 9001.0), (4, "c", 11000.0, 1.0)], "i long, c string, s double, e double")
    assert [r["turn"] for r in ordered.gap_turns(df, "c", "s", "e", ["i"], 2000.0, 1000.0).orderBy("i").collect()] == [0, 1, 1, 1]


def test_top_k_and_round_robin(spark):
    df = spark.createDataFrame([(i, "a" if i % 3 else "b", float(i % 5)) for i in range(40)], "i long, k string, v double")
    top = ordered.top_k(df, "k", F.col("v"), ["i"], 3).orderBy("k", "rank").collect()
    assert [r["i"] for r in top if r["k"] == "b"] == [9, 24, 39]
    picked = ordered.round_robin(df, "k", "i", 6, 1).collect()
    assert len(picked) == 6 and sum(r["k"] == "a" for r in picked) == 3
    assert ordered.top_k(df.limit(0), "k", F.col("v"), ["i"], 3).count() == 0


def test_vectors(spark):
    df = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "a", [0.8, 0.2]), (3, "b", [0.0, 1.0])], "i long, l string, v array<double>")
    near = mining.nearest(df, "v", mining.centroids(df, "v", "l"), "l").orderBy("i").collect()
    assert [r["nearest"] for r in near] == ["a", "a", "b"] and all(r["margin"] > 0 for r in near)
    e = mining.hashed_embedding(spark.createDataFrame([(1, "a b a"), (2, None), (3, "")], "i long, t string"), "i", "t", 16).orderBy("i").collect()
    assert abs(sum(x * x for x in e[0]["embedding"]) - 1) < 1e-9 and sum(e[1]["embedding"]) == 0 and sum(e[2]["embedding"]) == 0
