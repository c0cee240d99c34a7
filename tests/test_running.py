"""Ranks and running sums against plain loops, with groups that cross partitions, nulls and empty tables."""

import random

import pytest
from pyspark.sql import functions as F

from glyphmill.operators.results import describe, stratified
from glyphmill.operators.running import running


@pytest.mark.parametrize("parts", [1, 2, 7])
def test_running_against_loops(spark, parts):
    rng = random.Random(parts)
    rows = [("hot" if rng.random() < 0.5 else rng.choice([None, "a", "b", *(f"k{i}" for i in range(40))]), i, rng.choice([None, 1, 2, 5]), "clash") for i in range(900)]
    df = spark.createDataFrame(rows, "k string, i int, v int, _row string")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        for desc in (False, True):
            got = {r.i: (r["rank"], r.s) for r in running(df.drop("_row"), ["k"], [F.desc("i") if desc else "i"], {"s": "v"}).collect()}
            n, total, want = {}, {}, {}
            for k, i, v, _ in sorted(rows, key=lambda r: -r[1] if desc else r[1]):
                n[k], total[k] = n.get(k, 0) + 1, total.get(k, 0) + (v or 0)
                want[i] = (n[k], total[k])
            assert got == want
        assert running(df.drop("_row").where("false"), ["k"], ["i"], {"s": "v"}).count() == 0
        assert sorted(r["rank"] for r in running(df.select("i"), [], ["i"]).collect()) == list(range(1, 901))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_describe_and_split(spark):
    import numpy as np

    rng = random.Random(3)
    rows = [(rng.choice("ab"), k, rng.choice([None, 1.5, 2.0, rng.uniform(0, 9)])) for k in range(300)] + [("none", 1000, None)]
    df = spark.createDataFrame(rows, "g string, i int, v double")
    got = {r.g: r for r in describe(df, ["g"], "v").collect()}
    for g in "ab":
        v = np.array([x for k, _, x in rows if k == g and x is not None])
        assert (got[g].q25, got[g].q50, got[g].q75) == tuple(pytest.approx(np.percentile(v, q)) for q in (25, 50, 75)) and got[g]["count"] == len(v)
    assert got["none"].q50 is None and got["none"]["count"] == 0
    parts = stratified(df, ["g"], "i", 0.6).groupBy("g").agg(F.count(F.when(F.col("part") == "train", 1)).alias("t"), F.count(F.lit(1)).alias("n")).collect()
    assert all(r.t == int(r.n * 0.6 + 0.5) for r in parts)
