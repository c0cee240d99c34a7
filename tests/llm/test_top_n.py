"""Top N against sorting, and the loser tree by itself."""

import heapq
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glyphmill.llm.top_n import LoserTree, merge_top, top_n


@given(st.lists(st.lists(st.integers(0, 30)), max_size=9))
@settings(max_examples=200, deadline=None)
def test_loser_tree_merges(runs):
    runs = [sorted((x,) for x in r) for r in runs]
    tree, out = LoserTree(runs), []
    while tree.key() is not None:
        out.append(tree.key())
        tree.next()
    assert out == list(heapq.merge(*runs))


@given(st.lists(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 9))), max_size=6), st.integers(1, 4))
@settings(max_examples=200, deadline=None)
def test_merge_stops_at_n_and_counts_equal_keys_once(runs, n):
    got = [k for k, _ in merge_top([sorted(r) for r in runs], n)]
    every = sorted({k for r in runs for k in r})
    assert got == [k for g in sorted({k[0] for k in every}) for k in [x for x in every if x[0] == g][:n]]


def _brute(rows, n=3):
    good = {r for r in rows if None not in r and r[1] == r[1] and abs(r[1]) < float("inf")}
    out = set()
    for g in {r[0] for r in good}:
        best = sorted((r for r in good if r[0] == g), key=lambda r: (-r[1], r[2], r[3]))[:n]
        out |= {(g, r[3], k + 1) for k, r in enumerate(best)}
    return out


def test_top_n_against_sorting(spark):
    rng = random.Random(5)
    scores = [None, float("nan"), float("-inf"), float("inf"), *(-k / 4 for k in range(8))]
    rows = []
    for i in range(4000):
        g = 1 if rng.random() < 0.35 else rng.choice([None, *range(2, 400)])
        rows.append((g, rng.choice(scores), rng.choice([None, "", "a", "B", "ä", "a b"]), i))
    rows += rng.sample(rows, 100)
    df = spark.createDataFrame(rows, "g bigint, s double, t string, i bigint").repartition(5).withColumn("rank", F.lit("clash")).withColumn("bucket", F.lit("clash"))
    for run_rows, buckets, merge_rows in ((250_000, None, 500_000), (50, 3, 120), (1, 1, 30)):
        if run_rows == 1:
            df = df.where("g < 12")
            rows = [r for r in rows if r[0] is not None and r[0] < 12]
        got = [(r.g, r.i, r["rank"]) for r in top_n(df, "g", "s", "t", "i", 3, buckets, run_rows, merge_rows).collect()]
        assert len(got) == len(set(got)) and set(got) == _brute(rows)


def test_top_n_of_nothing(spark):
    df = spark.createDataFrame([], "g bigint, s double, t string, i bigint")
    assert top_n(df, "g", "s", "t", "i").count() == 0
    df = spark.createDataFrame([(None, 1.0, "a", 1), (1, None, "a", 1)], "g bigint, s double, t string, i bigint")
    assert top_n(df, "g", "s", "t", "i").count() == 0
