"""Repeated deliveries: each key once, whatever the bitmap's size."""

import random

import pytest

from glyphmill.operators.deliveries import one_delivery
from glyphmill.operators.hotkeys import author_totals, heavy_keys, term_totals


@pytest.mark.parametrize("bits", [15, 17, 27])
def test_each_key_once(spark, bits):
    rng = random.Random(2)
    rows = [(None if k % 50 == 0 else f"k{k}", k % 3, "clash") for k in range(3000)]
    rows += rng.sample(rows, 400)
    df = spark.createDataFrame(rows, "k string, part int, _h string")
    got = [tuple(r) for r in one_delivery(df, ["k", "part"], bits=bits).collect()]
    assert len(got) == len(set(got)) and set(got) == {r[:2] for r in rows}
    assert one_delivery(df.where("false"), "k", "part", bits=bits).count() == 0


def test_totals_count_a_document_once(spark):
    docs = [("1", " Ann", ["Ġthe", "The", "x"], 3), ("1", " Ann", ["Ġthe", "The", "x"], 3), ("2", "ann ", None, None), ("3", None, ["y", "", None, "the"], 4), ("4", " ", [], 0), ("5", "Bob", ["y"] * 5, 5)]
    df = spark.createDataFrame(docs, "doc_id string, author string, tokens array<string>, num_tokens int").selectExpr("*", "'c' as records")
    assert {(r.key_text, r.records, r.total) for r in author_totals(df).collect()} == {("ann", 2, 3), ("bob", 1, 5)}
    assert {(r.key_text, r.total) for r in term_totals(df).collect()} == {("the", 3), ("x", 1), ("y", 6)}
    assert {tuple(r) for r in heavy_keys(df, 0.4, 0.4).collect()} == {("author", "ann"), ("token", "y")}  # two of five documents, six of ten occurrences
    assert heavy_keys(df.where("false")).count() == 0
