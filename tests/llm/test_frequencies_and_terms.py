"""Frequencies, heavy terms and distinctive terms against brute force, with awkward rows."""

import math
import random
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glyphmill.functions.textnorm import clean_phrase, clean_term, doc_terms, clean_phrase_col, number_in
from glyphmill.llm import distinctive_terms
from glyphmill.llm.distinctive_terms import tf_idf
from glyphmill.llm.term_frequency import term_frequencies


def test_clean_forms():
    assert clean_term("ĠＴhe​ ") == "the" and clean_term("▁▁x") == "▁x" and clean_term("...") is None and clean_term("") is None and clean_term("​") is None
    assert clean_phrase(" A  b\n") == "a b" and clean_phrase("") == "" and clean_phrase(None) is None


@given(st.text())
@settings(max_examples=200, deadline=None)
def test_clean_forms_take_any_text(s):
    t = clean_term(s)
    assert t is None or (t == t.strip() and any(c.isalnum() for c in t))
    assert "  " not in clean_phrase(s)


def test_phrase_column_equals_function(spark):
    texts = ["Plain  ASCII\tText ", "ﬁne Ｗide‍", "", " ", "İstanbul", None, "a\x1cb\x0bc", "x y"]
    df = spark.createDataFrame([(t,) for t in texts], "phrase string")
    assert [r.c for r in df.select(clean_phrase_col(F.col("phrase")).alias("c")).collect()] == [clean_phrase(t) for t in texts]


def test_numbers_in_names(spark):
    names = ["phrase_007", " PHRASE_7 ", "none", None, "p99999999999999999999"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r.x for r in df.select(number_in(F.col("n")).alias("x")).collect()] == [7, 7, None, None, None]


def test_frequencies_against_brute_force(spark):
    rng = random.Random(1)
    rows = []
    for i in range(3000):
        term = "hot" if rng.random() < 0.4 else rng.choice([None, "", "ä", "b", *(f"t{k}" for k in range(300))])
        rows.append((term, rng.choice([None, *range(40)]), i))
    rows += rng.sample(rows, 200)  # delivered again
    df = spark.createDataFrame(rows, "term string, rec bigint, ident bigint").withColumn("n", F.lit("clash"))
    got = {r.term: (r.occurrences, r.records) for r in term_frequencies(df, "term", "rec", "ident").collect()}
    occ, recs = Counter(), defaultdict(set)
    for t, r, _ in set(rows):
        if t is not None:
            occ[t] += 1
            recs[t].update([] if r is None else [r])
    assert got == {t: (n, len(recs[t])) for t, n in occ.items()}


def test_frequencies_of_small_batches_and_nothing(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        df = spark.createDataFrame([("a", f"r{k % 4}", 2) for k in range(17)] + [("b", "r0", 5)], "term string, record string, tf int")
        got = {r.term: (r.occurrences, r.records) for r in term_frequencies(df, count="tf").collect()}
        assert got == {"a": (8, 4), "b": (5, 1)}  # equal (term, record) rows count once
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert term_frequencies(df.where("false")).count() == 0


DOCS = [
    ("1", ["Ġthe", "the", "cat", "cat", "cat"]), ("2", ["the", "dog"]), ("3", ["THE", "ﬁsh", None, "", "."]), ("4", None), ("5", []), (None, ["x"]),
]


def test_document_terms(spark):
    df = spark.createDataFrame(DOCS, "doc_id string, tokens array<string>").withColumn("term", F.lit("clash"))
    got = {(r.doc_id, r.term): r.tf for r in doc_terms(df, "doc_id", "tokens").collect()}
    assert got == {("1", "the"): 2, ("1", "cat"): 3, ("2", "the"): 1, ("2", "dog"): 1, ("3", "the"): 1, ("3", "fish"): 1, (None, "x"): 1}


def test_distinctive_terms(spark, monkeypatch):
    df = spark.createDataFrame(DOCS, "doc_id string, tokens array<string>").withColumn("df", F.lit("clash"))
    for lengths, hot_rows, most in ((False, 1, 10), (True, 1, 10), (True, 1, 0), (True, 100, 10)):  # terms joined by broadcast, by salt or all alike: the same scores
        monkeypatch.setattr(distinctive_terms, "BROADCAST_TERMS", most)
        counts = doc_terms(df, "doc_id", "tokens", lengths=lengths)
        rows = {(r.doc_id, r.term): r for r in tf_idf(counts, "doc_id", hot_rows=hot_rows).collect()}
        assert len(rows) == 6
        r = rows["1", "cat"]
        assert (r.tf, r.df, r.n_records) == (3, 1, 3) and math.isclose(r.score, 3 / 5 * (math.log(4 / 2) + 1))
        assert r.score > rows["1", "the"].score
        few = {(r.doc_id, r.term): r.score for r in tf_idf(counts, "doc_id", least_tf=2, most_df=1, hot_rows=hot_rows).collect()}
        assert few == {("1", "cat"): r.score}
        assert tf_idf(counts.where("false"), "doc_id").count() == 0
    twice = {(x.doc_id, x.term): x.tf for x in tf_idf(doc_terms(df.union(df), "doc_id", "tokens"), "doc_id").collect()}
    assert twice == {k: 2 * x.tf for k, x in rows.items()}  # rows of a record are added up
