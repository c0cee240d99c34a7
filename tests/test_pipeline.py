"""Whole runs, rescoring, bundles and the phrase operators beside the workbook's formulas."""

import math

import pytest
from pyspark.sql import functions as F

from glyphmill.functions import text as X
from glyphmill.operators import phrases as P
from glyphmill.operators import pipeline
from glyphmill.operators.numbering import number_within
from glyphmill.sources import files


def test_rescore(spark):
    scorer = lambda: lambda texts: [(t.split(), [-float(len(w)) for w in t.split()], [-1.0] * len(t.split())) for t in texts]
    rows = [("phrase_1", "reference", "the cat"), ("phrase_1", "paraphrase", "a cat"), ("phrase_2", "reference", "it ran"), ("phrase_2", "paraphrase", "it")]
    c = spark.createDataFrame(rows, "phrase_num string, phrase_type string, phrase string")
    out = pipeline.rescore(c, "we saw the cat and it ran", "the cat", scorer)
    llr = {r.phrase_num: r for r in out["LLR"].collect()}
    assert set(out) == {"no_context", "known", "unknown", "LLR"} and llr["phrase_1"].no_context_log_prob == -6.0
    want = math.exp(-6) / (math.exp(-6) + math.exp(-4))
    assert llr["phrase_1"].pmf_no_context == pytest.approx(want) and llr["phrase_1"].llr_no_context == pytest.approx(-math.log10(want))
    kept = spark.createDataFrame([("it ran",)], "phrase string")
    assert [r.phrase_num for r in pipeline.rescore(c, "x", "y", scorer, kept)["LLR"].collect()] == ["phrase_2"]


def test_bad_inputs_are_reported(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "good"))
    rows, bad = pipeline.each_input(spark, [str(tmp_path / n) for n in ("good", "none")], lambda p: spark.read.parquet(p).select("id"), errors=str(tmp_path / "errors"))
    assert rows.count() == 3 and list(bad) == [str(tmp_path / "none")] and len(list((tmp_path / "errors").glob("*.txt"))) == 1
    assert pipeline.each_input(spark, [], lambda p: None) == (None, {})


def test_a_finished_result_is_not_made_again(spark, tmp_path):
    made = []
    make = lambda: made.append(1) or spark.createDataFrame([("p", 1.0)], "problem string, score double")
    for _ in range(2):
        got = pipeline.unless_done(spark, str(tmp_path / "r"), make, make().schema)
    assert got.count() == 1 and len(made) == 3  # once to run, twice for the schema


def test_csv_keeps_quotes_breaks_blanks_and_nulls(spark, tmp_path):
    texts = ['plain', 'a "quoted" word', "two\nlines\r\nand more", " blank ", "", None, "a,b;c", "\\N", "back\\slash"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts) if t != "\\N"], "id int, t string")
    files.write_csv(df, str(tmp_path / "c"))
    got = {r.id: r.t for r in files.read_csv(spark, str(tmp_path / "c"), df.schema).collect()}
    assert got == {k: t for k, t in enumerate(texts) if t != "\\N"}


def test_result_bundle(spark, tmp_path):
    df = spark.createDataFrame([("phrase_1", 1, "x")], "phrase_num string, phrase_occurence int, original_phrase string")
    files.write_result(str(tmp_path / "b"), known=df, unknown=df, no_context=df, docs=df, metadata=df)
    sheets = files.read_bundle(spark, str(tmp_path / "b"))
    assert set(sheets) == {"docs", "known", "unknown", "metadata", "nocontext", "llr"} or len(sheets) == 6
    assert files.read_bundle(spark, str(tmp_path / "b"), ["L L R"])["L L R"].count() == 1
    with pytest.raises(ValueError):
        files.read_bundle(spark, str(tmp_path / "b"), ["none"])


def test_log_sum_over_a_wide_range(spark):
    df = spark.createDataFrame([("a", -1000.0), ("a", -1000.5), ("a", -3000.0), ("b", 900.0), ("c", None)], "k string, v double")
    got = {r.k: r.z for r in P.log_sum(df, ["k"], F.col("v"), "z").collect()}
    assert got["a"] == pytest.approx(-1000 + math.log(1 + math.exp(-0.5))) and got["b"] == pytest.approx(900.0) and got["c"] is None


def test_filled_phrases(spark):
    df = spark.createDataFrame([(1, ["The", "cat"], -2.0, "A dog"), (1, ["the", "cat"], -1.0, "A dog"), (1, ["a", "dog"], -0.1, "A dog"), (1, [" "], -0.1, "A dog"), (2, ["x"], -1.0, None), (2, ["x"], -1.0, None)], "k int, tokens array<string>, log_prob double, original string")
    got = sorted((r.k, r.text, r.score) for r in P.filled_phrases(df, "k", "original").collect())
    assert got == [(1, "the cat", -0.5), (2, "x", -1.0)]


def test_metadata_is_one_row(spark):
    df = spark.createDataFrame([(1,), (2,)], "a int")
    one = spark.createDataFrame([("m", 5)], "model string, a int")
    assert [tuple(r) for r in P.with_metadata(df, one).orderBy("a").collect()] == [(1, "m"), (2, "m")]
    with pytest.raises(ValueError):
        P.with_metadata(df, one.union(one))


def test_occurrences_and_sums_once(spark):
    rows = [(1, "s1", "reference", -1.0), (1, "s1", "paraphrase", -2.0), (1, "s2", "reference", -1.5), (1, None, "paraphrase", -1.0)]
    c = spark.createDataFrame(rows, "phrase_num int, sample string, phrase_type string, sum_log_probs double")
    o = P.with_occurrences(c, ["phrase_num"], "sample")
    assert sorted((r.sample or "", r.phrase_occurence) for r in o.collect()) == [("", None), ("s1", 1), ("s1", 1), ("s2", 2)]
    o = o.where("sample is not null")
    t = P.occurrence_llr(P.mass(o, ["phrase_num"], "no_context"), P.mass(o, ["phrase_num", "phrase_occurence"], "known").drop("num_phrases", "phrases_kept"), ["phrase_num"])
    s = P.summary_by_occurrence(t, [], ["llr_known"]).first()
    assert s.llr_no_context == pytest.approx(2 * s.llr_no_context_once) and s.num_phrases == 1


def test_text_functions(spark):
    df = spark.createDataFrame([("Dr. Smith met Prof. Jones at 9 a.m. They left. See fig. 2, e.g. J. B. Lane.\nEnd?", ["J. B. Lane", None, ""], "a\\b (??)")], "t string, names array<string>, p string")
    r = df.select(X.split_sentences(F.col("t"), F.col("names")).alias("s"), X.with_placeholders(F.col("p")).alias("w"), X.without_placeholders(X.with_placeholders(F.col("p"))).alias("p"), X.token_repr(F.array(F.lit("Ġa"), F.lit("b'"))).alias("r")).first()
    assert r.s == ["Dr. Smith met Prof. Jones at 9 a.m. They left", "See fig. 2, e.g. J. B. Lane", "End?"]
    assert (r.w, r.p, r.r) == ("a__BACKSLASH_PLACEHOLDER__b __REF_ERROR__", "a\\b (??)", "('Ġa', 'b\\'')")
    tokens = ["Like", "before", ",", "further", "improvements", "to", "this", "section", "are", "welcome", "ten", "12", "V"]
    tags = ["ADP", "ADV", "PUNCT", "ADV", "NOUN", "ADP", "DET", "NOUN", "AUX", "ADJ", "NUM", "NUM", "NUM"]
    m = spark.createDataFrame([(tokens, [t not in ("before", "V") for t in tokens], tags)], "t array<string>, s array<boolean>, p array<string>")
    assert m.select(X.masked_pos(F.col("t"), F.col("s"), F.col("p"), ("before", "further"))).first()[0] == "Like before, further # to this # are @ ten µ µ"


def test_numbers_within_groups(spark):
    df = spark.createDataFrame([("a", 3), ("a", 1), ("b", 9), (None, 2)], "k string, i int")
    assert {(r.k, r.i): r.impostor_id for r in number_within(df, ["k"], ["i"]).collect()} == {("a", 1): 1, ("a", 3): 2, ("b", 9): 1, (None, 2): 1}


def test_rounds_vectors_and_changes(spark):
    from glyphmill.operators.scoring import candidate_round, embed_texts

    rows = [(1, 0, " a  b ", [-1.0, -2.0]), (1, 1, "a b", [-9.0]), (1, 2, "", [-1.0]), (1, 3, "long", [-1.0] * 5), (2, 0, None, [-1.0])]
    df = spark.createDataFrame(rows, "k int, ord int, text string, log_probs array<double>").withColumn("p", F.lit(1))
    assert [tuple(r) for r in candidate_round(df, "k", 1, 4).collect()] == [(1, "a b", -3.0, 2)]
    assert [tuple(r) for r in candidate_round(df, "k", 1, 3, "p").collect()] == [(1, "a b", -2.0, 1)]
    got = embed_texts(df, "text", lambda: lambda texts: [[float(len(x))] for x in texts], "ord").collect()
    assert sorted(r.embedding[0] for r in got) == [0.0, 0.0, 3.0, 4.0, 6.0]
    one = spark.createDataFrame([(["a", "b", "c"], ["a", "x"], "Ġa", "—b", "é")], "a array<string>, b array<string>, m string, n string, o string")
    r = one.select(X.changed_tokens(F.col("a"), F.col("b")).alias("c"), X.leading_mark(F.col("m")).alias("m"), X.leading_mark(F.col("n")).alias("n"), X.leading_mark(F.col("o")).alias("o")).first()
    assert [tuple(c) for c in r.c] == [(1, "b", "x"), (2, "c", None)] and (r.m, r.n, r.o) == ("Ġ", "—", None)
