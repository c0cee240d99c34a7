"""The scorer interface with a scorer whose numbers can be told by hand: -length of each word."""

import sys

import pytest
from pyspark import cloudpickle

from glyphmill.operators import scoring as S

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers do not import test modules


def by_length():
    def score(texts):
        out = []
        for t in texts:
            words = t.split()
            out.append((words, [-float(len(w)) for w in words], [-1.0] * len(words)))
        return out

    return score


def test_scored_sentences(spark):
    df = spark.createDataFrame([(1, "a bb"), (2, ""), (3, None)], "i int, text string")
    rows = {r.i: r for r in S.scored_sentences(df, "text", by_length, "i").collect()}
    assert (rows[1].num_tokens, rows[1].sum_log_prob, rows[1].mean_abs_diff) == (2, -3.0, 0.5)
    assert rows[1].perplexity == pytest.approx(2.718281828459045**1.5) and rows[2].num_tokens == 0 and rows[3].avg_log_prob is None


PHRASES = [("phrase_1", "the cat", ["a cat", "the old cat", "a cat"]), ("phrase_2", "dog", None)]


def test_no_context_and_back(spark):
    df = spark.createDataFrame(PHRASES, "phrase_num string, phrase string, paraphrases array<string>")
    rows = {(r.phrase_num, r.phrase): (r["rank"], r.sum_log_probs) for r in S.score_no_context(df, by_length).collect()}
    assert rows == {("phrase_1", "the cat"): (0, -6.0), ("phrase_1", "a cat"): (1, -4.0), ("phrase_1", "the old cat"): (2, -9.0), ("phrase_2", "dog"): (0, -3.0)}
    back = {r.phrase_num: (r.phrase, r.paraphrases) for r in S.regrouped(S.exploded(df)).collect()}
    assert back == {"phrase_1": ("the cat", ["a cat", "the old cat"]), "phrase_2": ("dog", [])}


def test_in_context(spark):
    df = spark.createDataFrame(PHRASES[:1], "phrase_num string, phrase string, paraphrases array<string>")
    rows = {(r.phrase_occurence, r.phrase): r for r in S.score_in_context(df, "I saw The cat and the cat", by_length).collect()}
    assert len(rows) == 6
    r = rows[2, "a cat"]
    assert (r.sum_log_probs_base, r.sum_log_probs_phrase, r.difference, r.tokens, r["rank"]) == (-13.0, -4.0, -4.0, ["a", "cat"], 1)
    assert rows[1, "the cat"].sum_log_probs_base == -4.0 and rows[1, "the cat"]["rank"] == 0


def test_phrase_numbers_are_padded(spark):
    df = spark.createDataFrame([(f"p{k:02}",) for k in range(12)], "phrase string")
    assert [r.phrase_num for r in S.numbered_phrases(df, ["phrase"]).orderBy("phrase").collect()][:2] == ["phrase_01", "phrase_02"]
