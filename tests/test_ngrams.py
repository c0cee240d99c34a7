"""Shared n-grams against the quadratic definition, the n-gram filter's goldens, spans and occurrences."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glyphmill.functions import text as X
from glyphmill.operators import ngrams as N

KEEP = """Ġmachine,Ġlearning Super,Ġfragile Ġhello!,Ġworld ĉ,Ġtabbed ÂƠ,Ġword ▁we,▁test ▁,▁ Ġnatural,Ġlanguage,Ġprocessing Bio,Ġtech,Ġboom Ġthey,'d,Ġve Ċ,Ġnew,Ġparagraph
ĉ,Ġtabbed,Ġline Č,Ġform,Ġfeed Ġbefore,ÂƠ,Ġafter ▁we,▁are,▁testing ▁,▁,word""".split()
DROP = "Ġhello|, Ġwe|'re !|? un|breakable Ċ|Ġstart Ċ|Ċ .Ċ|pneu Ġi|'m Ġword|. (|Ġparenthetical Ġdash|— Â|Ơ ▁|Hello Ġsuper|cal|ifragilistic Ċ|i|'m Ċ|Ċ|Ċ bio|tech|nology Ġhello|!|Ċ -|Ġbreak|-".split()


def test_filter_goldens(spark):
    rows = [(k.split(","), True) for k in KEEP] + [(d.split("|"), False) for d in DROP]
    df = spark.createDataFrame(rows, "g array<string>, want boolean")
    bad = df.where(X.keeps_ngram(F.col("g")) != F.col("want")).collect()
    # a dash that is no ASCII punctuation counts as a word: such pairs have no word start after the first token anyway
    assert not [r.g for r in bad]


def _brute(a, b, n):
    grams = lambda t: {tuple(t[i : i + k]) for k in range(n, len(t) + 1) for i in range(len(t) - k + 1)}
    shared = grams(a) & grams(b)
    inside = lambda s, l: len(s) < len(l) and any(l[i : i + len(s)] == s for i in range(len(l) - len(s) + 1))  # noqa: E731, E741
    return {g for g in shared if not any(inside(g, h) for h in shared)}, shared


@pytest.mark.parametrize("n", [1, 2, 3])
def test_common_ngrams_against_brute_force(spark, n):
    rng = random.Random(n)
    docs = {f"{s}{k}": [rng.choice("abcd") for _ in range(rng.randint(0, 14))] for s in "xy" for k in range(8)}
    tokens = spark.createDataFrame(list(docs.items()), "doc_id string, tokens array<string>")
    pairs = spark.createDataFrame([(k, f"x{k}", f"y{k}") for k in range(8)], "pair_id int, doc_a string, doc_b string")
    got, all_ = ({(r.pair_id, tuple(r.gram.split("\u0001"))) for r in N.common_ngrams(pairs, tokens, n, include_subgrams=s).collect()} for s in (False, True))
    want = {(k, g) for k in range(8) for g in _brute(docs[f"x{k}"], docs[f"y{k}"], n)[0]}
    every = {(k, g) for k in range(8) for g in _brute(docs[f"x{k}"], docs[f"y{k}"], n)[1]}
    assert got == want and all_ == every


def test_common_ngrams_rejects_zero(spark):
    with pytest.raises(ValueError):
        N.common_ngrams(None, None, 0)


def test_occurrence_prefixes(spark):
    df = spark.createDataFrame([("A cat, a CAT.", "cat"), ("nothing", "cat"), ("a.b*a.b", "a.b"), (None, "x")], "t string, p string")
    got = [r.o for r in df.select(X.occurrence_prefixes(F.col("t"), F.col("p")).alias("o")).collect()]
    assert got[:3] == [["a ", "a cat, a "], ["nothing"], ["", "a.b*"]]


def test_spans_may_overlap_and_masks(spark):
    df = spark.createDataFrame([(list("aaab"), list("aa"))], "t array<string>, p array<string>")
    r = df.select(X.find_spans(F.col("t"), F.col("p")).alias("s"), X.masked_single(F.col("t"), F.lit(1), F.lit(2), "M").alias("m"), X.masked_each(F.col("t"), F.lit(2), F.lit(2), "M").alias("e")).first()
    assert (r.s, r.m, r.e) == ([0, 1], ["a", "M", "b"], ["a", "a", "M", "M"])


def test_coverage_runs(spark):
    text = spark.createDataFrame([("d", 10), ("e", 3)], "doc_id string, length int")
    spans = spark.createDataFrame([("d", 1, 4), ("d", 3, 6), ("d", 8, 10)], "doc_id string, start int, end int")
    got = [tuple(r) for r in N.coverage_runs(text, spans).orderBy("doc_id", "start").collect()]
    assert got == [("d", 0, 1, 0), ("d", 1, 3, 1), ("d", 3, 4, 2), ("d", 4, 6, 1), ("d", 6, 8, 0), ("d", 8, 10, 1), ("e", 0, 3, 0)]


def test_temp_doc_id(spark):
    df = spark.createDataFrame([("known [Quarry-Forum - Known 12].txt",), ("none",), (None,), ("[A--B][C]",)], "x string")
    assert [r.y for r in df.select(X.temp_doc_id(F.col("x")).alias("y")).collect()] == ["quarry_forum_known_12", None, None, "a_b"]


def test_words_are_unicode(spark):
    df = spark.createDataFrame([("straße Ünïcode don’t",)], "x string")
    assert df.select(X.words(F.col("x")).alias("w")).first().w == ["straße", "ünïcode", "don", "t"]


def test_masked_pos(spark):
    toks = "Like before , further improvements to this section are welcome .".split()
    tags = ["ADP", "ADV", "PUNCT", "ADV", "NOUN", "ADP", "DET", "NOUN", "AUX", "ADJ", "PUNCT"]
    spaces = [True, False, True, True, True, True, True, True, True, False, False]
    df = spark.createDataFrame([(toks, spaces, tags)], "t array<string>, s array<boolean>, p array<string>")
    out = df.select(X.masked_pos(F.col("t"), F.col("s"), F.col("p"), ("before", "further"), {"NOUN": "#", "ADJ": "@"}).alias("m")).first().m
    assert out == "Like before, further # to this # are @."


def test_json_and_paraphrases(spark):
    answers = ["first", 'say {"paraphrases": ["One", "two", "ONE", "Phrase"]} end', "{broken", None]
    df = spark.createDataFrame([(answers, "phrase")], "a array<string>, p string")
    assert df.select(X.parse_paraphrases(F.col("a"), F.col("p")).alias("x")).first().x == ["one", "two"]


@given(st.lists(st.sampled_from("abc"), max_size=14), st.lists(st.sampled_from("abc"), max_size=14), st.integers(1, 3))
@settings(max_examples=400, deadline=None)
def test_shared_runs_against_all_ngrams(a, b, n):
    grams = lambda x: {tuple(x[i : i + k]) for k in range(n, len(x) + 1) for i in range(len(x) - k + 1)}
    every = grams(a) & grams(b)
    inside = lambda s, l: len(l) > len(s) and any(l[i : i + len(s)] == s for i in range(len(l) - len(s) + 1))
    assert N.shared_runs(a, b, n, include_subgrams=True) == every
    assert N.shared_runs(a, b, n) == {s for s in every if not any(inside(s, x) for x in every)}


def test_shared_runs_of_long_repetitive_texts():
    import time

    began = time.process_time()
    n = 5_000
    assert {len(r) for r in N.shared_runs(["a", "b"] * n, ["b", "a"] * n, 2)} == {2 * n - 1}
    assert time.process_time() - began < 5


def test_sharing_pairs_and_reading_order(spark):
    docs = spark.createDataFrame([("x", "a b c d".split()), ("y", "z a b c".split()), ("w", "q".split()), ("v", None), ("u", [])], "doc_id string, tokens array<string>")
    pairs = N.sharing_pairs(docs, 3)
    assert [tuple(r) for r in pairs.collect()] == [("x|y", "x", "y")]
    grams = spark.createDataFrame([("p", 2, "b\u0001c"), ("p", 2, "a\u0001b"), ("p", 3, "Ġx\u0001y'\u0001z")], "pair_id string, n int, gram string")
    got = [(r.pretty, r.raw) for r in N.readable(grams, strip=("Ġ",)).orderBy("place").collect()]
    assert got == [("x y' z", "('Ġx', 'y\\'', 'z')"), ("a b", "('a', 'b')"), ("b c", "('b', 'c')")][1:] + [("x y' z", "('Ġx', 'y\\'', 'z')")]
    assert [r.n for r in N.readable(grams, "len_desc").orderBy("place").collect()] == [3, 2, 2]


def test_largest_common_run_of_profiles(spark):
    rng = random.Random(5)
    known = {a: [[rng.choice("abcd") for _ in range(rng.randint(0, 9))] for _ in range(6)] for a in "pqr"}
    unknown = {a: [[rng.choice("abcdx") for _ in range(rng.randint(0, 9))] for _ in range(4)] for a in "uv"} | {"none": [["z"], ["y", "z"]], "single": [["a"]]}
    table = lambda d: N.profile_tokens(spark.createDataFrame([(a, k, t) for a, docs in d.items() for k, t in enumerate(docs)] + [(None, 1, ["a"])], "author string, ord int, tokens array<string>"), "author", ["ord"])
    pairs = spark.createDataFrame([(f"{a}{b}", a, b) for a in "pqr" for b in unknown] + [("lost", "nobody", "u")], "pair_id string, left_id string, right_id string")
    flat = lambda d: {a: sum(docs, []) for a, docs in d.items()}
    got = {r.pair_id: (r.highest_common_count, r.ngram) for r in N.largest_common_run(pairs, table(known), table(unknown)).collect()}
    k, u, want = flat(known), flat(unknown), {}
    for a in k:
        for b in u:
            runs = N.shared_runs(u[b], k[a], 2, include_subgrams=True)
            if runs:
                n = max(map(len, runs))
                want[a + b] = (n, " ".join(min(r for r in runs if len(r) == n)))
    assert got == want and not {"pnone", "psingle", "lost"} & set(got)


@pytest.mark.parametrize("most", [1 << 18, 20])
def test_largest_common_run_of_texts_equals_the_rows(spark, most):
    """Profiles in one row, in rows of tokens, or some of each; the task that holds them needs no join by length."""
    rng = random.Random(11)
    texts = lambda owners, words, n: spark.createDataFrame([(a, f"d{rng.randint(1, 3)}", k, [rng.choice(words) for _ in range(rng.randint(0, 9))]) for a in owners for k in range(rng.randint(1, n))] + [(None, "d", 1, ["a"])], "author string, doc_id string, chunk int, tokens array<string>")
    known, unknown = texts("pqrs", ["a", "b", "c", "é", "z"], 8), texts("uvwxy", ["a", "b", "é", "q"], 5)
    pairs = spark.createDataFrame([(f"{a}{b}", a, b) for a in "pqrs" for b in "uvwxy"] + [("again", "p", "u"), ("lost", "nobody", "u")], "pair_id string, left_id string, right_id string")
    order = ["doc_id", "chunk"]
    want = sorted(tuple(r) for r in N.largest_common_run(pairs, *(N.profile_tokens(t, "author", order) for t in (known, unknown))).collect())
    assert sorted(tuple(r) for r in N.largest_common_run_of_texts(pairs, known, unknown, "author", order, most=most).collect()) == want and len(want) > 5


def test_longest_shared_takes_repetitive_profiles():
    a, b = np.zeros(3000, np.int64), np.r_[np.zeros(700, np.int64), 1, np.zeros(900, np.int64)]
    assert N._longest_shared(a, [b, np.array([2, 1]), np.zeros(0, np.int64), a]) == [(900, 701), (0, 0), (0, 0), (3000, 0)]
    assert N._longest_shared(np.array([3, 1, 2, 3, 1, 1]), [np.array([3, 1, 1, 0, 1, 2, 3])]) == [(3, 4)]
