"""Goldens of the language models and divergences, and properties that hold for any input."""

import math

import pytest
from pyspark.sql import functions as F

from glyphmill.operators import lm, ngrams, scorers
from glyphmill.functions import text as X


def _skn(spark, sentence):
    model = spark.createDataFrame([("m", ["a", "b", "a"]), ("m", ["b", "a", "c"])], "model_id string, tokens array<string>")
    q = spark.createDataFrame([("m", "q", sentence)], "model_id string, sent_id string, tokens array<string>")
    rows = lm.simplified_kn(lm.train(model), q, ["model_id", "sent_id"]).orderBy("pos").collect()
    return [r.p for r in rows]


def test_simplified_kn_goldens(spark):
    assert _skn(spark, ["a", "b"]) == pytest.approx([0.27734375, 0.453125, 0.0703125], abs=1e-12)
    assert _skn(spark, ["c", "z"]) == pytest.approx([0.052734375, 0.0, 0.25], abs=1e-12)


def test_lambdag_golden(spark):
    known = spark.createDataFrame([("k", "k1", ["a", "b", "a"]), ("k", "k2", ["b", "a", "c"])], "doc_id string, sent_id string, tokens array<string>")
    unknown = spark.createDataFrame([("u", "u1", ["a", "b"]), ("v", "v1", ["c", "z"])], "doc_id string, sent_id string, tokens array<string>")
    problems = spark.createDataFrame([(1, "k", "u"), (2, "k", "v")], "problem_id bigint, known_id string, unknown_id string")
    refs = spark.createDataFrame([(p, 1, t) for p in (1, 2) for t in (["a", "c"], ["c", "b"])], "problem_id bigint, rep int, tokens array<string>")
    got = {r.problem_id: r.score for r in scorers.lambdag(problems, known, unknown, refs, reps=1, order=3).collect()}
    assert got[1] == pytest.approx(0.008703814079, abs=1e-9)
    assert got[2] == pytest.approx(-0.801891425452, abs=1e-9)


def test_full_kn_goldens(spark):
    text = "a a b a a b a b a b a b".split()
    model = spark.createDataFrame([("m", text)], "model_id string, tokens array<string>")
    stats = lm.train(model, order=4)
    q = spark.createDataFrame([("m", "q", [*text, "c"])], "model_id string, sent_id string, tokens array<string>")
    probs = lm.full_kn(stats, q, ["model_id", "sent_id"], 4, 0.5)
    r = lm.perplexity(probs, ["model_id"]).first()
    assert (r.n, r.perplexity) == (14, pytest.approx(2.180138034524, abs=1e-9))


def test_full_kn_sums_to_one_over_the_vocabulary(spark):
    """For any context but the padding alone, at order 3."""
    text = ["x y z x y", "y x z z"]
    model = spark.createDataFrame([("m", t.split()) for t in text], "model_id string, tokens array<string>")
    stats = lm.train(model, order=3)
    words = ["x", "y", "z", "never"]
    q = spark.createDataFrame([("m", w, ["x", "y", w]) for w in words], "model_id string, sent_id string, tokens array<string>")
    p = {r.sent_id: r.p for r in lm.full_kn(stats, q, ["model_id", "sent_id"], 3, 0.5).where("pos = 2").collect()}
    end = spark.createDataFrame([("m", "e", ["x", "y"])], "model_id string, sent_id string, tokens array<string>")
    p_end = lm.full_kn(stats, end, ["model_id", "sent_id"], 3, 0.5).where("pos = 2").first().p
    pad = spark.createDataFrame([("m", "s", ["x", "y", "<s>"])], "model_id string, sent_id string, tokens array<string>")
    p_pad = lm.full_kn(stats, pad, ["model_id", "sent_id"], 3, 0.5).where("pos = 2").first().p
    assert sum(p.values()) + p_end + p_pad == pytest.approx(1.0, abs=1e-9)


def test_divergence_goldens(spark):
    docs = {"u": "a a b c", "k": "a b b d", "r": "c c e"}
    rows = spark.createDataFrame([(k, v.split()) for k, v in docs.items()], "id string, tokens array<string>")
    p = ngrams.token_counts(rows, "id")
    pairs = spark.createDataFrame([("uk", "u", "k"), ("ur", "u", "r")], "pair_id string, left_id string, right_id string")
    got = {r.pair_id: r for r in scorers.divergences(pairs, p).collect()}
    assert (got["uk"].jsd, got["ur"].jsd) == (pytest.approx(0.311278124459), pytest.approx(0.612547487381))
    assert (got["uk"].renyi, got["ur"].renyi) == (pytest.approx(1.0), pytest.approx(2.584962500721))
    assert (got["uk"].hellinger, got["ur"].hellinger) == (pytest.approx(0.541196100146), pytest.approx(0.769253995463))


def test_wasserstein_of_equal_sizes_is_the_mean_gap(spark):
    a, b = [1.0, 2.0, 4.0, 9.0], [2.0, 2.0, 5.0, 7.0]
    left = spark.createDataFrame([("x", v) for v in a], "k string, value double")
    right = spark.createDataFrame([("x", v) for v in b], "k string, value double")
    want = sum(abs(p / 16 - q / 16) for p, q in zip(sorted(a), sorted(b))) / 4
    assert scorers.wasserstein(left, right, "k").first().emd == pytest.approx(want)


def test_train_rejects_order_one(spark):
    with pytest.raises(ValueError):
        lm.train(spark.createDataFrame([], "model_id string, tokens array<string>"), order=1)


@pytest.mark.parametrize("order", [2, 3])
def test_next_words_against_every_word_of_the_vocabulary(spark, order):
    """Unseen words fill up and outrank seen ones; x has many left contexts and never stands after q."""
    text = ["a x", "b x", "c x", "d x", "e x", "f x", "q y", "q z y", "a b q z"]
    model = spark.createDataFrame([("m", t.split()) for t in text], "model_id string, tokens array<string>")
    stats = lm.train(model, order=order)
    asked = [("q",), ("x",), ("y",), ("never",), ("z", "q"), ("b", "q"), ("never", "q"), ("a", "b")]
    contexts = spark.createDataFrame([("m", "\u0001".join(c)) for c in asked], "model_id string, context string")
    got = {}
    for r in lm.next_words(stats, contexts, 4, order=order).orderBy("rank").collect():
        got.setdefault(tuple(r.context.split("\u0001")), []).append((r.word, r.p))

    grams = {}
    for t in text:
        padded = ["<s>"] * (order - 1) + t.split() + ["</s>"]
        for k in range(1, order + 1):
            for i in range(len(padded) - k + 1):
                grams[tuple(padded[i : i + k])] = grams.get(tuple(padded[i : i + k]), 0) + 1
    bigrams = [g for g in grams if len(g) == 2]

    def p(word, context):
        if not context:
            return sum(g[1] == word for g in bigrams) / len(bigrams)
        after = {g[-1]: c for g, c in grams.items() if len(g) == len(context) + 1 and g[:-1] == context}
        lower, total = p(word, context[1:]), sum(after.values())
        return max(after.get(word, 0) - 0.75, 0) / total + 0.75 * len(after) / total * lower if total else lower

    for c in asked:
        best = sorted((-p(g[0], c[-(order - 1) :]), g[0]) for g in grams if len(g) == 1)[:4]
        assert [w for w, _ in got[c]] == [w for _, w in best]
        assert [v for _, v in got[c]] == pytest.approx([-v for v, _ in best], abs=1e-12)
    assert "x" in [w for w, _ in got[("q",)]]


def test_generated_sentences_repeat_and_use_known_words(spark):
    model = spark.createDataFrame([("m", ["a", "b", "c"]), ("m", ["a", "c"])], "model_id string, tokens array<string>")
    stats = lm.train(model, order=2)
    one, two = ([r.tokens for r in lm.generate(stats, stats.select("model_id").distinct(), 6).collect()] for _ in range(2))
    assert one == two and set(one[0]) <= {"a", "b", "c"} and one[0][0] == "a"


@pytest.mark.parametrize("order", [2, 3])
def test_generated_first_words_follow_the_smoothed_probabilities(spark, order):
    """Words that never begin a sentence come as often as the full model says; 3000 copies of one model draw one word each."""
    text = ["a b c", "a c", "b c c"]
    names = [f"m{k:04}" for k in range(3000)]
    rows = spark.createDataFrame([(m, t.split()) for m in names for t in text], "model_id string, tokens array<string>")
    stats = lm.train(rows, order=order)
    drawn = [tuple(r.tokens) for r in lm.generate(stats, stats.select("model_id").distinct(), 1, order=order).collect()]
    voc = ["a", "b", "c", "<unk>", "<s>", "</s>"]
    one = lm.train(spark.createDataFrame([("m", t.split()) for t in text], "model_id string, tokens array<string>"), order=order)
    q = spark.createDataFrame([("m", w, [w]) for w in voc], "model_id string, sent_id string, tokens array<string>")
    p = {r.sent_id: r.p for r in lm.full_kn(one, q, ["model_id", "sent_id"], order, 0.5).where("pos = 0").collect()}
    total = sum(p.values())
    assert len(drawn) == 3000 and all(len(t) <= 1 for t in drawn)
    for w in ("a", "b", "c", "<unk>"):
        share = p[w] / total
        assert share > 0 and drawn.count((w,)) / 3000 == pytest.approx(share, abs=5 * math.sqrt(share * (1 - share) / 3000))


def test_cosine_zero_vector_raises(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    with pytest.raises(Exception, match="zero vector"):
        df.select(X.cosine(F.col("a"), F.col("b"))).collect()


def test_nearest_against_brute_force(spark):
    vectors = [(k, [math.sin(k), math.cos(3 * k), (k % 5) - 2.5]) for k in range(60)]
    pool = spark.createDataFrame(vectors, "item_id bigint, vector array<double>")
    queries = pool.where("item_id % 20 = 0").withColumnRenamed("item_id", "query_id")
    got = {(r.query_id, r["rank"]): r.item_id for r in scorers.nearest(queries, pool, 3, block_rows=16).collect()}

    def cos(a, b):
        return sum(x * y for x, y in zip(a, b)) / math.hypot(*a) / math.hypot(*b)

    for q in (0, 20, 40):
        best = sorted((-cos(vectors[q][1], v), k) for k, v in vectors if k != q)[:3]
        assert [got[q, r] for r in (1, 2, 3)] == [k for _, k in best]


def test_references_without_repetition(spark):
    n = spark.createDataFrame([(1, q, i) for q, items in ((1, "ab"), (2, "a"), (3, "bc")) for i in items], "problem_id int, query_id int, item_id string")
    rows = scorers.similar_references(n, reps=2).collect()
    assert {r.rep for r in rows} == {1, 2}
    for rep in (1, 2):
        used = [r.item_id for r in rows if r.rep == rep]
        assert len(used) == len(set(used)) == 3
    short = spark.createDataFrame([(1, 1, "a"), (1, 2, "a")], "problem_id int, query_id int, item_id string")
    with pytest.raises(Exception, match="no references"):
        scorers.similar_references(short).collect()
