"""Scorers against the models as tables and against plain loops; samples of exactly the size asked for."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphmill.functions.text import FLOOR
from glyphmill.operators import lm, sampling, scorers, small_models


def _texts(rng, docs):
    word = lambda: rng.choice("a b c d e f g h <s> the of".split())
    return [(d, f"{d}{k}", [word() for _ in range(rng.choice([0, 1, 2, 5, 9]))]) for d in docs for k in range(rng.randint(1, 5))]


@pytest.mark.parametrize("order,full", [(2, False), (3, False), (6, False), (2, True), (3, True), (5, True)])
def test_small_models_equal_the_tables(spark, order, full):
    rng = random.Random(order)
    schema = "doc_id string, sent_id string, tokens array<string>"
    known, unknown = spark.createDataFrame(_texts(rng, ["k1", "k2"]), schema), spark.createDataFrame(_texts(rng, ["u1", "u2"]), schema)
    problems = spark.createDataFrame([(1, "k1", "u1"), (2, "k2", "u1"), (3, "k1", "u2"), (4, "none", "u1"), (5, "k1", "none")], "problem_id bigint, known_id string, unknown_id string")
    refs = spark.createDataFrame([(p, r, t) for p in (1, 2, 3, 4, 5) for r in (1, 2, 3) for _, _, t in _texts(rng, "x")], "problem_id bigint, rep int, tokens array<string>")
    got = {(r.problem_id, r.rep): r for r in small_models.ratios(problems, known, unknown, refs, order, 0.6, full).collect()}
    f = lm.full_kn if full else lm.simplified_kn
    asked = unknown.withColumnRenamed("doc_id", "unknown_id")
    q = problems.join(asked, "unknown_id")
    keys = ["model_id", "problem_id", "sent_id"]
    km = lm.train(known.select(F.col("doc_id").alias("model_id"), "tokens"), order=order)
    pk = {(r.problem_id, r.sent_id, r.pos): r.p for r in f(km, q.select(F.col("known_id").alias("model_id"), "problem_id", "sent_id", "tokens").where("known_id <> 'none'"), keys, order, 0.6).collect()}
    name = F.concat_ws("|", "problem_id", "rep")
    rm = lm.train(refs.select(name.alias("model_id"), "tokens"), order=order)
    rq = q.join(refs.select("problem_id", "rep").distinct(), "problem_id").select(name.alias("model_id"), "problem_id", "rep", "sent_id", "tokens")
    want, wins, n = {}, {}, {}
    for r in f(rm, rq, [*keys, "rep"], order, 0.6).collect():
        if (k := pk.get((r.problem_id, r.sent_id, r.pos))) is not None:
            k, p, key = k if k > 0 else FLOOR, r.p if r.p > 0 else FLOOR, (r.problem_id, r.rep)
            want[key] = want.get(key, 0) + math.log10(k) - math.log10(p)
            n[key] = n.get(key, 0) + 1
    assert set(got) == set(want) and {p for p, _ in got} == {1, 2, 3}
    assert all(got[k].ratio == pytest.approx(want[k], abs=1e-8) and got[k].n == n[k] for k in want)


def test_perplexity_equals_the_table(spark):
    rng = random.Random(3)
    schema = "doc_id string, sent_id string, tokens array<string>"
    known, unknown = spark.createDataFrame(_texts(rng, ["k"]), schema), spark.createDataFrame(_texts(rng, ["u"]), schema)
    problems = spark.createDataFrame([(1, "k", "u")], "problem_id bigint, known_id string, unknown_id string")
    p = lm.full_kn(lm.train(known.select(F.col("doc_id").alias("model_id"), "tokens"), order=4), unknown.select(F.lit("k").alias("model_id"), "sent_id", "tokens"), ["model_id", "sent_id"], 4, 0.75)
    assert small_models.perplexities(problems, known, unknown, 4).first().perplexity == pytest.approx(lm.perplexity(p, ["model_id"]).first().perplexity)


def _ring(items, seed="0"):
    import hashlib

    return sorted(items, key=lambda i: (hashlib.md5(f"{seed}|{i}".encode()).hexdigest(), i))


def test_samples_have_exactly_their_size(spark):
    import hashlib

    rng = random.Random(4)
    items = {f"i{k}": ("hot" if k % 2 else "big" if k % 3 == 0 else rng.choice([None, "x", "y"])) for k in range(500)}
    asked = [(f"r{k}", rng.choice([0, 1, 5, 40, 80]), "hot", rng.choice(["big", "x", None, "hot"])) for k in range(120)] + [("all", 166, "hot", "big"), ("free", 500, None, None)]
    pool = spark.createDataFrame([*items.items()], "item string, author string").withColumn("pos", F.lit("clash"))
    req = spark.createDataFrame(asked, "req_id string, k bigint, not_a string, not_b string")
    got = {}
    for r in sampling.sample_for(req, pool).collect():
        got.setdefault(r.req_id, {})[r["rank"]] = r.item
    order = _ring(items)
    for name, k, a, b in asked:
        s = int(hashlib.md5(f"0|{name}".encode()).hexdigest()[:15], 16) % len(order)
        free = [i for i in order[s:] + order[:s] if items[i] is None or items[i] not in (a, b)]
        assert [got.get(name, {})[j] for j in range(1, k + 1)] == free[:k] and len(free) >= k
    share = sampling.sample_for(req.where("req_id = 'all'"), pool, share=0.5)
    assert share.count() == math.floor(sum(a not in ("hot", "big") for a in items.values()) / 2 + 0.5)
    with pytest.raises(ValueError, match="not enough"):
        sampling.sample_for(spark.createDataFrame([("r", 501, None, None)], req.schema), pool)
    assert sampling.sample_for(req.where("false"), pool).count() == 0


def test_samples_within_a_group(spark):
    pool = spark.createDataFrame([(g, f"{g}{k}") for g in "ab" for k in range(9)], "grp string, item string")
    req = spark.createDataFrame([("r1", "a", 9), ("r2", "a", 4), ("r3", "b", 1), ("r4", "b", 0)], "req_id string, grp string, k bigint")
    got = sampling.sample_within(req, pool).collect()
    assert {n: len({r.item for r in got if r.req_id == n}) for n in ("r1", "r2", "r3", "r4")} == {"r1": 9, "r2": 4, "r3": 1, "r4": 0} and all(r.item[0] == r.grp for r in got)
    with pytest.raises(Exception, match="not enough items for r5"):
        sampling.sample_within(spark.createDataFrame([("r5", "a", 10)], req.schema), pool).collect()


def test_perplexity_rank_against_loops(spark):
    rng = random.Random(6)
    values = lambda n: [round(rng.uniform(1, 9), 1) for _ in range(n)]
    k, u, refs = values(4), values(3), [values(4) for _ in range(3)]
    problems = spark.createDataFrame([(1, "k", "u")], "problem_id bigint, known_id string, unknown_id string")
    side = lambda d, v: spark.createDataFrame([(d, f"{d}{j}", x) for j, x in enumerate(v)], "doc_id string, sent_id string, perplexity double")
    r = spark.createDataFrame([(1, j + 1, x) for j, b in enumerate(refs) for x in b], "problem_id bigint, rep int, perplexity double")
    per = [sum(1 / ((1 + sum(abs(x - y) < abs(x - z) for y in b)) * 3 * 4) for b in refs for z in k) for x in u]
    assert scorers.perplexity_rank(problems, side("k", k), side("u", u), r, reps=3).first().score == pytest.approx(float(np.median(per)))


def test_impostor_distances_against_loops(spark):
    import hashlib

    rng = random.Random(8)
    docs = [(f"d{k}", "c", rng.choice(["x", "y", "z", None])) for k in range(40)] + [("k", "c", "ka"), ("o", "other", "x")]
    lp = {d: [rng.uniform(-5, -1) for _ in range(rng.choice([2, 3, 4]))] for d, _, _ in docs}
    lp["u"] = [-1.0, -2.0, -4.0]
    frame = lambda ds: spark.createDataFrame([(d, v) for d in ds for v in lp[d]], "doc_id string, avg_lp double")
    problems = spark.createDataFrame([(1, "c", "k", "u", "ka", "x")], "problem_id bigint, corpus string, known_id string, unknown_id string, known_author string, unknown_author string")
    pool = spark.createDataFrame(docs, "doc_id string, corpus string, author string")
    got = sorted(tuple(r) for r in scorers.impostor_distances(problems, frame([d for d, _, _ in docs]), frame(["u"]), pool, draws=20, tests=2).collect())
    scaled = {d: np.sort(np.exp(v)) / np.exp(v).sum() for d, v in lp.items()}

    def emd(a, b):
        at = np.sort(np.concatenate([a, b]))
        return round(float(sum(abs(np.searchsorted(a, x, "right") / len(a) - np.searchsorted(b, x, "right") / len(b)) * (y - x) for x, y in zip(at, at[1:]))), 12)

    ku = emd(scaled["u"], scaled["k"])
    ring = [d for d in _ring([d for d, c, a in docs if c == "c" and a not in ("ka", "x")])]
    m, n = len(ring), math.floor(len(ring) / 2 + 0.5)
    want = []
    for test in (0, 1):
        total = 0
        for j in range(20 * test, 20 * test + 20):
            s = int(hashlib.md5(f"0|1|{j}".encode()).hexdigest()[:15], 16) % m
            total += 1 / (1 + sum(emd(scaled["u"], scaled[(ring + ring)[i]]) < ku for i in range(s, s + n)))
        want.append((1, test + 1, pytest.approx(ku), pytest.approx(total / 20)))
    assert got == want


def test_impostor_distances_write_no_pairs(spark, monkeypatch):
    """Unknown documents meet their corpus in blocks; what is written grows with documents and problems, not with pairs, and doesn't depend on the blocks."""
    rng = random.Random(12)
    docs = [(f"d{k}", rng.choice(["c", "o"]), rng.choice(["x", "y", "z", None])) for k in range(60)]
    lp = {d: [rng.uniform(-5, -1) for _ in range(rng.randint(1, 5))] for d in [*(d for d, _, _ in docs), *(f"u{k}" for k in range(60))]}
    frame = lambda c: spark.createDataFrame([(d, v) for d in lp if d[0] == c for v in lp[d]], "doc_id string, avg_lp double")
    asked = [(k, rng.choice(["c", "o", "none", None]), f"d{rng.randrange(60)}", f"u{rng.randrange(60)}", rng.choice("xy"), rng.choice(["x", "z", None])) for k in range(80)]
    problems = spark.createDataFrame(asked, "problem_id bigint, corpus string, known_id string, unknown_id string, known_author string, unknown_author string")
    written = []
    whole = scorers.cut
    monkeypatch.setattr(scorers, "cut", lambda df: (x := whole(df), written.append(x.count()))[0])
    run = lambda: sorted(map(tuple, scorers.impostor_distances(problems, frame("d"), frame("u"), spark.createDataFrame(docs, "doc_id string, corpus string, author string"), draws=10, tests=2).collect()))
    got = run()
    assert len(got) == 160 and max(written) < 500  # 60 x 30 pairs
    assert all((s == 0) == (asked[p][1] in ("none", None)) for p, _, _, s in got)
    for name, size in (("ASKING_DOCS", 7), ("RING_DOCS", 5), ("PAIRS", 100)):
        monkeypatch.setattr(scorers, name, size)
    assert run() == got


def test_rare_tokens_are_scored_as_common_ones(spark, monkeypatch):
    rows = [("d", f"d:{k}", t.split()) for k, t in enumerate(["a b a", "c", "a d e", "b b", "e f"])]
    sentences = spark.createDataFrame(rows, "doc_id string, sent_id string, tokens array<string>")
    run = lambda: sorted(map(tuple, scorers.unigram_log_probs(sentences).collect()))
    every = run()
    n = {x: sum(r[2].count(x) for r in rows) for x in "abcdef"}
    assert [r[3] for r in every] == [pytest.approx(sum(math.log(n[x] / 11) for x in r[2])) for r in rows]
    monkeypatch.setattr(scorers, "HOT_TOKENS", 2)
    assert run() == every


def test_near_items_against_all_pairs(spark, monkeypatch):
    """Vectors that ask in blocks while the pool passes by in pieces find what plain sorting finds: ties to the smaller item, two authors fenced off, several fences of one vector."""
    import numpy as np

    monkeypatch.setattr(scorers, "ASKING_VECTORS", 20)
    monkeypatch.setattr(scorers, "PIECE_ITEMS", 37)
    r = np.random.default_rng(3)
    vectors = [r.integers(0, 3, 8).astype(float) + np.eye(8)[k % 8] * (0.5 if k % 17 == 0 else 1) for k in range(400)]
    items = [(k + 1, random.Random(k).choice(["x", "y", "z", None]), v.tolist()) for k, v in enumerate(vectors)]
    asked = [(q, random.Random(-q).choice(["x", "y", None]), random.Random(q).choice(["z", "y", None]), vectors[q // 2 * 7].tolist()) for q in range(100)]
    pool = scorers._packed(spark.createDataFrame(items, "item bigint, author string, vector array<double>"))
    queries = scorers._packed(spark.createDataFrame(asked, "query bigint, not_a string, not_b string, vector array<double>"))
    got: dict[int, set] = {}
    for x in scorers.near_items(queries, pool, 6).collect():
        got.setdefault(x.query, set()).add(x.item)
    unit = np.array([v / np.linalg.norm(v) for v in vectors])
    for q, a, b, v in asked:
        near = np.round(unit @ (np.array(v) / np.linalg.norm(v)), 12)
        free = [(-near[i - 1], i) for i, author, _ in items if author is None or author not in (a, b)]
        assert got[q] == {i for _, i in sorted(free)[:6]}


def test_max_similarity_against_plain_models(spark):
    """References come from the nearest sentences of other authors, one for each known sentence, and are scored as any others."""
    rng = random.Random(9)
    word = lambda: rng.choice("a b c d e f g h".split())
    rows = [(f"d{k}", rng.choice("xyz") if k else "k", f"d{k}:{j}", [word() for _ in range(rng.randint(2, 6))]) for k in range(12) for j in range(4)]
    known = spark.createDataFrame(rows, "doc_id string, author string, sent_id string, tokens array<string>")
    from glyphmill.functions import text as X

    problems = spark.createDataFrame([(1, "d0", "u", "k", "x")], "problem_id bigint, known_id string, unknown_id string, known_author string, unknown_author string")
    picks = scorers.similar_sentences(problems, known.withColumn("vector", X.hashed_vector(F.col("tokens"))), 6, 3).collect()
    author, tokens = {r[2]: r[1] for r in rows}, {r[2]: r[3] for r in rows}
    for rep in (1, 2, 3):
        mine = [r.sent_id for r in picks if r.rep == rep]
        assert len(mine) == 4 and len({tuple(tokens[s]) for s in mine}) == 4 and not {author[s] for s in mine} & {"k", "x"}
    unknown = spark.createDataFrame([("u", "u0", ["a", "b", "c"])], "doc_id string, sent_id string, tokens array<string>")
    refs = spark.createDataFrame([(1, r.rep, tokens[r.sent_id]) for r in picks], "problem_id bigint, rep int, tokens array<string>")
    assert small_models.ratios(problems, known, unknown, refs, 3).count() == 3
    with pytest.raises(Exception, match="count from 1"):
        small_models.ratios(problems, known, unknown, refs.withColumn("rep", F.col("rep") - 1), 3).collect()


def test_divergence_scores_send_no_tokens_of_pairs(spark, monkeypatch):
    """Means of the pairs' divergences as ``divergences`` has them, missing documents included; the plan explodes no tokens."""
    rng = random.Random(12)
    schema = "doc_id string, sent_id string, tokens array<string>"
    known, unknown = spark.createDataFrame(_texts(rng, [f"k{j}" for j in range(9)]), schema), spark.createDataFrame(_texts(rng, ["u1", "u2"]), schema)
    rows = [(1, "k0", "u1"), (2, "k1", "u2"), (3, "none", "u1"), (4, "k2", "none"), (5, "none", "none")]
    problems = spark.createDataFrame(rows, "problem_id bigint, known_id string, unknown_id string")
    refs = [(p, r, rng.choice([f"k{j}" for j in range(9)] + ["gone"])) for p, _, _ in rows for r in range(1, 6)]
    monkeypatch.setattr(scorers, "BLOCK_DOCS", 3)
    df = scorers.divergence_scores(problems, known, unknown, spark.createDataFrame(refs, "problem_id bigint, rep int, ref_id string"))
    assert "Generate" not in df._jdf.queryExecution().executedPlan().toString()
    side = lambda s, d: scorers.token_counts(d, "doc_id").select(F.concat(F.lit(s), "doc_id").alias("id"), "token", "p")
    of = {p: u for p, _, u in rows}
    named = [(p, 0, k, u) for p, k, u in rows] + [(p, r, k, of[p]) for p, r, k in refs]
    pairs = spark.createDataFrame([(f"{p}|{r}", f"u:{u}", f"k:{k}") for p, r, k, u in named], "pair_id string, left_id string, right_id string")
    d = {r.pair_id: (r.jsd, r.renyi, r.hellinger) for r in scorers.divergences(pairs, side("u:", unknown).unionByName(side("k:", known))).collect()}
    for r in df.collect():
        mine = [d[f"{r.problem_id}|{j}"] for j in range(1, 6) if f"{r.problem_id}|{j}" in d]
        own = d.get(f"{r.problem_id}|0")
        want = tuple(pytest.approx(np.mean([m[i] for m in mine]) - own[i], abs=1e-9) for i in range(3)) if own and mine else (None,) * 3
        assert (r.jsd, r.renyi, r.hellinger) == want
    assert {r.problem_id for r in df.collect()} == {int(x.split("|")[0]) for x in d}
