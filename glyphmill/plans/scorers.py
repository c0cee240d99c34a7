"""Queries that score every problem of the metadata by each method."""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphmill.functions import text as X
from glyphmill.operators import scorers as S
from glyphmill.plans import base as B
from glyphmill.session import cut, table

REPS, ORDER, TRIALS = 30, 10, 10  # the methods' own settings


def _inputs(spark, d):  # noqa: ANN001, ANN202
    # tokenised once and written: every scorer reads its sentences several times
    return {"problems": B.samples(spark, d), "known": cut(B.known_sentences(spark, d)), "unknown": cut(B.unknown_sentences(spark, d))}


def _rounded(df):  # noqa: ANN001, ANN202
    return df.select(*[B.r6(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _with_tokens(refs, x):  # noqa: ANN001, ANN202
    return refs.join(x["known"].select("sent_id", "tokens"), "sent_id").select("problem_id", "rep", "tokens")


def _sampled(name, spark, d, **more):  # noqa: ANN001, ANN003, ANN202
    x = _inputs(spark, d)
    refs = B.reference_sentences(x["problems"], x["known"], REPS)
    return _rounded(S.run_method(name, reps=REPS, refs=_with_tokens(refs, x), order=ORDER, **x, **more))


def lambdag(spark, d):  # noqa: ANN001, ANN201
    """Known model against models of as many sentences of other authors."""
    return _sampled("lambdag", spark, d)


def lambdag_v2(spark, d):  # noqa: ANN001, ANN201
    return _sampled("lambdag", spark, d, kind="full", discount=0.5)


def lambdag_surprisal(spark, d):  # noqa: ANN001, ANN201
    return _sampled("surprisal", spark, d)


def lambdag_entropy(spark, d):  # noqa: ANN001, ANN201
    return _sampled("entropy_weighted", spark, d)


def _docs(sentences):  # noqa: ANN001, ANN202
    return sentences.groupBy("doc_id").agg(F.max("author").alias("author"), F.max("corpus").alias("corpus"))


def _impostors(x, each, trials=1):  # noqa: ANN001, ANN202
    return B.reference_docs(x["problems"], _docs(x["known"]), trials, each)


def lambdag_paraphrase(spark, d):  # noqa: ANN001, ANN201
    """Known model against models of whole impostor documents."""
    x = _inputs(spark, d)
    refs = _impostors(x, REPS).join(x["known"].select(F.col("doc_id").alias("ref_id"), "tokens"), "ref_id")
    return _rounded(S.run_method("lambdag", reps=REPS, order=ORDER, refs=refs.select("problem_id", F.col("place").alias("rep"), "tokens"), **x))


def lambdag_paraphrase_v2(spark, d):  # noqa: ANN001, ANN201
    """Known model against models of as many sentences of the pooled impostor documents."""
    x = _inputs(spark, d)
    refs = B.pooled_sentences(x["problems"], x["known"], _impostors(x, REPS), REPS)
    return _rounded(S.run_method("lambdag", reps=REPS, order=ORDER, refs=_with_tokens(refs, x), **x))


def lambdag_max_similarity(spark, d):  # noqa: ANN001, ANN201
    """Known model against models of sentences like the known ones: of the 30 nearest of other authors for each known sentence one a repetition, no text twice.

    Sentence vectors are hashed words; an embedding column takes their place. A problem whose known sentences cannot all have a text of their own has a null score.
    """
    x = _inputs(spark, d)
    refs = S.similar_sentences(x["problems"], x["known"].withColumn("vector", X.hashed_vector(F.col("tokens"))), REPS, REPS, strict=False)
    scores = _rounded(S.run_method("lambdag", reps=REPS, order=ORDER, refs=_with_tokens(refs, x), **x))
    return x["problems"].select("problem_id").join(scores, "problem_id", "left")


def lambdag_divergences(spark, d):  # noqa: ANN001, ANN201
    """Unigram divergences (Jensen-Shannon, Renyi, Hellinger) from impostor documents minus those from the known one."""
    x = _inputs(spark, d)
    return _rounded(S.run_method("divergence_scores", ref_docs=_impostors(x, REPS).select("problem_id", F.col("place").alias("rep"), "ref_id"), **x))


def _scores(x):  # noqa: ANN001, ANN202
    both = x["known"].withColumn("side", F.lit("k")).unionByName(x["unknown"].withColumn("side", F.lit("u")))
    lp = cut(S.unigram_log_probs(both.select(F.concat_ws(":", "side", "doc_id").alias("doc_id"), "sent_id", "tokens")))
    part = lambda s: lp.where(F.col("doc_id").startswith(s)).withColumn("doc_id", F.expr("substring(doc_id, 3)"))
    return {"problems": x["problems"], "known_scores": part("k:"), "unknown_scores": part("u:")}


def sentence_scores(spark, d):  # noqa: ANN001, ANN201
    s = _scores(_inputs(spark, d))["unknown_scores"]
    return s.select("doc_id", "sent_id", "n", B.r6("sum_lp").alias("sum_lp"), B.r6("perplexity").alias("perplexity"))


def lambdag_no_ref(spark, d):  # noqa: ANN001, ANN201
    x = _inputs(spark, d)
    return _rounded(S.run_method("no_reference", unknown_scores=_scores(x)["unknown_scores"], order=ORDER, **x))


def lambdag_perplexity_rank(spark, d):  # noqa: ANN001, ANN201
    x = _inputs(spark, d)
    y = _scores(x)
    refs = B.reference_sentences(x["problems"], x["known"], REPS).join(y["known_scores"].select("sent_id", "perplexity"), "sent_id")
    return _rounded(S.run_method("perplexity_rank", refs=refs, reps=REPS, **y))


def impostors_rank(spark, d):  # noqa: ANN001, ANN201
    x = _inputs(spark, d)
    refs = _impostors(x, REPS, TRIALS).select("problem_id", F.col("trial").alias("rep"), "ref_id")
    return _rounded(S.run_method("impostors", ref_docs=refs, **_scores(x)))


def distribution_emd(spark, d):  # noqa: ANN001, ANN201
    return _rounded(S.run_method("distribution_distance", reps=REPS, **_scores(_inputs(spark, d))))


def impostors_emd(spark, d):  # noqa: ANN001, ANN201
    """Five tests of a hundred draws of half of the corpus's other documents."""
    x = _inputs(spark, d)
    return _rounded(S.run_method("impostor_distances", pool=_docs(x["known"]), **_scores(x)))


def verification_llr(spark, d):  # noqa: ANN001, ANN201
    """Mean log-probability of the known document and of the unknown one, each less the mean of a hundred impostor documents, drawn again where there are fewer."""
    x = _inputs(spark, d)
    refs = B.reference_docs(x["problems"], _docs(x["known"]), 1, 100, replace=True)
    return _rounded(S.run_method("verification", ref_docs=refs, **_scores(x)))


def cosine_topk(spark, d):  # noqa: ANN001, ANN201
    """The five nearest vectors of every twentieth vector among all."""
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    n = S.nearest(q, e.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector")), 5)
    return n.select("query_id", "item_id", F.col("rank").cast("int").alias("rank"), F.round("similarity", 5).alias("similarity"))


QUERIES = {f.__name__: f for f in (
    lambdag, lambdag_v2, lambdag_surprisal, lambdag_entropy, lambdag_paraphrase, lambdag_paraphrase_v2, lambdag_max_similarity, lambdag_divergences, sentence_scores, lambdag_no_ref, lambdag_perplexity_rank, impostors_rank,
    distribution_emd, impostors_emd, verification_llr, cosine_topk,
)}

# SQL ------------------------------------------------------------------------------------------------------------------

_BASE = ("known", "unknown_chunks", "known_rows", "ks", "us", "samples")
_FLOOR = "2.2250738585072014e-308"
#: Tokens as numbers: 1 is the end mark; the start mark is no 0, whose hash is 0.
_START = 9_000_000_001
_CODED = """vocab AS MATERIALIZED (SELECT token, row_number() OVER () + 1 AS id FROM (SELECT DISTINCT unnest(tokens) AS token FROM (SELECT tokens FROM ks UNION ALL SELECT tokens FROM us))),
    ki AS MATERIALIZED (SELECT sent_id, any_value(doc_id) AS doc_id, list(id ORDER BY k) AS ids FROM (SELECT sent_id, doc_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS k FROM ks) JOIN vocab USING (token) GROUP BY sent_id),
    ui AS MATERIALIZED (SELECT sent_id, any_value(doc_id) AS doc_id, list(id ORDER BY k) AS ids FROM (SELECT sent_id, doc_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS k FROM us) JOIN vocab USING (token) GROUP BY sent_id)"""


def _ratio_ctes(refs: str, order: int = ORDER, discount: float = 0.75, full: bool = False) -> str:
    """CTEs down to ``ratio`` (problem_id, rep, a, b) from ``refs`` (problem_id, rep, sent_id). Grams are hashes of token numbers; model 0 of a problem is that of its known document."""
    d, pads = f"{discount}::DOUBLE", [_START] * (order - 1)
    more = ", hash(list_slice(p, i + 1, i + n - 1)) AS s, hash(list_slice(p, i + 1, i + n - 2)) AS mid" if full else ", CASE WHEN n = 2 THEN hash([p[i + 1]]) END AS s"
    grams = f"""src AS (SELECT problem_id * 100 + rep AS m, ids FROM refs JOIN ki USING (sent_id) UNION ALL SELECT problem_id * 100, ids FROM samples JOIN ki ON ki.doc_id = known_id),
    pad AS (SELECT m, list_concat(list_concat({pads}, ids), [1]) AS p FROM src),
    g AS MATERIALIZED (SELECT m, n, g, any_value(c) AS c, any_value(s) AS s{', any_value(mid) AS mid' if full else ''}, count(*) AS cnt FROM (
        SELECT m, n, hash(list_slice(p, i, i + n - 1)) AS g, hash(list_slice(p, i, i + n - 2)) AS c{more} FROM (SELECT m, p, n, unnest(range(1, len(p) - n + 2)) AS i FROM pad, range(1, {order + 1}) AS r(n))) GROUP BY m, n, g),
    ctx AS MATERIALIZED (SELECT m, c, sum(cnt) AS ctx, count(*) AS suc FROM g WHERE n > 1 GROUP BY m, c),
    uni AS (SELECT m, s AS g, count(*) AS pre FROM g WHERE n = 2 GROUP BY m, s), tot AS (SELECT m, count(*) FILTER (n = 2) AS bi, count(*) FILTER (n = 1) AS words FROM g GROUP BY m),
    ask_s AS (SELECT problem_id, ui.sent_id, list_concat(list_concat({pads}, ids), [1]) AS p FROM samples JOIN ui ON ui.doc_id = unknown_id),
    ask AS MATERIALIZED (SELECT row_number() OVER () AS q, problem_id, p[i] AS word, list_transform(range(1, {order + 1}), lambda k: hash(list_slice(p, i - k + 1, i))) AS gs, list_transform(range(1, {order + 1}), lambda k: hash(list_slice(p, i - k + 1, i - 1))) AS cs
        FROM (SELECT *, unnest(range({order}, len(p) + 1)) AS i FROM ask_s)),
    models AS (SELECT DISTINCT m, m // 100 AS problem_id FROM src),
    want AS MATERIALIZED (SELECT m, q, unnest(range(1, {order + 1})) AS n, unnest(gs) AS g, unnest(cs) AS c FROM ask JOIN models USING (problem_id))"""
    pick = lambda col, n: f"max({col}) FILTER (n = {n})"
    if not full:
        flat = f"""hits AS MATERIALIZED (SELECT want.m, q, max(uni.pre) FILTER (n = 1) AS pre, {', '.join(f"{pick('cnt', n)} AS c{n}, {pick('ctx', n)} AS x{n}, {pick('suc', n)} AS f{n}" for n in range(2, order + 1))}
        FROM want LEFT JOIN (SELECT m, g, cnt FROM g) USING (m, g) LEFT JOIN ctx USING (m, c) LEFT JOIN uni USING (m, g) GROUP BY want.m, q)"""
        e = "coalesce(pre / nullif(bi, 0), 0)"
        steps = [f"p1 AS (SELECT *, {e} AS p FROM hits JOIN tot USING (m))"]
        for n in range(2, order + 1):
            steps.append(f"p{n} AS (SELECT * EXCLUDE p, CASE WHEN x{n} > 0 THEN greatest(coalesce(c{n}, 0) - {d}, 0) / x{n} + {d} * f{n} / x{n} * p ELSE p END AS p FROM p{n - 1})")
    else:
        flat = f"""prel AS MATERIALIZED (SELECT m, s AS g, count(*) AS pre FROM g WHERE n > 1 GROUP BY m, s), around AS MATERIALIZED (SELECT m, mid AS c, count(*) AS mid FROM g WHERE n > 2 GROUP BY m, mid), seen AS (SELECT m, g AS c, cnt AS seen FROM g),
        hits AS MATERIALIZED (SELECT want.m, q, {', '.join(f"{pick('pre', n)} AS e{n}, {pick('cnt', n)} AS c{n}, {pick('suc', n)} AS f{n}, {pick('mid', n)} AS r{n}, {pick('seen', n)} AS x{n}" for n in range(1, order + 1))}
        FROM want LEFT JOIN (SELECT m, g, cnt FROM g) USING (m, g) LEFT JOIN prel USING (m, g) LEFT JOIN ctx USING (m, c) LEFT JOIN around USING (m, c) LEFT JOIN seen USING (m, c) GROUP BY want.m, q)"""
        steps = [f"p1 AS (SELECT *, CASE WHEN bi > 0 THEN greatest(coalesce(e1, 0) - {d}, 0) / bi + {d} * words / bi / (words + 1) ELSE 1.0::DOUBLE / (words + 1) END AS p FROM hits JOIN tot USING (m))"]
        for n in range(2, order):
            steps.append(f"p{n} AS (SELECT * EXCLUDE p, CASE WHEN x{n} > 0 AND r{n} > 0 THEN greatest(coalesce(e{n}, 0) - {d}, 0) / r{n} + {d} * coalesce(f{n}, 0) / r{n} * p ELSE p END AS p FROM p{n - 1})")
        steps.append(f"p{order} AS (SELECT * EXCLUDE p, CASE WHEN x{order} > 0 THEN greatest(coalesce(c{order}, 0) - {d}, 0) / x{order} + {d} * coalesce(f{order}, 0) / x{order} * p ELSE p END AS p FROM p{order - 1})")
    ratio = f"""pp AS MATERIALIZED (SELECT m, q, CASE WHEN p > 0 THEN p ELSE {_FLOOR} END AS p FROM p{order}),
    ratio AS (SELECT b.m // 100 AS problem_id, b.m % 100 AS rep, a.p AS a, b.p AS b FROM pp b JOIN pp a ON a.q = b.q AND a.m = b.m - b.m % 100 WHERE b.m % 100 > 0)"""
    return ",\n".join([_CODED, refs, grams, flat, *steps, ratio])


_LG = f"SELECT problem_id, round(sum(log10(a) - log10(b)) / {REPS}, 6) + 0.0 AS score FROM ratio GROUP BY problem_id"
_SENT = B.ref_sentences_sql(REPS)
_DOCREFS = B.ref_docs_sql(1, REPS) + ",\nrefs AS MATERIALIZED (SELECT problem_id, CAST(place AS INTEGER) AS rep, sent_id FROM ref_docs JOIN ks ON ks.doc_id = ref_id)"
_LP = """tk AS (SELECT 'k' AS side, doc_id, sent_id, unnest(tokens) AS token FROM ks UNION ALL SELECT 'u', doc_id, sent_id, unnest(tokens) FROM us),
    fr AS (SELECT token, ln(count(*) / (SELECT count(*) FROM tk)) AS lp FROM tk GROUP BY token),
    sc AS MATERIALIZED (SELECT side, doc_id, sent_id, count(*) AS n, round(sum(lp), 12) AS sum_lp, round(avg(lp), 12) AS avg_lp, exp(-round(avg(lp), 12)) AS perplexity FROM tk JOIN fr USING (token) GROUP BY ALL),
    dm AS MATERIALIZED (SELECT side, doc_id, round(sum(sum_lp) / sum(n), 12) AS m FROM sc GROUP BY ALL)"""


def _emd(name: str, source: str, key: str) -> str:
    """CTE of distances from ``source`` (key, side k or u, value)."""
    return f"""{name}_n AS (SELECT {key}, side, value / sum(value) OVER w AS x, 1.0::DOUBLE / count(*) OVER w AS f FROM {source} WINDOW w AS (PARTITION BY {key}, side)),
    {name}_s AS (SELECT {key}, x, sum(CASE WHEN side = 'k' THEN f ELSE -f END) AS step FROM {name}_n GROUP BY ALL),
    {name} AS MATERIALIZED (SELECT {key}, round(coalesce(sum(abs(d) * gap), 0), 12) AS emd FROM (SELECT {key}, sum(step) OVER w AS d, lead(x) OVER w - x AS gap FROM {name}_s WINDOW w AS (PARTITION BY {key} ORDER BY x)) GROUP BY {key})"""


_W = B.with_
SQL = {
    "lambdag": _W(*_BASE, _ratio_ctes(_SENT)) + _LG,
    "lambdag_v2": _W(*_BASE, _ratio_ctes(_SENT, discount=0.5, full=True)) + _LG,
    "lambdag_surprisal": _W(*_BASE, _ratio_ctes(_SENT)) + "SELECT problem_id, round(avg(CASE WHEN a > b THEN 1.0 ELSE 0.0 END), 6) AS score FROM ratio GROUP BY problem_id",
    "lambdag_entropy": _W(*_BASE, _ratio_ctes(_SENT), "h AS (SELECT m, -sum(cnt / t * log2(cnt / t)) AS h FROM (SELECT m, cnt, sum(cnt) OVER (PARTITION BY m) AS t FROM g WHERE n = 1) GROUP BY m)", "lr AS (SELECT problem_id, rep, sum(log10(a) - log10(b)) AS lr FROM ratio GROUP BY ALL)")
        + f"SELECT problem_id, round(sum(lr * hr.h / (hk.h + 1e-12)) / {REPS}, 6) + 0.0 AS score FROM lr JOIN h hr ON hr.m = problem_id * 100 + rep JOIN h hk ON hk.m = problem_id * 100 GROUP BY problem_id",
    "lambdag_paraphrase": _W(*_BASE, _ratio_ctes(_DOCREFS)) + _LG,
    "lambdag_paraphrase_v2": _W(*_BASE, _ratio_ctes(B.pooled_sql(REPS, REPS))) + _LG,
    "lambdag_divergences": _W(*_BASE, B.ref_docs_sql(1, REPS), """c AS (SELECT 'u:' || doc_id AS id, token, count(*) AS n FROM (SELECT doc_id, unnest(tokens) AS token FROM us) GROUP BY ALL UNION ALL SELECT 'k:' || doc_id, token, count(*) FROM (SELECT doc_id, unnest(tokens) AS token FROM ks) GROUP BY ALL),
        p AS MATERIALIZED (SELECT id, token, n / sum(n) OVER (PARTITION BY id) AS p FROM c),
        nm AS (SELECT problem_id, -1 AS rep, 'u:' || unknown_id AS l, 'k:' || known_id AS r FROM samples UNION ALL SELECT problem_id, place, 'u:' || unknown_id, 'k:' || ref_id FROM ref_docs JOIN samples USING (problem_id)),
        pr AS (SELECT DISTINCT l, r FROM nm WHERE l IN (SELECT id FROM p) OR r IN (SELECT id FROM p)),
        uv AS (SELECT l, r, token, sum(u) AS u, sum(v) AS v FROM (SELECT l, r, token, p AS u, 0 AS v FROM pr JOIN p ON id = l UNION ALL SELECT l, r, token, 0, p FROM pr JOIN p ON id = r) GROUP BY ALL),
        dv AS (SELECT l, r, sum(CASE WHEN u > 0 THEN u * log2(u / ((u + v) / 2)) ELSE 0 END + CASE WHEN v > 0 THEN v * log2(v / ((u + v) / 2)) ELSE 0 END) / 2 AS jsd,
            log2(greatest(sum(CASE WHEN u > 0 AND v > 0 THEN sqrt(u) * sqrt(v) ELSE 0 END), 2.2250738585072014e-308)) / -0.5 AS renyi, sqrt(greatest(1 - sum(CASE WHEN u > 0 AND v > 0 THEN sqrt(u * v) ELSE 0 END), 0)) AS hellinger FROM uv GROUP BY ALL)""")
        + "SELECT problem_id, " + ", ".join(f"round(avg(CASE WHEN rep >= 0 THEN {c} END) - max(CASE WHEN rep < 0 THEN {c} END), 6) + 0.0 AS {c}" for c in ("jsd", "renyi", "hellinger")) + " FROM nm JOIN dv USING (l, r) GROUP BY problem_id",
    "sentence_scores": _W(*_BASE, _LP) + "SELECT doc_id, sent_id, n, round(sum_lp, 6) + 0.0 AS sum_lp, round(perplexity, 6) AS perplexity FROM sc WHERE side = 'u'",
    "lambdag_no_ref": _W(*_BASE, _LP, _ratio_ctes("refs AS (SELECT 0::BIGINT AS problem_id, 0 AS rep, '' AS sent_id WHERE false)", discount=0.75, full=True))
        + "SELECT problem_id, round(pow(2, -avg(log2(p))) / any_value(pow(2, -dm.m)), 6) AS score FROM pp JOIN samples ON problem_id = pp.m // 100 JOIN dm ON dm.side = 'u' AND dm.doc_id = unknown_id GROUP BY problem_id",
    "lambdag_perplexity_rank": _W(*_BASE, _SENT, _LP, "kk AS (SELECT problem_id, perplexity AS kp, count(*) OVER (PARTITION BY problem_id) AS k FROM samples JOIN sc ON side = 'k' AND doc_id = known_id)",
        "uu AS (SELECT problem_id, sent_id, perplexity AS up FROM samples JOIN sc ON side = 'u' AND doc_id = unknown_id)",
        "rr AS (SELECT problem_id, rep, list(perplexity) AS rp FROM refs JOIN sc USING (sent_id) WHERE side = 'k' GROUP BY ALL)",
        f"ss AS (SELECT problem_id, sent_id, sum(1.0::DOUBLE / ((len(list_filter(rp, lambda x: abs(up - x) < abs(up - kp))) + 1) * {REPS} * k)) AS s FROM uu JOIN kk USING (problem_id) JOIN rr USING (problem_id) GROUP BY ALL)")
        + "SELECT problem_id, round(median(s), 6) AS score FROM ss GROUP BY problem_id",
    "impostors_rank": _W(*_BASE, B.ref_docs_sql(TRIALS, REPS), _LP, """x AS (SELECT problem_id, trial, (sum(CASE WHEN i.m - u.m > k.m - u.m THEN 1 ELSE 0 END) + 1) / (count(*) + 1) AS s FROM ref_docs JOIN samples USING (problem_id)
        JOIN dm i ON i.side = 'k' AND i.doc_id = ref_id JOIN dm k ON k.side = 'k' AND k.doc_id = known_id JOIN dm u ON u.side = 'u' AND u.doc_id = unknown_id GROUP BY ALL)""")
        + "SELECT problem_id, round(avg(s), 6) AS score FROM x GROUP BY problem_id",
    "distribution_emd": _W(*_BASE, _LP, """b AS (SELECT problem_id, side, sent_id, exp(avg_lp) AS value FROM samples JOIN sc ON (side = 'k' AND doc_id = known_id) OR (side = 'u' AND doc_id = unknown_id)),
        z AS (SELECT problem_id, least(count(*) FILTER (side = 'k'), count(*) FILTER (side = 'u')) AS size FROM b GROUP BY problem_id)""",
        f"dr AS (SELECT problem_id, rep, side, value FROM (SELECT *, row_number() OVER (PARTITION BY problem_id, rep, side ORDER BY md5('0|' || problem_id || '|' || rep || '|' || sent_id), sent_id) AS k FROM b JOIN z USING (problem_id), range(1, {REPS + 1}) AS t(rep)) WHERE k <= size)",
        "de AS (SELECT problem_id || '|' || rep AS run, side, value FROM dr)", _emd("em", "de", "run")) + "SELECT CAST(split_part(run, '|', 1) AS BIGINT) AS problem_id, round(avg(emd), 6) AS score FROM em GROUP BY ALL",
    "impostors_emd": _W(*_BASE, _LP, """kd AS (SELECT doc_id, any_value(author) AS author, any_value(corpus) AS corpus FROM ks GROUP BY doc_id),
        pp AS (SELECT DISTINCT unknown_id || '|' || o AS pair, unknown_id, o FROM (SELECT unknown_id, kd.doc_id AS o FROM samples JOIN kd USING (corpus) UNION ALL SELECT unknown_id, known_id FROM samples)),
        pv AS (SELECT pair, 'u' AS side, exp(avg_lp) AS value FROM pp JOIN sc ON side = 'u' AND doc_id = unknown_id UNION ALL SELECT pair, 'k', exp(avg_lp) FROM pp JOIN sc ON side = 'k' AND doc_id = o)""", _emd("em", "pv", "pair"),
        "ds AS MATERIALIZED (SELECT unknown_id, o, emd FROM pp JOIN em USING (pair) WHERE unknown_id IN (SELECT doc_id FROM us) AND o IN (SELECT doc_id FROM ks))",
        "mine AS (SELECT s.*, emd AS ku FROM samples s JOIN ds ON ds.unknown_id = s.unknown_id AND o = known_id)",
        """ot AS MATERIALIZED (SELECT problem_id, emd < ku AS nearer, row_number() OVER (PARTITION BY problem_id ORDER BY md5('0|' || o), o) - 1 AS pos, count(*) OVER (PARTITION BY problem_id) AS m FROM mine JOIN ds USING (unknown_id) JOIN kd ON kd.doc_id = o AND kd.corpus = mine.corpus
            WHERE author IS NULL OR ((known_author IS NULL OR author <> known_author) AND (unknown_author IS NULL OR author <> unknown_author)))""",
        "sz AS (SELECT DISTINCT problem_id, m, greatest(CAST(floor(m * 0.5::DOUBLE + 0.5) AS BIGINT), 1) AS k FROM ot)",
        "dw AS (SELECT problem_id, m, k, draw, ('0x' || substr(md5('0|' || problem_id || '|' || draw), 1, 15))::BIGINT % m AS s FROM sz, range(500) AS t(draw))",
        "nr AS (SELECT problem_id, pos FROM ot WHERE nearer)",
        "rk AS (SELECT dw.problem_id, draw, count(nr.pos) + 1 AS rank FROM dw LEFT JOIN nr ON nr.problem_id = dw.problem_id AND (nr.pos - s + m) % m < k GROUP BY ALL)",
        "ts AS (SELECT problem_id, CAST(draw // 100 + 1 AS INTEGER) AS test, sum(1.0 / rank) / 100 AS score FROM rk GROUP BY ALL)")
        + "SELECT problem_id, test, round(ku, 6) + 0.0 AS emd_known_unknown, round(coalesce(score, 0), 6) AS score FROM (SELECT problem_id, ku, CAST(r.test AS INTEGER) AS test FROM mine, range(1, 6) AS r(test)) t LEFT JOIN ts USING (problem_id, test)",
    "verification_llr": _W(*_BASE, B.ref_docs_sql(1, 100), _LP, "im AS (SELECT problem_id, avg(m) AS i FROM ref_docs JOIN dm ON side = 'k' AND doc_id = ref_id GROUP BY problem_id)")
        + "SELECT problem_id, round(k.m - i, 6) + 0.0 AS known_llr, round(u.m - i, 6) + 0.0 AS unknown_llr FROM samples JOIN im USING (problem_id) JOIN dm k ON k.side = 'k' AND k.doc_id = known_id JOIN dm u ON u.side = 'u' AND u.doc_id = unknown_id",
    "cosine_topk": """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), s AS (SELECT q.vec_id AS query_id, p.vec_id AS item_id, list_cosine_similarity(q.e, p.e) AS c FROM v q JOIN v p ON p.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0)
        SELECT query_id, item_id, CAST(k AS INTEGER) AS rank, round(c, 5) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, item_id) AS k FROM s) WHERE k <= 5""",
}
