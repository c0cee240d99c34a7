"""Queries on n-grams, shared n-grams and language models."""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphmill.functions import text as X
from glyphmill.operators import lm, ngrams as N
from glyphmill.plans import base as B
from glyphmill.session import cut, table

ORDER = 3


def token_counts(spark, d):  # noqa: ANN001, ANN201
    t = N.token_counts(B.known_sentences(spark, d).where("author is not null"), "author")
    return t.select("author", "token", "n", B.r6("p").alias("p"))


def ngram_counts(spark, d):  # noqa: ANN001, ANN201
    return N.ngram_counts(B.known_sentences(spark, d), "corpus", ORDER).withColumn("gram", F.replace("gram", F.lit("\u0001"), F.lit(" ")))


def continuation_counts(spark, d):  # noqa: ANN001, ANN201
    return N.continuation_counts(B.known_sentences(spark, d), "corpus")


def _pairs(spark, d):  # noqa: ANN001, ANN202
    return B.samples(spark, d).select(F.concat("known_id", F.lit("|"), "unknown_id").alias("pair_id"), F.concat(F.lit("k:"), "known_id").alias("doc_a"), F.concat(F.lit("u:"), "unknown_id").alias("doc_b")).distinct()


def _pair_tokens(spark, d):  # noqa: ANN001, ANN202
    side = lambda s, t: B.doc_tokens(t).select(F.concat(F.lit(s), "doc_id").alias("doc_id"), "tokens")
    return cut(side("k:", B.known_sentences(spark, d)).unionByName(side("u:", B.unknown_sentences(spark, d))))


def _common(spark, d):  # noqa: ANN001, ANN202
    return N.common_ngrams(_pairs(spark, d), _pair_tokens(spark, d), 2)


def common_ngrams(spark, d):  # noqa: ANN001, ANN201
    return _common(spark, d).withColumn("gram", F.replace("gram", F.lit("\u0001"), F.lit(" ")))


def largest_common_ngram(spark, d):  # noqa: ANN001, ANN201
    return N.highest_common(_common(spark, d))


def largest_common_ngram_files(spark, d):  # noqa: ANN001, ANN201
    """All pairs of unknown documents that share eight words in a row, with the longest run they share."""
    t = _pair_tokens(spark, d).where("doc_id like 'u:%'")
    return N.highest_common(N.common_ngrams(N.sharing_pairs(t, 8), t, 8))


def largest_common_ngram_profiles(spark, d):  # noqa: ANN001, ANN201
    """For each problem the longest run of words that all texts of its known author and all of its unknown author share."""
    chunk = F.regexp_extract("sent_id", "([0-9]+)$", 1).cast("int")
    texts = lambda s: s.select("author", "doc_id", chunk.alias("chunk"), "tokens")
    m = table(spark, d, "agg_metadata").where("known_author is not null and unknown_author is not null").select("problem", "known_author", "unknown_author").distinct()
    pairs = m.select(F.col("known_author").alias("left_id"), F.col("unknown_author").alias("right_id")).distinct().withColumn("pair_id", F.concat_ws("|", "left_id", "right_id"))
    best = N.largest_common_run_of_texts(pairs, texts(B.known_sentences(spark, d)), texts(B.unknown_sentences(spark, d)), "author", ["doc_id", "chunk"])
    return m.withColumn("pair_id", F.concat_ws("|", "known_author", "unknown_author")).join(best, "pair_id", "left").drop("pair_id").fillna(0, ["highest_common_count"])


def common_ngrams_readable(spark, d):  # noqa: ANN001, ANN201
    return N.readable(_common(spark, d))


def filter_ngrams(spark, d):  # noqa: ANN001, ANN201
    """Candidates whose token arrays, as given, hold more than one word."""
    p = table(spark, d, "paraphrases").where("tokens is not null").dropDuplicates(["cand_id"])
    return p.where(X.keeps_ngram(F.col("tokens"))).select("cand_id", F.size("tokens").alias("n"))


def phrase_occurrences(spark, d):  # noqa: ANN001, ANN201
    """Text before each occurrence of the shared n-gram of greatest length in the unknown document."""
    text = B.doc_tokens(B.unknown_sentences(spark, d)).select(F.concat(F.lit("u:"), "doc_id").alias("doc_b"), F.array_join("tokens", " ").alias("text"))
    best = largest_common_ngram(spark, d).join(_pairs(spark, d), "pair_id").join(text, "doc_b")
    pre = best.select("pair_id", "ngram", F.posexplode(X.occurrence_prefixes(F.col("text"), F.col("ngram"))).alias("k", "before"))
    return pre.select("pair_id", "ngram", (F.col("k") + 1).alias("occurrence"), F.length("before").alias("start"))


def phrase_spans(spark, d):  # noqa: ANN001, ANN201
    """Places of the longest shared n-gram in the known document and the document with each of them masked by one mark."""
    toks = _pair_tokens(spark, d).withColumnRenamed("doc_id", "doc_a")
    best = largest_common_ngram(spark, d).join(_pairs(spark, d), "pair_id").join(toks, "doc_a")
    phrase = F.split("ngram", " ")
    spans = best.select("pair_id", "tokens", phrase.alias("phrase"), F.explode(X.find_spans(F.col("tokens"), phrase)).alias("start"))
    masked = X.masked_single(F.col("tokens"), F.col("start"), F.size("phrase"), "[MASK]")
    return spans.select("pair_id", "start", F.md5(F.array_join(masked, " ")).alias("masked"), F.md5(F.array_join(X.masked_each(F.col("tokens"), F.col("start"), F.size("phrase"), "[MASK]"), " ")).alias("masked_each"))


def coverage_runs(spark, d):  # noqa: ANN001, ANN201
    """How the spans of all shared n-grams cover the tokens of the known document of each pair."""
    toks = _pair_tokens(spark, d).withColumnRenamed("doc_id", "doc_a")
    grams = _common(spark, d).join(_pairs(spark, d), "pair_id").join(toks, "doc_a")
    phrase = F.split("gram", "\u0001")
    spans = grams.select("pair_id", F.size(phrase).alias("n"), F.explode(X.find_spans(F.col("tokens"), phrase)).alias("start")).select("pair_id", "start", (F.col("start") + F.col("n")).alias("end")).distinct()
    text = _pairs(spark, d).join(toks, "doc_a").select("pair_id", F.size("tokens").alias("length"))
    return N.coverage_runs(text, spans, "pair_id")


def _author_model(spark, d):  # noqa: ANN001, ANN202
    s = B.known_sentences(spark, d).where("author is not null")
    return lm.train(s.select(F.col("author").alias("model_id"), "tokens"), "model_id", ORDER)


def _asked_authors(spark, d):  # noqa: ANN001, ANN202
    return B.unknown_sentences(spark, d).where("author is not null").select(F.col("author").alias("model_id"), "sent_id", "tokens")


def skn_probs(spark, d):  # noqa: ANN001, ANN201
    """Each unknown sentence under the model of its own author's known texts."""
    p = lm.simplified_kn(_author_model(spark, d), _asked_authors(spark, d), ["model_id", "sent_id"], ORDER, 0.75)
    return p.select("model_id", "sent_id", "pos", "token", B.r6("p").alias("p"))


def fkn_probs(spark, d):  # noqa: ANN001, ANN201
    p = lm.full_kn(_author_model(spark, d), _asked_authors(spark, d), ["model_id", "sent_id"], ORDER, 0.5)
    return p.select("model_id", "sent_id", "pos", "token", B.r6("p").alias("p"))


def lm_perplexity(spark, d):  # noqa: ANN001, ANN201
    p = lm.full_kn(_author_model(spark, d), _asked_authors(spark, d), ["model_id", "sent_id"], ORDER, 0.5)
    return lm.perplexity(p, ["model_id", "sent_id"]).select("model_id", "sent_id", "n", B.r6("perplexity").alias("perplexity"))


def next_words(spark, d):  # noqa: ANN001, ANN201
    """Likeliest words after each word that the corpus has at least once, by corpus."""
    stats = lm.train(B.known_sentences(spark, d).select(F.col("corpus").alias("model_id"), "tokens"), "model_id", 2)
    contexts = stats.where("len = 1 and ctx > 0").select("model_id", F.col("gram").alias("context"))
    return lm.next_words(stats, contexts, 3).select("model_id", "context", "word", B.r6("p").alias("p"), "rank")


def kn_generate(spark, d):  # noqa: ANN001, ANN201
    """A sentence of each corpus by the full model, cut off at 12 words."""
    stats = cut(lm.train(B.known_sentences(spark, d).select(F.col("corpus").alias("model_id"), "tokens"), "model_id", ORDER))
    return lm.generate(stats, stats.select("model_id").distinct(), 12, order=ORDER)


QUERIES = {f.__name__: f for f in (
    token_counts, ngram_counts, continuation_counts, common_ngrams, largest_common_ngram, largest_common_ngram_files, largest_common_ngram_profiles, common_ngrams_readable, filter_ngrams, phrase_occurrences, phrase_spans, coverage_runs, skn_probs, fkn_probs,
    lm_perplexity, next_words, kn_generate,
)}

# SQL ------------------------------------------------------------------------------------------------------------------


def grams_sql(name: str, source: str, key: str, order: int) -> str:
    """CTEs: padded sentences of ``source`` (key, tokens) and counts of their grams for n = 1..order (tokens as lists)."""
    parts = " UNION ALL ".join(
        f"SELECT {key}, {n} AS n, unnest(list_transform(range(1, len(p) - {n} + 2), lambda i: list_slice(p, i, i + {n} - 1))) AS g FROM {name}_p" for n in range(1, order + 1)
    )
    return f"""{name}_p AS (SELECT {key}, list_concat(list_concat({['<s>'] * (order - 1)}, tokens), ['</s>']) AS p FROM {source}),
    {name} AS (SELECT {key}, n, g, count(*) AS c FROM ({parts}) GROUP BY ALL)"""


def model_sql(name: str, source: str, order: int) -> str:
    """CTEs of a model's tables from ``source`` (model_id, tokens)."""
    return f"""{grams_sql(name, source, 'model_id', order)},
    {name}_cnt AS (SELECT model_id, g, c FROM {name}),
    {name}_pre AS (SELECT model_id, list_slice(g, 2, n) AS g, count(*) AS pre FROM {name} GROUP BY ALL),
    {name}_suc AS (SELECT model_id, list_slice(g, 1, n - 1) AS g, count(*) AS suc, sum(c) AS ctx FROM {name} GROUP BY ALL),
    {name}_mid AS (SELECT model_id, list_slice(g, 2, n - 1) AS g, count(*) AS mid FROM {name} WHERE n >= 2 GROUP BY ALL)"""


def positions_sql(name: str, source: str, keys: str, order: int) -> str:
    """CTE of the query positions of ``source`` (keys, tokens) with the last ``order`` tokens ``h`` at each."""
    return f"""{name}_p AS (SELECT {keys}, list_concat(list_concat({['<s>'] * (order - 1)}, tokens), ['</s>']) AS p FROM {source}),
    {name} AS (SELECT {keys}, pos, list_slice(p, pos + 1, pos + {order}) AS h, p[pos + {order}] AS token FROM (SELECT *, unnest(range(0, len(p) - {order} + 1)) AS pos FROM {name}_p))"""


def skn_sql(name: str, model: str, queries: str, keys: str, order: int, discount: float) -> str:
    joins, p = "", "coalesce(u.pre / nullif(b.mid, 0), 0)"
    for n in range(2, order + 1):
        joins += f""" LEFT JOIN {model}_cnt c{n} ON c{n}.model_id = q.model_id AND c{n}.g = list_slice(q.h, {order - n + 1}, {order})
            LEFT JOIN {model}_suc s{n} ON s{n}.model_id = q.model_id AND s{n}.g = list_slice(q.h, {order - n + 1}, {order - 1})"""
        p = f"CASE WHEN s{n}.ctx > 0 THEN greatest(coalesce(c{n}.c, 0) - {discount}::DOUBLE, 0) / s{n}.ctx + {discount}::DOUBLE * s{n}.suc / s{n}.ctx * ({p}) ELSE {p} END"
    return f"""{name} AS (SELECT {', '.join('q.' + k.strip() for k in keys.split(','))}, q.pos, q.token, {p} AS p FROM {queries} q
        LEFT JOIN {model}_pre u ON u.model_id = q.model_id AND u.g = [q.token]
        LEFT JOIN {model}_mid b ON b.model_id = q.model_id AND b.g = [] {joins})"""


def fkn_sql(name: str, model: str, queries: str, keys: str, order: int, discount: float) -> str:
    D = f"{discount}::DOUBLE"
    joins = f"""LEFT JOIN {model}_mid m0 ON m0.model_id = q.model_id AND m0.g = [] LEFT JOIN {model}_suc s0 ON s0.model_id = q.model_id AND s0.g = []
        LEFT JOIN {model}_pre p1 ON p1.model_id = q.model_id AND p1.g = [q.token]"""
    star = f"CASE WHEN m0.mid > 0 THEN greatest(coalesce(p1.pre, 0) - {D}, 0) / m0.mid + {D} * s0.suc / m0.mid / (s0.suc + 1) ELSE 1.0 / (coalesce(s0.suc, 0) + 1) END"
    for k in range(1, order):
        ctx, gram = f"list_slice(q.h, {order - k}, {order - 1})", f"list_slice(q.h, {order - k}, {order})"
        joins += f""" LEFT JOIN {model}_cnt n{k} ON n{k}.model_id = q.model_id AND n{k}.g = {ctx} LEFT JOIN {model}_suc s{k} ON s{k}.model_id = q.model_id AND s{k}.g = {ctx}"""
        if k < order - 1:
            joins += f" LEFT JOIN {model}_mid m{k} ON m{k}.model_id = q.model_id AND m{k}.g = {ctx} LEFT JOIN {model}_pre p{k + 1} ON p{k + 1}.model_id = q.model_id AND p{k + 1}.g = {gram}"
            star = f"CASE WHEN n{k}.c > 0 AND m{k}.mid > 0 THEN greatest(coalesce(p{k + 1}.pre, 0) - {D}, 0) / m{k}.mid + {D} * coalesce(s{k}.suc, 0) / m{k}.mid * ({star}) ELSE {star} END"
        else:
            joins += f" LEFT JOIN {model}_cnt t ON t.model_id = q.model_id AND t.g = {gram}"
            star = f"CASE WHEN n{k}.c > 0 THEN greatest(coalesce(t.c, 0) - {D}, 0) / n{k}.c + {D} * coalesce(s{k}.suc, 0) / n{k}.c * ({star}) ELSE {star} END"
    return f"{name} AS (SELECT {', '.join('q.' + k.strip() for k in keys.split(','))}, q.pos, q.token, {star} AS p FROM {queries} q {joins})"


_DOCS = """ud AS (SELECT 'u:' || doc_id AS doc_id, flatten(list(tokens ORDER BY chunk_id)) AS tokens FROM us GROUP BY doc_id),
    kd AS (SELECT 'k:' || doc_id AS doc_id, flatten(list(tokens ORDER BY chunk_id)) AS tokens FROM ks GROUP BY doc_id),
    toks AS (SELECT * FROM ud UNION ALL SELECT * FROM kd),
    pairs AS (SELECT DISTINCT known_id || '|' || unknown_id AS pair_id, 'k:' || known_id AS doc_a, 'u:' || unknown_id AS doc_b FROM samples)"""
_COMMON = _DOCS + """,
    g AS (SELECT doc_id, unnest(range(0, len(tokens) - 1)) AS i, unnest(list_transform(range(1, len(tokens)), lambda i: tokens[i] || ' ' || tokens[i + 1])) AS gram FROM toks WHERE len(tokens) > 1),
    hits AS (SELECT pair_id, doc_a, a.i, a.i - b.i AS diag FROM pairs JOIN g a ON a.doc_id = doc_a JOIN g b ON b.doc_id = doc_b AND b.gram = a.gram),
    runs AS (SELECT pair_id, doc_a, min(i) AS start, count(*) + 1 AS n FROM (SELECT *, i - row_number() OVER (PARTITION BY pair_id, diag ORDER BY i) AS island FROM hits) GROUP BY pair_id, doc_a, diag, island),
    found AS (SELECT DISTINCT pair_id, CAST(n AS INTEGER) AS n, array_to_string(list_slice(tokens, start + 1, start + n), ' ') AS gram FROM runs JOIN toks ON doc_id = doc_a),
    common AS (SELECT * FROM found f WHERE NOT EXISTS (SELECT 1 FROM found l WHERE l.pair_id = f.pair_id AND l.n > f.n AND contains(' ' || l.gram || ' ', ' ' || f.gram || ' '))),
    best AS (SELECT pair_id, max(n) AS highest_common_count FROM common GROUP BY pair_id),
    tops AS (SELECT pair_id, highest_common_count, array_to_string(min(string_split(gram, ' ')), ' ') AS ngram FROM common JOIN best USING (pair_id) WHERE n = highest_common_count GROUP BY ALL)"""
_FILES = """,
    g8 AS MATERIALIZED (SELECT doc_id, i, list_slice(tokens, i + 1, i + 8) AS g FROM (SELECT *, unnest(range(0, len(tokens) - 7)) AS i FROM ud WHERE len(tokens) >= 8)),
    h8 AS (SELECT a.doc_id AS x, b.doc_id AS y, a.i, a.i - b.i AS diag FROM g8 a JOIN g8 b ON a.g = b.g AND a.doc_id < b.doc_id),
    r8 AS (SELECT x, y, min(i) AS start, count(*) + 7 AS n FROM (SELECT *, i - row_number() OVER (PARTITION BY x, y, diag ORDER BY i) AS island FROM h8) GROUP BY x, y, diag, island),
    m8 AS (SELECT x, y, max(n) AS n FROM r8 GROUP BY x, y)"""
_PROFILES = """m AS (SELECT DISTINCT problem, known_author, unknown_author FROM agg_metadata WHERE known_author IS NOT NULL AND unknown_author IS NOT NULL),
    pr AS (SELECT DISTINCT known_author AS x, unknown_author AS y FROM m),
    kp AS MATERIALIZED (SELECT author, flatten(list(tokens ORDER BY doc_id, chunk_id)) AS t FROM ks WHERE author IS NOT NULL GROUP BY author), up AS MATERIALIZED (SELECT author, flatten(list(tokens ORDER BY doc_id, chunk_id)) AS t FROM us WHERE author IS NOT NULL GROUP BY author),
    kg AS MATERIALIZED (SELECT DISTINCT author, n, list_slice(t, i, i + n - 1) AS g FROM (SELECT author, t, n, unnest(range(1, len(t) - n + 2)) AS i FROM kp, range(2, 9) AS r(n) WHERE len(t) >= n)),
    ug AS MATERIALIZED (SELECT DISTINCT author, n, list_slice(t, i, i + n - 1) AS g FROM (SELECT author, t, n, unnest(range(1, len(t) - n + 2)) AS i FROM up, range(2, 9) AS r(n) WHERE len(t) >= n)),
    sh AS MATERIALIZED (SELECT x, y, u.n AS n, min(u.g) AS g FROM pr JOIN ug u ON u.author = y JOIN kg k ON k.author = x AND k.n = u.n AND k.g = u.g GROUP BY x, y, u.n),
    k8 AS (SELECT author, i, list_slice(t, i, i + 7) AS g FROM (SELECT author, t, unnest(range(1, len(t) - 6)) AS i FROM kp WHERE len(t) >= 8)), u8 AS (SELECT author, i, list_slice(t, i, i + 7) AS g FROM (SELECT author, t, unnest(range(1, len(t) - 6)) AS i FROM up WHERE len(t) >= 8)),
    hi AS (SELECT x, y, u.i, u.i - k.i AS diag FROM pr JOIN u8 u ON u.author = y JOIN k8 k ON k.author = x AND k.g = u.g),
    ru AS MATERIALIZED (SELECT x, y, min(i) AS s, count(*) + 7 AS n FROM (SELECT *, i - row_number() OVER (PARTITION BY x, y, diag ORDER BY i) AS island FROM hi) GROUP BY x, y, diag, island),
    lg AS (SELECT x, y, n, min(list_slice(t, s, s + n - 1)) AS g FROM (SELECT *, max(n) OVER (PARTITION BY x, y) AS top FROM ru) JOIN up ON author = y WHERE n = top GROUP BY x, y, n),
    be AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY n DESC) AS k FROM (SELECT x, y, n, g FROM sh UNION ALL SELECT x, y, n, g FROM lg)) WHERE k = 1)"""
_BASE = ("known", "unknown_chunks", "known_rows", "ks", "us", "samples")
_SPANS = "list_filter(range(0, len(tokens) - len(ph) + 1), lambda i: list_slice(tokens, i + 1, i + len(ph)) = ph)"
_AUTHOR_MODEL = "src AS (SELECT author AS model_id, tokens FROM ks WHERE author IS NOT NULL),\n" + model_sql("m", "src", ORDER) + ",\nasked AS (SELECT author AS model_id, sent_id, tokens FROM us WHERE author IS NOT NULL),\n" + positions_sql("q", "asked", "model_id, sent_id", ORDER)
_W = B.with_
_KS = ("known", "known_rows", "ks")
_LM = ("known", "unknown_chunks", "known_rows", "ks", "us", _AUTHOR_MODEL)
_PUNCT = r"""[!"#$%&''()*+,\-./:;<=>?@\[\\\]^_`{|}~]"""
SQL = {
    "token_counts": _W(*_KS, "t AS (SELECT author, unnest(tokens) AS token FROM ks WHERE author IS NOT NULL)") + "SELECT author, token, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY author), 6) AS p FROM t GROUP BY author, token",
    "ngram_counts": _W(*_KS, grams_sql("m", "ks", "corpus", ORDER)) + "SELECT corpus, CAST(n AS INTEGER) AS n, array_to_string(g, ' ') AS gram, c AS count FROM m",
    "continuation_counts": _W(*_KS, grams_sql("m", "ks", "corpus", 2), "w AS (SELECT corpus, g[2] AS word, count(*) AS left_contexts FROM m WHERE n = 2 GROUP BY ALL)")
        + "SELECT corpus, word, left_contexts, CAST(sum(left_contexts) OVER (PARTITION BY corpus) AS BIGINT) AS distinct_bigrams FROM w",
    "common_ngrams": _W(*_BASE, _COMMON) + "SELECT pair_id, n, gram FROM common",
    "largest_common_ngram": _W(*_BASE, _COMMON) + "SELECT pair_id, highest_common_count, ngram FROM tops",
    "largest_common_ngram_files": _W(*_BASE, _DOCS + _FILES) + "SELECT x || '|' || y AS pair_id, CAST(n AS INTEGER) AS highest_common_count, array_to_string(min(list_slice(tokens, start + 1, start + n)), ' ') AS ngram FROM m8 JOIN r8 USING (x, y, n) JOIN ud ON doc_id = x GROUP BY x, y, n",
    "largest_common_ngram_profiles": _W("known", "unknown_chunks", "known_rows", "ks", "us", _PROFILES) + "SELECT problem, known_author, unknown_author, CAST(coalesce(n, 0) AS INTEGER) AS highest_common_count, array_to_string(g, ' ') AS ngram FROM m LEFT JOIN be ON x = known_author AND y = unknown_author",
    "common_ngrams_readable": _W(*_BASE, _COMMON, "z AS (SELECT *, count(*) OVER (PARTITION BY pair_id, n) AS c FROM common)")
        + "SELECT pair_id, CAST(row_number() OVER (PARTITION BY pair_id ORDER BY c DESC, n, string_split(gram, ' ')) AS INTEGER) AS place, n, gram AS pretty, '(' || chr(39) || array_to_string(string_split(gram, ' '), chr(39) || ', ' || chr(39)) || chr(39) || ')' AS raw FROM z",
    "filter_ngrams": f"""WITH p AS (SELECT cand_id, any_value(tokens) AS tokens FROM paraphrases WHERE tokens IS NOT NULL GROUP BY cand_id),
        w AS (SELECT *, len(list_filter(tokens, lambda t: NOT regexp_full_match(replace(replace(t, 'Ġ', ''), 'Ċ', ''), '{_PUNCT}*'))) AS words FROM p)
        SELECT cand_id, CAST(len(tokens) AS INTEGER) AS n FROM w WHERE len(tokens) >= 2 AND words > 1 AND len(list_filter(list_slice(tokens, 2, len(tokens)), lambda t: starts_with(t, 'Ġ') OR starts_with(t, '▁'))) > 0""",
    "phrase_occurrences": _W(*_BASE, _COMMON, """o AS (SELECT pair_id, ngram, string_split(array_to_string(tokens, ' '), ngram) AS parts FROM tops JOIN pairs USING (pair_id) JOIN toks ON doc_id = doc_b)""")
        + """SELECT pair_id, ngram, CAST(k AS INTEGER) AS occurrence, CAST(list_sum(list_transform(list_slice(parts, 1, k), lambda s: length(s))) + (k - 1) * length(ngram) AS INTEGER) AS start
        FROM (SELECT *, unnest(CASE WHEN len(parts) > 1 THEN range(1, len(parts)) ELSE [1] END) AS k FROM o)""",
    "phrase_spans": _W(*_BASE, _COMMON, f"s AS (SELECT pair_id, tokens, ph, unnest({_SPANS}) AS start FROM (SELECT pair_id, tokens, string_split(ngram, ' ') AS ph FROM tops JOIN pairs USING (pair_id) JOIN toks ON doc_id = doc_a))")
        + """SELECT pair_id, CAST(start AS INTEGER) AS start, md5(array_to_string(list_concat(list_concat(list_slice(tokens, 1, start), ['[MASK]']), list_slice(tokens, start + len(ph) + 1, len(tokens))), ' ')) AS masked,
        md5(array_to_string(list_concat(list_concat(list_slice(tokens, 1, start), list_transform(ph, lambda x: '[MASK]')), list_slice(tokens, start + len(ph) + 1, len(tokens))), ' ')) AS masked_each FROM s""",
    "coverage_runs": _W(*_BASE, _COMMON, f"s AS (SELECT DISTINCT pair_id, len(ph) AS n, unnest({_SPANS}) AS start FROM (SELECT pair_id, tokens, string_split(gram, ' ') AS ph FROM common JOIN pairs USING (pair_id) JOIN toks ON doc_id = doc_a))",
        "c AS (SELECT pair_id, x, least(2, (SELECT count(*) FROM s WHERE s.pair_id = t.pair_id AND s.start <= x AND x < s.start + s.n)) AS cover FROM (SELECT pair_id, unnest(range(0, len(tokens))) AS x FROM pairs JOIN toks ON doc_id = doc_a) t)",
        "r AS (SELECT *, x - row_number() OVER (PARTITION BY pair_id, cover ORDER BY x) AS island FROM c)")
        + 'SELECT pair_id, CAST(min(x) AS INTEGER) AS start, CAST(max(x) + 1 AS INTEGER) AS "end", CAST(cover AS INTEGER) AS cover FROM r GROUP BY pair_id, cover, island',
    "skn_probs": _W(*_LM, skn_sql("a", "m", "q", "model_id, sent_id", ORDER, 0.75)) + "SELECT model_id, sent_id, CAST(pos AS INTEGER) AS pos, token, round(p, 6) + 0.0 AS p FROM a",
    "fkn_probs": _W(*_LM, fkn_sql("a", "m", "q", "model_id, sent_id", ORDER, 0.5)) + "SELECT model_id, sent_id, CAST(pos AS INTEGER) AS pos, token, round(p, 6) + 0.0 AS p FROM a",
    "lm_perplexity": _W(*_LM, fkn_sql("a", "m", "q", "model_id, sent_id", ORDER, 0.5)) + "SELECT model_id, sent_id, count(*) AS n, round(pow(2, -avg(log2(CASE WHEN p > 0 THEN p ELSE 2.2250738585072014e-308 END))), 6) AS perplexity FROM a GROUP BY model_id, sent_id",
    "next_words": _W(*_KS, "src AS (SELECT corpus AS model_id, tokens FROM ks)", model_sql("m", "src", 2),
        """cx AS (SELECT model_id, g[1] AS context, suc, ctx FROM m_suc WHERE len(g) = 1), vo AS (SELECT c.model_id, c.g[1] AS word, coalesce(p.pre, 0) / t.mid AS u FROM m_cnt c LEFT JOIN m_pre p ON p.model_id = c.model_id AND p.g = c.g JOIN m_mid t ON t.model_id = c.model_id AND t.g = [] WHERE len(c.g) = 1),
        b AS (SELECT cx.model_id, context, word, greatest(coalesce(n.c, 0) - 0.75::DOUBLE, 0) / ctx + 0.75::DOUBLE * suc / ctx * u AS p FROM cx JOIN vo USING (model_id) LEFT JOIN m_cnt n ON n.model_id = cx.model_id AND n.g = [context, word])""")
        + "SELECT model_id, context, word, round(p, 6) AS p, CAST(k AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY model_id, context ORDER BY p DESC, word) AS k FROM b) WHERE k <= 3",
}
