"""Tables that the queries share, as DataFrames and as SQL, always over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions import text as X
from glyphmill.functions.textnorm import clean_key
from glyphmill.operators.corpus import sentence_rows
from glyphmill.operators.deliveries import one_delivery
from glyphmill.operators.sampling import sample_for, sample_within
from glyphmill.session import table


def r6(c: Column | str) -> Column:
    """Rounded for comparison, without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def known(spark: SparkSession, d: str) -> DataFrame:
    """One row a known document, with its clean author."""
    k = one_delivery(table(spark, d, "known_texts"), "doc_id", "orig_doc_id", "corpus", "author", "texttype", "text")
    return k.select("doc_id", "orig_doc_id", "corpus", clean_key(F.col("author")).alias("author"), "texttype", "text")


def unknown_chunks(spark: SparkSession, d: str) -> DataFrame:
    """One row a chunk of an unknown document, with its clean author."""
    u = one_delivery(table(spark, d, "unknown_texts"), ["doc_id", "chunk_id"], "corpus", "author", "texttype", "sentence")
    return u.select("doc_id", "corpus", "chunk_id", clean_key(F.col("author")).alias("author"), "texttype", "sentence")


def known_sentences(spark: SparkSession, d: str) -> DataFrame:
    """``(doc_id, author, corpus, sent_id, tokens)`` of known texts; sentences without words are left out."""
    s = sentence_rows(known(spark, d).select("doc_id", "author", "corpus", "text"))
    return _with_tokens(s)


def unknown_sentences(spark: SparkSession, d: str) -> DataFrame:
    return _with_tokens(unknown_chunks(spark, d).select("doc_id", "author", "corpus", "chunk_id", "sentence"))


def _with_tokens(s: DataFrame) -> DataFrame:
    rows = s.select("doc_id", "author", "corpus", F.concat_ws(":", "doc_id", F.col("chunk_id").cast("string")).alias("sent_id"), X.words(F.col("sentence")).alias("tokens"))
    return rows.where(F.size("tokens") > 0)


def doc_tokens(sentences: DataFrame) -> DataFrame:
    """``(doc_id, tokens)``: a document's tokens in order; a document is bounded."""
    parts = F.sort_array(F.collect_list(F.struct(F.regexp_extract("sent_id", r"([0-9]+)$", 1).cast("int").alias("k"), "tokens")))
    return sentences.groupBy("doc_id").agg(F.flatten(F.transform(parts, lambda s: s["tokens"])).alias("tokens"))


def samples(spark: SparkSession, d: str) -> DataFrame:
    """``(problem_id, corpus, problem, known_author, unknown_author, known_id, unknown_id, target)`` of problems with both documents named."""
    m = table(spark, d, "agg_metadata").where("known_doc_id is not null and unknown_doc_id is not null").dropDuplicates(["sample_id"])
    return m.select(
        F.col("sample_id").alias("problem_id"), "corpus", "problem", "known_author", "unknown_author", F.col("known_doc_id").alias("known_id"), F.col("unknown_doc_id").alias("unknown_id"),
        (F.col("known_author") == F.col("unknown_author")).alias("target"),
    )


def _split_request(got: DataFrame, *names: str) -> DataFrame:
    ids = F.split("req_id", r"\|")
    return got.select(ids[0].cast("bigint").alias("problem_id"), ids[1].cast("int").alias(names[0]), "item", "rank")


def _requests(problems: DataFrame, k: Column, draws: int, name: str = "") -> DataFrame:
    req = problems.select("problem_id", k.alias("k"), F.col("known_author").alias("not_a"), F.col("unknown_author").alias("not_b"), F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    return req.select(F.concat_ws("|", F.col("problem_id").cast("string"), F.col("draw").cast("string"), *([F.lit(name)] if name else [])).alias("req_id"), "k", "not_a", "not_b")


def reference_sentences(problems: DataFrame, sentences: DataFrame, reps: int) -> DataFrame:
    """``(problem_id, rep, sent_id)``: for each repetition as many sentences of other authors as the known document has."""
    sizes = sentences.groupBy(F.col("doc_id").alias("known_id")).agg(F.count(F.lit(1)).alias("k"))
    got = sample_for(_requests(problems.join(sizes, "known_id"), F.col("k"), reps), sentences.select(F.col("sent_id").alias("item"), "author"))
    return _split_request(got, "rep").select("problem_id", "rep", F.col("item").alias("sent_id"))


def reference_docs(problems: DataFrame, docs: DataFrame, trials: int, each: int, replace: bool = False) -> DataFrame:
    """``(problem_id, trial, place, ref_id)``: for each trial ``each`` documents of other authors, numbered from 1."""
    got = sample_for(_requests(problems, F.lit(each), trials, "d"), docs.select(F.col("doc_id").alias("item"), "author"), replace=replace)
    return _split_request(got, "trial").select("problem_id", "trial", F.col("rank").alias("place"), F.col("item").alias("ref_id"))


def pooled_sentences(problems: DataFrame, sentences: DataFrame, impostors: DataFrame, reps: int) -> DataFrame:
    """``(problem_id, rep, sent_id)``: for each repetition as many sentences of the problem's pooled impostor documents as the known document has."""
    sizes = sentences.groupBy(F.col("doc_id").alias("known_id")).agg(F.count(F.lit(1)).alias("k"))
    req = problems.join(sizes, "known_id").select("problem_id", "k", F.explode(F.sequence(F.lit(1), F.lit(reps))).alias("rep"))
    req = req.select(F.concat_ws("|", F.col("problem_id").cast("string"), F.col("rep").cast("string"), F.lit("p")).alias("req_id"), F.col("problem_id").alias("grp"), "k")
    pool = impostors.select(F.col("problem_id").alias("grp"), F.col("ref_id").alias("doc_id")).join(sentences.select("doc_id", F.col("sent_id").alias("item")), "doc_id")
    return _split_request(sample_within(req, pool), "rep").select("problem_id", "rep", F.col("item").alias("sent_id"))


# the same in SQL ------------------------------------------------------------------------------------------------------

_CLEAN = r"nullif(lower(regexp_replace({c}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')), '')"
_WORDS = r"regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}_]+')"

CTE = {
    "known": "known AS (SELECT doc_id, any_value(orig_doc_id) AS orig_doc_id, any_value(corpus) AS corpus, " + _CLEAN.format(c="any_value(author)") + " AS author, any_value(texttype) AS texttype, any_value(text) AS text FROM known_texts GROUP BY doc_id)",
    "unknown_chunks": "unknown_chunks AS (SELECT doc_id, chunk_id, any_value(corpus) AS corpus, " + _CLEAN.format(c="any_value(author)") + " AS author, any_value(texttype) AS texttype, any_value(sentence) AS sentence FROM unknown_texts GROUP BY doc_id, chunk_id)",
    "known_rows": r"""known_rows AS (SELECT doc_id, author, corpus, texttype, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS chunk_id, replace(s, chr(2), '.') AS sentence
        FROM (SELECT doc_id, author, corpus, texttype, unnest(parts) AS s, generate_subscripts(parts, 1) AS p FROM (SELECT *, regexp_split_to_array(regexp_replace(text, '""" + X.ABBREVIATION + r"""', '\1\2' || chr(2), 'g'), '[.!?]\s+|\n') AS parts FROM known WHERE text IS NOT NULL))
        WHERE regexp_matches(s, '[^\s\p{Z}]'))""",
    "ks": "ks AS (SELECT * FROM (SELECT doc_id, author, corpus, doc_id || ':' || chunk_id AS sent_id, chunk_id, " + _WORDS.format(c="sentence") + " AS tokens FROM known_rows) WHERE len(tokens) > 0)",
    "us": "us AS (SELECT * FROM (SELECT doc_id, author, corpus, doc_id || ':' || chunk_id AS sent_id, chunk_id, " + _WORDS.format(c="sentence") + " AS tokens FROM unknown_chunks WHERE sentence IS NOT NULL) WHERE len(tokens) > 0)",
    "samples": """samples AS (SELECT sample_id AS problem_id, any_value(corpus) AS corpus, any_value(problem) AS problem, any_value(known_author) AS known_author, any_value(unknown_author) AS unknown_author,
        any_value(known_doc_id) AS known_id, any_value(unknown_doc_id) AS unknown_id, any_value(known_author = unknown_author) AS target FROM agg_metadata WHERE known_doc_id IS NOT NULL AND unknown_doc_id IS NOT NULL GROUP BY sample_id)""",
}


def with_(*names: str) -> str:
    return "WITH " + ",\n".join(CTE.get(n, n) for n in names) + "\n"


def sample_sql(name: str, requests: str, pool: str, share: float | None = None) -> str:
    """CTEs that draw from a pool as sample_for does; ``requests`` has (req_id, k, not_a, not_b), ``pool`` (item, author). The items free for each pair of authors are numbered, and a request is arithmetic on these numbers."""
    k = "k" if share is None else f"greatest(CAST(floor(m * {share}::DOUBLE + 0.5) AS BIGINT), 1)"
    return f"""{name}_ring AS MATERIALIZED (SELECT item, author, row_number() OVER (ORDER BY md5('0|' || item), item) - 1 AS pos FROM {pool}),
    {name}_pairs AS (SELECT not_a, not_b, row_number() OVER () AS pair FROM (SELECT DISTINCT not_a, not_b FROM {requests})),
    {name}_free AS MATERIALIZED (SELECT pair, item, pos, row_number() OVER (PARTITION BY pair ORDER BY pos) - 1 AS er, count(*) OVER (PARTITION BY pair) AS m FROM {name}_pairs, {name}_ring
        WHERE author IS NULL OR ((not_a IS NULL OR author <> not_a) AND (not_b IS NULL OR author <> not_b))),
    {name}_start AS (SELECT req_id, k, pair, ('0x' || substr(md5('0|' || req_id), 1, 15))::BIGINT % (SELECT count(*) FROM {name}_ring) AS s FROM {requests} r JOIN {name}_pairs p ON r.not_a IS NOT DISTINCT FROM p.not_a AND r.not_b IS NOT DISTINCT FROM p.not_b),
    {name}_first AS (SELECT req_id, st.pair, st.k, coalesce(f.er, 0) AS e0 FROM {name}_start st ASOF LEFT JOIN {name}_free f ON st.pair = f.pair AND st.s <= f.pos),
    {name}_size AS (SELECT DISTINCT pair, m FROM {name}_free),
    {name}_want AS (SELECT req_id, pair, m, e0, unnest(range({k})) AS j FROM {name}_first JOIN {name}_size USING (pair)),
    {name} AS MATERIALIZED (SELECT req_id, item, j + 1 AS rank FROM {name}_want w JOIN {name}_free f ON f.pair = w.pair AND f.er = (w.e0 + w.j) % w.m)"""


_IDS = "CAST(split_part(req_id, '|', 1) AS BIGINT) AS problem_id, CAST(split_part(req_id, '|', 2) AS INTEGER)"


def ref_sentences_sql(reps: int) -> str:
    """CTE ``refs`` (problem_id, rep, sent_id)."""
    return f"""ks_items AS (SELECT sent_id AS item, author FROM ks),
    kn_size AS (SELECT doc_id AS known_id, count(*) AS k FROM ks GROUP BY doc_id),
    rs_req AS (SELECT problem_id || '|' || rep AS req_id, k, known_author AS not_a, unknown_author AS not_b FROM samples JOIN kn_size USING (known_id), range(1, {reps + 1}) AS t(rep)),
    {sample_sql('rs', 'rs_req', 'ks_items')},
    refs AS MATERIALIZED (SELECT {_IDS} AS rep, item AS sent_id FROM rs)"""


def ref_docs_sql(trials: int, each: int) -> str:
    """CTE ``ref_docs`` (problem_id, trial, place, ref_id)."""
    return f"""kd_items AS (SELECT doc_id AS item, any_value(author) AS author FROM ks GROUP BY doc_id),
    rd_req AS (SELECT problem_id || '|' || trial || '|d' AS req_id, {each} AS k, known_author AS not_a, unknown_author AS not_b FROM samples, range(1, {trials + 1}) AS t(trial)),
    {sample_sql('rd', 'rd_req', 'kd_items')},
    ref_docs AS MATERIALIZED (SELECT {_IDS} AS trial, rank AS place, item AS ref_id FROM rd)"""


def pooled_sql(docs: int, reps: int) -> str:
    """CTE ``refs`` (problem_id, rep, sent_id) from the pooled sentences of ``docs`` impostor documents."""
    return f"""{ref_docs_sql(1, docs)},
    pl AS MATERIALIZED (SELECT problem_id, sent_id, row_number() OVER (PARTITION BY problem_id ORDER BY md5('0|' || sent_id), sent_id) - 1 AS pos, count(*) OVER (PARTITION BY problem_id) AS m FROM ref_docs JOIN ks ON ks.doc_id = ref_id),
    ps AS (SELECT problem_id, rep, k, ('0x' || substr(md5('0|' || problem_id || '|' || rep || '|p'), 1, 15))::BIGINT AS s FROM samples JOIN (SELECT doc_id AS known_id, count(*) AS k FROM ks GROUP BY doc_id) USING (known_id), range(1, {reps + 1}) AS t(rep)),
    pw AS (SELECT problem_id, rep, s, unnest(range(k)) AS j FROM ps),
    refs AS MATERIALIZED (SELECT problem_id, CAST(rep AS INTEGER) AS rep, sent_id FROM pw JOIN pl USING (problem_id) WHERE pos = (s % m + j) % m)"""
