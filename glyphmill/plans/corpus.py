"""Queries on ids, problems, sentences and ordered text."""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphmill.functions import text as X
from glyphmill.operators import corpus as C
from glyphmill.operators.numbering import number_within
from glyphmill.plans import base as B
from glyphmill.session import table


def temp_doc_ids(spark, d):  # noqa: ANN001, ANN201
    raw = B.known(spark, d).select(F.col("orig_doc_id").alias("doc_id"), "corpus", "text", F.col("doc_id").alias("given"))
    return C.apply_temp_doc_id(raw).select("given", "doc_id", "orig_doc_id")


def build_metadata(spark, d):  # noqa: ANN001, ANN201
    return C.build_metadata(table(spark, d, "agg_metadata"), B.known(spark, d).where("author is not null"), B.unknown_chunks(spark, d).where("author is not null"))


def problem_pairs_meta(spark, d):  # noqa: ANN001, ANN201
    return C.problems(B.unknown_chunks(spark, d), B.known(spark, d), table(spark, d, "agg_metadata"))


def problem_pairs_single(spark, d):  # noqa: ANN001, ANN201
    """The author of most documents (ties: least name) against every unknown author."""
    k = B.known(spark, d).where("author is not null")
    first = k.groupBy("author").count().orderBy(F.desc("count"), "author").limit(1).select("author")
    return C.problems(B.unknown_chunks(spark, d), k.join(first, "author", "left_semi"))


def sentence_chunks(spark, d):  # noqa: ANN001, ANN201
    return C.sentence_rows(B.known(spark, d).select("doc_id", "corpus", "author", "text"))


def problem_doc_list(spark, d):  # noqa: ANN001, ANN201
    return B.samples(spark, d).select("problem_id", C.doc_pair_name("known_id", "unknown_id").alias("pair"))


def job_list(spark, d):  # noqa: ANN001, ANN201
    return C.numbered_jobs(B.samples(spark, d), "known_id", "unknown_id")


def pending_jobs(spark, d):  # noqa: ANN001, ANN201
    """Problems none of whose phrases has been scored."""
    done = table(spark, d, "paraphrases").where("sum_log_probs is not null").select("sample_id")
    return C.pending(table(spark, d, "agg_metadata").select("sample_id", "problem").distinct(), done, "sample_id")


def concat_text(spark, d):  # noqa: ANN001, ANN201
    return C.concat_text(B.unknown_chunks(spark, d), "doc_id", "chunk_id", "sentence")


def concat_listed(spark, d):  # noqa: ANN001, ANN201
    """The known documents of each problem, in the order of their samples, each once."""
    m = B.samples(spark, d).where("problem is not null").select(F.col("problem").alias("list_id"), F.col("problem_id").alias("ord"), F.col("known_id").alias("doc_id"))
    return C.concat_listed(m, B.known(spark, d), unique=True).select("list_id", F.md5("concat_text").alias("digest"), "missing")


def profile_offsets(spark, d):  # noqa: ANN001, ANN201
    return C.profile_offsets(B.known(spark, d).where("author is not null"), ["corpus", "author"], "doc_id")


def clean_text(spark, d):  # noqa: ANN001, ANN201
    t = table(spark, d, "documents")
    return t.select("doc_id", F.length(X.without_control_chars(F.col("text"))).alias("n_clean"), F.md5(X.without_control_chars(F.col("text"))).alias("digest"))


def split_description(spark, d):  # noqa: ANN001, ANN201
    p = table(spark, d, "paraphrases").dropDuplicates(["cand_id"])
    text = F.concat_ws(" - ", F.lit("gpt2"), F.coalesce("phrase_method", F.lit("none")), F.coalesce(F.col("num_tokens").cast("string"), F.lit("0")), F.lit("t"), F.lit("0.7"))
    return C.split_description(p.select("cand_id", text.alias("description"))).drop("description")


def sentence_vectors(spark, d):  # noqa: ANN001, ANN201
    """Vectors of unknown sentences, by their places that are not zero."""
    v = B.unknown_sentences(spark, d).select("sent_id", F.posexplode(X.hashed_vector(F.col("tokens"))).alias("dim", "value"))
    return v.where("value <> 0")


def token_measures(spark, d):  # noqa: ANN001, ANN201
    """Scored sentences: each unknown chunk's tokens with log-probabilities -1/(length + 1) and their median as the reference value."""
    s = B.unknown_sentences(spark, d)
    lp = F.transform("tokens", lambda t: -1.0 / (F.length(t) + 1))
    rows = s.select("sent_id", lp.alias("lp"))
    mid = F.get(F.sort_array("lp"), (F.floor((F.size("lp") - 1) / 2)).cast("int"))
    m = rows.select("sent_id", X.token_differences(F.col("lp"), F.transform("lp", lambda _: mid)).alias("m"))
    return m.select("sent_id", F.col("m.num_tokens").alias("num_tokens"), *[B.r6(F.col(f"m.{c}")).alias(c) for c in ("sum_log_prob", "avg_log_prob", "mean_diff", "mean_abs_diff", "perplexity")])


def protected_sentences(spark, d):  # noqa: ANN001, ANN201
    """Sentences of documents, in which names of two capitalised words and initials hold their full stop."""
    t = table(spark, d, "documents").where("text is not null")
    names = F.regexp_extract_all("text", F.lit(r"([A-Z][a-z]+ [A-Z]\. [A-Z][a-z]+)"), F.lit(1))
    rows = t.select("doc_id", F.posexplode(X.split_sentences(F.col("text"), names)).alias("k", "sentence"))
    return rows.select("doc_id", F.col("k").alias("chunk"), F.length("sentence").alias("n"), F.md5("sentence").alias("digest"))


def placeholders(spark, d):  # noqa: ANN001, ANN201
    """Unknown sentences with their placeholder words resolved, and put back."""
    s = B.unknown_chunks(spark, d).where("sentence is not null")
    plain = X.without_placeholders(F.col("sentence"))
    return s.select("doc_id", "chunk_id", F.md5(plain).alias("plain"), F.md5(X.with_placeholders(plain)).alias("prepared"))


def posnoise(spark, d):  # noqa: ANN001, ANN201
    """Unknown sentences with content words masked. Tags come from a rule in place of a tagger: digits, capitals, endings; the common English words are kept."""
    keep = tuple(r.word for r in table(spark, d, "common_words").where("lang = 'en'").select(F.lower("word").alias("word")).distinct().collect())  # a fixed table
    t = F.split("sentence", " ")
    tag = lambda w: F.when(w.rlike("^[0-9]+$"), "NUM").when(w.rlike("^[A-Z]"), "PROPN").when(w.rlike("ly$"), "ADV").when(w.rlike("ed$"), "VERB").when(w.rlike("^[a-z]+$"), "NOUN").otherwise("PUNCT")
    rows = B.unknown_chunks(spark, d).where("sentence is not null").select("doc_id", "chunk_id", t.alias("t"))
    last = F.size("t") - 1
    rows = rows.select("doc_id", "chunk_id", "t", F.transform("t", lambda w, k: k < last).alias("s"), F.transform("t", tag).alias("p"))
    return rows.select("doc_id", "chunk_id", X.masked_pos(F.col("t"), F.col("s"), F.col("p"), keep).alias("masked"))


def impostor_ids(spark, d):  # noqa: ANN001, ANN201
    """The candidates of each sample numbered from 1, as a document's impostors are."""
    p = table(spark, d, "paraphrases").where("sample_id is not null").select("sample_id", "cand_id").distinct()
    return number_within(p, ["sample_id"], ["cand_id"])


def prompts(spark, d):  # noqa: ANN001, ANN201
    """Requests for paraphrases and gaps to be filled, one for each unknown chunk's first word."""
    s = B.unknown_chunks(spark, d).where("sentence is not null")
    first, rest = F.element_at(F.split("sentence", " "), 1), F.regexp_replace("sentence", "^[^ ]*", "")
    return s.select("doc_id", "chunk_id", F.md5(X.user_prompt(first, X.token_repr(F.array(first)), F.col("sentence"))).alias("request"), F.md5(X.fill_in_prompt(first, rest)).alias("gap"), X.token_repr(F.array(first)).alias("raw"))


QUERIES = {f.__name__: f for f in (
    temp_doc_ids, build_metadata, problem_pairs_meta, problem_pairs_single, sentence_chunks, problem_doc_list, job_list, pending_jobs, concat_text, concat_listed, profile_offsets, clean_text,
    split_description, sentence_vectors, token_measures, protected_sentences, placeholders, posnoise, impostor_ids, prompts,
)}

_W = B.with_
SQL = {
    "temp_doc_ids": _W("known") + r"""SELECT doc_id AS given, orig_doc_id,
        CASE WHEN regexp_matches(orig_doc_id, '\[.*?\]') THEN lower(regexp_replace(regexp_replace(regexp_extract(orig_doc_id, '\[(.*?)\]', 1), '[^\p{L}\p{N}_]', '_', 'g'), '_{2,}', '_', 'g')) END AS doc_id FROM known""",
    "build_metadata": _W("known", "unknown_chunks", "m AS (SELECT DISTINCT problem, corpus, known_author, unknown_author FROM agg_metadata)",
        "f AS (SELECT author AS unknown_author, min(doc_id) AS unknown_doc_id FROM unknown_chunks WHERE author IS NOT NULL GROUP BY author)",
        "k AS (SELECT DISTINCT author AS known_author, doc_id AS known_doc_id FROM known WHERE author IS NOT NULL)")
        + """SELECT row_number() OVER (ORDER BY problem NULLS FIRST, corpus NULLS FIRST, known_author NULLS FIRST, unknown_author NULLS FIRST, known_doc_id NULLS FIRST) AS sample_id,
        problem, corpus, known_author, unknown_author, unknown_doc_id, known_doc_id FROM m JOIN f USING (unknown_author) LEFT JOIN k USING (known_author)""",
    "problem_pairs_meta": _W("known", "unknown_chunks") + """SELECT DISTINCT problem, known_author, unknown_author FROM agg_metadata
        WHERE known_author IN (SELECT author FROM known WHERE author IS NOT NULL) AND unknown_author IN (SELECT author FROM unknown_chunks WHERE author IS NOT NULL)""",
    "problem_pairs_single": _W("known", "unknown_chunks", "one AS (SELECT author FROM known WHERE author IS NOT NULL GROUP BY author ORDER BY count(*) DESC, author LIMIT 1)")
        + "SELECT DISTINCT one.author || ' vs ' || u.author AS problem, one.author AS known_author, u.author AS unknown_author FROM one, unknown_chunks u WHERE u.author IS NOT NULL",
    "sentence_chunks": _W("known", "known_rows") + "SELECT doc_id, corpus, author, CAST(chunk_id AS INTEGER) AS chunk_id, sentence FROM known_rows",
    "problem_doc_list": _W("samples") + "SELECT problem_id, known_id || ' vs ' || unknown_id AS pair FROM samples",
    "job_list": _W("samples") + "SELECT problem, known_id, unknown_id, CAST(row_number() OVER (PARTITION BY problem ORDER BY known_id, unknown_id) AS INTEGER) AS job FROM (SELECT DISTINCT problem, known_id, unknown_id FROM samples)",
    "pending_jobs": "SELECT DISTINCT sample_id, problem FROM agg_metadata WHERE sample_id NOT IN (SELECT sample_id FROM paraphrases WHERE sum_log_probs IS NOT NULL AND sample_id IS NOT NULL)",
    "concat_text": _W("unknown_chunks") + "SELECT doc_id, string_agg(sentence, chr(10) ORDER BY chunk_id) AS concat_text FROM unknown_chunks WHERE sentence IS NOT NULL GROUP BY doc_id",
    "concat_listed": _W("known", "samples", "l AS (SELECT problem, known_id, min(problem_id) AS o FROM samples WHERE problem IS NOT NULL GROUP BY ALL)")
        + "SELECT problem AS list_id, md5(coalesce(string_agg(text, chr(10) ORDER BY o), '')) AS digest, count(*) FILTER (text IS NULL) AS missing FROM l LEFT JOIN known ON doc_id = known_id GROUP BY problem",
    "profile_offsets": _W("known") + """SELECT corpus, author, doc_id, CAST(row_number() OVER w AS INTEGER) AS ord, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY corpus, author ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
        CAST(length(text) AS INTEGER) AS n_chars FROM known WHERE author IS NOT NULL AND text IS NOT NULL WINDOW w AS (PARTITION BY corpus, author ORDER BY doc_id)""",
    "clean_text": r"SELECT doc_id, CAST(length(regexp_replace(text, '[\x00-\x08\x0B-\x0C\x0E-\x1F]', '', 'g')) AS INTEGER) AS n_clean, md5(regexp_replace(text, '[\x00-\x08\x0B-\x0C\x0E-\x1F]', '', 'g')) AS digest FROM documents",
    "split_description": """SELECT cand_id, 'gpt2' AS model, coalesce(any_value(phrase_method), 'none') AS para_method, coalesce(CAST(any_value(num_tokens) AS VARCHAR), '0') AS top_k, '0.7' AS temperature,
        coalesce(any_value(phrase_method), 'none') || '_t_0.7' AS para_method_t_temp FROM paraphrases GROUP BY cand_id""",
    "sentence_vectors": _W("unknown_chunks", "us", "t AS (SELECT sent_id, unnest(tokens) AS w FROM us)") + "SELECT sent_id, CAST(('0x' || substr(md5(w), 1, 7))::BIGINT % 64 AS INTEGER) AS dim, CAST(count(*) AS DOUBLE) AS value FROM t GROUP BY ALL",
    "protected_sentences": r"""WITH d AS (SELECT doc_id, text, list_sort(list_distinct(regexp_extract_all(text, '[A-Z][a-z]+ [A-Z]\. [A-Z][a-z]+'))) AS names FROM documents WHERE text IS NOT NULL),
        e AS (SELECT doc_id, list_reduce(list_concat([text], list_sort(list_transform(names, lambda n: lpad(CAST(100000 - length(n) AS VARCHAR), 6, '0') || n))), lambda t, n: replace(t, substr(n, 7), replace(substr(n, 7), '.', chr(2)))) AS text FROM d),
        s AS (SELECT doc_id, regexp_split_to_array(regexp_replace(text, '""" + X.ABBREVIATION + r"""', '\1\2' || chr(2), 'g'), '[.!?]\s+|\n') AS parts FROM e),
        f AS (SELECT doc_id, list_filter(parts, lambda x: regexp_matches(x, '[^\s\p{Z}]')) AS parts FROM s),
        u AS (SELECT doc_id, unnest(parts) AS x, generate_subscripts(parts, 1) AS k FROM f)
        SELECT doc_id, CAST(k - 1 AS INTEGER) AS chunk, CAST(length(x) AS INTEGER) AS n, md5(replace(x, chr(2), '.')) AS digest FROM u""",
    "placeholders": _W("unknown_chunks", r"""p AS (SELECT doc_id, chunk_id, replace(replace(sentence, '__BACKSLASH_PLACEHOLDER__', chr(92)), '__REF_ERROR__', '(??)') AS s FROM unknown_chunks WHERE sentence IS NOT NULL)""")
        + "SELECT doc_id, chunk_id, md5(s) AS plain, md5(replace(replace(s, chr(92), '__BACKSLASH_PLACEHOLDER__'), '(??)', '__REF_ERROR__')) AS prepared FROM p",
    "posnoise": _W("unknown_chunks", "k AS (SELECT list(DISTINCT lower(word)) AS keep FROM common_words WHERE lang = 'en')", "w AS (SELECT doc_id, chunk_id, string_split(sentence, ' ') AS t FROM unknown_chunks WHERE sentence IS NOT NULL)")
        + """SELECT doc_id, chunk_id, array_to_string(list_transform(t, lambda w: CASE WHEN list_contains(keep, lower(w)) OR replace(w, chr(39), '~') IN ('~m', '~d', '~s', '~re', '~ve', '~ll', 'n~t', '~t') THEN w
            WHEN regexp_full_match(w, '[0-9]+') THEN 'µ' WHEN regexp_matches(w, '^[A-Z]') THEN '§' WHEN regexp_matches(w, 'ly$') THEN '©' WHEN regexp_matches(w, 'ed$') THEN 'Ø' WHEN regexp_full_match(w, '[a-z]+') THEN '#' ELSE w END), ' ') AS masked FROM w, k""",
    "impostor_ids": "SELECT sample_id, cand_id, row_number() OVER (PARTITION BY sample_id ORDER BY cand_id) AS impostor_id FROM (SELECT DISTINCT sample_id, cand_id FROM paraphrases WHERE sample_id IS NOT NULL)",
    "prompts": _W("unknown_chunks", "f AS (SELECT doc_id, chunk_id, sentence, split_part(sentence, ' ', 1) AS w FROM unknown_chunks WHERE sentence IS NOT NULL)")
        + """SELECT doc_id, chunk_id, md5(chr(10) || '<DOC>' || chr(10) || sentence || chr(10) || '</DOC>' || chr(10) || '<RAW NGRAM>' || chr(10) || '"' || raw || '"' || chr(10) || '</RAW NGRAM>' || chr(10) || '<NGRAM>' || chr(10) || '"' || w || '"' || chr(10) || '</NGRAM>' || chr(10)) AS request,
            md5('<|fim_prefix|>' || w || '<|fim_suffix|>' || substr(sentence, length(w) + 1) || '<|fim_middle|>') AS gap, raw
            FROM (SELECT *, '(' || chr(39) || replace(replace(w, chr(92), chr(92) || chr(92)), chr(39), chr(92) || chr(39)) || chr(39) || ')' AS raw FROM f)""",
    "token_measures": _W("unknown_chunks", "us", "l AS (SELECT sent_id, list_transform(tokens, lambda t: CAST(-1.0 AS DOUBLE) / (length(t) + 1)) AS lp FROM us)",
        "m AS (SELECT *, list_sort(lp)[CAST((len(lp) - 1) // 2 AS BIGINT) + 1] AS mid FROM l)")
        + """SELECT sent_id, CAST(len(lp) AS INTEGER) AS num_tokens, round(list_sum(lp), 6) + 0.0 AS sum_log_prob, round(list_avg(lp), 6) + 0.0 AS avg_log_prob,
        round(list_avg(list_transform(lp, lambda x: x - mid)), 6) + 0.0 AS mean_diff, round(list_avg(list_transform(lp, lambda x: abs(x - mid))), 6) + 0.0 AS mean_abs_diff, round(exp(-list_avg(lp)), 6) AS perplexity FROM m""",
}
