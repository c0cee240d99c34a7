"""Queries p1 to p4 and p6 to p9 over whole tables, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphmill.functions.textnorm import clean_key, clean_phrase_col, doc_terms, number_in
from glyphmill.llm.distinctive_terms import tf_idf
from glyphmill.llm.mixing import mix, mix_shares
from glyphmill.llm.packing import pack, pack_fill
from glyphmill.llm.quality import text_quality
from glyphmill.llm.sentences import sentences
from glyphmill.llm.shared_spans import shared_links, shared_pairs, shared_share
from glyphmill.llm.term_frequency import mark, term_frequencies
from glyphmill.llm.tokenizer import token_count
from glyphmill.llm.top_n import top_n
from glyphmill.operators.deliveries import one_delivery
from glyphmill.plans.folding import TERMS, folded
from glyphmill.session import cut, table


def _phrase_frequencies(spark, d):  # noqa: ANN001, ANN202
    """Terms are clean phrases, records phrase numbers, rows candidates (repeated deliveries of a candidate count once)."""
    p = table(spark, d, "paraphrases").select("cand_id", number_in(F.col("phrase_num")).alias("phrase_no"), clean_phrase_col(F.col("phrase")).alias("term"))
    freq = term_frequencies(p, "term", "phrase_no", "cand_id")
    groups = table(spark, d, "paraphrases").where("phrase is not null").select(F.countDistinct(number_in(F.col("phrase_num"))).alias("n")).scalar()
    return mark(freq, F.col("occurrences") == 1, (F.col("records") >= 5) & (F.col("records") * 200 >= groups))


def _token_frequencies(spark, d):  # noqa: ANN001, ANN202
    k = table(spark, d, "known_texts")
    freq = term_frequencies(doc_terms(k, "doc_id", "tokens"), "term", "doc_id", count="tf")
    docs = k.select(F.countDistinct("doc_id").alias("n")).scalar()
    return mark(freq, F.col("records") == 1, F.col("records") * 5 >= docs)


def p1_found(spark, d):  # noqa: ANN001, ANN201
    return p1_frequencies(spark, d).where("mark is not null").select("field_name", "term", "mark")


def p1_frequencies(spark, d):  # noqa: ANN001, ANN201
    both = [f.select(F.lit(name).alias("field_name"), "term", "occurrences", "records", "mark") for name, f in (("token", _token_frequencies(spark, d)), ("phrase", _phrase_frequencies(spark, d)))]
    return both[0].unionByName(both[1])


def _all_texts(spark, d):  # noqa: ANN001, ANN202
    """Texts of both sides as stored; an unknown document's text stands on its first chunk only."""
    unknown = table(spark, d, "unknown_texts").where("text is not null")
    return table(spark, d, "known_texts").select("doc_id", "text").unionByName(unknown.select("doc_id", "text"))


def p2_found(spark, d):  # noqa: ANN001, ANN201
    return shared_pairs(_all_texts(spark, d))


def p2_shared_share(spark, d):  # noqa: ANN001, ANN201
    return shared_share(_all_texts(spark, d))


def p2_classes(spark, d):  # noqa: ANN001, ANN201
    return shared_links(_all_texts(spark, d))


def _top(spark, d):  # noqa: ANN001, ANN202
    p = table(spark, d, "paraphrases").where("phrase_type = 'paraphrase'")
    rows = p.select(number_in(F.col("phrase_num")).alias("phrase_no"), "sum_log_probs", "phrase", "cand_id")
    return top_n(rows, "phrase_no", "sum_log_probs", "phrase", "cand_id", 3)


def p3_found(spark, d):  # noqa: ANN001, ANN201
    return _top(spark, d).select("phrase_no", "cand_id")


def p3_ranked(spark, d):  # noqa: ANN001, ANN201
    return _top(spark, d)


def p4_found(spark, d):  # noqa: ANN001, ANN201
    known = table(spark, d, "known_texts").select(F.lit("known").alias("side"), "doc_id", F.lit(0).alias("chunk_id"), "text")
    unknown = table(spark, d, "unknown_texts").select(F.lit("unknown").alias("side"), "doc_id", "chunk_id", F.col("sentence").alias("text"))
    return sentences(known.unionByName(unknown), "text", "side", "doc_id", "chunk_id", once=True)


def _doc_counts(spark, d):  # noqa: ANN001, ANN202
    return doc_terms(one_delivery(table(spark, d, "known_texts"), "doc_id", "tokens"), "doc_id", "tokens", lengths=True)


def p6_found(spark, d):  # noqa: ANN001, ANN201
    return tf_idf(_doc_counts(spark, d), "doc_id", least_tf=4, most_df=5).select("doc_id", "term")


def p6_document_terms(spark, d):  # noqa: ANN001, ANN201
    return tf_idf(_doc_counts(spark, d), "doc_id").withColumn("score", F.round("score", 9))


def p6_author_terms(spark, d):  # noqa: ANN001, ANN201
    docs = one_delivery(table(spark, d, "known_texts"), "doc_id", "author", "tokens")
    return tf_idf(doc_terms(docs.select(clean_key(F.col("author")).alias("author"), "tokens"), "author", "tokens"), "author").withColumn("score", F.round("score", 9))


def _sizes(spark, d):  # noqa: ANN001, ANN202
    """Tokens of each document by a public tokenizer, written once since several steps read them."""
    return cut(table(spark, d, "documents").select("doc_id", "source", token_count(F.col("text")).alias("tokens"), F.md5("text").alias("text_key")))


def _capacities(spark, d):  # noqa: ANN001, ANN202
    return {r.pack_name: r.capacity_tokens for r in table(spark, d, "pack_sizes").dropna().collect()}  # a fixed table of a few rows


def p7_packs(spark, d):  # noqa: ANN001, ANN201
    return pack(_sizes(spark, d), _capacities(spark, d))


def p7_fill(spark, d):  # noqa: ANN001, ANN201
    return pack_fill(p7_packs(spark, d))


def p8_draws(spark, d):  # noqa: ANN001, ANN201
    return mix(_sizes(spark, d), table(spark, d, "source_targets"))


def p8_shares(spark, d):  # noqa: ANN001, ANN201
    return mix_shares(p8_draws(spark, d), table(spark, d, "source_targets"))


def p9_quality(spark, d):  # noqa: ANN001, ANN201
    return text_quality(table(spark, d, "documents"), table(spark, d, "common_words"))


def p9_found(spark, d):  # noqa: ANN001, ANN201
    return p9_quality(spark, d).where("kind in ('list', 'table', 'junk')").select("doc_id", "kind")


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_frequencies, p2_found, p2_shared_share, p2_classes, p3_found, p3_ranked, p4_found, p6_found, p6_document_terms, p6_author_terms,
        p7_packs, p7_fill, p8_draws, p8_shares, p9_found, p9_quality,
    )
}

_FREQ = f"""
    WITH {TERMS}, {folded('phrases', 'paraphrases', 'phrase')},
         docs AS (SELECT count(DISTINCT doc_id) AS n FROM known_texts),
         t AS (SELECT folded AS term, count(*) AS occurrences, count(DISTINCT doc_id) AS records FROM kt JOIN terms ON token = raw WHERE folded IS NOT NULL GROUP BY folded),
         c AS (SELECT DISTINCT cand_id, TRY_CAST(nullif(regexp_extract(phrase_num, '[0-9]+'), '') AS BIGINT) AS phrase_no, phrase FROM paraphrases WHERE phrase IS NOT NULL),
         groups AS (SELECT count(DISTINCT phrase_no) AS n FROM c),
         p AS (SELECT folded AS term, count(DISTINCT cand_id) AS occurrences, count(DISTINCT phrase_no) AS records FROM c JOIN phrases ON phrase = raw GROUP BY folded),
         f AS (SELECT 'token' AS field_name, *, CASE WHEN records = 1 THEN 'rare' WHEN records * 5 >= (SELECT n FROM docs) THEN 'common' END AS mark FROM t
               UNION ALL SELECT 'phrase', *, CASE WHEN occurrences = 1 THEN 'rare' WHEN records >= 5 AND records * 200 >= (SELECT n FROM groups) THEN 'common' END FROM p)
"""
_DISTINCTIVE = """,
         x AS (SELECT {r} AS r, folded AS term, count(*) AS tf FROM kt JOIN terms ON token = raw WHERE folded IS NOT NULL AND {r} IS NOT NULL GROUP BY ALL),
         n AS (SELECT count(DISTINCT r) AS n_records FROM x), l AS (SELECT r, sum(tf) AS length FROM x GROUP BY r), d AS (SELECT term, count(*) AS df FROM x GROUP BY term),
         s AS (SELECT r, term, tf, df, n_records, round(tf / length * (ln((1 + n_records)::DOUBLE / (1 + df)) + 1), 9) AS score FROM x JOIN l USING (r) JOIN d USING (term), n)
"""
_AUTHOR = r"nullif(lower(regexp_replace(author, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')), '')"
_RANKED = """
    WITH c AS (SELECT DISTINCT TRY_CAST(nullif(regexp_extract(phrase_num, '[0-9]+'), '') AS BIGINT) AS phrase_no, cand_id, phrase, sum_log_probs
               FROM paraphrases WHERE phrase_type = 'paraphrase' AND phrase IS NOT NULL AND isfinite(sum_log_probs)),
         r AS (SELECT *, row_number() OVER (PARTITION BY phrase_no ORDER BY sum_log_probs DESC, phrase, cand_id) AS k FROM c WHERE phrase_no IS NOT NULL)
"""
_RUNS = """
    WITH t AS (SELECT doc_id, any_value(text) AS text FROM (SELECT doc_id, text FROM known_texts UNION ALL SELECT doc_id, text FROM unknown_texts WHERE text IS NOT NULL) GROUP BY doc_id),
         s AS (SELECT doc_id, i, substr(text, i, 120) AS s FROM (SELECT doc_id, text, unnest(range(1, length(text) - 118)) AS i FROM t WHERE length(text) >= 120)),
         m AS (SELECT s FROM s GROUP BY s HAVING count(DISTINCT doc_id) > 1)
"""
SQL = {
    "p1_frequencies": _FREQ + "SELECT field_name, term, occurrences, records, mark FROM f",
    "p1_found": _FREQ + "SELECT field_name, term, mark FROM f WHERE mark IS NOT NULL",
    "p6_document_terms": f"WITH {TERMS}" + _DISTINCTIVE.format(r="doc_id") + "SELECT r AS doc_id, term, tf, df, n_records, score FROM s",
    "p6_found": f"WITH {TERMS}" + _DISTINCTIVE.format(r="doc_id") + "SELECT r AS doc_id, term FROM s WHERE tf >= 4 AND df <= 5",
    "p6_author_terms": f"WITH {TERMS}" + _DISTINCTIVE.format(r=_AUTHOR) + "SELECT r AS author, term, tf, df, n_records, score FROM s",
    "p2_found": _RUNS + "SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM s a JOIN m ON a.s = m.s JOIN s b ON b.s = m.s WHERE a.doc_id < b.doc_id",
    "p2_shared_share": _RUNS + """, c AS (SELECT doc_id, CAST(sum(least(120, coalesce(n - i, 120))) AS BIGINT) AS shared FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM s JOIN m USING (s)) GROUP BY doc_id)
        SELECT doc_id, length(text) AS n_chars, coalesce(shared, 0) AS shared_chars, coalesce(shared, 0) / nullif(length(text), 0) AS shared_share FROM t LEFT JOIN c USING (doc_id)""",
    "p2_classes": _RUNS + """, p AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM s a JOIN m ON a.s = m.s JOIN s b ON b.s = m.s WHERE a.doc_id <> b.doc_id), l AS (SELECT a AS doc_id, count(*) AS links FROM p GROUP BY a)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS class_id, count(*) OVER (PARTITION BY text) AS copies, coalesce(links, 0) AS links FROM t LEFT JOIN l USING (doc_id) WHERE text IS NOT NULL""",
    "p3_found": _RANKED + "SELECT phrase_no, cand_id FROM r WHERE k <= 3",
    "p3_ranked": _RANKED + "SELECT phrase_no, cand_id, phrase, sum_log_probs, CAST(k AS INTEGER) AS rank FROM r WHERE k <= 3",
}
