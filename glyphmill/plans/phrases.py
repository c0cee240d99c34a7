"""Queries on phrase and paraphrase tables. A phrase is a phrase number; candidates come once, whatever their deliveries."""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphmill.functions import text as X
from glyphmill.functions.textnorm import number_in
from glyphmill.operators import phrases as P
from glyphmill.operators.deliveries import one_delivery
from glyphmill.operators.scoring import candidate_round
from glyphmill.plans import base as B
from glyphmill.session import table

METHODS = ("mask_fill", "varlen_fill", "both")


def candidates(spark, d):  # noqa: ANN001, ANN201
    """Candidates with a phrase number and a finite score."""
    p = table(spark, d, "paraphrases").select("cand_id", "sample_id", number_in(F.col("phrase_num")).alias("phrase_num"), "phrase_type", "phrase_method", "phrase", "tokens", "num_tokens", "sum_log_probs").dropDuplicates(["cand_id"])
    return p.where("phrase_num is not null and sum_log_probs is not null and not isnan(sum_log_probs) and abs(sum_log_probs) < double('infinity')")


def _r(df):  # noqa: ANN001, ANN202
    return df.select(*[B.r6(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def phrase_pmf_llr(spark, d):  # noqa: ANN001, ANN201
    """Every candidate included that has tokens."""
    return _r(P.mass(candidates(spark, d), ["phrase_num"], "no_context", included=F.col("tokens").isNotNull()))


def phrase_softmax(spark, d):  # noqa: ANN001, ANN201
    return _r(P.softmax(candidates(spark, d), ["phrase_num"]).select("cand_id", "phrase_num", "pmf"))


def llr_excluded(spark, d):  # noqa: ANN001, ANN201
    e = P.excluded_ratio(candidates(spark, d), ["phrase_num"])
    return _r(e.select("phrase_num", "p_ref", "log_z", "llr_excl_nats", "llr_excl_log10", "p_two_bin"))


def llr_included(spark, d):  # noqa: ANN001, ANN201
    return _r(P.included_ratio(candidates(spark, d), ["phrase_num"]))


def rank_vs_best(spark, d):  # noqa: ANN001, ANN201
    return _r(P.against_best(candidates(spark, d), ["phrase_num"]))


def candidate_ranks(spark, d):  # noqa: ANN001, ANN201
    """Place of each paraphrase in its document's phrase."""
    c = candidates(spark, d).where("sample_id is not null")
    return P.rank_candidates(c, ["sample_id", "phrase_num"], "sum_log_probs", ["cand_id"]).select("sample_id", "phrase_num", "cand_id", "rank")


def candidate_ranks_all(spark, d):  # noqa: ANN001, ANN201
    """Place of each candidate among all of its phrase, the reference included."""
    return P.rank_candidates(candidates(spark, d), ["phrase_num"], "sum_log_probs", ["cand_id"], with_reference=True).select("phrase_num", "cand_id", "rank")


def _occurrences(spark, d):  # noqa: ANN001, ANN202
    """A sample stands for an occurrence of its phrase."""
    c = P.with_occurrences(candidates(spark, d).where("sample_id is not null"), ["phrase_num"], "sample_id")
    known = P.mass(c, ["phrase_num", "phrase_occurence"], "known").drop("num_phrases", "phrases_kept")
    return P.occurrence_llr(P.mass(c, ["phrase_num"], "no_context"), known, ["phrase_num"])


def llr_occurrences(spark, d):  # noqa: ANN001, ANN201
    return _r(_occurrences(spark, d).select("phrase_num", "phrase_occurence", "llr_no_context", "llr_known", "known_vs_no_context_nats", "known_vs_no_context_log10"))


def llr_occurrence_summary(spark, d):  # noqa: ANN001, ANN201
    """Sums by the leading digit of the phrase number: every occurrence, and each phrase once."""
    t = _occurrences(spark, d).withColumn("part", F.substring(F.col("phrase_num").cast("string"), 1, 1))
    return _r(P.summary_by_occurrence(t, ["part"], ["llr_known"]))


def include_phrase(spark, d):  # noqa: ANN001, ANN201
    """Candidates with the review of their text: texts of two or more tokens are included."""
    c = candidates(spark, d).where("phrase is not null")
    reviewed = c.where("tokens is not null").select("phrase_num", "phrase", (F.size("tokens") >= 2).alias("include_phrase"))
    return P.include_lookup(c.select("cand_id", "phrase_num", "phrase"), reviewed, ["phrase_num", "phrase"]).select("cand_id", F.coalesce(F.col("include_phrase").cast("string"), F.lit("")).alias("include_phrase"))


def token_level_raw(spark, d):  # noqa: ANN001, ANN201
    """Each phrase's ratio with the metadata of its run."""
    meta = spark.createDataFrame([("mlm", "unigram", "all", "test")], "paraphrasing_model string, scoring_model string, corpus string, data_type string")
    t = P.mass(candidates(spark, d), ["phrase_num"], "no_context").select("phrase_num", "num_phrases", "llr_no_context")
    return _r(P.with_metadata(t, meta))


def _llr(spark, d):  # noqa: ANN001, ANN202
    """A sheet for each method that made the paraphrases: its candidates and all references."""
    c = candidates(spark, d)
    sheets = {"no_context": P.mass(c, ["phrase_num"], "no_context")}
    for m in METHODS:
        sheets[m] = P.mass(c.where((F.col("phrase_type") == "reference") | (F.col("phrase_method") == m)), ["phrase_num"], m).drop("num_phrases", "phrases_kept")
    return P.llr_table(c.select("phrase_num").distinct(), ["phrase_num"], sheets)


def llr_table(spark, d):  # noqa: ANN001, ANN201
    t = _llr(spark, d)
    return _r(t.select("phrase_num", "num_phrases", "phrases_kept", "llr_no_context", *[f"llr_{m}" for m in METHODS]))


def llr_summary(spark, d):  # noqa: ANN001, ANN201
    """Sums over all phrases of a leading digit of the phrase number, in place of a document."""
    t = _llr(spark, d).withColumn("part", F.substring(F.col("phrase_num").cast("string"), 1, 1))
    return _r(P.summary(t, ["part"], ["llr_no_context", *[f"llr_{m}" for m in METHODS]]))


def token_threshold_rollup(spark, d):  # noqa: ANN001, ANN201
    """LLR sums for phrases of at least 1..10 reference tokens, by corpus of their first sample."""
    c = candidates(spark, d)
    size = c.where("phrase_type = 'reference'").groupBy("phrase_num").agg(F.max(F.size("tokens")).alias("n_tokens"), F.min("sample_id").alias("sample_id"))
    m = P.mass(c, ["phrase_num"], "no_context").join(size, "phrase_num").join(table(spark, d, "agg_metadata").groupBy("sample_id").agg(F.max("corpus").alias("corpus")), "sample_id")
    return _r(P.by_min_tokens(m, ["corpus"], "n_tokens", ["llr_no_context"], list(range(1, 11))))


def merged_methods(spark, d):  # noqa: ANN001, ANN201
    c = candidates(spark, d).where("phrase_type = 'paraphrase' and phrase is not null")
    return P.merged_methods(c, ["phrase_num"]).select("phrase_num", "phrase", "phrase_method", F.coalesce(F.size("tokens"), F.lit(0)).alias("n"))


def phrase_list(spark, d):  # noqa: ANN001, ANN201
    return P.phrase_list(table(spark, d, "paraphrases")).select("phrase", F.array_join("tokens", "|").alias("tokens"), "num_tokens")


def kept_phrases(spark, d):  # noqa: ANN001, ANN201
    """Candidates of the phrases whose reference is kept: here, those of at least four tokens."""
    c = candidates(spark, d)
    reviewed = P.phrase_list(table(spark, d, "paraphrases")).select("phrase", F.when(F.col("num_tokens") < 4, 0).when(F.col("num_tokens") < 8, 1).alias("keep_phrase"))
    return P.kept_by_list(c, reviewed, ["phrase_num"]).groupBy("phrase_num").agg(F.count(F.lit(1)).alias("n"))


def saturation(spark, d):  # noqa: ANN001, ANN201
    """Rounds are days of a phrase's runs; small phrases end with their last one."""
    p = table(spark, d, "paraphrases").select("cand_id", "run_at").dropDuplicates(["cand_id"])
    rounds = candidates(spark, d).where("phrase_type = 'paraphrase'").join(p, "cand_id").where("run_at is not null")
    rounds = rounds.select("phrase_num", F.datediff("run_at", F.lit("2023-01-01")).alias("round"), F.col("sum_log_probs").alias("log_prob"))
    return P.saturation(rounds, "phrase_num", 0.01, 2)


def pseudo_ll(spark, d):  # noqa: ANN001, ANN201
    """Candidates of a phrase and length by summed token scores (here the length of each token)."""
    c = candidates(spark, d).where("tokens is not null and phrase_type = 'paraphrase'")
    t = c.select("phrase_num", F.size("tokens").alias("n"), F.col("cand_id").alias("candidate"), F.explode("tokens").alias("t")).withColumn("log_prob", -1.0 / (F.length("t") + 1))
    return _r(P.pseudo_log_likelihood(t, ["phrase_num", "n"]))


def _position_candidates(c, at, k):  # noqa: ANN001, ANN202
    """The tokens at one place with the logarithm of their share as score."""
    n = c.select("phrase_num", at.alias("token")).groupBy("phrase_num", "token").agg(F.count(F.lit(1)).alias("n"))
    s = n.groupBy("phrase_num").agg(F.sum("n").alias("s"))
    return P.mask_candidates(n.join(s, "phrase_num").withColumn("lp", F.log(F.col("n") / F.col("s"))), ["phrase_num"], "token", "lp").withColumnRenamed("candidates", f"m{k}")


def _two_masks(c):  # noqa: ANN001, ANN202
    m = _position_candidates(c, F.element_at("tokens", 1), 0).join(_position_candidates(c, F.element_at("tokens", -1), 1), "phrase_num")
    return m.select("phrase_num", F.array("m0", "m1").alias("candidates"))


def beam_infill(spark, d):  # noqa: ANN001, ANN201
    """Two masks a phrase: candidates are the first and the last tokens of its paraphrases."""
    c = candidates(spark, d).where("size(tokens) >= 2")
    return P.beam(_two_masks(c), "phrase_num", 5).select("phrase_num", F.array_join("tokens", " ").alias("filled"), B.r6("log_prob").alias("log_prob"))


def variable_infill(spark, d):  # noqa: ANN001, ANN201
    """One mask and two masks a phrase together, by mean score a mask, without what only differs in case."""
    c = candidates(spark, d).where("size(tokens) >= 2")
    one = _position_candidates(c, F.element_at("tokens", 1), 0).select("phrase_num", F.array("m0").alias("candidates"))
    both = P.beam(one, "phrase_num", 5).unionByName(P.beam(_two_masks(c), "phrase_num", 5))
    return P.filled_phrases(both, "phrase_num").select("phrase_num", F.lower("text").alias("text"), B.r6("score").alias("score"))


def phrase_search(spark, d):  # noqa: ANN001, ANN201
    """Samples in which the commonest phrase stands (of equals the first by code points)."""
    c = candidates(spark, d).where("phrase is not null")
    top = c.groupBy(F.lower("phrase").alias("p")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "p").first()
    return P.find_phrase(c.where("sample_id is not null"), "sample_id", top.p if top else "")


def generated_round(spark, d):  # noqa: ANN001, ANN201
    """Each sample's candidates as one round of generation: tokens score -1/(length + 1), texts of two to eight tokens stay."""
    p = one_delivery(table(spark, d, "paraphrases"), "cand_id", "sample_id", "phrase", "tokens").where("sample_id is not null and phrase is not null and tokens is not null")
    rows = p.select("sample_id", F.col("cand_id").alias("ord"), F.col("phrase").alias("text"), F.transform("tokens", lambda t: -1.0 / (F.length(t) + 1)).alias("log_probs"))
    r = candidate_round(rows, "sample_id", 2, 8)
    return r.select("sample_id", "text", B.r6("total_logprob").alias("total_logprob"), "token_count")


def changed_tokens(spark, d):  # noqa: ANN001, ANN201
    """What paraphrases change in the first reference of their phrase, for those of as many tokens."""
    c = candidates(spark, d).where("tokens is not null")
    ref = c.where("phrase_type = 'reference'").groupBy("phrase_num").agg(F.min_by("tokens", "cand_id").alias("ref"))
    p = c.where("phrase_type = 'paraphrase'").join(ref, "phrase_num").where(F.size("tokens") == F.size("ref"))
    rows = p.select("cand_id", F.explode(X.changed_tokens(F.col("ref"), F.col("tokens"))).alias("x"))
    return rows.groupBy("cand_id").agg(F.count(F.lit(1)).alias("changed"), F.min("x.at").alias("first"), F.max("x.at").alias("last"))


def special_marks(spark, d):  # noqa: ANN001, ANN201
    """What the tokenizers of the candidates put before tokens."""
    p = one_delivery(table(spark, d, "paraphrases"), "cand_id", "tokens")
    mark = p.select(F.explode("tokens").alias("t")).select(X.leading_mark(F.col("t")).alias("mark"))
    return mark.where("mark is not null").groupBy("mark").agg(F.count(F.lit(1)).alias("n"))


def json_paraphrases(spark, d):  # noqa: ANN001, ANN201
    """Answers as a service would give them, put together from the table and parsed again."""
    c = candidates(spark, d).where("sample_id is not null and phrase is not null")
    rows = c.groupBy("sample_id", "phrase_num").agg(F.sort_array(F.collect_set("phrase")).alias("list"), F.min("phrase").alias("phrase"))
    answer = F.concat(F.lit("Here: "), F.to_json(F.struct(F.col("list").alias("paraphrases"))), F.lit(" done"))
    parsed = X.parse_paraphrases(F.array(F.lit("skip"), answer, F.lit("{broken")), F.col("phrase"))
    return rows.select("sample_id", "phrase_num", F.size(parsed).alias("n"), F.md5(F.array_join(F.sort_array(parsed), "|")).alias("digest"))


QUERIES = {f.__name__: f for f in (
    phrase_pmf_llr, phrase_softmax, llr_excluded, llr_included, rank_vs_best, candidate_ranks, candidate_ranks_all, llr_occurrences, llr_occurrence_summary, include_phrase, token_level_raw, llr_table, llr_summary, token_threshold_rollup, merged_methods, phrase_list, kept_phrases, saturation,
    pseudo_ll, beam_infill, variable_infill, phrase_search, json_paraphrases, generated_round, changed_tokens, special_marks,
)}

C = """c AS (SELECT * FROM (SELECT cand_id, any_value(sample_id) AS sample_id, TRY_CAST(nullif(regexp_extract(any_value(phrase_num), '[0-9]+'), '') AS BIGINT) AS phrase_num, any_value(phrase_type) AS phrase_type, any_value(phrase_method) AS phrase_method,
    any_value(phrase) AS phrase, any_value(tokens) AS tokens, any_value(run_at) AS run_at, any_value(sum_log_probs) AS lp FROM paraphrases GROUP BY cand_id) WHERE phrase_num IS NOT NULL AND isfinite(lp))"""


def _mass(name: str, where: str = "true", inc: str = "true") -> str:
    return f"""{name} AS (SELECT phrase_num, count(*) AS num_phrases, CAST(sum(CASE WHEN {inc} THEN 1 ELSE 0 END) AS BIGINT) AS phrases_kept, max(CASE WHEN phrase_type = 'reference' THEN lp END) AS ref_lp,
        coalesce(sum(CASE WHEN {inc} AND phrase_type = 'reference' THEN exp(lp) END) / nullif(sum(CASE WHEN {inc} THEN exp(lp) END), 0), 0) AS pmf FROM c WHERE {where} GROUP BY phrase_num)"""


_LLR = "CASE WHEN {p} > 0 THEN -log10({p}) ELSE 0 END"
_SHEETS = ",\n".join([_mass("m0"), *[_mass(f"s_{m}", f"(phrase_type = 'reference' OR phrase_method = '{m}')") for m in METHODS]])
_TABLE = "t AS (SELECT m0.phrase_num, m0.num_phrases, m0.phrases_kept, " + _LLR.format(p="m0.pmf") + " AS llr_no_context, " + ", ".join(f"CASE WHEN s_{m}.phrase_num IS NOT NULL THEN {_LLR.format(p=f's_{m}.pmf')} END AS llr_{m}" for m in METHODS) + " FROM m0 " + " ".join(f"LEFT JOIN s_{m} ON s_{m}.phrase_num = m0.phrase_num" for m in METHODS) + ")"
_COLS = ("llr_no_context", *[f"llr_{m}" for m in METHODS])
_LIST = "l AS (SELECT DISTINCT phrase, tokens, coalesce(len(tokens), 0) AS num_tokens FROM paraphrases WHERE phrase_type = 'reference' AND phrase IS NOT NULL)"
_EXCL = """t AS (SELECT phrase_num, max(CASE WHEN phrase_type = 'reference' THEN lp END) AS r, max(CASE WHEN phrase_type <> 'reference' THEN lp END) AS m, max(lp) AS top FROM c GROUP BY phrase_num),
        z AS (SELECT phrase_num, sum(CASE WHEN phrase_type <> 'reference' THEN exp(lp - m) END) AS z FROM c JOIN t USING (phrase_num) GROUP BY phrase_num),
        x AS (SELECT phrase_num, r, top + ln(coalesce(exp(r - top), 0) + coalesce(exp(m + ln(z) - top), 0)) AS log_z, CASE WHEN r IS NULL THEN NULL WHEN m IS NULL THEN CAST('infinity' AS DOUBLE) ELSE r - m - ln(z) END AS v FROM t LEFT JOIN z USING (phrase_num))"""
_SUMS = "coalesce(sum(CASE WHEN phrase_type = 'reference' THEN exp(lp) END) / nullif(sum(exp(lp)), 0), 0) AS pmf, max(CASE WHEN phrase_type = 'reference' THEN lp END) AS ref_lp"
_OCC = f"""cs AS (SELECT *, dense_rank() OVER (PARTITION BY phrase_num ORDER BY sample_id) AS phrase_occurence FROM c WHERE sample_id IS NOT NULL),
    n AS (SELECT phrase_num, count(*) AS kept, {_SUMS.replace('AS pmf', 'AS n_pmf').replace('AS ref_lp', 'AS n_lp')} FROM cs GROUP BY phrase_num),
    o AS (SELECT * FROM (SELECT phrase_num, phrase_occurence, {_SUMS} FROM cs GROUP BY ALL) JOIN n USING (phrase_num))"""
_BEAM = """w AS (SELECT phrase_num, tokens[1] AS t0, tokens[-1] AS t1 FROM c WHERE len(tokens) >= 2),
    p0 AS (SELECT phrase_num, t0 AS t, ln(count(*) / sum(count(*)) OVER (PARTITION BY phrase_num)) AS lp FROM w GROUP BY phrase_num, t0), p1 AS (SELECT phrase_num, t1 AS t, ln(count(*) / sum(count(*)) OVER (PARTITION BY phrase_num)) AS lp FROM w GROUP BY phrase_num, t1),
    c0 AS (SELECT * FROM p0 WHERE t IS NOT NULL QUALIFY row_number() OVER (PARTITION BY phrase_num ORDER BY lp DESC, t) <= 25), c1 AS (SELECT * FROM p1 WHERE t IS NOT NULL QUALIFY row_number() OVER (PARTITION BY phrase_num ORDER BY lp DESC, t) <= 25),
    b1 AS (SELECT phrase_num, t AS t0, round(lp, 12) AS lp FROM c0 WHERE lp >= -7 QUALIFY row_number() OVER (PARTITION BY phrase_num ORDER BY round(lp, 12) DESC, t) <= 5),
    b2 AS (SELECT phrase_num, t0, t AS t1, round(b1.lp + c1.lp, 12) AS lp FROM b1 JOIN c1 USING (phrase_num) WHERE c1.lp >= -7 QUALIFY row_number() OVER (PARTITION BY phrase_num ORDER BY round(b1.lp + c1.lp, 12) DESC, t0, t) <= 5)"""
SQL = {
    "phrase_pmf_llr": f"WITH {C}, {_mass('m', inc='tokens IS NOT NULL')} SELECT phrase_num, num_phrases, phrases_kept, round(ref_lp, 6) + 0.0 AS no_context_log_prob, round(pmf, 6) + 0.0 AS pmf_no_context, round({_LLR.format(p='pmf')}, 6) + 0.0 AS llr_no_context FROM m",
    "phrase_softmax": f"WITH {C} SELECT cand_id, phrase_num, round(exp(lp - m) / sum(exp(lp - m)) OVER (PARTITION BY phrase_num), 6) + 0.0 AS pmf FROM (SELECT *, max(lp) OVER (PARTITION BY phrase_num) AS m FROM c)",
    "llr_excluded": f"""WITH {C}, {_EXCL} SELECT phrase_num, round(exp(r - log_z), 6) + 0.0 AS p_ref, round(log_z, 6) + 0.0 AS log_z, round(v, 6) + 0.0 AS llr_excl_nats, round(v / ln(10), 6) + 0.0 AS llr_excl_log10, round(1 / (1 + exp(-v)), 6) + 0.0 AS p_two_bin FROM x""",
    "llr_included": f"WITH {C}, {_EXCL} SELECT phrase_num, round(exp(r - log_z), 6) + 0.0 AS p_incl, round(log_z - r, 6) + 0.0 AS llr_incl_nats, round((log_z - r) / ln(10), 6) + 0.0 AS llr_incl_log10 FROM x",
    "candidate_ranks_all": f"WITH {C} SELECT phrase_num, cand_id, CAST(row_number() OVER (PARTITION BY phrase_num ORDER BY lp DESC, cand_id) AS INTEGER) AS rank FROM c",
    "llr_occurrences": f"WITH {C}, {_OCC} SELECT phrase_num, phrase_occurence, round({_LLR.format(p='n_pmf')}, 6) + 0.0 AS llr_no_context, round({_LLR.format(p='pmf')}, 6) + 0.0 AS llr_known, round(ref_lp - n_lp, 6) + 0.0 AS known_vs_no_context_nats, round((ref_lp - n_lp) / ln(10), 6) + 0.0 AS known_vs_no_context_log10 FROM o",
    "llr_occurrence_summary": f"""WITH {C}, {_OCC}, v AS (SELECT *, {_LLR.format(p='n_pmf')} AS a, {_LLR.format(p='pmf')} AS k FROM o),
        w AS (SELECT left(CAST(phrase_num AS VARCHAR), 1) AS part, count(DISTINCT phrase_num) AS num_phrases, count(DISTINCT CASE WHEN kept > 0 THEN phrase_num END) AS phrases_kept, sum(a) AS llr_no_context, sum(CASE WHEN phrase_occurence = 1 THEN a END) AS llr_no_context_once, sum(k) AS llr_known FROM v GROUP BY part)
        SELECT part, num_phrases, phrases_kept, """ + ", ".join(f"round({c}, 6) + 0.0 AS {c}, round({c} / nullif(phrases_kept, 0), 6) + 0.0 AS normalised_{c}" for c in ("llr_no_context", "llr_no_context_once", "llr_known")) + " FROM w",
    "include_phrase": f"WITH {C}, r AS (SELECT phrase_num, phrase, bool_or(len(tokens) >= 2) AS include_phrase FROM c WHERE tokens IS NOT NULL AND phrase IS NOT NULL GROUP BY ALL) SELECT cand_id, coalesce(CAST(include_phrase AS VARCHAR), '') AS include_phrase FROM c LEFT JOIN r USING (phrase_num, phrase) WHERE phrase IS NOT NULL",
    "token_level_raw": f"WITH {C}, {_mass('m')} SELECT phrase_num, num_phrases, round({_LLR.format(p='pmf')}, 6) + 0.0 AS llr_no_context, 'mlm' AS paraphrasing_model, 'unigram' AS scoring_model, 'all' AS corpus, 'test' AS data_type FROM m",
    "beam_infill": f"WITH {C}, {_BEAM} SELECT phrase_num, t0 || ' ' || t1 AS filled, round(lp, 6) + 0.0 AS log_prob FROM b2",
    "variable_infill": f"WITH {C}, {_BEAM}, a AS (SELECT phrase_num, t0 AS text, lp AS score FROM b1 UNION ALL SELECT phrase_num, t0 || ' ' || t1, lp / 2 FROM b2) SELECT phrase_num, lower(text) AS text, round(max(score), 6) + 0.0 AS score FROM a WHERE trim(text) <> '' GROUP BY phrase_num, lower(text)",
    "rank_vs_best": f"WITH {C} SELECT phrase_num, round(max(CASE WHEN phrase_type = 'reference' THEN lp END) - max(lp), 6) + 0.0 AS ref_vs_top_rank, round(max(CASE WHEN phrase_type = 'reference' THEN lp END) - max(CASE WHEN phrase_type <> 'reference' THEN lp END), 6) + 0.0 AS ref_vs_best_rest FROM c GROUP BY phrase_num",
    "candidate_ranks": f"WITH {C} SELECT sample_id, phrase_num, cand_id, CAST(CASE WHEN phrase_type = 'reference' THEN 0 ELSE row_number() OVER (PARTITION BY sample_id, phrase_num, phrase_type ORDER BY lp DESC, cand_id) END AS INTEGER) AS rank FROM c WHERE sample_id IS NOT NULL",
    "llr_table": f"WITH {C}, {_SHEETS}, {_TABLE} SELECT phrase_num, num_phrases, phrases_kept, " + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in _COLS) + " FROM t",
    "llr_summary": f"WITH {C}, {_SHEETS}, {_TABLE}, s AS (SELECT left(CAST(phrase_num AS VARCHAR), 1) AS part, count(DISTINCT phrase_num) AS num_phrases, count(DISTINCT CASE WHEN phrases_kept > 0 THEN phrase_num END) AS phrases_kept, " + ", ".join(f"sum({c}) AS {c}" for c in _COLS)
        + " FROM t GROUP BY part) SELECT part, num_phrases, phrases_kept, " + ", ".join(f"round({c}, 6) + 0.0 AS {c}, round({c} / nullif(phrases_kept, 0), 6) + 0.0 AS normalised_{c}" for c in _COLS) + " FROM s",
    "token_threshold_rollup": f"""WITH {C}, {_mass('m')}, s AS (SELECT phrase_num, max(len(tokens)) AS n_tokens, min(sample_id) AS sample_id FROM c WHERE phrase_type = 'reference' GROUP BY phrase_num),
        a AS (SELECT sample_id, max(corpus) AS corpus FROM agg_metadata GROUP BY sample_id), x AS (SELECT corpus, n_tokens, {_LLR.format(p='pmf')} AS llr FROM m JOIN s USING (phrase_num) JOIN a USING (sample_id))
        SELECT corpus, CAST(t.k AS INTEGER) AS min_tokens, count(*) AS n_rows, round(sum(llr), 6) + 0.0 AS llr_no_context FROM x JOIN range(1, 11) AS t(k) ON n_tokens >= t.k GROUP BY corpus, t.k""",
    "merged_methods": f"WITH {C} SELECT phrase_num, phrase, CASE WHEN count(DISTINCT phrase_method) > 1 THEN 'both' ELSE min(phrase_method) END AS phrase_method, CAST(coalesce(len(arg_min_null(tokens, cand_id)), 0) AS INTEGER) AS n FROM c WHERE phrase_type = 'paraphrase' AND phrase IS NOT NULL GROUP BY phrase_num, phrase",
    "phrase_list": f"WITH {_LIST} SELECT phrase, array_to_string(tokens, '|') AS tokens, CAST(num_tokens AS INTEGER) AS num_tokens FROM l",
    "kept_phrases": f"WITH {C}, {_LIST}, k AS (SELECT phrase FROM l WHERE num_tokens >= 4), g AS (SELECT phrase_num FROM c JOIN k USING (phrase) WHERE phrase_type = 'reference') SELECT phrase_num, count(*) AS n FROM c JOIN g USING (phrase_num) GROUP BY phrase_num",
    "saturation": f"""WITH {C}, p AS (SELECT phrase_num, date_diff('day', DATE '2023-01-01', CAST(run_at AS DATE)) AS round, sum(exp(lp)) AS gain, count(*) AS n FROM c WHERE phrase_type = 'paraphrase' AND run_at IS NOT NULL GROUP BY ALL),
        z AS (SELECT *, CASE WHEN gain < 0.01::DOUBLE * sum(gain) OVER w THEN 1 ELSE 0 END AS poor, sum(n) OVER w AS total FROM p WINDOW w AS (PARTITION BY phrase_num ORDER BY round)),
        q AS (SELECT *, sum(poor) OVER (PARTITION BY phrase_num ORDER BY round ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) = 2 AS stop FROM z),
        e AS (SELECT phrase_num, coalesce(min(CASE WHEN stop THEN round END), max(round)) AS stop_round FROM q GROUP BY phrase_num)
        SELECT phrase_num, CAST(stop_round AS INTEGER) AS stop_round, CAST(total AS BIGINT) AS n_candidates FROM e JOIN q USING (phrase_num) WHERE round = stop_round""",
    "pseudo_ll": f"""WITH {C}, t AS (SELECT phrase_num, len(tokens) AS n, cand_id AS candidate, round(sum(-1.0::DOUBLE / (length(u) + 1)), 12) AS pll FROM (SELECT phrase_num, tokens, cand_id, unnest(tokens) AS u FROM c WHERE tokens IS NOT NULL AND phrase_type = 'paraphrase') GROUP BY ALL)
        SELECT phrase_num, CAST(n AS INTEGER) AS n, candidate, round(pll, 6) + 0.0 AS pll, CAST(row_number() OVER (PARTITION BY phrase_num, n ORDER BY pll DESC, candidate) AS INTEGER) AS rank FROM t""",
    "generated_round": r"""WITH p AS (SELECT cand_id, any_value(sample_id) AS sample_id, any_value(phrase) AS phrase, any_value(tokens) AS tokens FROM paraphrases GROUP BY cand_id),
        r AS (SELECT sample_id, cand_id, trim(regexp_replace(phrase, '\s+', ' ', 'g')) AS text, list_sum(list_transform(tokens, lambda t: CAST(-1.0 AS DOUBLE) / (length(t) + 1))) AS lp, len(tokens) AS n FROM p WHERE sample_id IS NOT NULL AND phrase IS NOT NULL AND tokens IS NOT NULL)
        SELECT sample_id, text, round(arg_min(lp, cand_id), 6) + 0.0 AS total_logprob, CAST(arg_min(n, cand_id) AS INTEGER) AS token_count FROM r WHERE text <> '' AND n BETWEEN 2 AND 8 GROUP BY sample_id, text""",
    "changed_tokens": f"""WITH {C}, rf AS (SELECT phrase_num, arg_min(tokens, cand_id) AS ref FROM c WHERE phrase_type = 'reference' AND tokens IS NOT NULL GROUP BY phrase_num),
        x AS (SELECT cand_id, unnest(list_filter(range(len(tokens)), lambda i: tokens[i + 1] IS DISTINCT FROM ref[i + 1])) AS i FROM c JOIN rf USING (phrase_num) WHERE phrase_type = 'paraphrase' AND tokens IS NOT NULL AND len(tokens) = len(ref))
        SELECT cand_id, count(*) AS changed, CAST(min(i) AS INTEGER) AS first, CAST(max(i) AS INTEGER) AS last FROM x GROUP BY cand_id""",
    "special_marks": r"""WITH p AS (SELECT unnest(any_value(tokens)) AS t, cand_id FROM paraphrases GROUP BY cand_id), m AS (SELECT substr(t, 1, 1) AS mark FROM p WHERE t <> '')
        SELECT mark, count(*) AS n FROM m WHERE regexp_matches(mark, '[^\p{L}\p{M}\p{N}\x00-\x7F]') OR mark IN ('Ġ', 'Ċ', 'ĉ', 'Č', '▁') GROUP BY mark""",
    "phrase_search": f"WITH {C}, t AS (SELECT lower(phrase) AS p FROM c WHERE phrase IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) SELECT sample_id, count(*) AS n FROM c JOIN t ON lower(phrase) = p WHERE sample_id IS NOT NULL GROUP BY sample_id",
    "json_paraphrases": f"""WITH {C}, g AS (SELECT sample_id, phrase_num, list(DISTINCT phrase) AS l, min(phrase) AS phrase FROM c WHERE sample_id IS NOT NULL AND phrase IS NOT NULL GROUP BY ALL),
        q AS (SELECT sample_id, phrase_num, list_sort(list_distinct(list_filter(list_transform(l, lambda s: lower(s)), lambda s: s <> lower(phrase)))) AS p FROM g)
        SELECT sample_id, phrase_num, CAST(len(p) AS INTEGER) AS n, md5(array_to_string(p, '|')) AS digest FROM q""",
}
