"""Where a neural scorer plugs in: texts in, token and log-probability arrays out, in batches on the executors.

A scorer is made by a factory that each task calls once, on the executor (a factory of a large model may cache it in its module); it takes a list of texts and gives, for each, its
tokens, their natural-log probabilities and optionally the medians of the vocabulary's log-probabilities at each place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.functions import text as X
from glyphmill.operators.phrases import rank_candidates

Scored = tuple[list[str], list[float], list[float]]
Scorer = Callable[[list[str]], list[Scored]]


def score_texts(df: DataFrame, text: str, factory: Callable[[], Scorer], key: str) -> DataFrame:
    """``(key, tokens, log_probs, med_log_prob)`` of each text; null texts count as empty ones. Other columns are ignored."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = factory()
        for b in batches:
            rows = scorer([t if isinstance(t, str) else "" for t in b["_text"]])
            yield pd.DataFrame({key: b[key], "tokens": [r[0] for r in rows], "log_probs": [r[1] for r in rows], "med_log_prob": [r[2] for r in rows]})

    return df.select(key, F.col(text).alias("_text")).mapInPandas(run, f"`{key}` {kind}, tokens array<string>, log_probs array<double>, med_log_prob array<double>")


def embed_texts(df: DataFrame, text: str, factory: Callable[[], Callable[[list[str]], list[list[float]]]], key: str, out: str = "embedding") -> DataFrame:
    """``(key, out)``: the vector of each text by an embedding model, made by its factory on the executor; null texts count as empty ones."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for b in batches:
            yield pd.DataFrame({key: b[key], out: model([t if isinstance(t, str) else "" for t in b["_text"]])})

    return df.select(key, F.col(text).alias("_text")).mapInPandas(run, f"`{key}` {kind}, `{out}` array<double>")


def candidate_round(rows: DataFrame, key: str, least: int = 1, most: int | None = None, prompt: str | None = None) -> DataFrame:
    """``(key, text, total_logprob, token_count)``: one round of generated candidates of each gap: texts trimmed and each once, those of too few or too many tokens dropped.

    ``rows`` is (key, ord, text, log_probs); with ``prompt``, a column of the number of prompt tokens, only the log-probabilities after these count. Of equal texts the first by ``ord`` stays.
    """
    span = F.col("log_probs") if prompt is None else F.slice("log_probs", F.col(prompt) + 1, F.greatest(F.size("log_probs") - F.col(prompt), F.lit(0)))
    scored = rows.select(key, "ord", X.collapsed(F.col("text")).alias("text"), F.aggregate(span, F.lit(0.0), lambda a, x: a + x).alias("total_logprob"), F.size(span).alias("token_count"))
    kept = scored.where((F.col("text") != "") & (F.col("token_count") >= least) & (F.col("token_count") <= most if most is not None else F.lit(True)))
    first = kept.groupBy(key, "text").agg(F.min(F.struct("ord", "total_logprob", "token_count")).alias("f"))
    return first.select(key, "text", "f.total_logprob", "f.token_count")


def scored_sentences(df: DataFrame, text: str, factory: Callable[[], Scorer], key: str) -> DataFrame:
    """``df`` with the scorer's arrays and the measures taken from them (differences to the median, sums, means, perplexity)."""
    s = score_texts(df, text, factory, key).withColumn("_m", X.token_differences(F.col("log_probs"), F.col("med_log_prob")))
    return df.join(s.select(key, "tokens", "log_probs", "med_log_prob", "_m.*"), key)


def exploded(phrases: DataFrame) -> DataFrame:
    """One row a candidate from ``(phrase_num, phrase, paraphrases)``: the reference first, then its distinct paraphrases in order."""
    pairs = F.concat(
        F.array(F.struct(F.lit("reference").alias("phrase_type"), F.col("phrase").alias("phrase"))),
        F.transform(F.coalesce("paraphrases", F.array().cast("array<string>")), lambda p: F.struct(F.lit("paraphrase").alias("phrase_type"), p.alias("phrase"))),
    )
    return phrases.select("phrase_num", F.col("phrase").alias("original_phrase"), F.posexplode(F.array_distinct(pairs)).alias("ord", "c")).select("phrase_num", "original_phrase", "ord", "c.phrase_type", "c.phrase")


def regrouped(candidates: DataFrame) -> DataFrame:
    """``(phrase_num, phrase, paraphrases)`` again from candidate rows, to score a finished result anew. A phrase's candidates are bounded by its generator."""
    is_ref = F.col("phrase_type") == "reference"
    return candidates.groupBy("phrase_num").agg(F.max(F.when(is_ref, F.col("phrase"))).alias("phrase"), F.sort_array(F.collect_set(F.when(~is_ref, F.col("phrase")))).alias("paraphrases"))


def numbered_phrases(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` with ``phrase_num`` = phrase_01, phrase_02, ..., padded to the digits of the number of rows; order columns should be unique."""
    from glyphmill.operators.numbering import number_rows

    n = number_rows(df, "_n", *order)
    digits = F.length(n.agg(F.count(F.lit(1)).cast("string")).scalar())
    return n.withColumn("phrase_num", F.concat(F.lit("phrase_"), F.call_function("lpad", F.col("_n").cast("string"), digits, F.lit("0")))).drop("_n")


def score_no_context(phrases: DataFrame, factory: Callable[[], Scorer]) -> DataFrame:
    """Candidates scored by themselves, with ``sum_log_probs``, ``raw_prob`` and their rank in the phrase."""
    c = exploded(phrases).withColumn("_k", F.concat_ws("|", "phrase_num", F.col("ord").cast("string")))
    s = score_texts(c, "phrase", factory, "_k").select("_k", "tokens", "log_probs", F.aggregate("log_probs", F.lit(0.0), lambda a, x: a + x).alias("sum_log_probs"))
    return rank_candidates(c.join(s, "_k").withColumn("raw_prob", F.exp("sum_log_probs")), ["phrase_num"], "raw_prob", ["ord"]).drop("_k")


def score_in_context(phrases: DataFrame, text: str, factory: Callable[[], Scorer]) -> DataFrame:
    """Each candidate after the text that stands before each occurrence of its reference phrase.

    The prefix is scored once for each occurrence, prefix and candidate together once for each candidate; the phrase's own log-probabilities
    are those after the prefix's tokens. ``text`` is the document, a phrase that does not occur follows the whole of it.
    """
    # texts are lower-cased, as the phrases' occurrences are found without regard to case
    before = phrases.select("phrase_num", F.posexplode(X.occurrence_prefixes(F.lit(text), F.col("phrase"))).alias("_o", "base")).select("phrase_num", (F.col("_o") + 1).alias("phrase_occurence"), "base")
    before = before.withColumn("_b", F.concat_ws("|", "phrase_num", F.col("phrase_occurence").cast("string")))
    base = score_texts(before, "base", factory, "_b").select("_b", F.size("tokens").alias("n_base"), F.aggregate("log_probs", F.lit(0.0), lambda a, x: a + x).alias("sum_log_probs_base"))
    rows = before.join(base, "_b").join(exploded(phrases), "phrase_num").withColumn("_k", F.concat_ws("|", "_b", F.col("ord").cast("string"))).withColumn("_full", F.concat("base", F.col("phrase")))
    full = score_texts(rows, "_full", factory, "_k").withColumnRenamed("tokens", "_t")
    rest = lambda c: F.slice(c, F.col("n_base") + 1, F.greatest(F.size(c) - F.col("n_base"), F.lit(0)))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    out = rows.join(full, "_k").select(
        "phrase_num", "phrase_occurence", "original_phrase", "phrase_type", "phrase", "ord", rest("_t").alias("tokens"), "sum_log_probs_base", total("log_probs").alias("sum_log_probs_inc_phrase"),
        rest("log_probs").alias("phrase_log_probs"),
    )
    out = out.withColumn("difference", F.col("sum_log_probs_inc_phrase") - F.col("sum_log_probs_base")).withColumn("sum_log_probs_phrase", total("phrase_log_probs"))
    return rank_candidates(out.withColumn("raw_prob", F.exp("sum_log_probs_phrase")), ["phrase_num", "phrase_occurence"], "raw_prob", ["ord"]).drop("ord")
