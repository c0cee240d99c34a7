"""Phrase and paraphrase tables: probability mass of the reference phrase, log-likelihood ratios, ranks and roll-ups.

All are conditional sums and maxima by phrase, combined in the map tasks; no window runs over a phrase's candidates where an
aggregate can answer, since one phrase may hold a large part of all rows.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.operators.running import running

#: Fixed value: the least probability kept when raw probabilities become logarithms.
LEAST_PROB = 1e-45


def as_log_prob(raw: Column) -> Column:
    """Natural logarithm of a probability, first brought into [1e-45, 1]."""
    return F.log(F.greatest(F.least(raw, F.lit(1.0)), F.lit(LEAST_PROB)))


def mass(df: DataFrame, keys: list[str], name: str, log_prob: str = "sum_log_probs", included: Column | None = None) -> DataFrame:
    """``(*keys, num_phrases, phrases_kept, pmf_<name>, llr_<name>, <name>_log_prob)``.

    pmf: probability of the included reference rows over that of all included rows, 0 where there is none; llr: -log10 of it, 0 for pmf 0.
    ``included`` null counts as not included; rows of null log-probability count as phrases only.
    """
    inc = F.coalesce(included, F.lit(False)) if included is not None else F.lit(True)
    prob = F.exp(F.col(log_prob))
    is_ref = F.col("phrase_type") == "reference"
    sums = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("num_phrases"), F.sum(inc.cast("int")).cast("bigint").alias("phrases_kept"),
        F.sum(F.when(inc & is_ref, prob)).alias("_ref"), F.sum(F.when(inc, prob)).alias("_all"), F.max(F.when(is_ref, F.col(log_prob))).alias(f"{name}_log_prob"),
    )
    pmf = F.coalesce(F.try_divide(F.col("_ref"), F.col("_all")), F.lit(0.0))
    return sums.withColumn(f"pmf_{name}", pmf).withColumn(f"llr_{name}", F.when(pmf > 0, -F.log10(pmf)).otherwise(0.0)).drop("_ref", "_all")


#: Log-probabilities are added up within steps of this width, in which their exponentials neither overflow nor vanish.
STEP = 200.0


def log_sum(df: DataFrame, keys: list[str], value: Column, out: str, *more: Column) -> DataFrame:
    """``(*keys, out, ...)``: logarithm of the sum of exp(value) by key (null without any value), and further aggregates ``more`` of the form sum, min or max.

    Values are first added up by (key, step) with the step's scale taken off, then the few steps of a key: two map-side combined aggregates, nothing is joined back.
    """
    low = F.floor(value / STEP)
    first = df.groupBy(*keys, low.alias("_step")).agg(F.sum(F.exp(value - low * STEP)).alias("_z"), *more)
    names = [c for c in first.columns if c not in (*keys, "_step", "_z")]
    z = F.struct(F.col("_step").alias("s"), F.col("_z").alias("z"))
    best = first.groupBy(*keys).agg(F.max("_step").alias("_top"), F.collect_list(F.when(F.col("_step").isNotNull(), z)).alias("_parts"), *[F.max(c).alias(c) for c in names])  # a key has few steps
    scaled = F.aggregate("_parts", F.lit(0.0), lambda a, p: a + p["z"] * F.exp((p["s"] - F.col("_top")) * STEP))
    return best.select(*keys, F.when(F.col("_top").isNotNull(), F.col("_top") * STEP + F.log(scaled)).alias(out), *names)


def softmax(df: DataFrame, keys: list[str], log_prob: str = "sum_log_probs", prior: str | None = None) -> DataFrame:
    """``df`` with ``pmf``: each row's share of its group; null log-probabilities weigh nothing. With ``prior`` probabilities are weighted by that column.

    A group's sum is one row, joined back once.
    """
    lp = F.col(log_prob) + (F.log(F.col(prior)) if prior else F.lit(0.0))
    sums = log_sum(df, keys, lp, "_all")
    return df.join(sums, keys).withColumn("pmf", F.coalesce(F.exp(lp - F.col("_all")), F.lit(0.0))).drop("_all")


def excluded_ratio(df: DataFrame, keys: list[str], log_prob: str = "sum_log_probs") -> DataFrame:
    """``(*keys, p_ref, log_z, llr_excl_nats, llr_excl_log10, odds, p_two_bin)``: reference against all paraphrases together.

    ``p_ref`` is the reference's share of all rows, ``log_z`` the logarithm of their summed probability. Without paraphrases the ratio is infinite and p is 1; without a reference all but log_z are null.
    """
    is_ref = F.col("phrase_type") == "reference"
    rows = df.where(F.col(log_prob).isNotNull())
    best = log_sum(rows, keys, F.when(~is_ref, F.col(log_prob)), "_rest", F.max(F.when(is_ref, F.col(log_prob))).alias("_ref"))
    inf = F.lit(float("inf"))
    nats = F.when(F.col("_ref").isNull(), None).when(F.col("_rest").isNull(), inf).otherwise(F.col("_ref") - F.col("_rest"))
    high = F.greatest("_ref", "_rest")
    log_z = high + F.log(F.coalesce(F.exp(F.col("_ref") - high), F.lit(0.0)) + F.coalesce(F.exp(F.col("_rest") - high), F.lit(0.0)))
    # the two-bin probability is 1 / (1 + e^-llr), which does not overflow
    return best.select(*keys, "_ref", log_z.alias("log_z"), nats.alias("llr_excl_nats")).select(
        *keys, F.exp(F.col("_ref") - F.col("log_z")).alias("p_ref"), "log_z", "llr_excl_nats", (F.col("llr_excl_nats") / F.log(F.lit(10.0))).alias("llr_excl_log10"), F.exp("llr_excl_nats").alias("odds"),
        F.when(F.col("llr_excl_nats").isNotNull(), 1 / (1 + F.exp(-F.col("llr_excl_nats")))).alias("p_two_bin"),
    )


def included_ratio(df: DataFrame, keys: list[str], log_prob: str = "sum_log_probs") -> DataFrame:
    """``(*keys, p_incl, llr_incl_nats, llr_incl_log10)``: the reference's share of all rows and its negative logarithm; null without a reference."""
    e = excluded_ratio(df, keys, log_prob)
    return e.select(*keys, F.col("p_ref").alias("p_incl"), (-F.log("p_ref")).alias("llr_incl_nats"), (-F.log10("p_ref")).alias("llr_incl_log10"))


def rank_candidates(df: DataFrame, keys: list[str], raw: str, ties: list[str], with_reference: bool = False) -> DataFrame:
    """``df`` with ``rank``: 0 for reference rows, paraphrases 1.. by ``raw`` descending, ties by the given columns; ``with_reference`` all rows compete, from 1.

    A phrase of any number of candidates is spread over tasks.
    """
    if with_reference:
        return running(df, keys, [F.desc_nulls_last(raw), *ties]).withColumn("rank", F.col("rank").cast("int"))
    placed = running(df.withColumn("_ref", F.coalesce(F.col("phrase_type") == "reference", F.lit(False))), [*keys, "_ref"], [F.desc_nulls_last(raw), *ties])
    return placed.withColumn("rank", F.when(F.col("_ref"), 0).otherwise(F.col("rank")).cast("int")).drop("_ref")


def against_best(df: DataFrame, keys: list[str], log_prob: str = "sum_log_probs") -> DataFrame:
    """``(*keys, ref_vs_top_rank, ref_vs_best_rest)``: reference log-probability minus that of the best row (at most 0) and of the best paraphrase."""
    is_ref = F.col("phrase_type") == "reference"
    ref = F.max(F.when(is_ref, F.col(log_prob)))
    return df.groupBy(*keys).agg((ref - F.max(log_prob)).alias("ref_vs_top_rank"), (ref - F.max(F.when(~is_ref, F.col(log_prob)))).alias("ref_vs_best_rest"))


def llr_table(base: DataFrame, keys: list[str], sheets: dict[str, DataFrame]) -> DataFrame:
    """Left joins of the sheets' tables to the base of phrases, with each sheet's log-probability relative to ``no_context``.

    Columns that a later sheet would bring again are dropped from it.
    """
    out = base
    for df in sheets.values():
        out = out.join(df.drop(*[c for c in df.columns if c in out.columns and c not in keys]), [k for k in keys if k in df.columns], "left")
    for name in sheets:
        if name != "no_context" and {f"{name}_log_prob", "no_context_log_prob"} <= set(out.columns):
            out = out.withColumn(f"{name}_vs_no_context_log_prob", F.col(f"{name}_log_prob") - F.col("no_context_log_prob"))
    return out


def summary(llr: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """``(by, num_phrases, phrases_kept, <sums>, normalised_<sums>)``: distinct phrases, those with kept candidates, sums (infinite values
    left out) and the sums by kept phrase."""
    finite = lambda c: F.when(F.abs(F.col(c)) < float("inf"), F.col(c))
    agg = llr.groupBy(*by).agg(
        F.countDistinct("phrase_num").alias("num_phrases"), F.countDistinct(F.when(F.col("phrases_kept") > 0, F.col("phrase_num"))).alias("phrases_kept"),
        *[F.sum(finite(c)).alias(c) for c in columns],
    )
    return agg.withColumns({f"normalised_{c}": F.try_divide(F.col(c), F.col("phrases_kept")) for c in columns})


def by_min_tokens(rows: DataFrame, keys: list[str], size: str, columns: list[str], thresholds: list[int]) -> DataFrame:
    """``(*keys, min_tokens, n_rows, <sums>)``: for each threshold the rows of at least that size.

    Rows are first added up by size, of which there are few; each size then counts for all thresholds up to it.
    """
    per_size = rows.where(F.col(size).isNotNull()).groupBy(*keys, F.col(size).alias("_size")).agg(F.count(F.lit(1)).alias("n_rows"), *[F.sum(c).alias(c) for c in columns])
    t = F.explode(F.filter(F.array(*[F.lit(int(x)) for x in sorted(thresholds)]), lambda x: x <= F.col("_size"))).alias("min_tokens")
    return per_size.select(*keys, t, "n_rows", *columns).groupBy(*keys, "min_tokens").agg(F.sum("n_rows").alias("n_rows"), *[F.sum(c).alias(c) for c in columns])


def with_occurrences(df: DataFrame, keys: list[str], place: str) -> DataFrame:
    """``df`` with ``phrase_occurence`` = 1, 2, ... for the distinct places of each phrase in their order (rows without a place get none)."""
    at = df.where(F.col(place).isNotNull()).select(*keys, place).distinct()
    numbered = running(at, keys, [place], rank="phrase_occurence")
    return df.join(numbered, [*keys, place], "left")


def occurrence_llr(no_context: DataFrame, in_context: DataFrame, keys: list[str], name: str = "known") -> DataFrame:
    """``(*keys, phrase_occurence, ...)``: the tables of ``mass`` without context and at each occurrence side by side, with the reference's log-probability in context relative to that without, in nats and
    in log10."""
    out = in_context.join(no_context, keys, "left")
    diff = F.col(f"{name}_log_prob") - F.col("no_context_log_prob")
    return out.withColumns({f"{name}_vs_no_context_nats": diff, f"{name}_vs_no_context_log10": diff / F.log(F.lit(10.0))})


def summary_by_occurrence(llr: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """``(*by, num_phrases, phrases_kept, llr_no_context, llr_no_context_once, <sums>, normalised_<sums>)``: sums over all occurrences; ``llr_no_context_once`` counts each phrase at its first
    occurrence only, as the workbook does, ``llr_no_context`` at every one."""
    once = llr.withColumn("llr_no_context_once", F.when(F.col("phrase_occurence") == 1, F.col("llr_no_context")))
    return summary(once, by, ["llr_no_context", "llr_no_context_once", *columns])


def include_lookup(df: DataFrame, reviewed: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with ``include_phrase`` from the reviewed rows of the same ``keys``; null where there is none. A key reviewed several times counts by its greatest value."""
    return df.join(reviewed.groupBy(*keys).agg(F.max("include_phrase").alias("include_phrase")), keys, "left")


def with_metadata(df: DataFrame, metadata: DataFrame) -> DataFrame:
    """Every row of a result with the columns of its metadata, which must be one row."""
    rows = metadata.limit(2).count()
    if rows != 1:
        raise ValueError("the metadata of a result is one row")
    new = [c for c in metadata.columns if c not in df.columns]
    return df.crossJoin(F.broadcast(metadata.select(*new)))  # one row


def merged_methods(df: DataFrame, keys: list[str], text: str = "phrase", method: str = "phrase_method", order: str = "cand_id") -> DataFrame:
    """One row for each text of a group: ``method`` is ``both`` where several methods found it, tokens are the first row's."""
    return df.groupBy(*keys, text).agg(
        F.when(F.countDistinct(method) > 1, F.lit("both")).otherwise(F.min(method)).alias(method), F.min_by("tokens", order).alias("tokens")
    )


def phrase_list(df: DataFrame) -> DataFrame:
    """Distinct reference phrases with their tokens, as the list to be reviewed."""
    return df.where("phrase_type = 'reference' and phrase is not null").select("phrase", "tokens").distinct().withColumn("num_tokens", F.coalesce(F.size("tokens"), F.lit(0)).cast("int"))


def kept_by_list(df: DataFrame, reviewed: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of phrases whose reference is kept in the reviewed list (keep_phrase 1 or null). An inner join as in the source: a phrase listed twice comes twice."""
    keep = reviewed.where("keep_phrase = 1 or keep_phrase is null").select("phrase")
    chosen = df.where("phrase_type = 'reference'").join(keep, "phrase").select(*keys)
    return df.join(chosen, keys)


def find_phrase(df: DataFrame, place: str, phrase: str | None = None, tokens: list[str] | None = None) -> DataFrame:
    """``(place, n)``: where a phrase (regardless of case) or a token sequence stands as a candidate, and how often."""
    if (phrase is None) == (tokens is None):
        raise ValueError("either a phrase or tokens")
    hit = F.lower("phrase") == phrase.lower() if phrase is not None else F.col("tokens") == F.array(*map(F.lit, tokens))
    return df.where(hit).groupBy(place).agg(F.count(F.lit(1)).alias("n"))


def saturation(rounds: DataFrame, key: str, eps: float = 0.01, patience: int = 2) -> DataFrame:
    """``(key, stop_round, n_candidates)``: the round after which new candidates no longer add mass.

    ``rounds`` is (key, round, log_prob) of distinct candidates. Z is their summed probability so far; a round is poor when its gain is less than eps of
    Z; the first run of ``patience`` poor rounds ends generation. Without one the last round stands.
    """
    from pyspark.sql import Window

    per = rounds.groupBy(key, "round").agg(F.sum(F.exp("log_prob")).alias("gain"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(key).orderBy("round")
    z = per.withColumn("z", F.sum("gain").over(w)).withColumn("poor", (F.col("gain") < eps * F.col("z")).cast("int"))
    tail = F.sum("poor").over(w.rowsBetween(-(patience - 1), 0))
    z = z.withColumn("stop", tail == patience).withColumn("total", F.sum("n").over(w))
    stop = z.groupBy(key).agg(F.coalesce(F.min(F.when(F.col("stop"), F.col("round"))), F.max("round")).alias("stop_round"))
    return stop.join(z, key).where("round = stop_round").select(key, "stop_round", F.col("total").alias("n_candidates"))


def mask_candidates(rows: DataFrame, key: list[str], token: str, log_prob: str, top: int = 25) -> DataFrame:
    """``(*key, candidates)``: the ``top`` likeliest tokens of each mask, ties by token. A mask of any number of candidates is ranked over tasks; what is gathered are ``top`` of them."""
    best = running(rows.where(F.col(token).isNotNull() & F.col(log_prob).isNotNull()), key, [F.desc(log_prob), token], rank="_rank").where(F.col("_rank") <= top)
    return best.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(F.col(token).alias("token"), F.col(log_prob).alias("log_prob")))).alias("candidates"))


def beam(masks: DataFrame, key: str, beam_size: int = 30, floor: float = -7.0) -> DataFrame:
    """``(key, tokens, log_prob)``: best fillings of several masks from the candidates of each, one mask after another, joint score the sum.

    ``masks`` is (key, candidates: array of arrays of (token, log_prob)), one inner array a mask. Candidates under ``floor`` are dropped; after each mask the
    best ``beam_size`` partial fillings are kept, ties by tokens. The beam is the method's own limit, as is each mask's candidate list.
    """
    import pyarrow as pa

    def fill(batches):  # noqa: ANN001, ANN202
        for b in batches:
            keys, tokens, scores = [], [], []
            for k, options in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                paths = [((), 0.0)]
                for mask in options or ():
                    good = [(c["token"], c["log_prob"]) for c in mask or () if c["log_prob"] is not None and c["log_prob"] >= floor]
                    paths = sorted((((*t, w), round(s + p, 12)) for t, s in paths for w, p in good), key=lambda x: (-x[1], x[0]))[:beam_size]
                if paths and paths[0][0]:
                    keys += [k] * len(paths)
                    tokens += [list(t) for t, _ in paths]
                    scores += [s for _, s in paths]
            yield pa.RecordBatch.from_arrays([pa.array(keys, b.column(0).type), pa.array(tokens, pa.list_(pa.string())), pa.array(scores, pa.float64())], names=[key, "tokens", "log_prob"])

    kind = masks.schema[key].dataType.simpleString()
    return masks.select(key, "candidates").mapInArrow(fill, f"{key} {kind}, tokens array<string>, log_prob double")


def filled_phrases(fillings: DataFrame, key: str, original: str | None = None, sep: str = " ") -> DataFrame:
    """``(key, text, tokens, log_prob, score)``: fillings of masks as phrases, of any number of masks: the score is the mean log-probability a mask.

    Of phrases equal without regard to case the best stays (ties: fewer masks, then tokens); blank ones, and those equal to column ``original``, are dropped.
    """
    text = F.array_join("tokens", sep)
    rows = fillings.withColumn("text", text).withColumn("score", F.col("log_prob") / F.size("tokens")).where(F.trim("text") != "")
    if original is not None:
        rows = rows.where(F.col(original).isNull() | (F.lower("text") != F.lower(original)))
    best = F.max(F.struct(F.col("score").alias("s"), (-F.size("tokens")).alias("m"), F.struct("text", "tokens", "log_prob", "score").alias("r"))).alias("b")
    return rows.groupBy(key, F.lower("text").alias("_low")).agg(best).select(key, "b.r.*")


def pseudo_log_likelihood(spans: DataFrame, key: list[str]) -> DataFrame:
    """``(*key, pll, rank)`` of same-length candidates at a span from per-position log-probabilities (rows of (key, candidate, log_prob)); sums are rounded to 12 places, so equal ones tie."""
    total = spans.groupBy(*key, "candidate").agg(F.round(F.sum("log_prob"), 12).alias("pll"))
    return running(total, key, [F.desc("pll"), "candidate"]).withColumn("rank", F.col("rank").cast("int"))


def join_all(frames: list[DataFrame], keys: list[str], how: str = "full") -> DataFrame:
    """Successive joins on the same keys, nulls meeting nulls; the other columns' names must differ."""
    def pair(a: DataFrame, b: DataFrame) -> DataFrame:
        right = b.withColumnsRenamed({k: f"_right_{k}" for k in keys})
        on = functools.reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
        rest = [c for c in [*a.columns, *b.columns] if c not in keys]
        return a.join(right, on, how).select(*[F.coalesce(k, f"_right_{k}").alias(k) for k in keys], *rest)

    return functools.reduce(pair, frames)
