"""Kneser-Ney language models as tables: many models are trained and queried in one plan.

A query position asks a model for the grams that end there; one join with the model's statistics answers all of them.
What a position's contexts need is what the position before asked for, so a window over the sentence hands it on. The
recursion over lengths is a column expression.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.functions import text as X
from glyphmill.operators.ngrams import SEP, Flat, gram_statistics
from glyphmill.session import cut

STATS = ("cnt", "pre", "suc", "presuc", "ctx")


def train(sentences: DataFrame, model: str = "model_id", order: int = 3, tokens: str = "tokens") -> DataFrame:
    """Statistics of every model's grams of length 0..order, from its sentences."""
    if order < 2:
        raise ValueError("order must be at least 2")
    return gram_statistics(sentences, model, order, tokens)


def _asked(queries: DataFrame, keys: list[str], order: int) -> DataFrame:
    """``(*keys, pos, token, len, gram)``: the grams of length 1..order that end at each position, and once a sentence the empty one; position -1 is the last start mark."""
    kinds = [queries.schema[k].dataType.simpleString() for k in keys]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = Flat(b.column(len(keys)), order - 1, 1)
            for n in range(order + 1):
                last = np.flatnonzero((f.at >= order - 2) & (f.at >= n - 1) if n else f.at == order - 2)
                rows = pa.array(f.rows[last])
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(k).take(rows) for k in range(len(keys))), pa.array((f.at[last] - order + 1).astype(np.int32)), f.take(last), pa.array(np.full(len(last), n, np.int32)), f.joined(last - n + 1, n)],
                    names=[*keys, "pos", "token", "len", "gram"],
                )

    schema = ", ".join([*(f"`{k}` {t}" for k, t in zip(keys, kinds, strict=True)), "pos int", "token string", "len int", "gram string"])
    return queries.select(*keys, "tokens").mapInArrow(ask, schema)


def _answers(stats: DataFrame, queries: DataFrame, keys: list[str], order: int, model: str) -> DataFrame:
    asked = _asked(queries, keys, order)
    joined = asked.join(stats, [model, "len", "gram"], "left")
    # rows meet by sentence, which serves the aggregate by position and the window alike
    picks = [F.max(F.when(F.col("len") == n, F.col(s))).alias(f"g{n}_{s}") for n in range(order + 1) for s in STATS]
    at = joined.repartition(*keys).groupBy(*keys, "pos", "token").agg(*picks)
    w = Window.partitionBy(*keys).orderBy("pos")
    contexts = [F.lag(f"g{n}_{s}").over(w).alias(f"c{n}_{s}") for n in range(1, order) for s in STATS]
    whole = [F.max(f"g0_{s}").over(Window.partitionBy(*keys)).alias(f"c0_{s}") for s in STATS]
    return at.select("*", *contexts, *whole).where("pos >= 0")


def _zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0)).cast("double")


def simplified_kn(stats: DataFrame, queries: DataFrame, keys: list[str], order: int = 3, discount: float = 0.75, model: str = "model_id") -> DataFrame:
    """``(*keys, pos, token, p)``: interpolated Kneser-Ney with raw counts above the unigrams.

    An unknown context passes the shorter context's value on unchanged; p may be 0. ``keys`` name a query sentence and include the model.
    """
    out = _answers(stats, queries, keys, order, model)
    p = F.coalesce(F.try_divide(_zero("g1_pre"), _zero("c0_presuc")), F.lit(0.0))
    for k in range(1, order):
        seen = _zero(f"c{k}_ctx")
        upper = F.greatest(_zero(f"g{k + 1}_cnt") - discount, F.lit(0.0)) / seen + discount * _zero(f"c{k}_suc") / seen * p
        p = F.when(seen > 0, upper).otherwise(p)
    return out.select(*keys, "pos", "token", p.alias("p"))


def full_kn(stats: DataFrame, queries: DataFrame, keys: list[str], order: int = 3, discount: float = 0.5, model: str = "model_id") -> DataFrame:
    """``(*keys, pos, token, p)``: Kneser-Ney with continuation counts below the highest order and 1/V at its end.

    Where a context has been seen but never with a word on its left, the shorter context's value stands.
    """
    out = _answers(stats, queries, keys, order, model)
    vocabulary = _zero("c0_suc") + 1
    pairs = _zero("c0_presuc")
    star = F.greatest(_zero("g1_pre") - discount, F.lit(0.0)) / pairs + discount * _zero("c0_suc") / pairs / vocabulary
    star = F.when(pairs > 0, star).otherwise(1 / vocabulary)
    for k in range(1, order - 1):
        around = _zero(f"c{k}_presuc")
        upper = F.greatest(_zero(f"g{k + 1}_pre") - discount, F.lit(0.0)) / around + discount * _zero(f"c{k}_suc") / around * star
        star = F.when((_zero(f"c{k}_cnt") > 0) & (around > 0), upper).otherwise(star)
    top = order - 1
    seen = _zero(f"c{top}_cnt")
    p = F.when(seen > 0, F.greatest(_zero(f"g{order}_cnt") - discount, F.lit(0.0)) / seen + discount * _zero(f"c{top}_suc") / seen * star).otherwise(star)
    return out.select(*keys, "pos", "token", p.alias("p"))


def floored(p: Column) -> Column:
    return F.when(p > 0, p).otherwise(F.lit(X.FLOOR))


def perplexity(probabilities: DataFrame, keys: list[str]) -> DataFrame:
    """``(*keys, n, perplexity)``: 2 to the negative mean log2 of the floored probabilities."""
    return probabilities.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.pow(F.lit(2.0), -F.avg(F.log2(floored(F.col("p"))))).alias("perplexity"))


def _last(parts: Column, k: int) -> Column:
    """The last k words of an array as one string."""
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - k + 1, F.lit(1)), k), SEP) if k else F.lit("")


def _simplified_at(stats: DataFrame, rows: DataFrame, k: int, discount: float, model: str) -> DataFrame:
    """``rows`` (model, context of k words, word, ...) with ``p``, the value of ``simplified_kn`` for the word after the context."""
    total = stats.where("len = 0").select(model, F.col("presuc").alias("_all"))
    unigrams = stats.where("len = 1").select(model, F.col("gram").alias("word"), F.col("pre").alias("_pre"))
    out = rows.join(unigrams, [model, "word"], "left").join(total, model, "left").withColumn("p", F.coalesce(F.try_divide(_zero("_pre"), _zero("_all")), F.lit(0.0))).drop("_pre", "_all")
    for j in range(1, k + 1):
        out = out.withColumn("_c", _last(F.split("context", SEP), j)).withColumn("_g", F.concat_ws(SEP, "_c", "word"))
        seen = stats.where(F.col("len") == j).select(model, F.col("gram").alias("_c"), F.col("ctx").alias("_ctx"), F.col("suc").alias("_suc"))
        grams = stats.where(F.col("len") == j + 1).select(model, F.col("gram").alias("_g"), F.col("cnt").alias("_cnt"))
        out = out.join(seen, [model, "_c"], "left").join(grams, [model, "_g"], "left")
        upper = F.greatest(_zero("_cnt") - discount, F.lit(0.0)) / F.col("_ctx") + discount * F.col("_suc") / F.col("_ctx") * F.col("p")
        out = out.withColumn("p", F.when(F.col("_ctx") > 0, upper).otherwise(F.col("p"))).drop("_c", "_g", "_ctx", "_suc", "_cnt")
    return out


def _ranked(stats: DataFrame, need: DataFrame, k: int, discount: float, model: str) -> DataFrame:
    """``(model, context, word, p, rank)``: of the whole vocabulary the ``need`` likeliest words after each context of k words; ``need`` is (model, context, need)."""
    if k == 0:
        words = stats.where("len = 1 and cnt > 0").select(model, F.lit("").alias("context"), F.col("gram").alias("word"))
        rows = _simplified_at(stats, words, 0, discount, model).join(need.select(model, "need"), model)
    else:
        own = stats.where(F.col("len") == k).select(model, F.col("gram").alias("context"), F.when(F.col("ctx") > 0, F.col("suc")).otherwise(0).alias("_s"))
        # words unseen after a context keep the order they have after the shorter one, so its first need + seen words hold all that can come out
        wide = need.join(own, [model, "context"], "left").select(model, "context", "need", _last(F.split("context", SEP), k - 1).alias("_shorter"), (F.col("need") + F.coalesce("_s", F.lit(0))).alias("_wide"))
        below = _ranked(stats, wide.groupBy(model, F.col("_shorter").alias("context")).agg(F.max("_wide").alias("need")), k - 1, discount, model)
        places = wide.select(model, "context", "need", "_shorter", F.explode(F.sequence(F.lit(1), F.col("_wide").cast("int"))).alias("rank"))
        from_below = places.join(below.select(model, F.col("context").alias("_shorter"), "word", "rank"), [model, "_shorter", "rank"]).select(model, "context", "need", "word")
        w = F.split("gram", SEP)
        after = stats.where((F.col("len") == k + 1) & (F.col("cnt") > 0)).select(model, F.array_join(F.slice(w, 1, k), SEP).alias("context"), F.element_at(w, -1).alias("word"))
        seen = need.join(after, [model, "context"]).select(model, "context", "need", "word")
        rows = _simplified_at(stats, from_below.unionByName(seen).distinct(), k, discount, model)
    best = Window.partitionBy(model, "context").orderBy(F.desc("p"), "word")
    return rows.withColumn("rank", F.row_number().over(best)).where("rank <= need").select(model, "context", "word", "p", "rank")


def next_words(stats: DataFrame, contexts: DataFrame, n: int = 5, discount: float = 0.75, model: str = "model_id", order: int = 2) -> DataFrame:
    """``(model, context, word, p, rank)``: of a model's whole vocabulary the n likeliest words after each context, by the interpolated model of ``simplified_kn``.

    ``contexts`` is (model, context), a context being words joined by U+0001; no more than its last order - 1 words count, and a part of it that is not known
    passes to the shorter one. Words never seen after the context compete with those seen: each context meets the first n + (words seen after it) of
    the shorter context's ranking, down to the unigrams, never the whole vocabulary. Fewer than n rows come out only where the vocabulary is smaller; equal p go to the first word.
    """
    words = F.filter(F.split("context", SEP), lambda w: w != "")
    asked = contexts.select(model, "context").distinct().withColumn("_used", _last(words, order - 1)).withColumn("_k", F.least(F.size(words), F.lit(order - 1)))
    tops = []
    for k in range(order):
        need = asked.where(F.col("_k") == k).select(model, F.col("_used").alias("context"), F.lit(n).alias("need")).distinct()
        tops.append(_ranked(stats, need, k, discount, model))
    top = tops[0]
    for t in tops[1:]:
        top = top.unionByName(t)
    return asked.select(model, F.col("context").alias("_asked"), F.col("_used").alias("context")).join(top, [model, "context"]).select(model, F.col("_asked").alias("context"), "word", "p", "rank")


def _draw_tables(stats: DataFrame, order: int, discount: float, model: str) -> tuple[DataFrame, DataFrame]:
    """``(model, len, context, word, lo, hi)`` and ``(model, len, context, own, den, left)``: what each context of the full model gives out itself, laid end to end
    by word, and its sum, divisor and left-over for the shorter context. Length -1 is the uniform distribution over the vocabulary and the unknown word."""
    w = F.split("gram", SEP)
    head = lambda k: F.array_join(F.slice(w, 1, k), SEP) if k else F.lit("")
    parts = stats.where("len = 1 and cnt > 0").select(model, F.lit(-1).alias("len"), F.lit("").alias("context"), F.col("gram").alias("word"), F.lit(1.0).alias("weight"))
    parts = parts.unionByName(stats.where("len = 0").select(model, F.lit(-1).alias("len"), F.lit("").alias("context"), F.lit(X.UNKNOWN).alias("word"), F.lit(1.0).alias("weight")))
    for k in range(order):
        count = F.col("cnt" if k == order - 1 else "pre")
        own = stats.where((F.col("len") == k + 1) & (count > discount))
        parts = parts.unionByName(own.select(model, F.lit(k).alias("len"), head(k).alias("context"), F.element_at(w, -1).alias("word"), (count - discount).alias("weight")))
    keys = [model, "len", "context"]
    along = Window.partitionBy(*keys).orderBy("word")
    draws = parts.withColumn("hi", F.sum("weight").over(along.rowsBetween(Window.unboundedPreceding, 0))).withColumn("lo", F.coalesce(F.lag("hi").over(along), F.lit(0.0)))
    draws = cut(draws.select(*keys, "word", "lo", "hi"))
    # a context counts where it has been seen; below the highest order also only with a word on its left
    den = F.when(F.col("len") == order - 1, F.col("cnt")).when((F.col("len") == 0) | (F.col("cnt") > 0), F.col("presuc"))
    known = stats.where(F.col("len") < order).select(model, "len", F.col("gram").alias("context"), den.cast("double").alias("den"), (discount * F.col("suc")).alias("left")).where("den > 0")
    heads = known.join(draws.where("len >= 0").groupBy(*keys).agg(F.max("hi").alias("own")), keys, "left").select(*keys, F.coalesce("own", F.lit(0.0)).alias("own"), "den", "left")
    base = draws.where("len = -1").groupBy(*keys).agg(F.max("hi").alias("own")).select(*keys, "own", F.col("own").alias("den"), F.lit(0.0).alias("left"))
    return draws, cut(heads.unionByName(base))


def generate(stats: DataFrame, models: DataFrame, steps: int = 20, seed: str = "0", model: str = "model_id", order: int = 2, discount: float = 0.5) -> DataFrame:
    """``(model, tokens)``: for each model a sentence drawn word by word from the probabilities of ``full_kn``, at most ``steps`` words long.

    From the longest context down, a draw takes one of the context's own words by discounted count or passes with the left-over mass to the shorter one, and at
    last to all words alike, so any word of the vocabulary, a start mark or the unknown word can come; marks are left out of the result.
    Where a context's probabilities do not add up to one they are divided by their sum. The draw at each step is fixed by md5 of seed, model and step, so a run can
    be repeated. A model without sentences gives none.
    """
    draws, heads = _draw_tables(stats, order, discount, model)
    levels = range(-1, order)
    now = models.select(model, F.array_repeat(F.lit(X.PAD_START), order - 1).alias("tokens"))
    for step in range(steps):
        u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col(model).cast("string"), F.lit(step))), 1, 13), 16, 10).cast("double") / float(1 << 52)
        asked = now.select(model, "tokens", F.explode(F.array(*[F.struct(F.lit(k).alias("len"), _last(F.col("tokens"), max(k, 0)).alias("context")) for k in levels])).alias("c")).select(model, "tokens", "c.*")
        of = lambda k, c: F.max(F.when(F.col("len") == k, F.col(c)))
        at = asked.join(heads, [model, "len", "context"], "left").groupBy(model, "tokens").agg(*[of(k, c).alias(f"{c}_{k + 1}") for k in levels for c in ("own", "den", "left")])
        size, wholes = F.lit(1.0), []
        for k in range(order):
            own, den, rest = (F.col(f"{c}_{k + 1}") for c in ("own", "den", "left"))
            wholes.append(own + rest * size)
            size = F.when(den.isNotNull(), wholes[k] / den).otherwise(size)
        at = at.select("*", u.alias("u"), *[x.alias(f"whole_{k}") for k, x in enumerate(wholes)])
        # what is left of u beyond a context's own words is stretched over the shorter context
        level, place = F.lit(None).cast("int"), F.lit(None).cast("double")
        for k in reversed(range(order)):
            own, whole = F.col(f"own_{k + 1}"), F.col(f"whole_{k}")
            x = F.col("u") * whole
            here = level.isNull() & F.col(f"den_{k + 1}").isNotNull()
            at = at.select("*", F.when(here & (x < own), k).otherwise(level).alias(f"level_{k}"), F.when(here & (x < own), x).otherwise(place).alias(f"place_{k}"), F.when(here & (x >= own), F.coalesce(F.try_divide(x - own, whole - own), F.lit(0.0))).otherwise(F.col("u")).alias("_u")).drop("u").withColumnRenamed("_u", "u")
            level, place = F.col(f"level_{k}"), F.col(f"place_{k}")
        at = at.select(model, "tokens", F.coalesce(level, F.lit(-1)).alias("len"), F.coalesce(place, F.col("u") * F.col("own_0")).alias("x"))
        used = F.lit("")
        for k in range(1, order):
            used = F.when(F.col("len") == k, _last(F.col("tokens"), k)).otherwise(used)
        picked = at.withColumn("context", used).alias("a").join(draws.alias("d"), [F.col(f"a.{c}") == F.col(f"d.{c}") for c in (model, "len", "context")] + [F.col("x") >= F.col("lo"), F.col("x") < F.col("hi")], "left")
        ended = (F.size("a.tokens") > 0) & (F.element_at("a.tokens", -1) == X.PAD_END) | F.col("d.word").isNull()
        now = cut(picked.select(F.col(f"a.{model}").alias(model), F.when(ended, F.col("a.tokens")).otherwise(F.concat("a.tokens", F.array("d.word"))).alias("tokens")))
    return now.select(model, F.filter("tokens", lambda t: ~t.isin(X.PAD_START, X.PAD_END)).alias("tokens"))
