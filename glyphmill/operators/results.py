"""Roll-ups of results across problems, corpora and models."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.operators.phrases import join_all
from glyphmill.operators.running import running


def mean_scores(df: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """Mean score by key, repetitions taken together; rows with a null key are left out."""
    return df.dropna(subset=keys).groupBy(*keys).agg(F.avg(score).alias(score))


def complete_problems(df: DataFrame, group: list[str], problem: str = "problem", doc: str = "sample_id") -> DataFrame:
    """``(*group, problem, n_docs)``: problems that have as many documents as the fullest problem of their group."""
    n = df.groupBy(*group, problem).agg(F.countDistinct(doc).alias("n_docs"))
    most = n.groupBy(*group).agg(F.max("n_docs").alias("n_docs"))
    return n.join(most, [*group, "n_docs"]).select(*group, problem, "n_docs")


def both_classes(df: DataFrame, keys: list[str], problem: str = "problem") -> DataFrame:
    """``(*keys, n_false, n_true)``: distinct problems by target, 0 where there is none."""
    t = df.groupBy(*keys).pivot("target", [False, True]).agg(F.countDistinct(problem))
    return t.fillna(0).withColumnsRenamed({"false": "n_false", "true": "n_true"})


def merge_models(frames: dict[str, DataFrame], keys: list[str], metrics: list[str]) -> DataFrame:
    """One row a key with each model's metrics as ``<metric>_<model>``; keys missing in a model have nulls."""
    return join_all([df.select(*keys, *[F.col(m).alias(f"{m}_{name}") for m in metrics]) for name, df in frames.items()], keys)


def by_prefix(df: DataFrame, keys: list[str], prefixes: list[str]) -> DataFrame:
    """Non-null count and sum of every column that begins with one of the prefixes."""
    cols = [c for c in df.columns if any(c.startswith(p) for p in prefixes)]
    return df.groupBy(*keys).agg(*[x for c in cols for x in (F.count(c).alias(f"{c}_count"), F.sum(c).alias(f"{c}_sum"))])


def mean_then_sum(df: DataFrame, inner: list[str], outer: list[str], value: str, out: str) -> DataFrame:
    """Mean over the inner key first, then the sum of these means by the outer key."""
    return df.groupBy(*inner).agg(F.avg(value).alias("_m")).groupBy(*outer).agg(F.sum("_m").alias(out))


def describe(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """count, mean, std, min, quartiles (exact, linear interpolation) and max of a column by key. Null values count nowhere.

    Equal values are counted together and ranked by range partitions; a quartile is made of the one or two values at its place.
    """
    d = df.groupBy(*keys).agg(F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    per = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_x")).agg(F.count(F.lit(1)).alias("_c"))
    sizes = per.groupBy(*keys).agg(F.sum("_c").alias("_size"))
    placed = running(per, keys, ["_x"], {"_upto": "_c"}, "_rank")
    placed = placed.join(sizes, keys) if keys else placed.crossJoin(sizes)  # one row a group
    picks = []
    for name, q in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75)):
        at = (F.col("_size") - 1) * q
        holds = lambda r: (r < F.col("_upto")) & (r >= F.col("_upto") - F.col("_c"))
        low, high = (F.max(F.when(holds(r), F.col("_x"))) for r in (F.floor(at), F.ceil(at)))
        picks.append((low + (high - low) * (F.max(at) - F.max(F.floor(at)))).alias(name))
    out = d.join(placed.groupBy(*keys).agg(*picks), keys, "left") if keys else d.crossJoin(placed.groupBy().agg(*picks))
    return out.select(*keys, "count", "mean", "std", "min", "q25", "q50", "q75", "max")


def histogram(df: DataFrame, value: str, bins: int = 30, by: str | None = None) -> DataFrame:
    """``([by,] bin, low, high, n)``: equal bins between minimum and maximum of all rows; the last one is closed, empty ones are listed."""
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    ends = rows.agg(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"))
    r = ends.first()
    if r is None or r.lo is None:
        return df.sparkSession.createDataFrame([], f"{'' if by is None else by + ' ' + df.schema[by].dataType.simpleString() + ', '}bin int, low double, high double, n bigint")
    width = (r.hi - r.lo) / bins or 1.0
    b = F.least(F.floor((F.col(value) - r.lo) / width).cast("int"), F.lit(bins - 1))
    keys = [by] if by else []
    counts = rows.groupBy(*keys, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = (rows.select(*keys).distinct() if by else df.sparkSession.range(1).select()).select(*keys, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    full = grid.join(counts, [*keys, "bin"], "left").fillna(0, ["n"])
    return full.select(*keys, "bin", (r.lo + F.col("bin") * width).alias("low"), (r.lo + (F.col("bin") + 1) * width).alias("high"), "n")


def labelled_errors(df: DataFrame, truth: str = "y_true", predicted: str = "y_pred") -> DataFrame:
    """``error``: TP, FP, FN or TN; null where either side is null."""
    t, p = F.col(truth), F.col(predicted)
    return df.withColumn("error", F.when(t & p, "TP").when(~t & p, "FP").when(t & ~p, "FN").when(~t & ~p, "TN"))


def stratified(df: DataFrame, strata: list[str], ident: str, share: float = 0.6, seed: str = "42") -> DataFrame:
    """``df`` with ``part``: of each stratum the first ``share`` by md5 order is ``train``, the rest ``test``."""
    placed = running(df.withColumn("_h", F.md5(F.concat_ws("|", F.lit(seed), F.col(ident).cast("string")))), strata, ["_h", ident], rank="_rank")
    sizes = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("_size")).withColumnsRenamed({c: f"_k_{c}" for c in strata})
    same = functools.reduce(operator.and_, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in strata])
    out = placed.join(sizes, same)
    return out.select(*df.columns, F.when(F.col("_rank") <= F.floor(F.col("_size") * share + 0.5), "train").otherwise("test").alias("part"))
