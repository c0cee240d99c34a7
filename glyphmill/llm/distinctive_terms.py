"""How distinctive a term is of a record: length-normalised tf times smoothed logarithmic idf.

Document frequencies are counted with map-side combining and joined back by term. Terms of very many records would make hot keys in that join: they are joined
by broadcast where a count shows them to be few, else by a salted join; every other term meets its one frequency in a shuffle. A caller who wants only
terms of few records, or of many occurrences, says so, and the others are left out before anything is joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.session import cut

#: A term of more rows than this, and of more than 1/HOT of the records, is hot.
HOT_ROWS, HOT = 100_000, 100
#: As many hot terms at most are broadcast; beyond it each is cut into this many salted parts.
BROADCAST_TERMS, SALTS = 1_000_000, 64


def _joined(pairs: DataFrame, freq: DataFrame, hot: DataFrame | None) -> DataFrame:
    """``pairs`` with the frequency of their terms; ``hot`` are the hot ones of ``freq``."""
    if hot is None:
        return pairs.join(freq, "_t")
    if hot.count() > BROADCAST_TERMS:
        salted = freq.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        return pairs.withColumn("_salt", F.pmod(F.xxhash64("_r"), F.lit(SALTS)).cast("int")).join(salted, ["_t", "_salt"]).drop("_salt")
    with_hot = pairs.join(F.broadcast(hot), "_t", "left")
    known, rest = with_hot.where("df is not null"), with_hot.where("df is null").drop("df")
    return known.unionByName(rest.join(freq.join(F.broadcast(hot.select("_t")), "_t", "left_anti"), "_t"))


def tf_idf(counts: DataFrame, record: str, term: str = "term", tf: str = "tf", least_tf: int | None = None, most_df: int | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``(record, term, tf, df, n_records, score)`` for every distinct (record, term) of ``counts``, or those of at least ``least_tf`` and at most ``most_df``.

    score = tf / (terms in the record) x (ln((1 + n_records) / (1 + df)) + 1). ``counts`` has one row or several for a (record, term), whose
    tf are added; with columns ``length`` and ``first`` as ``doc_terms`` gives them it has one row each, and nothing is grouped by record. Null records or terms are
    left out. Empty input gives an empty result.
    """
    rows = counts.where(F.col(record).isNotNull() & F.col(term).isNotNull())
    if {"length", "first"} <= set(counts.columns):
        pairs = rows.select(F.col(record).alias("_r"), F.col(term).alias("_t"), F.col(tf).alias("tf"), "length", F.col("first").alias("_first"))
    else:
        summed = cut(rows.groupBy(F.col(record).alias("_r"), F.col(term).alias("_t")).agg(F.sum(tf).alias("tf")))
        lengths = summed.groupBy("_r").agg(F.sum("tf").alias("length"), F.min("_t").alias("_least"))
        pairs = summed.join(lengths, "_r").select("_r", "_t", "tf", "length", (F.col("_t") == F.col("_least")).cast("bigint").alias("_first"))
    freq = cut(pairs.groupBy("_t").agg(F.count(F.lit(1)).alias("df"), F.sum("_first").alias("_n")))
    n_records = freq.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n")).first()["n"]
    freq = freq.select("_t", "df")
    if most_df is not None:
        freq = freq.where(F.col("df") <= most_df)
    none_hot = most_df is not None and most_df <= hot_rows
    hot = None if none_hot else freq.where((F.col("df") > hot_rows) & (F.col("df") * HOT > n_records))
    if least_tf is not None:
        pairs = pairs.where(F.col("tf") >= least_tf)
    with_df = _joined(pairs.drop("_first"), freq, hot)
    score = F.col("tf") / F.col("length") * (F.log((F.lit(1.0) + n_records) / (F.lit(1.0) + F.col("df"))) + 1)
    return with_df.select(F.col("_r").alias(record), F.col("_t").alias("term"), "tf", "df", F.lit(n_records).cast("bigint").alias("n_records"), score.alias("score"))
