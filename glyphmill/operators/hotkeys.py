"""Per-key results when a few keys hold most records: combine in the map tasks, shuffle only compact partial states.

Every aggregate here is algebraic, so each map task folds its rows into one partial row a key before the shuffle (Spark's
hash aggregate does so in bounded memory: it falls back to sorted runs on disk when its table is full). A key of a third of all rows sends one row a
task, whatever its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions.textnorm import clean_key, clean_term_col
from glyphmill.operators.deliveries import one_delivery
from glyphmill.session import cut


def key_totals(df: DataFrame, key: Column, value: Column | None = None, out: str = "key_text") -> DataFrame:
    """``(out, records[, total])`` for every distinct non-null key: how many rows it has and the sum of ``value`` (nulls add nothing).

    Empty input gives an empty result; ties and repeated rows are counted as they stand.
    """
    rows = df.select(key.alias(out), *([value.alias("_v")] if value is not None else [])).where(F.col(out).isNotNull())
    aggs = [F.count(F.lit(1)).alias("records")]
    if value is not None:
        aggs.append(F.coalesce(F.sum("_v"), F.lit(0)).alias("total"))
    return rows.groupBy(out).agg(*aggs)


def author_totals(docs: DataFrame) -> DataFrame:
    """``(key_text, records, total)`` by clean author: documents and tokens. Documents of null or blank author are no key."""
    return key_totals(one_delivery(docs, "doc_id", "author", "num_tokens"), clean_key(F.col("author")), F.col("num_tokens").cast("bigint"))


def term_totals(docs: DataFrame) -> DataFrame:
    """``(key_text, total)`` by term: occurrences over all documents.

    Raw tokens are counted first, so each distinct token is folded once for all its occurrences; the forms are then added up.
    """
    raw = one_delivery(docs, "doc_id", "tokens").select(F.explode("tokens").alias("token")).where("token <> ''")
    counts = raw.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    terms = counts.select(clean_term_col(F.col("token")).alias("key_text"), "n").where("key_text is not null")
    return terms.groupBy("key_text").agg(F.sum("n").alias("total"))


def heavy_keys(docs: DataFrame, author_share: float = 0.04, term_share: float = 0.0073) -> DataFrame:
    """``(field_name, key_text)``: authors with at least ``author_share`` of all documents, terms with at least ``term_share`` of all occurrences.

    Both tables of totals are written once, for the sums they are measured against are those of their own columns; documents without author count in the sum.
    """
    authors = cut(one_delivery(docs, "doc_id", "author").groupBy(clean_key(F.col("author")).alias("key_text")).agg(F.count(F.lit(1)).alias("total")))
    terms = cut(term_totals(docs))
    heavy = [
        t.where((F.col("total") >= F.lit(share) * (t.agg(F.sum("total")).scalar())) & F.col("key_text").isNotNull()).select(F.lit(name).alias("field_name"), "key_text")
        for name, t, share in (("author", authors, author_share), ("token", terms, term_share))
    ]
    return heavy[0].unionByName(heavy[1])
