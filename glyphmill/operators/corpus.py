"""Corpora and verification problems: ids, metadata, sentence rows and ordered text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.functions import text as X
from glyphmill.operators.numbering import number_rows
from glyphmill.operators.running import running


def apply_temp_doc_id(df: DataFrame) -> DataFrame:
    """``doc_id`` derived from the original id, which is kept as ``orig_doc_id``; unchanged where both columns exist. ``text`` comes last."""
    if {"doc_id", "orig_doc_id"} <= set(df.columns):
        return df
    out = df.withColumnRenamed("doc_id", "orig_doc_id").withColumn("doc_id", X.temp_doc_id(F.col("orig_doc_id")))
    rest = [c for c in out.columns if c not in ("doc_id", "orig_doc_id", "text")]
    return out.select("doc_id", "orig_doc_id", *rest, *(["text"] if "text" in out.columns else []))


def build_metadata(metadata: DataFrame, known: DataFrame, unknown: DataFrame, order: str = "problem") -> DataFrame:
    """``(sample_id, problem, corpus, known_author, unknown_author, unknown_doc_id, known_doc_id)``.

    Every problem with each document of its known author (null where the author has none) and the first document (least id) of its
    unknown author; problems whose unknown author has no document are left out, where the reference fails. Numbered 1.. by problem and document.
    """
    docs = known.select(F.col("author").alias("known_author"), F.col("doc_id").alias("known_doc_id")).distinct()
    first = unknown.groupBy(F.col("author").alias("unknown_author")).agg(F.min("doc_id").alias("unknown_doc_id"))
    rows = metadata.select("problem", "corpus", "known_author", "unknown_author").distinct().join(first, "unknown_author").join(docs, "known_author", "left")
    numbered = number_rows(rows, "sample_id", order, "corpus", "known_author", "unknown_author", "known_doc_id")
    return numbered.select("sample_id", "problem", "corpus", "known_author", "unknown_author", "unknown_doc_id", "known_doc_id")


def problems(unknown: DataFrame, known: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """``(problem, known_author, unknown_author)``: distinct problems whose authors stand on both sides.

    Without metadata there must be one known author, who is set against every unknown author.
    """
    if metadata is not None:
        m = metadata.select("problem", "known_author", "unknown_author")
        have_k, have_u = known.select(F.col("author").alias("known_author")).distinct(), unknown.select(F.col("author").alias("unknown_author")).distinct()
        return m.join(have_k, "known_author", "left_semi").join(have_u, "unknown_author", "left_semi").select("problem", "known_author", "unknown_author").distinct()
    authors = [r.author for r in known.select("author").where("author is not null").distinct().limit(2).collect()]
    if len(authors) != 1:
        raise ValueError("without metadata there must be exactly one known author")
    u = unknown.select(F.col("author").alias("unknown_author")).where("unknown_author is not null").distinct()
    return u.select(F.concat(F.lit(f"{authors[0]} vs "), "unknown_author").alias("problem"), F.lit(authors[0]).alias("known_author"), "unknown_author")


def sentence_rows(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text, exploded to ``(chunk_id, sentence)`` numbered from 1 in each document; blank texts give no row."""
    keep = [c for c in docs.columns if c != text]
    return docs.select(*keep, F.posexplode(X.split_sentences(F.col(text))).alias("_p", "sentence")).select(*keep, (F.col("_p") + 1).alias("chunk_id"), "sentence")


def concat_text(rows: DataFrame, group: str | list[str], order: str, text: str = "text", sep: str = "\n", out: str = "concat_text", ids: DataFrame | None = None, strict: bool = False, dropna: bool = True) -> DataFrame:
    """``(*group, out)``: texts of each group joined in order. Meant for documents, whose size is bounded. Nulls are dropped, or count as empty texts if not ``dropna``.

    ``ids`` restricts the groups; with ``strict`` a listed id without rows raises.
    """
    keys = [group] if isinstance(group, str) else group
    if ids is not None:
        rows = rows.join(ids.select(*keys).distinct(), keys, "left_semi")
    pieces = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(text, F.lit("")).alias("t"))))
    there = rows.where(F.col(text).isNotNull()) if dropna else rows
    out_df = there.groupBy(*keys).agg(F.array_join(F.transform(pieces, lambda s: s["t"]), sep).alias(out))
    if ids is not None and strict and (missing := ids.select(*keys).distinct().join(out_df, keys, "left_anti").limit(5).collect()):
        raise ValueError(f"no text for {[r[0] for r in missing]}")
    return out_df


def concat_listed(lists: DataFrame, docs: DataFrame, sep: str = "\n", unique: bool = False, strict: bool = False) -> DataFrame:
    """``(list_id, concat_text, missing)``: the texts of each list of documents in the list's order, and how many of its documents have no text.

    ``lists`` is (list_id, ord, doc_id), ``docs`` (doc_id, text) with one row a document. A document listed twice comes twice unless ``unique``; with ``strict`` a missing one raises.
    """
    asked = lists.groupBy("list_id", "doc_id").agg(F.min("ord").alias("ord")) if unique else lists
    rows = asked.join(docs.where("text is not null").select("doc_id", "text"), "doc_id", "left")
    pieces = F.sort_array(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("ord", "text"))))
    out = rows.groupBy("list_id").agg(F.array_join(F.transform(pieces, lambda s: s["text"]), sep).alias("concat_text"), F.count(F.when(F.col("text").isNull(), 1)).alias("missing"))
    if strict and (bad := out.where("missing > 0").limit(5).collect()):
        raise ValueError(f"documents without text in {[r.list_id for r in bad]}")
    return out


def profile_offsets(docs: DataFrame, keys: list[str], order: str, text: str = "text", sep_chars: int = 1) -> DataFrame:
    """Where each document begins in its author's joined profile: the profile stays in rows, however large it is, and an author is spread over tasks."""
    rows = docs.where(F.col(text).isNotNull()).select(*keys, order, F.length(text).alias("n_chars"))
    placed = running(rows, keys, [order], {"_end": (F.col("n_chars") + sep_chars).cast("bigint")}, "ord")
    return placed.select(*keys, order, F.col("ord").cast("int").alias("ord"), (F.col("_end") - F.col("n_chars") - sep_chars).alias("start"), "n_chars")


def split_description(df: DataFrame, column: str = "description") -> DataFrame:
    """Five parts between " - ", the fourth being a dummy, and the method name put together again."""
    p = F.split(column, " - ")
    part = lambda k: F.get(p, F.lit(k))
    return df.withColumns({
        "model": part(0), "para_method": part(1), "top_k": part(2), "temperature": part(4),
        "para_method_t_temp": F.concat(part(1), F.lit("_t_"), part(4)),
    })


def doc_pair_name(known_doc: str = "known_doc_id", unknown_doc: str = "unknown_doc_id"):  # noqa: ANN201
    return F.concat(F.col(known_doc), F.lit(" vs "), F.col(unknown_doc))


def numbered_jobs(pairs: DataFrame, *keys: str) -> DataFrame:
    """Distinct document pairs of each problem, numbered from 1 within the problem: the job list of a run."""
    w = Window.partitionBy("problem").orderBy(*keys)
    return pairs.select("problem", *keys).distinct().withColumn("job", F.row_number().over(w))


def pending(work: DataFrame, completed: DataFrame, *keys: str) -> DataFrame:
    """Work whose key has no completed row."""
    return work.join(completed.select(*keys).distinct(), list(keys), "left_anti")
