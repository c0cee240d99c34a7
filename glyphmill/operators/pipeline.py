"""Whole runs: a method over repetitions with tags, skipping what is finished, and a folder of inputs in which a bad one is reported and skipped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.operators import scorers
from glyphmill.operators.phrases import join_all, mass
from glyphmill.operators.scoring import Scorer, regrouped, score_in_context, score_no_context
from glyphmill.sources.files import read_jsonl, save_error, write_jsonl


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))


def tagged(df: DataFrame, **tags: str | int) -> DataFrame:
    """``df`` with the given constants as first columns, those of value None left out."""
    given = {k: v for k, v in tags.items() if v is not None}
    return df.select(*[F.lit(v).alias(k) for k, v in given.items()], *[c for c in df.columns if c not in given])


def run_av(method: str, problems: DataFrame, inputs: Callable[[int], dict], repetitions: int = 5, **tags: str) -> DataFrame:
    """``(repetition, <tags>, problem, known_author, unknown_author, target, <scores>)``: a method run ``repetitions`` times.

    ``problems`` is (problem_id, problem, known_author, unknown_author, ...); ``inputs`` gives the method's other arguments for a repetition, with references drawn anew by its number as seed.
    """
    named = problems.select("problem_id", "problem", "known_author", "unknown_author", (F.col("known_author") == F.col("unknown_author")).alias("target"))
    runs = []
    for k in range(1, repetitions + 1):
        scores = scorers.run_method(method, problems=problems, **inputs(k))
        runs.append(tagged(named.join(scores, "problem_id").drop("problem_id"), repetition=k, **tags))
    out = runs[0]
    for r in runs[1:]:
        out = out.unionByName(r)
    return out


def unless_done(spark: SparkSession, path: str, make: Callable[[], DataFrame], schema) -> DataFrame:  # noqa: ANN001
    """The JSON-lines result at ``path``, made and written only if it is not there yet."""
    if not exists(spark, path):
        write_jsonl(make(), path)
    return read_jsonl(spark, path, schema)


def each_input(spark: SparkSession, paths: list[str], make: Callable[[str], DataFrame], tag: str = "filename", errors: str | None = None) -> tuple[DataFrame | None, dict[str, str]]:
    """``(rows of all good inputs with their name, {bad input: message})``: an input that cannot be read or lacks a column is left out and reported, as text files in ``errors`` if that is named.

    Every input is planned on its own, so that one bad file does not spoil the others.
    """
    out, bad = None, {}
    for path in paths:
        try:
            rows = make(path)
            rows.limit(1).collect()
        except Exception as e:  # noqa: BLE001
            bad[path] = str(e).splitlines()[0] if str(e) else type(e).__name__
            if errors:
                save_error(spark, f"{path}: {e}", errors)
            continue
        rows = rows.withColumn(tag, F.lit(path))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out, bad


def combined_means(spark: SparkSession, folders: dict[str, str], schema, keys: list[str], score: str = "score", tag: str = "method") -> DataFrame:  # noqa: ANN001
    """``(tag, *keys, score)``: the mean score by key of each folder of JSON-lines results, repetitions taken together."""
    from glyphmill.operators.results import mean_scores
    from glyphmill.sources.files import read_tagged

    return mean_scores(read_tagged(spark, folders, schema, tag), [tag, *keys], score)


def rescore(candidates: DataFrame, known_text: str, unknown_text: str, factory: Callable[[], Scorer], kept: DataFrame | None = None) -> dict[str, DataFrame]:
    """``{"no_context", "known", "unknown", "LLR"}``: a finished result's candidates scored anew by another model, without context and in both texts, with the ratios of all three.

    ``kept`` (phrase) restricts it to phrases kept in a review.
    """
    if kept is not None:
        candidates = candidates.join(candidates.where("phrase_type = 'reference'").join(kept.select("phrase").distinct(), "phrase", "left_semi").select("phrase_num").distinct(), "phrase_num", "left_semi")
    phrases = regrouped(candidates)
    sheets = {"no_context": score_no_context(phrases, factory), "known": score_in_context(phrases, known_text, factory), "unknown": score_in_context(phrases, unknown_text, factory)}
    tables = [mass(df, ["phrase_num"], name, "sum_log_probs" if name == "no_context" else "sum_log_probs_phrase").select("phrase_num", f"{name}_log_prob", f"pmf_{name}", f"llr_{name}") for name, df in sheets.items()]
    return sheets | {"LLR": join_all(tables, ["phrase_num"])}
