"""Queries that write a table in each format and read it back whole; the folders lie beside the checkpoints."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from glyphmill.operators import pipeline
from glyphmill.operators.results import mean_scores
from glyphmill.plans import base as B
from glyphmill.plans.results import trials
from glyphmill.session import shared_folder, table
from glyphmill.sources import files
from glyphmill.streaming.incremental import append_new, follow

_RESULT = "problem string, known_author string, unknown_author string, target boolean, score double"


def jsonl(spark, d):  # noqa: ANN001, ANN201
    docs, path = table(spark, d, "documents").select("doc_id", "text", "lang", "source"), shared_folder(spark, "jsonl")
    files.write_jsonl(docs, path)
    return files.read_jsonl(spark, path, docs.schema).select("doc_id", "lang", "source", F.md5("text").alias("digest"))


def whole_texts(spark, d):  # noqa: ANN001, ANN201
    """The common words of each language as one file, which is read as a whole."""
    path = shared_folder(spark, "texts")
    rows = table(spark, d, "common_words").where("lang is not null and word is not null").select("lang", F.concat("word", F.lit("\u0001")).alias("value"))
    rows.repartition(1, "lang").sortWithinPartitions("value").write.partitionBy("lang").text(path)
    t = files.read_text(spark, f"{path}/*/*.txt")
    words = F.filter(F.split("text", "\u0001"), lambda w: w.rlike(r"\S"))
    return t.select(F.regexp_extract("path", "lang=([^/]+)/", 1).alias("lang"), F.size(words).alias("words"))


def csv(spark, d):  # noqa: ANN001, ANN201
    docs, path = table(spark, d, "documents").where("text is not null").select("doc_id", "source", "text"), shared_folder(spark, "csv")
    files.write_csv(docs, path)
    return files.read_csv(spark, path, docs.schema).select("doc_id", "source", F.md5("text").alias("digest"))


def bundle(spark, d):  # noqa: ANN001, ANN201
    """A result as six sheets, read again by names in any spelling; rows of each sheet."""
    from glyphmill.operators import phrases as P
    from glyphmill.plans.phrases import candidates

    c, path = candidates(spark, d), shared_folder(spark, "bundle")
    k = B.known(spark, d)
    files.write_result(
        path, known=c.where("phrase_method = 'mask_fill'"), unknown=c.where("phrase_method = 'varlen_fill'"), no_context=c,
        docs=k.select("doc_id", "text"), metadata=table(spark, d, "agg_metadata"), llr=P.mass(c, ["phrase_num"], "no_context"),
    )
    sheets = files.read_bundle(spark, path, ["Docs", "known", "UNKNOWN", "meta data", "no context", "llr"])
    out = None
    for name, df in sheets.items():
        row = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(files.sheet_name(name)).alias("sheet"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def _results(spark, d):  # noqa: ANN001, ANN202
    m = table(spark, d, "agg_metadata").dropDuplicates(["sample_id"]).select("sample_id", "known_author", "unknown_author")
    return trials(spark, d).join(m, "sample_id").select("problem", "known_author", "unknown_author", "target", "score")


def combined_results(spark, d):  # noqa: ANN001, ANN201
    """Two methods' folders of results, one of them missing a third: mean by problem and method."""
    path, r = shared_folder(spark, "methods"), _results(spark, d)
    files.write_jsonl(r, f"{path}/a")
    files.write_jsonl(r.withColumn("score", F.col("score") * 2), f"{path}/b")
    schema = StructType.fromDDL(_RESULT)
    out = pipeline.combined_means(spark, {"a": f"{path}/a", "b": f"{path}/b", "c": f"{path}/c"}, schema, ["problem", "target"])
    return out.withColumn("score", F.round("score", 6))


def good_inputs(spark, d):  # noqa: ANN001, ANN201
    """A folder in which one input is no table and one lacks a column: the others' rows, and what was reported."""
    path, r = shared_folder(spark, "inputs"), _results(spark, d)
    r.where("target").write.parquet(f"{path}/one")
    r.where("not target").write.parquet(f"{path}/two")
    r.drop("score").write.parquet(f"{path}/short")
    names = [f"{path}/{n}" for n in ("one", "missing", "short", "two")]
    rows, bad = pipeline.each_input(spark, names, lambda p: files.required(spark.read.parquet(p), "problem", "score"))
    good = rows.groupBy(F.element_at(F.split("filename", "/"), -1).alias("input")).agg(F.count(F.lit(1)).alias("n"))
    return good.unionByName(spark.createDataFrame([(n.split("/")[-1], -1) for n in bad], "input string, n bigint"))


def av_run(spark, d):  # noqa: ANN001, ANN201
    """A method run twice with tags, written as JSON lines, not run again when its result is there, and averaged over the repetitions."""
    from glyphmill.operators import scorers as S
    from glyphmill.session import cut

    known, unknown, problems = cut(B.known_sentences(spark, d)), B.unknown_sentences(spark, d), B.samples(spark, d)
    docs = known.groupBy("doc_id").agg(F.max("author").alias("author"))

    def inputs(k: int) -> dict:
        refs = B.reference_docs(problems, docs, k, 5).where(F.col("trial") == k).select("problem_id", F.col("place").alias("rep"), "ref_id")
        return {"known": known, "unknown": unknown, "ref_docs": refs}

    path = shared_folder(spark, "av")
    schema = StructType.fromDDL("repetition int, corpus string, problem string, known_author string, unknown_author string, target boolean, jsd double")
    make = lambda: pipeline.run_av("divergence_scores", problems, inputs, 2, corpus="all").drop("renyi", "hellinger")
    pipeline.unless_done(spark, path, make, schema)
    done = pipeline.unless_done(spark, path, lambda: 1 / 0, schema)
    assert S.METHODS
    return mean_scores(done.where("jsd is not null"), ["problem", "target"], "jsd").withColumn("jsd", F.round("jsd", 6))


def appended(spark, d):  # noqa: ANN001, ANN201
    """Results that arrive in two overlapping pieces, the second as a stream that is started twice: every key once."""
    path, e = shared_folder(spark, "append"), table(spark, d, "events").select("event_id", "event_type")
    append_new(e.where("event_id % 3 <> 0"), f"{path}/all", ["event_id"])
    e.where("event_id % 3 <> 1").write.parquet(f"{path}/new")
    for _ in range(2):
        follow(spark, f"{path}/new", e.schema, f"{path}/all", f"{path}/log", ["event_id"]).awaitTermination()
    return spark.read.parquet(f"{path}/all").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("ids"))


QUERIES = {f"source_{f.__name__}": f for f in (jsonl, whole_texts, csv, bundle, combined_results, good_inputs, appended)} | {"av_run": av_run}

from glyphmill.plans.phrases import C as _C  # noqa: E402
from glyphmill.plans.results import _T  # noqa: E402

_R = _T + ", q AS (SELECT sample_id, any_value(known_author) AS known_author, any_value(unknown_author) AS unknown_author FROM agg_metadata GROUP BY sample_id), r AS (SELECT problem, target, score FROM t JOIN q USING (sample_id))"
SQL = {
    "source_jsonl": "SELECT doc_id, lang, source, md5(text) AS digest FROM documents",
    "source_whole_texts": "SELECT lang, CAST(count(*) AS INTEGER) AS words FROM common_words WHERE lang IS NOT NULL AND word IS NOT NULL GROUP BY lang",
    "source_csv": "SELECT doc_id, source, md5(text) AS digest FROM documents WHERE text IS NOT NULL",
    "source_bundle": f"""WITH {_C} SELECT 'docs' AS sheet, count(DISTINCT doc_id) AS n FROM known_texts UNION ALL SELECT 'known', count(*) FROM c WHERE phrase_method = 'mask_fill' UNION ALL SELECT 'unknown', count(*) FROM c WHERE phrase_method = 'varlen_fill'
        UNION ALL SELECT 'metadata', count(*) FROM agg_metadata UNION ALL SELECT 'no_context', count(*) FROM c UNION ALL SELECT 'LLR', count(DISTINCT phrase_num) FROM c""",
    "source_combined_results": _R + " SELECT m.m AS method, problem, target, round(avg(score * m.f), 6) AS score FROM r, (VALUES ('a', 1), ('b', 2)) AS m(m, f) WHERE problem IS NOT NULL GROUP BY ALL",
    "source_good_inputs": _R + " SELECT CASE WHEN target THEN 'one' ELSE 'two' END AS input, count(*) AS n FROM r GROUP BY ALL UNION ALL SELECT 'missing', -1 UNION ALL SELECT 'short', -1",
    "av_run": B.with_("known", "unknown_chunks", "known_rows", "ks", "us", "samples", B.ref_docs_sql(2, 5), """c AS (SELECT 'u:' || doc_id AS id, token, count(*) AS n FROM (SELECT doc_id, unnest(tokens) AS token FROM us) GROUP BY ALL UNION ALL SELECT 'k:' || doc_id, token, count(*) FROM (SELECT doc_id, unnest(tokens) AS token FROM ks) GROUP BY ALL),
        p AS MATERIALIZED (SELECT id, token, n / sum(n) OVER (PARTITION BY id) AS p FROM c),
        nm AS (SELECT problem_id, 0 AS trial, 'u:' || unknown_id AS l, 'k:' || known_id AS r FROM samples UNION ALL SELECT problem_id, trial, 'u:' || unknown_id, 'k:' || ref_id FROM ref_docs JOIN samples USING (problem_id)),
        pr AS (SELECT DISTINCT l, r FROM nm WHERE l IN (SELECT id FROM p) OR r IN (SELECT id FROM p)),
        uv AS (SELECT l, r, token, sum(u) AS u, sum(v) AS v FROM (SELECT l, r, token, p AS u, 0 AS v FROM pr JOIN p ON id = l UNION ALL SELECT l, r, token, 0, p FROM pr JOIN p ON id = r) GROUP BY ALL),
        dv AS (SELECT l, r, sum(CASE WHEN u > 0 THEN u * log2(u / ((u + v) / 2)) ELSE 0 END + CASE WHEN v > 0 THEN v * log2(v / ((u + v) / 2)) ELSE 0 END) / 2 AS jsd FROM uv GROUP BY ALL),
        m AS (SELECT problem_id, trial, avg(jsd) AS jsd FROM nm JOIN dv USING (l, r) GROUP BY ALL)""")
        + "SELECT problem, target, round(avg(m.jsd - k.jsd), 6) + 0.0 AS jsd FROM m JOIN m k ON k.problem_id = m.problem_id AND k.trial = 0 JOIN samples s ON s.problem_id = m.problem_id WHERE m.trial > 0 AND problem IS NOT NULL AND target IS NOT NULL GROUP BY problem, target",
    "source_appended": "SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS ids FROM events GROUP BY event_type",
}
