"""Problems, metadata, sampling, numbering, sources, streaming and heavy keys, with awkward inputs."""

import pytest
from pyspark.sql import functions as F

from glyphmill.operators import corpus as C
from glyphmill.operators import hotkeys as H
from glyphmill.operators.numbering import number_rows
from glyphmill.operators.sampling import sample_for
from glyphmill.sources import files as S
from glyphmill.streaming.incremental import append_new, follow


def test_metadata_keeps_problems_without_known_documents(spark):
    meta = spark.createDataFrame([("p1", "c", "a", "b"), ("p2", "c", "z", "b"), ("p3", "c", "a", "nobody")], "problem string, corpus string, known_author string, unknown_author string")
    known = spark.createDataFrame([("k1", "a"), ("k2", "a")], "doc_id string, author string")
    unknown = spark.createDataFrame([("u2", "b"), ("u1", "b")], "doc_id string, author string")
    rows = [tuple(r) for r in C.build_metadata(meta, known, unknown).orderBy("sample_id").collect()]
    assert rows == [(1, "p1", "c", "a", "b", "u1", "k1"), (2, "p1", "c", "a", "b", "u1", "k2"), (3, "p2", "c", "z", "b", "u1", None)]


def test_problems_need_one_known_author(spark):
    u = spark.createDataFrame([("x",), ("y",), (None,)], "author string")
    one = spark.createDataFrame([("a",), ("a",)], "author string")
    assert {r.problem for r in C.problems(u, one).collect()} == {"a vs x", "a vs y"}
    with pytest.raises(ValueError):
        C.problems(u, one.union(spark.createDataFrame([("b",)], "author string")))


def test_numbers_follow_the_order(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    rows = number_rows(df, "n", "v").collect()
    assert sorted((r.v, r.n) for r in rows) == [(v, v + 1) for v in range(1000)]
    assert number_rows(df.where("false"), "n", "v").count() == 0


def test_concat_text(spark):
    rows = spark.createDataFrame([("d", 2, "b"), ("d", 1, "a"), ("d", 3, None), ("e", 1, None)], "doc_id string, o int, text string")
    assert [tuple(r) for r in C.concat_text(rows, "doc_id", "o").collect()] == [("d", "a\nb")]
    ids = spark.createDataFrame([("d",), ("missing",)], "doc_id string")
    with pytest.raises(ValueError):
        C.concat_text(rows, "doc_id", "o", ids=ids, strict=True)


def test_sampling_excludes_and_repeats(spark):
    pool = spark.createDataFrame([(f"i{k}", f"a{k % 5}") for k in range(1000)], "item string, author string")
    req = spark.createDataFrame([(f"r{k}", 20, "a1", None) for k in range(10)], "req_id string, k int, not_a string, not_b string")
    one, two = (sorted(map(tuple, sample_for(req, pool).collect())) for _ in range(2))
    assert one == two
    authors = {r.item: r.author for r in pool.collect()}
    by = {}
    for r, item, _ in one:
        by.setdefault(r, []).append(item)
    assert all(len(v) == len(set(v)) == 20 and all(authors[i] != "a1" for i in v) for v in by.values()) and len({tuple(v) for v in by.values()}) == 10


def test_jsonl_round_trip_and_odd_lines(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"doc_id": "1", "text": "a\\nb"}\n[{"doc_id": "2"}]\n\nnot json\n')
    rows = S.read_jsonl(spark, str(p), S.DOCS, bad="bad").collect()
    assert [(r.doc_id, r.text, r.bad) for r in rows] == [("1", "a\nb", None), ("2", None, None), (None, None, "not json")]
    out = str(tmp_path / "out")
    S.write_jsonl(S.read_jsonl(spark, str(p), S.DOCS), out)
    assert {r.doc_id for r in S.read_jsonl(spark, out, S.DOCS).collect()} == {"1", "2", None}


def test_text_csv_and_tagged_folders(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<x>\n1</x>")
    assert S.read_text(spark, str(tmp_path / "a.xml")).first().text == "<x>\n1</x>"
    (tmp_path / "c.csv").write_text('a,b\n"1,5","x\ny"\n')
    assert tuple(S.read_csv(spark, str(tmp_path / "c.csv"), "a string, b string").first()) == ("1,5", "x\ny")
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "f.jsonl").write_text('{"doc_id": "1"}\n')
    t = S.read_tagged(spark, {"one": str(tmp_path / "one"), "gone": str(tmp_path / "gone")}, S.DOCS)
    assert [(r.doc_id, r.source) for r in t.collect()] == [("1", "one")]


def test_bundles(spark, tmp_path):
    path = str(tmp_path / "result")
    S.write_bundle({"No Context": spark.range(2), "docs": spark.range(1)}, path)
    assert S.read_bundle(spark, path, ["no_context"])["no_context"].count() == 2
    assert S.read_bundle(spark, path, ["LLR"], required=False)["LLR"] is None
    with pytest.raises(ValueError):
        S.read_bundle(spark, path, ["LLR"])


def test_impostors_missing(spark):
    imp = spark.createDataFrame([("d", 1)], "doc_id string, impostor_id int")
    assert S.impostor_rows(imp, spark.createDataFrame([("d",), ("e",)], "doc_id string")).count() == 1
    with pytest.raises(ValueError):
        S.impostor_rows(imp, spark.createDataFrame([("e",)], "doc_id string"))


def test_appending_is_idempotent(spark, tmp_path):
    target = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    append_new(df, target, ["k"])
    append_new(df.union(spark.createDataFrame([(3, "c")], "k int, v string")), target, ["k"])
    assert sorted(r.k for r in spark.read.parquet(target).collect()) == [1, 2, 3]


def test_stream_appends_unseen_keys(spark, tmp_path):
    source, target = str(tmp_path / "s"), str(tmp_path / "t")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    for _ in range(2):
        df.write.mode("append").parquet(source)
        follow(spark, source, df.schema, target, str(tmp_path / "c"), ["k"]).awaitTermination()
    assert sorted(r.k for r in spark.read.parquet(target).collect()) == [1, 2]


def test_heavy_keys_with_awkward_rows(spark):
    rows = [("1", " Ann ", ["Ġthe", "THE", "x"], 3), ("1", " Ann ", ["Ġthe", "THE", "x"], 3), ("2", "ann", None, None), ("3", "", [], 0), ("4", None, ["", None, "!"], 1), ("5", "Bob", ["the"], 1)]
    df = spark.createDataFrame(rows, "doc_id string, author string, tokens array<string>, num_tokens int").withColumn("key_text", F.lit("clash")).withColumn("records", F.lit(0))
    assert {(r.field_name, r.key_text) for r in H.heavy_keys(df, 0.4, 0.5).collect()} == {("author", "ann"), ("token", "the")}
    assert {(r.key_text, r.records, r.total) for r in H.author_totals(df).collect()} == {("ann", 2, 3), ("bob", 1, 1)}
    assert H.heavy_keys(df.where("false")).count() == 0 and H.term_totals(df.where("false")).count() == 0
