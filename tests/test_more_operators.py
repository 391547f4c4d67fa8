"""Embedding providers, reports, whole-text objects and conversations to complete."""

import pytest
from pyspark.sql import functions as F

from stratum.operators import chunking, corpus, metrics, serving
from stratum.sources import text


def test_provider_gives_as_many_vectors_as_texts(spark):
    rows = spark.createDataFrame([(k, "x" * k if k % 7 else None) for k in range(40)], "k int, t string").repartition(3)

    def provider():
        return lambda some: [[float(len(x)), float(len(some) <= 4)] for x in some]

    got = rows.select("k", chunking.embedded(provider, 4)("t").alias("v")).collect()
    assert all(r["v"] == [float(r["k"] if r["k"] % 7 else 0), 1.0] for r in got) and len(got) == 40
    with pytest.raises(Exception, match="texts gave"):
        rows.select(chunking.embedded(lambda: lambda some: [[1.0]], 4)("t")).collect()


def test_report(spark):
    facts = spark.createDataFrame([("params", "12,000"), ("note", None)], "key string, value string")
    summary = spark.createDataFrame([("arc", 0.25, None), ("mmlu", 0.5, 0.75)], "metric string, base double, sft double")
    lines = [r["line"] for r in metrics.report([("Model", facts)], summary, "metric", ["base", "sft"]).collect()]
    assert lines == ["## Model", "- params: 12,000", "- note: -", "## Summary", "| Metric | base | sft |", "|---|---|---|", "| arc | 0.2500 | - |", "| mmlu | 0.5000 | 0.7500 |"]


def test_objects(spark, tmp_path):
    at = f"file://{tmp_path}/a.txt"
    assert not text.delete_object(spark, at) and text.read_object(spark, at) is None
    text.put_object(spark, at, "é one")
    text.put_object(spark, at, "é two")
    assert text.read_object(spark, at) == "é two" and text.delete_object(spark, at) and text.read_object(spark, at) is None


def test_a_conversation_to_complete(spark):
    part = lambda x: [{"type": "text", "text": x}]
    rows = spark.createDataFrame([(1, [{"role": "user", "parts": part("ab")}, {"role": "assistant", "parts": part("c")}])], "id int, messages array<struct<role:string,parts:array<struct<type:string,text:string>>>>")
    encode = lambda t: [ord(c) for c in t]
    whole = corpus.render_tokens(rows, "id", encode, special_from=1000).first()
    open_ = corpus.render_tokens(rows, "id", encode, special_from=1000, complete=True).first()
    assert whole["ids"] == [1000, 1001, 97, 98, 1002, 1003, 99, 1004] and whole["mask"] == [0, 0, 0, 0, 0, 0, 1, 1]
    assert open_["ids"] == [1000, 1001, 97, 98, 1002, 1003] and set(open_["mask"]) == {0}


def test_snapshot_lines(spark):
    one = spark.range(1)
    authors = one.select(F.lit("a.py").alias("path"), F.lit(7).alias("total_commits"), F.array(*(F.struct(F.lit(n).alias("name")) for n in "wxyz")).alias("primary_contributors"))
    assert serving.snapshot_lines("authorship", authors).first()["line"] == "- a.py: 7 commits; primary contributors: w, x, y"
    start = one.select(F.lit("README").alias("path"), F.array(*map(F.lit, "abcde")).alias("reasons"))
    assert serving.snapshot_lines("start_here", start).first()["line"] == "- README (a, b, c, d)"
    spots = one.select(F.lit("p").alias("path"), F.lit(3).alias("touch_count"), F.lit(None).cast("string").alias("last_touched"))
    assert serving.snapshot_lines("hotspots", spots).first()["line"] == "- p: 3 touches; last touched unknown"
    types = spark.range(20).select(F.concat(F.lit("."), F.col("id")).alias("extension"), F.col("id").alias("file_count"))
    assert serving.snapshot_lines("file_types", types, F.desc("file_count")).count() == 12
    assert serving.snapshot_lines("contributors", one.select(F.lit("n").alias("name"), F.lit(2).alias("commits"))).first()["line"] == "- n: 2 commits across listed files"
