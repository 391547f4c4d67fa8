"""Task conversations, bundles, key-value tables, documents and tools."""

import pytest
from pyspark.sql import functions as F

from stratum.operators import tasks


def test_bundle_and_records(spark, tmp_path):
    (tmp_path / "base.csv").write_text("Eval Task,Random baseline\nt1,25.0\n")
    (tmp_path / "t1.jsonl").write_text('{"q":1}\n{"q":2}\n')
    got = tasks.evaluation_bundle(spark, [{"label": "t1", "kind": "mc", "shots": 0, "dataset": "t1.jsonl"}], str(tmp_path / "base.csv"), str(tmp_path))
    assert got.count() == 2 and got.first()["baseline"] == 25.0
    with pytest.raises(KeyError):
        tasks.evaluation_bundle(spark, [{"label": "t2", "kind": "mc", "shots": 0, "dataset": "x"}], str(tmp_path / "base.csv"), str(tmp_path))
    assert tasks.summary_record(got, n=F.count("*")).first()[0] == '{"n":2}'


def test_values_documents_and_tools(spark):
    old = spark.createDataFrame([("a", '{"x":1}')], "key string, value string")
    both = tasks.put_values(old, spark.createDataFrame([("a", '{"x":2}'), ("b", "{}")], old.schema))
    assert tasks.get_value(both, "a") == {"x": 2} and tasks.get_value(both, "z") is None
    docs = tasks.save_document(spark.createDataFrame([("r", 1, "one")], "repo_id string, version int, document string"), "r", "two")
    users = spark.createDataFrame([("u", "r"), ("u", "none")], "access_key string, repo_id string")
    assert [r["document"] for r in tasks.user_documents(users, docs).collect()] == ["two"]
    files = spark.createDataFrame([("src/a.py", "Hello\nworld"), ("README.md", "x")], "path string, content string")
    assert [r["name"] for r in tasks.call_tool("list_repo_files", files).collect()] == ["README.md", "src/"]
    assert [(r["line"], r["text"]) for r in tasks.call_tool("search_repo_text", files, needle="WORLD").collect()] == [(2, "world")]
    assert tasks.call_tool("read_repo_file", files, path="README.md").first()["content"] == "x"
    with pytest.raises(KeyError):
        tasks.call_tool("rm", files)


def test_rows_from_index_alone(spark):
    got = [tuple(r) for r in tasks.diverse_rows(spark.range(20), "id", {"tone": ["a", "b"], "topic": ["x", "y", "z"]}).orderBy("id").collect()]
    assert got == [tuple(r) for r in tasks.diverse_rows(spark.range(20).repartition(3), "id", {"tone": ["a", "b"], "topic": ["x", "y", "z"]}).orderBy("id").collect()]
    assert len({r[1:] for r in got}) > 2
    row = spark.createDataFrame([("q", ["x", "y"], "B")], "q string, c array<string>, a string")
    assert tasks.choice_conversations(row, "q", "c", "a").first()["messages"][1]["content"] == "B"
    nested = spark.createDataFrame([((1, 2),)], "train struct<a:int,b:int>")
    assert tasks.auxiliary(nested).columns == ["a", "b"]
    pieces = spark.createDataFrame([(1, 1, bytearray(b"lo")), (1, 0, bytearray(b"hel"))], "id int, n int, c binary")
    assert tasks.joined_chunks(pieces, "id", "n", "c").first()["response"] == "hello"
