"""Shuffles as bijections, forbidden keys in the data, and git logs in parts."""

import os
import random
import subprocess

import pytest
from pyspark.sql import functions as F

from stratum.operators import corpus, sync, tasks
from stratum.sources import git as git_source


def plain_shuffled(place, total, seed):
    for shift, a, b, c in corpus.shuffle_keys(seed):
        mirror = (shift - place) % total
        top = max(place, mirror)
        if (((top % corpus.PRIME) * a + top // corpus.PRIME % corpus.PRIME * b + c) % corpus.PRIME >> 15) % 2:
            place = mirror
    return place


@pytest.mark.parametrize("total", [1, 2, 3, 97, 1024, 4099])
def test_a_shuffle_is_a_permutation(spark, total):
    rows = spark.range(total).select("id", corpus.shuffled(F.col("id"), total, 7).alias("to")).withColumn("back", corpus.shuffled(F.col("to"), total, 7, back=True)).collect()
    assert sorted(r["to"] for r in rows) == list(range(total)) and all(r["back"] == r["id"] for r in rows)
    assert all(r["to"] == plain_shuffled(r["id"], total, 7) for r in rows)


def test_totals_beyond_32_bits_go_there_and_back(spark):
    total, draw = 3 * 10**13 + 7, random.Random(2)
    some = [draw.randrange(total) for _ in range(200)]
    rows = spark.createDataFrame([(i,) for i in some], "id long").select("id", corpus.shuffled(F.col("id"), total).alias("to")).withColumn("back", corpus.shuffled(F.col("to"), total, back=True)).collect()
    assert all(0 <= r["to"] < total and r["back"] == r["id"] and r["to"] == plain_shuffled(r["id"], total, 42) for r in rows)


def test_places_are_spread(spark):
    """Halves mix, neighbours part, and another seed gives another order."""
    to = [r[0] for r in spark.range(4096).select(corpus.shuffled(F.col("id"), 4096, 3)).collect()]
    assert 0.44 < sum(t < 2048 for t in to[:2048]) / 2048 < 0.56
    steps = [abs(a - b) for a, b in zip(to, to[1:], strict=False)]
    assert 4096 / 3 * 0.9 < sum(steps) / len(steps) < 4096 / 3 * 1.1
    other = [plain_shuffled(i, 4096, 4) for i in range(4096)]
    assert sum(a == b for a, b in zip(to, other, strict=True)) < 20


def test_mixture(spark):
    a, b = spark.range(0, 300, 3).withColumnRenamed("id", "i"), spark.range(50).selectExpr("id * 1000 as i")
    df = corpus.mixture([a, b, b], "i", 5)
    rows = df.collect()
    assert sorted(r["place"] for r in rows) == list(range(200)) and [sum(r["task"] == k for r in rows) for k in range(3)] == [100, 50, 50]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan
    by_place = {r["place"]: (r["task"], r["i"]) for r in rows}
    ids = [[i * 3 for i in range(100)], [i * 1000 for i in range(50)], [i * 1000 for i in range(50)]]
    found = corpus.mixture_rows([100, 50, 50], spark.range(-3, 210, 7).withColumnRenamed("id", "place"), seed=5).collect()
    assert len(found) == 28 and all(by_place[r["place"]] == (r["task"], ids[r["task"]][r["local"]]) for r in found)
    assert corpus.mixture([a.limit(0)], "i").collect() == []
    head = tasks.seeded_head(a, "i", 10).collect()
    assert sorted(r["place"] for r in head) == list(range(10))


def test_forbidden_keys(spark):
    data = [
        (1, {"a": {"ok": 1}}, ['{"x": [1, {"y": "author_email"}]}', None], "commit_message: no key", False),
        (2, {"a": {"Author_Email2": 1}}, [], None, True),
        (3, {"my_commit_message": {}}, None, "", True),
        (4, None, ["plain", '{"a": [1, [{"deep": {"ABSOLUTE_PATH": null}}], "s"]}'], "x", True),
        (5, {}, ['{"a": "author_email\\": ", "b": ":"}'], '{"k":"v",":commit":1}', False),
        (6, {}, [], '[{"a":"b",":commit_message":1}]', True),
        (7, {}, [], '{"commit\\u005fmessage": 1}', True),
        (8, {}, [], '{"author_email": broken', False),
        (9, {}, [], '{"a":"}","\\"x":{"author_email" : 2}}', True),
    ]
    rows = spark.createDataFrame(data, "id long, m map<string,map<string,int>>, a array<string>, s string, bad boolean")
    df = rows.select("id", "bad", "m", "a", F.struct("s", F.try_parse_json("s").alias("v")).alias("t"))
    told = df.select("id", "bad", sync.forbidden_keys(F.struct("m", "a", "t"), df.select("m", "a", "t").schema).alias("got")).collect()
    assert [(r["id"], r["got"]) for r in told] == [(r["id"], r["bad"]) for r in told]
    only_variant = df.select("id", sync.forbidden_keys(F.col("t.v"), df.schema["t"].dataType["v"].dataType).alias("got")).collect()
    assert {r["id"] for r in only_variant if r["got"]} == {6, 7, 9}
    assert sync.refuse_forbidden(df.where("not bad").select("m", "a")).count() == 3
    with pytest.raises(Exception, match="forbidden field"):
        sync.refuse_forbidden(df.select("m", "a")).collect()
    with pytest.raises(ValueError, match="forbidden"):
        sync.refuse_forbidden(df.select(F.create_map("s", F.struct(F.lit(1).alias("author_email"))).alias("x")) if False else spark.createDataFrame([], "x map<string,struct<author_email:int>>"))


def test_a_log_in_parts(spark, tmp_path):
    run = lambda *a, **k: subprocess.run(["git", *a], cwd=tmp_path, check=True, capture_output=True, **k)
    run("init", "-q")
    for day in range(11):
        (tmp_path / f"f{day % 3}.txt").write_text(str(day))
        when = f"2026-01-{day + 1:02d}T00:00:00+00:00"
        env = os.environ | {"GIT_COMMITTER_DATE": when, "GIT_AUTHOR_DATE": when}
        run("add", "-A")
        run("-c", "user.name=T", "-c", "user.email=t@example.com", "commit", "-q", "--allow-empty-message", "-m", f"c{day}\n\nbody", env=env)
    at = str(tmp_path)

    def log(part, most=500):
        both = [git_source.read_log(spark, [at], kind, most, part) for kind in ("meta", "stat")]
        return both, [tuple(r) for r in git_source.commit_log(*both).orderBy("ord").collect()]

    (meta, stat), whole = log(1000)
    assert len(whole) == 11 and meta.rdd.getNumPartitions() == 1 and [r[7] for r in whole] == [[(f"f{d % 3}.txt", 1, 0 if d < 3 else 1)] for d in range(10, -1, -1)] or [list(map(tuple, r[7])) for r in whole] == [[(f"f{d % 3}.txt", 1, 0 if d < 3 else 1)] for d in range(10, -1, -1)]
    (meta, stat), parts = log(3)
    assert parts == whole and meta.rdd.getNumPartitions() == stat.rdd.getNumPartitions() == 4
    assert log(3, most=7)[1] == whole[:7]
    some = meta.where("part >= 1 and part < 3")
    assert some.rdd.getNumPartitions() == 2 and sorted(r["line_no"] for r in some.collect()) == list(range(3, 9))
    assert meta.where(F.col("repo") == "other").collect() == [] and meta.where(F.col("repo").isin(at, "x") & F.col("value").contains("c10")).count() == 1
