"""Token functions, the task protocol, and folds that stream a group's sorted rows."""

import random

import pytest
from pyspark.sql import functions as F

from stratum.functions import tokens
from stratum.operators import chunking, corpus, tasks

SPECIAL = {"<|python_start|>": 1, "<|python_end|>": 2, "<|output_start|>": 3, "<|output_end|>": 4, "<|assistant_end|>": 5, "<|bos|>": 6}


def say(ids, tool=corpus.calculator):
    return tokens.answered(ids, SPECIAL, lambda x: "".join(map(chr, x)), lambda t: [ord(c) for c in t], tool)


def codes(text):
    return [ord(c) for c in text]


def test_tool_calls_are_answered():
    call = [1, *codes("6*7"), 2]
    assert say([9, *call, 8, 8, 8, 8, 7]) == ([9, *call, 3, *codes("42"), 4, 7], [1] * 6 + [0] * 4 + [1])
    assert say([9, *call, 8]) == ([9, *call, 3], [1] * 6 + [0])  # the stream ends within the answer
    assert say([1, 2, 9]) == ([1, 2, 9], [1, 1, 1])  # nothing called
    bad = [1, *codes("open(1)"), 2, 9]
    assert say(bad) == (bad, [1] * len(bad))
    assert say([2, 9, 5, 9]) == ([2, 9], [1, 1])
    assert say([9, 6, 9]) == ([9], [1])
    assert say([]) == ([], [])


def test_next_token(spark):
    rows = spark.createDataFrame([(1, [1.0, 3.0, 3.0], 0.0), (2, [1.0, 3.0, 3.0], 0.999999), (3, [], 0.5), (4, None, 0.5), (5, [0.0, 0.0], 0.6)], "id int, x array<double>, u double")
    got = {r["id"]: (r["all"], r["two"], r["best"]) for r in rows.select("id", tokens.next_token(F.col("x"), F.col("u")).alias("all"), tokens.next_token(F.col("x"), F.col("u"), 1.0, 2).alias("two"), tokens.next_token(F.col("x"), F.col("u"), 0.0).alias("best")).collect()}
    assert got == {1: (1, 1, 1), 2: (0, 2, 1), 3: (None, None, None), 4: (None, None, None), 5: (1, 1, 0)}
    with pytest.raises(ValueError, match="negative"):
        tokens.next_token(F.col("x"), F.col("u"), -1.0)


def test_encode_and_decode(spark):
    public = pytest.importorskip("public_tokenizers")
    path = public.path("byte_bpe_50k.tiktoken")
    texts = [None, "", "plain words 1234", "<|bos|> is text here", "é中\U0001f600\n\n  x", "word " * 20_000]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = rows.select("id", tokens.encode(F.col("t"), path, "<|bos|>", 7).alias("ids")).select("id", "ids", tokens.decode(F.slice("ids", 2, F.size("ids") - 2), path).alias("t")).orderBy("id").collect()
    assert [r["t"] for r in got] == [t or "" for t in texts]
    assert all(r["ids"][0] == 50256 and r["ids"][-1] == 7 for r in got)
    assert 50256 not in got[3]["ids"][1:]
    one = spark.createDataFrame([([50256, 50257],), ([],), (None,)], "ids array<int>").select(tokens.decode(F.col("ids"), path).alias("t")).collect()
    assert [r["t"] for r in one] == ["<|bos|><|user_start|>", "", ""]


def test_tasks(spark):
    rows = spark.range(10).select(F.col("id").alias("index"), (F.col("id") * 10).alias("answer"))
    task = tasks.Task(rows, "generative", lambda said: said == F.col("answer"), start=1, stop=8, step=3)
    assert len(task) == 3
    assert len(tasks.Task(rows, "categorical", lambda said: said.isNotNull())) == 10
    assert [(r["index"], r["of"]) for r in task.examples().orderBy("index").collect()] == [(0, 1), (1, 4), (2, 7)]
    assert task.example(2).first()["answer"] == 70
    said = spark.createDataFrame([(0, 10), (1, 5), (2, None), (9, 1)], "index int, completion long")
    assert sorted(map(tuple, task.evaluated(said).collect()), key=lambda r: r[0]) == [(0, 10, True, 1.0), (1, 5, False, 0.0), (2, None, False, 0.0)]
    with pytest.raises(ValueError, match="kind"):
        tasks.Task(rows, "other", lambda said: said)
    with pytest.raises(ValueError, match="slice"):
        tasks.Task(rows, "generative", lambda said: said, start=3, stop=2)


def plain_rows(sizes, capacity, buffer, crop):
    """Best fit by looking through the whole buffer each time."""
    out, held, rest, row, used = [], [], list(enumerate(sizes)), 0, 0
    while held or rest:
        while rest and len(held) < buffer:
            held.append(rest.pop(0))
        fits = [x for x in held if x[1] <= capacity - used]
        if not fits and not crop and used:
            row, used = row + 1, 0
            continue
        doc = max(fits, key=lambda x: (x[1], -x[0])) if fits else min(held, key=lambda x: (x[1], x[0]))
        held.remove(doc)
        taken = min(doc[1], capacity - used)
        out.append((row, used, doc[0], taken))
        used += taken
        if used == capacity:
            row, used = row + 1, 0
    return out


@pytest.mark.parametrize("crop", [True, False])
def test_rows_by_looking_through_the_buffer(crop):
    draw = random.Random(3)
    for _ in range(300):
        sizes = [draw.choice([0, 1, 2, 3, 5, 8, 19, 20, 21, 50]) for _ in range(draw.randrange(40))]
        buffer = draw.randrange(1, 9)
        assert corpus.pack_rows(sizes, 20, buffer, crop) == plain_rows(sizes, 20, buffer, crop)


def test_folds_over_groups(spark):
    """Null keys, a hot key, an empty table and columns with clashing names."""
    data = [(None if i % 7 == 0 else "hot" if i % 3 else f"k{i % 5}", i, (i * 37) % 11) for i in range(400)]
    rows = spark.createDataFrame(data, "batch_key string, ord long, n int").repartition(5)
    by = {}
    for k, i, n in data:
        by.setdefault(k, []).append((i, n))
    got = corpus.best_fit(rows, "batch_key", "ord", "n", 30, 16, True).collect()
    want = [(k, r, o, own[j][0], t) for k, own in by.items() for r, o, j, t in plain_rows([n for _, n in own], 30, 16, True)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    found = corpus.shards(rows, "batch_key", "ord", "n", 40, 4).collect()
    want = [(k, i, n, s) for k, own in by.items() for (i, n), s in zip(own, corpus.assign_shards([n for _, n in own], 40, 4), strict=True)]
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str)
    filled = chunking.batches_by_budget(rows, "n", 25, 6, "ord", "batch_key").collect()
    want = [(k, i, n, b) for k, own in by.items() for (i, n), b in zip(own, chunking.fill_batches([n for _, n in own], 25, 6), strict=True)]
    assert sorted(map(tuple, filled), key=str) == sorted(want, key=str)
    none = rows.limit(0)
    assert corpus.best_fit(none, "batch_key", "ord", "n", 30).collect() == corpus.shards(none, "batch_key", "ord", "n", 1, 1).collect() == chunking.batches_by_budget(none, "n", 25, 6, "ord", "batch_key").collect() == []


def test_folds_hold_no_group(spark):
    rows = spark.range(100).selectExpr("cast(id % 3 as string) k", "id", "cast(id as int) n")
    for df in (corpus.best_fit(rows, "k", "id", "n", 30), corpus.shards(rows, "k", "id", "n", 9, 2), chunking.batches_by_budget(rows, "n", 100, 6, "id", "k")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapGroups" not in plan and "MapInArrow" in plan and plan.count("Exchange") == 1
