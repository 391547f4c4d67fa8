"""Batches and shards of groups that are spread over many blocks, against plain folds."""

import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from stratum.operators import chunking, corpus, greedy


def data(n, seed, sizes):
    draw = random.Random(seed)
    rows = [(None if draw.random() < 0.1 else "hot" if draw.random() < 0.8 else f"k{draw.randrange(9)}", i * 3, draw.choice(sizes)) for i in range(n)]
    by = {}
    for k, i, s in rows:
        by.setdefault(k, []).append((i, s))
    return rows, by


def frame(spark, rows):
    return spark.createDataFrame(rows, "first string, n int, target long", verifySchema=False).toDF("first", "n", "target").repartition(3) if rows else spark.createDataFrame([], "first string, n int, target long")


@pytest.mark.parametrize(("rows_a_block", "sizes"), [(17, [0, 1, 2, 9, 25]), (40, [None, 0, 0, 1])])
def test_one_hot_group_over_many_blocks(spark, monkeypatch, rows_a_block, sizes):
    """Parts shorter and longer than a block, sizes of 0 and null, null groups, names that the operator has too."""
    monkeypatch.setattr(greedy, "ROWS", rows_a_block)
    rows, by = data(300, rows_a_block, sizes)
    df = frame(spark, rows)
    got = chunking.batches_by_budget(df, "target", 25, 6, "n", "first").collect()
    want = [(k, i, s, b) for k, own in by.items() for (i, s), b in zip(own, chunking.fill_batches([s or 0 for _, s in own], 25, 6), strict=True)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    for chars, group in ((40, 4), (150, 7)):
        got = corpus.shards(df, "first", "n", "target", chars, group).collect()
        want = [(k, i, s, b) for k, own in by.items() for (i, s), b in zip(own, corpus.assign_shards([s for _, s in own], chars, group), strict=True)]
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_a_row_above_the_limit_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(greedy, "ROWS", 10)
    with pytest.raises(Exception, match="exceeds the limit 5"):
        chunking.batches_by_budget(frame(spark, [("a", i, i) for i in range(30)]), "target", 5, 6, "n", "first").collect()


def test_work_on_one_group_has_many_tasks(spark, monkeypatch):
    """The group's rows reach the block search in as many groups as there are blocks, each with its rows and few more."""
    monkeypatch.setattr(greedy, "ROWS", 50)
    seen = []
    real = greedy.cut
    monkeypatch.setattr(greedy, "cut", lambda df: seen.append(real(df)) or seen[-1])
    rows = frame(spark, [("one", i, 1) for i in range(1000)])
    got = {r["n"]: r["batch"] for r in chunking.batches_by_budget(rows, "target", 30, 8, "n", "first").collect()}
    assert got == {i: i // 8 for i in range(1000)}
    dealt, jumps = seen[0], next(df for df in seen if "leaves" in df.columns)
    sizes = [r["count"] for r in dealt.groupBy("block").count().collect()]
    assert len(sizes) >= 15 and max(sizes) <= 150 and jumps.count() == len(sizes)
    plan = jumps._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


@given(st.lists(st.integers(0, 9), min_size=1, max_size=60), st.integers(1, 60), st.integers(1, 30), st.integers(1, 7))
@settings(max_examples=300, deadline=None)
def test_ends_are_those_of_the_folds(sizes, rows, limit, most):
    through = np.cumsum(sizes)
    before, n = through - sizes, len(sizes)
    limit = max(limit, max(sizes))
    ends = greedy.Filled(limit, most).ends(before, through, n, n)
    for i in range(n):
        assert ends[i] - i == chunking.fill_batches(sizes[i:], limit, most).count(0)
    ends = greedy.Reached(limit, most).ends(before, through, n, n)
    for i in range(n):
        first = corpus.assign_shards(sizes[i:], limit, most).count(0)
        assert ends[i] == (i + first if first else greedy.NEVER)
