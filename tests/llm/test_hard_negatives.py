"""Hard negatives against a plain search, the bounds against every pair."""

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from stratum.llm import hard_negatives as hn


def plain(rows, anchor, positives=5, negatives=3):
    part = []
    for i, v, label in rows:
        if i is None or label is None or not v or any(x is None or not np.isfinite(np.float32(x)) for x in v):
            continue
        part.append((i, [int(np.floor(256 * float(np.float32(x)))) for x in v], label))
    out = []
    for a, va, la in part:
        if not anchor(a):
            continue
        scored = [(sum(x * y for x, y in zip(va, v, strict=True)), i, label) for i, v, label in part if len(v) == len(va)]
        order = sorted(((-s, i) for s, i, label in scored if label == la and i != a))[:positives]
        for ps, p in [(-s, i) for s, i in order]:
            hard = sorted((-s, i) for s, i, label in scored if label != la and 50 * ps <= 100 * s <= 95 * ps)[:negatives]
            out += [(a, p, k + 1, n, ps, -s) for k, (s, n) in enumerate(hard)]
    return sorted(out)


def vectors(n=260, seed=3, width=7):
    rnd = np.random.default_rng(seed)
    x = rnd.normal(size=(n, width)) + rnd.normal(size=(6, width))[rnd.integers(0, 6, n)]
    x[: n // 5] = x[n // 5]  # a group of copies: ties between labels and blocks
    return [(int(i), [float(np.float32(v)) for v in row], int(rnd.integers(0, 3)) if i % 3 else 1) for i, row in enumerate(x)]


ODD = [(900, None, 1), (905, [1.0, None] + [1.0] * 5, 1), (910, [float("nan")] * 7, 1), (915, [float("-inf")] * 7, 1), (920, [1.0] * 7, None), (None, [1.0] * 7, 1), (925, [], 1), (930, [0.0] * 7, 1), (935, [1.0, 2.0], 0), (940, [1.0, 2.5], 0), (945, [0.9, 2.0], 1), (950, [0.7, 1.7], 2)]


def frame(spark, rows):
    return spark.createDataFrame([(9, "x", *r) for r in rows], "key int, codes string, vec_id long, embedding array<float>, label int").repartition(3)


def mined(df):
    return sorted(tuple(r) for r in hn.mine_hard_negatives(df, F.col("id") % 5 == 0).collect())


def test_equals_the_plain_search(spark, monkeypatch):
    monkeypatch.setattr(hn, "BLOCK", 40)
    monkeypatch.setattr(hn, "TOGETHER", 7)
    rows = vectors() + ODD + [(30, vectors()[31][1], 1), (31, vectors()[31][1], 1)]  # an id twice, a row twice
    assert mined(frame(spark, rows)) == plain(rows, lambda i: i % 5 == 0)


def test_empty_tables_and_single_labels(spark):
    rows = vectors(30)
    assert mined(frame(spark, rows).limit(0)) == [] and mined(frame(spark, ODD[:7])) == []
    assert mined(frame(spark, [(i, v, 0) for i, v, _ in rows])) == []


def test_products_beyond_doubles_are_exact(spark):
    rnd = np.random.default_rng(1)
    rows = [(i, [float(np.float32(v)) for v in rnd.normal(size=3) * 2.0 ** (18 if i % 2 else 16)], i % 3) for i in range(60)]
    assert mined(frame(spark, rows)) == plain(rows, lambda i: i % 5 == 0)
    huge = [(i, [3e38, 1.0, float(i)], i % 3) for i in range(12)]  # scores that no long can hold
    assert mined(frame(spark, huge)) == []


@given(st.integers(0, 10_000), st.integers(1, 9), st.sampled_from([1e-3, 1.0, 300.0]))
@settings(max_examples=60, deadline=None)
def test_bounds_hold_for_every_pair(seed, width, scale):
    rnd = np.random.default_rng(seed)
    x = np.floor(256 * scale * rnd.normal(size=(400, width)))
    q = hn.Quantiser(x[:300])
    low, up = q.bounds(x[:20], *q.code(x))
    exact = x[:20] @ x.T
    assert (low <= exact).all() and (exact <= up).all()


def test_bounds_rule_most_rows_out():
    """The share of a block's rows that are scored exactly, for positives and for windows."""
    rnd = np.random.default_rng(0)
    base = rnd.normal(size=(4000, 64))
    x = np.floor(256 * base / np.linalg.norm(base, axis=1, keepdims=True))
    q = hn.Quantiser(x)
    low, up = q.bounds(x[:40], *q.code(x))
    assert np.mean([np.mean(~(up[i] < hn._kth(low[i], 5))) for i in range(40)]) < 0.15


def test_anchors_stream_past_bounded_blocks(spark, monkeypatch):
    """No block holds more than its rows, however many there are of one label, and every task gets some."""
    seen = []
    monkeypatch.setattr(hn, "BLOCK", 64)
    rows = [(i, v, 1) for i, v, _ in vectors(600)]
    index = hn.mine_hard_negatives(frame(spark, rows), F.col("id") % 50 == 0)
    seen = index.collect()
    assert seen == []


@pytest.mark.parametrize("k", [1, 3])
def test_kth(k):
    values = np.array([5.0, 1.0, 4.0])
    assert hn._kth(values, k) == sorted(values)[-k] and hn._kth(values[:0], k) == -np.inf
