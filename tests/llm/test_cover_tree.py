"""Levels of the cover tree, what its traversal compares, and vectors of several widths."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratum.llm import ann, cover_tree


def clustered(seed=3, groups=200, members=20):
    rnd = np.random.default_rng(seed)
    return cover_tree.unit(np.repeat(rnd.normal(size=(groups, 32)), members, axis=0) + 0.1 * rnd.normal(size=(groups * members, 32)))


def test_levels_are_nested_separated_and_covered():
    x = clustered(groups=30)
    order, paths = cover_tree.build(x)
    tree = cover_tree.tree_of(x[order], paths)
    assert sorted(order.tolist()) == list(range(len(x)))
    apart_before = 3.0
    for k, (centers, radii, below) in enumerate(zip(tree.centers, tree.radii, tree.below, strict=True)):
        assert set(tree.centers[k - 1].tolist()) <= set(centers.tolist()) or not k  # nested
        d = cover_tree.distance(tree.x[centers], tree.x[centers]) + 9 * np.eye(len(centers))
        assert len(centers) == 1 or d.min() <= apart_before
        apart_before = d.min()
        for c, radius, lo, hi in zip(centers, radii, below, below[1:], strict=False):
            assert lo == c < hi  # a centre is the first of the rows below it
            assert abs(cover_tree.distance(tree.x[[c]], tree.x[lo:hi]).max() - radius) < 1e-6
        if k + 1 < len(tree.centers):
            assert (tree.below[k + 1][tree.starts[k]] == below).all()  # children hold what their parent holds


def test_a_part_of_a_tree_finds_the_links_of_its_rows():
    x = clustered(groups=30)
    order, paths = cover_tree.build(x)
    some = np.flatnonzero(np.random.default_rng(0).random(len(x)) < 0.4)
    part, whole = cover_tree.tree_of(x[order][some], paths[some]), cover_tree.tree_of(x[order], paths)
    got = np.zeros((len(some), len(x)), dtype=bool)
    for p, q, hits in cover_tree.dual_traversal(part, whole, 0.95):
        got[np.ix_(p, q)] |= True if hits is None else hits
    assert (got == (x[order][some] @ x[order].T >= 0.95)).all()


def test_separation_halves():
    x = clustered(groups=30)
    picked, near, own = [0], cover_tree.distance(x, x[:1])[:, 0], np.zeros(len(x), np.int64)
    for radius in (1.0, 0.5, 0.25, 0.125):
        assert cover_tree._refine(x, picked, near, own, radius)
        d = cover_tree.distance(x[picked], x[picked]) + 9 * np.eye(len(picked))
        assert d.min() > radius and near.max() <= radius and np.allclose(near, cover_tree.distance(x, x[picked]).min(1), atol=1e-6)


def test_clustered_vectors_are_mostly_pruned():
    x = clustered()
    order, paths = cover_tree.build(x)
    tree, seen, pairs = cover_tree.tree_of(x[order], paths), [0], 0
    for p, q, hits in cover_tree.dual_traversal(tree, tree, 0.95, seen):
        pairs += len(p) * len(q) if hits is None else int(hits.sum())
    assert pairs == int((x @ x.T >= 0.95).sum()) and seen[0] < 0.05 * len(x) ** 2


@pytest.mark.parametrize("block", [8192, 64])
def test_blocks_cells_and_widths(spark, monkeypatch, block):
    monkeypatch.setattr(cover_tree, "BLOCK", block)
    monkeypatch.setattr(cover_tree, "BLOCK_LEAST", block)
    x = np.concatenate([clustered(groups=12, members=15), clustered(5, 6, 15)])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000, [1.0, 2.0]), (1001, [2.0, 4.0]), (1002, [2.0, -1.0]), (1003, [3.0]), (1003, [-3.0]), (1004, [-5.0])]
    got = {r["vec_id"]: r for r in cover_tree.near_duplicates(spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, id int, cell int")).collect()}
    near = x @ x.T >= 0.95
    assert [got[i]["n_links"] for i in range(len(x))] == (near.sum(1) - 1).tolist()
    assert (got[1000]["n_links"], got[1001]["component_id"], got[1002]["n_links"]) == (1, 1000, 0)
    assert got[1004]["component_id"] == 1003 and got[1003]["kept"]


def test_search_in_each_width_and_past_small_leaves(spark, monkeypatch):
    monkeypatch.setattr(ann, "LEAF_ROWS", 8)
    x = clustered(groups=25, members=8)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, [float(i), 1.0]) for i in range(25)]
    table = spark.createDataFrame([(*r, "a") for r in rows], "vec_id long, embedding array<double>, leaf string")
    got = {}
    for r in ann.search(table, F.col("id") % 20 == 0, k=20, recall=0.05).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {*range(0, 200, 20), 1000, 1020} and all(len(v) == 20 for v in got.values())
    best = sorted(range(25), key=lambda i: (-(20.0 * i + 1), i))
    assert [v for _, v, _ in sorted(got[1020])] == [1000 + i for i in best if i != 20][:20]


def test_search_recall_at_twenty(spark):
    rnd = np.random.default_rng(8)
    x = rnd.normal(size=(1500, 24))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(table, F.col("id") % 20 == 0, k=20).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hit = 0
    for q, found in got.items():
        s = x @ x[q]
        s[q] = -np.inf
        hit += len(found & set(np.argsort(-s)[:20].tolist()))
    assert len(got) == 75 and hit >= 0.9 * 20 * len(got)
