"""Near-duplicate vectors by cover trees traversed in pairs.

Vectors are scaled to length 1, so cosine and distance decide alike.  A cover tree has nested
levels whose radii halve: a level keeps the centres of the one above, any two centres of a level
lie farther apart than its radius, and every row lies within the radius of a centre.  Each centre
knows its exact covering radius, the distance of the farthest row below it.

The upper levels, fitted on a bounded sample, cut the rows into cells, and cells into blocks.  Two
blocks meet only in the rows that the covering radius of the other's cell can't rule out; there the
trees of both sides are traversed together, level by level: a pair of nodes farther apart than both
covering radii and the reach is dropped, a pair entirely within reach is taken whole, and only what
is left at the lowest level is compared row by row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Scratch, parts, ship
from .components import components
from .vectors import by_width, matrix, usable, widths

#: Rows the upper levels are fitted on, cells at most, rows that a cell is meant for and a block holds at most, and at least where there are more tasks than that asks for.
SAMPLE, CELLS_MOST, BLOCK, BLOCK_LEAST = 20_000, 4_096, 8_192, 256
#: Rows to a side of one matrix product; the radius of the lowest level.
SIDE, LOWEST = 1_024, 2.0**-6
#: Slack of distances, and of dot products in single precision, which only tell what is looked at in double precision.
_EPS, _ROUGH = 1e-7, 1e-5


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows of ``a`` to all of ``b``, of length 1 all."""
    return np.sqrt(np.maximum(0, 2 - 2 * (a @ b.T)))


@dataclass
class Tree:
    """Levels from the root down: rows that are centres, their covering radii and where their children start.

    Centres and rows are in the order of the tree: the children of a centre follow one another, and
    so do the rows below it (``below``), of which the first is the centre itself.  ``starts`` tells
    for the nodes of a level where their children start in the next.
    """

    x: np.ndarray
    short: np.ndarray
    centers: list[np.ndarray]
    radii: list[np.ndarray]
    starts: list[np.ndarray]
    below: list[np.ndarray]


def tree_of(x: np.ndarray, paths: np.ndarray) -> Tree:
    """The tree of rows in its order, from the node that each row has at each level.

    Where some of a tree's rows are missing, the first row left of a node is its centre; covering
    radii are taken anew, so they are exact in any case.
    """
    tree = Tree(x, x.astype(np.float32), [], [], [], [])
    for path in paths.T:
        first = np.flatnonzero(np.concatenate(([True], path[1:] != path[:-1])))
        edges = np.append(first, len(x))
        center = np.repeat(first, np.diff(edges))
        far = np.empty(len(x))
        for i in range(0, len(x), SIDE):
            far[i : i + SIDE] = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("ij,ij->i", x[i : i + SIDE], x[center[i : i + SIDE]])))
        tree.centers.append(first)
        tree.radii.append(np.maximum.reduceat(far, first))
        tree.below.append(edges)
    tree.starts = [np.searchsorted(inner, outer) for outer, inner in zip(tree.below[:-1], tree.below[1:], strict=True)]
    return tree


def _nearest(x: np.ndarray, picked: list[int], near: np.ndarray, own: np.ndarray, start: int) -> None:
    """Bring ``near`` and ``own``, the nearest of the first ``start`` centres, up to date."""
    for j in range(start, len(picked), SIDE):
        new = np.array(picked[j : j + SIDE])
        for i in range(0, len(x), SIDE):
            d = distance(x[i : i + SIDE], x[new])
            best = d.argmin(1)
            least = d[np.arange(len(d)), best]
            closer = least < near[i : i + SIDE]
            near[i : i + SIDE][closer] = least[closer]
            own[i : i + SIDE][closer] = j + best[closer]


def _refine(x: np.ndarray, picked: list[int], near: np.ndarray, own: np.ndarray, radius: float, most: int | None = None) -> bool:
    """Add centres until every row is within ``radius`` of one; centres stay farther apart than that.

    False, with the work of this level to be thrown away, where that takes more than ``most``.
    """
    while True:
        free = np.flatnonzero(near > radius)[:SIDE]
        if not len(free):
            return True
        apart, start = distance(x[free], x[free]), len(picked)
        covered = np.zeros(len(free), dtype=bool)
        for i in range(len(free)):
            if not covered[i]:
                picked.append(int(free[i]))
                covered |= apart[i] <= radius
                covered[i] = True
        if most is not None and len(picked) > most:
            return False
        _nearest(x, picked, near, own, start)
        near[picked[start:]], own[picked[start:]] = 0.0, np.arange(start, len(picked))


def upper_levels(x: np.ndarray, most: int) -> np.ndarray:
    """Centres of the finest level, of radii 2, 1, 1/2 and so on, that has ``most`` nodes or fewer."""
    picked, near, own, radius = [0], distance(x, x[:1])[:, 0], np.zeros(len(x), np.int64), 2.0
    while radius > LOWEST:
        radius /= 2
        before = len(picked)
        if not _refine(x, picked, near, own, radius, most):
            return x[picked[:before]]
    return x[picked]


def build(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cover tree of rows of length 1: the order of its rows, and the node that each of them, so ordered, has at each level."""
    n = len(x)
    picked, near, own = [0], distance(x, x[:1])[:, 0], np.zeros(n, np.int64)
    levels, counts, radius = [own.copy()], [1], 2.0  # the centre of each row at each level
    while radius > LOWEST and len(picked) < n:
        radius /= 2
        before = len(picked)
        _refine(x, picked, near, own, radius)
        if len(picked) > before:
            levels.append(own.copy())
            counts.append(len(picked))
    rows = np.array(picked)
    # a centre hangs below the centre that its own row belongs to; its own child comes first, as it was picked first
    place = [np.zeros(1, np.int64)]
    parents = [levels[k][rows[: counts[k + 1]]] for k in range(len(levels) - 1)]
    for parent in parents:
        at = np.empty(len(parent), np.int64)
        at[np.lexsort((np.arange(len(parent)), place[-1][parent]))] = np.arange(len(parent))
        place.append(at)
    leaf = levels[-1]
    order = np.lexsort((rows[leaf] != np.arange(n), place[-1][leaf]))
    up, paths = leaf[order], []
    for k in range(len(levels) - 1, -1, -1):
        paths.insert(0, place[k][up])
        if k:
            up = parents[k - 1][up]
    return order, np.column_stack(paths)


def _spans(starts: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """The children of all ``nodes``."""
    first, many = starts[nodes], starts[nodes + 1] - starts[nodes]
    return np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())


def dual_traversal(a: Tree, b: Tree, cosine: float, seen: list[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
    """(rows of a, rows of b, hits): hits is a matrix, or None where all pairs are within reach.

    Rows are places in the order of the trees.  ``seen`` counts distances taken, of nodes and of rows.
    """
    reach, seen = math.sqrt(2 - 2 * cosine), [0] if seen is None else seen
    # each node of one level of a with the nodes of one level of b that may be near it; the shallower tree waits at its lowest level
    depth, work = max(len(a.centers), len(b.centers)), [(0, np.array([0]))]
    for level in range(depth):
        i, j = min(level, len(a.centers) - 1), min(level, len(b.centers) - 1)
        after = []
        for node, others in work:
            own = np.array([node]) if level == 0 or i < level else np.arange(a.starts[i - 1][node], a.starts[i - 1][node + 1])
            met = others if level == 0 or j < level else _spans(b.starts[j - 1], others)
            # wide nodes apart from narrow ones, so that the widest of a tile says something
            own, met = own[np.argsort(a.radii[i][own], kind="stable")], met[np.argsort(b.radii[j][met], kind="stable")]
            kept: list[list[np.ndarray]] = [[] for _ in own]
            for p in range(0, len(own), SIDE):
                left = own[p : p + SIDE]
                for q in range(0, len(met), SIDE):
                    right = met[q : q + SIDE]
                    dots = a.short[a.centers[i][left]] @ b.short[b.centers[j][right]].T
                    seen[0] += dots.size
                    ra, rb = a.radii[i][left], b.radii[j][right]
                    limit = ra + rb.max() + reach + _EPS
                    s, t = np.nonzero(dots >= (1 - 0.5 * np.minimum(limit, 2) ** 2 - _ROUGH).astype(np.float32)[:, None])
                    near = dots[s, t] >= 1 - 0.5 * np.minimum(ra[s] + rb[t] + reach + _EPS, 2) ** 2 - _ROUGH
                    s, t = s[near], t[near]
                    d = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("ij,ij->i", a.x[a.centers[i][left[s]]], b.x[b.centers[j][right[t]]])))
                    whole = d + ra[s] + rb[t] < reach - _EPS if len(d) else np.zeros(0, bool)
                    for u, v in zip(left[s[whole]].tolist(), right[t[whole]].tolist(), strict=True):
                        yield np.arange(a.below[i][u], a.below[i][u + 1]), np.arange(b.below[j][v], b.below[j][v + 1]), None
                    near = (d <= ra[s] + rb[t] + reach + _EPS) & ~whole
                    s, t = s[near], right[t[near]]
                    cut = np.searchsorted(s, np.arange(len(left) + 1))
                    for k in np.flatnonzero(cut[1:] > cut[:-1]):
                        kept[p + k].append(t[cut[k] : cut[k + 1]])
            after += [(int(own[k]), np.sort(np.concatenate(c))) for k, c in enumerate(kept) if c]
        work = after
    for node, others in work:
        left, met = np.arange(a.below[-1][node], a.below[-1][node + 1]), _spans(b.below[-1], others)
        for p in range(0, len(left), SIDE):
            for q in range(0, len(met), SIDE):
                right = met[q : q + SIDE]
                hits = a.x[left[p : p + SIDE]] @ b.x[right].T >= cosine
                seen[0] += hits.size
                if hits.any():
                    yield left[p : p + SIDE], right, hits


def _links(ids: np.ndarray, x: np.ndarray, weight: np.ndarray, side: np.ndarray, paths: list[np.ndarray], cosine: float) -> pa.Table:
    """Weighted link counts of the rows of a block, or of two blocks, and edges that join what is linked.

    Rows come with their paths; two paths of a block differ where their rows are in different nodes.
    """
    same = bool((side == 2).all())
    one, two = (np.flatnonzero(side != 1), np.flatnonzero(side != 0))
    if not len(one) or not len(two):
        return pa.table({"id": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "to": pa.array([], pa.int64())})

    def tree(at: np.ndarray) -> tuple[np.ndarray, Tree]:
        path = np.stack([paths[i] for i in at])  # levels of the tree, then the row's place in its order
        at, path = at[np.argsort(path[:, -1])], path[np.argsort(path[:, -1])]
        return at, tree_of(x[at], path[:, :-1])

    one, a = tree(one)
    two, b = (one, a) if same else tree(two)
    links, top, pairs = np.zeros(len(ids), np.int64), ids.copy(), []
    for p, q, hits in dual_traversal(a, b, cosine):
        p, q = one[p], two[q]
        if hits is None:
            links[p] += weight[q].sum()
            if not same:
                links[q] += weight[p].sum()
            # the whole pair is one class: tie all to the first of each side
            pairs += [(p, np.full(len(p), q[0])), (np.full(len(q), p[0]), q)]
        else:
            links[p] += hits @ weight[q]
            if not same:
                links[q] += weight[p] @ hits
            i, j = np.nonzero(hits)
            pairs.append((p[i], q[j]))
    if pairs:
        i, j = (np.concatenate(c) for c in zip(*pairs, strict=True))
        while True:  # smallest id along the pairs, until nothing changes
            before = top.copy()
            np.minimum.at(top, i, top[j])
            np.minimum.at(top, j, top[i])
            if (before == top).all():
                break
    keep = (links > 0) | (top != ids)
    return pa.table({"id": ids[keep], "n": links[keep], "to": top[keep]})


def near_duplicates(table: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept) of every row: exact links of cosine >= ``cosine``.

    Equal vectors are compared once and weighted; they link with one another.  Rows whose vector
    is null, zero or holds null or non-finite parts link with nothing, as do rows without an id,
    which have a null component and are kept.  Vectors link only with vectors of their own width;
    all widths but the most frequent make a cell each.  Rows that share an id count as separate
    vectors in one class.  Other columns are ignored, whatever their names; an empty table gives
    an empty result.

    The driver gets ``SAMPLE`` rows, a count for each width and figures of ``CELLS_MOST`` cells.
    """
    spark = table.sparkSession
    ship(spark)
    scratch = Scratch(spark, "near")
    rows = usable(table, id_col, vector_col)
    distinct = rows.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("weight"))

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, x in by_width(b.column(0)):
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays([b.column(1).take(take), b.column(2).take(take), pa.array(list(unit(x)), pa.list_(pa.float64()))], ["id", "weight", "u"])

    units = scratch.write(distinct.mapInArrow(scale, "id long, weight long, u array<double>"), "units")
    known = widths(units, "u")
    everyone = table.select(F.col(f"`{id_col}`").cast("long").alias("id"))
    if not known:
        return everyone.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    width = known[0][0]
    sample = units.where(F.size("u") == width).orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()
    centers = upper_levels(matrix(sample["u"]), int(min(CELLS_MOST, max(1, known[0][1] // BLOCK))))
    other = {w: len(centers) + k for k, (w, _) in enumerate(known[1:])}
    shared = spark.sparkContext.broadcast((centers, other))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, x in by_width(b.column(2)):
                centers, other = shared.value
                if x.shape[1] in other:
                    cell, far = np.full(len(at), other[x.shape[1]]), np.full(len(at), 2.0)
                else:
                    dots = x @ centers.T
                    cell = dots.argmax(1)
                    far = np.sqrt(np.maximum(0, 2 - 2 * dots[np.arange(len(cell)), cell]))
                rows = b.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(cell.astype(np.int32)), pa.array(far)], ["id", "weight", "u", "cell", "far"])

    dealt = scratch.write(units.mapInArrow(deal, "id long, weight long, u array<double>, cell int, far double"), "cells")
    scratch.drop("units")
    figures = dealt.groupBy("cell").agg(F.max("far").alias("far"), F.count("*").alias("n")).collect()  # a row for each cell
    radius, many = np.full(len(centers) + len(other), -np.inf), np.zeros(len(centers) + len(other), dtype=np.int64)
    # pairs of blocks are the tasks: as many blocks as give each task of a shuffle a pair, where there are rows enough
    block_rows = min(BLOCK, max(BLOCK_LEAST, math.ceil(sum(n for _, n in known) / math.sqrt(2 * parts(spark)))))
    for r in figures:
        radius[r["cell"]], many[r["cell"]] = r["far"], -(-r["n"] // block_rows)
    first = np.cumsum(many) - many
    plan = spark.sparkContext.broadcast((radius, first, many))
    reach = math.sqrt(2 - 2 * cosine)

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, first, many = plan.value
        for b in batches:
            cell = b.column(3).to_numpy()
            mixed = (b.column(0).to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            own = first[cell] + mixed.astype(np.int64) % many[cell]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(own)], ["id", "weight", "u", "cell", "block"])

    def plant(part: pa.Table) -> pa.Table:
        part = part.sort_by("id")
        order, path = build(matrix(part["u"]))
        return part.take(pa.array(order)).append_column("path", pa.array(list(np.column_stack([path, np.arange(len(path))]).astype(np.int32)), pa.list_(pa.int32())))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row to its own block, and to each pair of it with a block whose cell can hold a neighbour."""
        centers = shared.value[0]
        radius, first, many = plan.value
        for b in batches:
            for at, x in by_width(b.column(2)):
                cell, own = b.column(3).to_numpy()[at], b.column(4).to_numpy()[at]
                if x.shape[1] == centers.shape[1]:
                    i, met = np.nonzero(distance(x, centers) <= radius[None, : len(centers)] + reach + _EPS)
                else:
                    i, met = np.arange(len(at)), cell
                times = many[met]
                i, met = np.repeat(i, times), np.repeat(first[met], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                low, high = np.minimum(own[i], met), np.maximum(own[i], met)
                side = np.where(low == high, 2, (own[i] == high).astype(np.int64))
                rows = b.take(pa.array(at[i]))
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), rows.column(2), rows.column(5), pa.array(low), pa.array(high), pa.array(side.astype(np.int8))], ["id", "weight", "u", "path", "low", "high", "side"])

    def run(part: pa.Table) -> pa.Table:
        return _links(part["id"].to_numpy(), matrix(part["u"]), part["weight"].to_numpy(), part["side"].to_numpy(), part["path"].combine_chunks().to_numpy(zero_copy_only=False), cosine)

    columns = "id long, weight long, u array<double>, cell int, block long"
    planted = dealt.mapInArrow(block, columns).groupBy("block").applyInArrow(plant, f"{columns}, path array<int>")
    met = scratch.write(planted, "trees").mapInArrow(visit, "id long, weight long, u array<double>, path array<int>, low long, high long, side byte")
    found = scratch.write(met.groupBy("low", "high").applyInArrow(run, "id long, n long, to long"), "found")
    scratch.drop("trees")
    scratch.drop("cells")
    counts = found.groupBy("id").agg((F.sum("n") - 1).alias("n_links"))
    equal = rows.join(distinct.select(F.col("v").alias("w"), F.col("id").alias("rep")), F.col("v") == F.col("w")).select("id", "rep")
    equal = scratch.write(equal.distinct(), "members")
    # copies are attached after the rounds; only an id that stands for several vectors ties their classes within them
    several = equal.groupBy("id").count().where("count > 1").select("id")
    ties = equal.join(several, "id", "left_semi").where("id <> rep").select("id", "rep")
    classes = components(found.where("id <> to").select(F.col("id").alias("a"), F.col("to").alias("b")).union(ties), scratch, "classes")
    member = equal.join(classes.withColumnRenamed("node", "rep"), "rep", "left").join(counts.withColumnRenamed("id", "rep"), "rep", "left")
    linked = member.groupBy("id").agg(F.max("n_links").alias("n_links"), F.min(F.coalesce("component", "rep")).alias("component"))
    out = everyone.join(linked, "id", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("id").isNull() | (F.col("id") == component)).alias("kept"))


#: The same in SQL, over ``embeddings``, for a cosine of 0.95.
SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.95),
r AS (SELECT vec_id, vec_id AS seen FROM v UNION SELECT r.vec_id, l.b FROM r JOIN l ON l.a = r.seen),
c AS (SELECT vec_id, MIN(seen) AS component_id FROM r GROUP BY 1)
SELECT v.vec_id, (SELECT COUNT(*) FROM l WHERE l.a = v.vec_id) AS n_links, component_id, v.vec_id = component_id AS kept FROM v JOIN c USING (vec_id)
"""
