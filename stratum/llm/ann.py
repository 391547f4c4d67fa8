"""Nearest neighbours by inner product over a hierarchical k-means tree, leaves visited best bin first."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import Scratch, parts, ship
from .vectors import by_width, matrix, usable, widths

#: Rows the tree is fitted on at most, children of a node, rows a leaf is meant for, leaves at most.
FIT_ROWS, BRANCH, LEAF_ROWS, LEAVES_MOST = 20_000, 8, 200, 4_096
#: Queries that recall is calibrated on, recall aimed at, rows searched together at most and, where there are more tasks than that asks for, at least.
CALIBRATE, RECALL, BLOCK, BLOCK_LEAST = 128, 0.95, 8_192, 256


@dataclass
class Tree:
    """Nodes in order of creation: centres, first child and number of children, leaf number or -1."""

    centers: np.ndarray
    children: list[tuple[int, int]] = field(default_factory=list)
    leaf: list[int] = field(default_factory=list)

    @property
    def leaves(self) -> int:
        return max(self.leaf, default=-1) + 1

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row: down the tree by the nearest centre."""
        out = np.zeros(len(x), dtype=np.int64)
        stack = [(0, np.arange(len(x)))]
        while stack:
            node, rows = stack.pop()
            first, n = self.children[node]
            if not n:
                out[rows] = self.leaf[node]
                continue
            c = self.centers[first : first + n]
            near = (x[rows] @ c.T - 0.5 * (c * c).sum(1)).argmax(1)
            stack += [(first + k, rows[near == k]) for k in range(n) if (near == k).any()]
        return out

    def best_bins(self, q: np.ndarray, most: int, sizes: np.ndarray | None = None, least: int = 0) -> list[int]:
        """The first ``most`` leaves, or more until they hold ``least`` rows, by a queue of nodes with the largest product with their centres."""
        dots = self.centers @ q
        queue, out, held = [(-dots[0], 0)], [], 0
        while queue and (len(out) < most or held < least):
            _, node = heapq.heappop(queue)
            first, n = self.children[node]
            if not n:
                out.append(self.leaf[node])
                held += 0 if sizes is None else int(sizes[self.leaf[node]])
            for k in range(first, first + n):
                heapq.heappush(queue, (-dots[k], k))
        return out


def _kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Cluster of each row; centres start at rows far from one another."""
    start = [0]
    far = ((x - x[0]) ** 2).sum(1)
    for _ in range(k - 1):
        start.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[start[-1]]) ** 2).sum(1))
    c = x[start].copy()
    for _ in range(rounds):
        near = (x @ c.T - 0.5 * (c * c).sum(1)).argmax(1)
        for j in range(k):
            if (near == j).any():
                c[j] = x[near == j].mean(0)
    return near


def fit_tree(x: np.ndarray, leaves: int) -> Tree:
    """Split the largest groups first, ``BRANCH`` ways, until there are about ``leaves`` leaves."""
    centers, children, rows = [x.mean(0)], [(0, 0)], {0: np.arange(len(x))}
    queue, count = [(-len(x), 0)], 1
    while queue and count < leaves:
        n, node = heapq.heappop(queue)
        own = rows[node]
        if -n < 2 * BRANCH:
            break
        near = _kmeans(x[own], BRANCH)
        groups = [own[near == k] for k in range(BRANCH) if (near == k).any()]
        if len(groups) < 2:
            continue  # equal rows: can't be split
        children[node] = (len(centers), len(groups))
        for g in groups:
            rows[len(centers)] = g
            heapq.heappush(queue, (-len(g), len(centers)))
            centers.append(x[g].mean(0))
            children.append((0, 0))
        count += len(groups) - 1
    leaf, k = [], 0
    for _, n in children:
        leaf.append(-1 if n else k)
        k += not n
    return Tree(np.array(centers), children, leaf)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest scores, ties to smaller ids."""
    if len(ids) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= least)
    else:
        some = np.arange(len(ids))
    return some[np.lexsort((ids[some], -scores[some]))[:k]]


def pair_scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner product of each row with ``q``, added up in the order of the components: equal rows score equally wherever they stand."""
    out = np.zeros(len(x))
    for d in range(x.shape[1]):
        out += x[:, d] * q[d]
    return out


def near_best(scores: np.ndarray, k: int, slack: float) -> np.ndarray:
    """Places of the rows that may be among the ``k`` largest when each score is off by up to ``slack``."""
    least = np.partition(scores, len(scores) - k)[len(scores) - k] if len(scores) > k else -np.inf
    return np.flatnonzero((scores >= least - 2 * slack) & (scores > -np.inf))


def _blocks(sizes: np.ndarray, alone: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """First block and number of blocks of each leaf: leaves that follow one another share a block up to ``most`` rows, those from ``alone`` on share none."""
    first, many, block, used = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64), 0, 0
    for leaf, n in enumerate(sizes.tolist()):
        if used and (used + n > most or leaf >= alone):
            block, used = block + 1, 0
        first[leaf], many[leaf] = block, max(1, -(-n // most))
        used += n
        if n > most:
            block, used = block + int(many[leaf]), 0
    return first, many


def search(table: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows found of each query row, its own excluded.

    ``queries``: a condition on column ``id``.  The tree is fitted on at most ``FIT_ROWS`` rows (those
    with the smallest hashes of their ids), but every row is indexed.  How many leaves a query
    visits is widened until the true neighbours of ``CALIBRATE`` queries, found by comparing them
    with all rows, are in the visited leaves with the aimed-at recall, and for each query until
    its leaves hold more than ``k`` rows.  Leaves are searched in blocks of rows, at least two for
    each task of a shuffle where there are rows enough, so a leaf of any size is spread.  A matrix
    product finds the candidates, with what its rounding may be off; scores are then added up in
    float64 in the order of the components, so equal vectors have equal scores, ranked by id.

    Rows with null ids or unusable vectors take no part.  A vector's candidates are those of its
    own width; widths other than the most frequent are a leaf each, compared whole.  Rows that
    share an id are separate candidates, except that none with the query's id is returned.  Other
    columns are ignored, whatever their names; an empty table gives an empty result.
    """
    spark = table.sparkSession
    ship(spark)
    scratch = Scratch(spark, "ann")
    rows = usable(table, id_col, vector_col)
    schema, known = "query_id long, rank int, vec_id long, score double", widths(rows, "v")
    if not known:
        return spark.createDataFrame([], schema)
    width, total = known[0][0], sum(n for _, n in known)
    sample = rows.where(F.size("v") == width).orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS).toArrow()
    tree = fit_tree(matrix(sample["v"]), int(min(LEAVES_MOST, max(1, known[0][1] // LEAF_ROWS))))
    other = {w: tree.leaves + i for i, (w, _) in enumerate(known[1:])}
    shared = spark.sparkContext.broadcast((tree, other))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, other = shared.value
        for b in batches:
            for at, x in by_width(b.column(1)):
                leaf = np.full(len(at), other[x.shape[1]]) if x.shape[1] in other else tree.assign(x)
                rows_ = b.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*rows_.columns, pa.array(leaf.astype(np.int32))], ["id", "v", "leaf"])

    indexed = scratch.write(rows.mapInArrow(index, "id long, v array<double>, leaf int"), "index")
    sizes = np.zeros(tree.leaves + len(other), np.int64)
    for r in indexed.groupBy("leaf").count().collect():  # LEAVES_MOST numbers and one for each width at most
        sizes[r["leaf"]] = r["count"]
    asked = indexed.where(queries)

    trial = asked.where(F.size("v") == width).orderBy(F.xxhash64("id", F.lit(1)), "id").limit(CALIBRATE).toArrow()
    trial_ids, trial_q = trial["id"].to_numpy(), matrix(trial["v"])

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ids, x, leaf = b.column(0).to_numpy(), matrix(b.column(1)), b.column(2).to_numpy()
            scores = x @ trial_q.T
            got = [(j, ids[i], leaf[i], scores[i, j]) for j in range(len(trial_ids)) for i in _best(ids, np.where(ids == trial_ids[j], -np.inf, scores[:, j]), k) if ids[i] != trial_ids[j]]
            yield pa.RecordBatch.from_pandas(pd.DataFrame(got, columns=["q", "id", "leaf", "score"]).astype({"q": "int32", "id": "int64", "leaf": "int32", "score": "float64"}), preserve_index=False)

    visits = tree.leaves
    if trial.num_rows:
        order = Window.partitionBy("q").orderBy(F.desc("score"), "id")
        truth = indexed.where(F.size("v") == width).mapInArrow(brute, "q int, id long, leaf int, score double").withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).select("q", "leaf").toPandas()
        if len(truth):
            place = [{leaf: r for r, leaf in enumerate(tree.best_bins(q, tree.leaves))} for q in trial_q]
            at = np.sort([place[q][leaf] for q, leaf in zip(truth["q"], truth["leaf"], strict=True)])
            visits = int(at[min(len(at) - 1, int(np.ceil(recall * len(at))) - 1)]) + 1

    first, many = _blocks(sizes, tree.leaves, min(BLOCK, max(BLOCK_LEAST, -(-total // (2 * parts(spark))))))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf = b.column(2).to_numpy()
            part = (b.column(0).to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % many[leaf]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array((first[leaf] + part).astype(np.int32))], ["id", "v", "leaf", "block"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, other = shared.value
        for b in batches:
            for at, q in by_width(b.column(1)):
                rows_, blocks, listed = [], [], []
                for i, place in enumerate(at.tolist()):
                    own: dict[int, list[int]] = {}
                    for leaf in [other[q.shape[1]]] if q.shape[1] in other else tree.best_bins(q[i], visits, sizes, k + 1):
                        for block in range(int(first[leaf]), int(first[leaf] + many[leaf])):
                            own.setdefault(block, []).append(leaf)
                    rows_ += [place] * len(own)
                    blocks += own.keys()
                    listed += own.values()
                take = pa.array(rows_, pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(blocks, pa.int32()), pa.array(listed, pa.list_(pa.int32()))], ["id", "v", "block", "leaves"])

    probes = asked.repartition(parts(spark)).mapInArrow(probe, "id long, v array<double>, block int, leaves array<int>")
    dealt = indexed.mapInArrow(deal, "id long, v array<double>, leaf int, block int")

    def block_search(left: pa.Table, right: pa.Table) -> pa.Table:
        none = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not left.num_rows or not right.num_rows:
            return none
        ids, x, leaf = left["id"].to_numpy(), matrix(left["v"]), left["leaf"].to_numpy()
        own, q, wanted = right["id"].to_numpy(), matrix(right["v"]), right["leaves"].to_pylist()
        low, place = int(leaf.min()), leaf - int(leaf.min())
        # what a matrix product's order of summation may change of any score
        slack, out = 4e-16 * x.shape[1] * np.sqrt((x * x).sum(1).max()), []
        for a in range(0, len(own), 256):
            scores = q[a : a + 256] @ x.T
            asked_ = np.zeros((len(scores), int(place.max()) + 1), dtype=bool)
            for j, leaves in enumerate(wanted[a : a + 256]):
                asked_[j, [n - low for n in leaves if 0 <= n - low < asked_.shape[1]]] = True
            scores[~asked_[:, place]] = -np.inf
            for j in range(len(scores)):
                scores[j, ids == own[a + j]] = -np.inf
                some = near_best(scores[j], k, slack * np.sqrt((q[a + j] * q[a + j]).sum()))
                exact = pair_scores(x[some], q[a + j])
                best = _best(ids[some], exact, k)
                out.append((np.full(len(best), own[a + j]), ids[some[best]], exact[best]))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)]
        return pa.table({"query_id": cols[0], "vec_id": cols[1], "score": cols[2]})

    found = dealt.groupBy("block").cogroup(probes.groupBy("block")).applyInArrow(block_search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
