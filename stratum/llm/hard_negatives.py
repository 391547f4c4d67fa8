"""Hard negatives by product quantisation with stored residual norms and an exact integer rerank.

Vectors are scaled and floored to whole components.  Each is cut into short runs; a run is coded by
the nearest of up to 256 centres, and the norm of what the centre leaves over is stored beside the
code.  An anchor's product with a row is then, run by run, a looked-up product with the centre, off
by at most the anchor's norm times the stored norm.  These bounds rule out, without doubt, rows that
can't be among the nearest, or in a window of scores; the rest are scored in whole numbers.

Rows are dealt to blocks by their place; every anchor meets every block, streaming past it, so a
task holds one block and one batch of anchors.  Each block gives an anchor's best few, and a window
over those picks the best of all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import Scratch, parts, ship
from .vectors import matrix, widths

#: Rows that centres are fitted on at most, components of a run, centres of a run at most, rounds of the fit.
FIT_ROWS, RUN, CENTRES, ROUNDS = 20_000, 2, 256, 6
#: Rows of a block at most and, where there are more tasks than that asks for, at least; anchors scored together.
BLOCK, BLOCK_LEAST, TOGETHER = 16_384, 256, 128
#: Below this, sums of products of whole doubles are exact.
EXACT = float(1 << 53)


class Quantiser:
    """Centres of each run of a vector's components."""

    def __init__(self, x: np.ndarray) -> None:
        self.cuts = [slice(i, min(i + RUN, x.shape[1])) for i in range(0, x.shape[1], RUN)]
        self.centres = [self._fit(x[:, cut]) for cut in self.cuts]

    @staticmethod
    def _fit(x: np.ndarray) -> np.ndarray:
        seen = np.unique(x, axis=0)
        c = seen[np.linspace(0, len(seen) - 1, min(CENTRES, len(seen))).astype(int)]
        for _ in range(ROUNDS if len(seen) > CENTRES else 0):
            near = Quantiser._nearest(x, c)
            n = np.bincount(near, minlength=len(c))
            for d in range(x.shape[1]):
                c[:, d] = np.where(n > 0, np.bincount(near, x[:, d], len(c)) / np.maximum(n, 1), c[:, d])
        return c

    @staticmethod
    def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        half = 0.5 * (c * c).sum(1)
        return np.concatenate([(x[i : i + 4096] @ c.T - half).argmax(1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)

    def code(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(code of each run, norm of what is left over, rounded up) of each row."""
        codes, norms = np.zeros((len(x), len(self.cuts)), np.uint8), np.zeros((len(x), len(self.cuts)), np.float32)
        for m, (cut, c) in enumerate(zip(self.cuts, self.centres, strict=True)):
            codes[:, m] = self._nearest(x[:, cut], c)
            norms[:, m] = np.nextafter(np.sqrt(((x[:, cut] - c[codes[:, m]]) ** 2).sum(1)).astype(np.float32), np.float32(np.inf))
        return codes, norms

    def bounds(self, a: np.ndarray, codes: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lower, upper) bounds of the product of each anchor with each coded row."""
        near, off = np.zeros((len(a), len(codes))), np.zeros((len(a), len(codes)))
        for m, (cut, c) in enumerate(zip(self.cuts, self.centres, strict=True)):
            near += (a[:, cut] @ c.T)[:, codes[:, m]]
            off += np.sqrt((a[:, cut] ** 2).sum(1))[:, None] * norms[:, m]
        off += 1e-9 * (np.abs(near) + off) + 1e-6  # rounding of the bounds themselves
        return near - off, near + off


def whole_scores(x: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Exact products of whole components, as Python's whole numbers where doubles could round."""
    if not len(x) or np.abs(x).max() * np.abs(a).max() * len(a) < EXACT:
        return (x @ a).astype(np.int64)
    mine = [int(v) for v in a]
    return np.array([sum(int(v) * w for v, w in zip(row, mine, strict=True)) for row in x], dtype=object)


def _first(ids: np.ndarray, scores: np.ndarray, k: int) -> list[int]:
    """Places of the ``k`` largest scores that a long can hold, ties to smaller ids."""
    fits = [i for i in range(len(ids)) if -(1 << 63) <= scores[i] < 1 << 63] if scores.dtype == object else range(len(ids))
    return sorted(fits, key=lambda i: (-scores[i], ids[i]))[:k] if scores.dtype == object else np.lexsort((ids, -scores))[:k].tolist()


def _kth(values: np.ndarray, k: int) -> float:
    """The ``k``-th largest, or minus infinity if there are fewer."""
    return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k else -np.inf


class Block:
    """One block's rows, and which of them an anchor gets."""

    def __init__(self, quantiser: Quantiser | None, batches: list[pa.RecordBatch]) -> None:
        rows = pa.Table.from_batches(batches)
        self.ids, self.labels, self.x = rows["id"].to_numpy(), rows["label"].to_numpy(), matrix(rows["v"])
        self.quantiser = quantiser
        if quantiser:
            self.codes = np.frombuffer(b"".join(rows["codes"].to_pylist()), np.uint8).reshape(len(self.ids), -1)
            self.norms = matrix(rows["norms"])

    def bounds(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.quantiser:
            return self.quantiser.bounds(a, self.codes, self.norms)
        return np.full((len(a), len(self.ids)), -np.inf), np.full((len(a), len(self.ids)), np.inf)

    def positives(self, own: int, label: int, a: np.ndarray, low: np.ndarray, up: np.ndarray, k: int) -> Iterator[tuple[int, int]]:
        """(id, score) of the first ``k`` rows of the anchor's label and of another id."""
        same = np.flatnonzero((self.labels == label) & (self.ids != own))
        some = same[~(up[same] < _kth(low[same], k))]
        scores = whole_scores(self.x[some], a)
        yield from ((int(self.ids[some[i]]), int(scores[i])) for i in _first(self.ids[some], scores, k))

    def negatives(self, label: int, a: np.ndarray, low: np.ndarray, up: np.ndarray, k: int, least: int, most: int) -> Iterator[tuple[int, int]]:
        """(id, score) of the first ``k`` rows of other labels with scores from ``least`` to ``most``."""
        other = np.flatnonzero(self.labels != label)
        low, up = low[other], up[other]
        surely = _kth(low[(up <= most) & (low >= least)], k)
        some = other[~(low > most) & ~(up < max(least, surely))]
        scores = whole_scores(self.x[some], a)
        inside = np.array([least <= s <= most for s in scores], dtype=bool) if scores.dtype == object else (scores >= least) & (scores <= most)
        some, scores = some[inside], scores[inside]
        yield from ((int(self.ids[some[i]]), int(scores[i])) for i in _first(self.ids[some], scores, k))


def _meet(rows: DataFrame, anchors: DataFrame, blocks: int, tasks: int, quantisers: Callable, schema: str, each: Callable) -> DataFrame:
    """What ``each`` (block, anchors, lower and upper bounds) gives of every anchor with every block of rows of its width."""
    cols = ["width", "block", "side", "key", "id", "label", "v", "codes", "norms", "wanted"]
    left = rows.withColumns({"side": F.lit(0), "key": F.lit(None).cast("long"), "wanted": F.lit(None).cast("array<struct<id:bigint,score:bigint>>")}).select(cols)
    right = anchors.drop("block").withColumns({"side": F.lit(1), "codes": F.lit(None).cast("binary"), "norms": F.lit(None).cast("array<float>"), "block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))}).select(cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, block = None, [], None
        for batch in batches:
            place = np.stack([batch.column(i).to_numpy() for i in range(3)], 1)
            edges = [0, *(np.flatnonzero((place[1:] != place[:-1]).any(1)) + 1).tolist(), len(place)]
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                if i == j:
                    continue
                width, number, side = place[i].tolist()
                if (width, number) != at:
                    at, held, block = (width, number), [], None
                some = batch.slice(i, j - i)
                if side == 0:
                    held.append(some)
                    continue
                if not held:
                    continue
                block = block or Block(quantisers().get(width), held)
                for k in range(0, some.num_rows, TOGETHER):
                    these = some.slice(k, TOGETHER)
                    a = matrix(these.column(6))
                    yield from each(block, these, a, *block.bounds(a))

    return left.unionByName(right).repartition(tasks, "width", "block").sortWithinPartitions("width", "block", "side").mapInArrow(run, schema)


def mine_hard_negatives(
    table: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
    id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", scale: float = 256.0,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Rows that meet ``anchors`` (a condition on column ``id``) are anchors.  Components are
    ``floor(scale * x)``, a score is the whole inner product with the anchor, and higher scores come
    first, ties by smaller id.  An anchor's positives are its first rows of its label and of another
    id; for each, the first ``negatives`` rows of other labels are given whose scores are from ``low``
    to ``high`` per cent of the positive's.  No candidate is capped: what the bounds can't rule out
    is scored exactly.

    Rows with a null id or label, a null or empty vector, or a null or non-finite component (scaled
    or not) take no part; zero vectors do.  Rows of other widths than the anchor's aren't its
    candidates.  Rows that repeat or share an id count each; a score that a long can't hold makes no
    positive or negative.  Other columns are ignored, whatever their names; an empty table gives an
    empty result.  Centres are fitted on at most ``FIT_ROWS`` rows (by smallest hash of their ids) of
    the most frequent width; rows of other widths are scored exactly.
    """
    spark = table.sparkSession
    ship(spark)
    scratch = Scratch(spark, "hard-negatives")
    v = F.transform(F.col(f"`{vector_col}`").cast("array<double>"), lambda x: F.lit(float(scale)) * x)
    rows = table.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"), v.alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & fine)
    # a double's floor as a double: Spark's own is a long, which large ones overflow
    floor = lambda x: F.when(F.abs(x) < EXACT, F.floor(x).cast("double")).otherwise(x)
    rows = rows.withColumn("v", F.transform("v", floor))
    known = widths(rows, "v")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not known:
        return spark.createDataFrame([], schema)
    width, total = known[0][0], sum(n for _, n in known)
    sample = rows.where(F.size("v") == width).orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS).toArrow()
    shared = spark.sparkContext.broadcast({width: Quantiser(matrix(sample["v"]))})
    blocks = max(-(-total // BLOCK), min(2 * parts(spark), -(-total // BLOCK_LEAST)))
    tasks = max(parts(spark), min(blocks, 4 * parts(spark)))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, norms = [None] * b.num_rows, [None] * b.num_rows
            size = np.diff(b.column(2).offsets.to_numpy())
            at = np.flatnonzero(size == width)
            if len(at):
                c, n = shared.value[width].code(matrix(b.column(2).take(pa.array(at))))
                for i, own, norm in zip(at.tolist(), c, n, strict=True):
                    codes[i], norms[i] = own.tobytes(), norm
            out = [*b.columns, pa.array(codes, pa.binary()), pa.array(norms, pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays(out, ["id", "label", "v", "place", "codes", "norms"])

    placed = rows.withColumn("place", F.monotonically_increasing_id())
    index = placed.mapInArrow(code, "id long, label long, v array<double>, place long, codes binary, norms array<float>")
    index = scratch.write(index.select("id", "label", "v", "codes", "norms", F.size("v").alias("width"), F.pmod("place", F.lit(blocks)).cast("int").alias("block"), F.col("place").alias("key")), "index")
    asked = index.where(anchors).withColumn("wanted", F.lit(None).cast("array<struct<id:bigint,score:bigint>>"))
    centres = lambda: shared.value

    def found(rows_: list[tuple], names: list[str]) -> Iterator[pa.RecordBatch]:
        if rows_:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows_, strict=True)], names)

    def nearest(block: Block, these: pa.RecordBatch, a: np.ndarray, down: np.ndarray, up: np.ndarray) -> Iterator[pa.RecordBatch]:
        who = zip(these["key"].to_pylist(), these["id"].to_pylist(), these["label"].to_pylist(), strict=True)
        yield from found([(key, *p) for i, (key, own, label) in enumerate(who) for p in block.positives(own, label, a[i], down[i], up[i], positives)], ["key", "id", "score"])

    place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "id"))
    best = _meet(index, asked, blocks, tasks, centres, "key long, id long, score long", nearest).withColumn("r", place).where(F.col("r") <= positives)
    best = scratch.write(best.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("r", "id", "score"))).alias("found")), "positives")  # ``positives`` of each
    wanted = asked.drop("wanted").join(best, "key").withColumn("wanted", F.transform("found", lambda p: F.struct(p["id"].alias("id"), p["score"].alias("score")))).drop("found")

    def window(block: Block, these: pa.RecordBatch, a: np.ndarray, down: np.ndarray, up: np.ndarray) -> Iterator[pa.RecordBatch]:
        out = []
        for i, (key, own, label, wanted_) in enumerate(zip(these["key"].to_pylist(), these["id"].to_pylist(), these["label"].to_pylist(), these["wanted"].to_pylist(), strict=True)):
            for n, p in enumerate(wanted_):
                ends = -(-low * p["score"] // 100), high * p["score"] // 100
                if ends[0] <= ends[1]:
                    out += [(key, n, own, p["id"], p["score"], *q) for q in block.negatives(label, a[i], down[i], up[i], negatives, *ends)]
        yield from found(out, ["key", "n", "anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    hard = _meet(index, wanted, blocks, tasks, centres, "key long, n long, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long", window)
    rank = F.row_number().over(Window.partitionBy("key", "n").orderBy(F.desc("negative_score"), "negative_id"))
    return hard.withColumn("rank", rank).where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


SQL = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, a.label AS own, r.vec_id, r.label, CAST(list_dot_product(a.v, r.v) AS BIGINT) AS score
  FROM e a JOIN e r ON a.vec_id % 50 = 0 AND len(a.v) = len(r.v)
), p AS (
  SELECT anchor_id, own, vec_id AS positive_id, score AS positive_score FROM s WHERE own = label AND anchor_id <> vec_id
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> p.own AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER w <= 3
"""
