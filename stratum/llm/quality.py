"""Document quality by hierarchical empirical Bayes.

Evidence: two logistic heads (good quality, toxic) over text statistics and the presence of
selected words, fitted to labelled documents.  Priors: the expected share of good (toxic)
documents of each site, a host and a path of it, from all documents; a path's share is shrunk
toward its host's, a host's toward the global one, by as much as the spread between hosts
(paths) warrants.  A document's log-odds are its evidence plus what its site's prior adds to
the global one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import Scratch, ship, small
from .text import ID_BITS, ID_MASK, U, text_blocks, word_hashes, word_spans

#: Labelled rows to fit on at most (those with the smallest hashes of their ids), distinct words of each that the fit looks at
#: (those with the smallest hashes), words to a head, and how often and how clearly a word must tell.
TRAIN_ROWS, TRAIN_WORDS, HEAD_WORDS, LEAST_DOCS, LEAST_Z = 10_000, 4_096, 300, 5, 6.0
HEADS = ("quality", "toxic")
DENSE = 12
_CLASS = np.zeros(256, dtype=np.int64)
_CLASS[97:123], _CLASS[128:], _CLASS[65:91], _CLASS[48:58] = 1, 1, 2, 3
_CLASS[[33]], _CLASS[[35, 36, 37, 38, 42, 64, 94, 126]], _CLASS[[124, 60, 62, 91, 93, 123, 125, 95, 61, 92]] = 4, 5, 6
_MARK = np.zeros(256, dtype=np.int64)
_MARK[[b for b in range(33, 127) if not chr(b).isalnum()]] = 1


def text_features(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(statistics of each text, sorted (text << 54 | word id) of its distinct words)."""
    texts = len(offs) - 1
    starts, ends, words = word_spans(buf, offs)
    left, right = starts.copy(), ends.copy()
    for _ in range(3):  # a word's id leaves out up to three marks at each end
        left += _MARK[buf[left]] & (right - left > 1)
        right -= _MARK[buf[right - 1]] & (right - left > 1)
    keys = np.unique((np.repeat(np.arange(texts, dtype=U), words) << U(ID_BITS)) | (word_hashes(buf, left, right) >> U(64 - ID_BITS)))
    distinct = np.bincount((keys >> U(ID_BITS)).astype(np.int64), minlength=texts)
    size = np.maximum(np.diff(offs), 1)
    share = np.zeros((texts, 7))
    kind = _CLASS[buf] + 7 * np.repeat(np.arange(texts), np.diff(offs))
    share += np.bincount(kind, minlength=7 * texts).reshape(texts, 7) / size[:, None]
    breaks = buf == 10
    lines_at = np.unique(np.concatenate((offs[:-1], np.flatnonzero(breaks) + 1)))
    lines_at = lines_at[lines_at < len(buf)]
    line_end = np.append(lines_at[1:], len(buf))
    owner = np.searchsorted(offs, lines_at, "right") - 1
    prints = word_hashes(buf, lines_at, line_end, lower=False)
    lines = np.bincount(owner, minlength=texts)
    unique = np.unique((owner.astype(U) << U(ID_BITS)) | (prints >> U(64 - ID_BITS))) >> U(ID_BITS)
    repeats = 1 - np.bincount(unique.astype(np.int64), minlength=texts) / np.maximum(lines, 1)
    length = np.bincount(np.repeat(np.arange(texts), words), weights=ends - starts, minlength=texts) / np.maximum(words, 1)
    some = np.maximum(words, 1)
    return np.column_stack([share[:, 1:], np.log1p(words), length / 10, distinct / some, np.log1p(words / np.maximum(lines, 1)), repeats, words < 5]), keys


@dataclass
class Heads:
    """Means, scales and weights of the statistics; sorted ids and weights of the words; intercepts."""

    mean: np.ndarray
    scale: np.ndarray
    dense: np.ndarray
    words: np.ndarray
    sparse: np.ndarray
    bias: np.ndarray

    def log_odds(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        stats, keys = text_features(buf, offs)
        out = ((stats - self.mean) / self.scale) @ self.dense + self.bias
        if len(self.words):
            ids = keys & ID_MASK
            at = np.searchsorted(self.words, ids)
            at[at == len(self.words)] = 0
            hit = self.words[at] == ids
            text, at = (keys[hit] >> U(ID_BITS)).astype(np.int64), at[hit]
            for h in range(len(HEADS)):
                out[:, h] += np.bincount(text, self.sparse[at, h], len(out))
        return np.clip(out, -30, 30)


def _logistic(x: np.ndarray, y: np.ndarray, penalty: np.ndarray, steps: int = 12) -> np.ndarray:
    """Weights of penalised logistic regression by damped Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = np.maximum(p * (1 - p), 1e-4)
        step = np.linalg.solve((x * curve[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step * min(1.0, 5.0 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-4:
            break
    return w


def fit_heads(stats: np.ndarray, docs: list[np.ndarray], labels: np.ndarray) -> Heads:
    """Fit both heads; ``docs``: word ids of each row, ``labels``: a 0/1 column for each head, NaN for unknown."""
    n = len(stats)
    ids, owner = (np.concatenate(docs) if n else np.zeros(0, U)), np.repeat(np.arange(n), [len(d) for d in docs])
    mean, scale = (stats.mean(0), np.maximum(stats.std(0), 1e-6)) if n else (np.zeros(DENSE), np.ones(DENSE))
    vocabulary, col, df = np.unique(ids, return_inverse=True, return_counts=True)
    chosen: set[int] = set()
    for h in range(len(HEADS)):
        y = labels[:, h] if n else np.zeros(0)
        pos = np.bincount(col, weights=(y == 1)[owner], minlength=len(vocabulary))
        a, b = float((y == 1).sum()), float((y == 0).sum())
        if not a or not b:
            continue
        p, q = (pos + 0.5) / (a + 1), (df - pos + 0.5) / (b + 1)
        z = np.abs(np.log(p / q)) * np.sqrt(np.minimum(df, n - df + 1))
        z[(df < LEAST_DOCS) | (z < LEAST_Z)] = 0
        best = np.argsort(-z, kind="stable")[:HEAD_WORDS]
        chosen |= set(best[z[best] > 0].tolist())
    picked = np.array(sorted(chosen), dtype=np.int64)
    place = np.full(len(vocabulary), -1)
    place[picked] = np.arange(len(picked))
    use = place[col] >= 0 if n else np.zeros(0, bool)
    x = np.zeros((n, 1 + DENSE + len(picked)))
    x[:, 0] = 1
    x[:, 1 : 1 + DENSE] = (stats - mean) / scale if n else 0
    x[owner[use], 1 + DENSE + place[col[use]]] = 1
    penalty = np.concatenate(([1e-3], np.full(DENSE, 1.0), np.full(len(picked), 1.0)))
    weights = np.zeros((x.shape[1], len(HEADS)))
    for h in range(len(HEADS)):
        y = labels[:, h] if n else np.zeros(0)
        known = ~np.isnan(y)
        if known.any() and len(set(y[known].tolist())) == 2:
            weights[:, h] = _logistic(x if known.all() else x[known], y[known], penalty)
        elif h == 0:
            weights[0, h] = 3.0  # nothing to learn from: everything is good
        else:
            weights[0, h] = -3.0  # and nothing toxic
    return Heads(mean, scale, weights[1 : 1 + DENSE], vocabulary[picked].astype(U), weights[1 + DENSE :], weights[0])


def train_heads(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS, words: int = TRAIN_WORDS) -> Heads:
    """Fit on at most ``rows`` labelled documents; rows without an id or a label say nothing.

    Where labels of an id differ, the worse one holds: good only if all say good, toxic if one does.
    Where documents share an id, one of them is taken, by the order of their figures.  The driver
    gets ``rows`` rows of ``words`` numbers at most, however many copies and words there are.
    """
    sample = labels.select(F.col(f"`{id_col}`").cast("long").alias("id"), *(F.col(f"`{h}`").cast("double").alias(h) for h in HEADS)).where("id is not null")
    sample = sample.groupBy("id").agg(F.min(HEADS[0]).alias(HEADS[0]), F.max(HEADS[1]).alias(HEADS[1])).orderBy(F.xxhash64("id"), "id").limit(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, buf, offs in text_blocks(batch.column(1)):
                n = len(offs) - 1
                stats, keys = text_features(buf, offs)
                cut = np.searchsorted((keys >> U(ID_BITS)).astype(np.int64), np.arange(n + 1))
                ids = (keys & ID_MASK).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), pa.array(list(stats), pa.list_(pa.float64())), pa.array([ids[i : min(j, i + words)] for i, j in zip(cut[:-1], cut[1:], strict=True)], pa.list_(pa.int64()))], ["id", "stats", "words"])

    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    figures = own.join(F.broadcast(sample.select("id")), "id", "left_semi").mapInArrow(run, "id long, stats array<double>, words array<long>")
    figures = figures.groupBy("id").agg(F.min(F.struct("stats", "words")).alias("f")).select("id", "f.stats", "f.words")
    got = figures.join(F.broadcast(sample), "id").toArrow().sort_by("id")
    stats = np.array(got["stats"].to_pylist(), dtype=float).reshape(-1, DENSE)
    flat, cut = got["words"].combine_chunks(), got["words"].combine_chunks().offsets.to_numpy()
    flat = flat.values.to_numpy(zero_copy_only=False).astype(U)
    return fit_heads(stats, [flat[i:j] for i, j in zip(cut[:-1], cut[1:], strict=True)], np.column_stack([got[h].to_numpy() for h in HEADS]).astype(float))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and first path part of a URL column, for tables that have one: ``judge(..., host=h, path=p)``."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z]+://([^/?#]*)", 1)), F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]*/([^/?#]*)", 1)


def scored(docs: DataFrame, text: Column, heads: Heads, row: Column, host: Column, path: Column) -> DataFrame:
    """(row, host, path, lq, lt): the log-odds of both heads beside what ``row`` holds."""
    shared = docs.sparkSession.sparkContext.broadcast(heads)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            odds = [shared.value.log_odds(buf, offs) for _, buf, offs in text_blocks(batch.column(3))]
            odds = np.concatenate(odds) if odds else np.zeros((0, 2))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(odds[:, 0]), pa.array(odds[:, 1])], ["row", "host", "path", "lq", "lt"])

    rows = docs.select(row.alias("row"), host.alias("host"), path.alias("path"), text.alias("text"))
    schema = StructType([*rows.schema.fields[:3], StructField("lq", DoubleType()), StructField("lt", DoubleType())])
    return rows.mapInArrow(run, schema)


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def site_priors(evidence: DataFrame) -> tuple[DataFrame, dict[str, float]]:
    """(host, path, add_q, add_t): what a site's prior adds to the log-odds; and the global figures.

    ``evidence``: columns host, path, lq, lt.  Sums are combined before the shuffle, so a host
    with most of the rows costs no more than another.  Strengths come by moments from the spread
    of the shares of hosts (of paths within hosts) beyond what chance would give.
    """
    sites = evidence.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(_sigmoid(F.col("lq"))).alias("q"), F.sum(_sigmoid(F.col("lt"))).alias("t"))
    hosts = sites.groupBy("host").agg(*(F.sum(c).alias(f"h_{c}") for c in "nqt"), F.count("*").alias("paths"))
    total = hosts.agg(*(F.sum(f"h_{c}").alias(c) for c in "nqt"), F.count("*").alias("hosts")).first()
    n = float(total["n"] or 0)
    known = {"n": n} | {c: min(max((total[c] or 0.0) / n, 1e-4), 1 - 1e-4) if n else 0.5 for c in "qt"}

    def strength(share: Column, size: Column, mean: Column) -> Column:
        # weights by size: the between-group variance is what exceeds mean * (1 - mean) / size
        spread = F.sum(size * (share - mean) * (share - mean)) - F.sum(mean * (1 - mean))
        between = F.greatest(spread / F.sum(size), F.lit(1e-6))
        return F.least(F.greatest(F.avg(mean * (1 - mean)) / between - 1, F.lit(1.0)), F.lit(1e6))

    got = hosts.agg(*(strength(F.col(f"h_{c}") / F.col("h_n"), F.col("h_n"), F.lit(known[c])).alias(c) for c in "qt")).first()
    for c in "qt":
        known[f"host_{c}"] = got[c] or 1.0
        hosts = hosts.withColumn(f"p_{c}", (F.col(f"h_{c}") + known[f"host_{c}"] * known[c]) / (F.col("h_n") + known[f"host_{c}"]))
    both = sites.withColumnRenamed("host", "site").join(hosts, F.col("site").eqNullSafe(F.col("host"))).drop("site")
    got = both.agg(*(strength(F.col(c) / F.col("n"), F.col("n"), F.col(f"p_{c}")).alias(c) for c in "qt")).first()
    for c in "qt":
        known[f"path_{c}"] = got[c] or 1.0
        share = (F.col(c) + known[f"path_{c}"] * F.col(f"p_{c}")) / (F.col("n") + known[f"path_{c}"])
        share = F.least(F.greatest(share, F.lit(1e-4)), F.lit(1 - 1e-4))
        both = both.withColumn(f"add_{c}", F.log(share / (1 - share)) - float(np.log(known[c] / (1 - known[c]))))
    return both.select("host", "path", "add_q", "add_t"), known


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host: str | Column = "source", path: str | Column = "lang", columns: list[str] | None = None, rows: int = TRAIN_ROWS) -> DataFrame:
    """(row, p_quality, p_toxic, kept) of every row of ``docs``; ``row`` is a struct of its ``columns`` (all).

    A row is kept when its posterior odds say good quality and not toxic (each at even odds).  Every
    text is scored once: the scores are written with ``row``, and the priors of the sites, which
    need all scores, are joined to what was written.

    A null or empty text is judged by its statistics and site alone; very long texts are judged
    whole; null hosts and paths are sites of their own; rows that repeat are judged alike; without
    labels everything is kept; an empty table gives an empty result.  The row's own columns sit in
    a struct, so no name can clash.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "quality")
    heads = train_heads(docs, labels, id_col, text_col, rows)
    place = [F.col(f"`{c}`") if isinstance(c, str) else c for c in (host, path)]
    kept = F.struct(*(F.col(f"`{c}`") for c in (docs.columns if columns is None else columns)))
    evidence = scratch.write(scored(docs, F.col(f"`{text_col}`"), heads, kept, *place), "evidence")
    priors, _ = site_priors(evidence.select("host", "path", "lq", "lt"))
    priors = scratch.write(priors.withColumnsRenamed({"host": "h", "path": "p"}), "priors")
    out = evidence.join(small(priors, priors.count()), F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p")), "left")
    odds = {c: F.col(f"l{c}") + F.coalesce(F.col(f"add_{c}"), F.lit(0.0)) for c in "qt"}
    return out.select("row", _sigmoid(odds["q"]).alias("p_quality"), _sigmoid(odds["t"]).alias("p_toxic"), ((odds["q"] >= 0) & (odds["t"] < 0)).alias("kept"))
