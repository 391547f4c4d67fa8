"""Divergence of sources: baselines from zero counts, corrected along an inverted index of terms.

Every group (language, source) gives each kept term a smoothed share ``p`` in parts of a thousand
million, and two groups differ by ``f = floor((p - q)^2 / (p + q))`` summed over all kept terms.  Most
terms of most groups have count 0, so a pair starts at V times ``f`` of the two shares of count 0.
Postings (term, group, count) then emit corrections: what a group's counts change against the other's
zero share, added up once for each distinct count, and what a term that both groups have changes on
top.  A term that neither has emits nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import Scratch, parts, ship, small
from .text import text_blocks

BLOCK_BYTES = 16 << 20
#: A term's documents at least, terms reported of a group.
LEAST_DOCS, TOP = 10, 10
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of a term: ASCII letters and all of characters beyond ASCII.
_INSIDE = np.zeros(256, dtype=bool)
_INSIDE[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _counted(group: np.ndarray, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """(group, term, occurrences, documents) of a block of texts, one row for each group and term."""
    inside = np.zeros(len(buf) + 2, dtype=bool)
    inside[1:-1] = _INSIDE[buf]
    begins, ends = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    edges = offs[1:-1]
    edges = edges[(edges > 0) & (edges < len(buf))]
    begins[edges] = inside[edges + 1]  # terms never cross texts
    ends[edges - 1] |= inside[edges]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    doc = np.searchsorted(offs, starts, "right") - 1
    # the terms' bytes laid end to end, so that Arrow can tell the distinct ones
    kept = _LOWER[buf[inside[1:-1]]]
    sizes = stops - starts
    bounds = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    terms = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(bounds), pa.py_buffer(kept)]).dictionary_encode()
    code, n = terms.indices.to_numpy().astype(np.int64), max(1, len(terms.dictionary))
    pairs, times = np.unique(doc * n + code, return_counts=True)
    own, at = np.unique(group[pairs // n] * n + pairs % n, return_inverse=True)
    return own // n, terms.dictionary.take(pa.array(own % n)).cast(pa.string()), np.bincount(at, times, len(own)).astype(np.int64), np.bincount(at, minlength=len(own)).astype(np.int64)


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of every term of every group, and a row with an empty term for each group.

    Nulls are empty texts and names.  Texts are counted whole, in blocks; a block's sums are added up before the shuffle.
    """
    ship(docs.sparkSession)
    read = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias
    rows = docs.select(read(lang_col)("lang"), read(source_col)("source"), read(text_col)("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["lang", "source", "term", "n", "docs"]
        for batch in batches:
            if not batch.num_rows:
                continue
            both = pa.Table.from_batches([batch]).select([0, 1]).append_column("at", pa.array(np.arange(batch.num_rows)))
            groups = both.group_by(["lang", "source"]).aggregate([("at", "list")]).sort_by([("lang", "ascending"), ("source", "ascending")])
            lists = groups["at_list"].combine_chunks()
            group = np.empty(batch.num_rows, np.int64)
            group[lists.flatten().to_numpy()] = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            lang, source = groups["lang"].combine_chunks(), groups["source"].combine_chunks()
            zeros = np.zeros(len(lists), np.int64)
            yield pa.RecordBatch.from_arrays([lang, source, pa.array([""] * len(lists), pa.string()), pa.array(zeros), pa.array(zeros)], names)
            for at, buf, offs in text_blocks(batch.column(2), BLOCK_BYTES, 1 << 30):
                if len(buf):
                    own, term, n, docs_ = _counted(group[at : at + len(offs) - 1], buf, offs)
                    who = pa.array(own)
                    yield pa.RecordBatch.from_arrays([lang.take(who), source.take(who), term, pa.array(n), pa.array(docs_)], names)

    found = rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column) -> Column:
    """1 + floor(10^9 * count / total), exact: digits in two steps, so that totals up to 9 * 10^13 fit."""
    high = F.call_function("div", count * 100_000, total)
    rest = count * 100_000 - high * total
    return 1 + high * 10_000 + F.call_function("div", rest * 10_000, total)


def gap(p: Column, q: Column) -> Column:
    """f of two shares."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): each group's distance from every other source of its language (part ``pair``, all ranks), and the terms that set it apart from its language (part ``term``, ``top`` of them).

    Null texts and names count as empty ones, and '' is a language or source like others.  A group
    without terms has count 0 of every kept term; a language without kept terms has distances 0.
    Very long texts are counted whole; rows that repeat are documents each; ties go by the item's
    UTF-8 bytes.  Other columns are ignored, whatever their names; an empty table gives an empty
    result.  Every term and posting counts: nothing is capped or sampled.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "divergence")
    counts = scratch.write(term_counts(docs, text_col, lang_col, source_col), "counts")
    kept = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).drop("docs")
    postings = scratch.write(counts.where("term <> ''").drop("docs").join(kept, ["lang", "term"]), "postings")
    sizes = postings.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    # a language's sums from its distinct terms; each term has a posting of its own least source
    langs = postings.groupBy("lang", "term").agg(F.max("all_n").alias("all_n")).groupBy("lang").agg(F.count("*").alias("terms"), F.sum("all_n").alias("lang_total"))
    groups = counts.where("term = ''").select("lang", "source").join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
    nil = F.lit(0).cast("long")
    groups = groups.select("lang", "source", F.coalesce("terms", nil).alias("terms"), F.coalesce("total", nil).alias("total"), F.coalesce("lang_total", nil).alias("lang_total"))
    base = F.col("total") + 2 * F.col("terms")
    groups = groups.withColumn("zero", F.when(F.col("terms") > 0, share(F.lit(2).cast("long"), base)).otherwise(nil))
    groups = scratch.write(groups.withColumn("g", F.row_number().over(Window.partitionBy("lang").orderBy("source"))), "groups")
    known = groups.count()
    side = small(groups, known)

    shares = postings.join(side.select("lang", "source", "g", "terms", "total", "lang_total", "zero"), ["lang", "source"])
    shares = shares.select("lang", "source", "term", "g", "zero", "n", share(F.col("n") + 2, base).alias("p"), share(F.col("all_n") + 2, F.col("lang_total") + 2 * F.col("terms")).alias("q"))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)

    # (lang, a, b, d) corrections; first what a's own counts change against b's zero share, once for each distinct count
    own = shares.groupBy("lang", "g", "zero", "p").agg(F.count("*").alias("many"))
    other = side.select("lang", F.col("g").alias("b"), F.col("zero").alias("zero_b"))
    one = own.join(other, "lang").where("g <> b").select("lang", F.least("g", "b").alias("a"), F.greatest("g", "b").alias("b"), (F.col("many") * (gap(F.col("p"), F.col("zero_b")) - gap(F.col("zero"), F.col("zero_b")))).alias("d"))
    # then what a term that both have changes on top
    left = shares.select("lang", "term", F.col("g").alias("a"), F.col("p").alias("pa"), F.col("zero").alias("za"))
    right = shares.select("lang", "term", F.col("g").alias("b"), F.col("p").alias("pb"), F.col("zero").alias("zb"))
    pa_, pb, za, zb = (F.col(c) for c in ("pa", "pb", "za", "zb"))
    both = left.join(right, ["lang", "term"]).where("a < b").select("lang", "a", "b", (gap(pa_, pb) - gap(pa_, zb) - gap(za, pb) + gap(za, zb)).alias("d"))
    corrections = one.where("d <> 0").unionByName(both.where("d <> 0")).groupBy("lang", "a", "b").agg(F.sum("d").alias("d"))

    # every pair of a language's sources, dealt out by the first one's number
    pieces = max(1, min(parts(spark), known))
    first = groups.select("lang", "source", "g", "terms", "zero").withColumn("piece", F.pmod("g", F.lit(pieces)))
    second = groups.select("lang", F.col("source").alias("item"), F.col("g").alias("h"), F.col("zero").alias("zero_h")).withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))))
    pairs = first.join(second, ["lang", "piece"]).where("g <> h").select("lang", "source", "item", F.least("g", "h").alias("a"), F.greatest("g", "h").alias("b"), F.when(F.col("terms") > 0, F.col("terms") * gap(F.col("zero"), F.col("zero_h"))).otherwise(nil).alias("start"))
    pairs = pairs.join(corrections, ["lang", "a", "b"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", (F.col("start") + F.coalesce("d", nil)).alias("value"))
    return pairs.withColumn("rank", F.row_number().over(ranked)).unionByName(terms)


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT k, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS raw FROM d
), t AS (
  SELECT k, lang, source, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM w
), kept AS (
  SELECT lang, term, count(*) AS all_n FROM t GROUP BY lang, term HAVING count(DISTINCT k) >= 10
), v AS (
  SELECT lang, count(*) AS v, sum(all_n) AS lang_total FROM kept GROUP BY lang
), g AS (
  SELECT DISTINCT lang, source FROM d
), c AS (
  SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term
), totals AS (
  SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source
), p AS (
  SELECT g.lang, g.source, kept.term, coalesce(n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(n, 0) + 2)) // (coalesce(total, 0) + 2 * v) AS p,
         1 + (1000000000::HUGEINT * (all_n + 2)) // (lang_total + 2 * v) AS q
  FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN totals USING (lang, source) LEFT JOIN c USING (lang, source, term)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), all_parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) FROM p WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM all_parts
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
