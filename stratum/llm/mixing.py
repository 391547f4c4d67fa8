"""Mixing sources to target weights: rates from token counts, whole copies plus one seeded Bernoulli copy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import Scratch, small

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(key: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on key and seed alone; all null keys draw alike."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(key.cast("string"), F.lit("null")))), 1, 13), 16, 10).cast("double") / float(1 << 52)


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """(source, source_size, target) from rows of (source, size).

    Sources in code point order, null last, get the weights in turn.  They share the total of all
    sizes by weight; a target stops at ``cap`` times its source's size and the excess is shared
    again by weight.  That is ``min(cap * size, level * weight)`` for the one level at which the
    targets add up to the total, found by running sums over the sources (one row each).
    """
    per = sizes.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("source_size"))
    turn = F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights)))
    per = per.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (turn + 1).cast("int")))
    per = per.withColumn("most", F.col("source_size") * float(cap))
    order = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    per = per.withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    per = per.withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct(F.col("most") / F.col("weight"), F.col("level").alias("level")))).over(everything)["level"])
    return per.select("source", "source_size", F.coalesce(F.least("most", F.col("level") * F.col("weight")), "most").alias("target"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (5, 2, 1), cap: float = 3.0, seed: str = "mix") -> DataFrame:
    """Every row of ``docs`` as a struct ``row`` with size, source_size, target, copies and taken.

    ``copies`` is the whole part of rate = target / source_size, plus one when the row's seeded
    draw falls below the fraction, so a row is never taken more than ``ceil(cap)`` times and
    reruns agree.  A null text has size 0, a very long one is counted whole; a null source is a
    source of its own; rows that share an id share the draw; an empty table gives an empty result.
    The row's own columns sit in the struct, so no name can clash.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    base = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{source_col}`").alias("source"), F.col(f"`{id_col}`").alias("key"), word_count(F.col(f"`{text_col}`")).alias("size"))
    targets = scratch.write(source_targets(base.select("source", "size"), weights, cap), "targets")
    side = small(targets.withColumnRenamed("source", "name"), targets.count())
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    copies = (F.floor(rate) + F.when(draw(F.col("key"), seed) < rate - F.floor(rate), 1).otherwise(0)).cast("long")
    out = base.join(side, base["source"].eqNullSafe(side["name"]), "left")
    out = out.withColumn("copies", F.least(copies, F.lit(int(-(-cap // 1)))))
    return out.select("row", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_rows(docs: DataFrame, **options) -> DataFrame:  # noqa: ANN003
    """The mix itself: each row as often as it is taken, with the columns of ``docs``."""
    mixed = mix_sources(docs, **options).where("copies > 0")
    return mixed.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


#: The same in SQL, over ``documents``.
SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(SUM(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3] AS weight, source_size * 3.0::DOUBLE AS most FROM s),
l AS (SELECT *, (CAST(SUM(source_size) OVER () AS DOUBLE) - COALESCE(SUM(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
       / SUM(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, LEAST(most, weight * (SELECT arg_min(level, most / weight) FROM l WHERE level * weight <= most)) AS target FROM l),
r AS (SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
       CAST(CAST('0x' || substr(md5('mix|' || COALESCE(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0::DOUBLE AS u
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, size * CAST(floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS taken FROM r
"""
