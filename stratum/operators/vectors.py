"""A keyed vector table: last write wins, filtered exact search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

KEY = ("repo_slug", "head_commit", "file_path", "start_line", "end_line")


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str] = KEY, order: str = "seq") -> DataFrame:
    """Old and new rows, the one with the highest ``order`` for each key; new rows win over old ones."""
    both = old.withColumn("__age", F.lit(0)).unionByName(new.withColumn("__age", F.lit(1)))
    latest = Window.partitionBy(*key).orderBy(F.desc("__age"), F.desc(order))
    return both.withColumn("__rank", F.row_number().over(latest)).where("__rank = 1").drop("__age", "__rank")


def delete_by(rows: DataFrame, column: str, value: str) -> tuple[DataFrame, int]:
    """(rows without those whose ``column`` is ``value``, how many went); an empty value deletes nothing."""
    if not value:
        return rows, 0
    return rows.where(~F.col(column).eqNullSafe(F.lit(value))), rows.where(F.col(column) == value).count()


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 where one has no length, an error where widths differ."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    value = F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors differ in width")).cast("double")).otherwise(value)


def vector_literal(v: Column) -> Column:
    """``[a,b,...]`` with 12 significant digits; a non-finite part is an error."""
    bad = F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    # the format pads with zeros, which go again
    parts = F.transform(v, lambda x: F.regexp_replace(F.regexp_replace(F.format_string("%.12g", x.cast("double")), r"(\.\d*?)0+(e|$)", "$1$2"), r"\.(e|$)", "$1"))
    return F.when(bad, F.raise_error(F.lit("vector has a part that is not finite")).cast("string")).otherwise(F.concat(F.lit("["), F.array_join(parts, ","), F.lit("]")))


def search(rows: DataFrame, query: Sequence[float], k: int, filters: dict[str, str | None] | None = None, vector: str = "vector", order: str = "seq") -> DataFrame:
    """The ``k`` rows most similar to ``query`` among those that meet all filters that are set."""
    if not query:
        raise ValueError("empty query vector")
    for column, value in (filters or {}).items():
        if value is not None:
            rows = rows.where(F.col(column) == value)
    if k <= 0:
        return rows.limit(0).withColumn("score", F.lit(0.0))
    probe = F.array(*(F.lit(float(x)) for x in query))
    return rows.withColumn("score", cosine(F.col(vector), probe)).orderBy(F.desc("score"), order).limit(k)


class VectorStore:
    """The same over a table held as a DataFrame: upsert, delete_by_repo, search."""

    def __init__(self, rows: DataFrame, width: int) -> None:
        if width <= 0:
            raise ValueError("width must be positive")
        self.rows, self.width = rows, width

    def upsert(self, new: DataFrame) -> int:
        wrong = new.where(F.size("vector") != self.width).limit(1).count()
        if wrong:
            raise ValueError(f"vectors must have {self.width} parts")
        self.rows = upsert(self.rows, new)
        return new.count()

    def delete_by_repo(self, repo_slug: str) -> int:
        self.rows, gone = delete_by(self.rows, "repo_slug", repo_slug)
        return gone

    def search(self, query: Sequence[float], k: int, **filters: str | None) -> DataFrame:
        if len(query) != self.width:
            raise ValueError(f"query must have {self.width} parts")
        return search(self.rows, query, k, filters)
