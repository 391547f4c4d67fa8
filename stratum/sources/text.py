"""Corpus shards, conversation lines, result files, settings and whole-text objects."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from stratum.operators.corpus import is_valid
from stratum.schemas import CONVERSATION


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of all parquet shards with ``file`` and ``split``: the last file in name order is val."""
    rows = spark.read.option("pathGlobFilter", "*.parquet").parquet(folder).withColumn("file", F.col("_metadata.file_name"))
    last = rows.agg(F.max("file").alias("last"))
    return rows.crossJoin(F.broadcast(last)).withColumn("split", F.when(F.col("file") == F.col("last"), "val").otherwise("train")).drop("last")


def write_shards(docs: DataFrame, folder: str, shard: str = "shard") -> None:
    """One zstd parquet folder for each shard; rows of the unfinished last shard (-1) are left out."""
    docs.where(F.col(shard) >= 0).repartition(shard).write.mode("overwrite").option("compression", "zstd").partitionBy(shard).parquet(folder)


def read_conversations(spark: SparkSession, path: str) -> DataFrame:
    """(line, messages) of a file with one JSON array of messages a line; a malformed one is an error when read."""
    rows = spark.read.text(path).where(F.trim("value") != "")
    messages = F.from_json("value", CONVERSATION.removeprefix("messages "))
    return rows.select(messages.alias("messages")).withColumn("messages", F.when(F.col("messages").isNotNull() & is_valid(F.col("messages")), F.col("messages")).otherwise(F.raise_error(F.lit("bad conversation")).cast("array<struct<role:string,content:string>>")))


def write_conversations(rows: DataFrame, path: str, messages: str = "messages") -> None:
    rows.select(F.to_json(messages).alias("value")).write.mode("overwrite").text(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """(label, accuracy, centered) of a padded result file; numbers that aren't are null."""
    rows = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path).toDF("label", "accuracy", "centered")
    return rows.select("label", F.col("accuracy").try_cast("double").alias("accuracy"), F.col("centered").try_cast("double").alias("centered"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value) of one text file."""
    return spark.read.option("wholetext", True).text(path).select(F.posexplode(F.split("value", "\r?\n")).alias("line_no", "value"))


def read_object(spark: SparkSession, path: str) -> str | None:
    """The text at a path, or None."""
    if not exists(spark, path):
        return None
    row = spark.read.option("wholetext", True).text(path).first()
    return row[0] if row else ""


def put_object(spark: SparkSession, path: str, text: str) -> None:
    """Write a whole text to a path, in place of what was there."""
    at, files = _at(spark, path)
    out = files.create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def delete_object(spark: SparkSession, path: str) -> bool:
    """Whether there was something at the path, which is gone now."""
    at, files = _at(spark, path)
    return bool(files.delete(at, False))


def folders(spark: SparkSession, path: str, holding: str = "") -> list[str]:
    """Names of the folders right below a path in which there is ``holding``, sorted; none where there is no such path."""
    at, files = _at(spark, path)
    if not files.exists(at):
        return []
    names = sorted(f.getPath().getName() for f in files.listStatus(at) if f.isDirectory())
    return [n for n in names if not holding or exists(spark, f"{path}/{n}/{holding}")]


def exists(spark: SparkSession, path: str) -> bool:
    at, files = _at(spark, path)
    return bool(files.exists(at))


def put_in_place(spark: SparkSession, fresh: str, path: str) -> None:
    """Move a folder to a path, in place of what was there."""
    at, files = _at(spark, path)
    files.delete(at, True)
    if not files.rename(_at(spark, fresh)[0], at):
        raise OSError(f"{fresh} couldn't be moved to {path}")


def _at(spark: SparkSession, path: str) -> tuple:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def settings(path: str, override: bool = False) -> dict[str, str]:
    """KEY=VALUE lines put into the environment; '#' comments, matching quotes taken off."""
    out = {}
    for line in Path(path).read_text(encoding="utf-8").splitlines():
        key, eq, value = line.strip().partition("=")
        if not eq or key.startswith("#"):
            continue
        value = value.strip()
        if len(value) > 1 and value[0] == value[-1] and value[0] in "'\"":
            value = value[1:-1]
        out[key.strip()] = value
        if override or key.strip() not in os.environ:
            os.environ[key.strip()] = value
    return out


def checkpoints(spark: SparkSession, folder: str) -> DataFrame:
    """(tag, step) of files named model_<step>.pt in folders named by tag."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "model_*.pt").load(folder).select("path")
    return rows.select(F.regexp_extract("path", r"([^/]+)/model_\d+\.pt$", 1).alias("tag"), F.regexp_extract("path", r"model_(\d+)\.pt$", 1).cast("int").alias("step"))


def first_checkpoints(rows: DataFrame, most: int = 20) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("tag").orderBy("step"))
    return rows.withColumn("place", place).where(F.col("place") <= most)
