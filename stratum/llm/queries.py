"""The registered queries of the corpus operators, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import ann, bpe, cover_tree, divergence, hard_negatives, jaccard_join, mixing, pii, quality, warc
from .common import Scratch, table
from .jaccard_join import ngram_jaccard_components
from .packing import pack_documents
from .sharding import bounded_load_shards
from .token_files import token_file_round_trip


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), cap=2048)


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_components(table(spark, sf_dir, "documents"), n=5, threshold=80)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    index = scratch.write(warc.write_warc(table(spark, sf_dir, "pages"), scratch.path("bundles")), "index")
    return warc.read_warc(index)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), columns=["doc_id"])
    return judged.select("row.doc_id", "p_quality", "p_toxic", "kept")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"), weights=(5, 2, 1), cap=3.0)
    return mixed.select("row.doc_id", "size", "source_size", "target", "taken")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = bounded_load_shards(table(spark, sf_dir, "documents"), shards=16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.95)


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file_round_trip(table(spark, sf_dir, "documents"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op11_byte_pair_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bpe.round_trip(table(spark, sf_dir, "documents"), columns=["doc_id"])
    digest = F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256)
    return done.select("row.doc_id", F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine_hard_negatives(rows.withColumn("label", label), F.col("id") % 50 == 0)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_best_fit_packing, op2_ngram_jaccard_join, op3_warc, op4_quality, op5_mixing, op6_sharding, op7_nearest_neighbours, op8_embedding_near_dedup, op9_token_output, op10_personal_data, op11_byte_pair_encoding, op12_hard_negatives, op13_source_divergence)}


def oracle_sql() -> dict[str, str]:
    return {"op2_ngram_jaccard_join": jaccard_join.SQL, "op3_warc": warc.SQL, "op5_mixing": mixing.SQL, "op8_embedding_near_dedup": cover_tree.SQL, "op12_hard_negatives": hard_negatives.SQL, "op13_source_divergence": divergence.SQL}
