"""The corpus pipeline: quality, near duplicates, personal data, mixture, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns the
columns of ``documents``, but for the last, which returns the places of the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stratum.llm import mixing, pii, quality
from stratum.llm.common import Scratch, small, table
from stratum.llm.jaccard_join import ngram_jaccard_components
from stratum.llm.packing import pack_documents


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the classifier takes for good and not toxic.

    Null and empty texts are judged by their statistics and site; very long texts whole; rows that
    repeat alike, so all of them stay or go; an empty table gives an empty one.  Columns of any
    name pass through as they are.
    """
    return quality.judge(docs, table(spark, sf_dir, "labels")).where("kept").select("row.*")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near duplicates.

    Rows without an id stay, as do empty texts, which are near nothing.  Rows that share an id are
    one document of several texts: they stay or go together, but of those with equal text one stays.
    Very long texts are compared whole.  Other columns, of any name, pass through; an empty table
    gives an empty one.
    """
    scratch = Scratch(spark, "near-duplicates")
    found = scratch.write(ngram_jaccard_components(docs, n=5, threshold=80), "found")
    gone = scratch.write(found.where("component_id <> doc_id").select("doc_id").distinct(), "gone")
    kept = docs.join(small(gone, gone.count()), "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
    twice = scratch.write(found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "twice")
    if n := twice.count():
        again = kept.join(small(twice, n), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).select(*(F.col(f"`{c}`") for c in docs.columns))
        kept = kept.join(small(twice, n), "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns)).union(again)
    return kept


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in every text, whole; every document stays.

    Null texts stay null, empty ones empty; rows that repeat are treated alike.  ``n_chars``, where
    there is such a column, counts the new text; other columns pass through; an empty table gives
    an empty one.
    """
    return pii.redact(docs, length_col="n_chars" if "n_chars" in docs.columns else None)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each document as often as its source's rate says, 0 to 3 times.

    A null source is a source of its own; null and empty texts have size 0 and are taken at their
    source's rate like others; rows that share an id share the draw.  Columns of any name pass
    through; an empty table gives an empty one.
    """
    return mixing.mixed_rows(docs, weights=(5, 2, 1), cap=3.0)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents' pieces in sequences of 2048 tokens.

    A null or empty text is its end id alone; a text longer than a sequence is cut into pieces;
    rows that repeat are packed each; an empty table gives an empty result.
    """
    return pack_documents(docs, cap=2048)


STAGES = [("quality classifier", quality_stage), ("n-gram Jaccard join", near_duplicate_stage), ("personal data", personal_data_stage), ("mixing", mixing_stage), ("best-fit packing", packing_stage)]

#: SQL can't express the classifier, the tokenizer and the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again; a stage's own tables go when it is written."""
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before = Scratch.live()
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.write(docs, f"stage-{k}")
            Scratch.drop_all(spark, keep=before)
            if k:
                scratch.drop(f"stage-{k - 1}")
    return docs
