"""Task rows to conversations, evaluation bundles, request checks, key-value tables and the tool table."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stratum.operators import corpus, serving, sync

LETTERS = ("A", "B", "C", "D", "E")


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def choice_conversations(rows: DataFrame, question: str, choices: str, answer: str) -> DataFrame:
    """Rows with ``messages`` of a multiple choice question; ``answer`` is a place from 0 or a letter."""
    letters = F.slice(F.array(*map(F.lit, LETTERS)), 1, F.size(choices))
    letter = F.when(F.col(answer).cast("string").rlike("^[0-9]+$"), F.element_at(letters, (F.col(answer).try_cast("int") + 1))).otherwise(F.col(answer).cast("string"))
    return rows.withColumn("messages", F.array(message("user", corpus.render_choices(F.col(question), letters, F.col(choices))), message("assistant", letter)))


def question_conversations(rows: DataFrame, question: str, answer: str) -> DataFrame:
    return rows.withColumn("messages", F.array(message("user", F.col(question)), message("assistant", F.col(answer))))


def auxiliary(rows: DataFrame) -> DataFrame:
    """Rows of a set that nests its columns in a struct ``train``, unwrapped."""
    return rows.select("train.*") if "train" in rows.columns else rows


def diverse_rows(count: DataFrame, index: str, options: dict[str, Sequence[str]], seed: int = 0) -> DataFrame:
    """One option of each kind for each index, drawn from the index and the seed alone."""
    pick = lambda name, values: F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.xxhash64(F.col(index), F.lit(f"{seed}/{name}")), F.lit(len(values))) + 1).cast("int"))
    return count.select(index, *(pick(n, v).alias(n) for n, v in options.items()))


def evaluation_bundle(spark: SparkSession, tasks: Sequence[dict], baselines: str, data: str) -> DataFrame:
    """(label, kind, shots, baseline, row) of all items: task list, baseline CSV and JSON lines joined.

    A task without a baseline is an error.
    """
    base = spark.read.option("header", True).csv(baselines).toDF("label", "baseline").select(F.trim("label").alias("label"), F.col("baseline").try_cast("double").alias("baseline"))
    known = {r["label"] for r in base.collect()}  # one row a task
    out = None
    for t in tasks:
        if t["label"] not in known:
            raise KeyError(t["label"])
        items = spark.read.text(f"{data}/{t['dataset']}").select(F.lit(t["label"]).alias("label"), F.lit(t["kind"]).alias("kind"), F.lit(int(t["shots"])).alias("shots"), F.col("value").alias("row"))
        out = items if out is None else out.unionByName(items)
    return out.join(F.broadcast(base), "label")


@dataclass(frozen=True)
class Task:
    """A view of conversations (``index``, messages and what ``correct`` needs): every ``step``-th from ``start`` to below ``stop``.

    ``kind``: generative or categorical.  ``correct``: whether a row's completion is right, as a
    column over the conversation's columns and the completion.  ``reward``: its worth, 1 or 0 by
    ``correct`` where none is given.
    """

    rows: DataFrame
    kind: str
    correct: Callable[[Column], Column]
    reward: Callable[[Column], Column] | None = None
    index: str = "index"
    start: int = 0
    stop: int | None = None
    step: int = 1

    def __post_init__(self) -> None:
        if self.kind not in ("generative", "categorical"):
            raise ValueError(f"unknown kind {self.kind}")
        if self.start < 0 or self.step < 1 or (self.stop is not None and self.stop < self.start):
            raise ValueError("bad slice")

    def __len__(self) -> int:
        """Number of examples of the view, whose end may lie behind the last row."""
        stop = self.rows.count() if self.stop is None else self.stop
        return max(0, -((self.start - stop) // self.step))

    def examples(self) -> DataFrame:
        """The view's rows, with the place in it as ``index`` and the row's own as ``of``."""
        return corpus.sliced(self.rows.withColumnRenamed(self.index, "of"), "of", self.start, self.stop, self.step)

    def example(self, index: int) -> DataFrame:
        """The one row at a place of the view."""
        at = self.start + index * self.step
        return corpus.sliced(self.rows.withColumnRenamed(self.index, "of"), "of", at, at + 1).withColumn("index", F.lit(index))

    def evaluated(self, completions: DataFrame) -> DataFrame:
        """(index, completion) rows with ``correct`` and ``reward``; a completion of no example is left out, none counts as wrong."""
        said = F.col("completion")
        right = F.coalesce(self.correct(said).cast("boolean"), F.lit(False))
        worth = right.cast("double") if self.reward is None else self.reward(said)
        return self.examples().join(completions.select("index", "completion"), "index").select("index", "completion", right.alias("correct"), worth.alias("reward"))


def seeded_head(rows: DataFrame, index: str, most: int, seed: int = 1337) -> DataFrame:
    """The first ``most`` rows of a seeded shuffle, with their ``place`` in it; ``index``: a whole-number order."""
    total = rows.count()
    placed = corpus.numbered(rows, index, "place")
    return placed.withColumn("place", corpus.shuffled(F.col("place"), max(total, 1), seed)).where(F.col("place") < most)


def long_prompts(rows: DataFrame, tokens: str, least: int = 512) -> DataFrame:
    return rows.where(F.size(tokens) >= least)


def summary_record(rows: DataFrame, **figures: Column) -> DataFrame:
    """One row of JSON with the figures."""
    return rows.agg(*(c.alias(n) for n, c in figures.items())).select(F.to_json(F.struct(*figures)).alias("value"))


def request_errors(requests: DataFrame, most_messages: int = 500, most_chars: int = 8_000, most_total: int = 32_000) -> DataFrame:
    """Requests (messages, temperature, top_k, max_tokens) with ``error``, null where all is in bounds."""
    size = F.aggregate("messages", F.lit(0), lambda a, m: a + F.length(F.coalesce(m["content"], F.lit(""))))
    rules = [
        (F.size("messages") == 0, "no messages"),
        (F.size("messages") > most_messages, "too many messages"),
        (F.exists("messages", lambda m: F.length(F.coalesce(m["content"], F.lit(""))) == 0), "empty message"),
        (F.exists("messages", lambda m: F.length(m["content"]) > most_chars), "message too long"),
        (size > most_total, "conversation too long"),
        (F.exists("messages", lambda m: ~m["role"].isin("user", "assistant")), "unknown role"),
        (~F.col("temperature").between(0, 2), "temperature out of range"),
        (~F.col("top_k").between(0, 200), "top_k out of range"),
        (~F.col("max_tokens").between(1, 4096), "max_tokens out of range"),
    ]
    return requests.withColumn("error", F.coalesce(*(F.when(c, m) for c, m in rules)))


def may_enter(keys: Column, allowed: Sequence[str]) -> Column:
    return F.coalesce(keys.isin(*allowed), F.lit(False)) if allowed else F.lit(False)


def put_values(old: DataFrame, new: DataFrame) -> DataFrame:
    """A key-value table (key, value JSON) with new values in place of old ones."""
    return sync.merge(old, new, ["key"])


def get_value(rows: DataFrame, key: str) -> dict | None:
    got = rows.where(F.col("key") == key).limit(1).collect()
    return json.loads(got[0]["value"]) if got else None


def save_document(old: DataFrame, repo: str, document: str, by: str = "repo_id") -> DataFrame:
    """The versions of a document with one more, numbered after the last."""
    last = old.where(F.col(by) == repo).agg((F.coalesce(F.max("version"), F.lit(0)) + 1).cast("int").alias("version"))
    return old.unionByName(last.select(F.lit(repo).alias(by), "version", F.lit(document).alias("document")).select(*old.columns))


def user_documents(users: DataFrame, documents: DataFrame) -> DataFrame:
    """The latest document of each of a user's repositories, those without one left out."""
    return users.join(sync.latest(documents, ["repo_id"], "version"), "repo_id")


def agent_prompt(turns: DataFrame, by: str = "conv_id", order: str = "turn", text: str = "text") -> DataFrame:
    """(by, prompt): the last turns as 'role: text' lines."""
    kept = serving.last_turns(turns, by, order, text)
    lines = F.sort_array(F.collect_list(F.struct(order, F.concat_ws(": ", "role", text).alias("line"))))
    return kept.groupBy(by).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("prompt"))


def joined_chunks(chunks: DataFrame, by: str, order: str, content: str) -> DataFrame:
    """Streamed pieces of a response, text or bytes, put together."""
    piece = F.make_valid_utf8(F.col(content).cast("string"))
    return chunks.groupBy(by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, piece.alias("piece")))), lambda x: x["piece"]), "").alias("response"))


def named_arguments(pairs: Column) -> Column:
    """An array of (name, value) as a map."""
    return F.map_from_entries(F.transform(pairs, lambda p: F.struct(p["name"], p["value"])))


#: Tools by name: each takes the files (path, content) of a repository and its own arguments.
TOOLS: dict[str, Callable[..., DataFrame]] = {"list_repo_files": serving.children, "read_repo_file": lambda files, path, most=12_000: serving.read_prefix(files.where(F.col("path") == path), most), "search_repo_text": serving.grep}


def call_tool(name: str, files: DataFrame, **arguments: str) -> DataFrame:
    if name not in TOOLS:
        raise KeyError(f"no tool {name!r}; there are {', '.join(sorted(TOOLS))}")
    return TOOLS[name](files, **arguments)
