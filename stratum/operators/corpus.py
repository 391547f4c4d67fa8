"""Corpora and tasks for language models: shards, crops, packing, mixtures, conversations, prompts, answers."""

from __future__ import annotations

import hashlib
import operator
import re
from bisect import bisect_right, insort
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import groupby, islice
from operator import itemgetter

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from stratum.operators.greedy import Reached, parted

# Tokens of a rendered conversation.
SPECIAL = ("<|bos|>", "<|user_start|>", "<|user_end|>", "<|assistant_start|>", "<|assistant_end|>", "<|python_start|>", "<|python_end|>", "<|output_start|>", "<|output_end|>")
# Fixed value: the pre-tokenisation pattern.
SPLIT = r"'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?+\p{L}+|\p{N}{1,2}| ?[^\s\p{L}\p{N}]++[\r\n]*|\s*[\r\n]|\s+(?!\S)|\s+"
ANSWER = r"#### (\-?[0-9\.\,]+)"


def split_last_shard(rows: DataFrame, shard: str) -> DataFrame:
    """Rows with ``split``: the last shard in name order is val, the others train."""
    last = rows.agg(F.max(shard).alias("__last"))
    return rows.crossJoin(F.broadcast(last)).withColumn("split", F.when(F.col(shard) == F.col("__last"), "val").otherwise("train")).drop("__last")


def stride(rows: DataFrame, place: str, rank: int, world: int) -> DataFrame:
    return rows.where(F.pmod(F.col(place), F.lit(world)) == rank)


def numbered(rows: DataFrame, order: str, name: str = "index") -> DataFrame:
    """Rows with their place, from 0, by a whole-number ``order``.

    Rows are counted in blocks of the order, whose counts are added up first, so no task sorts more than a block.
    """
    rows = rows.withColumn("__block", F.floor(F.col(order) / 4096))
    sums = rows.groupBy("__block").agg(F.count("*").alias("__sum"))
    before = sums.select("__block", (F.sum("__sum").over(Window.orderBy("__block")) - F.col("__sum")).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__block").orderBy(order)) - 1 + F.col("__before")
    return rows.join(before, "__block").withColumn(name, place).drop("__block", "__before")


def sliced(rows: DataFrame, order: str, start: int = 0, stop: int | None = None, step: int = 1) -> DataFrame:
    """Rows at start, start + step and so on below ``stop`` by a whole-number ``order``, with their new ``index``.

    Rows are counted in blocks of the order, whose counts are added up first, so no task sorts more than a block.
    """
    if start < 0 or step < 1 or (stop is not None and stop < start):
        raise ValueError("bad slice")
    rows = rows.withColumn("__block", F.floor(F.col(order) / 4096))
    sums = rows.groupBy("__block").agg(F.count("*").alias("__sum"))
    before = sums.select("__block", (F.sum("__sum").over(Window.orderBy("__block")) - F.col("__sum")).alias("__before"))
    rows = rows.join(before if stop is None else before.where(F.col("__before") < stop), "__block")
    rows = rows.withColumn("__place", F.row_number().over(Window.partitionBy("__block").orderBy(order)) - 1 + F.col("__before"))
    rows = rows.where((F.col("__place") >= start) & (F.pmod(F.col("__place") - start, F.lit(step)) == 0))
    rows = rows if stop is None else rows.where(F.col("__place") < stop)
    return rows.withColumn("index", ((F.col("__place") - start) / step).cast("int")).drop("__place", "__block", "__before")


#: Rounds of a shuffle, and the prime that its keys and hashes are below.
ROUNDS, PRIME = 40, (1 << 31) - 1


def shuffle_keys(seed: int) -> list[tuple[int, int, int, int]]:
    """(shift, two factors, offset) of each round, drawn from the seed."""
    numbers = [int.from_bytes(hashlib.sha256(f"{seed}/{r}/{k}".encode()).digest()[:8]) for r in range(ROUNDS) for k in range(4)]
    return [(numbers[i] >> 2, *(1 + n % (PRIME - 1) for n in numbers[i + 1 : i + 4])) for i in range(0, len(numbers), 4)]


def shuffled(place: Column, total: Column | int, seed: int = 42, back: bool = False) -> Column:
    """Where a place of ``total`` goes in a shuffle that the seed fixes, or (``back``) which place comes there.

    A bijection of 0 to total - 1, for any total, computed for each place alone: nothing is sorted or
    sent.  A round pairs each place with its mirror about a key and swaps both or neither, by a bit of
    a hash of the larger; so it undoes itself, and the way back is the rounds in reverse.
    """
    total = F.lit(total).cast("long") if isinstance(total, int) else total.cast("long")
    keys = shuffle_keys(seed)
    rounds = F.array(*(F.struct(*(F.lit(v).cast("long").alias(n) for n, v in zip(("shift", "a", "b", "c"), k, strict=True))) for k in (reversed(keys) if back else keys)))

    def swap(x: Column, k: Column) -> Column:
        mirror = F.pmod(k["shift"] % total - x, total)
        top = F.greatest(x, mirror)
        mixed = F.pmod(F.pmod(top, F.lit(PRIME)) * k["a"] + F.call_function("div", top, F.lit(PRIME)) % PRIME * k["b"] + k["c"], F.lit(PRIME))
        return F.when(F.shiftright(mixed, 15) % 2 == 1, mirror).otherwise(x)

    return F.aggregate(rounds, place.cast("long"), swap)


def mixture(tasks: Sequence[DataFrame], index: str, seed: int = 42) -> DataFrame:
    """All rows of all tasks, a task given twice counted twice, with ``task`` and ``place``: where the shuffle that the seed fixes puts them.

    ``index``: a whole-number order within a task.  Rows get their places alone, after they are
    counted; no sort of all rows.  ``mixture_rows`` gives those at some places.
    """
    parts, before = [], 0
    for k, t in enumerate(tasks):
        parts.append((k, t, before))
        before += t.count()
    out = None
    for k, t, first in parts:
        own = numbered(t, index, "place").withColumn("task", F.lit(k)).withColumn("place", F.col("place") + first)
        out = own if out is None else out.unionByName(own)
    return out.withColumn("place", shuffled(F.col("place"), before, seed)) if before else out


def mixture_rows(sizes: Sequence[int], places: DataFrame, place: str = "place", seed: int = 42) -> DataFrame:
    """``places`` with the ``task`` and the row's ``local`` place in it that a mixture of tasks of such sizes has there; no task is read."""
    total = sum(sizes)
    rows = places.where(F.col(place).between(0, total - 1)).withColumn("local", shuffled(F.col(place), max(total, 1), seed, back=True))
    ends = [sum(sizes[: k + 1]) for k in range(len(sizes))]
    task = F.coalesce(*(F.when(F.col("local") < end, k) for k, end in enumerate(ends)))
    return rows.withColumn("task", task).withColumn("local", F.col("local") - F.element_at(F.array(*map(F.lit, [0, *ends[:-1]])), F.col("task") + 1))


def sequence(tasks: Sequence[DataFrame], index: str) -> DataFrame:
    out = None
    for k, t in enumerate(tasks):
        t = t.withColumn("task", F.lit(k))
        out = t if out is None else out.unionByName(t)
    return out.orderBy("task", index)


def crop_corpus(docs: DataFrame, order: str, text: str, doc_cap: int, max_chars: int) -> DataFrame:
    """Texts cut to ``doc_cap``, up to and with the one that takes the total past ``max_chars``.

    The running total is kept within blocks of the order, whose totals are added up first, so no
    task holds more than a block.
    """
    block = F.floor(F.col(order) / 4096)
    rows = docs.withColumn(text, F.substring(text, 1, doc_cap)).withColumn("__n", F.length(text)).withColumn("__block", block)
    sums = rows.groupBy("__block").agg(F.sum("__n").alias("__sum"))
    before = sums.select("__block", (F.sum("__sum").over(Window.orderBy("__block")) - F.col("__sum")).alias("__before")).where(F.col("__before") <= max_chars)
    run = F.sum("__n").over(Window.partitionBy("__block").orderBy(order)) - F.col("__n") + F.col("__before")
    return rows.join(before, "__block").withColumn("__run", run).where(F.col("__run") <= max_chars).drop("__n", "__block", "__before", "__run")


def folded(rows: DataFrame, by: str, fold: Callable[[Iterator[tuple]], Iterator[tuple]], schema: str) -> DataFrame:
    """(by, what ``fold`` gives) of each group's other columns, of partitions that hold whole groups in order."""
    fields = StructType.fromDDL(f"__by {dict(rows.dtypes)[by]}, {schema}")
    shape = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        found = ((key, *out) for key, own in groupby(values, itemgetter(0)) for out in fold(row[1:] for row in own))
        while some := list(islice(found, 16_384)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), shape, strict=True)], schema=shape)

    return rows.select(by, *(c for c in rows.columns if c != by)).mapInArrow(run, fields).withColumnRenamed("__by", by)


def in_order(rows: DataFrame, by: str, order: str, fold: Callable[[Iterator[tuple]], Iterator[tuple]], schema: str) -> DataFrame:
    """(by, what ``fold`` gives) of each group's other columns, which it gets a row at a time, sorted by ``order``.

    For folds in which each row's result hangs on those before it.  Groups are sorted by Spark,
    which spills, and streamed through the fold, so a task holds only what the fold keeps, however
    large a group is.
    """
    return folded(rows.repartition(by).sortWithinPartitions(by, order), by, fold, schema)


def closed_shards(docs: Iterable[tuple], chars: int, group: int) -> Iterator[tuple]:
    """(document, size, shard) of (document, size): a shard ends when it has ``chars`` or more and a multiple of ``group`` documents; -1 for the rest.

    Holds the documents of one shard.
    """
    shard, held, total = 0, [], 0
    for doc, size in docs:
        held.append((doc, size))
        total += size or 0
        if total >= chars and len(held) % group == 0:
            yield from ((*d, shard) for d in held)
            shard, held, total = shard + 1, [], 0
    yield from ((*d, -1) for d in held)


def assign_shards(sizes: Iterable[int], chars: int, group: int) -> list[int]:
    """Shard of each document of a list."""
    return [s for *_, s in closed_shards(enumerate(sizes), chars, group)]


def shards(docs: DataFrame, stream: str, order: str, size: str, chars: int, group: int) -> DataFrame:
    """(stream, order, size, shard) of ordered streams; only keys and sizes are sent.

    Streams that lie in one task pass through it; one of more rows is spread over many (``greedy``).
    """
    types = dict(docs.dtypes)
    schema = f"{order} {types[order]}, {size} {types[size]}, shard int"
    fold = lambda rows: folded(rows, stream, lambda own: closed_shards(own, chars, group), schema)
    return parted(docs.select(stream, order, size), stream, order, size, Reached(chars, group), "shard", fold)


def packed(docs: Iterable[tuple], capacity: int, buffer: int, crop: bool) -> Iterator[tuple]:
    """(row, offset, document, taken) of (document, size): best fit from a buffer of documents.

    The largest that fits goes next, the earliest of equals.  Where none fits, the shortest is
    cropped to fill the row, or the row is left short if ``crop`` is false.  Holds the buffer alone,
    sorted by size and, of equals, latest first.
    """
    coming, held, count, row, used = iter(docs), [], 0, 0, 0
    while True:
        for doc, size in islice(coming, buffer - len(held)):
            insort(held, (size or 0, -count, doc))
            count += 1
        if not held:
            return
        left = capacity - used
        at = bisect_right(held, left, key=itemgetter(0)) - 1
        if at < 0 and not crop and used:
            row, used = row + 1, 0
            continue
        # none fits: the earliest of the shortest, to fill the row (one longer than an empty row keeps its beginning)
        at = at if at >= 0 else bisect_right(held, held[0][0], key=itemgetter(0)) - 1
        size, _, doc = held.pop(at)
        taken = min(size, left)
        yield row, used, doc, taken
        used += taken
        if used == capacity:
            row, used = row + 1, 0


def pack_rows(sizes: Iterable[int], capacity: int, buffer: int, crop: bool) -> list[tuple[int, int, int, int]]:
    """(row, offset, document, taken) of a list of sizes."""
    return list(packed(enumerate(sizes), capacity, buffer, crop))


def best_fit(docs: DataFrame, shard: str, order: str, size: str, capacity: int, buffer: int = 1000, crop: bool = True) -> DataFrame:
    """(shard, row, offset, doc, taken) of documents packed in order within each shard."""
    return in_order(docs.select(shard, order, size), shard, order, lambda rows: packed(rows, capacity, buffer, crop), f"row int, offset int, doc {dict(docs.dtypes)[order]}, taken int")


def conversations(turns: DataFrame, by: str = "conv_id", order: str = "turn") -> DataFrame:
    """(by, messages): one row a conversation from one row a turn."""
    return turns.groupBy(by).agg(F.transform(F.sort_array(F.collect_list(F.struct(order, "role", "text"))), lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content"))).alias("messages"))


def is_valid(messages: Column, least: int = 2) -> Column:
    """An optional system message, then user and assistant in turn, nothing empty."""
    body = F.when(F.element_at(messages, 1)["role"] == "system", F.slice(messages, 2, F.greatest(F.size(messages) - 1, F.lit(0)))).otherwise(messages)
    turns = F.forall(F.transform(body, lambda m, i: (m["role"] == F.when(i % 2 == 0, "user").otherwise("assistant")) & (F.length(F.coalesce(m["content"], F.lit(""))) > 0)), lambda ok: ok)
    return (F.size(messages) > 0) & (F.size(body) >= least) & turns


def merge_system(messages: Column) -> Column:
    """A leading system message put before the user message that follows it."""
    first, second = F.element_at(messages, 1), F.try_element_at(messages, F.lit(2))
    joined = F.array(F.struct(second["role"].alias("role"), F.concat(first["content"], F.lit("\n\n"), second["content"]).alias("content")))
    return F.when((first["role"] == "system") & (F.size(messages) > 1), F.concat(joined, F.slice(messages, 3, F.greatest(F.size(messages) - 2, F.lit(0))))).otherwise(messages)


def render_segments(messages: Column) -> Column:
    """(text, mask) pieces of a conversation with string contents; mask 1 where the assistant is trained on."""
    piece = lambda text, mask: F.struct(text.alias("text"), F.lit(mask).alias("mask"))
    user = lambda m: F.array(piece(F.lit("<|user_start|>"), 0), piece(m["content"], 0), piece(F.lit("<|user_end|>"), 0))
    assistant = lambda m: F.array(piece(F.lit("<|assistant_start|>"), 0), piece(m["content"], 1), piece(F.lit("<|assistant_end|>"), 1))
    return F.concat(F.array(piece(F.lit("<|bos|>"), 0)), F.flatten(F.transform(messages, lambda m: F.when(m["role"] == "user", user(m)).otherwise(assistant(m)))))


def render_tokens(conversations_: DataFrame, by: str, encode, max_tokens: int = 2048, special_from: int = 50257, complete: bool = False) -> DataFrame:  # noqa: ANN001
    """(by, ids, mask) of conversations whose messages are (role, parts of (type, text)).

    ``encode``: text to ids; ids of the special tokens follow ``special_from`` in their order.
    Text and python parts of the assistant are trained on, python output and the user are not.
    To ``complete`` a conversation its last assistant message is left out and the token that
    starts one is put last.
    """
    number = {t: special_from + k for k, t in enumerate(SPECIAL)}
    around = {"python": ("<|python_start|>", "<|python_end|>", 1), "python_output": ("<|output_start|>", "<|output_end|>", 0)}
    # (role, part) -> tokens before and after it, and what of it is trained on
    layout = {("user", "text"): ((), (), 0), ("assistant", "text"): ((), (), 1)} | {("assistant", kind): ((number[a],), (number[b],), bit) for kind, (a, b, bit) in around.items()}

    def pieces(role: str, parts: list) -> Iterator[tuple[Sequence[int], int]]:
        """Token runs of one message, each with its mask."""
        yield (number[f"<|{role}_start|>"],), 0
        for p in parts:
            if (role, p["type"]) not in layout:
                raise ValueError(f"unknown part {p['type']} of {role}")
            before, behind, bit = layout[role, p["type"]]
            yield (*before, *encode(p["text"]), *behind), bit
        yield (number[f"<|{role}_end|>"],), int(role == "assistant")

    def render(messages: list) -> tuple[list[int], list[int]]:
        messages = [(m["role"], list(m["parts"])) for m in messages]
        if messages and messages[0][0] == "system":
            if len(messages) < 2 or messages[1][0] != "user":
                raise ValueError("a system message must be followed by a user message")
            lead = "".join(p["text"] for p in messages[0][1])
            messages = [("user", [{"type": "text", "text": lead + "\n\n" + "".join(p["text"] for p in messages[1][1])}]), *messages[2:]]
        if complete and messages and messages[-1][0] == "assistant":
            messages = messages[:-1]
        odd = [i for i, (role, _) in enumerate(messages) if role != ("user", "assistant")[i % 2]]
        if odd:
            raise ValueError(f"message {odd[0]} is from {messages[odd[0]][0]}")
        runs = [((number["<|bos|>"],), 0), *(run_ for m in messages for run_ in pieces(*m)), *([((number["<|assistant_start|>"],), 0)] if complete else [])]
        ids, mask = [t for r, _ in runs for t in r], [bit for r, bit in runs for _ in r]
        return ids[:max_tokens], mask[:max_tokens]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            done = [render(m) for m in pdf["messages"]]
            yield pd.DataFrame({by: pdf[by], "ids": [d[0] for d in done], "mask": [d[1] for d in done]})

    return conversations_.select(by, "messages").mapInPandas(run, f"{by} {dict(conversations_.dtypes)[by]}, ids array<int>, mask array<int>")


def for_completion(messages: Column) -> Column:
    """The conversation without its last assistant message."""
    return F.when(F.element_at(messages, -1)["role"] == "assistant", F.slice(messages, 1, F.size(messages) - 1)).otherwise(messages)


def render_choices(question: Column, letters: Column, choices: Column) -> Column:
    """A multiple choice prompt: the letter after each choice, so that it follows '=' without a space."""
    lines = F.array_join(F.zip_with(letters, choices, lambda a, c: F.concat(F.lit("- "), c, F.lit("="), a, F.lit("\n"))), "")
    return F.concat(F.lit("Multiple Choice question: "), question, F.lit("\n"), lines, F.lit("\nRespond only with the letter of the correct answer."))


def few_shot(prompt: Column, examples: Column, delimiter: str = " ") -> Column:
    """Worked examples (query, answer), a blank line after each, then the prompt."""
    shots = F.array_join(F.transform(examples, lambda e: F.concat(e["query"], F.lit(delimiter), e["answer"], F.lit("\n\n"))), "")
    return F.concat(shots, prompt)


def choice_prompts(query: Column, choices: Column, delimiter: str = " ") -> Column:
    return F.transform(choices, lambda c: F.concat(query, F.lit(delimiter), c))


def schema_prompts(contexts: Column, continuation: Column, delimiter: str = " ") -> Column:
    return F.transform(contexts, lambda c: F.concat(c, F.lit(delimiter), continuation))


def completion_prompts(context_: Column, continuation: Column, delimiter: str = " ") -> Column:
    """Prompt without and with its continuation; the one without ends in no white space."""
    trimmed = F.regexp_replace(context_, r"^\s+|\s+$", "")
    return F.array(F.regexp_replace(F.concat(trimmed, F.lit(delimiter)), r"^\s+|\s+$", ""), F.concat(trimmed, F.lit(delimiter), continuation))


def common_prefix(a: Column, b: Column) -> Column:
    """How many leading elements two arrays share."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y) & x.isNotNull())
    return F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, F.size(same)).cast("int")


def common_length(sequences: Column, suffix: bool = False) -> Column:
    """How many leading (or trailing) elements all arrays of an array share."""
    rows = F.transform(sequences, F.reverse) if suffix else sequences
    first = F.element_at(rows, 1)
    same = F.transform(first, lambda x, i: F.forall(rows, lambda r: (F.size(r) > i) & F.get(r, i).eqNullSafe(x)))
    return F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, F.size(same).cast("long")).cast("int")


def answer_spans(sequences: Column, kind: str) -> Column:
    """(start, end) of what counts in each token sequence of an item.

    choice: from where the options differ to the end; schema: the common ending; completion: what
    the second sequence adds to the first, which must begin it.
    """
    span = lambda a, b: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"))
    if kind == "choice":
        return F.transform(sequences, lambda s: span(common_length(sequences), F.size(s)))
    if kind == "schema":
        return F.transform(sequences, lambda s: span(F.size(s) - common_length(sequences, suffix=True), F.size(s)))
    if kind != "completion":
        raise ValueError(f"no kind {kind!r}")
    short, long = F.element_at(sequences, 1), F.element_at(sequences, 2)
    fits = (F.size(short) < F.size(long)) & (F.slice(long, 1, F.size(short)) == short)
    return F.when(fits, F.array(span(F.size(short), F.size(long)))).otherwise(F.raise_error(F.lit("the prompt must begin its continuation")).cast("array<struct<start:int,end:int>>"))


def padded(ids: Column, mask: Column, capacity: int, pad: int) -> Column:
    """(ids, targets) of a row: filled up with ``pad``, targets -1 where nothing is trained on."""
    short = F.greatest(F.lit(capacity) - F.size(ids), F.lit(0))
    return F.struct(F.concat(ids, F.array_repeat(F.lit(pad), short)).alias("ids"), F.concat(F.zip_with(ids, mask, lambda i, m: F.when(m == 1, i).otherwise(-1)), F.array_repeat(F.lit(-1), short)).alias("targets"))


def best_option(scores: Column, options: Column) -> Column:
    """The option, a place in ``scores``, with the highest score; the first of equals."""
    return F.element_at(options, first_most(F.transform(options, lambda o: F.get(scores, o))) + 1)


def letter_trace(word: Column, letter: Column) -> Column:
    """Running counts of a letter along a word."""
    return F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: letter_count(F.substring(word, F.lit(1), i), letter))


def epochs(rows: DataFrame, place: str, count: int, after: tuple[int, int] | None = None) -> DataFrame:
    """Rows with ``epoch``: all of them ``count`` times over, from behind (epoch, place) ``after`` on."""
    out = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    return out if after is None else out.where((F.col("epoch") > after[0]) | ((F.col("epoch") == after[0]) & (F.col(place) > after[1])))


def crop_left(tokens: Column, most: int, start: Column, end: Column) -> Column:
    """The last ``most`` tokens, and the span moved along."""
    cut = F.greatest(F.size(tokens) - most, F.lit(0))
    return F.struct(F.slice(tokens, cut + 1, most).alias("tokens"), (start - cut).alias("start"), (end - cut).alias("end"))


def first_least(values: Column) -> Column:
    """Index of the smallest element, the first of equals."""
    return (F.array_position(values, F.array_min(values)) - 1).cast("int")


def first_most(values: Column) -> Column:
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def all_equal(predicted: Column, actual: Column) -> Column:
    return F.forall(F.zip_with(predicted, actual, lambda a, b: a.eqNullSafe(b)), lambda x: x)


def extract_answer(text: Column) -> Column:
    """The number after '####', commas left out; null for none."""
    return F.replace(F.nullif(F.regexp_extract(text, ANSWER, 1), F.lit("")), F.lit(","), F.lit(""))


def normalize_answer(text: Column) -> Column:
    """First word of the first line, without ',' and '_'."""
    line = F.regexp_replace(F.element_at(F.split(F.trim(text), r"\r?\n"), 1), "[,_]", "")
    return F.nullif(F.regexp_extract(line, r"(\S+)", 1), F.lit(""))


def same_answer(a: Column, b: Column) -> Column:
    """1 for equal answers, two missing ones included."""
    return a.eqNullSafe(b).cast("int")


def relative_reward(predicted: Column, reference: Column) -> Column:
    p, r = F.expr("null").cast("double") if predicted is None else predicted.try_cast("double"), reference.try_cast("double")
    return F.coalesce(F.greatest(F.lit(0.0), 1 - F.abs(r - p) / (F.abs(r) + 1e-8)), F.lit(0.0))


def combined_reward(correct: Column, bonus: Column) -> Column:
    return F.least(F.lit(1.0), correct * 0.7 + bonus)


#: Signs by precedence, lowest first, each with what it does; all join from the left but powers.
_SIGNS = ({"+": operator.add, "-": operator.sub}, {"*": operator.mul, "/": operator.truediv, "//": operator.floordiv, "%": operator.mod})
_TOKEN = re.compile(r"\s*(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?|\*\*|//|[-+*/%()])")
#: Largest power of whole numbers that is worked out.
POWER_BITS = 4_096


def _power(x: float, y: float) -> float:
    if isinstance(x, int) and isinstance(y, int) and y > 0 and x.bit_length() * y > POWER_BITS:
        raise ValueError("too large")
    z = x**y
    if isinstance(z, complex):
        raise ValueError("not real")
    return z


def arithmetic(text: str) -> float:
    """The value of an expression of numbers, brackets and + - * / // % **; anything else is an error."""
    signs, at = [], 0
    text = text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError("not arithmetic")
        signs.append(m[1])
        at = m.end()
    signs.append("")
    place = 0

    def take() -> str:
        nonlocal place
        place += 1
        return signs[place - 1]

    def joined(level: int) -> float:
        if level == len(_SIGNS):
            return signed()
        left = joined(level + 1)
        while signs[place] in _SIGNS[level]:
            left = _SIGNS[level][take()](left, joined(level + 1))
        return left

    def signed() -> float:
        if signs[place] in ("+", "-"):
            return -signed() if take() == "-" else signed()
        base = atom()
        if signs[place] == "**":
            take()
            return _power(base, signed())
        return base

    def atom() -> float:
        sign = take()
        if sign == "(":
            inner = joined(0)
            if take() != ")":
                raise ValueError("not arithmetic")
            return inner
        if not sign or not (sign[0].isdigit() or sign[0] == "."):
            raise ValueError("not arithmetic")
        return int(sign) if sign.isdigit() else float(sign)

    value = joined(0)
    if signs[place]:
        raise ValueError("not arithmetic")
    return value


def calculator(text: str) -> str | None:
    """A tool call: arithmetic without powers, or ``'...'.count('...')``; null where it is neither."""
    text = text.replace(",", "")
    counted = re.fullmatch(r"""\s*(['"])([^'"]*)\1\.count\((['"])([^'"]*)\3\)\s*""", text)
    try:
        return str(counted[2].count(counted[4])) if counted else None if "**" in text else str(arithmetic(text))
    except (ValueError, ArithmeticError, RecursionError):
        return None


def steps_right(text: str | None) -> float:
    """0.05 for each '<<expression=result>>' that is right, 0.3 at most."""
    good = 0
    for call in re.findall(r"<<([^>]+)>>", text or ""):
        left, eq, right = call.rpartition("=")
        try:
            good += bool(eq) and abs(arithmetic(left) - float(right)) < 1e-6
        except (ValueError, ArithmeticError, RecursionError):
            pass
    return min(0.3, good * 0.05)


def step_bonus(text: Column) -> Column:
    """``steps_right`` of a column, in Arrow batches."""
    return F.pandas_udf(lambda s: s.map(steps_right), "double")(text)


def answer_parts(text: str) -> list[tuple[str, str]]:
    """(type, text) of an answer with '<<expression=result>>' calls."""
    out = []
    for piece in re.split(r"(<<[^>]+>>)", text):
        if piece.startswith("<<") and piece.endswith(">>"):
            left, eq, right = piece[2:-2].rpartition("=")
            out += [("python", left if eq else right), ("python_output", right if eq else "")]
        elif piece:
            out.append(("text", piece))
    return out


_TAG = re.compile(r"<(gadget|output|result)\b[^>]*>(.*?)</\1>", re.DOTALL)


def chain_parts(chain: str, result: str) -> list[tuple[str, str]]:
    """(type, text) of a trace of gadget, output and result tags, the final answer last."""
    out, at = [], 0
    for m in _TAG.finditer(chain):
        if before := chain[at : m.start()].strip():
            out.append(("text", before))
        kind = {"gadget": "python", "output": "python_output"}.get(m[1])
        if kind:
            out.append((kind, m[2].strip()))
        at = m.end()
    if rest := chain[at:].strip():
        out.append(("text", rest))
    return [*out, ("text", f"#### {result}")]


def parts_of(text: Column, result: Column | None = None) -> Column:
    """``answer_parts`` of a column, or ``chain_parts`` where there is a ``result``, in Arrow batches; null has none."""
    kind = "array<struct<type:string,text:string>>"
    named = lambda parts: [{"type": t, "text": x} for t, x in parts]
    if result is None:
        return F.pandas_udf(lambda s: s.map(lambda x: named(answer_parts(x or ""))), kind)(text)
    return F.pandas_udf(lambda s, r: pd.Series([named(chain_parts(x or "", y)) for x, y in zip(s, r, strict=True)]), kind)(text, result)


def letter_count(word: Column, letter: Column) -> Column:
    return F.length(word) - F.length(F.replace(word, letter, F.lit("")))


def code_block(text: Column) -> Column:
    """The first fenced block of a completion, or all of it."""
    fenced = F.regexp_extract(text, r"(?s)```(?:python)?\s*\n(.*?)```", 1)
    return F.regexp_replace(F.when(fenced != "", fenced).otherwise(text), r"^\s+|\s+$", "")


def leading_imports(text: Column) -> Column:
    """The import lines before the first other line."""
    return F.regexp_extract(text, r"\A((?:\s*(?:import|from)\b[^\n]*\n|\s*(?:#[^\n]*)?\n)*)", 1)


def pre_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(SPLIT), 0)


def spelling_rows(spark, words: Sequence[str], count: int, test: bool = False) -> DataFrame:  # noqa: ANN001
    """(index, word, letter, answer): a word and letter drawn for each index alone, test rows apart."""
    start = 10_000_000 if test else 0
    seed = F.xxhash64(F.col("id") + start)
    rows = spark.range(count).withColumn("word", F.element_at(F.array(*map(F.lit, words)), (F.pmod(seed, F.lit(len(words))) + 1).cast("int")))
    own = F.substr("word", F.pmod(F.xxhash64(seed, F.lit(1)), F.length("word").cast("long")) + 1, F.lit(1))
    other = F.substr(F.lit("abcdefghijklmnopqrstuvwxyz"), F.pmod(F.xxhash64(seed, F.lit(2)), F.lit(26)) + 1, F.lit(1))
    rows = rows.withColumn("letter", F.when(F.pmod(F.xxhash64(seed, F.lit(3)), F.lit(10)) < 9, own).otherwise(other))
    return rows.select(F.col("id").alias("index"), "word", "letter", letter_count(F.col("word"), F.col("letter")).alias("answer"))


def few_shot_pool(rows: DataFrame, index: str, shots: int, seed: int = 1234) -> DataFrame:
    """(index, shot): for each row ``shots`` different other rows, or all others if there are fewer.

    The rows stand in a seeded order.  Each draws steps to rows further on in it, going round the
    end: one from each of ``shots`` equal parts of the way round, so no two meet, and any row but
    its own can come.  Places are joined, so no pair of all rows is made.
    """
    total = rows.count()
    if total < 2 or shots < 1:
        return rows.select(index, F.col(index).alias("shot")).limit(0)
    shots = min(shots, total - 1)
    keyed = rows.select(F.col(index), F.xxhash64(F.col(index), F.lit(seed)).alias("__h"))
    # places in hash order, counted in blocks of the hash
    keyed = keyed.withColumn("__block", F.shiftright("__h", 48))
    sums = keyed.groupBy("__block").agg(F.count("*").alias("__n"))
    before = sums.select("__block", (F.sum("__n").over(Window.orderBy("__block")) - F.col("__n")).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__block").orderBy("__h", index)) - 1 + F.col("__before")
    placed = keyed.join(before, "__block").select(index, place.cast("long").alias("__place"))
    part = placed.select(index, "__place", F.explode(F.sequence(F.lit(0), F.lit(shots - 1))).alias("__s"))
    low, high = F.floor(F.col("__s") * (total - 1) / shots), F.floor((F.col("__s") + 1) * (total - 1) / shots)
    step = 1 + low + F.pmod(F.xxhash64(index, "__s", F.lit(seed)), high - low)
    drawn = part.select(index, F.pmod(F.col("__place") + step, F.lit(total)).alias("__place"))
    return drawn.join(placed.withColumnRenamed(index, "shot"), "__place").select(index, "shot")
