"""Token ids of texts by a given vocabulary, texts of ids, the next token of logits, and tool calls in a token stream."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, functions as F

from stratum.operators.corpus import SPECIAL, SPLIT, calculator, first_most


@lru_cache(maxsize=4)
def vocabulary(path: str, pattern: str = SPLIT, special: tuple[str, ...] = SPECIAL):  # noqa: ANN201
    """The encoding of a file of ranks; special tokens are numbered behind the vocabulary, in their order."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={s: len(ranks) + k for k, s in enumerate(special)})


def _number(path: str, token: str | int | None) -> list[int]:
    return [] if token is None else [token if isinstance(token, int) else vocabulary(path).encode_single_token(token)]


def encode(text: Column, path: str, prepend: str | int | None = None, append: str | int | None = None) -> Column:
    """Ids of a text, in which special tokens' strings are ordinary text; null counts as empty.

    ``path``: a file of base64 words with ranks, readable where tasks run.  ``prepend`` and
    ``append``: a special token or an id put before and behind each text's ids.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vocab, before, behind = vocabulary(path), _number(path, prepend), _number(path, append)
        for texts in batches:
            yield pd.Series([[*before, *vocab.encode_ordinary(t), *behind] for t in texts.fillna("")])

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<int>")(text)


def decode(ids: Column, path: str) -> Column:
    """The text of ids, special tokens as their strings; bytes that aren't UTF-8 become U+FFFD; null counts as empty."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vocab = vocabulary(path)
        for rows in batches:
            yield pd.Series(["" if r is None else vocab.decode(list(r)) for r in rows], dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "string")(ids)


def next_token(logits: Column, draw: Column, temperature: float = 1.0, top_k: int | None = None) -> Column:
    """The place of a token drawn by its share of exp(logit / temperature), of the ``top_k`` largest if given.

    ``draw``: a number from 0 to below 1 that decides; the larger logits come first, the earlier of
    equals.  At temperature 0 the largest is taken.  Null or no logits give null.
    """
    if temperature < 0:
        raise ValueError("temperature can't be negative")
    if temperature == 0:
        return F.when(F.size(logits) > 0, first_most(logits))
    ranked = F.array_sort(F.transform(logits, lambda x, i: F.struct((-x).alias("less"), i.alias("id"))))
    kept = F.slice(ranked, 1, top_k) if top_k else ranked
    shares = F.transform(kept, lambda e: F.struct(e["id"].alias("id"), F.exp((-e["less"] - F.array_max(logits)) / temperature).alias("share")))
    total = F.aggregate(shares, F.lit(0.0), lambda a, e: a + e["share"])
    # walk until the running share passes the draw; rounding may leave the last one to take
    start = F.struct(F.lit(0.0).alias("run"), F.lit(-1).alias("id"))
    step = lambda a, e: F.struct((a["run"] + e["share"]).alias("run"), F.when((a["id"] < 0) & (a["run"] + e["share"] > draw * total), e["id"]).otherwise(a["id"]).alias("id"))
    found = F.aggregate(shares, start, step)["id"]
    return F.when(F.size(logits) > 0, F.when(found >= 0, found).otherwise(F.element_at(kept, -1)["id"]))


def answered(sampled: Sequence[int], special: dict[str, int], to_text: Callable[[list[int]], str], to_ids: Callable[[str], list[int]], tool: Callable[[str], str | None] = calculator) -> tuple[list[int], list[int]]:
    """(ids, mask) of a stream of sampled ids in which tool calls are answered.

    Behind a call, python_start to python_end, its answer stands between output_start and
    output_end, with mask 0; as many sampled ids are passed over.  A call without content or
    without an answer adds nothing.  The stream ends before assistant_end or bos.
    """
    ids, mask, call, waiting = [], [], None, []
    stops = {special["<|assistant_end|>"], special["<|bos|>"]}
    for drawn in sampled:
        mask.append(int(not waiting))
        ids.append(waiting.pop(0) if waiting else drawn)
        if ids[-1] in stops:
            return ids[:-1], mask[:-1]
        if ids[-1] == special["<|python_start|>"]:
            call = []
        elif call is not None and ids[-1] == special["<|python_end|>"]:
            answer = tool(to_text(call)) if call else None
            if answer is not None:
                waiting = [special["<|output_start|>"], *to_ids(answer), special["<|output_end|>"]]
            call = None
        elif call is not None:
            call.append(ids[-1])
    return ids, mask


def answer_calls(sampled: Column, special: dict[str, int], to_text: Callable[[list[int]], str], to_ids: Callable[[str], list[int]], tool: Callable[[str], str | None] = calculator) -> Column:
    """``answered`` of a column of id arrays, as a struct of ids and mask; null counts as empty."""

    def run(rows: pd.Series) -> pd.DataFrame:
        done = [answered([] if r is None else list(map(int, r)), special, to_text, to_ids, tool) for r in rows]
        return pd.DataFrame({"ids": [d[0] for d in done], "mask": [d[1] for d in done]})

    run.__annotations__ = {"rows": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, "ids array<int>, mask array<int>")(sampled)
