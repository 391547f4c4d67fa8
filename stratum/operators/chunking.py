"""File chunks by bytes and by definitions, batches of embedding requests, and the indexing pipeline."""

from __future__ import annotations

import ast
import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from stratum.functions import lexing
from stratum.functions.paths import inside, language
from stratum.operators.greedy import Filled, parted

CHUNK = "repo_slug string, file_path string, language string, strategy string, start_byte int, end_byte int, start_line int, end_line int, content binary"


@dataclass(frozen=True)
class ChunkConfig:
    max_bytes: int = 1200
    overlap_bytes: int = 120
    min_split_bytes: int = 300

    def __post_init__(self) -> None:
        if self.max_bytes <= 0 or self.overlap_bytes < 0 or self.min_split_bytes < 0:
            raise ValueError("sizes can't be negative, and max_bytes must be positive")
        if self.overlap_bytes >= self.max_bytes:
            raise ValueError("overlap_bytes must be below max_bytes")
        if self.min_split_bytes > self.max_bytes:
            raise ValueError("min_split_bytes can't exceed max_bytes")


def line_breaks(data: bytes) -> np.ndarray:
    """Places of all line breaks."""
    return np.flatnonzero(np.frombuffer(data, np.uint8) == 10)


def windows(breaks: np.ndarray, config: ChunkConfig, begin: int, stop: int) -> list[tuple[int, int]]:
    """Overlapping windows of a byte range, given its line breaks.

    A window that doesn't reach the end closes behind the last break in it that is at least
    ``min_split_bytes`` from its start, where there is one; the next starts ``overlap_bytes`` back.
    """
    out = []
    while begin < stop and (not out or out[-1][1] < stop):
        full = begin + config.max_bytes
        last = int(breaks[np.searchsorted(breaks, full) - 1]) if full < stop and len(breaks) and breaks[0] < full else -1
        out.append((begin, stop if full >= stop else last + 1 if last >= begin + config.min_split_bytes else full))
        begin = max(out[-1][1] - config.overlap_bytes, begin + 1)
    return out


def python_definitions(data: bytes) -> list[tuple[int, int]]:
    """Byte spans of top-level functions and classes, decorators included."""
    try:
        tree = ast.parse(data)
    except (SyntaxError, ValueError):
        return []
    starts = [0]
    for line in data.split(b"\n"):
        starts.append(starts[-1] + len(line) + 1)
    out = []
    for node in tree.body:
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            first = min([node.lineno, *(d.lineno for d in node.decorator_list)])
            out.append((starts[first - 1], min(len(data), starts[node.end_lineno - 1] + node.end_col_offset)))
    return out


def braced_definitions(language: str) -> Callable[[bytes], list[tuple[int, int]]]:
    """Finds byte spans of what Java or JavaScript source declares at the top, to the closing brace."""
    return lambda data: lexing.definitions(data.decode("latin-1"), language)


#: Strategy and definition finder by language; other languages are cut by bytes.
STRATEGIES: dict[str, tuple[str, Callable[[bytes], list[tuple[int, int]]]]] = {
    "python": ("python_definitions", python_definitions),
    "java": ("java_definitions", braced_definitions("java")),
    "javascript": ("javascript_definitions", braced_definitions("javascript")),
    "jsx": ("jsx_definitions", braced_definitions("javascript")),
}


def register_strategy(name: str, strategy: str, finder: Callable[[bytes], list[tuple[int, int]]]) -> None:
    STRATEGIES[name] = (strategy, finder)


def spans(data: bytes, lang: str | None, config: ChunkConfig, breaks: np.ndarray) -> tuple[str, list[tuple[int, int]]]:
    """(strategy, byte spans): definitions and the gaps between them, each cut; white space alone is left out."""
    name, finder = STRATEGIES.get(lang or "", ("naive", None))
    found = sorted(finder(data)) if finder else []
    if not found:
        return "naive", windows(breaks, config, 0, len(data))
    edges = [0, *np.maximum.accumulate([b for _, b in found]).tolist()]
    gaps = [(a, b) for a, b in zip(edges, [*(a for a, _ in found), len(data)], strict=True) if a < b]
    pieces = sorted([*found, *gaps])
    return name, [w for a, b in pieces if data[a:b].strip() for w in windows(breaks, config, a, b)]


def chunk_columns(data: bytes, lang: str | None, config: ChunkConfig) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """(strategy, spans, first lines, last lines) of a file's chunks."""
    breaks = line_breaks(data)
    name, found = spans(data, lang, config, breaks)
    at = np.array(found, dtype=np.int64).reshape(-1, 2)
    return name, at, np.searchsorted(breaks, at[:, 0]) + 1, np.searchsorted(breaks, np.maximum(at[:, 0], at[:, 1] - 1)) + 1


def chunk_files(files: DataFrame, config: ChunkConfig | None = None) -> DataFrame:
    """Chunks with ids of files (repo_slug, path, content binary); an empty file has none."""
    config = config or ChunkConfig()
    rows = files.select("repo_slug", "path", F.col("content").cast("binary").alias("content"), language(F.col("path"), F.make_valid_utf8(F.substring(F.col("content").cast("binary"), 1, 1024).cast("string"))).alias("language"))
    rules = dict(STRATEGIES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        STRATEGIES.update(rules)
        for batch in batches:
            owner, names, parts, contents = [], [], [], []
            for i, (content, lang) in enumerate(zip(batch.column(2), batch.column(3).to_pylist(), strict=True)):
                data = content.as_py() or b""
                name, at, first, last = chunk_columns(data, lang, config)
                owner += [i] * len(at)
                names += [name] * len(at)
                parts.append(np.column_stack([at, first, last]))
                contents += [data[a:b] for a, b in at.tolist()]
            take, numbers = pa.array(owner, pa.int32()), np.concatenate(parts).astype(np.int32) if parts else np.zeros((0, 4), np.int32)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in (0, 1, 3)), pa.array(names, pa.string()), *(pa.array(numbers[:, c]) for c in range(4)), pa.array(contents, pa.binary())], ["repo_slug", "file_path", "language", "strategy", "start_byte", "end_byte", "start_line", "end_line", "content"])

    chunks = rows.mapInArrow(run, CHUNK)
    ident = F.concat_ws(":", "repo_slug", "file_path", F.col("start_byte").cast("string"), F.col("end_byte").cast("string"), F.sha2("content", 256))
    return chunks.withColumn("chunk_id", F.sha2(ident, 256))


def batches_by_count(rows: DataFrame, size: int, order: str, by: str = "file_path") -> DataFrame:
    """Rows with ``batch``: consecutive runs of ``size`` in each file."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1
    return rows.withColumn("batch", F.floor(place / size).cast("int"))


class Filling:
    """Deals items to batches: one closes before an item that would exceed ``limit`` or the count ``most``."""

    def __init__(self, limit: int, most: int) -> None:
        self.limit, self.most, self.batch, self.used, self.count = limit, most, 0, 0, 0

    def add(self, size: int) -> int:
        if size > self.limit:
            raise ValueError(f"one input of size {size} exceeds the limit {self.limit}")
        if self.count and (self.count >= self.most or self.used + size > self.limit):
            self.batch, self.used, self.count = self.batch + 1, 0, 0
        self.used, self.count = self.used + size, self.count + 1
        return self.batch


def fill_batches(sizes: list[int], limit: int, most: int) -> list[int]:
    """Batch of each item of a list."""
    return list(map(Filling(limit, most).add, sizes))


def batches_by_budget(rows: DataFrame, size: str, limit: int, most: int, order: str, by: str = "file_path") -> DataFrame:
    """Rows with ``batch``, filled in order up to ``limit`` of column ``size`` and ``most`` rows; batches never span files.

    Rows that lie in one task stream through; a file of more rows is spread over many (``greedy``).
    """
    schema = StructType([*rows.schema.fields, StructField("batch", IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, filling = None, None
        for batch in batches:
            out = []
            for k, n in zip(batch.column(by).to_pylist(), batch.column(size).to_pylist(), strict=True):
                if filling is None or k != key:
                    key, filling = k, Filling(limit, most)
                out.append(filling.add(n or 0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int32())], [*batch.schema.names, "batch"])

    return parted(rows, by, order, size, Filled(limit, most), "batch", lambda sorted_: sorted_.mapInArrow(run, schema))


def token_count(text):  # noqa: ANN001, ANN201
    """Words of a text column, split at white space."""
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def hash_embedding(text, width: int = 8):  # noqa: ANN001, ANN201
    """The first bytes of a text's SHA-256, scaled to [0, 1]: a stand-in for a model."""
    digest = F.sha2(text, 256)
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: (F.conv(F.substr(digest, i * 2 + 1, F.lit(2)), 16, 10).cast("double") / 255.0).cast("float"))


def embedded(provider: Callable[[], Callable[[list[str]], list[list[float]]]], size: int = 16):  # noqa: ANN201
    """A column function that embeds texts with a provider, made once in each task, in lists of ``size``; as many vectors as texts."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embed = provider()
        for texts in batches:
            out: list[list[float]] = []
            for i in range(0, len(texts), size):
                some = texts.iloc[i : i + size].fillna("").tolist()
                got = embed(some)
                if len(got) != len(some):
                    raise ValueError(f"{len(some)} texts gave {len(got)} vectors")
                out += got
            yield pd.Series(out)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<float>")


def eligible_files(manifest: DataFrame, limit: int | None = None, max_bytes: int | None = None, skip_empty_hash: bool = True) -> DataFrame:
    """Files of a manifest (path, content_hash, size_bytes, ord, present) to index, in manifest order."""
    rows = manifest.where(F.col("path").isNotNull() & F.col("present") & inside(F.col("path")))
    if skip_empty_hash:
        rows = rows.where(F.coalesce(F.col("content_hash"), F.lit("")) != "")
    if max_bytes is not None:
        rows = rows.where(F.col("size_bytes") <= max_bytes)
    rows = rows.orderBy("ord")
    return rows if limit is None else rows.limit(limit)


def index_files(files: DataFrame, head_commit: str, config: ChunkConfig | None = None, embed: Callable | None = None) -> tuple[DataFrame, DataFrame]:
    """(vector records, statistics) of files: chunk, embed each chunk's text, one record a chunk."""
    if not head_commit:
        raise ValueError("a manifest without head_commit can't be indexed")
    chunks = chunk_files(files, config)
    text = F.make_valid_utf8(F.col("content").cast("string"))
    records = chunks.select((embed or hash_embedding)(text).alias("vector"), "repo_slug", F.lit(head_commit).alias("head_commit"), "file_path", "start_line", "end_line", "start_byte")
    stats = files.agg(F.count("*").alias("files_seen")).crossJoin(chunks.agg(F.countDistinct("file_path").alias("files_indexed"), F.count("*").alias("chunks_created"), F.count("*").alias("vectors_upserted")))
    return records, stats


def span_digest(content: bytes) -> str:
    return hashlib.sha256(content).hexdigest()
