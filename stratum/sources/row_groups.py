"""Parquet shards read by row groups, from a place (epoch, file, row group) on, in batches or as a stream.

Shards are taken in name order; the last one is val, the others train.  A reader of several takes
every ``world``-th row group of each file.  A place names what comes next: the epoch (from 1), the
file's name and the first row group not yet read, so it holds when shards are added behind it.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

START = {"epoch": 1, "file": "", "group": 0}
PLACE = [StructField("file", StringType()), StructField("row_group", IntegerType()), StructField("epoch", IntegerType())]


def _at(url: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(url) if "://" in url else fs.FileSystem.from_uri("file://" + posixpath.abspath(url.removeprefix("file:")))


def shards(folder: str, split: str = "all") -> list[str]:
    """Names of the parquet files right below a folder (or of the one file that it is), in order; ``split``: all, train or val."""
    store, path = _at(folder)
    if store.get_file_info(path).type == fs.FileType.File:
        return [""]
    found = sorted(f.base_name for f in store.get_file_info(fs.FileSelector(path)) if f.type == fs.FileType.File and f.extension == "parquet")
    return {"all": found, "train": found[:-1], "val": found[-1:]}[split]


@dataclass
class Shards:
    """The row groups of a folder's shards that one reader of ``world`` gets."""

    folder: str
    split: str = "all"
    epochs: int = 1
    rank: int = 0
    world: int = 1

    def __post_init__(self) -> None:
        self.store, self.path = _at(self.folder)
        self.counts: dict[str, int] = {}

    @classmethod
    def of(cls, options: dict) -> Shards:
        return cls(options["path"], options.get("split", "all"), int(options.get("epochs", 1)), int(options.get("rank", 0)), int(options.get("world", 1)))

    def file(self, name: str) -> str:
        return f"{self.path}/{name}" if name else self.path

    def groups(self, name: str) -> int:
        """Row groups of a file, from its footer, which is read once."""
        if name not in self.counts:
            with self.store.open_input_file(self.file(name)) as f:
                self.counts[name] = pq.ParquetFile(f).num_row_groups
        return self.counts[name]

    def schema(self) -> StructType:
        names = shards(self.folder, self.split)
        if not names:
            raise FileNotFoundError(f"no shards in {self.folder}")
        with self.store.open_input_file(self.file(names[0])) as f:
            known = pq.ParquetFile(f).schema_arrow
        return StructType([f for f in from_arrow_schema(known).fields if f.name not in {p.name for p in PLACE}] + PLACE)

    def ahead(self, start: dict, most: int | None = None, end: dict | None = None) -> Iterator[tuple[int, str, int, dict]]:
        """(epoch, file, row group, place after it) from ``start`` on: ``most`` of them, or up to ``end``, or to the last epoch's end; 0 epochs never end."""
        names, left = shards(self.folder, self.split), most
        if not names:
            return
        epoch, at, first = start["epoch"], start["file"], start["group"]
        while not self.epochs or epoch <= self.epochs:
            some = False
            for name in (n for n in names if n >= at):
                begin = first if name == at else 0
                for group in range(begin + (self.rank - begin) % self.world, self.groups(name), self.world):
                    some = True
                    here = (epoch, name, group)
                    if left == 0 or (end is not None and here >= (end["epoch"], end["file"], end["group"])):
                        return
                    left = None if left is None else left - 1
                    yield (*here, {"epoch": epoch, "file": name, "group": group + 1})
            if not some and (at, first) == ("", 0):
                return  # an epoch without a row group for this reader
            epoch, at, first = epoch + 1, "", 0

    def read(self, place: tuple[int, str, int], schema: StructType) -> Iterator[pa.RecordBatch]:
        epoch, name, group = place
        shape = to_arrow_schema(schema)
        own = [f.name for f in schema.fields if f.name not in {p.name for p in PLACE}]
        with self.store.open_input_file(self.file(name)) as f:
            for batch in pq.ParquetFile(f).iter_batches(4096, row_groups=[group], columns=own):
                known = {"file": pa.array([name] * batch.num_rows, pa.string()), "row_group": pa.array([group] * batch.num_rows, pa.int32()), "epoch": pa.array([epoch] * batch.num_rows, pa.int32())}
                yield pa.RecordBatch.from_arrays([known[c.name] if c.name in known else batch.column(c.name).cast(c.type) for c in shape], schema=shape)


class RowGroups(DataSource):
    """``format("row_groups")`` with options path, split, epochs, rank, world; ``start`` (a place as JSON) and ``most`` in batches, ``most`` and ``position`` in streams.

    One partition a row group.  In a stream ``most`` row groups make a batch, and ``position`` is a
    folder of the stream's own, beside its checkpoint, where the end of the last planned batch is
    kept: Spark's log says where a batch that was cut off ends, and this where the next one begins.
    """

    @classmethod
    def name(cls) -> str:
        return "row_groups"

    def schema(self) -> StructType:
        return Shards.of(self.options).schema()

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options, schema)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return _StreamReader(self.options, schema)


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType) -> None:
        self.shards, self.schema = Shards.of(options), schema
        self.start, most = json.loads(options.get("start", json.dumps(START))), options.get("most")
        self.most = None if most is None else int(most)
        if not self.shards.epochs and self.most is None:
            raise ValueError("endless epochs need a limit in a batch")

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(place[:3]) for place in self.shards.ahead(self.start, self.most)] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.value is not None:
            yield from self.shards.read(partition.value, self.schema)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, options: dict, schema: StructType) -> None:
        self.shards, self.schema, self.most = Shards.of(options), schema, int(options.get("most", 1))
        self.store, folder = _at(options["position"])
        self.store.create_dir(folder, recursive=True)
        self.kept = f"{folder}/planned.json"
        self.end = START
        if self.store.get_file_info(self.kept).type == fs.FileType.File:
            with self.store.open_input_stream(self.kept) as f:
                self.end = json.loads(f.read())

    def initialOffset(self) -> dict:  # noqa: N802
        return START

    def latestOffset(self) -> dict:  # noqa: N802
        after = self.end
        for *_, after in self.shards.ahead(self.end, self.most):
            pass
        return after

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        # a batch that Spark plans again after a loss ends where it ended before
        self.end = end
        temp = f"{self.kept}.{uuid.uuid4().hex}"
        with self.store.open_output_stream(temp) as f:
            f.write(json.dumps(end).encode())
        self.store.move(temp, self.kept)
        return [InputPartition(place[:3]) for place in self.shards.ahead(start, end=end)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        yield from self.shards.read(partition.value, self.schema)

    def commit(self, end: dict) -> None:
        pass


def read_row_groups(spark: SparkSession, folder: str, start: dict | None = None, most: int | None = None, **options: object) -> DataFrame:
    """Rows of shards from a place on, with file, row_group and epoch; ``resume_at`` tells the place after them."""
    spark.dataSource.register(RowGroups)
    given = {k: str(v) for k, v in options.items()} | ({"most": str(most)} if most is not None else {})
    return spark.read.format("row_groups").options(path=folder, start=json.dumps(start or START), **given).load()


def resume_at(folder: str, start: dict | None = None, most: int | None = None, **options: object) -> dict:
    """The place after what ``read_row_groups`` reads with the same arguments."""
    after = start or START
    for *_, after in Shards.of({"path": folder, **options}).ahead(after, most):
        pass
    return after


def stream_row_groups(spark: SparkSession, folder: str, position: str, most: int = 1, **options: object) -> DataFrame:
    """The same as a stream of ``most`` row groups a batch, which goes on after a stop with the next row group."""
    spark.dataSource.register(RowGroups)
    return spark.readStream.format("row_groups").options(path=folder, position=position, most=str(most), **{k: str(v) for k, v in options.items()}).load()
