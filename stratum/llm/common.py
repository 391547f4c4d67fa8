"""Shared plumbing of the corpus operators: scratch tables, code shipping, counted broadcasts."""

from __future__ import annotations

import atexit
import contextlib
import gc
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Rows up to which a side whose rows were counted may be broadcast.
BROADCAST_ROWS = 200_000
TABLES = ("documents", "embeddings", "pages", "labels", "benchmark", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; only a session on one machine may go without and use a local one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        set_at = spark.sparkContext._jsc.sc().getCheckpointDir()
        if set_at.isDefined():
            return set_at.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="stratum-")
        spark.sparkContext.setCheckpointDir(at)
    return at


def ship(spark: SparkSession) -> None:
    """Let executors import this package, however the driver found it."""
    sc = spark.sparkContext
    if getattr(sc, "_stratum_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    at = Path(tempfile.mkdtemp(prefix="stratum-")) / "stratum_code.zip"
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    sc.addPyFile(str(at))
    sc._stratum_shipped = True


class Scratch:
    """Tables in the shared folder that cut lineage; one folder for each run of an operator.

    An operator's result reads from its tables, so they outlive it: whoever has written or consumed
    the result drops them with ``Scratch.drop_all``; a session that ends drops what is left.
    """

    _live: dict[str, Scratch] = {}

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.at = spark, f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        if not Scratch._live:
            atexit.register(Scratch._at_exit, spark)
        Scratch._live[self.at] = self

    @staticmethod
    def _at_exit(spark: SparkSession) -> None:
        with contextlib.suppress(Exception):  # the session may be gone already
            Scratch.drop_all(spark)

    @staticmethod
    def live() -> set[str]:
        """Folders not yet dropped."""
        return set(Scratch._live)

    @staticmethod
    def drop_all(spark: SparkSession, keep: set[str] = frozenset()) -> None:
        """Drop all folders but those to ``keep``."""
        for at, scratch in list(Scratch._live.items()):
            if at not in keep and scratch.spark is spark and spark.sparkContext._jsc is not None:
                scratch.drop()

    def path(self, name: str) -> str:
        return f"{self.at}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str = "") -> None:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.at)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        if not name:
            Scratch._live.pop(self.at, None)


def small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast ``df`` if its counted ``rows`` are within the bound; else leave the join to Spark."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that no one holds any more, at once rather than at its next collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def local_path(url: str) -> str | None:
    if url.startswith("file:"):
        return "/" + url[5:].lstrip("/")
    return url if url.startswith("/") else None


def write_bytes(url: str, data: bytes) -> None:
    """Put a whole file in the shared folder: a temporary name, then a rename, so a retry is safe."""
    if (path := local_path(url)) is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        temp = f"{path}.{uuid.uuid4().hex}.tmp"
        with open(temp, "wb") as f:
            f.write(data)
        os.replace(temp, path)
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(url)
    with store.open_output_stream(path) as f:
        f.write(data)


def read_bytes(url: str) -> bytes:
    if (path := local_path(url)) is not None:
        with open(path, "rb") as f:
            return f.read()
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(url)
    with store.open_input_file(path) as f:
        return f.read()


class Slice:
    """Ranged reads of one file in the shared folder."""

    def __init__(self, url: str) -> None:
        if (path := local_path(url)) is not None:
            self.file = open(path, "rb")  # noqa: SIM115
            self.size = os.fstat(self.file.fileno()).st_size
        else:
            from pyarrow import fs

            store, path = fs.FileSystem.from_uri(url)
            self.file = store.open_input_file(path)
            self.size = self.file.size()

    def read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def close(self) -> None:
        self.file.close()
