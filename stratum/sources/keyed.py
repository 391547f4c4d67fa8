"""Keyed tables in hash buckets: a merge rewrites the buckets that it touches, and one manifest makes it count.

A folder holds ``data/<run>/<table>/__bucket=<n>`` and ``manifests/<number>.json``.  The manifest with the
highest number says which folder each bucket of each table is in, and which numbered batches have been
merged.  A run writes new folders and then its manifest, by a rename that fails if the number is taken:
a run that is cut off leaves the tables as they were, and one that is repeated finds its batch merged.
"""

from __future__ import annotations

import functools
import json
import operator
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from stratum.operators import sync
from stratum.sources.text import _at, exists, read_object


class KeyedTables:
    """Tables (name: key columns) under one manifest; the number of buckets is kept from the first merge on."""

    def __init__(self, spark: SparkSession, folder: str, keys: Mapping[str, Sequence[str]], buckets: int = 64, bucket_on: Mapping[str, Sequence[str]] | None = None) -> None:
        """``bucket_on``: of some tables, the key columns that buckets hang on, by which rows can be deleted together; all, if not given."""
        self.spark, self.folder, self.keys, self.buckets = spark, folder.rstrip("/"), {n: list(k) for n, k in keys.items()}, buckets
        self.on = self.keys | {n: list(k) for n, k in (bucket_on or {}).items()}

    def manifest(self) -> dict:
        """What counts now."""
        last = self._numbers()
        if not last:
            return {"number": 0, "buckets": self.buckets, "batches": {}, "schemas": {}, "paths": {}}
        return json.loads(read_object(self.spark, f"{self.folder}/manifests/{last[-1]:012d}.json"))

    def _numbers(self) -> list[int]:
        at, files = _at(self.spark, f"{self.folder}/manifests")
        if not files.exists(at):
            return []
        names = (f.getPath().getName() for f in files.listStatus(at))
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def read(self, name: str, buckets: Sequence[int] | None = None, manifest: dict | None = None) -> DataFrame | None:
        """A table, or some of its buckets; None before its first merge."""
        known = manifest or self.manifest()
        if name not in known["schemas"]:
            return None
        schema = StructType.fromJson(known["schemas"][name])
        paths = [f"{self.folder}/{p}" for b, p in known["paths"][name].items() if buckets is None or int(b) in set(buckets)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _bucket(self, name: str, buckets: int) -> Column:
        return F.pmod(F.hash(*self.on[name]), F.lit(buckets))

    def _commit(self, changes: Mapping[str, tuple[DataFrame, Callable[[DataFrame | None], DataFrame]]], batch: tuple[str, int] | None) -> bool:
        """Rewrite, of each table, the buckets in which the given keys fall, as the function makes them of the old ones."""
        known = self.manifest()
        if batch is not None and known["batches"].get(batch[0], -1) >= batch[1]:
            return False
        run, before = uuid.uuid4().hex, known["number"]
        for name, (rows, change) in changes.items():
            buckets = known["buckets"]
            if name in known["schemas"]:
                was = StructType.fromJson(known["schemas"][name])
                if any(was[k].dataType != rows.schema[k].dataType for k in self.on[name]):  # buckets hang on the keys' types
                    raise ValueError(f"the keys of {name} had other types")
            touched = sorted(r[0] for r in rows.select(self._bucket(name, buckets)).distinct().collect())  # as many numbers as there are buckets at most
            if not touched:
                continue
            new = change(self.read(name, touched, known))
            at = f"data/{run}/{name}"
            # Spark splits the buckets that are too much for a task
            new.withColumn("__bucket", self._bucket(name, buckets)).hint("rebalance", "__bucket").write.partitionBy("__bucket").parquet(f"{self.folder}/{at}")
            paths = known["paths"].setdefault(name, {})
            for b in touched:
                paths.pop(str(b), None)
                if exists(self.spark, f"{self.folder}/{at}/__bucket={b}"):
                    paths[str(b)] = f"{at}/__bucket={b}"
            known["schemas"][name] = new.schema.jsonValue()
        known |= {"number": before + 1} | ({"batches": known["batches"] | {batch[0]: batch[1]}} if batch is not None else {})
        self._put(known)
        return True

    def _put(self, manifest: dict) -> None:
        jvm = self.spark.sparkContext._jvm
        fs = jvm.org.apache.hadoop.fs
        temp, at = (_at(self.spark, f"{self.folder}/manifests/{n}")[0] for n in (f".{uuid.uuid4().hex}", f"{manifest['number']:012d}.json"))
        files = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        out = files.create(temp, True)
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()
        whole = files.makeQualified(at)
        if files.exists(at):
            files.delete(temp, False)
            raise RuntimeError(f"manifest {manifest['number']} is there already: another run was faster")
        fs.FileContext.getFileContext(whole.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(files.makeQualified(temp), whole, self.spark.sparkContext._gateway.new_array(fs.Options.Rename, 0))

    def merge(self, changes: Mapping[str, DataFrame], keep_first: Mapping[str, Sequence[str]] | None = None, keep_last: Mapping[str, Sequence[str]] | None = None, batch: tuple[str, int] | None = None) -> bool:
        """Upsert rows (unique by key) of some tables, all or none; False if the (writer, number) ``batch`` was merged before.

        Columns of ``keep_first`` stay as first written, those of ``keep_last`` take the larger.
        """
        first, last = keep_first or {}, keep_last or {}

        def one(name: str, rows: DataFrame) -> tuple[DataFrame, Callable]:
            return rows, lambda old: rows if old is None else sync.merge(old, rows, self.keys[name], first.get(name, ()), last.get(name, ()))

        return self._commit({name: one(name, rows) for name, rows in changes.items()}, batch)

    def delete(self, name: str, keys: DataFrame, batch: tuple[str, int] | None = None) -> int:
        """Take out the rows of the given keys, or of the given part of a key that buckets hang on; how many went."""
        known = self.manifest()
        if name not in known["schemas"]:
            return 0
        by = [c for c in self.keys[name] if c in keys.columns]
        if not set(self.on[name]) <= set(by):
            raise ValueError(f"rows of {name} are found by {', '.join(self.on[name])}")
        keys = keys.select(*by).distinct()
        gone = 0

        def rest(old: DataFrame) -> DataFrame:
            nonlocal gone
            same = functools.reduce(operator.and_, (F.col(f"o.{c}").eqNullSafe(F.col(f"k.{c}")) for c in by))
            gone = old.alias("o").join(keys.alias("k"), same, "left_semi").count()
            return old.alias("o").join(keys.alias("k"), same, "left_anti")

        return gone if self._commit({name: (keys, rest)}, batch) else 0

    def vacuum(self, keep: int = 2) -> int:
        """Drop all but the last ``keep`` manifests, and the folders that none of these names; how many folders went."""
        numbers = self._numbers()
        used = set()
        for n in numbers[-keep:]:
            known = json.loads(read_object(self.spark, f"{self.folder}/manifests/{n:012d}.json"))
            used |= {p.split("/")[1] for paths in known["paths"].values() for p in paths.values()}
        at, files = _at(self.spark, f"{self.folder}/data")
        gone = [f.getPath() for f in files.listStatus(at) if f.getPath().getName() not in used] if files.exists(at) else []
        for n in numbers[:-keep]:
            files.delete(_at(self.spark, f"{self.folder}/manifests/{n:012d}.json")[0], False)
        for path in gone:
            files.delete(path, True)
        return len(gone)


def synced_tables(spark: SparkSession, folder: str, buckets: int = 64) -> KeyedTables:
    """The tables of a synchronised state, empty or as they are in a folder."""
    return KeyedTables(spark, folder, {name: key for name, (key, _) in sync.STATE.items()} | {"sync_runs": ("sync_run_id",)}, buckets)


def sync_payloads(tables: KeyedTables, sent: DataFrame, batch: tuple[str, int] | None = None, run_id: Column | None = None) -> bool:
    """Put redacted payloads into the tables, all or none of them."""
    rows = sync.payload_rows(sent, run_id)
    stay = {name: [c for c in rows[name].columns if c not in key] if first is None else first for name, (key, first) in sync.STATE.items()}
    stay["sync_runs"] = [c for c in rows["sync_runs"].columns if c != "sync_run_id"]
    return tables.merge(rows, keep_first=stay, batch=batch)
