"""Streams: a resumable corpus reader, an append-only chat log and an idempotent synchronisation."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import ArrayType, StructField, StructType

from stratum.sources.keyed import KeyedTables


def corpus_stream(spark: SparkSession, folder: str, schema: StructType | str, files_a_batch: int = 1) -> DataFrame:
    """Shards as they appear; where a reader stopped is in its query's checkpoint, to the file."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).option("pathGlobFilter", "*.parquet").parquet(folder)


def append_log(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Write each row once, stamped with the time the server saw it."""
    stamped = stream.withColumn("created_at", F.current_timestamp())
    return stamped.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(folder)


def sync_stream(stream: DataFrame, tables: KeyedTables, name: str, checkpoint: str, writer: str = "stream") -> StreamingQuery:
    """Merge each batch into a keyed table: first_seen stays, last_seen moves on; a repeated batch changes nothing.

    A batch rewrites the buckets of its keys alone.
    """
    key = tables.keys[name]

    def put(batch: DataFrame, number: int) -> None:
        # of a batch's rows of a key the one last seen, ties by the other columns, so no row mixes two
        rest = [c for c in batch.columns if c not in key]
        lead = [c for c in ("last_seen", "first_seen") if c in rest]
        row = F.struct(*lead, *(c for c in rest if c not in lead))
        once = batch.groupBy(*key).agg(F.max(row).alias("r"), *([F.min("first_seen").alias("first")] if "first_seen" in rest else []))
        once = once.select(*(F.col("first").alias(c) if c == "first_seen" else F.col(c) if c in key else F.col(f"r.{c}").alias(c) for c in batch.columns))
        held = once.persist()
        try:
            tables.merge({name: held}, {name: [c for c in ("first_seen",) if c in rest]}, {name: [c for c in ("last_seen",) if c in rest]}, (writer, number))
        finally:
            held.unpersist()

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, time: str, key: str, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")


def running_turns(stream: DataFrame, by: str, order: str, text: str, most: int = 10, seconds: int = 30 * 24 * 3600) -> DataFrame:
    """(by, turns): of each session that a batch touches, its last ``most`` turns as they are then, blank ones left out after the cut.

    The same turns as ``serving.last_turns`` over all that came, however it was split into batches
    and whatever order it came in; a turn that comes again is the same turn.  State holds ``most`` turns
    of a session, as JSON (so columns are numbers, texts or booleans), and forgets a session that was
    quiet for ``seconds``.  Turns with a null session are left out.  Spark looks for quiet sessions in
    batches without data too, so a query that is to end (``availableNow``) needs
    ``spark.sql.streaming.noDataMicroBatches.enabled`` off when it starts.
    """
    turn = StructType([f for f in stream.schema.fields if f.name != by])
    names = turn.names
    at, said = names.index(order), names.index(text)
    rank = lambda t: (t[at] is not None, t[at] if t[at] is not None else 0, repr(t))

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        turns = {tuple(t) for t in json.loads(state.get[0])} if state.exists else set()
        for part in parts:
            new = part[names].astype(object).where(part[names].notna(), None)
            turns |= {tuple(v.item() if hasattr(v, "item") else v for v in t) for t in new.itertuples(index=False, name=None)}
            turns = set(sorted(turns, key=rank)[-most:])
        last = sorted(turns, key=rank)
        state.update((json.dumps(last),))
        state.setTimeoutDuration(seconds * 1000)
        shown = [dict(zip(names, t, strict=True)) for t in last if (t[said] or "").strip(" ")]
        yield pd.DataFrame({"session": [key[0]], "turns": [shown]})

    out = StructType([StructField("session", stream.schema[by].dataType), StructField("turns", ArrayType(turn))])
    kept = stream.where(F.col(by).isNotNull()).groupBy(by).applyInPandasWithState(update, out, "turns string", "update", GroupStateTimeout.ProcessingTimeTimeout)
    return kept.withColumnRenamed("session", by)
