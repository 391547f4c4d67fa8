"""Shards by row groups: places, sharing among readers, and streams that stop and go on."""

import json

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from stratum.sources import row_groups as rg


@pytest.fixture
def folder(tmp_path):
    at, n = tmp_path / "shards", 0
    at.mkdir()
    for k, groups in enumerate((3, 1, 4)):
        rows = pa.table({"id": list(range(n, n + 5 * groups)), "text": [f"t{i}" if i % 4 else None for i in range(n, n + 5 * groups)]})
        pq.write_table(rows, at / f"shard-{k}.parquet", row_group_size=5)
        n += 5 * groups
    return str(at)


def places(folder, start=rg.START, most=None, **options):
    return [p[:3] for p in rg.Shards(folder, **options).ahead(start, most)]


def test_places_go_on_within_a_file_and_an_epoch(folder):
    every = places(folder, epochs=2)
    assert len(every) == 16 and every[:4] == [(1, "shard-0.parquet", g) for g in range(3)] + [(1, "shard-1.parquet", 0)] and every[8][0] == 2
    start, got = rg.START, []
    for most in (2, 3, 1, 7, 5):
        got += places(folder, start, most, epochs=2)
        start = rg.resume_at(folder, start, most, epochs=2)
    assert got == every and places(folder, start, epochs=2) == []
    assert places(folder, split="train") + places(folder, split="val") == every[:8]
    shared = [places(folder, rank=r, world=3, epochs=2) for r in range(3)]
    assert sorted(p for own in shared for p in own) == sorted(every) and all(g % 3 == r for r, own in enumerate(shared) for *_, g in own)
    assert places(folder, rank=9, world=10, epochs=0) == []


def test_added_shards_come_after_the_place(folder):
    start = rg.resume_at(folder, most=4)
    pq.write_table(pa.table({"id": [99], "text": ["new"]}), f"{folder}/shard-1b.parquet")
    assert places(folder, start, 2) == [(1, "shard-1b.parquet", 0), (1, "shard-2.parquet", 0)]


def test_batches(spark, folder):
    df = rg.read_row_groups(spark, folder, epochs=2)
    assert df.columns == ["id", "text", "file", "row_group", "epoch"] and df.rdd.getNumPartitions() == 16
    rows = sorted((r["epoch"], r["id"], r["text"]) for r in df.collect())
    assert rows == [(e, i, f"t{i}" if i % 4 else None) for e in (1, 2) for i in range(40)]
    some = rg.read_row_groups(spark, folder, start={"epoch": 1, "file": "shard-2.parquet", "group": 2}, most=1).collect()
    assert [r["id"] for r in some] == list(range(30, 35)) and {r["row_group"] for r in some} == {2}


def run(spark, folder, base, batches, fail_at=None):
    """Runs a stream for some batches, or until one fails half way; rows seen go to ``done`` of the batch."""
    seen, count = [], 0

    def put(df, number):
        nonlocal count
        if count >= batches:
            raise KeyboardInterrupt
        count += 1
        rows = [(r["epoch"], r["id"]) for r in df.collect()]
        if fail_at == number:
            raise ValueError("lost")
        if rows:
            (base / "done" / f"{number}.json").write_text(json.dumps(rows))
        seen.append(number)

    stream = rg.stream_row_groups(spark, folder, str(base / "position"), most=3, epochs=2)
    q = stream.writeStream.foreachBatch(put).option("checkpointLocation", str(base / "checkpoint")).trigger(processingTime="0 seconds").start()
    try:
        while q.isActive and len(seen) < batches:
            q.awaitTermination(0.3)
    except Exception as e:  # noqa: BLE001
        assert "lost" in str(e)
    q.stop()
    return seen


def test_a_stopped_stream_goes_on_with_the_next_row_group(spark, folder, tmp_path):
    (tmp_path / "done").mkdir()
    run(spark, folder, tmp_path, 1)  # ends within a file
    assert len(json.loads((tmp_path / "done" / "0.json").read_text())) == 15
    run(spark, folder, tmp_path, 9, fail_at=2)  # a batch of both epochs is lost half way
    run(spark, folder, tmp_path, 4)
    got = [tuple(r) for f in sorted((tmp_path / "done").iterdir()) for r in json.loads(f.read_text())]
    assert sorted(got) == [(e, i) for e in (1, 2) for i in range(40)]
