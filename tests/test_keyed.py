"""Keyed tables in buckets: what a merge rewrites, repeated and cut-off runs, deletion, and the synchronised state."""

import pytest
from pyspark.sql import functions as F

from stratum.operators import sync
from stratum.sources import keyed

SCHEMA = "k long, part string, first_seen int, last_seen int, note string"


def rows(spark, *data):
    return spark.createDataFrame(list(data), SCHEMA)


def content(tables, name="t"):
    return sorted(map(tuple, tables.read(name).collect()), key=str)


@pytest.fixture
def tables(spark, tmp_path):
    out = keyed.KeyedTables(spark, f"file://{tmp_path}/t", {"t": ["k", "part"], "other": ["k"]}, 8)
    assert out.read("t") is None
    assert out.merge({"t": rows(spark, *((i, "a" if i % 2 else None, 1, 1, f"n{i}") for i in range(40)))}, batch=("w", 0))
    return out


def test_one_key_rewrites_one_bucket(spark, tables):
    before = tables.manifest()["paths"]["t"]
    assert len(before) == 8
    one = rows(spark, (7, "a", 5, 5, "new"))
    assert tables.merge({"t": one}, {"t": ["first_seen"]}, {"t": ["last_seen"]}, ("w", 1))
    after = tables.manifest()["paths"]["t"]
    assert sum(before[b] != after[b] for b in before) == 1 and before.keys() == after.keys()
    assert content(tables) == sorted([(7, "a", 1, 5, "new"), *((i, "a" if i % 2 else None, 1, 1, f"n{i}") for i in range(40) if i != 7)], key=str)


def test_a_repeated_batch_is_no_change(spark, tables):
    number, was = tables.manifest()["number"], content(tables)
    assert not tables.merge({"t": rows(spark, (7, "a", 9, 9, "again"))}, batch=("w", 0))
    assert tables.manifest()["number"] == number and content(tables) == was
    assert tables.merge({"t": rows(spark, (7, "a", 9, 9, "another writer"))}, batch=("v", 0))


def test_a_run_cut_off_half_way_changes_nothing(spark, tables, monkeypatch):
    was = content(tables)

    def lost(_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(tables, "_put", lost)
        with pytest.raises(OSError):
            tables.merge({"t": rows(spark, (1, "a", 9, 9, "x")), "other": rows(spark, (1, "a", 9, 9, "x"))}, batch=("w", 1))
    assert content(tables) == was and tables.read("other") is None
    assert tables.vacuum() == 1 and content(tables) == was
    assert tables.merge({"t": rows(spark, (1, "a", 9, 9, "x")), "other": rows(spark, (1, "a", 9, 9, "x"))}, batch=("w", 1))
    assert (1, "a", 9, 9, "x") in content(tables) and content(tables, "other") == [(1, "a", 9, 9, "x")]


def test_two_runs_at_once_dont_mix(spark, tables, monkeypatch):
    other = keyed.KeyedTables(spark, tables.folder, tables.keys, 8)
    seen = other.manifest()
    tables.merge({"t": rows(spark, (1, "a", 9, 9, "first"))})
    monkeypatch.setattr(other, "manifest", lambda: seen)
    with pytest.raises(RuntimeError, match="faster"):
        other.merge({"t": rows(spark, (2, None, 9, 9, "second"))})
    assert (1, "a", 9, 9, "first") in content(tables) and (2, None, 1, 1, "n2") in content(tables)


def test_delete_and_empty_changes(spark, tables):
    assert tables.delete("t", rows(spark, (7, "a", 0, 0, ""), (99, "a", 0, 0, ""), (8, None, 0, 0, ""))) == 2
    assert len(content(tables)) == 38
    assert tables.merge({"t": rows(spark)}) and len(content(tables)) == 38 and not tables.delete("none", rows(spark))
    every = tables.read("t").where("part = 'a'")
    assert tables.delete("t", every) == 19
    assert {r[1] for r in content(tables)} == {None}
    with pytest.raises(ValueError, match="other types"):
        tables.merge({"t": rows(spark, (1, "a", 1, 1, "")).withColumn("k", F.col("k").cast("int"))})


def test_a_chat_is_deleted_whole(spark, tmp_path):
    """All rows of a part of the key, which buckets hang on."""
    chats = keyed.KeyedTables(spark, str(tmp_path / "c"), {"chats": ["access_key", "repo_slug", "id"]}, 4, {"chats": ["access_key", "repo_slug"]})
    said = spark.range(30).selectExpr("'k' || (id % 3) as access_key", "'r' || (id % 2) as repo_slug", "id", "'m' as message")
    chats.merge({"chats": said})
    before = chats.manifest()["paths"]["chats"]
    one = spark.createDataFrame([("k1", "r0")], "access_key string, repo_slug string")
    assert chats.delete("chats", one) == 5 and chats.delete("chats", one) == 0
    after = chats.manifest()["paths"]["chats"]
    assert sum(before.get(b) != after.get(b) for b in before) == 1
    assert sorted(r["id"] for r in chats.read("chats").collect()) == [i for i in range(30) if not (i % 3 == 1 and i % 2 == 0)]
    with pytest.raises(ValueError, match="found by"):
        chats.delete("chats", one.select("access_key"))


def test_synchronised_state(spark, tmp_path):
    """The same rows as the tables held as frames, whatever is sent again."""
    repos = spark.range(6).selectExpr("'https://h/r' || (id % 3) as repo_url", "'r' as repo_slug", "'c' || (id div 3) as head_commit", "'t' || id as synced_at", "array(struct('p' || id as path, cast(id as int) as touch_count, '2026' as last_touched)) as hotspots", "array('f' || id) as files")
    sent = sync.payloads(repos, "tenant", "user", "salt")
    tables = keyed.synced_tables(spark, str(tmp_path / "state"), 4)
    state = {}
    for n, part in enumerate((sent.where("head_commit = 'c0'"), sent.where("head_commit = 'c1'"))):
        assert keyed.sync_payloads(tables, part, ("job", n))
        assert not keyed.sync_payloads(tables, part, ("job", n))
        state = sync.apply_payloads(state, part)
    assert keyed.sync_payloads(tables, sent.where("head_commit = 'c1'"))
    for name, df in state.items():
        assert sorted(map(str, tables.read(name).select(df.columns).collect())) == sorted(map(str, df.collect())), name
