"""Operators that SQL can't express, against plain Python versions."""

import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from stratum.operators import chunking, corpus, metrics, serving, sync
from stratum.plans import registry
from stratum.sources import keyed
from stratum.streaming import streams

DATA = "/root/testdata/sf0.001"


def plain_chunks(data, size=1200, back=120, least=300):
    """Byte by byte: a window of ``size``, shortened to behind the last line break that leaves ``least`` bytes before it."""
    out, at = [], 0
    while at < len(data):
        end = min(at + size, len(data))
        if end < len(data):
            for i in range(end - 1, at + least - 1, -1):
                if data[i] == 10:
                    end = i + 1
                    break
        out.append((at, end, data[:at].count(b"\n") + 1, data[: max(at, end - 1)].count(b"\n") + 1))
        if end == len(data):
            break
        at = max(end - back, at + 1)
    return out


def test_chunk_naive(spark):
    got = {}
    for r in registry.chunk_naive(spark, DATA).collect():
        got.setdefault(r["file_path"], []).append((r["start_byte"], r["end_byte"], r["start_line"], r["end_line"]))
    texts = {f"docs/{r['doc_id']}.txt": (r["text"] or "").encode() for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert {k: sorted(v) for k, v in got.items()} == {k: plain_chunks(v) for k, v in texts.items() if v}
    stats = registry.chunk_stats(spark, DATA).first()
    assert (stats["files_seen"], stats["chunks_created"]) == (len(texts), sum(map(len, got.values())))


@given(st.text(alphabet="ab\n", max_size=80), st.integers(1, 12), st.integers(0, 11), st.integers(0, 12))
@settings(max_examples=300, deadline=None)
def test_windows(text, size, back, least):
    if back >= size or least > size:
        return
    data = text.encode()
    got = chunking.windows(chunking.line_breaks(data), chunking.ChunkConfig(size, back, least), 0, len(data))
    assert got == [(a, b) for a, b, *_ in plain_chunks(data, size, back, least)]


def test_prompt_budget(spark):
    rows = registry.queries()["prompt_budget"](spark, DATA).toPandas()
    items = registry.doc_names(spark, DATA).select("source", F.concat("path", F.lit("#"), F.col("doc_id").cast("string")).alias("path"), "text").toPandas()
    rank = lambda p: next((k for k, x in enumerate(serving.PREFERRED) if pd.Series([p]).str.contains(x.replace("(?i)", ""), case=False, regex=True)[0]), 100)
    for source, own in items.groupby("source"):
        left, want = 16_000, []
        for path, text in sorted(zip(own["path"], own["text"], strict=True), key=lambda x: (rank(x[0]), x[0])):
            if left > 0:
                limit = min(4_000, left)
                shown = text if len(text) <= limit else text[:limit].rstrip() + "\n...[truncated]"
                want.append((path, shown))
                left -= len(shown)
        got = rows[rows["source"] == source].sort_values("place")
        assert list(zip(got["path"], got["excerpt"], strict=True)) == want


def test_ridge_fit(spark):
    rows = spark.read.parquet(f"{DATA}/lineitem.parquet").toPandas()
    mean = rows.groupby(["l_returnflag", "l_suppkey"])[["l_quantity", "l_discount", "l_tax", "l_extendedprice"]].mean().reset_index()
    for r in registry.ridge_fit(spark, DATA).collect():
        own = mean[mean["l_returnflag"] == r["l_returnflag"]]
        x, y = own[["l_quantity", "l_discount", "l_tax"]].to_numpy(), own["l_extendedprice"].to_numpy()
        a = np.column_stack([np.ones(len(x)), x])
        w = np.linalg.solve(a.T @ a + np.diag([0, 1, 1, 1]), a.T @ y)
        rest, spread = ((y - a @ w) ** 2).sum(), ((y - y.mean()) ** 2).sum()
        assert np.allclose([r["intercept"], *r["weights"]], w, rtol=1e-6) and abs(r["r2"] - (1 - rest / spread)) < 1e-8


def plain_packing(sizes, capacity, buffer, crop):
    """The packer by its rule: (documents and how much of each) a row."""
    queue, rows, row, used = list(enumerate(sizes)), [], [], 0
    while queue:
        seen = queue[:buffer]
        fits = [x for x in seen if x[1] <= capacity - used]
        if fits:
            pick = max(fits, key=lambda x: x[1])
            n = pick[1]
        elif crop or not used:
            pick = min(seen, key=lambda x: x[1])
            n = capacity - used
        else:
            rows.append(row)
            row, used = [], 0
            continue
        queue.remove(pick)
        row.append((pick[0], n))
        used += n
        if used == capacity:
            rows.append(row)
            row, used = [], 0
    return [*rows, row] if row else rows


@pytest.mark.parametrize("crop", [True, False])
def test_packers(spark, crop):
    sizes = spark.read.parquet(f"{DATA}/documents.parquet").select("source", "doc_id", "n_chars").toPandas()
    query = registry.pack_bestfit_crop if crop else registry.pack_bestfit_pad
    got = {}
    for r in query(spark, DATA).collect():
        got.setdefault(r["source"], {}).setdefault(r["row"], []).append((r["offset"], r["doc"], r["taken"]))
    for source, own in sizes.sort_values("doc_id").groupby("source"):
        ids = own["doc_id"].tolist()
        want = plain_packing(own["n_chars"].tolist(), 2049, 1000 if crop else 100, crop)
        assert [[(d, t) for _, d, t in sorted(got[source][k])] for k in sorted(got[source])] == [[(ids[i], n) for i, n in row] for row in want]


@pytest.mark.parametrize("text,value", [("2**3", 8), ("-2**2", -4), ("2**-1", 0.5), ("2**3**2", 512), ("7//2*2+7%4", 9), ("(1+2)*-3", -9), ("1.5e2/3", 50), (" 4 - -1 ", 5), ("2*(3", None), ("a+1", None), ("9**99999", None), ("1 2", None), ("", None), ("__import__", None)])
def test_arithmetic(text, value):
    if value is None:
        with pytest.raises((ValueError, IndexError)):
            corpus.arithmetic(text)
    else:
        assert corpus.arithmetic(text) == value
    assert corpus.steps_right("<<2**3=8>>") == 0.05 and corpus.calculator("2**3") is None and corpus.calculator("1,000/8") == "125.0"


@pytest.mark.parametrize("rows,shots", [(50, 7), (5, 9), (2, 1), (1, 3)])
def test_few_shot_draws_come_from_all_other_rows(spark, rows, shots):
    got = {}
    for r in corpus.few_shot_pool(spark.range(rows).withColumnRenamed("id", "i"), "i", shots).collect():
        got.setdefault(r["i"], []).append(r["shot"])
    most = min(shots, rows - 1)
    assert all(len(set(v)) == len(v) == most and i not in v and set(v) <= set(range(rows)) for i, v in got.items()) and len(got) == (rows if most else 0)
    if rows == 50:
        assert len({x for v in got.values() for x in v}) == 50


def test_smoothing_of_a_long_series(spark):
    rnd = random.Random(1)
    values = [rnd.uniform(-5, 5) for _ in range(3000)]
    rows = spark.createDataFrame([("a", k, x) for k, x in enumerate(values)] + [("b", 1, 2.0)], "u string, k int, x double").repartition(3)
    got = {(r["u"], r["k"]): r["ema"] for r in metrics.smoothed(rows, "u", "k", "x").collect()}
    m = 0.0
    for k, x in enumerate(values):
        m = 0.9 * m + 0.1 * x
        assert abs(got["a", k] - m / (1 - 0.9 ** (k + 1))) < 1e-9
    assert abs(got["b", 1] - 2.0) < 1e-12


def test_payloads_applied_twice_change_nothing(spark):
    repos = spark.createDataFrame([("u/a", "", "h1", "t1", 5), ("u/a", "", "h1", "t2", 9), ("u/b", "", "h2", "t1", 1)], "repo_url string, repo_slug string, head_commit string, synced_at string, n int")
    repos = repos.withColumn("hotspots", F.array(F.struct(F.lit("x.py").alias("path"), F.col("n").alias("touch_count"), F.lit("d").alias("last_touched")))).withColumn("files", F.array(F.lit("x.py")))
    sent = sync.payloads(repos, "tenant", "user", "salt")
    once = sync.apply_payloads({}, sent)
    twice = sync.apply_payloads(once, sent)
    show = lambda state: {k: sorted(map(str, v.collect())) for k, v in state.items()}
    assert show(once) == show(twice)
    versions = {r["head_commit"]: (r["first_seen_at"], r["last_seen_at"]) for r in once["versions"].collect()}
    assert versions == {"h1": ("t1", "t2"), "h2": ("t1", "t1")}
    assert sorted(r["touch_count"] for r in once["version_hotspots"].collect()) == [1, 9] and once["sync_runs"].count() == 3 and once["tenants"].count() == 1
    late = sync.apply_payloads(once, sync.payloads(repos.where("n = 1").withColumn("synced_at", F.lit("t9")), "tenant", "user", "salt"))
    assert {r["head_commit"]: (r["first_seen_at"], r["last_seen_at"]) for r in late["versions"].collect()}["h2"] == ("t1", "t9")
    assert sync.enabled(" Yes ") and not sync.enabled(None) and not sync.enabled("0")


def test_a_streamed_batch_keeps_whole_rows(spark, tmp_path):
    schema = "k int, a string, b string, first_seen string, last_seen string"
    spark.createDataFrame([(1, "z", "old", "2", "3"), (1, "a", "new", "4", "5"), (2, "q", "r", "1", "1")], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    tables = keyed.KeyedTables(spark, str(tmp_path / "out"), {"t": ["k"]}, 2)
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    streams.sync_stream(stream, tables, "t", str(tmp_path / "cp")).awaitTermination()
    assert sorted(map(tuple, tables.read("t").collect())) == [(1, "a", "new", "2", "5"), (2, "q", "r", "1", "1")]


def test_fits_leave_out_rows_with_nulls(spark):
    draw = random.Random(5)
    data = [("a", draw.random(), draw.random(), draw.random()) for _ in range(30)]
    holes = [("a", None, 1.0, 9.0), ("a", 1.0, 2.0, None), ("b", None, None, None)]
    schema = "k string, x double, y double, t double"
    whole, with_holes = spark.createDataFrame(data, schema), spark.createDataFrame(data + holes, schema)
    for fit in (lambda d: metrics.ridge(d, "k", ["x", "y"], "t"), lambda d: metrics.parabola(d, F.col("x"), F.col("t"), ["k"])):
        (a,), (b,) = fit(whole).collect(), fit(with_holes).collect()
        flat = lambda r: [v for c in r[1:] for v in (c if isinstance(c, list) else [c])]
        assert a["k"] == b["k"] and np.allclose(flat(a), flat(b))
