"""Chunks, batches, vectors, sync, conversations, answers, packing and metrics."""

import math

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from stratum.operators import chunking, corpus, metrics, sync, vectors


def chunk_rows(data, lang, config):
    name, spans, first, last = chunking.chunk_columns(data, lang, config)
    return [(name, a, b, i, j, data[a:b]) for (a, b), i, j in zip(spans.tolist(), first.tolist(), last.tolist(), strict=True)]


def rows(df):
    return [tuple(r) for r in df.collect()]


@given(st.binary(max_size=400), st.integers(5, 60))
@settings(max_examples=60, deadline=None)
def test_chunks_cover_all_bytes(data, most):
    config = chunking.ChunkConfig(most, most // 4, most // 3)
    found = chunking.windows(chunking.line_breaks(data), config, 0, len(data))
    assert found == [] if not data else (found[0][0], found[-1][1]) == (0, len(data))
    for (a, b), (c, d) in zip(found, found[1:], strict=False):
        assert a < c <= b < d and b - a <= most and b - c <= most // 4


def test_chunks_end_after_line_breaks_and_count_bytes():
    data = "é\n".encode() * 10
    got = chunk_rows(data, None, chunking.ChunkConfig(8, 2, 3))
    assert got[-1][2] == 30 and got[0][:5] == ("naive", 0, 6, 1, 2)


def test_definitions_make_chunks(spark):
    code = b"import os\n\n\n@wrap\ndef f():\n    return 1\n\n\nclass A:\n    x = 1\n"
    got = chunk_rows(code, "python", chunking.ChunkConfig())
    assert [c[5].strip() for c in got] == [b"import os", b"@wrap\ndef f():\n    return 1", b"class A:\n    x = 1"]
    js = b"const a = 1;\nfunction f() { return '}'; }\nclass B { m() {} }\n"
    assert [c[5].strip() for c in chunk_rows(js, "javascript", chunking.ChunkConfig())] == [b"const a = 1;", b"function f() { return '}'; }", b"class B { m() {} }"]
    files = spark.createDataFrame([("r", "a.py", bytearray(code)), ("r", "e.py", bytearray())], "repo_slug string, path string, content binary")
    records, stats = chunking.index_files(files, "head")
    assert records.count() == 3 and rows(stats) == [(2, 1, 3, 3)]
    with pytest.raises(ValueError):
        chunking.index_files(files, "")


@pytest.mark.parametrize("bad", [(0, 0, 0), (10, 10, 0), (10, 0, 11), (10, -1, 0)])
def test_chunk_config_bounds(bad):
    with pytest.raises(ValueError):
        chunking.ChunkConfig(*bad)


def test_batches_close_before_they_exceed():
    assert chunking.fill_batches([3, 3, 3, 1, 1, 1, 1], 6, 3) == [0, 0, 1, 1, 1, 2, 2]
    with pytest.raises(ValueError):
        chunking.fill_batches([7], 6, 3)


def test_vector_store(spark):
    schema = "repo_slug string, head_commit string, file_path string, start_line int, end_line int, vector array<float>, seq int"
    new = lambda *r: spark.createDataFrame(list(r), schema)
    store = vectors.VectorStore(new(), 2)
    assert store.upsert(new(("a", "h", "f", 1, 2, [1.0, 0.0], 0), ("b", "h", "f", 1, 2, [0.0, 1.0], 1))) == 2
    assert store.upsert(new(("a", "h", "f", 1, 2, [1.0, 1.0], 0))) == 1
    got = rows(store.search([1.0, 1.0], 5).select("repo_slug", F.round("score", 6)))
    assert got == [("a", 1.0), ("b", 0.707107)]
    assert rows(store.search([1.0, 0.0], 5, repo_slug="b", file_path=None).select("repo_slug")) == [("b",)]
    assert rows(store.search([1.0, 0.0], 0)) == [] and store.delete_by_repo("a") == 1 and store.delete_by_repo("") == 0
    for bad in ([1.0], []):
        with pytest.raises(ValueError):
            store.search(bad, 1)
    one = spark.range(1)
    assert one.select(vectors.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))), vectors.vector_literal(F.array(F.lit(0.5), F.lit(2.0)))).first()[:] == (0.0, "[0.5,2]")


def test_payload_holds_no_names(spark):
    repos = spark.createDataFrame([("https://Host/Owner/Repo/", "s", "h", [("src/app.py", 3, "d")], ["/src/app.py"], "now")], "repo_url string, repo_slug string, head_commit string, hotspots array<struct<path:string,touch_count:int,last_touched:string>>, files array<string>, synced_at string")
    row = sync.payloads(repos, "t", "u", "salt").first()
    assert "app.py" not in str(row) and row["hotspot_metrics"][0]["file_hash"] == row["file_fingerprints"][0]["file_path_hash"]
    with pytest.raises(ValueError):
        sync.ensure_safe(spark.createDataFrame([], "a array<struct<author_email:string>>").schema)


def test_merge_keeps_first_seen(spark):
    old = spark.createDataFrame([("k", 1, 1, "a"), ("o", 1, 1, "b")], "k string, first_seen int, last_seen int, v string")
    new = spark.createDataFrame([("k", 5, 5, "c"), ("n", 5, 5, "d")], old.schema)
    assert sorted(rows(sync.merge(old, new, ["k"], ["first_seen"], ["last_seen"]))) == [("k", 1, 5, "c"), ("n", 5, 5, "d"), ("o", 1, 1, "b")]


def test_conversations(spark):
    turns = [(1, k, r, t) for k, (r, t) in enumerate([("system", "s"), ("user", "u"), ("assistant", "a")])] + [(2, 0, "user", "u"), (2, 1, "user", "x"), (3, 0, "user", "q"), (3, 1, "assistant", "")]
    conv = corpus.conversations(spark.createDataFrame(turns, "conv_id int, turn int, role string, text string"))
    assert sorted(rows(conv.select("conv_id", corpus.is_valid(F.col("messages"))))) == [(1, True), (2, False), (3, False)]
    merged = conv.where("conv_id = 1").select(corpus.merge_system(F.col("messages")).alias("m")).first()["m"]
    assert [tuple(m) for m in merged] == [("user", "s\n\nu"), ("assistant", "a")]
    parts = spark.createDataFrame([(1, [("user", [("text", "ab")]), ("assistant", [("text", "c"), ("python", "d"), ("python_output", "e")])])], "id int, messages array<struct<role:string,parts:array<struct<type:string,text:string>>>>")
    got = corpus.render_tokens(parts, "id", lambda t: [ord(c) for c in t], 2048, 1000).first()
    assert got["ids"] == [1000, 1001, 97, 98, 1002, 1003, 99, 1005, 100, 1006, 1007, 101, 1008, 1004]
    assert got["mask"] == [0, 0, 0, 0, 0, 0, 1, 1, 1, 1, 0, 0, 0, 1]


def test_answers(spark):
    one = spark.range(1)
    get = lambda *c: one.select(*c).first()[:]
    assert get(corpus.extract_answer(F.lit("x #### -1,234.5 y")), corpus.extract_answer(F.lit("none")), corpus.normalize_answer(F.lit(" 1_000,2 m\nz"))) == ("-1234.5", None, "10002")
    assert get(corpus.same_answer(F.lit(None), F.lit(None)), corpus.relative_reward(F.lit("90"), F.lit("100")), corpus.relative_reward(F.lit(None).cast("string"), F.lit("1"))) == (1, pytest.approx(0.9), 0.0)
    assert corpus.steps_right("<<1+1=2>> <<2*3=7>> <<bad>> <<10/4=2.5>>") == pytest.approx(0.1)
    assert corpus.calculator("'strawberry'.count('r')") == "3" and corpus.calculator("2**9") is None and corpus.calculator("1,000+1") == "1001"
    assert corpus.answer_parts("so <<1+1=2>>2") == [("text", "so "), ("python", "1+1"), ("python_output", "2"), ("text", "2")]
    assert corpus.chain_parts("a <gadget id='c'>1+1</gadget><output>2</output> b", "2") == [("text", "a"), ("python", "1+1"), ("python_output", "2"), ("text", "b"), ("text", "#### 2")]
    assert get(corpus.first_least(F.array(F.lit(2.0), F.lit(1.0), F.lit(1.0))), corpus.common_prefix(F.array(F.lit(1), F.lit(2)), F.array(F.lit(1), F.lit(2), F.lit(3))), corpus.common_prefix(F.array(F.lit(1), F.lit(2)), F.array(F.lit(1), F.lit(3)))) == (1, 2, 1)


@given(st.lists(st.integers(1, 30), max_size=60), st.booleans())
@settings(max_examples=60, deadline=None)
def test_best_fit_rows(sizes, crop):
    placed = corpus.pack_rows(sizes, 20, 8, crop)
    assert sorted(i for _, _, i, _ in placed) == list(range(len(sizes)))
    used = {}
    for row, offset, i, taken in placed:
        assert offset == used.get(row, 0) and taken <= sizes[i]
        assert crop or taken == min(20, sizes[i])
        used[row] = offset + taken
        assert used[row] <= 20
    full = [used[r] for r in sorted(used)][:-1]
    assert not crop or all(n == 20 for n in full)


def test_shards_leave_the_rest_out():
    assert corpus.assign_shards([5, 5, 5, 5, 5], 8, 2) == [0, 0, 1, 1, -1]


def test_metrics(spark):
    df = spark.createDataFrame([("p", 1, False), ("p", 2, True), ("q", 1, False), ("q", 2, False)], "id string, k int, ok boolean")
    assert sorted(rows(metrics.pass_at_k(df, "id", ["k"], "ok", 2))) == [(1, 0.0, 2), (2, 0.5, 2)]
    bpb = spark.createDataFrame([(2.0, 0, 1), (math.log(2), 1, 1), (9.0, 4, -1)], "loss double, size int, target int")
    assert rows(metrics.bits_per_byte(bpb, "loss", "size", "target")) == [(pytest.approx(1.0),)]
    assert rows(metrics.bits_per_byte(bpb.limit(0), "loss", "size")) == [(math.inf,)]
    curve = spark.createDataFrame([(float(x), 2.0 * (x - 3) ** 2 + 1) for x in range(7)], "x double, y double")
    got = metrics.parabola(curve, F.col("x"), F.col("y")).first()
    assert got["a"] == pytest.approx(2) and got["x_best"] == pytest.approx(3) and got["y_best"] == pytest.approx(1)
    acc = spark.createDataFrame([("a", True), ("a", False), ("b", True)], "task string, ok boolean")
    base = spark.createDataFrame([("a", 25.0), ("b", 0.0)], "task string, baseline double")
    assert rows(metrics.core_metric(acc, base, "task", "ok")[1]) == [(pytest.approx((1 / 3 + 1) / 2),)]
    assert rows(metrics.chat_metric(acc.groupBy("task").agg(F.avg(F.col("ok").cast("int")).alias("accuracy")), {"a": 0.25, "c": 0.0})) == [(None,)]
    lines = spark.createDataFrame([(0, "loss: 1,000"), (1, "loss: 900"), (2, "x")], "line_no int, value string")
    assert rows(metrics.last_values(lines, {"loss": r"loss: ([\d,]+)"})) == [("900",)] and rows(metrics.report_value(lines, "loss")) == [("900",)]
