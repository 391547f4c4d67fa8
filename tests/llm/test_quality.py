"""The quality classifier against a plain numpy version, and rows that are hard to handle."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stratum.llm import quality
from stratum.llm.common import Scratch
from stratum.llm.text import text_blocks

from .test_models_and_vectors import quality_rows

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sigmoid(x):
    return 1 / (1 + np.exp(-x))


def plain_posteriors(odds, sites):
    """Empirical Bayes by loops: posterior log-odds of each row from its evidence and its (host, path)."""
    out = np.zeros_like(odds)
    for h in range(2):
        p = sigmoid(odds[:, h])
        overall = min(max(p.mean(), 1e-4), 1 - 1e-4)

        def strength(shares, sizes, means):
            spread = sum(n * (s - m) ** 2 for s, n, m in zip(shares, sizes, means)) - sum(m * (1 - m) for m in means)
            between = max(spread / sum(sizes), 1e-6)
            return min(max(np.mean([m * (1 - m) for m in means]) / between - 1, 1.0), 1e6)

        hosts = {s[0] for s in sites}
        of_host = {g: [i for i, s in enumerate(sites) if s[0] == g] for g in hosts}
        k = strength([p[of_host[g]].mean() for g in hosts], [len(of_host[g]) for g in hosts], [overall] * len(hosts))
        host = {g: (p[of_host[g]].sum() + k * overall) / (len(of_host[g]) + k) for g in hosts}
        of_path = {g: [i for i, s in enumerate(sites) if s == g] for g in set(sites)}
        k = strength([p[v].mean() for v in of_path.values()], [len(v) for v in of_path.values()], [host[g[0]] for g in of_path])
        path = {g: min(max((p[v].sum() + k * host[g[0]]) / (len(v) + k), 1e-4), 1 - 1e-4) for g, v in of_path.items()}
        out[:, h] = [o + np.log(path[s] / (1 - path[s])) - np.log(overall / (1 - overall)) for o, s in zip(odds[:, h], sites)]
    return out


def test_posteriors_equal_plain_numpy(spark):
    rows, labels = quality_rows(300)
    rows = [(i, t, "fr" if i % 5 == 0 else lang, None if i % 11 == 0 else source, n) for i, t, lang, source, n in rows]
    docs, known = spark.createDataFrame(rows, SCHEMA).repartition(3), spark.createDataFrame(labels[:150], "doc_id long, quality int, toxic int")
    heads = quality.train_heads(docs, known)
    odds = np.concatenate([heads.log_odds(buf, offs) for _, buf, offs in text_blocks(pa.array([r[1] for r in rows]))])
    want = plain_posteriors(odds, [(r[3], r[2]) for r in rows])
    got = {r["row"]["doc_id"]: r for r in quality.judge(docs, known).collect()}
    for i, (q, t) in enumerate(want):
        assert abs(got[i]["p_quality"] - sigmoid(q)) < 1e-6 and abs(got[i]["p_toxic"] - sigmoid(t)) < 1e-6
        assert got[i]["kept"] == (q >= 0 and t < 0) or min(abs(q), abs(t)) < 1e-6


def test_clashing_names_long_texts_and_repeats(spark):
    rows, labels = quality_rows(200)
    long = " ".join(f"word{k % 200}" for k in range(300_000))
    rows += [(900, long, "en", "hot", 1), (901, None, None, None, None), (902, "", "en", "hot", 0), (3, "another text of the same id", "en", "hot", 1), rows[8], rows[8]]
    clash = ("add_q", "lq", "__lq", "a.b", "row", "host", "path", "p", "h", "id", "words", "kept", "p_quality")
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in clash})
    known = spark.createDataFrame([*labels, (5, 0, 1), (5, 1, 0), (None, 1, 0), (6, None, None)], "doc_id long, quality int, toxic int")
    got = quality.judge(docs, known)
    assert got.schema["row"].dataType.names == docs.columns and got.count() == len(rows)
    first, second = (sorted(tuple(map(str, r)) for r in quality.judge(d, k, columns=["doc_id"]).collect()) for d, k in ((docs, known), (docs.repartition(5), known.repartition(3))))
    assert [r[0] for r in first] == [r[0] for r in second]
    assert [[round(float(x), 9) for x in r[1:3]] for r in first] == [[round(float(x), 9) for x in r[1:3]] for r in second]
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, "")
    assert kept.columns == docs.columns and {"another text of the same id"} < {r["text"] for r in kept.where("doc_id = 3").collect()}


def test_labels_that_differ_count_as_the_worse(spark):
    docs = spark.createDataFrame([(i, "good words " * 5 + f"w{i}", "en", "a", 1) for i in range(20)], SCHEMA)
    one = spark.createDataFrame([*((i, 1, 0) for i in range(20)), *((i, 0, 1) for i in range(10))], "doc_id long, quality int, toxic int")
    two = spark.createDataFrame([(i, int(i >= 10), int(i < 10)) for i in range(20)], "doc_id long, quality int, toxic int")
    a, b = (quality.train_heads(docs, k) for k in (one, two))
    assert np.array_equal(a.dense, b.dense) and np.array_equal(a.bias, b.bias)


def test_host_and_path(spark):
    rows = spark.createDataFrame([("http://A.example.com/x/y?q",), ("https://b.org",), (None,)], "url string")
    host, path = quality.host_and_path(F.col("url"))
    assert [tuple(r) for r in rows.select(host, path).collect()] == [("a.example.com", "x"), ("b.org", ""), (None, None)]


@pytest.fixture
def tables(spark, tmp_path):
    rows, labels = quality_rows(240)
    docs = [*rows, (500, rows[2][1] + " more", "en", "hot", 1), (501, "mail a.b@c.example.com " + rows[3][1], "en", "hot", 1), (502, None, "en", None, None), (503, "", "en", "hot", 0)]
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_pipeline_stages_and_run(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    kept = corpus_pipeline.quality_stage(spark, docs, tables)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    bad = {i for i, q, t in quality_rows(240)[1] if q == 0 or t == 1}
    assert len(ids & bad) <= 4 and len({i for i in range(240)} - bad - ids) <= 2
    before = Scratch.live()
    got = corpus_pipeline.run(spark, tables)
    rows = got.collect()
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(got.columns) and {r["doc_id"] for r in rows} <= ids - {500}
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    Scratch.drop_all(spark, keep=before)
    assert Scratch.live() == before


def test_empty_tables_through_the_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, tables).count() == 0, name
