"""Registered queries over whole tables, against counts made without the operators."""

from collections import Counter
from itertools import combinations

import pytest

from stratum.operators import gold
from stratum.plans import registry

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def pairs(spark):
    """Pairs of parts in two orders or more, of all orders of at most 50 parts."""
    files = {}
    for order, part in spark.read.parquet(f"{DATA}/lineitem.parquet").select("l_orderkey", "l_partkey").collect():
        files.setdefault(order, set()).add(f"part/{part}")
    assert max(map(len, files.values())) > 8
    counts = Counter(p for own in files.values() if len(own) <= gold.MAX_FILES_PER_COMMIT for p in combinations(sorted(own), 2))
    return {p: n for p, n in counts.items() if n >= 2}


def test_co_changes_keep_orders_of_up_to_50_parts(spark, pairs):
    got = {(r["file_a"], r["file_b"]): r["co_change_count"] for r in registry.co_change_pairs(spark, DATA).collect()}
    assert got == pairs


def test_degrees_and_risk_count_these_pairs(spark, pairs):
    degrees = Counter(f for p in pairs for f in p)
    assert {r["path"]: r["co_change_degree"] for r in registry.coupling_degree(spark, DATA).collect()} == degrees
    rows = registry.risk_levels(spark, DATA).collect()
    assert rows and all(r["co_change_degree"] == degrees[r["path"]] for r in rows)


def test_every_document_has_a_language_row(spark):
    ids = sorted(r["doc_id"] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id").collect())
    assert sorted(r["doc_id"] for r in registry.file_language(spark, DATA).select("doc_id").collect()) == ids


def test_the_grid_covers_all_customers(spark):
    runs = {tuple(r) for r in spark.read.parquet(f"{DATA}/orders.parquet").select("o_orderpriority", "o_custkey").collect()}
    want = sorted((p, c) for p in {p for p, _ in runs} for c in {c for _, c in runs} if (p, c) not in runs)
    assert sorted(tuple(r) for r in registry.sweep_grid(spark, DATA).collect()) == want
