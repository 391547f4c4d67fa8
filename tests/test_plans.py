"""Plans: top-k without a full sort, pruned scans, no Python where native expressions do, and all queries run."""

import contextlib
import io
import re

import pytest

import __spark_entry__
from stratum.plans import registry

DATA = "/root/testdata/sf0.001"


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("name", ["hotspots_topn", "start_here", "vector_topk", "preset_versions"])
def test_top_k_is_taken_in_order(spark, name):
    assert "TakeOrderedAndProject" in plan(registry.QUERIES[name](spark, DATA))


def test_co_changes_need_no_join_beyond_the_touches(spark):
    text = plan(registry.co_change_pairs(spark, DATA))
    assert "Generate" in text and text.count("Join") <= 4 and "Python" not in text and "Pandas" not in text


@pytest.mark.parametrize("name", ["hotspots_topn", "authorship_top3", "co_change_pairs", "risk_levels"])
def test_headline_queries_aggregate_by_hash(spark, name):
    text = plan(registry.QUERIES[name](spark, DATA))
    assert "HashAggregate" in text and "SortAggregate" not in text and "Cartesian" not in text


def test_a_slice_needs_no_window_over_all_rows(spark):
    text = plan(registry.slice_step(spark, DATA))
    # one window over the blocks' counts, one within a block
    assert text.count("Window [") <= 2 * text.count("__block") and "__block" in text


def test_scans_read_only_what_is_used(spark):
    text = plan(registry.delete_by_key(spark, DATA))
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderpriority:string>" in text and "1-URGENT" in text


PYTHON_NODE = re.compile(r"EvalPython|InPandas|InArrow")
PYTHON = {"chunk_naive", "chunk_stats", "batch_budget", "prompt_budget", "shard_assign", "pack_bestfit_crop", "pack_bestfit_pad", "ridge_fit", "step_bonus", "import_edges", "imports_map", "answer_parts", "chain_parts", "tokenizer_round_trip", "tool_calls", "code_chunks", "code_imports", "chunk_spans"}


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_queries_run_and_are_native(spark, name):
    df = registry.QUERIES[name](spark, DATA)
    assert df.columns and (name in PYTHON) == bool(PYTHON_NODE.search(plan(df)))
    df.write.format("noop").mode("overwrite").save()


def test_entry_point(spark):
    assert __spark_entry__.entry(spark).count() == 200
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
