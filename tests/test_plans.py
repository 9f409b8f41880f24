"""Plan assertions: no row-at-a-time Python UDF, no
Cartesian product, nested-loop joins only against bounded dimensions, partial
limits before the top-k shuffle, and column pruning at the scan."""

import pytest

import __spark_entry__ as E

# Keys whose nested-loop join has a fixed-size build side: the 21-row dataset
# catalog, curriculum stages, mix-source weights (one row per source) or a
# one-row total attached to every row.
BOUNDED_NESTED_LOOP = {"manifest_check", "tokenize_corpus", "catalog_list", "catalog_lookup", "curriculum_at_step", "curriculum_lr", "curriculum_table",
                       "curriculum_token_plan", "gram_matrix", "mix_fetch", "mix_report", "mix_sample",
                       "mix_weights", "stage_range_join"}
STREAMING = {k for k in E.queries() if k.startswith("stream_") and k != "stream_sequences"}
KEYS = sorted(k for k in E.queries() if k not in STREAMING)


def _plan(spark, key):
    from tests.conftest import SMALL
    return E.queries()[key](spark, SMALL)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", KEYS)
def test_plan_shape(spark, key):
    plan = _plan(spark, key)
    assert "BatchEvalPython" not in plan
    assert "CartesianProduct" not in plan
    if "BroadcastNestedLoopJoin" in plan:
        assert key in BOUNDED_NESTED_LOOP, key


def test_topk_has_partial_limit(spark):
    plan = _plan(spark, "lexical_search")
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_scan_prunes_columns(spark):
    plan = _plan(spark, "request_metrics")
    assert "ReadSchema: struct<event_type:string,value:double>" in plan
