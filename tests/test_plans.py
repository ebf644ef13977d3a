"""Plan checks: no Python evaluation in core plans, no unpartitioned window in dedup, pushdown reaches the scan."""

import pytest

from conftest import SF_SMALL


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["AG-1", "AG-3", "ST-2", "AU-6", "SC-12", "AG-4", "WN-1", "JN-4"])
def test_no_python_in_core_plans(spark, name):
    from __spark_entry__ import queries
    p = plan_of(queries()[name](spark, SF_SMALL))
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p


def test_dedup_has_no_window_and_is_partial_aggregate(spark):
    from __spark_entry__ import queries
    df = queries()["AG-1"](spark, SF_SMALL)
    df.collect()
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in p


def test_scan_prunes_columns(spark):
    from __spark_entry__ import queries
    df = queries()["SC-2"](spark, SF_SMALL)
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "lang" not in p and "n_chars" not in p


def _final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_ledger_and_windows_reuse_their_exchange(spark):
    from __spark_entry__ import queries
    for name in ("AG-2", "ST-3"):
        p = _final_plan(queries()[name](spark, SF_SMALL))
        assert "ReusedExchange" in p, name


def test_catalog_dimension_is_broadcast(spark):
    from __spark_entry__ import queries
    p = _final_plan(queries()["JN-1"](spark, SF_SMALL))
    assert "BroadcastHashJoin" in p


def test_attempt_scan_pushes_role_filter(spark):
    from __spark_entry__ import queries
    df = queries()["AG-7"](spark, SF_SMALL)
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(role), EqualTo(role,assistant)]" in p
