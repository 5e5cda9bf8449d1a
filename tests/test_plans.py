"""Plan-shape checks: the scale properties the design relies on."""

import re

from webloom.plans import queries as Q


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_last_n_limits_before_shuffle(spark, sf_small):
    p = plan(Q.q_last_n_log(spark, sf_small))
    assert re.search(r"WindowGroupLimit .*Partial", p)


def test_retention_filter_reaches_scan(spark, sf_small):
    p = plan(Q.q_expired(spark, sf_small))
    assert "PushedFilters: [IsNotNull(ts), LessThan(ts," in p
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz>" in p


def test_search_scores_stay_in_partition(spark, sf_small):
    p = plan(Q.q_multi_search(spark, sf_small))
    keys = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", p)
    assert not any("_q" in k and "_d" in k for k in keys)      # no shuffle of (query, doc) sums
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_reset_uses_aggregate_not_window(spark, sf_small):
    p = plan(Q.q_since_last_reset(spark, sf_small))
    assert "Window " not in p and "partial_max" in p


def test_outline_is_narrow(spark, sf_small):
    p = plan(Q.q_outline_text(spark, sf_small))
    assert "MapInPandas" in p and "hashpartitioning" not in p
