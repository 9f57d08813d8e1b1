"""Plans that must hold at any size."""

import os

import pytest

import __spark_entry__ as contract

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not there")


def plan_of(spark, name):
    return contract.queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()


def test_energy_reads_only_its_columns(spark):
    plan = plan_of(spark, "en_hourly")
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,value:double>" in plan
    assert "partial_sum" in plan and plan.count("Exchange hashpartitioning") == 1


def test_shipments_read_three_of_eleven_columns(spark):
    plan = plan_of(spark, "en_monthly")
    assert "ReadSchema: struct<l_quantity:double,l_discount:double,l_shipdate:timestamp_ntz>" in plan


@pytest.mark.parametrize("name", ["ft_all", "ft_lags", "ft_rolling_60", "ds_split_temporal", "cv_expanding", "ch_residuals"])
def test_no_row_scale_single_partition(spark, name):
    assert "SinglePartition" not in plan_of(spark, name)


def test_all_row_features_share_one_window_shuffle(spark):
    plan = plan_of(spark, "ft_all")
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.count("Window [") == 1


def test_folds_need_no_shuffle(spark):
    assert "Exchange hashpartitioning" not in plan_of(spark, "cv_expanding")


def test_metrics_are_one_aggregation(spark):
    plan = plan_of(spark, "ev_regression_metrics")
    assert plan.count("Exchange hashpartitioning") == 1


def test_top_n_is_cut_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan_of(spark, "ch_topn_importance")


def test_small_summaries_are_broadcast(spark):
    """Rows are not shuffled by task and model, where one may hold most of them."""
    plan = plan_of(spark, "ch_residual_hist")
    assert "BroadcastHashJoin" in plan
