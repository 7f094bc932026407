"""The registered queries: keys, oracles at the smallest scale, and plans."""

import os

import pytest

import __spark_entry__ as entry
from inplay.plans.catalog import ORACLES, QUERIES
from tools.check import compare, connect

SF = "/root/testdata/sf0.001"
SAMPLE = ["paired_score", "asof_quote", "winner_grid", "event_study", "info_test", "monotone_repair", "play_events", "replay_events", "match_pair_date",
          "priors", "price_ladder", "forecast_eval", "segment_rows", "bucket_borrow", "wp_features", "situations", "counterfactual", "coverage",
          "json_normalize", "calib_paired", "live_asof"]
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables absent")


def test_every_oracle_belongs_to_a_query():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    assert set(QUERIES) - set(ORACLES) == {"wp_fit", "loso_cv", "forward_test", "wp_on_events", "outcome_fit"}


@needs_data
@pytest.mark.parametrize("key", SAMPLE)
def test_query_equals_its_sql(spark, key):
    msg, _, ok = compare(connect(SF), spark, key, entry.queries()[key], entry.oracle_sql()[key], SF)
    assert ok, msg


@needs_data
def test_entry_runs(spark):
    df = entry.entry(spark)
    assert "brier_diff" in df.columns and df.count() > 0


@needs_data
@pytest.mark.parametrize("key", ["asof_quote", "winner_grid", "event_path", "match_pair_date", "bars_vwap"])
def test_plans_have_no_nested_loops(spark, key):
    plan = entry.queries()[key](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


@needs_data
def test_model_fit_scores_every_row(spark):
    rows = entry.queries()["wp_fit"](spark, SF).collect()
    assert rows and all(0 <= r.wp <= 1 for r in rows)


@needs_data
def test_wide_distributions_are_not_broadcast(spark):
    plan = entry.queries()["rung_grid"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert any("ShuffledHashJoin [game_id" in line and "BuildLeft" in line for line in plan.splitlines())


@needs_data
@pytest.mark.parametrize("key", ["winner_grid", "waiting_for", "counterfactual"])
def test_tasks_of_the_grid_grow_with_the_events(spark, monkeypatch, key):
    from inplay.operators import scan as sc

    events = spark.read.parquet(f"{SF}/events.parquet").count()
    monkeypatch.setattr(sc, "TASK_ROWS", events // 40)
    scans = entry.queries()[key](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(game_id" in scans and "REPARTITION_BY_NUM" in scans
    assert compare(connect(SF), spark, key, entry.queries()[key], entry.oracle_sql()[key], SF)[2]
    if key == "winner_grid":
        assert entry.queries()[key](spark, SF).rdd.getNumPartitions() >= 40


def test_labels_of_keys_past_six_digits(spark, tmp_path):
    """lpad cuts what is longer than its width, on both sides."""
    import duckdb

    duckdb.sql(f"""COPY (SELECT unnest([7, 999999, 1000001, 123456789])::BIGINT AS p_partkey, 'spring ring' AS p_name, 'b' AS p_brand, 'TIN' AS p_type)
        TO '{tmp_path}/part.parquet' (FORMAT parquet)""")
    msg, _, ok = compare(connect(str(tmp_path)), spark, "fn_string", entry.queries()["fn_string"], entry.oracle_sql()["fn_string"], str(tmp_path))
    assert ok, msg
