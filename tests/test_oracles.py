"""Panel queries against SQL on the smallest tables: some of each family, and all that are new or costly to get wrong."""

import pytest

from barloom import plans
from tests.compare import same

QUERIES, SQL = plans.collect()
FOLDER = "/root/testdata/sf0.001"
#: One or two queries of each family; the driver compares them all.
CHOSEN = [
    "f_price", "f_trend", "f_momentum", "f_volatility", "f_volume", "f_microstructure", "f_market_structure", "f_swings", "xs_ranks", "rg_regime", "mc_macro_features", "sr_sector_residual", "ea_earnings",
    "sv_filings", "fu4_fundamentals_ttm", "src9_flatten_facts", "snk2_upsert_preserving", "cln5_cleaning_report", "cln9_audit_sources", "pit6_mask_non_members", "lb2_quantile_label",
    "sp1_fold_rows", "ev5_evaluate_predictions", "gt2_trial_objective", "dr1_drift_check", "pr2_rank_predictions", "ca1_calibration_table", "sr5_etf_features", "fu1_fundamentals_annual", "fu3_latest_value", "fu5_fundamentals_ranks", "pn1_build_panel", "pn3_inference_slice", "pn4_batch_slice", "snk3_training_panel", "ev8_monthly_summary", "pr8_performance_summary",
    "pr8_calibration", "se1_sector_flags", "se2_canonical_sector", "src8_flatten_filings", "snk1_upsert", "aj0_asof_last", "aj1_asof_next", "ud2_date_group", "ca2_ic_timeseries", "src1_read_bars", "pf38_retrain_pace", "pf25_seeded_atr", "st1_stream_upsert", "st2_stream_settle", "ud1_custom_group", "pf7_per_year_metrics", "pf28_lot_outcomes", "pf31_position_rollup", "tx7_coerce", "st3_preliminary_vs_final",
]


@pytest.mark.parametrize("name", CHOSEN)
def test_same_as_sql(spark, name):
    same(spark, QUERIES[name], SQL[name], FOLDER)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_queries_without_sql_give_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).limit(1).count() == 1


def test_sql_only_for_queries():
    assert set(SQL) <= set(QUERIES)
