"""Catalogue queries against their DuckDB oracles on the smallest tables."""
import math

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from sidelines.sources.io import TABLES

SF = "/root/testdata/sf0.001"
FAST = ["kicker_features", "points_rubric", "spine_densify", "fill_downup", "season_to_date_ratio", "row_index",
        "median_iqr_sd", "two_level_median", "hexbin_counts", "star_enrich", "patch_table", "fallback_row",
        "pivot_multi", "dummy_drop_mode", "ranked_board", "sorted_na_last", "weather_parse", "impact_table",
        "expected_points", "grid_slice", "stratified_folds", "local_smoother", "univariate_regression",
        "season_range_load", "snapshot_load", "override_csv", "preamble_csv", "many_csv", "indexed_csv", "baseline_row",
        "rating_files", "power_sequence", "grid_timeouts", "grid_eras", "grid_roofs", "grid_home", "spline_basis", "fold_metrics",
        "blend_scoring", "gram_matrix", "event_window", "impact_summary", "group_id",
        "running_raw", "fill_raw", "sparse_levels", "permuted_column", "correlation_matrix", "ridge_cv", "saved_model_scores",
        "penalised_spline", "loess_span", "impact_band",
        "knn_regression", "metrics_table", "team_week_offense", "team_week_defense", "final_data"]


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def _key(r):
    return tuple((x is None, type(x).__name__, x if x is not None else 0) for x in r)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, con, name):
    sdf = queries()[name](spark, SF)
    cur = con.execute(oracle_sql()[name])
    ocols = [d[0] for d in cur.description]
    assert sorted(sdf.columns) == sorted(ocols)
    idx = [ocols.index(c) for c in sdf.columns]
    o = sorted((tuple(_norm(r[i]) for i in idx) for r in cur.fetchall()), key=_key)
    s = sorted((tuple(_norm(v) for v in r) for r in sdf.collect()), key=_key)
    assert s == o


def test_every_query_has_docstring_and_oracle_names_exist():
    qs, os_ = queries(), oracle_sql()
    assert set(os_) <= set(qs)
    assert all(f.__doc__ for f in qs.values())


def test_entry_runs(spark):
    df = entry(spark)
    assert df.count() >= 0 and "fg_pct_mv" in df.columns
