"""Registered queries against DuckDB on the smallest tables.

A sample of each area runs by default; TICKLOOM_ALL=1 runs every query.
"""

import os

import pytest

from tests.oracle import compare, connect
from tickloom.catalog import load

SF = os.environ.get("TICKLOOM_SF", "/root/testdata/sf0.001")
QUERIES, ORACLES = load()
SAMPLE = [
    "clock_codec", "market_cuts", "order_routing", "trade_sides", "latest_state_at_cuts", "flow_pressure_family", "impact_efficiency_family",
    "depth_fragility", "order_flow_imbalance", "basic_statistics", "id_gaps", "big_trades", "parent_orders", "trade_pairs", "information_coefficients",
    "quantile_group_returns", "winsorised_exposure", "validity_matrix", "evidence_classes", "frozen_selection", "portfolio_metrics", "effect_time_series",
    "column_quality", "reproduction_check", "two_run_comparison", "exposure_matrix", "ledger_quality", "chip_levels", "live_bars", "execution_shocks", "shock_replenishment", "factor_portrait", "metric_panel",
    "closing_bars", "replay_audit", "live_pairs", "big_orders", "garch_fit", "ou_fit", "ofi_principal_component", "parameter_neighbours",
]
#: a shock needs thirty earlier trades of its stock-day, which the smallest tables do not have
LARGER = {"execution_shocks", "shock_replenishment"}
#: reports that the smallest tables leave empty on both sides
EMPTY = {"frozen_selection"}
NAMES = sorted(QUERIES) if os.environ.get("TICKLOOM_ALL") else SAMPLE


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    if name in ORACLES:
        folder = SF.replace("sf0.001", "sf0.01") if name in LARGER else SF
        problem = compare(spark, connect(folder) if name in LARGER else duck, name, QUERIES[name], ORACLES[name], folder)
        assert problem is None or problem == "empty" and name in EMPTY, problem
    else:
        assert QUERIES[name](spark, SF).columns


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) > 100
