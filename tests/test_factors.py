"""Hand-computed cases for the event families, books and clocks."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.functions import book
from tickloom.operators.cuts import market_cuts
from tickloom.plans import event_families as ev
from tickloom.plans.registry import FAMILIES, KEYS, Streams, build_panel, default_names, factor_family

T = 36_000_000  # 10:00 in milliseconds


def trades(spark, rows, date="20240102", symbol="000001"):
    """rows: (side, volume[, price[, type]]) one second apart from 09:30, then the record that fires 10:00."""
    out = []
    for i, r in enumerate(rows):
        side, volume, price, kind = (*r, *(100, "0")[len(r) - 2 :]) if len(r) < 4 else r
        ms = 34_200_000 + i * 1000
        out.append((date, symbol, ms * 1000, ms, 1, i, side, volume, price, kind))
    out.append((date, "trigger", T * 1000, T, 1, 10**6, "B", 1, 100, "0"))
    return spark.createDataFrame(out, "date string, symbol string, local_us long, exch_ms long, channel int, serial long, bsflag string, volume long, price long, trade_type string")


def flow(spark, rows):
    t = trades(spark, rows)
    cuts = market_cuts([t], [100_000_000])
    out = ev.flow_pressure(Streams(trades=t), cuts).filter("symbol = '000001'").collect()
    return out[0].asDict() if out else None


@pytest.mark.parametrize("rows, want", [([("B", 100)], 1.0), ([("S", 100)], -1.0), ([("B", 50), ("S", 50)], 0.0)])
def test_signed_flow(spark, rows, want):
    got = flow(spark, rows)
    assert got["flow_pressure_signed_trade_flow_w16"] == want
    assert got["ready_flow_pressure_signed_trade_flow_w16"]


def test_lag_drops_the_newest_trades(spark):
    got = flow(spark, [("B", 100), ("S", 100)])
    assert got["flow_pressure_signed_trade_flow_w16"] == 0.0
    assert got["flow_pressure_signed_trade_flow_w64_lag1"] == 1.0
    assert got["flow_pressure_signed_trade_flow_w128_lag2"] == 0.0


def test_ignored_trades_leave_no_row(spark):
    assert flow(spark, [("B", 100, 100, "C"), ("B", 0), ("X", 10)]) is None


def test_eviction(spark):
    assert flow(spark, [("S", 100)] + [("B", 10)] * 16)["flow_pressure_signed_trade_flow_w16"] == 1.0


def test_later_records_do_not_change_a_checkpoint(spark):
    before = flow(spark, [("B", 10), ("S", 4)])
    t = trades(spark, [("B", 10), ("S", 4)])
    huge = spark.createDataFrame([("20240102", "000001", T * 1000 + 5, T, 1, 7, "S", 10**9, 100, "0")], t.schema)
    t = t.unionByName(huge)
    after = ev.flow_pressure(Streams(trades=t), market_cuts([t], [100_000_000])).filter("symbol = '000001'").collect()[0].asDict()
    assert after == before


def test_impact_needs_two_trades_and_no_opening(spark):
    t = trades(spark, [("B", 10, 100), ("B", 10, 110)])
    got = ev.impact_efficiency(Streams(trades=t), market_cuts([t], [100_000_000])).filter("symbol = '000001'").collect()[0]
    assert got.impact_efficiency_signed_price_impact_w16 == pytest.approx(10 / 105)
    one = trades(spark, [("B", 10, 100)])
    got = ev.impact_efficiency(Streams(trades=one), market_cuts([one], [100_000_000])).filter("symbol = '000001'").collect()[0]
    assert not got.ready_impact_efficiency_signed_price_impact_w16


def quotes(spark, books, symbol="000001"):
    out = []
    for i, (bp, bv, ap, av) in enumerate(books):
        ms = 34_200_000 + i * 1000
        pad = lambda x: (list(x) + [0] * 10)[:10]
        out.append(("20240102", symbol, ms * 1000, ms, 0, i, pad(bp), pad(bv), pad(ap), pad(av)))
    out.append(("20240102", "trigger", T * 1000, T, 0, 10**6, [0] * 10, [0] * 10, [0] * 10, [0] * 10))
    return spark.createDataFrame(out, "date string, symbol string, local_us long, exch_ms long, channel int, serial long, bp array<long>, bv array<long>, ap array<long>, av array<long>")


def resilience(spark, volumes, bid=10_000, ask=10_010):
    q = quotes(spark, [([bid], [v], [ask], [v]) for v in volumes])
    return ev.liquidity_resilience(Streams(quotes=q), market_cuts([q], [100_000_000])).filter("symbol = '000001'").collect()[0]


def test_recovery_warm_up_and_rising_window(spark):
    one = resilience(spark, [10])
    assert one.liquidity_resilience_spread_adjusted_depth_recovery_w16 is None
    assert not one.ready_liquidity_resilience_spread_adjusted_depth_recovery_w16
    rising = resilience(spark, [10 * (i + 1) for i in range(16)])
    assert rising.liquidity_resilience_shock_recovery_speed_w16_lag0 is None
    assert rising.liquidity_resilience_spread_adjusted_depth_recovery_w16 == 1.0


def test_shock_then_rebound(spark):
    fallen = resilience(spark, [100] * 16 + [10])
    assert fallen.liquidity_resilience_shock_recovery_speed_w16_lag0 is None
    back = resilience(spark, [100] * 16 + [10, 60])
    assert back.liquidity_resilience_shock_recovery_speed_w16_lag0 == pytest.approx(50 / 90)


def test_crossed_book_is_not_ready(spark):
    got = resilience(spark, [100] * 20, bid=20_000, ask=10_000)
    assert got.liquidity_resilience_spread_adjusted_depth_recovery_w16 is None


def test_shock_speeds_match_a_plain_scan():
    rng = np.random.default_rng(1)
    series = rng.integers(1, 100, (200, 16)).astype(float)

    def scan(h):
        peak, top, low, at = h[0], 0.0, 0.0, None
        for i in range(1, len(h) - 1):
            if h[i] < peak * 0.8 and (at is None or h[i] < low):
                top, low, at = peak, h[i], i
            peak = max(peak, h[i])
        if at is None or h[-1] <= low or top <= low:
            return math.nan
        return (h[-1] - low) / (top - low) / (len(h) - 1 - at)

    np.testing.assert_allclose(ev.shock_speeds(series), [scan(h) for h in series])


def test_fragility_needs_three_levels_and_depth(spark):
    deep = ([100, 99, 98], [10, 10, 10], [101, 102, 103], [10, 10, 10])
    q = quotes(spark, [deep, ([100], [10], [101], [10]), ([200, 99, 98], [1, 1, 1], [100, 101, 102], [1, 1, 1])])
    got = {r.serial: r for r in book.with_sweep(q.filter("symbol = '000001'"), 0.5).collect()}
    # 15 shares a side: (10*101+5*102)/15 and (10*100+5*99)/15 around 100.5
    assert got[0].vwap_fragility == pytest.approx((1520 / 15 - 100.5) - (100.5 - 1495 / 15))
    assert got[0].terminal_fragility == pytest.approx(102 / 100.5 - 1 - (1 - 99 / 100.5))
    assert got[1].vwap_fragility is None and got[2].vwap_fragility is None


def test_cut_is_market_wide(spark):
    # the other stock reaches 10:00 first; a later arrival of 000001 with an earlier clock is not seen
    rows = [("20240102", "000001", 1, T - 10, 1, 1), ("20240102", "x", 2, T, 1, 2), ("20240102", "000001", 3, T - 5, 1, 3)]
    s = spark.createDataFrame(rows, "date string, symbol string, local_us long, exch_ms long, channel int, serial long")
    cut = market_cuts([s], [100_000_000]).collect()[0]
    assert (cut.cut.local_us, cut.cut.serial) == (2, 2)


def test_registry_and_panel_layout(spark):
    assert default_names("f", 2) == ("f_F000", "f_F001")
    with pytest.raises(ValueError):
        factor_family("flow_pressure", 1)(lambda s, c: None)
    t = trades(spark, [("B", 1)])
    panel = build_panel(Streams(trades=t), market_cuts([t], [100_000_000]), ["impact_efficiency", "flow_pressure"])
    factors = [*FAMILIES["impact_efficiency"].columns, *FAMILIES["flow_pressure"].columns]
    assert panel.columns[: 3 + len(factors)] == KEYS + factors
    assert panel.filter(F.col("ready_flow_pressure_signed_trade_flow_w16") != (F.col("reason_flow_pressure_signed_trade_flow_w16") == 0)).count() == 0


def test_partition_count_does_not_matter(spark):
    t = trades(spark, [("B" if i % 3 else "S", 1 + i % 7, 100 + i % 5) for i in range(300)])
    many = t.repartition(13)
    a = ev.flow_pressure(Streams(trades=t), market_cuts([t], [100_000_000])).filter("symbol = '000001'").collect()[0]
    b = ev.flow_pressure(Streams(trades=many), market_cuts([many], [100_000_000])).filter("symbol = '000001'").collect()[0]
    for c in FAMILIES["flow_pressure"].columns:
        assert a[c] == pytest.approx(b[c], abs=1e-12)


def test_a_cross_sectional_family_reads_the_panel(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from tickloom.plans.registry import with_readiness

    @factor_family("rank_of_flow_test", ["flow_rank_test"], cross_sectional=True, events=[100_000_000])
    def rank_of_flow(panel, cuts):
        own = FAMILIES["flow_pressure"].columns[0]
        ranked = panel.filter(F.col(own).isNotNull()).withColumn("flow_rank_test", F.rank().over(Window.partitionBy("date", "event").orderBy(own)).cast("double"))
        return with_readiness(ranked.select(*KEYS, "flow_rank_test"), ["flow_rank_test"])

    try:
        rows = [("20240102", s, 34_000_000_000 + i, 34_000_000 + i, 0, i, side) for i in range(40) for s, side in ((1, "B"), (2, "S" if i % 2 else "B"))]
        t = spark.createDataFrame(rows, "date string, symbol long, local_us long, exch_ms long, channel int, serial long, bsflag string")
        t = t.selectExpr("*", "'F' AS trade_type", "100L AS volume", "1000L AS price", "1000L AS amount")
        cuts = market_cuts([t.unionByName(t.filter("serial = 0").selectExpr("date", "symbol", "36000000000L AS local_us", "36000000L AS exch_ms", "channel", "99L AS serial", "bsflag", "trade_type", "volume", "price", "amount"))], [100_000_000])
        panel = build_panel(Streams(trades=t), cuts, ["rank_of_flow_test", "flow_pressure"])
        assert panel.columns[3] == "flow_rank_test"
        got = {r.symbol: (r.flow_rank_test, r.ready_flow_rank_test) for r in panel.collect()}
        assert got == {1: (2.0, True), 2: (1.0, True)}
    finally:
        del FAMILIES["rank_of_flow_test"]
