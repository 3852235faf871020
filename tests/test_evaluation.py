"""Hand-computed cases of the evaluation, selection and effect jobs."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.operators import crosssection as cs
from tickloom.operators import fits, ofi
from tickloom.operators import series as sr
from tickloom.plans import validity as vd
from tickloom.sources import daily, ledger
from tickloom.sources import panels as pn


def frame(spark, x, y):
    return spark.createDataFrame([("g", i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "g string, symbol long, x double, y double")


@pytest.mark.parametrize("x, y", [([1, 2, 3, 4], [0.1, 0.2, 0.3, 0.4]), ([1, 2, float("nan"), 3, float("inf"), 4], [0.1, 0.2, 9, 0.3, 9, 0.4])])
def test_rank_ic(spark, x, y):
    got = cs.information_coefficients(frame(spark, x, y), ["g"]).collect()[0]
    assert got.RankIC == pytest.approx(1.0) and got.pairs == 4


def test_constant_factor_has_no_ic(spark):
    assert cs.information_coefficients(frame(spark, [1, 1, 1], [1, 2, 3]), ["g"]).collect()[0].RankIC is None


def test_average_rank_matches_pandas(spark):
    rng = np.random.default_rng(3)
    v = rng.integers(-40, 40, 500) / 8.0
    df = spark.createDataFrame([(int(i % 3), int(i), float(a)) for i, a in enumerate(v)], "g int, symbol long, x double")
    got = cs.average_rank(df, ["g"], "x", "r").toPandas().sort_values("symbol")
    want = got.groupby("g")["x"].rank(method="average")
    np.testing.assert_allclose(got["r"], want)


def test_quantile_groups(spark):
    g = cs.group_returns(frame(spark, [1, 2, 3, 4, 5, 6], [1, 1, 2, 2, 3, 3]), ["g"], groups=3).orderBy("bucket").collect()
    assert [r.mean_return for r in g] == [1.0, 2.0, 3.0]


def test_deciles_put_the_highest_values_first(spark):
    d = cs.decile_panel(frame(spark, range(20), range(20)), ["g"]).collect()[0]
    assert (d.D1, d.D10, d.LS) == (18.5, 0.5, 18.0) and d.Monotonicity == pytest.approx(-1.0)


def test_winsorise_matches_numpy(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=400) * np.where(rng.random(400) < 0.02, 30, 1)
    n = int(len(x) * 0.01)
    s = np.sort(x)
    a = np.clip(x, s[n], s[-n - 1])
    b = np.clip(a, a.mean() - 3 * a.std(), a.mean() + 3 * a.std())
    want = (b - b.mean()) / b.std()
    df = spark.createDataFrame([("g", i, float(v)) for i, v in enumerate(x)], "g string, i int, v double")
    got = cs.winsorise(df, ["g"], "v", "w").toPandas().sort_values("i")["w"]
    np.testing.assert_allclose(got, want, atol=1e-9)


def test_portfolio_metrics(spark):
    df = spark.createDataFrame([("p", f"2021010{i}", r) for i, r in enumerate([0.10, -0.05, 0.02])], "g string, date string, r double")
    m = sr.portfolio_metrics(df, ["g"], "r", 3).collect()[0]
    assert m.cumulative_return == pytest.approx(1.10 * 0.95 * 1.02 - 1)
    assert m.volatility == pytest.approx(0.1061446, abs=1e-6) and m.max_drawdown == pytest.approx(-0.05)


def test_total_loss_keeps_equity_at_zero(spark):
    df = spark.createDataFrame([("p", f"2021010{i}", r) for i, r in enumerate([0.10, -1.0, 0.5])], "g string, date string, r double")
    m = sr.portfolio_metrics(df, ["g"], "r", 3).collect()[0]
    assert (m.cumulative_return, m.annualized_return, m.max_drawdown) == (-1.0, -1.0, -1.0)


def test_turnover(spark):
    df = spark.createDataFrame([("p", "1", [1.0, 0.0]), ("p", "2", [0.5, 0.5]), ("p", "3", [0.5, 0.5])], "g string, date string, weights array<double>")
    assert sr.average_turnover(df, ["g"]).collect()[0].average_turnover == 0.25


def test_effect_series_skips_dates_that_are_not_ready(spark):
    rows = [("f", "u", "l", 1, d, r, ic, q) for d, r, ic, q in [("20240101", True, 0.1, 0.1), ("20240102", False, 0.9, 0.9), ("20240103", True, -0.2, -0.1)]]
    df = spark.createDataFrame(rows, "factor string, universe string, label string, event long, date string, ready boolean, rank_ic double, q double")
    df = df.select("*", *[F.col("q").alias(f"q{i}_return") for i in range(1, 11)]).drop("q")
    d = spark.createDataFrame([("f", "u", "l", 1, "positive")], "factor string, universe string, label string, event long, direction string")
    got = sr.effect_series(df, d).orderBy("date").collect()
    assert [round(r.ic_cumulative, 9) for r in got] == [0.1, -0.1]
    assert got[-1].long_cumulative == pytest.approx(1.1 * 0.9 - 1) and got[-1].coverage == pytest.approx(2 / 3)


def test_holdout_needs_authorisation(spark):
    df = spark.createDataFrame([("20250103",)], "date string")
    with pytest.raises(ValueError):
        sr.guard_holdout(df)
    sr.guard_holdout(df, authorised=True)


CELL = "factor string, event long, universe string, label string, coverage double, ready boolean, metric_defined boolean, data_error boolean, training_rank_ic double, observation_rank_ic double, training_ls double, observation_ls double, training_monotonicity double, observation_monotonicity double, training_rank_ic_tstat double, observation_rank_ic_tstat double, parent_rank_ic double"


def cell(name, s=1.0, event=926, **over):
    base = dict(factor=name, event=event, universe="u", label="l", coverage=1.0, ready=True, metric_defined=True, data_error=False, training_rank_ic=0.02 * s, observation_rank_ic=0.01 * s, training_ls=s, observation_ls=s, training_monotonicity=-s, observation_monotonicity=-s, training_rank_ic_tstat=None, observation_rank_ic_tstat=None, parent_rank_ic=0.005)
    return tuple((base | over).values())


def test_evidence_rules_and_selection(spark):
    rows = [
        cell("up"), cell("down", -1.0), cell("flip", observation_rank_ic=-0.01), cell("small", training_rank_ic=0.004), cell("weak_t", training_rank_ic_tstat=1.0),
        cell("thin", coverage=0.9), cell("off", ready=False), cell("parent", parent_rank_ic=0.5), cell("up", event=1000, training_rank_ic=0.03),
    ]
    c = vd.classify_evidence(spark.createDataFrame(rows, CELL))
    got = {(r.factor, r.event): r.status for r in c.collect()}
    assert got[("up", 926)] == got[("down", 926)] == "supported"
    assert got[("flip", 926)] == "unsupported"
    assert got[("small", 926)] == got[("weak_t", 926)] == got[("parent", 926)] == "promising"
    assert got[("thin", 926)] == got[("off", 926)] == "not_evaluable"
    assert {(r.factor, r.direction) for r in vd.selected_directions(c).collect()} == {("up", "positive"), ("down", "negative")}
    assert {(r.factor, r.best_event) for r in vd.best_events(c).collect()} == {("up", 1000), ("down", 926)}
    bad = vd.classify_evidence(spark.createDataFrame([cell("x", data_error=True)], CELL))
    with pytest.raises(ValueError):
        vd.require_no_errors(bad)


def test_readiness_is_not_zero(spark):
    p = spark.createDataFrame([("d", 0.0, False), ("d", 0.0, True), ("d", 1.0, True), ("d", 2.0, True)], "date string, f double, ready_f boolean")
    q = pn.column_quality(p, ["f"], ["date"], min_coverage=0.5).collect()[0]
    assert (q.not_ready_count, q.not_ready_zero_count, q.zero_count) == (1, 1, 1) and q.nonzero_ratio == pytest.approx(2 / 3)


def test_degenerate_column_has_four_reasons(spark):
    p = spark.createDataFrame([("d", 0.0, True)] * 4, "date string, f double, ready_f boolean")
    q = pn.column_quality(p, ["f"], ["date"], min_std=0.1, min_nonzero=0.5).collect()[0]
    assert q.status == "technical_reject" and {"constant_column", "cross_section_std_below_threshold", "cross_section_unique_count_below_threshold", "cross_section_nonzero_ratio_below_threshold"} <= set(q.reject_reasons)


def test_contract_checks():
    pn.check_dates(["20240102", "20240103"], ["20240102", "20240103"])
    for bad in (["20240103", "20240102"], ["20250103"], ["2024010"], []):
        with pytest.raises(ValueError):
            pn.check_dates(bad, ["20240102", "20240103", "20250103"])
    with pytest.raises(ValueError):
        pn.check_columns(["a"], ["a", "b"])


def test_panel_round_trip_replaces_only_its_partitions(spark, tmp_path):
    schema = "symbol string, date string, event long, f double, ready_f boolean, reason_f short"
    a = spark.createDataFrame([("1", "20240102", 1, 1.0, True, 0), ("1", "20240103", 1, 2.0, True, 0)], schema)
    pn.write_panel(a, str(tmp_path / "p"))
    pn.write_panel(spark.createDataFrame([("1", "20240103", 1, 3.0, False, 3)], schema), str(tmp_path / "p"))
    back = pn.read_panel(spark, str(tmp_path / "p"), ["f"], ["20240102", "20240103"])
    assert sorted((str(r.date), r.f) for r in back.collect()) == [("20240102", 1.0), ("20240103", 3.0)]
    only = pn.factor_only(back, ["f"]).collect()
    assert sum(np.isnan(r.f) for r in only) == 1


def test_strict_json(spark, tmp_path):
    (tmp_path / "ok.json").write_text('{"a": 1.5}')
    (tmp_path / "bad.json").write_text('{"a": NaN}')
    assert pn.read_strict_json(spark, str(tmp_path / "ok.json"), "a double").collect()[0].a == 1.5
    with pytest.raises(Exception):
        pn.read_strict_json(spark, str(tmp_path / "bad.json"), "a double").collect()


def test_daily_csv(spark, tmp_path):
    head = "ticker,high,low,open,close,vwap,vol,amount,ashare\n"
    (tmp_path / "d.csv").write_text(head + "600000.SH,1,2,3,4,5,6,7,8\nshort,1\n000001.SZ,,x,3,4,5,6,7,8\n600000.SH,9,2,3,4,5,6,7,8\n")
    got = {r.ticker: r for r in daily.read_daily_csv(spark, str(tmp_path)).collect()}
    assert set(got) == {"600000", "000001"} and got["600000"].high == 9.0 and (got["000001"].high, got["000001"].low) == (0.0, 0.0)


def test_ledger_rules(spark):
    ok = {n: "x" for n in ledger.REQUIRED} | {"status": "promoted", "promotion_allowed": True}
    import json

    lines = [json.dumps(ok), "not json", "", json.dumps(ok | {"promotion_allowed": False}), json.dumps(ok | {"status": "lost", "family_id": ""}), json.dumps(ok | {"status": "crash", "promotion_allowed": "maybe"}), json.dumps({k: v for k, v in ok.items() if k != "promotion_allowed"} | {"status": "crash"})]
    got = [[(b.rule, b.fields) for b in r.broken] for r in ledger.check_lines(spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1)).collect()]
    both = ["status", "promotion_allowed"]
    assert got == [[], [("L0", [])], [("L4", both)], [("L1", ["family_id"]), ("L2", ["status"]), ("L4", both)], [("L3", ["promotion_allowed"])], []]


#: next state for (state, shock, normal, direction of z and slope): +1 both up, -1 both down, 0 otherwise
def walk(state, z, vz, slope):
    shock, normal = abs(z) >= ofi.Z_SHOCK and vz >= ofi.V_SHOCK, abs(z) <= ofi.Z_NORMAL and vz <= ofi.V_NORMAL
    way = (z > 0 and slope > 0) - (z < 0 and slope < 0)
    if state == ofi.SHOCK:
        return ofi.RECOVERY if normal else state
    calm = {1: ofi.ACCUMULATION, -1: ofi.DISTRIBUTION, 0: ofi.CALM}
    table = {ofi.CALM: calm[way], ofi.ACCUMULATION: ofi.ACCUMULATION if way > 0 else ofi.CALM, ofi.DISTRIBUTION: ofi.DISTRIBUTION if way < 0 else ofi.CALM, ofi.RECOVERY: ofi.CALM if normal else ofi.RECOVERY}
    return ofi.SHOCK if shock else table[state]


def test_state_machine_chunks_equal_a_sequential_walk(spark):
    """Chunked automaton against the plain loop, with chunks of forty rows."""
    rng = np.random.default_rng(7)
    n = 300
    pdf = pd.DataFrame({"date": "d", "symbol": 1, "local_us": range(n), "exch_ms": range(n), "channel": 0, "serial": range(n), "seq": range(1, n + 1), "z": rng.normal(0, 2, n), "vz": rng.normal(0, 2, n), "slope": rng.normal(0, 1, n)})
    pdf["chunk"] = (pdf["seq"] - 1) // 40
    got = ofi.state_series(spark.createDataFrame(pdf)).toPandas().sort_values("seq")
    state, want = ofi.CALM, []
    for r in pdf.itertuples():
        state = walk(state, r.z, r.vz, r.slope)
        want.append(state)
    assert got["state"].tolist() == want and got["prev_state"].tolist() == [0, *want[:-1]]


def test_state_inputs_match_pandas(spark):
    rng = np.random.default_rng(11)
    n = 400
    pdf = pd.DataFrame({"date": "d", "symbol": 1, "local_us": np.arange(n) * 1000, "exch_ms": np.arange(n) * 3000, "channel": 0, "serial": range(n), "ofi_agg": rng.normal(0, 1, n), "mid": 100 + rng.normal(0, 1, n).cumsum() / 10})
    pdf["prev_mid"] = pdf["mid"].shift(1).fillna(100.0)
    got = ofi.state_inputs(spark.createDataFrame(pdf)).toPandas().sort_values("seq")
    roll = pdf["ofi_agg"].rolling(40, min_periods=2)
    np.testing.assert_allclose(got["z"], ((pdf["ofi_agg"] - roll.mean()) / roll.std()).fillna(0.0), atol=1e-9)
    slope = [0.0 if i < 1 else np.polyfit(np.arange(min(i + 1, 120)), pdf["ofi_agg"].iloc[max(0, i - 119) : i + 1], 1)[0] for i in range(n)]
    np.testing.assert_allclose(got["slope"], slope, atol=1e-8)


def _volatility(pdf, rows):
    """Spread of returns and mean price in arrival order: rows of the last five seconds, ``rows`` at most."""
    vol, mean, clock = [], [], pdf["exch_ms"].cummax().to_numpy()
    ret = ((pdf["mid"] - pdf["prev_mid"]) / pdf["prev_mid"]).abs().to_numpy()
    for i in range(len(pdf)):
        own = [j for j in range(max(0, i - rows + 1), i + 1) if clock[j] > clock[i] - 5000]
        x = ret[own]
        vol.append(x.std(ddof=1) if len(x) > 1 and x.var(ddof=1) * (len(x) - 1) > 1e-9 else 0.0)
        mean.append(pdf["mid"].to_numpy()[own].mean())
    return pd.Series(vol), pd.Series(mean)


@pytest.mark.parametrize("rows, chunk", [(1999, 50_000), (6, 130)])
def test_state_inputs_see_nothing_later(spark, rows, chunk):
    """Ties and steps back of the exchange clock, many quotes in a span, and chunk edges."""
    rng = np.random.default_rng(13)
    n = 400
    clock = np.sort(rng.integers(0, 60, n)) * 1000 - rng.integers(0, 2, n) * 1500
    pdf = pd.DataFrame({"date": "d", "symbol": 1, "local_us": np.arange(n) * 1000, "exch_ms": clock, "channel": 0, "serial": range(n), "ofi_agg": rng.normal(0, 1, n), "mid": 100 + rng.normal(0, 1, n).cumsum() / 5})
    pdf["prev_mid"] = pdf["mid"].shift(1).fillna(100.0)
    got = ofi.state_inputs(spark.createDataFrame(pdf), vol_rows=rows, rows_per_chunk=chunk).toPandas().sort_values("seq")
    vol, mean = _volatility(pdf, rows)
    roll, before = vol.rolling(40, min_periods=2), mean.shift(1)
    std = roll.std().where(lambda x: (x**2 * (roll.count() - 1) > 1e-9) & (x > 1e-12))
    np.testing.assert_allclose(got["vz"], ((vol - roll.mean()) / std).fillna(0.0), atol=1e-6)
    np.testing.assert_allclose(got["ret5s"], ((mean - before) / before).fillna(0.0), atol=1e-10)
    shorter = ofi.state_inputs(spark.createDataFrame(pdf.iloc[:250]), vol_rows=rows, rows_per_chunk=chunk).toPandas().sort_values("seq")
    np.testing.assert_allclose(shorter[["z", "vz", "slope", "ret5s"]], got[["z", "vz", "slope", "ret5s"]].iloc[:250], atol=1e-9)


def test_dwell_reaches_back_to_the_last_change(spark):
    n = 700
    pdf = pd.DataFrame({"date": "d", "symbol": 1, "local_us": range(n), "exch_ms": range(n), "channel": 0, "serial": range(n), "seq": range(1, n + 1), "z": 0.5, "vz": 0.0, "slope": 0.1, "absret": 0.0, "ret5s": 0.0})
    pdf["state"] = [ofi.CALM] * 150 + [ofi.ACCUMULATION] * 550
    pdf["prev_state"] = pdf["state"].shift(1).fillna(ofi.CALM).astype(int)
    cut = spark.sql("SELECT 'd' AS date, 100L AS event, struct(650L AS local_us, 650L AS exch_ms, 0L AS channel, 650L AS serial) AS cut UNION ALL SELECT 'd', 50L, struct(100L, 100L, 0L, 100L)")
    got = {r.event: r.dwell for r in ofi.status_at_cuts(spark.createDataFrame(pdf), cut).collect()}
    assert got == {100: 500 - 1, 50: 100}


def test_clip_and_winsorise_keep_null(spark):
    from tickloom.functions.scalar import clamp01, clip
    from tickloom.operators.crosssection import winsorise

    row = spark.sql("SELECT CAST(NULL AS DOUBLE) AS a, 7.0D AS b").select(clip(F.col("a"), -5, 5), clip(F.col("b"), -5, 5), clamp01(F.col("a"))).first()
    assert tuple(row) == (None, 5.0, None)
    df = spark.createDataFrame([(1, float(i)) for i in range(20)] + [(1, None)] * 3, "g int, x double")
    got = winsorise(df, ["g"], "x", "w", cut=0.05).collect()
    assert sum(r.w is None for r in got) == 3 and all((r.x is None) == (r.w is None) for r in got)
    assert sum(r.w for r in got if r.w is not None) == pytest.approx(0)


@pytest.mark.parametrize("chunk, most", [(50_000, 40), (17, 40), (17, 10**9), (40, 2)])
def test_above_past_quantile_against_numpy(spark, chunk, most):
    """Few and many chunks, volumes that all differ, and one volume that most trades have."""
    from tickloom.operators.quantile import above_past_quantile

    rng = np.random.default_rng(3)
    v = np.where(rng.random(300) < (0.7 if most == 2 else 0), 20, rng.integers(1, max(most, 40), 300))
    df = spark.createDataFrame([("d", i % 2, i, i, 0, i, int(x)) for i, x in enumerate(v)], "date string, symbol int, local_us long, exch_ms long, channel int, serial long, volume long")
    got = {r.local_us: r.above for r in above_past_quantile(df, ["date", "symbol"], "volume", least=5, rows_per_chunk=chunk).collect()}
    for i, x in enumerate(v):
        past = v[i % 2 : i : 2]
        assert got[i] == (len(past) >= 5 and x > np.quantile(past, 0.9) + 1e-9), i


def test_rows_of_the_grid_do_not_grow_with_the_values(spark):
    """What earlier chunks hold is kept by chunk and bucket, however many values there are."""
    from tickloom.operators import quantile as qt

    df = spark.range(4000).select(F.lit("d").alias("date"), F.lit(1).alias("symbol"), (F.col("id") + 1).alias("_seq"), F.expr("id div 200").alias("_chunk"), F.xxhash64("id").alias("volume"))
    rows = qt._bucketed(df, ["date", "symbol"], "volume", 200)
    grid = qt._grid(rows, ["date", "symbol"], "volume")
    assert rows.groupBy("_bucket").count().agg(F.max("count")).first()[0] < 500 and grid.count() <= 20 * 40


@pytest.mark.parametrize("interval", [1, 3])
def test_closing_bars_against_a_walk(spark, interval):
    """Bars by a plain walk over arrivals, of which some come late."""
    from tickloom.operators.bars import closing_bars

    rng = np.random.default_rng(12)
    n = 400
    local = np.sort(rng.integers(0, 90 * 60_000, n))
    exch = np.maximum(local - rng.integers(0, 150_000, n), 0)
    ticks = pd.DataFrame({"date": "d", "symbol": np.where(rng.random(n) < 0.8, 1, 2), "local_us": local * 1000, "exch_ms": exch, "channel": 0, "serial": range(n), "price": rng.integers(90, 110, n)})
    for name in ("total_volume", "total_turnover", "open_interest", "upper_limit", "lower_limit"):
        ticks[name] = rng.integers(0, 50, n).cumsum()
    got = {(r.symbol, r.bar): tuple(r[2:]) for r in closing_bars(spark.createDataFrame(ticks).repartition(3), interval).select("date", "symbol", "bar", "minute", "open", "high", "low", "close", "volume", "turnover", "open_interest", "upper_limit", "lower_limit").collect()}
    want = {}
    for symbol, own in ticks.groupby("symbol"):
        last, bar, number = None, [], 0
        for t in own.itertuples():
            bar.append(t)
            minute = t.exch_ms // 60_000
            if last is None:
                last = minute
            elif minute - last >= interval:
                prices = [b.price for b in bar]
                o = bar[0]
                want[symbol, number] = (number, minute, o.price, max(prices), min(prices), t.price, t.total_volume - o.total_volume, t.total_turnover - o.total_turnover, t.open_interest, o.upper_limit, o.lower_limit)
                last, bar, number = minute, [], number + 1
    assert got == want and len(want) > 30


def test_big_orders_against_a_walk(spark):
    """Spans that end with the order before, both gates and the fallback, over bursts inside one millisecond."""
    from tickloom.operators.toolbox import big_orders

    rng = np.random.default_rng(14)
    n, width = 500, 4000
    ms = np.sort(rng.integers(0, 60_000, n) // 7 * 7)
    o = pd.DataFrame({"date": "d", "symbol": np.where(rng.random(n) < 0.8, 1, 2), "local_us": ms * 1000 + rng.integers(0, 3, n), "exch_ms": ms, "channel": 0, "serial": range(n), "price": rng.integers(95, 106, n), "volume": np.where(rng.random(n) < 0.9, 10, rng.integers(1, 90, n)), "bsflag": rng.choice(["B", "S"], n)})
    o.loc[o.symbol == 2, "volume"] = 10
    o = o.sort_values(["local_us", "serial"])
    q = spark.createDataFrame([("d", s, 0, 0, 0, -1, [99], [101]) for s in (1, 2)], "date string, symbol long, local_us long, exch_ms long, channel long, serial long, bp array<long>, ap array<long>")
    df = spark.createDataFrame(o).repartition(3)
    for need_m, need_t, fallback in ((False, False, None), (True, False, 10.0), (False, True, 10.0)):
        got = {r.serial: (r.ref_n, round(r.threshold, 6), r.is_big) for r in big_orders(df, q, width, min_n=8, fallback=fallback, need_marketable=need_m, need_touch=need_t).collect()}
        want = {}
        for _, own in o.groupby("symbol"):
            rows = list(own.itertuples())
            for i, r in enumerate(rows):
                past = [b.volume for b in rows[:i] if b.local_us // 1000 > rows[i - 1].local_us // 1000 - width]
                std = np.std(past, ddof=1) if len(past) > 1 else 0.0
                usable, flat = len(past) >= 8 and std > 1e-12, len(past) >= 8 and not std > 1e-12
                limit = np.mean(past) + 2 * std if usable else fallback if flat and fallback else 0.0
                crosses = r.price >= 101 if r.bsflag == "B" else r.price <= 99
                gap = max(0, 101 - r.price if r.bsflag == "B" else r.price - 99)
                big = (usable or flat and fallback is not None) and r.volume >= limit and (crosses or not need_m) and (gap == 0 or not need_t)
                want[r.serial] = (len(past), round(float(limit), 6), bool(big))
        assert got == want
        assert sum(w[2] for w in want.values()) > 3


def test_parameter_neighbours_over_maps(spark):
    """Any number of parameters; other key sets, equal definitions and two changes are no neighbours."""
    from tickloom.plans.portrait import parameter_neighbours

    rng = np.random.default_rng(16)
    docs = [(f"c{i}", f"f{i % 2}", {f"p{k}": str(rng.integers(0, 2)) for k in range(6)}) for i in range(60)] + [("e1", "f0", {}), ("e2", "f0", {"p0": "1"}), ("e3", "f0", {"p0": "2"}), ("e4", "f0", {"q": "1"}), ("n", "f0", None)]
    got = {tuple(r) for r in parameter_neighbours(spark.createDataFrame(docs, "id string, family string, parameters map<string,string>")).select("family", "changed", "a", "a_value", "b", "b_value").collect()}
    want = set()
    for a, f, x in docs:
        for b, g, y in docs:
            if f == g and x and y and x.keys() == y.keys() and len(d := [k for k in x if x[k] != y[k]]) == 1 and x[d[0]] < y[d[0]]:
                want.add((f, d[0], a, x[d[0]], b, y[d[0]]))
    assert got == want and ("f0", "p0", "e2", "1", "e3", "2") in got and len(got) > 10


def affine(pdf):
    return pdf[["a", "b"]].to_numpy(float)


def after(x, y):
    """x -> a x + b, and then the other: the order matters."""
    return np.stack([x[..., 0] * y[..., 0], y[..., 0] * x[..., 1] + y[..., 1]], axis=-1)


def test_ordered_fold_over_many_chunks(spark):
    """A fold whose steps do not commute, on a key of many chunks, against the plain walk."""
    from tickloom.operators.fold import Fold, check_associative, ordered_fold

    fold = Fold(affine, after, lambda s, x: s[:, :1] * x[0] + s[:, 1:], (2.0,))
    rng = np.random.default_rng(15)
    pdf = pd.DataFrame({"key": np.repeat([1, 2], [700, 5]), "seq": [*range(1, 701), *range(1, 6)], "a": rng.uniform(-1, 1, 705), "b": rng.normal(size=705)})
    pdf["chunk"] = (pdf["seq"] - 1) // 13
    check_associative(fold, pdf.head(50))
    with pytest.raises(ValueError):
        check_associative(fold._replace(compose=lambda x, y: x - y), pdf.head(50))
    got = ordered_fold(spark.createDataFrame(pdf).repartition(4), ["key"], fold, ["x"]).toPandas().set_index(["key", "seq"])
    for key, own in pdf.groupby("key"):
        x = 2.0
        for r in own.itertuples():
            before, x = x, r.a * x + r.b
            assert got.loc[(key, r.seq), "x"] == pytest.approx(x) and got.loc[(key, r.seq), "prev_x"] == pytest.approx(before)


def test_peak_of_changes_against_a_walk(spark):
    from tickloom.operators.sequence import peak_of_changes

    rng = np.random.default_rng(13)
    rows = [(int(rng.integers(0, 4)), i, int(rng.choice([-1, 1, 2, -2]))) for i in range(500)] + [(9, 1, -3), (9, 2, 1)]
    df = spark.createDataFrame(rows, "k int, at long, d long").repartition(3)
    got = {r.k: r.peak for r in peak_of_changes(df, ["k"], "d", ["at"], F.expr("at div 37")).collect()}
    assert got == {k: max(0, max(np.cumsum([d for g, _, d in sorted(rows, key=lambda r: r[1]) if g == k]))) for k in got} and set(got) == {r[0] for r in rows} and got[9] == 0


def test_principal_components_match_numpy():
    rng = np.random.default_rng(2)
    x = np.stack([rng.normal(size=(300, 4)) @ np.linalg.qr(rng.normal(size=(4, 4)))[0] * np.array([5.0, 1.5, 0.5, 0.1]) for _ in range(5)])
    n, sums, cross = np.array([300.0] * 4 + [1.0]), x.sum(1), np.einsum("nai,naj->nij", x, x)
    got = ofi.projections(n, sums, cross, x[:, -1], k=3, steps=400, tol=0.0)
    for m in range(4):
        top = np.linalg.eigh(np.cov(x[m].T))[1][:, ::-1][:, :3]
        assert np.abs(got[m]) == pytest.approx(np.abs(x[m, -1] @ top), rel=1e-6)
    assert (got[4] == 0).all()


def bars_of(spark, days):
    return spark.createDataFrame([("d", k, i, float(v)) for k, x in enumerate(days) for i, v in enumerate(x)], "date string, symbol int, bar long, close double").repartition(3)


def test_ou_fit_is_the_discounted_least_squares_line(spark):
    rng = np.random.default_rng(4)
    x = [10.0]
    for _ in range(1400):
        x.append(10.0 + 0.9 * (x[-1] - 10.0) + rng.normal(0, 0.1))
    got = {r.symbol: r for r in fits.ou_fit(bars_of(spark, [x, [5.0], [5.0, 6.0], [7.0] * 30, [1.0, 3.0, 2.0, 2.5]])).collect()}
    a, b = np.array(x[:-1]), np.array(x[1:])
    miss = []
    for k in range(2, len(b)):
        w = 0.995 ** np.arange(k - 1, -1, -1)
        slope, level = np.linalg.lstsq(np.sqrt(w)[:, None] * np.column_stack([a[:k], np.ones(k)]), np.sqrt(w) * b[:k], rcond=None)[0]
        miss.append(b[k] - slope * a[k] - level)
    w = 0.995 ** np.arange(len(b) - 1, -1, -1)
    slope, level = np.linalg.lstsq(np.sqrt(w)[:, None] * np.column_stack([a, np.ones(len(a))]), np.sqrt(w) * b, rcond=None)[0]
    noise = (w[2:] * np.square(miss)).sum() / w[2:].sum()
    dt = 60.0 / fits.YEAR_SECONDS
    assert (got[0].theta, got[0].mu, got[0].last) == (pytest.approx(-np.log(slope) / dt), pytest.approx(level / (1 - slope)), pytest.approx(x[-1]))
    assert got[0].sigma == pytest.approx(np.sqrt(-2 * np.log(slope) * noise / (dt * (1 - slope**2))))
    assert 1 not in got and got[2].theta is None and got[3].theta is None and got[4].theta > 0


def test_garch_fit_against_a_walk(spark):
    rng = np.random.default_rng(6)
    x = 100 * np.cumprod(1 + rng.normal(0, 0.01, 900))
    got = {r.symbol: r for r in fits.garch_fit(bars_of(spark, [x, [4.0], [4.0, 5.0], [4.0, 0.0, 5.0, 6.0]]), rate=3e-4).collect()}
    p, h, last = np.array([0.01, 0.1, 0.85]), 0.01 / 0.05, None
    for r in x[1:] / x[:-1] - 1:
        if last is not None:
            g = np.array([1.0, last, h])
            h = float(p @ g)
            p = np.maximum(p + 3e-4 * (r * r - h) / h**2 * g, [1e-9, 0, 0])
            over = p[1] + p[2] - 0.9999
            if over > 0:
                p[1] = min(max(p[1] - over / 2, 0), 0.9999)
                p[2] = 0.9999 - p[1]
        last = r * r
    assert [got[0].omega, got[0].alpha, got[0].beta, got[0].variance] == pytest.approx([*p, h], rel=1e-6)
    assert all((got[k].alpha, got[k].variance) == (0.1, 0.0) for k in (1, 2)) and got[3].variance > 0


@pytest.mark.parametrize("change, status, reason", [
    ({}, "pass", "explicit_readiness_true"), ({"rows": 9}, "data_error", "invalid_date_count"), ({"dates": 0, "rows": 0}, "data_error", "invalid_date_count"),
    ({"bad_factors": 1}, "data_error", "non_finite_factor_value"), ({"bad_metrics": 1}, "data_error", "non_finite_metric"), ({"ready_null": 1}, "data_error", "readiness_contains_null"),
    ({"ready_bad": 1}, "data_error", "ready_factor_value_not_finite"), ({"ready_dates": 0}, "not_ready", "explicit_readiness_false"), ({"ready_dates": 9}, "not_ready", "explicit_readiness_false"),
    ({"min_metric_count": 0, "max_metric_count": 0}, "metric_undefined", "no_finite_metric_values"), ({"min_metric_count": 9}, "coverage_fail", "metric_coverage_below_threshold"),
    ({"min_metric_distinct": 1}, "metric_undefined", "insufficient_metric_variation"), ({"factor_std": 0.0}, "metric_undefined", "insufficient_cross_sectional_variation"),
    ({"factor_unique": 1}, "metric_undefined", "insufficient_cross_sectional_variation"), ({"has_readiness": False, "ready_dates": 0}, "review", "readiness_not_provided"),
])
def test_every_validity_rule(spark, change, status, reason):
    cell = {"dates": 10, "rows": 10, "bad_metrics": 0, "bad_factors": 0, "ready_null": 0, "ready_dates": 10, "ready_bad": 0, "has_readiness": True, "min_metric_count": 10, "max_metric_count": 10, "min_metric_distinct": 5, "factor_std": 1.0, "factor_unique": 7}
    got = vd.classify_validity(spark.createDataFrame(pd.DataFrame([cell | change]))).first()
    assert (got.status, got.reason) == (status, reason)


def _cells(spark, **change):
    good = {"factor": "f", "event": 1, "universe": "u", "label": "l", "training_rank_ic": 0.02, "observation_rank_ic": 0.01, "training_ls": 1.0, "observation_ls": 1.0, "training_monotonicity": -1.0, "observation_monotonicity": -1.0, "training_rank_ic_tstat": 3.0, "observation_rank_ic_tstat": 3.0, "parent_rank_ic": 0.005, "coverage": 1.0, "ready": True, "metric_defined": True, "data_error": False}
    return vd.classify_evidence(spark.createDataFrame([good | change]))


@pytest.mark.parametrize("change, status", [({}, "supported"), ({"data_error": True}, "error"), ({"ready": False}, "not_evaluable"), ({"metric_defined": False}, "not_evaluable"), ({"coverage": 0.9}, "not_evaluable"), ({"parent_rank_ic": 0.05}, "promising"), ({"training_rank_ic_tstat": 1.0}, "promising"), ({"observation_rank_ic": -0.01}, "unsupported")])
def test_every_evidence_class_and_the_guard(spark, change, status):
    got = _cells(spark, **change)
    assert got.first().status == status
    if status == "error":
        with pytest.raises(ValueError):
            vd.require_no_errors(got)
    else:
        vd.require_no_errors(got)
    if status == "supported":
        assert vd.best_events(got).first().best_event == 1 and vd.selected_directions(got).first().direction == "positive"


def test_validity_over_a_whole_grid(spark):
    panel = spark.createDataFrame([("training", "f", 1, "u", "l", d, 0.1 * d, 0.2 * d, 0.3, 0.4 * d) for d in range(1, 4)], "split string, factor string, event int, universe string, label string, date int, RankIC double, IC double, LS double, Monotonicity double")
    grid = spark.createDataFrame([("training", "f", e, "u", "l") for e in (1, 2)], "split string, factor string, event int, universe string, label string")
    cross = spark.createDataFrame([("training", "f", e, 3, 0, 0, 0, 1.0, 3, True) for e in (1, 2)], "split string, factor string, event int, ready_dates int, ready_null int, ready_bad int, bad_factors int, factor_std double, factor_unique int, has_readiness boolean")
    counts = spark.createDataFrame([("training", 3)], "split string, dates int")
    got = {r.event: (r.status, r.reason) for r in vd.validity_cells(panel, counts, cross, grid=grid).collect()}
    assert got == {1: ("metric_undefined", "insufficient_metric_variation"), 2: ("data_error", "invalid_date_count")}


def test_universe_label_csv_and_concatenation(spark, tmp_path):
    spark.createDataFrame([("600000.SH", 1, 0), ("000001.SZ", 0, 1)], "code string, `000985` int, isdt1 int").write.parquet(f"{tmp_path}/u")
    assert pn.read_universe(spark, f"{tmp_path}/u").columns == ["code", "000985", "isdt1"]
    spark.createDataFrame([("600000", 1)], "code string, a int").write.parquet(f"{tmp_path}/v")
    with pytest.raises(ValueError):
        pn.read_universe(spark, f"{tmp_path}/v")
    (tmp_path / "l.csv").write_text("symbol,label\n1,0.5\n2,-1e-3\n")
    assert [r.label for r in pn.read_label_csv(spark, f"{tmp_path}/l.csv").orderBy("symbol").collect()] == [0.5, -0.001]
    (tmp_path / "m.csv").write_text("symbol,label\n1,none\n")
    with pytest.raises(Exception):
        pn.read_label_csv(spark, f"{tmp_path}/m.csv").collect()
    with pytest.raises(ValueError):
        pn.read_label_csv(spark, f"{tmp_path}/l.csv", "other")
    a, b = (spark.createDataFrame([(d, 1, 0.5)], "date string, event int, x double") for d in ("20240102", "20250102"))
    assert {(r.split, r.date) for r in pn.concat_panels({"observation": a, "holdout": b}).collect()} == {("observation", "20240102"), ("holdout", "20250102")}
    with pytest.raises(ValueError):
        pn.concat_panels({"observation": a, "holdout": a})


def test_strict_frame(spark):
    dates, events = ["20240102", "20240103"], [1, 2]
    make = lambda *v: spark.createDataFrame([(d, e, x) for (d, e), x in zip([(d, e) for d in dates for e in events], v)], "date string, event int, `f|IC` double")
    check = lambda df, **k: pn.strict_frame(df, dates, events, ["f"], ["IC"], **k)
    assert check(make(0.1, 0.2, 0.3, 0.4)).count() == 4
    for bad in (make(0.1, 0.2, 0.3), make(0.1, 0.2, 0.3, float("nan")), make(0.1, 0.2, 0.3, None), make(0.1, 0.2, 0.3, 0.4).toDF("date", "event", "g|IC")):
        with pytest.raises(ValueError):
            check(bad)
    assert check(make(0.1, 0.2, 0.3, None), allow_partial=True).count() == 4


def test_direction_chain_and_best_event(spark):
    cells = spark.createDataFrame([("a", "u", "l", 1), ("a", "u", "l", 2), ("b", "u", "l", 1), ("c", "u", "l", 1)], "factor string, universe string, label string, event int")
    own = spark.createDataFrame([("a", "u", "l", 1, "negative")], "factor string, universe string, label string, event int, direction string")
    factor = spark.createDataFrame([("a", "positive"), ("b", "negative")], "factor string, direction string")
    got = {(r.factor, r.event): r.direction for r in sr.chain_directions(cells, own, factor).collect()}
    assert got == {("a", 1): "negative", ("a", 2): "positive", ("b", 1): "negative", ("c", 1): "positive"}
    best = spark.createDataFrame([("a", "u", "l", 2)], "factor string, universe string, label string, best_event int")
    assert sorted((r.factor, r.event) for r in sr.best_event_only(cells, best).collect()) == [("a", 2), ("b", 1), ("c", 1)]
