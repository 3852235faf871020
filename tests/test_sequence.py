"""Prefix operators: one window for a small key, blocks for a crowded one, the same results."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.operators import sequence as seq
from tickloom.operators.toolbox import span_reference

K = ["date", "symbol"]


def ticks(spark, n=400, seed=3):
    r = np.random.default_rng(seed)
    us = np.sort(r.integers(0, 40, n)) * 30_000_000
    pdf = pd.DataFrame({"date": "d", "symbol": r.choice([1, 1, 1, 2], n), "local_us": us, "exch_ms": us // 1000, "channel": 1, "serial": np.arange(n), "v": r.integers(1, 90, n)})
    pdf["w"] = pdf["v"].where(pdf["v"] % 3 > 0)
    return spark.createDataFrame(pdf.sample(frac=1, random_state=1)).withColumn("w", F.when(~F.isnan("w"), F.col("w"))), pdf.sort_values("serial")


def exchanges(df):
    """Shuffles of rows by stock; those of the few cuts of a date are not counted."""
    return len(re.findall(r"Exchange hashpartitioning\(date#\d+, symbol", df._jdf.queryExecution().executedPlan().toString()))


@pytest.mark.parametrize("crowd", [10, 200, 10**6])
def test_prefixes_do_not_depend_on_the_crowd(spark, monkeypatch, crowd):
    monkeypatch.setattr(seq, "CROWD", crowd)
    df, pdf = ticks(spark)
    out = seq.number_rows(df, K)
    out = seq.running(out, K, {"s": ("sum", F.col("v")), "top": ("max", F.col("v"))})
    out = seq.previous(out, K, {"w": "before"})
    got = seq.carry_forward(out, K, F.col("w"), "known").toPandas().sort_values("serial").reset_index(drop=True)
    by = pdf.reset_index(drop=True).groupby("symbol")
    assert (got["seq"] == by.cumcount() + 1).all() and (got["s"] == by["v"].cumsum()).all() and (got["top"] == by["v"].cummax()).all()
    pd.testing.assert_series_equal(got["before"], by["w"].shift(), check_names=False)
    pd.testing.assert_series_equal(got["known"], by["w"].transform(lambda w: w.ffill().shift()), check_names=False)


@pytest.mark.parametrize("crowd", [10, 10**6])
def test_span_reference_does_not_depend_on_the_crowd(spark, monkeypatch, crowd):
    monkeypatch.setattr(seq, "CROWD", crowd)
    df, pdf = ticks(spark)
    got = span_reference(df.drop("w"), "v", 90_000).toPandas().sort_values("serial").reset_index(drop=True)
    for _, own in pdf.groupby("symbol"):
        rows = own.to_dict("records")
        for i, row in enumerate(rows):
            inside = [b["v"] for b in rows[:i] if b["local_us"] // 1000 > rows[i - 1]["local_us"] // 1000 - 90_000]
            g = got[got["serial"] == row["serial"]].iloc[0]
            assert g["ref_n"] == len(inside)
            assert not inside or np.isclose(g["ref_mean"], np.mean(inside))
            assert len(inside) < 2 or np.isclose(g["ref_std"], np.std(inside, ddof=1))


def test_small_keys_are_shuffled_once(spark):
    df, _ = ticks(spark)
    df = df.repartition(4)
    out = seq.running(seq.previous(df, K, {"v": "before"}), K, {"s": ("sum", F.col("v"))})
    assert exchanges(out) == 1 and exchanges(span_reference(df, "v", 90_000)) == 1


def quotes(spark, n=60):
    r = np.random.default_rng(5)
    side = lambda base, step: [[int(base + step * i) for i in range(10)] for _ in range(n)]
    pdf = pd.DataFrame({"date": "d", "symbol": r.choice([1, 2], n), "local_us": np.arange(n) * 1_000_000, "exch_ms": np.arange(n) * 1000, "channel": 0, "serial": np.arange(n), "bp": side(1000, -1), "ap": side(1002, 1)})
    for c in ("bv", "av"):
        pdf[c] = [list(map(int, r.integers(1, 90, 10))) for _ in range(n)]
    return spark.createDataFrame(pdf).repartition(4)


CUT = "SELECT 'd' AS date, 100L AS event, struct({0}L AS local_us, {1}L AS exch_ms, 0L AS channel, 0L AS serial) AS cut"


def test_components_take_one_pass_over_the_books(spark):
    from tickloom.operators import ofi

    cuts = spark.sql(CUT.format(45_000_000, 45_000))
    assert exchanges(ofi.components_at_cuts(ofi.flow_series(quotes(spark)), cuts, 2)) == 1


def test_states_of_small_keys_take_one_shuffle_and_no_join(spark):
    from tickloom.operators import ofi

    states = ofi.state_series(ofi.state_inputs(ofi.flow_series(quotes(spark))))
    assert exchanges(states) == 1 and "Join" not in states._jdf.queryExecution().executedPlan().toString()


def test_last_rows_at_cuts_do_not_depend_on_the_crowd(spark):
    from tickloom.operators.cuts import last_at_cuts

    df, _ = ticks(spark)
    cuts = spark.sql(CUT.format(400_000_000, 400_000) + " UNION ALL " + CUT.format(900_000_000, 900_000).replace("100L", "200L"))
    got = [sorted(map(tuple, last_at_cuts(df, cuts, 7, ["v"], crowd=c).select("symbol", "event", "serial", "v", "rn").collect())) for c in (None, [])]
    assert got[0] == got[1] and len(got[0]) == 28
    assert exchanges(last_at_cuts(df, cuts, 7, ["v"], crowd=[])) == 1
