"""How often a step reads its input and shuffles it, and that the sparing form gives the same results."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_sequence import ticks
from tickloom.operators import cuts as ct
from tickloom.operators import lifecycle as lc
from tickloom.operators import sequence as seq
from tickloom.schema import ORDER_KEY


def plan(df, physical=False):
    q = df._jdf.queryExecution()
    return (q.executedPlan() if physical else q.optimizedPlan()).toString()


def reads(df):
    return len(re.findall(r"Relation \[", plan(df)))


def cuts_of(spark, keys):
    return spark.createDataFrame([("d", 90_000_000 + i, tuple(k)) for i, k in enumerate(keys)], "date string, event bigint, cut struct<local_us bigint, exch_ms bigint, channel bigint, serial bigint>")


def market(spark, tmp_path, books=False):
    """The ticks of two stocks as trades, orders or quotes, from a file."""
    levels = [f"array(CAST(10 AS BIGINT) {o} v % 3) AS {n}" for o, n in (("-", "bp"), ("+", "ap"), ("*", "bv"), ("+", "av"))]
    df = ticks(spark)[0].selectExpr("*", "v AS price", "v AS volume", "v AS last_px", "'0' AS trade_type", "'A' AS order_type", "48S AS market", "'B' AS bsflag", *levels)
    df.write.parquet(f"{tmp_path}/ticks")
    return spark.read.parquet(f"{tmp_path}/ticks")


@pytest.mark.parametrize("n", [1, 3, 8, 11])
@pytest.mark.parametrize("hole", [False, True])
def test_segments_match_a_comparison_of_structs(spark, n, hole):
    r = np.random.default_rng(n)
    key = lambda: [int(v) for v in r.integers(0, 3, 4)]
    cuts = cuts_of(spark, [key() for _ in range(n)])
    rows = [("d", *key(), i) for i in range(300)]
    if hole:
        rows = [(d, a, None if i % 7 == 0 else b, c, e, i) for d, a, b, c, e, i in rows]
    events = spark.createDataFrame(rows, "date string, local_us bigint, exch_ms bigint, channel bigint, serial bigint, i int")
    got = {r["i"]: r["_seg"] for r in ct.assign_segment(events, cuts).collect()}
    plain = events.crossJoin(cuts.select("cut")).groupBy("i").agg(F.count_if(F.col("cut") <= F.struct(*ORDER_KEY)).alias("fired")).collect()
    assert got == {r["i"]: r["fired"] for r in plain if r["fired"] < n}


def test_the_prices_read_each_stream_once(spark, tmp_path):
    from tickloom.plans.demo_family import prices
    from tickloom.plans.registry import Streams

    df = market(spark, tmp_path)
    cuts = cuts_of(spark, [(300_000_000, 0, 0, 0), (10**12, 0, 0, 0)])
    out = prices(Streams(df, df, df), cuts)
    assert reads(out) == 3 and out.filter("quote_count > 0 AND last_trade_time >= 0 AND last_price > 0").count() == out.count() == 4


def test_the_commitment_reads_its_events_once(spark, tmp_path):
    from tickloom.plans.order_flow_family import commitment

    cols = {"order_id": "serial", "estimated": "false", "original": "v", "event_ms": "local_us div 1000", "rest": "v", "side": "int(v % 2)"}
    df = market(spark, tmp_path).selectExpr("*", "v AS order_price", *[f"{e} AS {n}" for n, e in cols.items()])
    assert reads(commitment(df, df, cuts_of(spark, [(10**12, 0, 0, 0)]))) == 2


@pytest.mark.parametrize("crowd", [10, 10**6])
def test_bars_do_not_depend_on_the_crowd(spark, monkeypatch, crowd):
    from tickloom.operators.bars import closing_bars

    monkeypatch.setattr(seq, "CROWD", crowd)
    df = ticks(spark)[0].selectExpr("*", "v AS price", *[f"serial AS {c}" for c in ("total_volume", "total_turnover", "open_interest", "upper_limit", "lower_limit")])
    out = closing_bars(df, 3)
    windows = len(re.findall(r"\bWindow \[", plan(out)))
    assert (windows == 0) == (crowd == 10**6)
    bars = [tuple(r) for r in out.orderBy("symbol", "bar").collect()]
    for symbol in (1, 2):
        own = [b for b in bars if b[1] == symbol]
        assert [b[2] for b in own] == list(range(len(own))) and own
    if crowd == 10:
        monkeypatch.setattr(seq, "CROWD", 10**6)
        assert bars == [tuple(r) for r in closing_bars(df, 3).orderBy("symbol", "bar").collect()]


def test_macd_reads_its_events_once(spark, tmp_path):
    from tickloom.operators.toolbox import macd_at_cuts

    df = seq.number_rows(market(spark, tmp_path), ["date", "symbol"])
    out = macd_at_cuts(df, cuts_of(spark, [(10**12, 0, 0, 0)]), "v")
    assert reads(out) == 1
    for row in out.collect():
        x = [r["v"] for r in df.filter(F.col("symbol") == row["symbol"]).orderBy("seq").collect()]
        velocity = x[1] - x[0]
        for i in range(2, len(x)):
            velocity = 0.2 * (x[i] - x[i - 1]) + 0.8 * velocity
        assert np.isclose(row["smoothed_velocity"], velocity)


def test_the_book_family_reads_its_quotes_once(spark, tmp_path):
    from tickloom.plans.event_families import book_imbalance
    from tickloom.plans.registry import Streams

    df = market(spark, tmp_path)
    assert reads(book_imbalance(Streams(df, df, df), cuts_of(spark, [(10**12, 0, 0, 0)]))) == 1


@pytest.mark.parametrize("marked", [False, True])
def test_events_of_written_states_need_no_window(spark, marked):
    names = ["date", "symbol", "order_id", *ORDER_KEY, "market", "kind", "qty", "amount", "biz_index", "side", "price"]
    rows = [("d", 1, 1, i, i, 0, i, 48, k, q, 0, i, 0, 10, k == "F") for i, (k, q) in enumerate([("A", 10), ("F", 4), ("F", 6)])]
    legs = spark.createDataFrame(rows, ", ".join(f"{n} {'string' if n in ('date', 'kind') else 'int' if n in ('side', 'market') else 'bigint'}" for n in names) + ", incoming boolean")
    states = lc.order_states(legs)
    states = lc.written(lc.with_first_leg(states)) if marked else states
    events = lc.lifecycle_events(states)
    assert sorted(r["event"] for r in events.collect()) == ["Closed", "Confirmed", "RestQtyChanged"]
    assert ("Window [" in plan(events)) != marked
