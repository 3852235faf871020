"""Order reconstruction: scenario list, invariants, and stream against batch."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom import fixtures as fx
from tickloom.operators import lifecycle as lc
from tickloom.streaming import lifecycle as sl

DAY, SYM = "20220222", "600000"
ORDERS = "date string, symbol string, local_us long, exch_ms long, channel int, serial long, market int, order_type string, bsflag string, order_index long, orderorino long, biz_index long, price long, volume long"
TRADES = "date string, symbol string, local_us long, exch_ms long, channel int, serial long, market int, bsflag string, trade_type string, price long, volume long, amount long, buy_id long, sell_id long, trade_index long, biz_index long"
OPEN = 34_200_000


def sh_order(oid, kind, side, qty, biz, ms, local=None, n=0):
    return (DAY, SYM, (local or ms) * 1000, ms, 2, n, 49, kind, side, 900_000 + n, oid, biz, 100_000, qty)


def sz_order(oid, side, qty, ms):
    return (DAY, SYM, ms * 1000, ms, 2, oid, 48, "0", side, oid, 0, 0, 100_000, qty)


def trade(market, buy, sell, side, qty, biz, ms, kind="0", local=None, n=0):
    return (DAY, SYM, (local or ms) * 1000, ms, 1, n or biz, market, side, kind, 100_000, qty, qty * 10, buy, sell, biz, biz)


def run(spark, orders, trades):
    o = spark.createDataFrame(orders, ORDERS)
    t = spark.createDataFrame(trades, TRADES) if trades else spark.createDataFrame([], TRADES)
    r = lc.reconstruct(t, o)
    return {x.order_id: x for x in r["finals"].collect()}, r


def test_shanghai_fills_before_the_add(spark):
    fills = [trade(49, 10001, 9001, "B", 300, 100, OPEN), trade(49, 10001, 9002, "B", 200, 101, OPEN + 1000)]
    for local in (OPEN + 2000, OPEN - 1000):  # in order, and inverted arrival
        f, _ = run(spark, [sh_order(10001, "A", "B", 500, 102, OPEN + 2000, local)], fills)
        o = f[10001]
        assert (o.original, o.immediate, o.passive, o.rest_at_close, o.estimated) == (1000, 500, 0, 500, False)


def test_shanghai_without_an_add(spark):
    f, _ = run(spark, [], [trade(49, 20001, 9101, "B", 300, 200, OPEN), trade(49, 20001, 9102, "B", 700, 201, OPEN + 1000)])
    assert (f[20001].original, f[20001].close_reason, f[20001].estimated) == (1000, "FullyFilledOnArrival", True)
    assert 9101 not in f  # passive fragments alone make no order


def test_passive_fill_and_delete_after_confirmation(spark):
    orders = [sh_order(10001, "A", "B", 500, 102, OPEN), sh_order(10001, "D", "B", 300, 104, OPEN + 600_000, n=5)]
    f, r = run(spark, orders, [trade(49, 10001, 30001, "S", 200, 103, OPEN + 60_000)])
    o = f[10001]
    assert (o.original, o.passive, o.cancelled, o.rest_at_close, o.close_reason) == (500, 200, 300, 0, "Cancelled")
    assert lc.conservation_violations(r["finals"]).count() == 0


def test_delayed_predecessor_within_the_watermark(spark):
    # the add arrives 11.741 s before its immediate fill
    f, _ = run(
        spark,
        [sh_order(608613, "A", "B", 600, 800920, OPEN + 15_420)],
        [trade(49, 608613, 605368, "B", 900, 800919, OPEN + 15_420, local=OPEN + 15_420 + 11_741)],
    )
    assert (f[608613].original, f[608613].immediate, f[608613].rest_at_close) == (1500, 900, 600)


def test_shenzhen_trade_cancel_and_pair(spark):
    orders = [sz_order(7001, "B", 1000, OPEN), sz_order(8001, "S", 1000, OPEN)]
    f, r = run(spark, orders, [trade(48, 7001, 8001, "B", 300, 1, OPEN + 1000), trade(48, 7001, 0, "N", 700, 2, OPEN + 2000, kind="C")])
    assert (f[7001].immediate, f[7001].cancelled, f[7001].close_reason) == (300, 700, "Cancelled")
    assert (f[8001].passive, f[8001].rest_at_close, f[8001].close_reason) == (300, 700, "SessionClose")
    pair = r["pairs"].filter("resolved").collect()
    assert len(pair) == 1 and pair[0].buy.original == 1000 and pair[0].aggressor == 1 and pair[0].source == "BsFlag"


def test_pair_waits_for_the_incoming_parent(spark):
    orders = [sh_order(51001, "A", "S", 3000, 50, OPEN), sh_order(52001, "A", "B", 500, 101, OPEN + 61_000, n=1)]
    _, r = run(spark, orders, [trade(49, 52001, 51001, "B", 500, 100, OPEN + 60_000)])
    p = r["pairs"].filter("resolved").collect()[0]
    assert (p.buy.original, p.sell.original, p.resolved_ms) == (1000, 3000, OPEN + 81_000)


def test_records_after_the_close_are_late(spark):
    orders = [sz_order(1, "B", 100, OPEN), sz_order(2, "S", 500, OPEN)]
    _, r = run(spark, orders, [trade(48, 1, 2, "B", 100, 1, OPEN + 1000), trade(48, 1, 2, "B", 50, 2, OPEN + 2000)])
    assert r["states"].filter("late").count() == 1
    assert r["pairs"].filter("NOT resolved").count() == 1


def test_price_is_rounded_half_away_from_zero(spark):
    from tickloom.functions.scalar import average_price_x1e4

    df = spark.createDataFrame([(857, 100), (1, 3), (-1, 8), (5, 0)], "a long, v long")
    got = [r[0] for r in df.select(average_price_x1e4(F.col("a"), F.col("v"))).collect()]
    assert got == [85700, 3333, -1250, 0]


def play(spark, folder, parts, schema):
    """Micro-batches of records through both stateful streams; their sinks read back."""
    (folder / "in").mkdir()
    for i, part in enumerate(parts):
        file = folder / "in" / f"{i:03d}.json"
        file.write_text("\n".join(json.dumps(r) for r in part))
        os.utime(file, (1_700_000_000 + i, 1_700_000_000 + i))
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder / "in"))

    def sink(stream, name):
        q = stream.writeStream.format("parquet").option("path", str(folder / name)).option("checkpointLocation", str(folder / f"{name}-state")).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.schema(stream.schema).parquet(str(folder / name))

    events = sink(sl.lifecycle_stream(raw.filter("what = 't'"), raw.filter("what = 'o'"), buckets=3), "events")
    again = spark.readStream.schema(events.schema).parquet(str(folder / "events"))
    return events, sink(sl.pair_stream(again, buckets=2), "pairs")


@pytest.mark.parametrize("slices", [1, 5, 50])
def test_stream_equals_batch(spark, slices, tmp_path):
    """The stand-in feed, cut into arrival-ordered micro-batches, ends in the batch's orders and pairs."""
    sf = "/root/testdata/sf0.001"
    day = "date = '20240103'"
    t, o = fx.lifecycle_trades(spark, sf).filter(day), fx.lifecycle_orders(spark, sf).filter(day)
    both = t.select(F.lit("t").alias("what"), "*").unionByName(o.select(F.lit("o").alias("what"), "*"), allowMissingColumns=True)
    rows = sorted((r.asDict() for r in both.collect()), key=lambda r: (r["local_us"], r["exch_ms"], r["channel"], r["serial"]))
    # a last record past the close moves the watermark over it
    tail = dict(rows[-1]) | {"what": "o", "symbol": -1, "exch_ms": 60_000_000, "local_us": 60_000_000_000, "order_type": "A", "market": 48, "order_index": 1, "orderorino": 1, "bsflag": "B", "volume": 1}
    parts = [rows[i * len(rows) // slices : (i + 1) * len(rows) // slices] for i in range(slices)] + [[tail]]
    events, pairs = play(spark, tmp_path, parts, both.schema)
    fields = ("original", "immediate", "passive", "cancelled", "estimated", "close_reason")
    closed = events.filter("event = 'Closed' AND symbol >= 0").collect()
    job = lc.reconstruct(t, o)
    got = [((r.symbol, r.order_id), tuple(r[f] for f in fields)) for r in closed if r.original > 0]
    want = {(r.symbol, r.order_id): tuple(r[f] for f in fields) for r in job["finals"].collect() if r.original > 0}
    assert sorted(got) == sorted(want.items()) and len(got) > 10
    key = ("symbol", "local_us", "serial", "buy_id", "sell_id")
    told = {tuple(r[k] for k in key): (r.resolved, r.resolved_ms) for r in pairs.collect()}
    assert told == {tuple(r[k] for k in key): (r.resolved, r.resolved_ms) for r in job["pairs"].collect()} and len(told) == pairs.count()
    stood = lambda p: {tuple(r[k] for k in key): (r.resolved_ms, tuple(r.buy), tuple(r.sell)) for r in p.collect()}
    assert stood(sl.resolved_pairs(pairs, events)) == stood(lc.pair_snapshots(job["pairs"], job["events"])) != {}


def test_a_bucket_moves_all_its_orders_at_once():
    """Legs of many orders in one call, or one by one, leave the same orders, waiting fills and events."""
    rng = np.random.default_rng(8)
    n = 600
    legs = np.zeros(n, sl.LEG_T)
    legs["local_us"], legs["serial"] = np.sort(rng.integers(34_200_000, 34_400_000, n)) * 1000, np.arange(n)
    legs["exch_ms"] = legs["local_us"] // 1000 - rng.integers(0, 3000, n)
    legs["order_id"], legs["kind"], legs["qty"], legs["biz"] = rng.integers(1, 60, n), rng.choice([0, 1, 3, 3, 3], n), rng.integers(1, 90, n), rng.permutation(n)
    legs["market"], legs["incoming"], legs["paired"] = 48 + legs["order_id"] % 2, rng.random(n) < 0.4, rng.random(n) < 0.5
    whole, single, cut = sl.Bucket(), sl.Bucket(), sl.Bucket()
    whole.advance(legs)
    for leg in legs:
        single.advance(np.array([leg]))
    for part in np.array_split(legs, 7):  # through packed state
        kept, cut = cut.out, sl.Bucket(*cut.packed())
        cut.out = kept
        cut.advance(part)
    for b in (whole, single, cut):
        b.expire(34_300_000)
        b.close()
    rows = [sorted(map(tuple, np.concatenate(b.out).tolist())) for b in (whole, single, cut)]
    assert rows[0] == rows[1] == rows[2] and len(rows[0]) > 200 and len(whole.halves) == 0
    assert (whole.orders == single.orders).all() and (whole.orders["rest"] == 0).all()


def test_legs_reach_the_buckets_packed(spark):
    """A bucket gets a row for many legs, and all of them; a chunk ends a row, nulls of a symbol stay apart."""
    n = 3000
    legs = spark.range(0, n, 1, 2).select(
        F.lit(DAY).alias("date"), F.when(F.col("id") % 10 > 0, F.col("id") % 2).alias("symbol"), F.col("id").alias("event_ms"),
        *[(F.col("id") % 2 == 0 if sl.LEG_T[c] == bool else F.col("id") if sl.LEG_T[c].itemsize == 8 else F.lit(1)).alias(c) for c in sl.LEG_T.names],
    )
    for chunk, most in ((n, 2 * 3 * 4), (100, 30 * 3 * 4)):
        rows = sl.pack(legs, sl.LEG_T, 4, "order_id", chunk=chunk).collect()
        told = {(r.stock, int(i), bool(i % 2 == 0) == bool(f)) for r in rows for i, f in zip(*(np.frombuffer(r.packed, sl.LEG_T)[c] for c in ("order_id", "incoming")))}
        assert told == {("" if i % 10 == 0 else str(i % 2), i, True) for i in range(n)} and len(rows) <= most
        assert all(np.frombuffer(r.packed, sl.LEG_T)["order_id"].max() == r.event_ms for r in rows)
        assert len(rows) < n / 2


def test_only_the_events_asked_for_leave_a_bucket():
    """Closed orders alone are a part of what the bucket says, its state is the same."""
    legs = np.zeros(3, sl.LEG_T)
    legs["local_us"], legs["serial"], legs["order_id"], legs["market"], legs["qty"] = OPEN * 1000, [1, 2, 3], 7, 48, [30, 10, 20]
    legs["kind"] = [sl.ADD, sl.FILL, sl.FILL]
    seen = []
    for wanted in (None, [sl.SHUT]):
        b = sl.Bucket()
        b.advance(legs)
        seen.append((b.frame(DAY, SYM, wanted), b.packed()))
    (whole, kept), (closed, same) = seen
    assert kept == same and len(whole) == 3 and closed.equals(whole[whole["event"] == sl.SHUT].reset_index(drop=True)) and len(closed) == 1


def test_snapshots_do_not_see_what_comes_later(spark):
    """Fills after a pair was resolved leave its parents as they stood."""
    orders = [sz_order(1, "B", 1000, OPEN), sz_order(2, "S", 500, OPEN)]
    early = trade(48, 1, 2, "B", 100, 1, OPEN + 1000)
    later = [trade(48, 1, 2, "B", 150, 2, OPEN + 1000, n=5), trade(48, 1, 2, "S", 250, 3, OPEN + 2000)]
    seen = []
    for trades in ([early], [early, *later]):
        _, r = run(spark, orders, trades)
        p = lc.pair_snapshots(r["pairs"], r["events"]).filter("serial = 1").first()
        seen.append((tuple(p.buy), tuple(p.sell), p.resolved_ms))
    assert seen[0] == seen[1] == ((1000, 100, 0, 0, 900), (500, 0, 100, 0, 400), OPEN + 1000)


def windows_planned(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Window [")


@pytest.mark.parametrize("name", ["replay_audit", "trade_pairs", "pair_mismatch", "execution_shocks"])
def test_orders_are_reconstructed_once(spark, name):
    import __spark_entry__ as e

    once = windows_planned(lc.order_states(lc.order_legs(*(f(spark, "/root/testdata/sf0.001") for f in (fx.lifecycle_trades, fx.lifecycle_orders)))))
    # what is left works on written parents and states
    assert 1 <= once <= 5 and windows_planned(e.queries()[name](spark, "/root/testdata/sf0.001")) <= 5


def test_results_count_the_legs_of_parents_that_never_confirm(spark):
    _, r = run(spark, [], [trade(49, 20001, 9101, "B", 300, 200, OPEN)])
    got = {x.order_id: (x.confirmed, x.legs, x.late_legs) for x in lc.order_results(r["states"]).collect()}
    assert got == {20001: (True, 1, 0), 9101: (False, 1, 0)}
