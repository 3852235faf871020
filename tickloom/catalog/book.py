"""Book expressions evaluated on every quote."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom import fixtures as fx
from tickloom.catalog import query
from tickloom.catalog.families import MICRO_SQL, imbalance_sql, spread_sql
from tickloom.fixtures import r6s
from tickloom.functions import book as bk
from tickloom.functions.scalar import r6
from tickloom.operators.sequence import previous

Q = f"WITH {fx.FEED_SQL}, {fx.QUOTES_SQL}"
KEY = ["date", "symbol", "serial"]


@query(
    "book_snapshot_signals",
    f"""{Q} SELECT date, symbol, serial, {", ".join(f"{r6s(imbalance_sql(v))} AS depth{v}" for v in (0, 1, 4))},
  {r6s(MICRO_SQL)} AS micro, {r6s(spread_sql(0))} AS spread0 FROM quotes""",
)
def book_snapshot_signals(spark, sf_dir):
    """Weighted depth imbalance, microprice displacement and spread conditioning."""
    return bk.with_side_depths(fx.quotes(spark, sf_dir), (0, 1, 4)).select(
        *KEY,
        *[r6(bk.depth_imbalance(v)).alias(f"depth{v}") for v in (0, 1, 4)],
        r6(bk.microprice_displacement()).alias("micro"),
        r6(bk.spread_conditioned(0)).alias("spread0"),
    )


_LV = "list_filter(list_zip({p}, {v}), lambda x: x[1] > 0 AND x[2] > 0)"
BIDS, ASKS = _LV.format(p="bp", v="bv"), _LV.format(p="ap", v="av")

_WALK = """
w_{side} AS (
  SELECT serial, date, symbol, q, sum(take * price) AS notional, sum(take) AS consumed, arg_max(price, lv) FILTER (WHERE take > 0) AS terminal
  FROM (SELECT *, greatest(0.0, least(v, q - coalesce(sum(v) OVER (PARTITION BY date, symbol, serial ORDER BY lv ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS take
    FROM (SELECT date, symbol, serial, q, lv, {levels}[lv][1]::DOUBLE AS price, {levels}[lv][2]::DOUBLE AS v
      FROM (SELECT *, unnest(generate_series(1, len({levels}))) AS lv FROM lv WHERE q IS NOT NULL)))
  GROUP BY date, symbol, serial, q)"""

FRAGILITY_CTE = f"""
lv AS (SELECT *, CASE WHEN len(b) >= 3 AND len(a) >= 3 AND ap[1] > bp[1] THEN {{fraction}}::DOUBLE * least(list_sum(list_transform(b, lambda x: x[2])), list_sum(list_transform(a, lambda x: x[2])))::DOUBLE END AS q
  FROM (SELECT *, {BIDS} AS b, {ASKS} AS a FROM {{source}})),{_WALK.format(side="buy", levels="a")},{_WALK.format(side="sell", levels="b")}"""


def fragility_sql(head, source, fraction, keys="date, symbol, serial"):
    return f"""{head},{FRAGILITY_CTE.format(fraction=fraction, source=source)}"""


@query(
    "depth_fragility",
    fragility_sql(Q, "quotes", 0.25)
    + f""" SELECT lv.date, lv.symbol, lv.serial, len(b) AS bid_levels, len(a) AS ask_levels,
  {r6s("CASE WHEN abs(w_buy.consumed - lv.q) <= 1e-9 AND abs(w_sell.consumed - lv.q) <= 1e-9 THEN w_buy.notional / w_buy.consumed + w_sell.notional / w_sell.consumed - (bp[1] + ap[1]) END")} AS vwap_form,
  {r6s("CASE WHEN abs(w_buy.consumed - lv.q) <= 1e-9 AND abs(w_sell.consumed - lv.q) <= 1e-9 THEN w_buy.terminal / (0.5 * (bp[1] + ap[1]))::DOUBLE - 1 - (1 - w_sell.terminal / (0.5 * (bp[1] + ap[1]))::DOUBLE) END")} AS terminal_form
FROM lv LEFT JOIN w_buy USING (date, symbol, serial) LEFT JOIN w_sell USING (date, symbol, serial)""",
)
def depth_fragility(spark, sf_dir):
    """Walk-the-book sweep cost, by VWAP and by terminal price, with valid-level counts."""
    return bk.with_sweep(fx.quotes(spark, sf_dir), 0.25).select(
        *KEY,
        bk.level_count("bp", "bv").cast("bigint").alias("bid_levels"),
        bk.level_count("ap", "av").cast("bigint").alias("ask_levels"),
        r6(F.col("vwap_fragility")).alias("vwap_form"),
        r6(F.col("terminal_fragility")).alias("terminal_form"),
    )


def ofi_sql(i):
    b = f"CASE WHEN bp[{i}] > pb[1][{i}] THEN bv[{i}] WHEN bp[{i}] < pb[1][{i}] THEN -pb[2][{i}] ELSE bv[{i}] - pb[2][{i}] END"
    a = f"CASE WHEN ap[{i}] < pb[3][{i}] THEN -av[{i}] WHEN ap[{i}] > pb[3][{i}] THEN pb[4][{i}] ELSE pb[4][{i}] - av[{i}] END"
    return f"(({b}) + ({a}))"


OFI_CTE = f"""
lagged AS (SELECT *, lag([bp, bv, ap, av]) OVER (PARTITION BY date, symbol ORDER BY local_us, exch_ms, channel, serial) AS pb FROM quotes),
ofi AS (SELECT date, symbol, local_us, exch_ms, channel, serial, bp, ap, {", ".join(f"{ofi_sql(i)}::DOUBLE AS o{i}" for i in range(1, 11))},
  CASE WHEN list_sum(bv) + list_sum(av) > 1e-9 THEN (list_sum(bv) + list_sum(av)) / 20.0::DOUBLE ELSE 1.0 END AS avg_depth FROM lagged WHERE pb IS NOT NULL)"""


@query(
    "order_flow_imbalance",
    f"""{Q},{OFI_CTE} SELECT date, symbol, serial, o1 AS basic, {r6s("avg_depth")} AS avg_depth,
  {r6s("(" + " + ".join(f"o{i}" for i in range(1, 11)) + ") / avg_depth")} AS agg FROM ofi""",
)
def order_flow_imbalance(spark, sf_dir):
    """Per-level order-flow imbalance against the previous snapshot, level 1 and depth-normalised sum."""
    sides = ("bp", "bv", "ap", "av")
    j = previous(fx.quotes(spark, sf_dir), ["date", "symbol"], {c: f"before_{c}" for c in (*sides, "serial")}).filter(F.col("before_serial").isNotNull())
    flows = bk.level_flow(sides, F.struct(*[F.col(f"before_{c}").alias(c) for c in sides]))
    total = flows[0]
    for f in flows[1:]:
        total = total + f
    return j.select(
        *KEY,
        flows[0].cast("double").alias("basic"),
        r6(bk.average_depth()).alias("avg_depth"),
        r6(total / bk.average_depth()).alias("agg"),
    )


_PROFILE = """
SELECT date, symbol, serial, lv - 1 AS i, len({lv}) AS n, abs({lv}[lv][1] - {lv}[1][1])::DOUBLE AS d, {lv}[lv][2]::DOUBLE AS v
FROM (SELECT *, unnest(generate_series(1, len({lv}))) AS lv FROM (SELECT *, {levels} AS {lv} FROM quotes))"""


@query(
    "depth_profile",
    f"""{Q}, pb AS ({_PROFILE.format(lv="b", levels=BIDS)}),
slope AS (SELECT date, symbol, serial, CASE WHEN count(*) >= 3 THEN (count(*) * sum(d * v) - sum(d) * sum(v)) / nullif(count(*) * sum(d * d) - sum(d) * sum(d), 0) END AS slope FROM pb GROUP BY ALL),
conv AS (SELECT date, symbol, serial, CASE WHEN any_value(n) >= 4 THEN sum(d2) / (any_value(n) - 2) END AS convexity FROM (
  SELECT *, v - 2 * lag(v, 1) OVER w + lag(v, 2) OVER w AS d2 FROM pb WINDOW w AS (PARTITION BY date, symbol, serial ORDER BY i)) GROUP BY ALL),
nf AS (SELECT date, symbol, serial, {", ".join(f"(CASE WHEN {p}[{i}] > 0 AND {v}[{i}] > 0 THEN {v}[{i}] ELSE 0 END)::DOUBLE AS {v}{i}" for p, v in (("bp", "bv"), ("ap", "av")) for i in range(1, 11))} FROM quotes)
SELECT date, symbol, serial, {r6s("slope")} AS bid_slope, {r6s("convexity")} AS bid_convexity,
  {r6s("(" + "+".join(f"bv{i}" for i in (1, 2, 3)) + " - (" + "+".join(f"av{i}" for i in (1, 2, 3)) + ")) / nullif(" + "+".join(f"bv{i}+av{i}" for i in (1, 2, 3)) + ", 0) - (" + "+".join(f"bv{i}" for i in range(4, 11)) + " - (" + "+".join(f"av{i}" for i in range(4, 11)) + ")) / nullif(" + "+".join(f"bv{i}+av{i}" for i in range(4, 11)) + ", 0)")} AS near_far
FROM nf LEFT JOIN slope USING (date, symbol, serial) LEFT JOIN conv USING (date, symbol, serial)""",
)
def depth_profile(spark, sf_dir):
    """Slope, convexity and near-far divergence of the displayed depth."""
    return bk.with_profile(fx.quotes(spark, sf_dir), "bp", "bv", "bid").select(
        *KEY,
        r6(F.col("bid_slope")).alias("bid_slope"),
        r6(F.col("bid_convexity")).alias("bid_convexity"),
        r6(bk.near_far_divergence()).alias("near_far"),
    )
