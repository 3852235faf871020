"""Parent-order factors and the demonstration family."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom import fixtures as fx
from tickloom.catalog import query
from tickloom.catalog.book import OFI_CTE
from tickloom.catalog.lifecycle import LIFE
from tickloom.fixtures import r6s
from tickloom.functions.scalar import r6
from tickloom.operators import lifecycle as lc
from tickloom.operators.cuts import market_cuts
from tickloom.operators.sequence import crowded
from tickloom.plans import order_flow_family as of
from tickloom.plans.registry import FAMILIES, KEYS
from tickloom.schema import STOCK_DAY
from tickloom.session import cut_lineage, written

LC = f"{LIFE}, {fx.LIFECYCLE_CUTS_SQL}"
C = of.COLUMNS


def setup(spark, sf_dir):
    s = fx.lifecycle_streams(spark, sf_dir)
    return s, market_cuts(s.present())


def rounded(df, names):
    return df.select(*KEYS, *[r6(F.col(c)).alias(c) for c in names])


_XP = """xp AS (SELECT date, symbol, resolved_ms * 1000 AS local_us, exch_ms, channel, serial, agg, volume, ln(1 + b_orig) - ln(1 + s_orig) AS z, CASE WHEN agg = 1 THEN buy_id ELSE sell_id END AS parent
  FROM pr WHERE resolved AND source = 'BsFlag' AND NOT b_est AND NOT s_est AND b_orig > 0 AND s_orig > 0)"""


@query(
    "pair_mismatch",
    f"""{LC}, {_XP}, s AS (SELECT x.*, c.event, row_number() OVER (PARTITION BY x.date, x.symbol, c.event ORDER BY x.local_us DESC, x.exch_ms DESC, x.channel DESC, x.serial DESC) AS rn
  FROM xp x JOIN cuts c ON x.date = c.date AND (x.local_us, x.exch_ms, x.channel, x.serial) < c.cut)
SELECT date, symbol, event, {r6s("sum(agg * z * greatest(1, volume)) / sum(greatest(1, volume))")} AS {C[2]}, {r6s("avg(agg * z)")} AS {C[3]} FROM s WHERE rn <= 4096 GROUP BY ALL""",
)
def pair_mismatch(spark, sf_dir):
    """Size mismatch of the two parents of recent trades."""
    s, cuts = setup(spark, sf_dir)
    pairs = lc.day_pairs(s.trades, s.orders)
    return rounded(of.pair_mismatch(pairs, cuts), C[2:4])


_EVT = """le AS (
  SELECT date, symbol, order_id, confirm_ms AS event_ms, 0 AS rank, side, original, imm0 AS immediate, pas0 AS passive, can0 AS cancelled, rest0 AS rest, estimated FROM cf
  UNION ALL SELECT date, symbol, order_id, confirm_ms, 1, side, original, imm0, pas0, can0, rest0, estimated FROM cf WHERE rest0 = 0 AND market = 49)"""
_LIVE = """lr AS (SELECT k.*, cf.side AS oside, cf.original, cf.estimated, imm0 + sum(CASE WHEN k.market = 48 AND incoming THEN filled ELSE 0 END) OVER w AS immediate, pas0 + sum(CASE WHEN k.market = 48 AND incoming THEN 0 ELSE filled END) OVER w AS passive,
  can0 + sum(CASE WHEN kind <> 'F' THEN applied ELSE 0 END) OVER w AS cancelled FROM (SELECT * EXCLUDE (imm0, pas0, can0, original, estimated, amt0) FROM kp) k JOIN (SELECT date, symbol, order_id, side, imm0, pas0, can0, original, estimated FROM cf) cf USING (date, symbol, order_id)
  WINDOW w AS (PARTITION BY date, symbol, order_id ORDER BY local_us, exch_ms, channel, serial, k.side ROWS UNBOUNDED PRECEDING))"""


@query(
    "cancel_execution_divergence",
    f"""{LC}, cd AS (SELECT date, symbol, confirm_ms AS ms, side, can0 AS d FROM cf WHERE can0 > 0 AND NOT estimated AND original > 0 UNION ALL
  SELECT k.date, k.symbol, k.local_us // 1000, cf.side, applied FROM kp k JOIN cf USING (date, symbol, order_id) WHERE kind <> 'F' AND applied > 0 AND NOT cf.estimated AND cf.original > 0),
cw AS (SELECT cd.date, symbol, event, sum(d) FILTER (WHERE side = 0) AS cb, sum(d) FILTER (WHERE side = 1) AS ca FROM cd JOIN cuts c ON cd.date = c.date AND ms * 1000 < c.cut[1] AND ms > event_ms - 900000 GROUP BY ALL),
ew AS (SELECT t.date, symbol, event, sum(volume) FILTER (WHERE bsflag = 'B') AS eb, sum(volume) FILTER (WHERE bsflag = 'S') AS es FROM lt t JOIN cuts c ON t.date = c.date AND (t.local_us, t.exch_ms, t.channel, t.serial) < c.cut AND t.exch_ms > event_ms - 900000
  WHERE trade_type <> 'C' AND bsflag IN ('B', 'S') GROUP BY ALL),
j AS (SELECT date, symbol, event, coalesce(ca, 0) AS ca, coalesce(cb, 0) AS cb, coalesce(eb, 0) AS eb, coalesce(es, 0) AS es FROM cw JOIN ew USING (date, symbol, event))
SELECT date, symbol, event, {r6s("(ca - cb) / (ca + cb + 1e-9) - (eb - es) / (eb + es + 1e-9)")} AS {C[6]}, {r6s("((ca - cb) - (eb - es)) / (ca + cb + eb + es + 1e-9)")} AS {C[7]} FROM j WHERE ca + cb > 0 AND eb + es > 0""",
)
def cancel_execution_divergence(spark, sf_dir):
    """Withdrawn against aggressively executed volume of the trailing quarter hour."""
    s, cuts = setup(spark, sf_dir)
    events = lc.reconstruct(s.trades, s.orders)["events"]
    return rounded(of.cancel_execution(events, s.trades, cuts), C[6:8])


@query(
    "run_surprisal",
    f"""{LC}, {_XP}, f AS (SELECT date, symbol, parent, min((local_us, exch_ms, channel, serial, agg)) AS k FROM xp GROUP BY ALL),
s AS (SELECT date, symbol, k, k[5] AS side, lag(k[5]) OVER w AS prev, row_number() OVER w AS n FROM (SELECT date, symbol, [k[1], k[2], k[3], k[4], k[5]] AS k FROM f) WINDOW w AS (PARTITION BY date, symbol ORDER BY k)),
c AS (SELECT *, n - 1 AS pn, coalesce(sum(CASE WHEN side = 1 THEN 1 ELSE 0 END) OVER w, 0) AS pb, coalesce(sum(CASE WHEN prev = 1 THEN 1 ELSE 0 END) OVER w, 0) AS fu, coalesce(sum(CASE WHEN prev = -1 THEN 1 ELSE 0 END) OVER w, 0) AS fd,
  coalesce(sum(CASE WHEN prev = 1 AND side = 1 THEN 1 ELSE 0 END) OVER w, 0) AS uu, coalesce(sum(CASE WHEN prev = -1 AND side = -1 THEN 1 ELSE 0 END) OVER w, 0) AS dd FROM s WINDOW w AS (PARTITION BY date, symbol ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
p AS (SELECT *, (CASE WHEN side = 1 THEN pb ELSE pn - pb END + 1.0::DOUBLE) / (pn + 2) AS marg,
  (CASE WHEN prev = 1 THEN CASE WHEN side = 1 THEN uu ELSE fu - uu END + 1.0::DOUBLE ELSE CASE WHEN side = -1 THEN dd ELSE fd - dd END + 1.0::DOUBLE END) / (CASE WHEN prev = 1 THEN fu ELSE fd END + 2) AS mk FROM c),
q AS (SELECT *, -ln(marg) AS sp, -ln(CASE WHEN prev IS NULL THEN marg ELSE mk END) AS sm, sum(CASE WHEN prev IS NULL OR prev <> side THEN 1 ELSE 0 END) OVER (PARTITION BY date, symbol ORDER BY k ROWS UNBOUNDED PRECEDING) AS isl FROM p),
r AS (SELECT *, sum(sm) OVER w AS rm, sum(sp) OVER w AS rp, count(*) OVER w AS len FROM q WINDOW w AS (PARTITION BY date, symbol, isl ORDER BY k ROWS UNBOUNDED PRECEDING)),
z AS (SELECT r.*, c2.event, row_number() OVER (PARTITION BY r.date, r.symbol, c2.event ORDER BY k DESC) AS rn FROM r JOIN (SELECT date, event, [cut[1], cut[2], cut[3], cut[4]] AS cut FROM cuts) c2 ON r.date = c2.date AND r.k[1:4] < c2.cut)
SELECT date, symbol, event, {r6s("CASE WHEN n > 30 AND len >= 2 THEN side * rm / sqrt(len) END")} AS {C[10]}, {r6s("CASE WHEN n > 30 AND len >= 2 THEN side * rp / sqrt(len) END")} AS {C[11]} FROM z WHERE rn = 1""",
)
def run_surprisal(spark, sf_dir):
    """Surprise of the current same-side run of distinct aggressor parents."""
    s, cuts = setup(spark, sf_dir)
    pairs = lc.day_pairs(s.trades, s.orders)
    return rounded(of.run_surprisal(pairs, cut_lineage(cuts)), C[10:12])


@query(
    "resting_commitment",
    f"""{LC}, {_EVT}, {_LIVE},
al AS (SELECT date, symbol, order_id, event_ms, exch_ms, channel, serial, side, rest FROM (SELECT cf.date, cf.symbol, cf.order_id, confirm_ms AS event_ms, side, rest0 AS rest, exch_ms, channel, serial FROM cf JOIN (SELECT date, symbol, order_id, min((local_us, exch_ms, channel, serial, side)) AS k FROM ph GROUP BY ALL) f USING (date, symbol, order_id), LATERAL (SELECT k[2] AS exch_ms, k[3] AS channel, k[4] AS serial) WHERE NOT estimated AND original > 0)
  UNION ALL SELECT date, symbol, order_id, local_us // 1000, exch_ms, channel, serial, oside, rest FROM lr WHERE NOT estimated AND original > 0),
bo AS (SELECT date, symbol, order_id, min(event_ms) AS born FROM al GROUP BY ALL),
st AS (SELECT a.*, c.event, c.event_ms AS t, row_number() OVER (PARTITION BY a.date, a.symbol, a.order_id, c.event ORDER BY a.event_ms DESC, a.exch_ms DESC, a.channel DESC, a.serial DESC) AS rn FROM al a JOIN cuts c ON a.date = c.date AND (a.event_ms * 1000, a.exch_ms, a.channel, a.serial) < c.cut),
qs AS (SELECT q.*, c.event, row_number() OVER (PARTITION BY q.date, q.symbol, c.event ORDER BY q.local_us DESC, q.exch_ms DESC, q.channel DESC, q.serial DESC) AS rn FROM lq q JOIN cuts c ON q.date = c.date AND (q.local_us, q.exch_ms, q.channel, q.serial) < c.cut),
j AS (SELECT st.date, st.symbol, st.event, st.side, st.rest * exp(-least(abs(100000 + (order_id - 1) % 40 - 0.5 * (bp[1] + ap[1])) / (ap[1] - bp[1]), 20) / 4) AS w, ln(1 + greatest(0, (t - born) / 1000.0::DOUBLE) / 10) AS g
  FROM st JOIN bo USING (date, symbol, order_id) JOIN qs ON qs.date = st.date AND qs.symbol = st.symbol AND qs.event = st.event AND qs.rn = 1 WHERE st.rn = 1 AND rest > 0 AND 100000 + (order_id - 1) % 40 BETWEEN list_min(bp) AND list_max(ap)),
g AS (SELECT date, symbol, event, sum(CASE WHEN side = 0 THEN w ELSE -w END) / sum(w) AS na, sum(CASE WHEN side = 0 THEN w * g ELSE -w * g END) / nullif(sum(w * g), 0) AS ag, count(*) FILTER (WHERE side = 0) AS b, count(*) FILTER (WHERE side = 1) AS a FROM j GROUP BY ALL)
SELECT date, symbol, event, {r6s("CASE WHEN a >= 2 AND b >= 2 THEN ag END")} AS {C[4]}, {r6s("CASE WHEN a >= 2 AND b >= 2 THEN na END")} AS {C[5]} FROM g""",
)
def resting_commitment(spark, sf_dir):
    """Age- and distance-weighted share of the resting parent orders."""
    s, cuts = setup(spark, sf_dir)
    events = lc.reconstruct(s.trades, s.orders)["events"]
    return rounded(of.commitment(events, s.quotes, cuts), C[4:6])


def _shock_sql(least):
    return f"""sh AS (SELECT * FROM (SELECT date, symbol, local_us, exch_ms, channel, serial, volume, bsflag, count(*) OVER w AS n, quantile_cont(volume, 0.9) OVER w AS q FROM lt WHERE trade_type <> 'C' AND volume > 0 AND bsflag IN ('B', 'S')
  WINDOW w AS (PARTITION BY date, symbol ORDER BY local_us, exch_ms, channel, serial ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE n >= {least} AND volume > q + 1e-9),
sq AS (SELECT sh.*, CASE WHEN bsflag = 'B' THEN lq.av[1] ELSE lq.bv[1] END AS touch, row_number() OVER (PARTITION BY sh.date, sh.symbol, sh.local_us, sh.exch_ms, sh.channel, sh.serial ORDER BY lq.local_us DESC, lq.exch_ms DESC, lq.channel DESC, lq.serial DESC) AS rn
  FROM sh JOIN lq ON sh.date = lq.date AND sh.symbol = lq.symbol AND (lq.local_us, lq.exch_ms, lq.channel, lq.serial) < (sh.local_us, sh.exch_ms, sh.channel, sh.serial)),
sx AS (SELECT date, symbol, local_us, exch_ms, channel, serial, volume, local_us // 1000 AS ms, CASE WHEN bsflag = 'B' THEN 1 ELSE -1 END AS sign FROM sq WHERE rn = 1 AND touch > 0 AND volume >= 0.25 * touch),
so AS (SELECT sx.date, sx.symbol, sx.local_us, sx.exch_ms, sx.channel, sx.serial, sum(rest0) AS added FROM sx JOIN cf ON sx.date = cf.date AND sx.symbol = cf.symbol AND NOT estimated AND rest0 > 0 AND (side = 1) = (sign = 1) AND confirm_ms > ms AND confirm_ms <= ms + 30000 GROUP BY ALL),
sd AS (SELECT sx.date, sx.symbol, sx.local_us, sx.exch_ms, sx.channel, sx.serial, arg_max(CASE WHEN sign = 1 THEN list_sum(av) ELSE list_sum(bv) END, (q.local_us // 1000, q.serial)) - arg_min(CASE WHEN sign = 1 THEN list_sum(av) ELSE list_sum(bv) END, (q.local_us // 1000, q.serial)) AS refilled
  FROM sx JOIN lq q ON sx.date = q.date AND sx.symbol = q.symbol AND q.local_us // 1000 > ms AND q.local_us // 1000 <= ms + 30000 GROUP BY ALL),
sr AS (SELECT sx.*, greatest(-5.0, least(5.0, sign * coalesce(added, 0) / (volume + 1e-9))) AS o, CASE WHEN refilled IS NOT NULL THEN greatest(-5.0, least(5.0, sign * greatest(0, refilled) / (volume + 1e-9))) END AS v
  FROM sx LEFT JOIN so USING (date, symbol, local_us, exch_ms, channel, serial) LEFT JOIN sd USING (date, symbol, local_us, exch_ms, channel, serial))"""


#: flagged trades before a shock
FEW = 30


@query("execution_shocks", f"""{LC}, {_shock_sql(FEW)} SELECT date, symbol, local_us, exch_ms, channel, serial, volume, sign, {r6s("o")} AS order_response, {r6s("v")} AS quote_response FROM sr""")
def execution_shocks(spark, sf_dir):
    """Outsized trades with what refilled the touch within 30 seconds."""
    s, _ = setup(spark, sf_dir)
    rows = of.shock_responses(s.trades, s.quotes, lc.reconstruct(s.trades, s.orders)["finals"], FEW)
    return rows.withColumns({c: r6(F.col(c)) for c in ("order_response", "quote_response")})


@query(
    "shock_replenishment",
    f"""{LC}, {_shock_sql(FEW)} SELECT sr.date, symbol, event, {r6s("sum(o) / count(*)")} AS {C[8]}, {r6s("avg(v)")} AS {C[9]}
FROM sr JOIN cuts c ON sr.date = c.date AND (local_us + 30000000, exch_ms, channel, serial) < c.cut GROUP BY ALL""",
)
def shock_replenishment(spark, sf_dir):
    """Mean response to the matured shocks at every checkpoint."""
    s, cuts = setup(spark, sf_dir)
    return rounded(of.replenishment(s.trades, s.quotes, lc.reconstruct(s.trades, s.orders)["finals"], cuts, FEW), C[8:10])


@query("market_microstructure_family")
def market_microstructure_family(spark, sf_dir):
    """The twelve parent-order and book columns with readiness reasons."""
    s, cuts = setup(spark, sf_dir)
    panel = FAMILIES["market_microstructure"].build(s, cuts)
    return panel.select(*KEYS, *[r6(F.col(c)).alias(c) for c in C], *[F.col(f"reason_{c}").cast("int").alias(f"reason_{c}") for c in C])


# --- demonstration family ---------------------------------------------------------------------

from tickloom.operators import histogram as hg  # noqa: E402
from tickloom.operators import ofi  # noqa: E402
from tickloom.plans import demo_family as df_  # noqa: E402

W = f"WITH {fx.MARKET_SQL}"
#: spans in seconds fitting the stand-in's minute-a-day clock
SPANS = {"short": 3600, "mid": 10800, "volume": 7200, "chip": 7200}


def seen_sql(table, where="true", name="seen"):
    return f"""{name} AS (SELECT t.*, c.event, c.event_ms, row_number() OVER (PARTITION BY t.date, t.symbol, c.event ORDER BY t.local_us DESC, t.exch_ms DESC, t.channel DESC, t.serial DESC) AS rn,
  count(*) OVER (PARTITION BY t.date, t.symbol, c.event) AS n FROM {table} t JOIN cuts c ON t.date = c.date AND (t.local_us, t.exch_ms, t.channel, t.serial) < c.cut WHERE {where})"""


def feed_setup(spark, sf_dir):
    s = fx.streams(spark, sf_dir)
    return s, market_cuts(s.present())


_PK = "((exch_ms // 3600000) * 10000000 + (exch_ms // 60000 % 60) * 100000 + (exch_ms // 1000 % 60) * 1000 + exch_ms % 1000)"
_MARKS = """marks AS (SELECT date, symbol, local_us, exch_ms, channel, serial, last_px::DOUBLE AS p FROM quotes UNION ALL SELECT date, symbol, local_us, exch_ms, channel, serial, price::DOUBLE FROM trades WHERE trade_type <> 'C')"""


@query(
    "demo_prices",
    f"""{W}, {_MARKS}, {seen_sql("quotes", name="q")}, {seen_sql("trades", name="t")}, {seen_sql("ord", name="o")}, {seen_sql("marks", name="m")}, {seen_sql("quotes", "t.bp[1] > 0 AND t.ap[1] > 0", "mq")},
mi AS (SELECT date, symbol, event, 0.5::DOUBLE * (bp[1] + ap[1]) AS mid_price FROM mq WHERE rn = 1),
qa AS (SELECT date, symbol, event, {_PK} AS last_quote_time, n AS quote_count, bp[1]::DOUBLE AS best_bid, ap[1]::DOUBLE AS best_ask FROM q WHERE rn = 1),
ta AS (SELECT date, symbol, event, max({_PK}) FILTER (WHERE rn = 1) AS last_trade_time, count(*) FILTER (WHERE trade_type <> 'C') AS trade_count FROM t GROUP BY ALL),
oa AS (SELECT date, symbol, event, max({_PK}) FILTER (WHERE rn = 1) AS last_order_time, count(*) FILTER (WHERE NOT (market = 49 AND order_type = 'D')) AS order_count FROM o GROUP BY ALL),
ma AS (SELECT date, symbol, event, p AS last_price FROM m WHERE rn = 1)
SELECT date, symbol, event, coalesce(last_quote_time, 0) AS last_quote_time, coalesce(last_trade_time, 0) AS last_trade_time, coalesce(last_order_time, 0) AS last_order_time, coalesce(quote_count, 0) AS quote_count, coalesce(trade_count, 0) AS trade_count,
  coalesce(order_count, 0) AS order_count, coalesce(last_price, 0) AS last_price, coalesce(best_bid, 0) AS best_bid, coalesce(best_ask, 0) AS best_ask, coalesce(best_ask - best_bid, 0) AS spread, coalesce(mid_price, 0) AS mid_price, event::DOUBLE AS "timestamp"
FROM qa FULL JOIN ta USING (date, symbol, event) FULL JOIN oa USING (date, symbol, event) FULL JOIN ma USING (date, symbol, event) FULL JOIN mi USING (date, symbol, event)""",
)
def demo_prices(spark, sf_dir):
    """Clocks, counts, last price and touch of the demonstration family."""
    s, cuts = feed_setup(spark, sf_dir)
    p = df_.prices(s, cuts)
    return p.select(*KEYS, "last_quote_time", "last_trade_time", "last_order_time", "quote_count", "trade_count", "order_count", "last_price", "best_bid", "best_ask", "spread", "mid_price", "timestamp")


@query(
    "flow_totals",
    f"""{W}, {seen_sql("trades", "trade_type <> 'C'", "t")}, u AS (
  SELECT date, symbol, local_us, exch_ms, channel, serial, NULL AS bid, NULL AS ask, price, bsflag, volume FROM ord WHERE NOT (market = 49 AND order_type = 'D')
  UNION ALL SELECT date, symbol, local_us, exch_ms, channel, serial, bp[1], ap[1], NULL, NULL, NULL FROM quotes),
a AS (SELECT *, last_value(CASE WHEN bid IS NOT NULL THEN (bid, ask) END IGNORE NULLS) OVER (PARTITION BY date, symbol ORDER BY local_us, exch_ms, channel, serial ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS q FROM u),
od AS (SELECT *, CASE WHEN bsflag = 'B' AND price = q[1] THEN volume WHEN bsflag = 'S' AND price = q[2] THEN -volume ELSE 0 END AS d FROM a WHERE price IS NOT NULL), {seen_sql("od", name="o")},
ta AS (SELECT date, symbol, event, sum(CASE bsflag WHEN 'B' THEN volume WHEN 'S' THEN -volume ELSE 0 END)::DOUBLE AS ofi_trade FROM t GROUP BY ALL), oa AS (SELECT date, symbol, event, sum(d)::DOUBLE AS ofi_order FROM o GROUP BY ALL)
SELECT date, symbol, event, coalesce(ofi_trade, 0) AS ofi_trade, coalesce(ofi_order, 0) AS ofi_order FROM ta FULL JOIN oa USING (date, symbol, event)""",
)
def flow_totals(spark, sf_dir):
    """Day-to-date trade flow and touch-order flow."""
    s, cuts = feed_setup(spark, sf_dir)
    f = df_.flows(s, cuts)
    t = df_.totals_at_cuts(s.trades.filter(df_.counted_trade()), cuts, {"x": ("sum", F.lit(1))})
    o = df_.totals_at_cuts(s.orders.filter(df_.counted_order()), cuts, {"y": ("sum", F.lit(1))})
    keep = t.join(o, KEYS, "full_outer")
    return keep.join(f, KEYS, "left").select(*KEYS, F.coalesce("ofi_trade", F.lit(0.0)).alias("ofi_trade"), F.coalesce("ofi_order", F.lit(0.0)).alias("ofi_order"))


@query(
    "big_trade_at_cuts",
    f"""{W}, {seen_sql("trades", "trade_type <> 'C'")}, r AS (SELECT date, symbol, event, max(volume) FILTER (WHERE rn = 1) AS v, count(*) FILTER (WHERE rn > 1) AS n, avg(volume) FILTER (WHERE rn > 1) AS m, stddev_samp(volume) FILTER (WHERE rn > 1) AS s FROM seen WHERE rn <= 201 GROUP BY ALL)
SELECT date, symbol, event, CASE WHEN n >= 30 AND s > 1e-12 AND v >= m + 2 * s THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS big_trade_flag, {r6s("CASE WHEN n >= 30 AND s > 1e-12 THEN greatest(-8, least(8, (v - m) / s)) ELSE 0 END")} AS big_trade_zscore,
  {r6s("CASE WHEN n >= 30 AND s > 1e-12 THEN m + 2 * s ELSE 0 END")} AS big_trade_threshold FROM r""",
)
def big_trade_at_cuts(spark, sf_dir):
    """Is the last trade large against the two hundred before it."""
    s, cuts = feed_setup(spark, sf_dir)
    b = df_.big_at_cuts(s.trades.filter(df_.counted_trade()), cuts, "big_trade")
    return b.select(*KEYS, "big_trade_flag", *[r6(F.col(c)).alias(c) for c in ("big_trade_zscore", "big_trade_threshold")])


@query(
    "big_order_at_cuts",
    f"""{W}, {seen_sql("ord", "NOT (market = 49 AND order_type = 'D')")}, r AS (SELECT date, symbol, event, max(volume) FILTER (WHERE rn = 1) AS v, count(*) FILTER (WHERE rn > 1) AS n, avg(volume) FILTER (WHERE rn > 1) AS m, stddev_samp(volume) FILTER (WHERE rn > 1) AS s FROM seen WHERE rn <= 201 GROUP BY ALL)
SELECT date, symbol, event, CASE WHEN n >= 30 AND s > 1e-12 AND v >= m + 2 * s THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS big_order_flag, {r6s("CASE WHEN n >= 30 AND s > 1e-12 THEN greatest(-8, least(8, (v - m) / s)) ELSE 0 END")} AS big_order_zscore,
  {r6s("CASE WHEN n >= 30 AND s > 1e-12 THEN m + 2 * s ELSE 0 END")} AS big_order_threshold FROM r""",
)
def big_order_at_cuts(spark, sf_dir):
    """Is the last order large against the two hundred before it."""
    s, cuts = feed_setup(spark, sf_dir)
    b = df_.big_at_cuts(s.orders.filter(df_.counted_order()), cuts, "big_order")
    return b.select(*KEYS, "big_order_flag", *[r6(F.col(c)).alias(c) for c in ("big_order_zscore", "big_order_threshold")])


@query(
    "id_statistics",
    f"""{W}, {seen_sql("trades", "trade_type <> 'C'")}, g AS (SELECT *, buy_id - lag(buy_id) OVER w AS gap, exch_ms - lag(exch_ms) OVER w AS tg FROM seen WINDOW w AS (PARTITION BY date, symbol, event ORDER BY rn DESC))
SELECT date, symbol, event, {r6s("CASE WHEN count(gap) >= 2 AND avg(tg) > 0 THEN 1000 / avg(tg) ELSE 0 END")} AS velocity, {r6s("CASE WHEN count(gap) >= 2 THEN avg(gap) ELSE 0 END")} AS gap_mean,
  {r6s("CASE WHEN count(*) >= 2 THEN avg(CASE WHEN bsflag = 'B' THEN 1.0 ELSE 0.0 END) ELSE 0 END")} AS pressure_buy,
  {r6s("CASE WHEN count(*) >= 2 THEN avg(CASE WHEN bsflag = 'S' THEN 1.0 ELSE 0.0 END) ELSE 0 END")} AS pressure_sell FROM g GROUP BY ALL""",
)
def id_statistics(spark, sf_dir):
    """Velocity, mean id gap and the pressure of both sides."""
    s, cuts = feed_setup(spark, sf_dir)
    t = df_.id_statistics(s.trades.filter(df_.counted_trade()), cuts, "buy_id")
    return t.select(*KEYS, *[r6(F.col(c)).alias(c) for c in ("velocity", "gap_mean", "pressure_buy", "pressure_sell")])


@query(
    "wash_probability",
    f"""{W}, t2 AS (SELECT * REPLACE (CASE WHEN sell_id % 3 = 0 THEN buy_id ELSE sell_id END AS sell_id) FROM trades WHERE trade_type <> 'C'),
r AS (SELECT *, sum(CASE WHEN sell_id = buy_id THEN 1 ELSE 0 END) OVER w / (count(*) OVER w)::DOUBLE AS p FROM t2 WINDOW w AS (PARTITION BY date, symbol ORDER BY local_us, exch_ms, channel, serial ROWS UNBOUNDED PRECEDING)),
{seen_sql("r")} SELECT date, symbol, event, {r6s("CASE WHEN count(*) >= 2 THEN sum(0.1::DOUBLE * pow(0.9::DOUBLE, rn - 1) * p) ELSE 0 END")} AS wash_probability FROM seen GROUP BY ALL""",
)
def wash_probability(spark, sf_dir):
    """Exponential average of the running share of self-matched trades."""
    s, cuts = feed_setup(spark, sf_dir)
    t = s.trades.withColumn("sell_id", F.when(F.col("sell_id") % 3 == 0, F.col("buy_id")).otherwise(F.col("sell_id")))
    return rounded(df_.wash_probability(t, cuts), ["wash_probability"])


def _chip(kept):
    return f"""{W}, {seen_sql("trades", "trade_type <> 'C' AND price > 0")}, nw AS (SELECT date, symbol, event, max(exch_ms) FILTER (WHERE rn = 1) AS now_ms FROM seen GROUP BY ALL),
bins AS (SELECT s.date, s.symbol, s.event, price // 2000000 AS bin, sum(volume)::DOUBLE AS w FROM seen s JOIN nw USING (date, symbol, event) WHERE {kept}exch_ms / 1000.0 > now_ms // 1000 - 7200 GROUP BY ALL),
sh AS (SELECT *, sum(w) OVER k AS total, w / sum(w) OVER k AS share, row_number() OVER (PARTITION BY date, symbol, event ORDER BY w DESC, bin) AS pos FROM bins WINDOW k AS (PARTITION BY date, symbol, event))"""


#: over the last 4,096 trades, and over all trades of the span
_CHIP, _CHIP_ALL = _chip("rn <= 4096 AND "), _chip("")


def chip_bins(spark, sf_dir):
    s, cuts = feed_setup(spark, sf_dir)
    return hg.price_bins(hg.recent_trades(s.trades, cuts), SPANS["chip"], tick=2_000_000)


def span_bins(spark, sf_dir):
    """The newest trades and the price bins of all trades of the span."""
    s, cuts = feed_setup(spark, sf_dir)
    cuts = cut_lineage(cuts)
    newest = written(hg.newest_trades(s.trades, cuts))
    return newest, hg.price_bins(hg.span_trades(s.trades, cuts, newest, SPANS["chip"]), SPANS["chip"], tick=2_000_000)


@query(
    "chip_concentration",
    f"""{_CHIP} SELECT date, symbol, event, {r6s("sum(share * bin)")} AS vwap_bin, {r6s("-sum(share * ln(share))")} AS entropy, {r6s("sum(share * share)")} AS hhi, {r6s("sum(share) FILTER (WHERE pos <= 1)")} AS top1,
  {r6s("sum(share) FILTER (WHERE pos <= 3)")} AS top3, {r6s("sum(share) FILTER (WHERE pos <= 5)")} AS top5, max(bin) FILTER (WHERE pos = 1) AS peak_bin FROM sh GROUP BY ALL""",
)
def chip_concentration(spark, sf_dir):
    """Concentration of the traded volume over price bins."""
    c = hg.concentration(chip_bins(spark, sf_dir))
    names = {"chip_vwap": "vwap_bin", "chip_entropy": "entropy", "chip_hhi": "hhi", "chip_top1_share": "top1", "chip_top3_share": "top3", "chip_top5_share": "top5"}
    return c.select(*KEYS, *[r6(F.col(a)).alias(b) for a, b in names.items()], F.col("chip_peak_price").alias("peak_bin"))


@query(
    "chip_levels",
    f"""{_CHIP_ALL}, lp AS (SELECT date, symbol, event, price // 2000000 AS here FROM seen WHERE rn = 1)
SELECT date, symbol, event, {r6s("sum(CASE WHEN bin < here THEN share ELSE 0 END)")} AS below, {r6s("sum(CASE WHEN bin > here THEN share ELSE 0 END)")} AS above,
  coalesce(any_value(here) - max(bin) FILTER (WHERE bin < here AND share >= 0.02), -1) AS support, coalesce(min(bin) FILTER (WHERE bin > here AND share >= 0.02) - any_value(here), -1) AS resistance FROM sh JOIN lp USING (date, symbol, event) GROUP BY ALL""",
)
def chip_levels(spark, sf_dir):
    """Shares around the current price and the nearest heavy levels."""
    newest, bins = span_bins(spark, sf_dir)
    price = newest.select(*KEYS, F.floor(F.col("price") / 2_000_000).alias("last_price"))
    lv = hg.levels_around(bins, price)
    return lv.select(*KEYS, r6(F.col("chip_below_share")).alias("below"), r6(F.col("chip_above_share")).alias("above"), F.col("chip_support_ticks").alias("support"), F.col("chip_resistance_ticks").alias("resistance"))


@query(
    "chip_migration",
    f"""{_CHIP_ALL}, ch AS (SELECT *, lag(event) OVER w AS pe, lag(now_ms) OVER w AS pm FROM nw WINDOW w AS (PARTITION BY date, symbol ORDER BY event)),
cb AS (SELECT c.date, c.symbol, c.event, bin, share AS q, 0.0::DOUBLE AS p FROM sh s JOIN ch c ON s.date = c.date AND s.symbol = c.symbol AND s.event = c.event WHERE pe IS NOT NULL UNION ALL
  SELECT c.date, c.symbol, c.event, bin, 0, share FROM ch c JOIN sh s ON s.date = c.date AND s.symbol = c.symbol AND s.event = c.pe),
mb AS (SELECT date, symbol, event, bin, sum(q) AS q, sum(p) AS p FROM cb GROUP BY ALL),
cd AS (SELECT date, symbol, event, abs(sum(q) OVER (w ROWS UNBOUNDED PRECEDING) - sum(p) OVER (w ROWS UNBOUNDED PRECEDING)) * (bin - lag(bin) OVER w) AS d FROM mb WINDOW w AS (PARTITION BY date, symbol, event ORDER BY bin)),
ds AS (SELECT date, symbol, event, coalesce(sum(d), 0) AS w1 FROM cd GROUP BY ALL)
SELECT c.date, c.symbol, c.event, a.bin - b.bin AS peak_shift, {r6s("w1")} AS wasserstein, {r6s("w1 / greatest(1e-9, (now_ms - pm) / 1000.0)")} AS speed FROM ch c JOIN ds USING (date, symbol, event)
  JOIN sh a ON a.date = c.date AND a.symbol = c.symbol AND a.event = c.event AND a.pos = 1 JOIN sh b ON b.date = c.date AND b.symbol = c.symbol AND b.event = c.pe AND b.pos = 1""",
)
def chip_migration(spark, sf_dir):
    """Move of the price distribution between successive checkpoints."""
    newest, bins = span_bins(spark, sf_dir)
    m = hg.migration(written(bins), newest.select(*KEYS, "now_ms"))
    return m.select(*KEYS, "peak_shift", r6(F.col("wasserstein")).alias("wasserstein"), r6(F.col("speed")).alias("speed"))


@query("ofi_status")
def ofi_status(spark, sf_dir):
    """Market state, dwell, conditional statistics and purity of the order-flow imbalance."""
    s, cuts = feed_setup(spark, sf_dir)
    crowd = crowded(s.quotes, STOCK_DAY)
    return ofi.status_at_cuts(ofi.quote_states(s.quotes, crowd), cut_lineage(cuts), crowd)


def _steps(q: int, source: str) -> str:
    """At most thirty power steps from axis q on every covariance of ``source``, then what is left of it."""
    axis = ", ".join("1.0" if i == q else "0.0" for i in range(1, 11))
    return f"""z{q} AS (
  SELECT date, symbol, event, n, x, cov, [{axis}]::DOUBLE[] AS v, 0.0::DOUBLE AS before, 0 AS k, false AS done FROM {source}
  UNION ALL SELECT date, symbol, event, n, x, cov, CASE WHEN size > 0 THEN [a / size for a in av] ELSE av END, value, k + 1, abs(value - before) <= 1e-6 * greatest(1, abs(before))
  FROM (SELECT *, list_dot_product(v, av) AS value, sqrt(list_dot_product(av, av)) AS size FROM (SELECT *, [list_dot_product(r, v) for r in cov] AS av FROM z{q} WHERE NOT done AND k < 30))),
e{q} AS (SELECT *, list_dot_product(v, [list_dot_product(r, v) for r in cov]) AS explained FROM z{q} QUALIFY row_number() OVER (PARTITION BY date, symbol, event ORDER BY k DESC) = 1),
m{q} AS (SELECT date, symbol, event, n, x, [[cov[i][j] - explained * v[i] * v[j] for j in range(1, 11)] for i in range(1, 11)] AS cov FROM e{q})"""


_LEVELS = "[" + ", ".join(f"o{i} / avg_depth" for i in range(1, 11)) + "]"


@query(
    "ofi_principal_component",
    f"""{W.replace("WITH ", "WITH RECURSIVE ", 1)},{OFI_CTE}, f AS (SELECT *, {_LEVELS}::DOUBLE[] AS o FROM ofi), {seen_sql("f")},
t AS (SELECT date, symbol, event, count(*)::DOUBLE AS n, max(o) FILTER (WHERE rn = 1) AS x, [{", ".join(f"sum(o[{i}])" for i in range(1, 11))}] AS s,
  [{", ".join("[" + ", ".join(f"sum(o[{i}] * o[{j}])" for j in range(1, 11)) + "]" for i in range(1, 11))}] AS c FROM seen GROUP BY ALL),
b AS (SELECT date, symbol, event, n, x, [[(c[i][j] - s[i] * s[j] / greatest(n, 2)) / greatest(n - 1, 1) for j in range(1, 11)] for i in range(1, 11)] AS cov FROM t),
{_steps(1, "b")}, {_steps(2, "m1")}
SELECT e1.date, e1.symbol, e1.event, {r6s("CASE WHEN e1.n >= 2 AND e1.explained > 1e-9 * list_sum([e1.cov[i][i] for i in range(1, 11)]) THEN list_dot_product(e1.v, e1.x) ELSE 0 END")} AS ofi_pca,
  {r6s("CASE WHEN e1.n >= 2 AND e2.explained > 1e-9 * list_sum([e1.cov[i][i] for i in range(1, 11)]) THEN list_dot_product(e2.v, e2.x) ELSE 0 END")} AS second FROM e1 JOIN e2 USING (date, symbol, event)""",
)
def ofi_principal_component(spark, sf_dir):
    """Latest level-flow vector projected on its first two principal components."""
    s, cuts = feed_setup(spark, sf_dir)
    c = ofi.components_at_cuts(ofi.flow_series(s.quotes), cuts, 2)
    return c.select(*KEYS, r6(F.element_at("components", 1)).alias("ofi_pca"), r6(F.element_at("components", 2)).alias("second"))


@query("state_transitions")
def state_transitions(spark, sf_dir):
    """Transition counts of the market-state machine."""
    q = fx.quotes(spark, sf_dir)
    return ofi.transition_counts(ofi.quote_states(q, crowded(q, STOCK_DAY)))


@query("demo_family")
def demo_family(spark, sf_dir):
    """All 54 columns of the demonstration family."""
    s, cuts = feed_setup(spark, sf_dir)
    panel = df_.demofw00(s, cuts, SPANS)
    return panel.select(*KEYS, *[r6(F.col(c)).alias(c) for c in df_.COLUMNS])
