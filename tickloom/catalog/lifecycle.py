"""Order reconstruction, trade pairs and their audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom import fixtures as fx
from tickloom.catalog import query
from tickloom.fixtures import r6s
from tickloom.functions.scalar import r6
from tickloom.operators import lifecycle as lc
from tickloom.schema import ORDER_KEY, STOCK_DAY
from tickloom.session import drop_written, written

O = "date, symbol, order_id"
_ORD = "local_us, exch_ms, channel, serial, side"
_RUN = f"OVER (PARTITION BY {O} ORDER BY {_ORD} ROWS UNBOUNDED PRECEDING)"

LIFE = f"""WITH {fx.LIFECYCLE_SQL},
tr AS (SELECT *, CASE WHEN bsflag = 'B' THEN 1 WHEN bsflag = 'S' THEN -1 WHEN buy_id > 0 AND sell_id > 0 AND buy_id <> sell_id THEN CASE WHEN buy_id > sell_id THEN 1 ELSE -1 END ELSE 0 END AS agg FROM lt),
legs AS (
  SELECT date, symbol, local_us, exch_ms, channel, serial, market, CASE market WHEN 49 THEN orderorino ELSE order_index END AS order_id,
    CASE WHEN order_type = 'D' THEN 'D' ELSE 'A' END AS kind, volume AS qty, 0 AS amount, biz_index, CASE bsflag WHEN 'B' THEN 0 ELSE 1 END AS side, false AS incoming FROM lo
  UNION ALL SELECT date, symbol, local_us, exch_ms, channel, serial, market, CASE WHEN buy_id <> 0 THEN buy_id ELSE sell_id END, 'C', volume, 0, biz_index, CASE WHEN buy_id <> 0 THEN 0 ELSE 1 END, false FROM tr WHERE trade_type = 'C'
  UNION ALL SELECT date, symbol, local_us, exch_ms, channel, serial, market, buy_id, 'F', volume, amount, biz_index, 0, agg = 1 FROM tr WHERE trade_type <> 'C' AND buy_id <> 0
  UNION ALL SELECT date, symbol, local_us, exch_ms, channel, serial, market, sell_id, 'F', volume, amount, biz_index, 1, agg = -1 FROM tr WHERE trade_type <> 'C' AND sell_id <> 0),
r1 AS (SELECT *, max(exch_ms) {_RUN} AS m, max(CASE WHEN kind = 'A' OR incoming THEN 1 ELSE 0 END) {_RUN} AS e, sum(CASE WHEN kind = 'A' THEN 1 ELSE 0 END) {_RUN} AS na FROM legs),
r2 AS (SELECT *, lag(m) OVER w AS pm, coalesce(lag(e) OVER w, 0) AS pe FROM r1 WINDOW w AS (PARTITION BY {O} ORDER BY {_ORD})),
r3 AS (SELECT *, max(CASE WHEN pe = 1 AND local_us // 1000 > pm + 20000 THEN 1 ELSE 0 END) {_RUN} AS g FROM r2),
ph AS (SELECT *, CASE WHEN market = 48 THEN na = 0 OR (kind = 'A' AND na > 1) ELSE g = 1 AND kind = 'A' END AS orphan, CASE WHEN market = 48 THEN kind <> 'A' AND na > 0 ELSE g = 1 AND kind <> 'A' END AS live FROM r3),
pre AS (SELECT * FROM ph WHERE NOT live AND NOT orphan),
b AS (SELECT {O}, any_value(market) AS market, arg_min(side, ({_ORD})) AS side, bool_or(kind = 'A') AS has_a, max(qty) FILTER (WHERE kind = 'A') AS a_qty, max(biz_index) FILTER (WHERE kind = 'A') AS a_biz,
  bool_or(incoming) AS inc, max(exch_ms) AS last_ms, min(local_us) FILTER (WHERE kind = 'A') AS a_us FROM pre GROUP BY ALL),
fr AS (SELECT p.*, b.has_a, b.a_biz FROM pre p JOIN b USING ({O}) WHERE kind <> 'A'),
s0 AS (SELECT {O}, sum(CASE WHEN kind = 'F' AND CASE WHEN has_a THEN biz_index < a_biz ELSE incoming END THEN qty ELSE 0 END) AS imm0, sum(CASE WHEN kind = 'F' AND has_a AND biz_index > a_biz THEN qty ELSE 0 END) AS pas0,
  sum(CASE WHEN kind = 'D' THEN qty ELSE 0 END) AS can0, sum(amount) AS amt0 FROM fr GROUP BY ALL),
cf AS (SELECT b.{O.replace(", ", ", b.")}, market, side, has_a, coalesce(imm0, 0) AS imm0, coalesce(pas0, 0) AS pas0, coalesce(can0, 0) AS can0, coalesce(amt0, 0) AS amt0,
  CASE WHEN has_a THEN a_qty + coalesce(imm0, 0) ELSE coalesce(imm0, 0) END AS original, CASE WHEN has_a THEN greatest(0, a_qty - coalesce(pas0, 0) - coalesce(can0, 0)) ELSE 0 END AS rest0, NOT has_a AS estimated,
  CASE WHEN market = 48 THEN a_us // 1000 ELSE least(last_ms + 20000, 54000000) END AS confirm_ms FROM b LEFT JOIN s0 USING ({O}) WHERE has_a OR inc),
lv0 AS (SELECT p.*, cf.rest0, cf.original, cf.imm0, cf.pas0, cf.can0, cf.amt0, cf.estimated, sum(qty) OVER (PARTITION BY {O} ORDER BY p.local_us, p.exch_ms, p.channel, p.serial, p.side ROWS UNBOUNDED PRECEDING) AS taken
  FROM ph p JOIN (SELECT * EXCLUDE (side, market) FROM cf) cf USING ({O}) WHERE live),
lv AS (SELECT *, taken - qty >= rest0 AS late, greatest(0, rest0 - taken) AS rest, least(qty, greatest(0, rest0 - taken + qty)) AS applied FROM lv0),
kp AS (SELECT *, CASE WHEN kind = 'F' THEN CASE WHEN market = 48 THEN qty ELSE applied END ELSE 0 END AS filled FROM lv WHERE NOT late),
ls AS (SELECT {O}, sum(CASE WHEN market = 48 AND incoming THEN filled ELSE 0 END) AS imm, sum(CASE WHEN market = 48 AND incoming THEN 0 ELSE filled END) AS pas, sum(CASE WHEN kind <> 'F' THEN applied ELSE 0 END) AS can,
  sum(CASE WHEN kind = 'F' THEN amount ELSE 0 END) AS amt, min(rest) AS rest, max(kind) FILTER (WHERE rest = 0) AS ck, max(({_ORD})) FILTER (WHERE rest = 0) AS close_key, count(*) AS changes FROM kp GROUP BY ALL),
fin AS (SELECT {O}, market, side, original, imm0 + coalesce(imm, 0) AS immediate, pas0 + coalesce(pas, 0) AS passive, can0 + coalesce(can, 0) + coalesce(rest, rest0) AS cancelled, coalesce(rest, rest0) AS rest_at_close,
  amt0 + coalesce(amt, 0) AS filled_amount, estimated, confirm_ms, close_key, coalesce(changes, 0) AS changes,
  CASE WHEN rest0 = 0 AND estimated THEN 'FullyFilledOnArrival' WHEN rest0 = 0 AND market = 49 THEN CASE WHEN can0 > 0 THEN 'Cancelled' ELSE 'FullyFilledAfterResting' END
    WHEN rest = 0 AND ck = 'F' THEN 'FullyFilledAfterResting' WHEN rest = 0 THEN 'Cancelled' ELSE 'SessionClose' END AS close_reason FROM cf LEFT JOIN ls USING ({O})),
pr0 AS (SELECT t.*, CASE WHEN bsflag IN ('B', 'S') THEN 'BsFlag' WHEN agg <> 0 THEN 'OrderIdFallback' ELSE 'Unknown' END AS source, bo.original AS b_orig, so.original AS s_orig, bo.estimated AS b_est, so.estimated AS s_est,
  bo.confirm_ms AS b_ms, so.confirm_ms AS s_ms, bo.order_id IS NOT NULL AND NOT coalesce((t.local_us, t.exch_ms, t.channel, t.serial, 0) > bo.close_key, false) AS b_ok, so.order_id IS NOT NULL AND NOT coalesce((t.local_us, t.exch_ms, t.channel, t.serial, 1) > so.close_key, false) AS s_ok,
  bo.immediate + bo.passive AS b_fill, so.immediate + so.passive AS s_fill
  FROM tr t LEFT JOIN fin bo ON bo.date = t.date AND bo.symbol = t.symbol AND bo.order_id = t.buy_id LEFT JOIN fin so ON so.date = t.date AND so.symbol = t.symbol AND so.order_id = t.sell_id
  WHERE trade_type <> 'C' AND buy_id <> 0 AND sell_id <> 0),
pr AS (SELECT *, b_ok AND s_ok AS resolved, CASE WHEN b_ok AND s_ok THEN greatest(local_us // 1000, b_ms, s_ms) END AS resolved_ms FROM pr0)"""


def job(spark, sf_dir):
    return lc.reconstruct(fx.lifecycle_trades(spark, sf_dir), fx.lifecycle_orders(spark, sf_dir))


@query(
    "parent_orders",
    f"""{LIFE} SELECT {O}, CAST(market AS INTEGER) AS market, side, original, CAST(immediate AS BIGINT) AS immediate, CAST(passive AS BIGINT) AS passive, CAST(cancelled AS BIGINT) AS cancelled, CAST(rest_at_close AS BIGINT) AS rest_at_close,
  CAST(filled_amount AS BIGINT) AS filled_amount, estimated, confirm_ms, changes, close_reason FROM fin""",
)
def parent_orders(spark, sf_dir):
    """Every reconstructed parent order after the close, with quantities and close reason."""
    f = job(spark, sf_dir)["finals"]
    return f.select(*lc.ORDER, F.col("market").cast("int").alias("market"), "side", "original", "immediate", "passive", "cancelled", "rest_at_close", "filled_amount", "estimated", "confirm_ms", "changes", "close_reason")


#: resolved pairs with both parents after all that had reached them when the pair was resolved
PAIR_SQL = LIFE + """,
prn AS (SELECT *, row_number() OVER () AS pid FROM pr WHERE resolved),
req AS (SELECT pid, 'b' AS leg, date, symbol, buy_id AS order_id, resolved_ms, local_us, exch_ms, channel, serial FROM prn UNION ALL SELECT pid, 's', date, symbol, sell_id, resolved_ms, local_us, exch_ms, channel, serial FROM prn),
sn AS (SELECT pid, leg, any_value(cf.original) AS original, CAST(any_value(cf.imm0) + coalesce(sum(CASE WHEN k.market = 48 AND k.incoming THEN k.filled ELSE 0 END), 0) AS BIGINT) AS immediate,
  CAST(any_value(cf.pas0) + coalesce(sum(CASE WHEN k.market = 48 AND k.incoming THEN 0 ELSE k.filled END), 0) AS BIGINT) AS passive,
  CAST(any_value(cf.can0) + coalesce(sum(CASE WHEN k.kind <> 'F' THEN k.applied ELSE 0 END), 0) AS BIGINT) AS cancelled, CAST(coalesce(min(k.rest), any_value(cf.rest0)) AS BIGINT) AS rest
  FROM req r JOIN cf USING (date, symbol, order_id) LEFT JOIN kp k ON k.date = r.date AND k.symbol = r.symbol AND k.order_id = r.order_id AND (k.local_us // 1000 < r.resolved_ms OR k.local_us // 1000 = r.resolved_ms
    AND (r.resolved_ms > r.local_us // 1000 OR (k.local_us, k.exch_ms, k.channel, k.serial) <= (r.local_us, r.exch_ms, r.channel, r.serial))) GROUP BY pid, leg)
SELECT {columns}, b.original AS buy_original, b.immediate AS buy_immediate, b.passive AS buy_passive, b.cancelled AS buy_cancelled, b.rest AS buy_rest,
  s.original AS sell_original, s.immediate AS sell_immediate, s.passive AS sell_passive, s.cancelled AS sell_cancelled, s.rest AS sell_rest
FROM prn JOIN sn b ON b.pid = prn.pid AND b.leg = 'b' JOIN sn s ON s.pid = prn.pid AND s.leg = 's'"""


def snapshot_columns():
    return [F.col(f"{side}.{c}").alias(f"{side}_{c}") for side in ("buy", "sell") for c in lc.SNAPSHOT]


@query("trade_pairs", PAIR_SQL.format(columns="date, symbol, serial, source, agg AS aggressor, b_est OR s_est AS estimated, resolved_ms"))
def trade_pairs(spark, sf_dir):
    """Resolved trade pairs with both parents as they stood at the moment both were known."""
    trades = fx.lifecycle_trades(spark, sf_dir)
    states = written(lc.kept_states(lc.order_states(lc.order_legs(trades, fx.lifecycle_orders(spark, sf_dir)))))
    finals = written(lc.final_orders(states).select(*lc.PARENT))
    p = lc.trade_pairs(trades, finals).filter("resolved").withColumn("estimated", F.col("buy.estimated") | F.col("sell.estimated"))
    # the pairs go through two more shuffles: with what is asked for, and after those of their making are gone
    p = written(p.select(*STOCK_DAY, *ORDER_KEY, "buy_id", "sell_id", "source", "aggressor", "estimated", "resolved", "resolved_ms"))
    drop_written(finals)
    return lc.pair_snapshots(p, lc.lifecycle_events(states)).select("date", "symbol", "serial", "source", "aggressor", "estimated", "resolved_ms", *snapshot_columns())


@query(
    "replay_audit",
    f"""{LIFE}, lg AS (SELECT date, symbol, count(*) AS inputs, count(*) FILTER (WHERE kind IN ('C', 'D')) AS cancels, count(*) FILTER (WHERE orphan) AS orphans FROM ph GROUP BY ALL),
lt2 AS (SELECT date, symbol, count(*) FILTER (WHERE late) AS late_events FROM lv GROUP BY ALL),
fo AS (SELECT date, symbol, count(*) AS confirmed, count(*) FILTER (WHERE close_reason <> 'SessionClose') AS closed, count(*) FILTER (WHERE original <> immediate + passive + cancelled) AS conservation_failures,
  count(*) FILTER (WHERE rest_at_close < 0) AS negative_rest FROM fin GROUP BY ALL),
pp AS (SELECT date, symbol, count(*) FILTER (WHERE resolved) AS pairs, count(*) FILTER (WHERE NOT resolved) AS unresolved FROM pr GROUP BY ALL),
sa AS (SELECT f.date, f.symbol, f.confirm_ms AS a, CASE WHEN f.close_key IS NOT NULL THEN f.close_key[1] // 1000 WHEN cf.rest0 = 0 AND f.market = 49 THEN f.confirm_ms ELSE 54000000 END AS b FROM fin f JOIN cf USING (date, symbol, order_id)),
sp AS (SELECT p.date, p.symbol, min(p.local_us) // 1000 AS a, coalesce(any_value(cf.confirm_ms), 54000000) AS b FROM ph p LEFT JOIN cf USING (date, symbol, order_id) WHERE p.market = 49 GROUP BY p.date, p.symbol, p.order_id),
ev AS (SELECT 'a' AS kind, date, symbol, a AS ms, 1 AS d FROM sa WHERE a < b UNION ALL SELECT 'a', date, symbol, b, -1 FROM sa WHERE a < b UNION ALL SELECT 'p', date, symbol, a, 1 FROM sp WHERE a < b UNION ALL SELECT 'p', date, symbol, b, -1 FROM sp WHERE a < b),
ek AS (SELECT kind, date, symbol, max(n) AS peak FROM (SELECT *, sum(d) OVER (PARTITION BY kind, date, symbol ORDER BY ms RANGE UNBOUNDED PRECEDING) AS n FROM ev) GROUP BY ALL)
SELECT date, symbol, inputs, cancels, orphans, coalesce(late_events, 0) AS late_events, confirmed, closed, conservation_failures, negative_rest, coalesce(pairs, 0) AS pairs, coalesce(unresolved, 0) AS unresolved,
  CAST(coalesce(ka.peak, 0) AS BIGINT) AS max_active, CAST(coalesce(kp2.peak, 0) AS BIGINT) AS max_pending
FROM lg JOIN fo USING (date, symbol) LEFT JOIN lt2 USING (date, symbol) LEFT JOIN pp USING (date, symbol) LEFT JOIN (SELECT * FROM ek WHERE kind = 'a') ka USING (date, symbol) LEFT JOIN (SELECT * FROM ek WHERE kind = 'p') kp2 USING (date, symbol)""",
)
def replay_audit(spark, sf_dir):
    """Counts of the whole reconstruction per stock-day: late events, unresolved pairs, conservation, most orders open and waiting at once."""
    trades = fx.lifecycle_trades(spark, sf_dir)
    results = written(lc.order_results(lc.order_states(lc.order_legs(trades, fx.lifecycle_orders(spark, sf_dir)))))
    k = ["date", "symbol"]
    names = ["inputs", "cancels", "orphans", "late_events"]
    legs = results.groupBy(*k).agg(*[F.sum(c).alias(name) for c, name in zip(lc.LEG_COUNTS, names)])
    f = lc.confirmed_orders(results)
    broken = F.col("original") != F.col("immediate") + F.col("passive") + F.col("cancelled")
    fin = f.groupBy(*k).agg(
        F.count(F.lit(1)).alias("confirmed"), F.count_if(F.col("close_reason") != "SessionClose").alias("closed"),
        F.count_if(broken).alias("conservation_failures"), F.count_if(F.col("rest_at_close") < 0).alias("negative_rest"),
    )
    p = lc.trade_pairs(trades, f).groupBy(*k).agg(F.count_if("resolved").alias("pairs"), F.count_if(~F.col("resolved")).alias("unresolved"))
    out = legs.join(fin, k).join(p, k, "left").join(lc.replay_peaks(results), k, "left")
    return out.na.fill(0, ["late_events", "pairs", "unresolved", "max_active", "max_pending"])


@query(
    "unresolved_parents",
    f"""{LIFE}, ids AS (SELECT date, symbol, buy_id AS order_id FROM tr WHERE trade_type <> 'C' UNION ALL SELECT date, symbol, sell_id FROM tr WHERE trade_type <> 'C')
SELECT date, symbol, order_id, count(*) AS trades FROM ids i WHERE order_id <> 0 AND NOT EXISTS (SELECT 1 FROM fin f WHERE f.date = i.date AND f.symbol = i.symbol AND f.order_id = i.order_id) GROUP BY ALL""",
)
def unresolved_parents(spark, sf_dir):
    """Parents named by a trade that never confirm."""
    t = fx.lifecycle_trades(spark, sf_dir).filter("trade_type <> 'C'")
    ids = t.select("date", "symbol", F.explode(F.array("buy_id", "sell_id")).alias("order_id")).filter("order_id <> 0")
    n = ids.groupBy(*lc.ORDER).agg(F.count(F.lit(1)).alias("trades"))
    return n.join(job(spark, sf_dir)["finals"], lc.ORDER, "left_anti")


@query(
    "arrival_inversions",
    f"""WITH {fx.LIFECYCLE_SQL}, a AS (SELECT date, symbol, orderorino AS order_id, biz_index - 1 AS biz, local_us FROM lo WHERE market = 49 AND order_type = 'A'),
t AS (SELECT date, symbol, biz_index AS biz, local_us, serial, buy_id AS order_id FROM lt WHERE market = 49 UNION SELECT date, symbol, biz_index, local_us, serial, sell_id FROM lt WHERE market = 49)
SELECT date, symbol, order_id, t.serial, greatest(0, t.local_us - a.local_us) AS inversion_us FROM a JOIN t USING (date, symbol, order_id, biz)""",
)
def arrival_inversions(spark, sf_dir):
    """Adds whose exchange-order predecessor arrived after them."""
    inv = lc.arrival_inversions(fx.lifecycle_trades(spark, sf_dir), fx.lifecycle_orders(spark, sf_dir))
    return inv.select("date", "symbol", "order_id", "serial", "inversion_us")


@query(
    "input_audit",
    f"""WITH {fx.LIFECYCLE_SQL}, u AS (SELECT date, symbol, 'trade' AS stream, trade_type AS type, bsflag, exch_ms, buy_id = 0 OR sell_id = 0 AS zero_id FROM lt UNION ALL SELECT date, symbol, 'order', order_type, bsflag, exch_ms, order_index = 0 FROM lo)
SELECT date, symbol, stream, count(*) AS rows, count(*) FILTER (WHERE type = 'C') AS type_c, count(*) FILTER (WHERE type = 'A') AS type_a, count(*) FILTER (WHERE type = 'D') AS type_d, count(*) FILTER (WHERE type = '0') AS type_0,
  count(*) FILTER (WHERE bsflag = 'B') AS flag_b, count(*) FILTER (WHERE bsflag = 'S') AS flag_s, count(*) FILTER (WHERE zero_id) AS zero_ids, min(exch_ms) AS first_ms, max(exch_ms) AS last_ms FROM u GROUP BY ALL""",
)
def input_audit(spark, sf_dir):
    """Value census and time range of each stream of a stock-day."""
    t = fx.lifecycle_trades(spark, sf_dir).select("date", "symbol", F.lit("trade").alias("stream"), F.col("trade_type").alias("type"), "bsflag", "exch_ms", ((F.col("buy_id") == 0) | (F.col("sell_id") == 0)).alias("zero_id"))
    o = fx.lifecycle_orders(spark, sf_dir).select("date", "symbol", F.lit("order").alias("stream"), F.col("order_type").alias("type"), "bsflag", "exch_ms", (F.col("order_index") == 0).alias("zero_id"))
    return t.unionByName(o).groupBy("date", "symbol", "stream").agg(
        F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col("type") == v).alias(f"type_{v.lower()}") for v in ("C", "A", "D", "0")],
        *[F.count_if(F.col("bsflag") == v).alias(f"flag_{v.lower()}") for v in ("B", "S")], F.count_if("zero_id").alias("zero_ids"),
        F.min("exch_ms").alias("first_ms"), F.max("exch_ms").alias("last_ms"),
    )


@query(
    "lifecycle_events",
    f"""{LIFE}, n AS (SELECT date, symbol, side, count(*) AS confirmed, CAST(sum(original) AS BIGINT) AS original, CAST(sum(rest0) AS BIGINT) AS rest0, count(*) FILTER (WHERE rest0 = 0 AND market = 49) AS closed_at_once FROM cf GROUP BY ALL),
c AS (SELECT k.date, k.symbol, cf.side, count(*) AS changes, count(*) FILTER (WHERE rest = 0) AS closed_live, CAST(sum(rest) AS BIGINT) AS rest_sum FROM kp k JOIN cf USING (date, symbol, order_id) GROUP BY ALL)
SELECT date, symbol, side, confirmed, original, rest0, closed_at_once, coalesce(changes, 0) AS changes, coalesce(closed_live, 0) AS closed_live, coalesce(rest_sum, 0) AS rest_sum FROM n LEFT JOIN c USING (date, symbol, side)""",
)
def lifecycle_events(spark, sf_dir):
    """Lifecycle events per stock-day and side."""
    e = job(spark, sf_dir)["events"]
    born = F.col("event") == "Confirmed"
    at_once = (F.col("event") == "Closed") & F.col("at_confirmation")
    live = ~born & ~F.col("at_confirmation")
    one = lambda c, v: F.sum(F.when(c, F.col(v)).otherwise(0))
    return e.groupBy("date", "symbol", "side").agg(
        F.count_if(born).alias("confirmed"), one(born, "original").alias("original"), one(born, "rest").alias("rest0"), F.count_if(at_once).alias("closed_at_once"),
        F.count_if(live).alias("changes"), F.count_if(live & (F.col("event") == "Closed")).alias("closed_live"), one(live, "rest").alias("rest_sum"),
    )
