"""Clock, routing, predicate and projection queries over the tick feed."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom import fixtures as fx
from tickloom.catalog import query
from tickloom.fixtures import r6s
from tickloom.functions import clock
from tickloom.functions import scalar as sc
from tickloom.operators.cuts import (
    as_of_quote,
    assign_segment,
    family_cuts,
    grid_at_cuts,
    latest_at_cuts,
    market_cuts,
    totals_at_cuts,
    tracked,
)
from tickloom.operators.sequence import number_rows
from tickloom.schema import ORDER_KEY

W = f"WITH {fx.MARKET_SQL}"
F_T = f"WITH {fx.FEED_SQL}, {fx.TRADES_SQL}"
F_O = f"WITH {fx.FEED_SQL}, {fx.ORDERS_SQL}"

#: packed clock of a millisecond of day
PACK = "((exch_ms // 3600000) * 10000000 + (exch_ms // 60000 % 60) * 100000 + (exch_ms // 1000 % 60) * 1000 + exch_ms % 1000)"


@query(
    "clock_codec",
    f"""{F_T}, p AS (SELECT {PACK} AS int_time, exch_ms FROM trades)
SELECT CAST(int_time AS BIGINT) AS int_time, CAST(exch_ms AS BIGINT) AS ms_of_day,
  exch_ms / 1000.0::DOUBLE AS seconds,
  CAST(int_time // 10000000 * 60 + int_time % 10000000 // 100000 AS BIGINT) AS minute,
  lpad(CAST(int_time // 1000 AS VARCHAR), 6, '0') AS stem,
  CASE WHEN (int_time // 10000000 = 9 AND int_time // 100000 % 100 < 45)
    OR int_time // 10000000 > 14 OR (int_time // 10000000 = 14 AND int_time // 100000 % 100 >= 30) THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END AS session_weight,
  count(*) AS rows
FROM p GROUP BY int_time, exch_ms""",
)
def clock_codec(spark, sf_dir):
    """Packed clock decoded to milliseconds, seconds, minute index, file stem and session weight."""
    packed = fx.trades(spark, sf_dir).select(clock.pack_ms(F.col("exch_ms")).alias("int_time"))
    p = F.col("int_time")
    return packed.groupBy("int_time").agg(F.count(F.lit(1)).alias("rows")).select(
        p,
        clock.ms_of_day(p).alias("ms_of_day"),
        clock.packed_seconds(p).alias("seconds"),
        clock.minute_index(p).alias("minute"),
        clock.stem(p).alias("stem"),
        clock.session_weight(p).alias("session_weight"),
        "rows",
    )


@query(
    "clock_add",
    f"""{F_T}, p AS (SELECT exch_ms, volume FROM trades)
SELECT date_ms AS later, count(*) AS rows FROM (
  SELECT CAST((m // 3600000) * 10000000 + (m // 60000 % 60) * 100000 + (m // 1000 % 60) * 1000 + m % 1000 AS BIGINT) AS date_ms
  FROM (SELECT exch_ms + volume * 61001 AS m FROM p)) GROUP BY 1""",
)
def clock_add(spark, sf_dir):
    """Adding a span to a packed clock carries through seconds, minutes and hours."""
    t = fx.trades(spark, sf_dir)
    later = clock.add_ms(clock.pack_ms(F.col("exch_ms")), F.col("volume") * 61001)
    return t.groupBy(later.alias("later")).agg(F.count(F.lit(1)).alias("rows"))


@query(
    "clock_epoch",
    """WITH e AS (SELECT epoch_us(CAST(ts AS TIMESTAMP)) AS us, event_type FROM events),
l AS (SELECT (us // 1000 + 28800000) % 86400000 AS m, event_type FROM e)
SELECT event_type, CAST((m // 3600000) * 10000000 + (m // 60000 % 60) * 100000 + (m // 1000 % 60) * 1000 + m % 1000 AS BIGINT) AS wall,
  count(*) AS rows FROM l GROUP BY ALL""",
)
def clock_epoch(spark, sf_dir):
    """Epoch microseconds to the exchange wall clock (UTC+8)."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    e = fx.table(spark, sf_dir, "events")
    return e.groupBy("event_type", clock.epoch_us_to_packed(us).alias("wall")).agg(F.count(F.lit(1)).alias("rows"))


@query(
    "global_second_grid",
    f"""{F_T}, n AS (SELECT exch_ms - exch_ms % 1000 AS ms, count(*) AS trades FROM trades GROUP BY 1),
g AS (SELECT unnest(generate_series(34200000::BIGINT, 53821000::BIGINT, 1000::BIGINT)) AS ms),
g2 AS (SELECT ms FROM g WHERE ms <> 41400000 UNION SELECT 33900000::BIGINT)
SELECT CAST((ms // 3600000) * 10000000 + (ms // 60000 % 60) * 100000 + (ms // 1000 % 60) * 1000 AS BIGINT) AS int_time,
  coalesce(trades, 0) AS trades FROM g2 LEFT JOIN n USING (ms)""",
)
def global_second_grid(spark, sf_dir):
    """The market-wide one-second grid, minus skipped and plus added times, with the trades of each second."""
    grid = clock.time_grid(spark, 93_000_000, 145_701_000, 1000, add=(92_500_000,), skip=(113_000_000,))
    t = fx.trades(spark, sf_dir)
    second = clock.pack_ms(F.col("exch_ms") - F.col("exch_ms") % 1000)
    n = t.groupBy(second.alias("int_time")).agg(F.count(F.lit(1)).alias("trades"))
    return grid.join(n, "int_time", "left").select("int_time", F.coalesce("trades", F.lit(0)).cast("bigint").alias("trades"))


@query("market_cuts", f"{W} SELECT date, event, cut[1] AS local_us, cut[2] AS exch_ms, CAST(cut[3] AS INTEGER) AS channel, cut[4] AS serial FROM (SELECT date, event, [cut[1], cut[2], cut[3], cut[4]] AS cut FROM cuts)")
def cuts_query(spark, sf_dir):
    """Arrival key that fires each checkpoint, over all three streams."""
    c = market_cuts(fx.streams(spark, sf_dir).present())
    return c.select("date", "event", *[F.col("cut")[k].alias(k) for k in ORDER_KEY])


@query(
    "published_events",
    f"""{W} SELECT date, CAST(CASE WHEN event = 92700000 THEN 92600000 ELSE event END AS BIGINT) AS event,
  CAST(CASE WHEN event = 92700000 THEN 926 ELSE event // 100000 END AS BIGINT) AS minute_code FROM cuts
WHERE event IN (92700000, 113000000, 143000000)""",
)
def published_events(spark, sf_dir):
    """Trigger list of one family, restricted and renamed to published event codes."""
    c = family_cuts(market_cuts(fx.streams(spark, sf_dir).present()), [92_700_000, 113_000_000, 143_000_000])
    return c.select("date", clock.published_event(F.col("event")).alias("event"), clock.minute_code(F.col("event")).alias("minute_code"))


@query(
    "missed_triggers",
    f"""WITH {fx.FEED_SQL}, {fx.TRADES_SQL}, late AS (SELECT * FROM trades WHERE exch_ms < 34000000 OR exch_ms > 40000000),
{fx.CHECKPOINT_ROWS},
cuts AS (SELECT date, CAST(event AS BIGINT) AS event, min({fx.KEY}) AS cut FROM late JOIN checkpoints ON exch_ms >= event_ms GROUP BY date, event)
SELECT date, max(event) AS event, cut[1] AS local_us FROM (SELECT date, event, cut AS c, [cut[1]] AS cut FROM cuts) GROUP BY date, c, cut[1]""",
)
def missed_triggers(spark, sf_dir):
    """With skip_missed, checkpoints that fire on the same arrival keep only the latest."""
    t = fx.trades(spark, sf_dir).filter("exch_ms < 34000000 OR exch_ms > 40000000")
    return market_cuts([t], skip_missed=True).select("date", "event", F.col("cut.local_us").alias("local_us"))


@query(
    "order_routing",
    f"""{F_O} SELECT CAST(market AS INTEGER) AS market, order_type, bsflag, count(*) AS orders,
  CAST(sum(CASE WHEN market = 49 THEN orderorino WHEN market = 48 THEN order_index ELSE 0 END) AS BIGINT) AS id_sum
FROM ord WHERE order_type <> 'S' AND ((market = 48 AND order_index <> 0) OR (market = 49 AND orderorino <> 0)) GROUP BY ALL""",
)
def order_routing(spark, sf_dir):
    """Routable orders with their canonical id."""
    o = fx.orders(spark, sf_dir).filter(sc.routable_order())
    return o.groupBy(F.col("market").cast("int").alias("market"), "order_type", "bsflag").agg(
        F.count(F.lit(1)).alias("orders"), F.sum(sc.canonical_order_id()).alias("id_sum")
    )


@query(
    "trade_sides",
    f"""{F_T}, a AS (SELECT *, CASE WHEN bsflag IN ('B', 'S') THEN 'BsFlag'
    WHEN buy_id > 0 AND sell_id > 0 AND buy_id <> sell_id THEN 'OrderIdFallback' ELSE 'Unknown' END AS source,
  CASE WHEN bsflag = 'B' THEN 1 WHEN bsflag = 'S' THEN -1 WHEN buy_id > 0 AND sell_id > 0 AND buy_id <> sell_id
    THEN CASE WHEN buy_id > sell_id THEN 1 ELSE -1 END ELSE 0 END AS side FROM trades)
SELECT date, symbol, source, side, count(*) AS trades,
  CAST(sum(CASE bsflag WHEN 'B' THEN volume WHEN 'S' THEN -volume END) AS BIGINT) AS signed_volume,
  CAST(sum((amount * 10000 + volume // 2) // volume) AS BIGINT) AS avg_price_sum
FROM a GROUP BY ALL""",
)
def trade_sides(spark, sf_dir):
    """Aggressor side and its source, signed volume and the exact average price."""
    a = sc.aggressor()
    t = fx.trades(spark, sf_dir)
    return t.groupBy("date", "symbol", a["source"].alias("source"), a["side"].alias("side")).agg(
        F.count(F.lit(1)).alias("trades"),
        F.sum(sc.signed_volume()).alias("signed_volume"),
        F.sum(sc.average_price_x1e4(F.col("amount"), F.col("volume"))).alias("avg_price_sum"),
    )


@query(
    "marketable_orders",
    f"""{W}, u AS (
  SELECT date, symbol, local_us, exch_ms, channel, serial, NULL AS bid, NULL AS ask, price, bsflag, volume, market, order_type FROM ord WHERE order_type <> 'S'
  UNION ALL SELECT date, symbol, local_us, exch_ms, channel, serial, bp[1], ap[1], NULL, NULL, NULL, NULL, NULL FROM quotes),
j AS (SELECT *, last_value(CASE WHEN bid IS NOT NULL THEN (bid, ask) END IGNORE NULLS) OVER (PARTITION BY date, symbol
  ORDER BY local_us, exch_ms, channel, serial ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS q FROM u),
o AS (SELECT *, CASE WHEN bsflag = 'B' AND q[2] > 0 THEN price >= q[2] WHEN bsflag = 'S' AND q[1] > 0 THEN price <= q[1] END AS hit,
  CASE WHEN bsflag = 'B' AND q[2] > 0 THEN q[2] - price WHEN bsflag = 'S' AND q[1] > 0 THEN price - q[1] END AS gap FROM j WHERE price IS NOT NULL)
SELECT date, symbol, bsflag, count(*) AS orders, CAST(sum(CASE WHEN hit THEN 1 ELSE 0 END) AS BIGINT) AS marketable,
  CAST(sum(greatest(0, coalesce(gap, 0))) AS BIGINT) AS distance, CAST(sum(CASE WHEN q IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS unquoted
FROM o GROUP BY ALL""",
)
def marketable_orders(spark, sf_dir):
    """Orders against the last quote that arrived before them."""
    s = fx.streams(spark, sf_dir)
    o = s.orders.filter("order_type <> 'S'").select("date", "symbol", *ORDER_KEY, "price", "bsflag", "volume")
    q = s.quotes.withColumns({"bid": F.col("bp")[0], "ask": F.col("ap")[0]})
    j = as_of_quote(o, q, ["bid", "ask"])
    bid, ask = F.col("quote.bid"), F.col("quote.ask")
    return j.groupBy("date", "symbol", "bsflag").agg(
        F.count(F.lit(1)).alias("orders"),
        F.count_if(sc.marketable(bid, ask)).alias("marketable"),
        F.sum(sc.touch_distance(bid, ask)).alias("distance"),
        F.count_if(F.col("quote").isNull()).alias("unquoted"),
    )


@query(
    "safe_math",
    f"""SELECT l_suppkey, {r6s("sum(CASE WHEN abs(l_tax) < 1e-9 THEN l_discount / (l_tax + 1e-9) ELSE l_discount / l_tax END)")} AS guarded,
  {r6s("sum(greatest(0.0, least(1.0, l_quantity / 40)))")} AS clamped,
  {r6s("sum(ln(1 + l_quantity) + log2(l_quantity) + exp(-l_quantity) + sqrt(l_quantity) + pow(l_quantity, 1.5) + tanh(l_discount) + sign(l_discount - 0.05))")} AS math
FROM lineitem GROUP BY l_suppkey""",
)
def safe_math(spark, sf_dir):
    """Guarded division, clamping and the math functions the factors use."""
    li = fx.table(spark, sf_dir, "lineitem")
    q, d = F.col("l_quantity"), F.col("l_discount")
    math = F.log1p(q) + F.log2(q) + F.exp(-q) + F.sqrt(q) + F.pow(q, F.lit(1.5)) + F.tanh(d) + F.signum(d - 0.05)
    return li.groupBy("l_suppkey").agg(
        sc.r6(F.sum(sc.safe_divide(d, F.col("l_tax")))).alias("guarded"),
        sc.r6(F.sum(sc.clamp01(q / 40))).alias("clamped"),
        sc.r6(F.sum(math)).alias("math"),
    )


@query(
    "code_keys",
    """WITH c AS (SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, CASE WHEN s_nationkey % 3 = 0 THEN '6' ELSE '0' END)
    || CASE WHEN s_nationkey % 3 = 0 THEN '.SH' ELSE '.SZ' END AS code, s_acctbal FROM supplier)
SELECT split_part(code, '.', 1) AS symbol, lpad(CAST(CAST(floor(abs(s_acctbal)) AS BIGINT) AS VARCHAR), 6, '0') AS universe,
  CASE WHEN substr(code, 1, 1) IN ('0', '3') THEN 'SZ' WHEN substr(code, 1, 1) = '6' THEN 'SH' END AS market,
  CASE WHEN substr(code, 1, 1) IN ('0', '3') THEN 0 WHEN substr(code, 1, 1) = '6' THEN 1 ELSE 2 END AS market_rank
FROM c WHERE substr(code, 1, 1) IN ('0', '3', '6')""",
)
def code_keys(spark, sf_dir):
    """Symbol normalisation, market of a code and the Shenzhen-first row order."""
    s = fx.table(spark, sf_dir, "supplier")
    sh = F.col("s_nationkey") % 3 == 0
    text = F.col("s_suppkey").cast("string")
    code = F.concat(F.when(sh, F.lpad(text, 6, "6")).otherwise(F.lpad(text, 6, "0")), F.when(sh, ".SH").otherwise(".SZ"))
    c = s.withColumn("code", code).filter(F.substring("code", 1, 1).isin("0", "3", "6"))
    return c.select(
        sc.symbol_code(F.col("code")).alias("symbol"),
        sc.universe_code(F.floor(F.abs("s_acctbal")).cast("string")).alias("universe"),
        sc.market_of_code(F.col("code")).alias("market"),
        sc.market_rank(F.col("code")).alias("market_rank"),
    )


@query(
    "content_hashes",
    """SELECT CAST(year(o_orderdate) AS VARCHAR) AS year,
  'sha256:' || sha256(string_agg(DISTINCT strftime(o_orderdate, '%Y%m%d'), chr(10) ORDER BY strftime(o_orderdate, '%Y%m%d')) || chr(10)) AS date_list_hash,
  count(DISTINCT o_orderdate) AS dates FROM orders GROUP BY ALL""",
)
def content_hashes(spark, sf_dir):
    """Hash of the sorted distinct date list of each year (a calendar-sized list)."""
    o = fx.table(spark, sf_dir, "orders")
    day = F.date_format("o_orderdate", "yyyyMMdd")
    return o.groupBy(F.year("o_orderdate").cast("string").alias("year")).agg(
        sc.list_hash(day).alias("date_list_hash"), F.count_distinct("o_orderdate").alias("dates")
    )


@query(
    "structure_signatures",
    """WITH d AS (SELECT DISTINCT p_brand, p_type, p_name FROM part),
s AS (SELECT p_brand, p_type, p_name, 'sha256:' || sha256('{"formula":"' || trim(regexp_replace(lower('SUM(' || p_name || ')   / ' || p_type), '\\s+', ' ', 'g'))
   || '","inputs":["' || array_to_string(list_sort([p_brand, 'quote']), '","') || '"],"operators":["rolling"]}') AS signature FROM d)
SELECT p_brand, p_type, p_name, signature, count(*) OVER (PARTITION BY signature) AS copies FROM s""",
)
def structure_signatures(spark, sf_dir):
    """Definitions that compute the same thing share a signature; names and spacing do not matter."""
    d = fx.table(spark, sf_dir, "part").select("p_brand", "p_type", "p_name").distinct()
    formula = F.concat(F.lit("SUM("), "p_name", F.lit(")   / "), "p_type")
    s = d.withColumn("signature", sc.structure_signature(F.array("p_brand", F.lit("quote")), F.array(F.lit("rolling")), formula))
    copies = s.groupBy("signature").agg(F.count(F.lit(1)).alias("copies"))
    return s.join(copies, "signature").select("p_brand", "p_type", "p_name", "signature", "copies")


@query(
    "date_splits",
    """WITH d AS (SELECT strftime(o_orderdate + INTERVAL 25 YEAR, '%Y%m%d') AS date FROM orders)
SELECT CASE WHEN date BETWEEN '20210104' AND '20221230' THEN 'training' WHEN date BETWEEN '20230103' AND '20241231' THEN 'observation'
  WHEN date >= '20250101' THEN 'holdout' END AS split, substr(date, 1, 4) AS year,
  substr(date, 1, 4) || 'Q' || CAST((CAST(substr(date, 5, 2) AS INTEGER) + 2) // 3 AS VARCHAR) AS quarter, count(*) AS rows FROM d GROUP BY ALL""",
)
def date_splits(spark, sf_dir):
    """Frozen split ranges with year and quarter buckets."""
    o = fx.table(spark, sf_dir, "orders")
    date = F.date_format(F.col("o_orderdate") + F.expr("INTERVAL 25 YEAR"), "yyyyMMdd")
    d = o.select(date.alias("date"))
    return d.groupBy(
        sc.split_of(F.col("date")).alias("split"), sc.year_bucket(F.col("date")).alias("year"), sc.quarter_bucket(F.col("date")).alias("quarter")
    ).agg(F.count(F.lit(1)).alias("rows"))


@query(
    "arrival_positions",
    f"""{W}, u AS (SELECT date, symbol, local_us, exch_ms, channel, serial FROM trades UNION ALL
  SELECT date, symbol, local_us, exch_ms, channel, serial FROM quotes UNION ALL SELECT date, symbol, local_us, exch_ms, channel, serial FROM ord)
SELECT date, symbol, channel, serial, row_number() OVER (PARTITION BY date, symbol ORDER BY local_us, exch_ms, channel, serial) AS seq FROM u""",
)
def arrival_positions(spark, sf_dir):
    """Union of the three streams in arrival order, numbered per stock-day without a single-task window."""
    s = fx.streams(spark, sf_dir)
    u = None
    for part in s.present():
        p = part.select("date", "symbol", *ORDER_KEY)
        u = p if u is None else u.unionByName(p)
    return number_rows(u, ["date", "symbol"]).select("date", "symbol", "channel", "serial", "seq")


@query(
    "latest_state_at_cuts",
    f"""{W}, z AS (SELECT t.date, t.symbol, c.event, t.price, t.volume, row_number() OVER (PARTITION BY t.date, t.symbol, c.event
  ORDER BY t.local_us DESC, t.exch_ms DESC, t.channel DESC, t.serial DESC) AS rn, count(*) OVER (PARTITION BY t.date, t.symbol, c.event) AS n
  FROM trades t JOIN cuts c ON t.date = c.date AND (t.local_us, t.exch_ms, t.channel, t.serial) < c.cut WHERE t.symbol % 2 = 0),
g AS (SELECT DISTINCT t.date, t.symbol, c.event FROM trades t JOIN cuts c ON t.date = c.date WHERE t.symbol % 2 = 0)
SELECT g.date, g.symbol, g.event, z.price, z.volume, coalesce(z.n, 0) AS seen FROM g LEFT JOIN z ON z.date = g.date AND z.symbol = g.symbol AND z.event = g.event AND z.rn = 1""",
)
def latest_state_at_cuts(spark, sf_dir):
    """Tracked codes only, but the cut comes from every stream and symbol; idle codes still emit a row."""
    s = fx.streams(spark, sf_dir)
    cuts = market_cuts(s.present())
    codes = s.trades.select("date", "symbol").filter("symbol % 2 = 0").distinct()
    t = tracked(s.trades, codes)
    latest = latest_at_cuts(t, cuts, ["price", "volume"]).select("date", "symbol", "event", "price", "volume")
    seen = totals_at_cuts(t, cuts, {"seen": ("sum", F.lit(1).cast("bigint"))})
    keys = ["date", "symbol", "event"]
    return (
        grid_at_cuts(codes, cuts)
        .join(latest, keys, "left")
        .join(seen, keys, "left")
        .select(*keys, "price", "volume", F.coalesce("seen", F.lit(0)).cast("bigint").alias("seen"))
    )


@query(
    "segment_counts",
    f"""{W} SELECT date, symbol, seg, count(*) AS rows FROM (
  SELECT t.date, t.symbol, t.serial, t.local_us, count(c.event) FILTER (WHERE c.cut <= (t.local_us, t.exch_ms, t.channel, t.serial)) AS seg, count(*) AS n
  FROM trades t JOIN cuts c ON t.date = c.date GROUP BY t.date, t.symbol, t.serial, t.local_us) WHERE seg < n GROUP BY ALL""",
)
def segment_counts(spark, sf_dir):
    """Trades between successive checkpoints."""
    s = fx.streams(spark, sf_dir)
    seg = assign_segment(s.trades, market_cuts(s.present()))
    return seg.groupBy("date", "symbol", F.col("_seg").cast("bigint").alias("seg")).agg(F.count(F.lit(1)).alias("rows"))
