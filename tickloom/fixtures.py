"""Market-shaped views over the driver tables, and the same views as oracle SQL.

``lineitem`` plays one exchange feed: a calendar year is a trading day, the day of
the year is the minute of the session (09:25 + n minutes), a supplier is a stock.
Every row is read; nothing is sampled or bounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickloom.plans.registry import Streams

HOUR_US = 3_600_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- feed over lineitem ---------------------------------------------------------------------

_FEED_SPARK = """
  CAST(year(l_shipdate) AS STRING) || '0104' AS date,
  l_suppkey AS symbol,
  CAST(33900000 + (dayofyear(l_shipdate) - 1) * 60000 + (l_orderkey % 60) * 1000 AS BIGINT) AS exch_ms,
  CAST((l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS BIGINT) AS serial,
  CAST(48 + l_suppkey % 2 AS SMALLINT) AS market,
  CAST(100000 + l_suppkey * 100 + (l_orderkey % 50) AS BIGINT) AS base,
  CAST(CASE WHEN l_linenumber = 7 AND l_tax >= 0.08 THEN -10 ELSE 10 * (1 + l_linenumber % 3) END AS BIGINT) AS spread,
  l_orderkey, l_partkey, l_linenumber, l_returnflag, l_linestatus, l_quantity, l_extendedprice, l_discount, l_tax
"""
_FEED_DUCK = _FEED_SPARK.replace("AS STRING)", "AS VARCHAR)")

_TRADE = """
  date, symbol, (exch_ms + (l_partkey % 7) * 1000) * 1000 + 1 AS local_us, exch_ms, 1 AS channel, serial, market,
  CASE l_returnflag WHEN 'A' THEN 'B' WHEN 'R' THEN 'S' ELSE 'N' END AS bsflag,
  CASE WHEN l_returnflag = 'N' THEN 'C' ELSE '0' END AS trade_type,
  CAST(floor(l_extendedprice * 10000 / l_quantity) AS BIGINT) AS price,
  CAST(l_quantity AS BIGINT) AS volume,
  CAST(floor(l_extendedprice) AS BIGINT) AS amount,
  CAST(l_orderkey + 1 AS BIGINT) AS buy_id,
  CAST(l_partkey + 1 AS BIGINT) AS sell_id,
  serial AS trade_index, serial AS biz_index
"""

_ORDER = """
  date, symbol, (exch_ms + (l_linenumber % 4) * 1000) * 1000 AS local_us, exch_ms, 2 AS channel, serial, market,
  CASE WHEN l_linenumber = 6 THEN 'S' WHEN l_returnflag = 'N' AND market = 49 THEN 'D' ELSE 'A' END AS order_type,
  CASE l_linestatus WHEN 'O' THEN 'B' ELSE 'S' END AS bsflag,
  CAST(CASE WHEN l_linenumber = 5 THEN 0 ELSE l_orderkey + 1 END AS BIGINT) AS order_index,
  CAST(CASE WHEN l_linenumber = 4 THEN 0 ELSE l_orderkey + 1 END AS BIGINT) AS orderorino,
  serial AS biz_index,
  base + ((l_partkey % 5) - 2) * 10 AS price,
  CAST(l_quantity AS BIGINT) * 10 AS volume
"""

_QUOTE_HEAD = "date, symbol, (exch_ms + (l_orderkey % 5) * 1000) * 1000 AS local_us, exch_ms, 0 AS channel, serial, base AS last_px"
_LADDER = {
    "bp": "base - 10 * {i}",
    "ap": "base + spread + 10 * {i}",
    "bv": "(l_partkey * ({i} + 3) + l_orderkey) % 97 * 10",
    "av": "(l_partkey + l_orderkey * ({i} + 2)) % 89 * 10",
}
_QUOTE_SPARK = f"{_QUOTE_HEAD}, " + ", ".join(
    f"array({', '.join(step.format(i=i) for i in range(10))}) AS {name}" for name, step in _LADDER.items()
)
_QUOTE_DUCK = f"{_QUOTE_HEAD}, " + ", ".join(
    f"list_transform(range(0, 10), lambda i: {step.format(i='i')}) AS {name}" for name, step in _LADDER.items()
)


def _exprs(text: str) -> list[str]:
    """Split a select list on its top-level commas."""
    parts, depth, last = [], 0, 0
    for at, ch in enumerate(text):
        if ch in "([":
            depth += 1
        elif ch in ")]":
            depth -= 1
        elif ch == "," and depth == 0:
            parts.append(text[last:at].strip())
            last = at + 1
    return [p for p in [*parts, text[last:].strip()] if p]


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*_exprs(_FEED_SPARK))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed(spark, sf_dir).selectExpr(*_exprs(_TRADE))


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed(spark, sf_dir).selectExpr(*_exprs(_QUOTE_SPARK))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed(spark, sf_dir).selectExpr(*_exprs(_ORDER))


def streams(spark: SparkSession, sf_dir: str) -> Streams:
    return Streams(quotes(spark, sf_dir), trades(spark, sf_dir), orders(spark, sf_dir))


FEED_SQL = f"feed AS (SELECT {_FEED_DUCK} FROM lineitem)"
TRADES_SQL = f"trades AS (SELECT {_TRADE} FROM feed)"
QUOTES_SQL = f"quotes AS (SELECT {_QUOTE_DUCK} FROM feed)"
ORDERS_SQL = f"ord AS (SELECT {_ORDER} FROM feed)"

#: the arrival key as a DuckDB row value
KEY = "(local_us, exch_ms, channel, serial)"

CHECKPOINT_ROWS = (
    "checkpoints AS (SELECT * FROM (VALUES (92700000, 34020000), (100000000, 36000000), (103000000, 37800000), "
    "(110000000, 39600000), (113000000, 41400000), (133000000, 48600000), (140000000, 50400000), (143000000, 52200000)) "
    "AS t(event, event_ms))"
)
CUTS_SQL = f"""{CHECKPOINT_ROWS},
all_keys AS (
  SELECT date, exch_ms, {KEY} AS k FROM trades UNION ALL
  SELECT date, exch_ms, {KEY} AS k FROM quotes UNION ALL
  SELECT date, exch_ms, {KEY} AS k FROM ord),
cuts AS (
  SELECT date, CAST(event AS BIGINT) AS event, event_ms, min(k) AS cut
  FROM all_keys JOIN checkpoints ON exch_ms >= event_ms GROUP BY date, event, event_ms)"""

MARKET_SQL = ",\n".join([FEED_SQL, TRADES_SQL, QUOTES_SQL, ORDERS_SQL, CUTS_SQL])


def r6s(expr: str) -> str:
    """The report rounding of ``scalar.r6`` as SQL text."""
    return f"floor(({expr})::DOUBLE * 1e6 + 0.5001) / 1e6"


# --- evaluation panel over lineitem ---------------------------------------------------------
# A month is a date (moved into 2021 and later), a line number an event, a supplier a symbol.
# Factor values are ratios of exact integers, so that ranks do not depend on summation order.

# Published event codes.
EVENTS = [92600000, 100000000, 103000000, 110000000, 113000000, 133000000, 140000000, 143000000]

PANEL_FACTORS = ["fa", "fb", "fc"]

_MONTH_SPARK = "CAST(year(l_shipdate) + 26 AS STRING) || lpad(CAST(month(l_shipdate) AS STRING), 2, '0') || '15'"
_MONTH_DUCK = _MONTH_SPARK.replace("STRING", "VARCHAR")
_EVENT_SPARK = f"element_at(array({', '.join(f'{e}L' for e in EVENTS)}), l_linenumber)"
_EVENT_DUCK = f"CAST(([{', '.join(map(str, EVENTS))}])[l_linenumber] AS BIGINT)"

_PANEL = """
  l_suppkey AS symbol,
  sum(CAST(floor(l_extendedprice) AS BIGINT)) / CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS fa,
  CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS fb,
  sum(CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN -1 ELSE 0 END) / CAST(count(*) AS DOUBLE) AS fc,
  count(*) AS n
"""


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide factor panel with readiness: one row per date, event and symbol."""
    t = table(spark, sf_dir, "lineitem").selectExpr("*", f"{_MONTH_SPARK} AS date", f"{_EVENT_SPARK} AS event")
    t.createOrReplaceTempView("tickloom_panel_rows")
    p = spark.sql(f"SELECT date, event, {_PANEL} FROM tickloom_panel_rows GROUP BY date, event, l_suppkey")
    ready = {"fa": "true", "fb": "n >= 2", "fc": "event <> 92600000"}
    return p.selectExpr(
        "symbol", "date", "event", "n", *PANEL_FACTORS,
        *[f"{r} AS ready_{f}" for f, r in ready.items()],
        *[f"CAST(CASE WHEN {r} THEN 0 ELSE {3 if f == 'fb' else 4} END AS SMALLINT) AS reason_{f}" for f, r in ready.items()],
    )


PANEL_SQL = f"""panel0 AS (SELECT {_MONTH_DUCK} AS date, {_EVENT_DUCK} AS event, {_PANEL} FROM lineitem GROUP BY 1, 2, l_suppkey),
panel AS (SELECT symbol, date, event, n, fa, fb, fc, true AS ready_fa, n >= 2 AS ready_fb, event <> 92600000 AS ready_fc,
  0 AS reason_fa, CASE WHEN n >= 2 THEN 0 ELSE 3 END AS reason_fb, CASE WHEN event <> 92600000 THEN 0 ELSE 4 END AS reason_fc FROM panel0)"""


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Next-date return of the price factor, demeaned per date and event, and per nation as well."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    p = panel(spark, sf_dir).select("symbol", "date", "event", "fa")
    # one row per date: bounded by the calendar
    nxt = F.lead("fa").over(Window.partitionBy("symbol", "event").orderBy("date"))
    raw = p.withColumn("r", (nxt - F.col("fa")) / F.col("fa")).filter("r IS NOT NULL")
    s = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS symbol", "s_nationkey AS nation")
    raw = raw.join(s, "symbol")
    day = raw.groupBy("date", "event").agg(F.avg("r").alias("m"))
    nation = raw.groupBy("date", "event", "nation").agg(F.avg("r").alias("mn"))
    return (
        raw.join(day, ["date", "event"])
        .join(nation, ["date", "event", "nation"])
        .selectExpr("symbol", "date", "event", "r - m AS v_1D_v_demean", "CASE WHEN nation % 11 <> 3 THEN r - mn END AS v_1D_v_neuted")
    )


LABELS_SQL = """raw AS (SELECT * FROM (SELECT symbol, date, event, (lead(fa) OVER (PARTITION BY symbol, event ORDER BY date) - fa) / fa AS r FROM panel) WHERE r IS NOT NULL),
rawn AS (SELECT raw.*, s_nationkey AS nation FROM raw JOIN supplier ON s_suppkey = symbol),
labels_p AS (SELECT symbol, date, event, r - avg(r) OVER (PARTITION BY date, event) AS v_1D_v_demean,
  CASE WHEN nation % 11 <> 3 THEN r - avg(r) OVER (PARTITION BY date, event, nation) END AS v_1D_v_neuted FROM rawn)"""


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide membership and tradability by exchange-suffixed code."""
    return table(spark, sf_dir, "supplier").selectExpr(
        "CAST(s_suppkey AS STRING) || '.SZ' AS code",
        "1 AS `000985`",
        "CASE WHEN s_nationkey < 15 THEN 1 ELSE 0 END AS `003800`",
        "CASE WHEN s_nationkey % 2 = 0 THEN 1 ELSE 0 END AS `000906`",
        "CASE WHEN s_acctbal < 0 THEN 1 ELSE 0 END AS isdt1",
        "CASE WHEN s_nationkey = 7 THEN 1 ELSE 0 END AS iszt1",
    )


UNIVERSE_SQL = """members AS (SELECT s_suppkey AS symbol, u.universe, (CASE WHEN s_acctbal < 0 THEN 1 ELSE 0 END) + (CASE WHEN s_nationkey = 7 THEN 1 ELSE 0 END) = 0 AS tradable
  FROM supplier, (VALUES ('000985'), ('003800'), ('000906')) AS u(universe)
  WHERE u.universe = '000985' OR (u.universe = '003800' AND s_nationkey < 15) OR (u.universe = '000906' AND s_nationkey % 2 = 0))"""


# --- metric panel over lineitem -------------------------------------------------------------

_METRIC = """
  'f' || CAST(l_suppkey % 6 AS {T}) AS factor,
  CASE WHEN CAST(floor(l_tax * 100 + 0.5) AS BIGINT) % 2 = 0 THEN '000906' ELSE '000985' END AS universe,
  CASE l_linestatus WHEN 'O' THEN 'raw926' ELSE 'ease926' END AS label,
  CAST(l_quantity AS BIGINT) AS q, CAST(floor(l_discount * 100 + 0.5) AS BIGINT) AS d
"""
_METRIC_AGG = """
  count(*) AS n,
  (sum(q) - 25 * count(*)) / CAST(100 * count(*) AS DOUBLE) AS RankIC,
  CASE WHEN count(*) > 1 THEN (sum(d) - 5 * count(*)) / CAST(20 * count(*) AS DOUBLE) END AS IC,
  (sum(q) - 24 * count(*)) / CAST(1000 * count(*) AS DOUBLE) AS LS,
  (26 * count(*) - sum(q)) / CAST(50 * count(*) AS DOUBLE) AS Monotonicity
"""
CORE = ["RankIC", "IC", "LS", "Monotonicity"]


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric panel in wide-by-metric form: split, label, universe, date, event, factor, four metrics."""
    from tickloom.functions.scalar import split_of
    from pyspark.sql import functions as F

    t = table(spark, sf_dir, "lineitem").selectExpr(
        f"{_MONTH_SPARK} AS date", f"{_EVENT_SPARK} AS event", *_exprs(_METRIC.format(T="STRING"))
    )
    t.createOrReplaceTempView("tickloom_metric_rows")
    m = spark.sql(
        f"SELECT date, event, factor, universe, label, {_METRIC_AGG} FROM tickloom_metric_rows GROUP BY date, event, factor, universe, label"
    )
    return m.withColumn("split", split_of(F.col("date"))).filter("split IS NOT NULL")


METRICS_SQL = f"""metric_rows AS (SELECT {_MONTH_DUCK} AS date, {_EVENT_DUCK} AS event, {_METRIC.format(T="VARCHAR")} FROM lineitem),
metrics AS (SELECT *, CASE WHEN date BETWEEN '20210104' AND '20221230' THEN 'training' WHEN date BETWEEN '20230103' AND '20241231' THEN 'observation'
  WHEN date >= '20250101' THEN 'holdout' END AS split FROM (
  SELECT date, event, factor, universe, label, {_METRIC_AGG} FROM metric_rows GROUP BY date, event, factor, universe, label)
  WHERE date >= '20210104' AND NOT (date > '20221230' AND date < '20230103') AND NOT (date > '20241231' AND date < '20250101'))"""


# --- parent orders and fills over orders and lineitem ---------------------------------------

_PARENT = """
  CAST(20240102 + {k} % 5 AS {T}) AS date, CAST({k} // 5 % 40 AS BIGINT) AS symbol, CAST(48 + {k} // 5 % 40 % 2 AS SMALLINT) AS market
"""
_BOOKED_HEAD = _PARENT.format(k="o_orderkey", T="{T}") + """,
  CAST(34200000 + {DAY_O} % 2640 * 7500 AS BIGINT) AS exch_ms, o_orderkey, o_orderdate, o_totalprice, o_orderkey AS serial
"""
_BOOKED = """
  date, symbol, market, (exch_ms + (o_orderkey % 4) * 4000) * 1000 AS local_us, exch_ms, 2 AS channel, serial,
  CASE WHEN market = 49 THEN 'A' ELSE '0' END AS order_type, CASE WHEN o_orderkey // 200 % 2 = 0 THEN 'B' ELSE 'S' END AS bsflag,
  CAST(o_orderkey + 1 AS BIGINT) AS order_index, CAST(o_orderkey + 1 AS BIGINT) AS orderorino, exch_ms * 10 + 5 AS biz_index,
  CAST(100000 + o_orderkey % 40 AS BIGINT) AS price, CAST(floor(o_totalprice / 1000) AS BIGINT) AS volume
"""
_DONE_HEAD = _PARENT.format(k="l_orderkey", T="{T}") + """,
  CAST(34200000 + {DAY_L} % 2640 * 7500 AS BIGINT) AS exch_ms, l_orderkey, l_partkey, l_returnflag, l_quantity, l_extendedprice, l_orderkey // 200 % 2 = 0 AS buys,
  CAST(100000000000 + (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS BIGINT) AS serial
"""
_DONE = """
  date, symbol, market, (exch_ms + (l_partkey % 5) * 3000) * 1000 + 1 AS local_us, exch_ms, 1 AS channel, serial,
  CASE l_returnflag WHEN 'A' THEN 'B' WHEN 'R' THEN 'S' ELSE 'N' END AS bsflag, CASE WHEN l_returnflag = 'N' THEN 'C' ELSE '0' END AS trade_type,
  CAST(100000 + l_partkey % 50 AS BIGINT) AS price, CAST(l_quantity AS BIGINT) AS volume, CAST(floor(l_extendedprice) AS BIGINT) AS amount,
  CAST(CASE WHEN buys THEN l_orderkey + 1 WHEN l_returnflag = 'N' THEN 0 ELSE l_orderkey + 1 + 200 * (1 + 2 * (l_partkey % 12)) END AS BIGINT) AS buy_id,
  CAST(CASE WHEN NOT buys THEN l_orderkey + 1 WHEN l_returnflag = 'N' THEN 0 ELSE l_orderkey + 1 + 200 * (1 + 2 * (l_partkey % 12)) END AS BIGINT) AS sell_id,
  serial AS trade_index, exch_ms * 10 + 4 AS biz_index, l_orderkey
"""
_DELETE = """
  date, symbol, market, local_us, exch_ms, 2 AS channel, serial, 'D' AS order_type, CASE WHEN buy_id > 0 THEN 'B' ELSE 'S' END AS bsflag,
  CAST(l_orderkey + 1 AS BIGINT) AS order_index, CAST(l_orderkey + 1 AS BIGINT) AS orderorino, biz_index, price, volume
"""


def _spark_div(text: str) -> str:
    return text.replace(" // ", " div ")


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades of the parent orders; Shanghai cancels live in the order stream instead."""
    head = _spark_div(_DONE_HEAD.format(T="STRING", DAY_L="datediff(l_shipdate, DATE '1992-01-01')"))
    t = table(spark, sf_dir, "lineitem").selectExpr(*_exprs(head)).selectExpr(*_exprs(_DONE))
    return t


def lifecycle_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fills(spark, sf_dir).filter("NOT (market = 49 AND trade_type = 'C')").drop("l_orderkey")


def lifecycle_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = _spark_div(_BOOKED_HEAD.format(T="STRING", DAY_O="datediff(o_orderdate, DATE '1992-01-01')"))
    adds = table(spark, sf_dir, "orders").selectExpr(*_exprs(head)).selectExpr(*_exprs(_spark_div(_BOOKED)))
    deletes = fills(spark, sf_dir).filter("market = 49 AND trade_type = 'C'").selectExpr(*_exprs(_DELETE))
    return adds.unionByName(deletes)


LIFECYCLE_SQL = f"""booked0 AS (SELECT {_BOOKED_HEAD.format(T="VARCHAR", DAY_O="date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE))")} FROM orders),
done0 AS (SELECT {_DONE_HEAD.format(T="VARCHAR", DAY_L="date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE))")} FROM lineitem),
done AS (SELECT {_DONE} FROM done0),
lt AS (SELECT * EXCLUDE (l_orderkey) FROM done WHERE NOT (market = 49 AND trade_type = 'C')),
lo AS (SELECT {_BOOKED} FROM booked0 UNION ALL BY NAME SELECT {_DELETE} FROM done WHERE market = 49 AND trade_type = 'C')"""

_LQUOTE_HEAD = """
  date, symbol, market, (exch_ms + (o_orderkey % 3) * 2000) * 1000 AS local_us, exch_ms, 0 AS channel, serial, 100020 AS last_px
"""
_LLADDER = {
    "bp": "100019 - 2 * {i}",
    "ap": "100021 + (o_orderkey % 3) + 2 * {i}",
    "bv": "(o_orderkey * ({i} + 3)) % 97 + 5",
    "av": "(o_orderkey * ({i} + 2)) % 89 + 5",
}
_LQUOTE_SPARK = f"{_LQUOTE_HEAD}, " + ", ".join(f"array({', '.join('CAST(' + s.format(i=i) + ' AS BIGINT)' for i in range(10))}) AS {n}" for n, s in _LLADDER.items())
_LQUOTE_DUCK = f"{_LQUOTE_HEAD}, " + ", ".join(f"list_transform(range(0, 10), lambda i: CAST({s.format(i='i')} AS BIGINT)) AS {n}" for n, s in _LLADDER.items())


def lifecycle_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = _spark_div(_BOOKED_HEAD.format(T="STRING", DAY_O="datediff(o_orderdate, DATE '1992-01-01')"))
    return table(spark, sf_dir, "orders").selectExpr(*_exprs(head)).selectExpr(*_exprs(_LQUOTE_SPARK))


def lifecycle_streams(spark: SparkSession, sf_dir: str) -> Streams:
    return Streams(lifecycle_quotes(spark, sf_dir), lifecycle_trades(spark, sf_dir), lifecycle_orders(spark, sf_dir))


LIFECYCLE_CUTS_SQL = f"""lq AS (SELECT {_LQUOTE_DUCK} FROM booked0), {CHECKPOINT_ROWS},
lkeys AS (SELECT date, exch_ms, {KEY} AS k FROM lt UNION ALL SELECT date, exch_ms, {KEY} AS k FROM lo UNION ALL SELECT date, exch_ms, {KEY} AS k FROM lq),
cuts AS (SELECT date, CAST(event AS BIGINT) AS event, event_ms, min(k) AS cut FROM lkeys JOIN checkpoints ON exch_ms >= event_ms GROUP BY date, event, event_ms)"""
