"""Daily files, eligibility, exposures, sequential fits and log quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom import fixtures as fx
from tickloom.catalog import query
from tickloom.fixtures import r6s
from tickloom.functions.scalar import r6
from tickloom.operators import fits
from tickloom.operators import toolbox as tb
from tickloom.operators.sequence import running
from tickloom.sources import daily as dl
from tickloom.sources import ledger

_LINE = "lpad(CAST(p_partkey AS {T}), 6, '0') || 'XX,' || CASE WHEN p_size % 7 = 0 THEN '' WHEN p_size % 11 = 0 THEN 'n/a' ELSE CAST(p_size AS {T}) END || ',1,2,' || CAST(p_size * 3 AS {T}) || ',' || CASE WHEN p_size % 5 = 0 THEN '9' ELSE '4.5,100,2000,7' END"


@query(
    "daily_file",
    f"""WITH l AS (SELECT p_size, p_partkey, {_LINE.format(T="VARCHAR")} AS line FROM part), f AS (SELECT p_partkey, string_split(line, ',') AS f FROM l),
r AS (SELECT substr(trim(f[1]), 1, 6) AS ticker, coalesce(TRY_CAST(f[2] AS DOUBLE), 0) AS high, coalesce(TRY_CAST(f[5] AS DOUBLE), 0) AS close, coalesce(TRY_CAST(f[6] AS DOUBLE), 0) AS vwap, coalesce(TRY_CAST(f[9] AS DOUBLE), 0) AS ashare, p_partkey FROM f WHERE len(f) >= 9)
SELECT ticker, high, close, vwap, ashare FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY p_partkey DESC) AS rn FROM r) WHERE rn = 1""",
)
def daily_file(spark, sf_dir):
    """Daily stock lines: short lines skipped, bad numbers 0, last duplicate wins."""
    lines = fx.table(spark, sf_dir, "part").select(F.expr(_LINE.format(T="STRING")).alias("line"), F.col("p_partkey").alias("line_no"))
    return dl.parse_daily(lines).select("ticker", "high", "close", "vwap", "ashare")


@query(
    "code_list",
    "SELECT DISTINCT substr(code, 1, 6) AS symbol FROM (SELECT lpad(CAST(p_partkey * 997 % 1000000 AS VARCHAR), 6, '0') || '.XX' AS code FROM part) WHERE substr(code, 1, 1) IN ('0', '3', '6')",
)
def code_list(spark, sf_dir):
    """Stock codes of the three prefixes."""
    codes = fx.table(spark, sf_dir, "part").select(F.expr("lpad(CAST(p_partkey * 997 % 1000000 AS STRING), 6, '0') || '.XX'").alias("code"))
    return dl.code_list(codes)


@query("calendar_range", "SELECT DISTINCT CAST(o_orderdate AS DATE)::VARCHAR AS date FROM orders WHERE CAST(o_orderdate AS DATE)::VARCHAR BETWEEN '1996-03-01' AND '1997-02-15'")
def calendar_range(spark, sf_dir):
    """Trading dates inside a range."""
    cal = fx.table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").cast("string").alias("date")).distinct()
    return dl.calendar_range(cal, "1996-03-01", "1997-02-15")


DAILY_SQL = """d0 AS (SELECT CAST(year(o_orderdate) AS VARCHAR) AS date, o_custkey AS symbol, min(o_totalprice) AS low, max(o_totalprice) AS high, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS amount, count(*) AS volume,
  arg_min(o_totalprice, (o_orderdate, o_orderkey)) AS open, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS close FROM orders GROUP BY ALL),
d AS (SELECT d0.*, c_mktsegment AS industry, CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS st, c_nationkey * 5 AS list_days, 1 + c_nationkey % 4 AS adj FROM d0 JOIN customer ON c_custkey = symbol)"""


def daily(spark, sf_dir):
    o = fx.table(spark, sf_dir, "orders")
    key = F.struct("o_orderdate", "o_orderkey")
    d = o.groupBy(F.year("o_orderdate").cast("string").alias("date"), F.col("o_custkey").alias("symbol")).agg(
        F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"), F.sum(F.floor("o_totalprice")).alias("amount"), F.count(F.lit(1)).alias("volume"),
        F.min_by("o_totalprice", key).alias("open"), F.max_by("o_totalprice", key).alias("close"),
    )
    c = fx.table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS symbol", "c_mktsegment AS industry", "CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS st", "c_nationkey * 5 AS list_days", "1 + c_nationkey % 4 AS adj"
    )
    return d.join(c, "symbol")


@query(
    "daily_bars",
    f"""WITH {DAILY_SQL} SELECT date, symbol, {r6s("open / adj * 10000")} AS open, {r6s("high / adj * 10000")} AS high, {r6s("low / adj * 10000")} AS low, {r6s("close / adj * 10000")} AS close, CAST(volume * adj AS BIGINT) AS vol, CAST(volume * 100 AS BIGINT) AS shares, amount * 1000 AS yuan FROM d""",
)
def daily_bars(spark, sf_dir):
    """Daily open, high, low, close with price adjustment and unit scaling."""
    d = daily(spark, sf_dir).withColumns({"vol": F.col("volume"), "vwap": F.col("amount") / F.col("volume")})
    a = dl.previous_day_units(dl.adjusted(d))
    return a.select("date", "symbol", *[r6(F.col(c)).alias(c) for c in ("open", "high", "low", "close")], F.col("vol").cast("bigint").alias("vol"), F.col("volume").cast("bigint").alias("shares"), F.col("amount").cast("bigint").alias("yuan"))


_IND = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query(
    "exposure_matrix",
    f"""WITH {DAILY_SQL}, e AS (SELECT *, ln(amount / volume * volume) AS lm FROM d WHERE st = 0 AND list_days > 20 AND length(industry) > 5),
o AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY lm) AS rn, count(*) OVER (PARTITION BY date) AS n FROM e),
ed AS (SELECT date, max(lm) FILTER (WHERE rn = CAST(floor(n * 0.01::DOUBLE) AS BIGINT) + 1) AS lo, max(lm) FILTER (WHERE rn = n - CAST(floor(n * 0.01::DOUBLE) AS BIGINT)) AS hi FROM o GROUP BY date),
a AS (SELECT o.*, lo, hi, least(greatest(lm, lo), hi) AS v FROM o JOIN ed USING (date)), b AS (SELECT *, avg(v) OVER w AS m, stddev_pop(v) OVER w AS s FROM a WINDOW w AS (PARTITION BY date)),
c AS (SELECT *, least(greatest(v, m - 3 * s), m + 3 * s) AS v2 FROM b), f AS (SELECT *, avg(v2) OVER w AS m2, stddev_pop(v2) OVER w AS s2 FROM c WINDOW w AS (PARTITION BY date))
SELECT date, symbol, {", ".join(f"CASE WHEN industry = '{i}' THEN 1 ELSE 0 END AS ind_{i}" for i in _IND)}, {r6s("CASE WHEN lo = hi THEN lm ELSE (v2 - m2) / (CASE WHEN s2 = 0 THEN 1 ELSE s2 END) END")} AS size FROM f""",
)
def exposure_matrix(spark, sf_dir):
    """Eligible stocks with one-hot industry and standardised log market value."""
    d = daily(spark, sf_dir).withColumns({"vwap": F.col("amount") / F.col("volume"), "free_float": F.col("volume")})
    x = dl.exposure_matrix(d, _IND)
    return x.select("date", "symbol", *[f"ind_{i}" for i in _IND], r6(F.col("size")).alias("size"))


def bars(spark, sf_dir):
    t = running(fx.trades(spark, sf_dir), ["date", "symbol"], {"total": ("sum", F.col("volume"))})
    return tb.minute_bars(t, "price", "total", 1)


def _hundredths(c):
    return F.floor(F.col(c) * 100 + 0.5001) / 100


_BARS = f"""{fx.FEED_SQL}, {fx.TRADES_SQL},
b AS (SELECT date, symbol, exch_ms // 60000 AS bar, last(price ORDER BY local_us, exch_ms, channel, serial)::DOUBLE AS y FROM trades GROUP BY ALL),
l AS (SELECT *, lag(y) OVER w AS py, first_value(y) OVER w AS centre, row_number() OVER w - 1 AS k FROM b WINDOW w AS (PARTITION BY date, symbol ORDER BY bar))"""


@query(
    "garch_fit",
    f"""WITH RECURSIVE {_BARS},
r AS (SELECT date, symbol, y / py - 1 AS r, row_number() OVER (PARTITION BY date, symbol ORDER BY bar) AS n FROM l WHERE py <> 0),
walk AS (
  SELECT date, symbol, 0::BIGINT AS n, 0.01::DOUBLE AS omega, 0.1::DOUBLE AS alpha, 0.85::DOUBLE AS beta, (0.01::DOUBLE / (1 - 0.1::DOUBLE - 0.85::DOUBLE))::DOUBLE AS h, 0.0::DOUBLE AS square FROM (SELECT DISTINCT date, symbol FROM b)
  UNION ALL
  SELECT date, symbol, n, CASE WHEN n = 1 THEN omega ELSE greatest(omega + push, 1e-9) END,
    CASE WHEN n = 1 THEN alpha WHEN a2 + b2 > 0.9999 THEN least(greatest(a2 - (a2 + b2 - 0.9999) / 2, 0), 0.9999) ELSE a2 END,
    CASE WHEN n = 1 THEN beta WHEN a2 + b2 > 0.9999 THEN 0.9999 - least(greatest(a2 - (a2 + b2 - 0.9999) / 2, 0), 0.9999) ELSE b2 END,
    CASE WHEN n = 1 THEN h ELSE hn END, r * r
  FROM (SELECT *, greatest(alpha + push * square, 0) AS a2, greatest(beta + push * h, 0) AS b2
        FROM (SELECT w.*  REPLACE (r.n AS n), r.r, omega + alpha * square + beta * h AS hn, 1e-6::DOUBLE * (r.r * r.r - (omega + alpha * square + beta * h)) / ((omega + alpha * square + beta * h) * (omega + alpha * square + beta * h)) AS push
              FROM walk w JOIN r ON r.date = w.date AND r.symbol = w.symbol AND r.n = w.n + 1)))
SELECT date, symbol, {r6s("omega")} AS omega, {r6s("alpha")} AS alpha, {r6s("beta")} AS beta, {r6s("CASE WHEN n > 1 THEN h ELSE 0 END")} AS variance
FROM walk QUALIFY row_number() OVER (PARTITION BY date, symbol ORDER BY n DESC) = 1""",
)
def garch_fit(spark, sf_dir):
    """GARCH(1,1) on the minute bars of each symbol-day."""
    g = fits.garch_fit(bars(spark, sf_dir))
    return g.select("date", "symbol", *[r6(F.col(c)).alias(c) for c in ("omega", "alpha", "beta", "variance")])


@query(
    "ou_fit",
    f"""WITH {_BARS},
p AS (SELECT date, symbol, bar, centre, k, y - centre AS y, py - centre AS x, pow(1 / 0.995::DOUBLE, k) AS w FROM l WHERE k > 0),
s AS (SELECT *, sum(w) OVER o AS s1, sum(w * x) OVER o AS sx, sum(w * y) OVER o AS sy, sum(w * (x * x)) OVER o AS sxx, sum(w * (x * y)) OVER o AS sxy FROM p WINDOW o AS (PARTITION BY date, symbol ORDER BY bar ROWS UNBOUNDED PRECEDING)),
f AS (SELECT *, CASE WHEN k > 1 AND s1 * sxx - sx * sx > 1e-9 * s1 * sxx THEN (s1 * sxy - sx * sy) / (s1 * sxx - sx * sx) END AS slope FROM s),
g AS (SELECT *, (sy - slope * sx) / s1 AS lev FROM f),
e AS (SELECT *, y - (lag(slope) OVER o * x + lag(lev) OVER o) AS miss FROM g WINDOW o AS (PARTITION BY date, symbol ORDER BY bar)),
z AS (SELECT date, symbol, max(bar) AS bar, sum(w * miss * miss) / sum(CASE WHEN miss IS NOT NULL THEN w END) AS noise FROM e GROUP BY ALL),
q AS (SELECT e.*, noise, CASE WHEN slope IS NOT NULL THEN least(greatest(slope, 1e-9), 0.999999) END AS a, 60.0::DOUBLE / (252.0::DOUBLE * 6.5 * 3600.0) AS dt FROM e JOIN z USING (date, symbol, bar))
SELECT date, symbol, floor(-ln(a) / dt * 100 + 0.5001) / 100 AS theta, CASE WHEN slope < 0.999999 THEN floor(centre + lev / (1 - a) + 0.5001) END AS mu,
  {r6s("sqrt(-2 * ln(a) * noise / (dt * (1 - a * a))) / (y + centre)")} AS relative_sigma, y + centre AS last FROM q""",
)
def ou_fit(spark, sf_dir):
    """Ornstein-Uhlenbeck parameters of the minute bars of each symbol-day."""
    o = fits.ou_fit(bars(spark, sf_dir))
    return o.select("date", "symbol", _hundredths("theta").alias("theta"), F.floor(F.col("mu") + 0.5001).cast("double").alias("mu"), r6(F.col("sigma") / F.col("last")).alias("relative_sigma"), "last")


@query(
    "ledger_quality",
    """WITH l AS (SELECT event_id, event_type, json_extract_string(props, '$.k')::INTEGER AS k FROM events), s AS (SELECT *, CASE event_type WHEN 'purchase' THEN 'promoted' WHEN 'error' THEN 'crash' WHEN 'signup' THEN 'lost' ELSE 'compiled' END AS status FROM l),
b AS (SELECT unnest([CASE WHEN k % 10 = 0 THEN 'L1 config_hash' END, CASE WHEN status = 'lost' THEN 'L2 status' END, CASE WHEN (status = 'promoted') <> (k % 7 = 0) THEN 'L4 status,promotion_allowed' END,
  CASE WHEN k % 10 <> 0 AND status <> 'lost' AND (status = 'promoted') = (k % 7 = 0) THEN 'good' END]) AS finding FROM s)
SELECT finding, count(*) AS lines FROM b WHERE finding IS NOT NULL GROUP BY 1""",
)
def ledger_quality(spark, sf_dir):
    """How often lines of a JSON-lines log break each rule, and how many break none."""
    k = F.get_json_object("props", "$.k").cast("int")
    e = fx.table(spark, sf_dir, "events").withColumn("k", k)
    status = F.when(F.col("event_type") == "purchase", "promoted").when(F.col("event_type") == "error", "crash").when(F.col("event_type") == "signup", "lost").otherwise("compiled")
    fields = {n: F.lit("x") for n in ledger.REQUIRED} | {"status": status, "config_hash": F.when(F.col("k") % 10 != 0, "h")}
    line = F.to_json(F.struct(*[v.alias(n) for n, v in fields.items()], (F.col("k") % 7 == 0).alias("promotion_allowed")))
    found = ledger.check_lines(e.select(line.alias("value"))).select(F.explode_outer("broken").alias("b"))
    named = F.when(F.col("b").isNull(), "good").otherwise(F.concat_ws(" ", "b.rule", F.array_join("b.fields", ",")))
    return found.groupBy(named.alias("finding")).agg(F.count(F.lit(1)).alias("lines"))
