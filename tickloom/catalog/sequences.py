"""Series statistics, frames, runs and gaps over the trade feed."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom import fixtures as fx
from tickloom.catalog import query
from tickloom.fixtures import r6s
from tickloom.functions import moments
from tickloom.functions.scalar import r6
from tickloom.operators import bars
from tickloom.operators import toolbox as tb
from tickloom.operators.cuts import market_cuts
from tickloom.operators.sequence import number_rows, running

T = f"WITH {fx.FEED_SQL}, {fx.TRADES_SQL}"
W = f"WITH {fx.MARKET_SQL}"
K = ["date", "symbol"]
KE = [*K, "event"]
OVER = "OVER (PARTITION BY date, symbol ORDER BY local_us, exch_ms, channel, serial)"
WIN = "(PARTITION BY date, symbol ORDER BY local_us, exch_ms, channel, serial"
#: every trade visible at a checkpoint, newest first
SEEN = """seen AS (SELECT t.*, c.event, c.event_ms, row_number() OVER (PARTITION BY t.date, t.symbol, c.event ORDER BY t.local_us DESC, t.exch_ms DESC, t.channel DESC, t.serial DESC) AS rn,
  count(*) OVER (PARTITION BY t.date, t.symbol, c.event) AS n FROM trades t JOIN cuts c ON t.date = c.date AND (t.local_us, t.exch_ms, t.channel, t.serial) < c.cut)"""


def trades(spark, sf_dir):
    return fx.trades(spark, sf_dir)


def cuts(spark, sf_dir):
    return market_cuts(fx.streams(spark, sf_dir).present())


_V = "volume::DOUBLE"
# the guards: under two values, or without any spread, a statistic is 0
_B = f"""{T}, p AS (SELECT date, symbol, count(*)::DOUBLE AS n, sum({_V}) AS s1, sum(pow({_V}, 2)) AS s2, sum(pow({_V}, 3)) AS s3, sum(pow({_V}, 4)) AS s4, sum(abs({_V})) AS sa, sum(ln({_V})) AS sl, sum(1 / {_V}) AS si FROM trades GROUP BY ALL),
q AS (SELECT *, s1 / n AS m FROM p), r AS (SELECT *, s2 - 2 * m * s1 + n * m * m AS sp, s4 - 4 * m * s3 + 6 * m * m * s2 - 4 * m * m * m * s1 + n * m * m * m * m AS f4 FROM q),
b AS (SELECT *, n >= 2 AS enough, n >= 2 AND sp > 1e-9 AS varied, CASE WHEN n >= 2 AND sp > 1e-9 THEN sp / (n - 1) ELSE 0 END AS variance,
  CASE WHEN n >= 2 AND abs(sp) > 1e-9 THEN (s3 - 3 * m * s2 + 3 * m * m * s1 - n * m * m * m) / pow(abs(sp), 1.5) * sqrt(n) ELSE 0 END AS skew,
  CASE WHEN n >= 2 AND abs(sp) > 1e-9 AND abs(f4) > 1e-9 THEN f4 / (sp * sp) * n - 3 ELSE 0 END AS kurt FROM r)"""


@query(
    "basic_statistics",
    f"""{_B} SELECT date, symbol, n::BIGINT AS n, {r6s("CASE WHEN enough THEN m ELSE 0 END")} AS mean, {r6s("variance")} AS variance, {r6s("sqrt(variance)")} AS std, {r6s("skew")} AS skew, {r6s("kurt")} AS kurt,
  {r6s("CASE WHEN varied THEN (skew * skew + kurt * kurt / 4) * n / 6 ELSE 0 END")} AS jarque_bera, {r6s("CASE WHEN varied THEN (skew * skew + 1) / nullif(kurt - 3, 0) ELSE 0 END")} AS bimodality_excess,
  {r6s("CASE WHEN varied AND kurt > 0 THEN skew / sqrt(kurt) END")} AS skew_kurt_ratio, {r6s("CASE WHEN enough THEN sqrt(s2 / n) ELSE 0 END")} AS rms, {r6s("CASE WHEN enough THEN sqrt(variance) / abs(m) ELSE 0 END")} AS cv,
  {r6s("CASE WHEN enough THEN sqrt(variance) / sqrt(n) ELSE 0 END")} AS se, {r6s("CASE WHEN enough THEN sa / n ELSE 0 END")} AS mean_abs, {r6s("CASE WHEN enough THEN exp(sl / n) ELSE 0 END")} AS geometric_mean,
  {r6s("CASE WHEN enough THEN n / si ELSE 0 END")} AS harmonic_mean FROM b""",
)
def basic_statistics(spark, sf_dir):
    """Moments and derived statistics of trade volume from one aggregate of power sums."""
    s = trades(spark, sf_dir).groupBy(*K).agg(*moments.power_sums(F.col("volume")))
    b, d = moments.basic(), moments.derived()
    names = ["jarque_bera", "bimodality_excess", "skew_kurt_ratio", "rms", "cv", "se", "mean_abs", "geometric_mean", "harmonic_mean"]
    return s.select(*K, "n", *[r6(e).alias(k) for k, e in b.items()], *[r6(d[k]).alias(k) for k in names])


@query(
    "category_entropy",
    f"""{T}, c AS (SELECT date, symbol, volume, count(*) AS c FROM trades GROUP BY ALL), p AS (SELECT *, c / sum(c) OVER (PARTITION BY date, symbol)::DOUBLE AS p FROM c)
SELECT date, symbol, CAST(sum(c) AS BIGINT) AS n, {r6s("-sum(p * log2(p))")} AS entropy FROM p GROUP BY ALL""",
)
def category_entropy(spark, sf_dir):
    """Shannon entropy in bits of the traded sizes."""
    return tb.entropy_bits(trades(spark, sf_dir), "volume").withColumn("entropy", r6(F.col("entropy")))


@query(
    "price_differences",
    f"""{W}, {SEEN}, w AS (SELECT date, symbol, event, {", ".join(f"max(price::DOUBLE) FILTER (WHERE rn = {i + 1}) AS x{i}" for i in range(5))} FROM seen WHERE rn <= 5 GROUP BY ALL)
SELECT date, symbol, event, {r6s("x0 - x1")} AS velocity, {r6s("x0 - 2 * x1 + x2")} AS acceleration, {r6s("x0 - 3 * x1 + 3 * x2 - x3")} AS jerk, {r6s("x0 - 4 * x1 + 6 * x2 - 4 * x3 + x4")} AS snap,
  {r6s("(x0 - x1) / x1")} AS roc FROM w""",
)
def price_differences(spark, sf_dir):
    """Velocity, acceleration, jerk, snap and rate of change of the last price."""
    d = tb.differences_at_cuts(trades(spark, sf_dir), cuts(spark, sf_dir), "price")
    return d.select(*KE, *[r6(F.col(c)).alias(c) for c in ("velocity", "acceleration", "jerk", "snap", "roc")])


def _ema(alpha, x="volume", seed=True):
    """EMA at the checkpoint as a weighted sum over the visible rows."""
    w = f"CASE WHEN rn = n THEN pow({1 - alpha!r}::DOUBLE, rn - 1) ELSE {alpha!r}::DOUBLE * pow({1 - alpha!r}::DOUBLE, rn - 1) END"
    return f"sum({w} * {x})"


@query(
    "macd",
    f"""{W}, {SEEN}, f AS (SELECT t.date, t.symbol, t.local_us, t.exch_ms, t.channel, t.serial, t.volume, row_number() {OVER} AS i FROM trades t),
rec AS (SELECT a.date, a.symbol, a.i, sum(CASE WHEN b.i = 1 THEN pow({11 / 13!r}::DOUBLE, a.i - 1) ELSE {2 / 13!r}::DOUBLE * pow({11 / 13!r}::DOUBLE, a.i - b.i) END * b.volume)
  - sum(CASE WHEN b.i = 1 THEN pow({25 / 27!r}::DOUBLE, a.i - 1) ELSE {2 / 27!r}::DOUBLE * pow({25 / 27!r}::DOUBLE, a.i - b.i) END * b.volume) AS line
  FROM f a JOIN f b ON a.date = b.date AND a.symbol = b.symbol AND b.i <= a.i GROUP BY ALL),
e AS (SELECT date, symbol, event, max(n) AS n, {_ema(2 / 13)} AS fast, {_ema(2 / 27)} AS slow FROM seen GROUP BY ALL),
sg AS (SELECT e.date, e.symbol, e.event, sum(CASE WHEN r.i = 1 THEN pow(0.8::DOUBLE, e.n - 1) ELSE 0.2::DOUBLE * pow(0.8::DOUBLE, e.n - r.i) END * r.line) AS signal FROM e JOIN rec r ON e.date = r.date AND e.symbol = r.symbol AND r.i <= e.n GROUP BY ALL)
SELECT date, symbol, event, n, {r6s("fast")} AS ema_fast, {r6s("slow")} AS ema_slow, {r6s("fast - slow")} AS macd_line, {r6s("signal")} AS macd_signal FROM e JOIN sg USING (date, symbol, event)""",
)
def macd(spark, sf_dir):
    """Seeded EMAs, MACD line and signal at every checkpoint, without walking the series."""
    t = number_rows(trades(spark, sf_dir), K)
    m = tb.macd_at_cuts(t, cuts(spark, sf_dir), "volume")
    return m.select(*KE, "n", *[r6(F.col(c)).alias(c) for c in ("ema_fast", "ema_slow", "macd_line", "macd_signal")])


@query(
    "recent_moments",
    f"""{W}, {SEEN} SELECT date, symbol, event, count(*) AS n, {r6s("avg(volume)")} AS mean, {r6s("var_samp(volume)")} AS variance, {r6s("stddev_samp(volume)")} AS std FROM seen WHERE rn <= 60 GROUP BY ALL""",
)
def recent_moments(spark, sf_dir):
    """Mean and variance of the last sixty values."""
    m = tb.recent_moments_at_cuts(trades(spark, sf_dir), cuts(spark, sf_dir), "volume", 60)
    return m.select(*KE, "n", *[r6(F.col(c)).alias(c) for c in ("mean", "variance", "std")])


_SPAN = f"""{W}, sp AS (SELECT t.date, t.symbol, c.event, c.event_ms, t.exch_ms, t.volume, t.price, row_number() OVER (PARTITION BY t.date, t.symbol, c.event ORDER BY t.local_us DESC, t.exch_ms DESC, t.channel DESC, t.serial DESC) AS rn
  FROM trades t JOIN cuts c ON t.date = c.date AND (t.local_us, t.exch_ms, t.channel, t.serial) < c.cut AND t.exch_ms > c.event_ms - 3600000)"""


@query(
    "trailing_span_stats",
    f"""{_SPAN}, k AS (SELECT date, symbol, event, count(*) AS n, max(volume::DOUBLE) FILTER (WHERE rn = 1) AS last, avg(volume) AS m, var_samp(volume) AS v FROM sp WHERE rn <= 16 GROUP BY ALL)
SELECT date, symbol, event, n, last, {r6s("CASE WHEN n >= 2 THEN m ELSE 0 END")} AS mean, {r6s("CASE WHEN n >= 2 AND v * (n - 1) > 1e-9 THEN sqrt(v) ELSE 0 END")} AS std FROM k""",
)
def trailing_span_stats(spark, sf_dir):
    """Statistics of the trailing hour before each checkpoint, at most sixteen events."""
    s = tb.span_stats_at_cuts(trades(spark, sf_dir), cuts(spark, sf_dir), "volume", 3_600_000, 16)
    return s.select(*KE, "n", "last", r6(F.col("mean")).alias("mean"), r6(F.col("std")).alias("std"))


@query(
    "trailing_ols",
    f"""{_SPAN}, k AS (SELECT date, symbol, event, count(*) AS n, covar_pop(volume::DOUBLE, (exch_ms - event_ms) / 1000.0::DOUBLE) AS cov, var_pop((exch_ms - event_ms) / 1000.0::DOUBLE) AS vx, var_pop(volume::DOUBLE) AS vy,
  avg(volume::DOUBLE) AS my, avg((exch_ms - event_ms) / 1000.0::DOUBLE) AS mx FROM sp WHERE rn <= 200 GROUP BY ALL),
z AS (SELECT *, n >= 5 AND n * vx > 1e-12 AND n * vy > 1e-9 AS ok, sqrt(greatest(0, n * (vy - cov * cov / nullif(vx, 0))) / greatest(1, n - 2)) AS rs FROM k)
SELECT date, symbol, event, n, {r6s("CASE WHEN ok THEN cov / vx ELSE 0 END")} AS slope, {r6s("CASE WHEN ok THEN my - cov / vx * mx ELSE 0 END")} AS intercept,
  {r6s("CASE WHEN ok THEN least(1, cov * cov / (vx * vy)) ELSE 0 END")} AS r2, {r6s("CASE WHEN ok THEN rs ELSE 0 END")} AS residual_std, {r6s("CASE WHEN ok AND rs > 1e-6 THEN cov / vx / rs ELSE 0 END")} AS slope_z FROM z""",
)
def trailing_ols(spark, sf_dir):
    """Slope, fit and residual of volume on time over the trailing hour."""
    o = tb.span_ols_at_cuts(trades(spark, sf_dir), cuts(spark, sf_dir), "volume", 3_600_000, 200)
    return o.select(*KE, "n", *[r6(F.col(c)).alias(c) for c in ("slope", "intercept", "r2", "residual_std", "slope_z")])


@query(
    "id_gaps",
    f"""{T}, g AS (SELECT *, (buy_id - lag(buy_id) {OVER})::DOUBLE AS gap, row_number() {OVER} - 1 AS n FROM trades),
m AS (SELECT *, CASE WHEN n >= 2 THEN avg(gap) OVER {WIN} ROWS UNBOUNDED PRECEDING) ELSE 0 END AS gm, CASE WHEN n >= 2 THEN stddev_samp(gap) OVER {WIN} ROWS UNBOUNDED PRECEDING) ELSE 0 END AS gs FROM g)
SELECT date, symbol, count(gap) AS gaps, {r6s("avg(gap)")} AS gap_mean, CAST(sum(CASE WHEN gap > gm + 3 * greatest(1e-9, gs) THEN 1 ELSE 0 END) AS BIGINT) AS jumps FROM m GROUP BY ALL""",
)
def id_gaps(spark, sf_dir):
    """Gaps between successive order ids and the jumps beyond three expanding deviations."""
    g = tb.gap_statistics(trades(spark, sf_dir), "buy_id")
    return g.groupBy(*K).agg(F.count("gap").alias("gaps"), r6(F.avg("gap")).alias("gap_mean"), F.count_if("jump").alias("jumps"))


@query(
    "id_clusters",
    f"""{T}, g AS (SELECT *, lag(sell_id) {OVER} AS b FROM trades), i AS (SELECT *, sum(CASE WHEN b IS NULL OR abs(sell_id - b) > 400 THEN 1 ELSE 0 END) OVER {WIN} ROWS UNBOUNDED PRECEDING) AS island FROM g),
r AS (SELECT date, symbol, island, count(*) AS size FROM i GROUP BY ALL)
SELECT date, symbol, count(*) FILTER (WHERE size >= 2) AS clusters, CAST(sum(size - 1) AS BIGINT) AS extra_members, max(size) AS max_size, count(*) FILTER (WHERE size >= 5) AS large_runs FROM r GROUP BY ALL""",
)
def id_clusters(spark, sf_dir):
    """Runs of neighbouring ids."""
    return tb.run_summary(tb.id_runs(trades(spark, sf_dir), "sell_id", 400))


@query(
    "side_runs",
    f"""{T}, s AS (SELECT *, lag(bsflag) {OVER} AS b, row_number() {OVER} AS seq FROM trades WHERE bsflag <> 'N'), i AS (SELECT *, max(CASE WHEN b IS NULL OR b <> bsflag THEN seq END) OVER {WIN} ROWS UNBOUNDED PRECEDING) AS st FROM s)
SELECT date, symbol, serial, bsflag, seq - st + 1 AS run FROM i""",
)
def side_runs(spark, sf_dir):
    """Length so far of the current run of the same aggressor side."""
    return tb.value_runs(trades(spark, sf_dir).filter("bsflag <> 'N'"), "bsflag").select(*K, "serial", "bsflag", "run")


@query(
    "big_trades",
    f"""{T}, r AS (SELECT *, count(*) OVER w AS rn, avg(volume) OVER w AS m, stddev_samp(volume) OVER w AS s FROM trades WINDOW w AS {WIN} ROWS BETWEEN 40 PRECEDING AND 1 PRECEDING))
SELECT date, symbol, serial, {r6s("CASE WHEN rn >= 30 AND s > 1e-12 THEN m + 1.5 * s ELSE 0 END")} AS threshold, {r6s("CASE WHEN rn >= 30 AND s > 1e-12 THEN greatest(-8, least(8, (volume - m) / s)) ELSE 0 END")} AS z,
  rn >= 30 AND s > 1e-12 AND volume >= m + 1.5 * s AS is_big FROM r""",
)
def big_trades(spark, sf_dir):
    """Trades large against the forty before them."""
    b = tb.big_events(trades(spark, sf_dir), "volume", window=40, min_n=30, k=1.5)
    return b.select(*K, "serial", r6(F.col("threshold")).alias("threshold"), r6(F.col("z")).alias("z"), "is_big")


@query(
    "running_pressure",
    f"""{T}, r AS (SELECT *, sum(CASE bsflag WHEN 'B' THEN 1 ELSE 0 END) OVER w AS b, sum(CASE bsflag WHEN 'S' THEN 1 ELSE 0 END) OVER w AS s, sum(CASE WHEN volume >= 40 THEN 1 ELSE 0 END) OVER w AS lg, count(*) OVER w AS n FROM trades WINDOW w AS {WIN} ROWS UNBOUNDED PRECEDING))
SELECT date, symbol, serial, {r6s("b / nullif(b + s, 0)")} AS buy_pressure, {r6s("lg / n")} AS large_ratio FROM r""",
)
def running_pressure(spark, sf_dir):
    """Running share of buys and of large trades."""
    one = lambda c: F.when(c, 1).otherwise(0)
    r = running(
        trades(spark, sf_dir), K,
        {"b": ("sum", one(F.col("bsflag") == "B")), "s": ("sum", one(F.col("bsflag") == "S")), "lg": ("sum", one(F.col("volume") >= 40)), "n": ("sum", F.lit(1))},
    )
    return r.select(*K, "serial", r6(F.col("b") / F.nullif(F.col("b") + F.col("s"), F.lit(0))).alias("buy_pressure"), r6(F.col("lg") / F.col("n")).alias("large_ratio"))


@query(
    "causal_signals",
    f"""{T}, r AS (SELECT *, count(*) OVER w AS n, avg(volume) OVER w AS m, stddev_samp(volume) OVER w AS s, max(price) OVER w AS hi, min(price) OVER w AS lo FROM trades WINDOW w AS {WIN} ROWS UNBOUNDED PRECEDING))
SELECT date, symbol, serial, {r6s("CASE WHEN s * s > 1e-9 THEN (volume - m) / s END")} AS z, (price - hi)::DOUBLE AS from_high, (price - lo)::DOUBLE AS from_low FROM r""",
)
def causal_signals(spark, sf_dir):
    """Causal z-score and reversal from the backward-looking extremes."""
    r = tb.reversal(tb.causal_zscore(trades(spark, sf_dir), "volume"), "price")
    return r.select(*K, "serial", r6(F.col("z")).alias("z"), "from_high", "from_low")


@query(
    "minute_bars",
    f"""{T}, t AS (SELECT *, sum(volume) OVER {WIN} ROWS UNBOUNDED PRECEDING) AS total, exch_ms // 1800000 AS bar FROM trades)
SELECT date, symbol, bar, arg_min(price, {fx.KEY}) AS open, max(price) AS high, min(price) AS low, arg_max(price, {fx.KEY}) AS close,
  CAST(arg_max(total, {fx.KEY}) - arg_min(total, {fx.KEY}) AS BIGINT) AS volume, count(*) AS ticks FROM t GROUP BY ALL""",
)
def minute_bars(spark, sf_dir):
    """Thirty-minute bars from ticks with a day-to-date volume."""
    t = running(trades(spark, sf_dir), K, {"total": ("sum", F.col("volume"))})
    return tb.minute_bars(t, "price", "total", 30)


_TICKS = """k AS (SELECT *, exch_ms // 60000 AS minute, (local_us, exch_ms, channel, serial) AS key, CAST(sum(volume) OVER d AS BIGINT) AS total_volume, CAST(sum(amount) OVER d AS BIGINT) AS total_turnover, price % 100003 AS open_interest
  FROM trades WINDOW d AS (PARTITION BY date, symbol ORDER BY local_us, exch_ms, channel, serial ROWS UNBOUNDED PRECEDING))"""
#: minutes that a bar lasts at least
BAR = 20


@query(
    "closing_bars",
    f"""WITH RECURSIVE {fx.FEED_SQL}, {fx.TRADES_SQL}, {_TICKS},
z AS (SELECT date, symbol, -1::BIGINT AS bar, min(key) AS pos, arg_min(minute, key) AS last FROM k GROUP BY ALL
  UNION ALL SELECT * FROM (SELECT z.date, z.symbol, z.bar + 1, min(k.key) AS pos, arg_min(k.minute, k.key) AS last FROM z JOIN k ON k.date = z.date AND k.symbol = z.symbol AND k.key > z.pos AND k.minute >= z.last + {BAR} GROUP BY z.date, z.symbol, z.bar)),
c AS (SELECT date, symbol, bar, pos, lag(pos) OVER (PARTITION BY date, symbol ORDER BY bar) AS prev FROM z),
t AS (SELECT k.*, bar FROM c JOIN k ON k.date = c.date AND k.symbol = c.symbol AND k.key <= c.pos AND (k.key > c.prev OR c.bar = 0) WHERE bar >= 0)
SELECT date, symbol, bar, arg_max(minute, key) AS minute, arg_min(price, key) AS open, max(price) AS high, min(price) AS low, arg_max(price, key) AS close, arg_max(total_volume, key) - arg_min(total_volume, key) AS volume,
  arg_max(total_turnover, key) - arg_min(total_turnover, key) AS turnover, arg_max(open_interest, key) AS open_interest, arg_min(price, key) + 1000 AS upper_limit, arg_min(price, key) - 1000 AS lower_limit, count(*) AS ticks FROM t GROUP BY date, symbol, bar""",
)
def closing_bars(spark, sf_dir):
    """Bars of twenty minutes or more, each closed by the tick that reaches them, with turnover, open interest and limits."""
    t = running(trades(spark, sf_dir), K, {"total_volume": ("sum", F.col("volume")), "total_turnover": ("sum", F.col("amount"))})
    t = t.withColumns({"open_interest": F.col("price") % 100003, "upper_limit": F.col("price") + 1000, "lower_limit": F.col("price") - 1000})
    return bars.closing_bars(t, BAR)


#: milliseconds of orders that an order is compared with; the stand-in's stocks have few orders a minute
SPAN = 14_400_000


@query(
    "big_orders",
    f"""{W}, u AS (SELECT date, symbol, local_us, exch_ms, channel, serial, NULL AS bid, NULL AS ask, price, bsflag, volume FROM ord
  UNION ALL SELECT date, symbol, local_us, exch_ms, channel, serial, bp[1], ap[1], NULL, NULL, NULL FROM quotes),
j AS (SELECT *, last_value(CASE WHEN bid IS NOT NULL THEN (bid, ask) END IGNORE NULLS) OVER (PARTITION BY date, symbol ORDER BY local_us, exch_ms, channel, serial ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS q FROM u),
o AS (SELECT *, local_us // 1000 AS ms, row_number() OVER w AS i, lag(local_us // 1000) OVER w AS before_ms,
  coalesce(CASE WHEN bsflag = 'B' AND q[2] > 0 THEN price >= q[2] WHEN bsflag = 'S' AND q[1] > 0 THEN price <= q[1] END, false) AS marketable,
  greatest(0, coalesce(CASE WHEN bsflag = 'B' AND q[2] > 0 THEN q[2] - price WHEN bsflag = 'S' AND q[1] > 0 THEN price - q[1] END, 0)) AS gap FROM j WHERE price IS NOT NULL WINDOW w AS (PARTITION BY date, symbol ORDER BY local_us, exch_ms, channel, serial)),
r AS (SELECT a.date, a.symbol, a.serial, a.volume, a.marketable, a.gap, count(b.i) AS n, sum(b.volume)::DOUBLE / nullif(count(b.i), 0) AS m,
  sqrt(greatest(0, (count(b.i)::HUGEINT * sum(b.volume::HUGEINT * b.volume) - sum(b.volume::HUGEINT) * sum(b.volume::HUGEINT))::DOUBLE / nullif((count(b.i) * (count(b.i) - 1))::DOUBLE, 0))) AS s
  FROM o a LEFT JOIN o b ON b.date = a.date AND b.symbol = a.symbol AND b.i < a.i AND b.ms > a.before_ms - {SPAN} GROUP BY a.date, a.symbol, a.serial, a.i, a.volume, a.marketable, a.gap),
f AS (SELECT *, n >= 30 AND coalesce(s, 0) > 1e-12 AS usable, n >= 30 AND NOT coalesce(s, 0) > 1e-12 AS flat FROM r)
SELECT date, symbol, serial, n AS ref_n, {r6s("CASE WHEN usable THEN m + 1.5 * s WHEN flat THEN 300 ELSE 0 END")} AS threshold, {r6s("CASE WHEN usable THEN greatest(-8, least(8, (volume - m) / s)) ELSE 0 END")} AS z, marketable, gap AS touch_distance,
  (usable AND volume >= m + 1.5 * s OR flat AND volume >= 300) AND marketable AS is_big FROM f""",
)
def big_orders(spark, sf_dir):
    """Orders large against those of the four hours before them, that cross the quote; a fixed threshold where those are all alike."""
    s = fx.streams(spark, sf_dir)
    b = tb.big_orders(s.orders, s.quotes, SPAN, k=1.5, fallback=300.0, need_marketable=True)
    return b.select(*K, "serial", "ref_n", r6(F.col("threshold")).alias("threshold"), r6(F.col("z")).alias("z"), "marketable", "touch_distance", "is_big")
