"""Portfolio metrics, turnover and effect series."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom import fixtures as fx
from tickloom.catalog import query
from tickloom.fixtures import r6s
from tickloom.functions.scalar import r6
from tickloom.operators import series as sr
from tickloom.sources.panels import names_of

M = f"WITH {fx.METRICS_SQL}"
_G = "factor, universe, label, event"
RET = f"{M}, ret AS (SELECT factor, date, avg(LS) AS r FROM metrics GROUP BY ALL)"


def returns(spark, sf_dir):
    return fx.metrics(spark, sf_dir).groupBy("factor", "date").agg(F.avg("LS").alias("r"))


@query(
    "portfolio_metrics",
    f"""{RET}, c AS (SELECT factor, date, r, exp(sum(ln(1 + r)) OVER (PARTITION BY factor ORDER BY date)) AS eq FROM ret),
d AS (SELECT *, eq / greatest(1.0, max(eq) OVER (PARTITION BY factor ORDER BY date)) - 1 AS dd FROM c),
a AS (SELECT factor, count(*) AS n, arg_max(eq, date) AS g, avg(r) AS m, stddev_pop(r) AS v, min(least(dd, 0)) AS mdd FROM d GROUP BY factor)
SELECT factor, n AS period_count, {r6s("g - 1")} AS cumulative_return, {r6s("pow(g, 12.0 / n) - 1")} AS annualized_return, {r6s("v * sqrt(12.0)")} AS volatility,
  {r6s("m / v * sqrt(12.0)")} AS sharpe, {r6s("mdd")} AS max_drawdown, {r6s("CASE WHEN mdd < 0 THEN (pow(g, 12.0 / n) - 1) / abs(mdd) END")} AS calmar FROM a""",
)
def portfolio_metrics(spark, sf_dir):
    """Return, risk and drawdown of each factor's long-short series."""
    m = sr.portfolio_metrics(returns(spark, sf_dir), ["factor"], "r", 12)
    cols = ["cumulative_return", "annualized_return", "volatility", "sharpe", "max_drawdown", "calmar"]
    return m.select("factor", "period_count", *[r6(F.col(c)).alias(c) for c in cols])


@query(
    "equity_curve",
    f"""{RET}, c AS (SELECT factor, date, r, exp(sum(ln(1 + r)) OVER (PARTITION BY factor ORDER BY date)) AS eq FROM ret)
SELECT factor, date, {r6s("eq")} AS equity, {r6s("eq / greatest(1.0, max(eq) OVER (PARTITION BY factor ORDER BY date)) - 1")} AS drawdown FROM c""",
)
def equity_curve(spark, sf_dir):
    """Equity and drawdown along the dates."""
    c = sr.equity_curve(returns(spark, sf_dir), ["factor"], "r")
    return c.select("factor", "date", r6(F.col("equity")).alias("equity"), r6(F.col("drawdown")).alias("drawdown"))


@query(
    "portfolio_turnover",
    f"""{M}, s AS (SELECT universe, date, factor, sum(n) AS n FROM metrics GROUP BY ALL), w AS (SELECT d.universe, d.date, f.factor, coalesce(s.n, 0) / d.n::DOUBLE AS w FROM (SELECT universe, date, sum(n) AS n FROM s GROUP BY ALL) d, (SELECT DISTINCT factor FROM s) f LEFT JOIN s ON s.universe = d.universe AND s.date = d.date AND s.factor = f.factor),
m AS (SELECT universe, date, abs(w - lag(w) OVER (PARTITION BY universe, factor ORDER BY date)) AS m FROM w),
t AS (SELECT universe, date, 0.5::DOUBLE * sum(m) AS t FROM m GROUP BY ALL)
SELECT universe, {r6s("avg(t)")} AS average_turnover FROM t WHERE t IS NOT NULL GROUP BY universe""",
)
def portfolio_turnover(spark, sf_dir):
    """Mean half L1 change of the factor weights of each universe."""
    m = fx.metrics(spark, sf_dir)
    own = [F.coalesce(F.sum(F.when(F.col("factor") == f, F.col("n"))), F.lit(0)) for f in names_of(m, "factor")]
    w = m.groupBy("universe", "date").agg(F.array(*[n / F.sum("n") for n in own]).alias("weights"))
    return sr.average_turnover(w, ["universe"]).select("universe", r6(F.col("average_turnover")).alias("average_turnover"))


@query(
    "series_statistics",
    f"""{M} SELECT factor, universe, label, count(RankIC) AS "count", {r6s("avg(RankIC)")} AS "mean", {r6s("stddev_samp(RankIC)")} AS std,
  {r6s("avg(RankIC) / nullif(stddev_samp(RankIC), 0)")} AS ir, {r6s("avg(CASE WHEN RankIC > 0 THEN 1.0 ELSE 0.0 END)")} AS positive_fraction FROM metrics GROUP BY factor, universe, label""",
)
def series_statistics(spark, sf_dir):
    """count, mean, std, information ratio and positive fraction of a metric series."""
    g = fx.metrics(spark, sf_dir).groupBy("factor", "universe", "label").agg(*sr.series_stats(F.col("RankIC")))
    return g.select("factor", "universe", "label", "count", *[r6(F.col(c)).alias(c) for c in ("mean", "std", "ir", "positive_fraction")])


_QS = ", ".join(f"LS * {i} / 10.0::DOUBLE AS q{i}" for i in range(1, 11))


@query(
    "effect_time_series",
    f"""{M}, d AS (SELECT {_G}, CASE WHEN sum(RankIC) < 0 THEN 'negative' ELSE 'positive' END AS direction FROM metrics WHERE split <> 'holdout' GROUP BY ALL),
e AS (SELECT {_G}, date, n >= 2 AS ready, IC AS rank_ic, {_QS}, coalesce(direction, 'positive') AS direction FROM metrics LEFT JOIN d USING ({_G})),
s AS (SELECT *, count(*) OVER (PARTITION BY {_G} ORDER BY date) AS seen, sum(CASE WHEN ready THEN 1 ELSE 0 END) OVER (PARTITION BY {_G} ORDER BY date) AS rc FROM e)
SELECT {_G}, date, {r6s("rc / seen::DOUBLE")} AS coverage, {r6s(f"sum(coalesce(rank_ic, 0)) OVER w")} AS ic_cumulative,
  {r6s("exp(sum(ln(1 + CASE WHEN direction = 'negative' THEN q10 ELSE q1 END)) OVER w) - 1")} AS long_cumulative,
  {", ".join(r6s(f"exp(sum(ln(1 + q{i})) OVER w) - 1") + f" AS q{i}_cumulative" for i in range(1, 11))}
FROM s WHERE ready WINDOW w AS (PARTITION BY {_G} ORDER BY date)""",
)
def effect_time_series(spark, sf_dir):
    """Cumulative effect of every cell with its frozen direction; holdout dates are display only."""
    m = fx.metrics(spark, sf_dir)
    cell = ["factor", "universe", "label", "event"]
    total = F.sum("RankIC")
    d = m.filter("split <> 'holdout'").groupBy(*cell).agg(F.when(total < 0, "negative").otherwise("positive").alias("direction"))
    e = m.withColumns({"ready": F.col("n") >= 2, "rank_ic": F.col("IC"), **{f"q{i}_return": F.col("LS") * i / 10.0 for i in range(1, 11)}})
    out = sr.effect_series(sr.guard_holdout(e, authorised=True), d, cell)
    cols = ["coverage", "ic_cumulative", "long_cumulative", *[f"q{i}_cumulative" for i in range(1, 11)]]
    return out.select(*cell, "date", *[r6(F.col(c)).alias(c) for c in cols])
