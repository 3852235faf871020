"""Statistics of date series: one row per date of a calendar, so every group is calendar-bounded."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOLDOUT_START = "20250101"


def series_stats(value: Column) -> list[Column]:
    """count, mean, std (ddof 1), information ratio and positive fraction."""
    std = F.stddev_samp(value)
    return [
        F.count(value).alias("count"),
        F.avg(value).alias("mean"),
        std.alias("std"),
        (F.avg(value) / F.when(std > 0, std)).alias("ir"),
        F.avg(F.when(value > 0, 1.0).when(value.isNotNull(), 0.0)).alias("positive_fraction"),
    ]


def rolling_mean(df: DataFrame, group: Sequence[str], value: str, window: int = 60, min_periods: int = 30, name: str = "rolled") -> DataFrame:
    """Mean of the last ``window`` dates, NULL below ``min_periods`` values."""
    w = Window.partitionBy(*group).orderBy("date").rowsBetween(1 - window, 0)
    return df.withColumn(name, F.when(F.count(value).over(w) >= min_periods, F.avg(value).over(w)))


def equity_curve(df: DataFrame, group: Sequence[str], ret: str) -> DataFrame:
    """Add ``equity``, ``peak`` (never below 1) and ``drawdown`` along the dates.

    The running product is kept as a count of zeros and negative factors and a sum of logs, so a
    loss of 100 % or more needs no special case.
    """
    w = Window.partitionBy(*group).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    growth = 1.0 + F.col(ret)
    zeros = F.sum(F.when(growth == 0, 1).otherwise(0)).over(w)
    flips = F.sum(F.when(growth < 0, 1).otherwise(0)).over(w)
    logs = F.sum(F.when(growth != 0, F.ln(F.abs(growth))).otherwise(0.0)).over(w)
    equity = F.when(zeros > 0, 0.0).otherwise(F.exp(logs) * F.when(flips % 2 == 1, -1.0).otherwise(1.0))
    out = df.withColumn("equity", equity)
    out = out.withColumn("peak", F.greatest(F.lit(1.0), F.max("equity").over(w)))
    return out.withColumn("drawdown", F.col("equity") / F.col("peak") - 1.0)


def portfolio_metrics(df: DataFrame, group: Sequence[str], ret: str, periods_per_year: int = 252) -> DataFrame:
    """Cumulative and annualised return, volatility, Sharpe, drawdown and Calmar per group.

    Population volatility and a zero risk-free rate, as published.
    """
    curve = equity_curve(df, group, ret)
    n = F.count(ret)
    growth = F.max_by("equity", "date")
    vol, worst = F.stddev_pop(ret), F.min(F.least(F.col("drawdown"), F.lit(0.0)))
    base = curve.groupBy(*group).agg(n.alias("period_count"), growth.alias("_g"), F.avg(ret).alias("_m"), vol.alias("_v"), worst.alias("max_drawdown"))
    root = F.sqrt(F.lit(float(periods_per_year)))
    annual = F.when(F.col("_g") <= 0, -1.0).otherwise(F.pow(F.when(F.col("_g") > 0, F.col("_g")), F.lit(float(periods_per_year)) / F.col("period_count")) - 1.0)
    out = base.withColumns(
        {
            "cumulative_return": F.col("_g") - 1.0,
            "annualized_return": annual,
            "volatility": F.col("_v") * root,
            "sharpe": F.when(F.col("_v") > 0, F.col("_m") / F.nullif(F.col("_v"), F.lit(0.0)) * root),
        }
    )
    calmar = F.when(F.col("max_drawdown") < 0, F.col("annualized_return") / F.nullif(F.abs("max_drawdown"), F.lit(0.0)))
    return out.withColumn("calmar", calmar).drop("_g", "_m", "_v")


def average_turnover(weights: DataFrame, group: Sequence[str], vector: str = "weights") -> DataFrame:
    """Mean half L1 change between consecutive weight vectors."""
    before = F.lag(vector).over(Window.partitionBy(*group).orderBy("date"))
    moved = F.aggregate(
        F.zip_with(vector, "_before", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda acc, x: acc + x
    )
    return weights.withColumn("_before", before).filter("_before IS NOT NULL").groupBy(*group).agg(F.avg(0.5 * moved).alias("average_turnover"))


def guard_holdout(df: DataFrame, authorised: bool = False) -> DataFrame:
    """Refuse holdout dates unless the run is authorised to display them."""
    if not authorised and df.filter(F.col("date") >= HOLDOUT_START).limit(1).count():
        raise ValueError("holdout dates need a frozen selection and a display-only authorisation")
    return df


def chain_directions(cells: DataFrame, by_cell: DataFrame, by_factor: DataFrame, group: Sequence[str] = ("factor", "universe", "label", "event"), default: str = "positive") -> DataFrame:
    """Direction of every cell: its own, else its factor's, else the default.  The two tables have ``direction``."""
    own = by_cell.select(*group, F.col("direction").alias("_own"))
    factor = by_factor.select("factor", F.col("direction").alias("_factor"))
    found = cells.select(*group).distinct().join(own, list(group), "left").join(factor, "factor", "left")
    return found.select(*group, F.coalesce("_own", "_factor", F.lit(default)).alias("direction"))


def best_event_only(df: DataFrame, best: DataFrame, keys: Sequence[str] = ("factor", "universe", "label")) -> DataFrame:
    """Rows of the frozen best event (``best_event``) of their cell; cells without one keep all their events."""
    known = df.join(best.select(*keys, "best_event"), list(keys), "left")
    return known.filter(F.col("best_event").isNull() | (F.col("event") == F.col("best_event"))).drop("best_event")


def effect_series(df: DataFrame, directions: DataFrame, group: Sequence[str] = ("factor", "universe", "label", "event")) -> DataFrame:
    """Cumulative rank IC, long return and decile returns over ready, observed dates.

    Input: ``date, ready, rank_ic, q1_return .. q10_return``; ``directions`` gives the frozen
    direction per cell.  Dates without an observed value emit no row, but a not-ready date still
    counts in the coverage denominator.
    """
    group = list(group)
    w = Window.partitionBy(*group).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    qs = [f"q{i}_return" for i in range(1, 11)]
    seen = F.count(F.lit(1)).over(w)
    observed = F.coalesce(F.col("ready"), F.lit(True)) & F.coalesce("rank_ic", *qs).isNotNull()
    rows = df.join(directions, group, "left").withColumns({"_seen": seen, "_obs": observed})
    rows = rows.withColumns({"coverage": F.sum(F.col("_obs").cast("int")).over(w) / F.col("_seen")}).filter("_obs")
    long = F.when(F.col("direction") == "negative", F.col("q10_return")).otherwise(F.col("q1_return"))
    rows = rows.withColumn("_long", long)

    def product(c: str) -> Column:
        return F.exp(F.sum(F.coalesce(F.ln(1.0 + F.col(c)), F.lit(0.0))).over(w)) - 1.0

    out = {"ic_cumulative": F.sum(F.coalesce("rank_ic", F.lit(0.0))).over(w), "long_cumulative": product("_long")}
    out |= {f"q{i}_cumulative": product(f"q{i}_return") for i in range(1, 11)}
    return rows.withColumns(out).select(*group, "date", "coverage", *out)
