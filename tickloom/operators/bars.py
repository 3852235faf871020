"""Bars that close on the tick that reaches the interval.

Where a bar ends depends on where the one before it ended: it closes on the first tick whose minute lies ``interval``
or more past the minute of the last closing tick. Such a tick is always the first of its minute to arrive, so the
first arrival of each minute is all that the walk has to see: at most 1,440 entries of a stock-day, aggregated with map-side
combine, whatever its number of ticks. The ticks then only count the closings before them: in the list of their stock-day, or where a
stock-day is crowded by a blocked running sum.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.sequence import crowded, running
from tickloom.schema import ORDER_KEY, STOCK_DAY


def minute_of_day(ms: Column) -> Column:
    return F.floor(ms / 60_000).cast("bigint")


def closing_ticks(firsts: Column, interval: int) -> Column:
    """The entries that close a bar, of the first arrivals (``key``, ``minute``) of the minutes of a stock-day in their order."""
    start = F.struct(F.element_at(firsts, 1)["minute"].alias("last"), F.slice(firsts, 1, 0).alias("closed"))

    def step(state: Column, tick: Column) -> Column:
        closes = tick["minute"] >= state["last"] + interval
        return F.when(closes, F.struct(tick["minute"].alias("last"), F.array_append(state["closed"], tick).alias("closed"))).otherwise(state)

    return F.aggregate(firsts, start, step, lambda s: s["closed"])


def closing_bars(
    ticks: DataFrame, interval: int = 1, price: str = "price", volume: str = "total_volume", turnover: str = "total_turnover", interest: str = "open_interest",
    limits: tuple[str, str] = ("upper_limit", "lower_limit"), order: Sequence[str] = tuple(ORDER_KEY),
) -> DataFrame:
    """Closed bars of each stock-day: prices, growth of the day-to-date volume and turnover, open interest at the close, limits at the open.

    The first tick opens the first bar and never closes it; a tick may open and close a bar of its own. ``bar`` counts
    from 0, ``minute`` is that of the closing tick. Ticks behind the last closing make no bar.
    """
    rows = ticks.withColumns({"_minute": minute_of_day(F.col("exch_ms")), "_key": F.struct(*order)})
    firsts = rows.groupBy(*STOCK_DAY, "_minute").agg(F.min("_key").alias("_key"))
    arrived = F.sort_array(F.collect_list(F.struct(F.col("_key").alias("key"), F.col("_minute").alias("minute"))))
    ends = firsts.groupBy(*STOCK_DAY).agg(arrived.alias("_firsts")).select(*STOCK_DAY, closing_ticks(F.col("_firsts"), interval).alias("_ends"))
    crowd = crowded(ticks, STOCK_DAY)
    if crowd:
        # minutes spread the ticks of a busy stock
        each = ends.select(*STOCK_DAY, F.explode("_ends").alias("_e")).select(*STOCK_DAY, F.col("_e.minute").alias("_minute"), F.col("_e.key").alias("_end"))
        marked = rows.join(each, [*STOCK_DAY, "_minute"], "left").withColumn("_closes", F.coalesce(F.col("_key") == F.col("_end"), F.lit(False)))
        counted = running(marked, STOCK_DAY, {"_upto": ("sum", F.col("_closes").cast("int"))}, order, crowd=crowd)
        placed = counted.withColumns({"bar": (F.col("_upto") - F.col("_closes").cast("int")).cast("bigint"), "_closed": F.col("_closes")})
    else:
        # the closings before a tick tell its bar; its stock-day is in one place already
        joined = rows.join(ends.select(*STOCK_DAY, F.col("_ends.key").alias("_ends")), STOCK_DAY)
        placed = joined.withColumn("bar", F.size(F.filter("_ends", lambda e: e < F.col("_key"))).cast("bigint"))
        placed = placed.withColumn("_closed", F.col("bar") < F.size("_ends")).where("_closed")
    opened = F.min(F.struct("_key", *[F.col(c).alias(n) for n, c in (("p", price), ("v", volume), ("t", turnover), ("u", limits[0]), ("l", limits[1]))]))
    closed = F.max(F.struct("_key", F.col("_minute").alias("minute"), *[F.col(c).alias(n) for n, c in (("p", price), ("v", volume), ("t", turnover), ("i", interest))]))
    bars = placed.groupBy(*STOCK_DAY, "bar").agg(
        F.max("_closed").alias("_closed"), opened.alias("_o"), closed.alias("_c"), F.max(price).alias("high"), F.min(price).alias("low"), F.count(F.lit(1)).alias("ticks")
    )
    return bars.where("_closed").select(
        *STOCK_DAY, "bar", F.col("_c.minute").alias("minute"), F.col("_o.p").alias("open"), "high", "low", F.col("_c.p").alias("close"), (F.col("_c.v") - F.col("_o.v")).alias("volume"),
        (F.col("_c.t") - F.col("_o.t")).alias("turnover"), F.col("_c.i").alias("open_interest"), F.col("_o.u").alias("upper_limit"), F.col("_o.l").alias("lower_limit"), "ticks",
    )
