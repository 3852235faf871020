"""Daily stock files, code lists, calendars, eligibility and exposures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.functions.scalar import ratio
from tickloom.operators.crosssection import winsorise

# Fields of the daily stock file, in file order.
DAILY_FIELDS = ["ticker", "high", "low", "open", "close", "vwap", "vol", "amount", "ashare"]


def parse_daily(lines: DataFrame, line: str = "line", order: str = "line_no") -> DataFrame:
    """Text lines to daily rows.

    Lines with fewer than nine fields are skipped, blank or malformed numbers become 0.0, the
    ticker is cut to six characters and the last line of a ticker wins.
    """
    from tickloom.operators.sequence import last_rows

    parts = lines.withColumn("_f", F.split(line, ",", -1)).filter(F.size("_f") >= len(DAILY_FIELDS))
    number = lambda i: F.coalesce(F.get("_f", i).try_cast("double"), F.lit(0.0))
    keys = [c for c in lines.columns if c not in (line, order)]
    rows = parts.select(
        *keys, order, F.substring(F.trim(F.get("_f", 0)), 1, 6).alias("ticker"), *[number(i).alias(n) for i, n in enumerate(DAILY_FIELDS) if i]
    )
    return last_rows(rows, [*keys, "ticker"], 1, order=[order]).drop("rn", order)


def read_daily_csv(spark: SparkSession, path: str) -> DataFrame:
    """Daily files, header skipped.  File name and row index inside the file order duplicate tickers."""
    text = spark.read.option("header", True).option("enforceSchema", True).schema("line string").option("sep", "\x01").csv(path)
    lines = text.select(F.col("_metadata.file_name").alias("file"), "line", F.monotonically_increasing_id().alias("line_no"))
    return parse_daily(lines)


def code_list(df: DataFrame, column: str = "code") -> DataFrame:
    """Six-character codes of the three stock prefixes."""
    head = F.substring(column, 1, 1)
    return df.filter(head.isin("0", "3", "6")).select(F.substring(column, 1, 6).alias("symbol")).distinct()


def first_readable(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """The first candidate path that can be read."""
    from pyspark.errors import AnalysisException

    for path in paths:
        try:
            return spark.read.text(path)
        except AnalysisException:
            continue
    raise FileNotFoundError(", ".join(paths))


def calendar_range(calendar: DataFrame, begin: str, end: str) -> DataFrame:
    return calendar.filter(F.col("date").between(begin, end))


def calendar_index(calendar: DataFrame) -> DataFrame:
    """Trading days numbered from 1; a calendar is a few thousand rows."""
    return calendar.select("date").distinct().withColumn("idx", F.row_number().over(Window.orderBy("date")).cast("bigint"))


def nth_before(days: DataFrame, index: DataFrame, n: int, name: str) -> DataFrame:
    """n-th trading day before each indexed day."""
    back = index.select((F.col("idx") + n).alias("idx"), F.col("date").alias(name))
    return days.join(back, "idx", "left")


def adjusted(daily: DataFrame, adj: str = "adj") -> DataFrame:
    """Volume times, prices over the adjustment factor; prices in 1e-4 units."""
    a = F.col(adj)
    prices = {c: ratio(F.col(c), a) * 10000 for c in ("high", "low", "open", "close", "vwap")}
    return daily.withColumns({"vol": F.col("vol") * a, **prices})


def previous_day_units(daily: DataFrame) -> DataFrame:
    """Lots to shares and thousands to yuan."""
    return daily.withColumns({"volume": F.col("volume") * 100, "amount": F.col("amount") * 1000})


def eligible(daily: DataFrame, min_days: int = 20) -> DataFrame:
    """Not under special treatment, listed longer than ``min_days`` and with an industry."""
    return daily.filter((F.col("st") == 0) & (F.col("list_days") > min_days) & (F.length("industry") > 5))


def exposure_matrix(daily: DataFrame, industries: Sequence[str], group: Sequence[str] = ("date",)) -> DataFrame:
    """One-hot industry and winsorised log market value of the eligible stocks."""
    mv = F.ln(F.col("vwap") * F.col("free_float"))
    base = eligible(daily).withColumn("log_mv", mv)
    size = winsorise(base, group, "log_mv", "size", cut=0.01, k=3.0)
    hot: list[Column] = [(F.col("industry") == i).cast("int").alias(f"ind_{i}") for i in industries]
    return size.select(*group, "symbol", *hot, "size")
