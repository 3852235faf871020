"""Row-level expressions and predicates on ticks, panels and text keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SZ, SH = 48, 49


def r6(value: Column) -> Column:
    """Six digits for reports.

    The boundary sits a little above the half (0.5001 of the last digit), so that decimal
    ties do not depend on the last bit of a floating-point sum.
    """
    return F.floor(value * 1e6 + 0.5001) / 1e6


def ratio(num: Column, den: Column) -> Column:
    """NULL when the denominator is 0."""
    return num / F.nullif(den.cast("double"), F.lit(0.0))


def finite(value: Column) -> Column:
    v = value.cast("double")
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))


def finite_or_zero(value: Column) -> Column:
    return F.when(finite(value), value).otherwise(0.0)


def clip(value: Column, low: float, high: float) -> Column:
    """Value inside the bounds; NULL stays NULL, which ``greatest`` and ``least`` alone would skip."""
    return F.when(value.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), value)))


def clamp01(value: Column) -> Column:
    return clip(value, 0.0, 1.0)


def safe_divide(num: Column, den: Column, eps: float = 1e-9) -> Column:
    """A denominator below 1e-9 in size gets ``eps`` added; a non-finite result becomes ``eps``."""
    d = F.when(F.abs(den) < 1e-9, den + eps).otherwise(den)
    value = F.try_divide(num.cast("double"), d)
    return F.when(finite(value), value).otherwise(eps)


def routable_order() -> Column:
    """Orders the factor families see: no summary records, and a usable id per market."""
    sz = (F.col("market") == SZ) & (F.col("order_index") != 0)
    sh = (F.col("market") == SH) & (F.col("orderorino") != 0)
    return (F.col("order_type") != "S") & (sz | sh)


def valid_trade(need_price: bool = False, need_side: bool = True) -> Column:
    ok = (F.col("trade_type") != "C") & (F.col("volume") > 0)
    if need_side:
        ok = ok & F.col("bsflag").isin("B", "S")
    return ok & (F.col("price") > 0) if need_price else ok


def signed_volume() -> Column:
    return F.when(F.col("bsflag") == "B", F.col("volume")).when(F.col("bsflag") == "S", -F.col("volume"))


def canonical_order_id() -> Column:
    return (
        F.when(F.col("market") == SH, F.col("orderorino"))
        .when(F.col("market") == SZ, F.col("order_index"))
        .otherwise(0)
    )


def aggressor() -> Column:
    """struct(side, source): 1 buy, -1 sell, 0 unknown; flag first, then the larger order id."""
    flag = F.upper("bsflag")
    by_id = (F.col("buy_id") > 0) & (F.col("sell_id") > 0) & (F.col("buy_id") != F.col("sell_id"))
    side = (
        F.when(flag == "B", 1)
        .when(flag == "S", -1)
        .when(by_id, F.when(F.col("buy_id") > F.col("sell_id"), 1).otherwise(-1))
        .otherwise(0)
    )
    source = F.when(flag.isin("B", "S"), "BsFlag").when(by_id, "OrderIdFallback").otherwise("Unknown")
    return F.struct(side.cast("int").alias("side"), source.alias("source"))


def average_price_x1e4(amount: Column, volume: Column) -> Column:
    """round half away from zero of amount * 10000 / volume, exact in 38 digits; 0 without volume."""
    whole = F.abs(amount).cast("decimal(24,0)") * F.lit(10000).cast("decimal(5,0)")
    half_up = F.floor((whole + F.floor(volume / 2).cast("decimal(20,0)")) / F.nullif(volume, F.lit(0)).cast("decimal(20,0)"))
    return F.when(volume > 0, F.signum(amount.cast("double")).cast("bigint") * half_up.cast("bigint")).otherwise(0).cast("bigint")


def symbol_code(text: Column) -> Column:
    return F.split_part(text, F.lit("."), F.lit(1))


def universe_code(text: Column) -> Column:
    return F.lpad(text, 6, "0")


def market_of_code(code: Column) -> Column:
    head = F.substring(code, 1, 1)
    return F.when(head.isin("0", "3"), "SZ").when(head == "6", "SH")


def market_rank(code: Column) -> Column:
    """Shenzhen rows come first in a published matrix."""
    return F.when(market_of_code(code) == "SZ", 0).when(market_of_code(code) == "SH", 1).otherwise(2)


def adjust_price(price: Column, adj: Column) -> Column:
    return ratio(price, adj) * 10000


def adjust_volume(volume: Column, adj: Column) -> Column:
    return volume * adj


def year_bucket(date: Column) -> Column:
    return F.substring(date, 1, 4)


def quarter_bucket(date: Column) -> Column:
    month = F.substring(date, 5, 2).cast("int")
    return F.concat(F.substring(date, 1, 4), F.lit("Q"), F.floor((month + 2) / 3).cast("string"))


def list_hash(values: Column) -> Column:
    """sha256 of the sorted distinct texts of a group, one per line."""
    lines = F.concat(F.array_join(F.array_sort(F.collect_set(values)), "\n"), F.lit("\n"))
    return F.concat(F.lit("sha256:"), F.sha2(F.when(F.count(values) > 0, lines).otherwise(""), 256))


def structure_signature(inputs: Column, operators: Column, formula: Column) -> Column:
    """sha256 of the canonical JSON of what a definition computes, not of its name."""
    text = F.trim(F.regexp_replace(F.lower(formula), r"\s+", " "))

    def quoted(items: Column) -> Column:
        return F.concat(F.lit('["'), F.array_join(F.array_sort(items), '","'), F.lit('"]'))

    def listed(items: Column) -> Column:
        return F.when(F.size(items) == 0, "[]").otherwise(quoted(items))

    canonical = F.concat(
        F.lit('{"formula":"'), text, F.lit('","inputs":'), listed(inputs), F.lit(',"operators":'), listed(operators), F.lit("}")
    )
    return F.concat(F.lit("sha256:"), F.sha2(canonical, 256))


def metric_column(factor: Column, metric: Column) -> Column:
    return F.concat(factor, F.lit("|"), metric)


def metric_of(name: Column) -> Column:
    return F.substring_index(name, "|", -1)


def factor_of(name: Column) -> Column:
    return F.regexp_extract(name, r"^(.*)\|[^|]*$", 1)


def split_of(date: Column) -> Column:
    """Frozen date ranges of the three splits."""
    return (
        F.when(date.between("20210104", "20221230"), "training")
        .when(date.between("20230103", "20241231"), "observation")
        .when(date >= "20250101", "holdout")
    )


def marketable(best_bid: Column, best_ask: Column) -> Column:
    buy = (F.upper("bsflag") == "B") & (best_ask > 0)
    sell = (F.upper("bsflag") == "S") & (best_bid > 0)
    hit = F.when(buy, F.col("price") >= best_ask).when(sell, F.col("price") <= best_bid)
    return F.coalesce(hit, F.lit(False))


def touch_distance(best_bid: Column, best_ask: Column) -> Column:
    buy = (F.upper("bsflag") == "B") & (best_ask > 0)
    sell = (F.upper("bsflag") == "S") & (best_bid > 0)
    gap = F.when(buy, best_ask - F.col("price")).when(sell, F.col("price") - best_bid)
    return F.greatest(F.lit(0), F.coalesce(gap, F.lit(0))).cast("bigint")
