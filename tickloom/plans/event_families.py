"""Factor families over the last N trades and quotes before a checkpoint."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions import book
from tickloom.functions.scalar import clip, signed_volume, valid_trade
from tickloom.operators.cuts import last_at_cuts, latest_at_cuts, totals_at_cuts
from tickloom.operators.sequence import crowded
from tickloom.plans.registry import KEYS, Streams, factor_family, with_readiness
from tickloom.schema import ORDER_KEY, REASON, STOCK_DAY

#: longest window plus its lag
HISTORY = 130

# Window, lag and half-life of the flow columns, in published order.
FLOW = [
    ("flow_pressure_signed_trade_flow_w16", "ratio", 16, 0, None),
    ("flow_pressure_signed_trade_flow_w32_lag0", "ratio", 32, 0, None),
    ("flow_pressure_signed_trade_flow_w64_lag1", "ratio", 64, 1, None),
    ("flow_pressure_signed_trade_flow_w128_lag2", "ratio", 128, 2, None),
    ("flow_pressure_trade_flow_zscore_w16_lag0", "zscore", 16, 0, None),
    ("flow_pressure_trade_flow_zscore_w32_lag0", "zscore", 32, 0, None),
    ("flow_pressure_trade_flow_zscore_w64_lag1", "zscore", 64, 1, None),
    ("flow_pressure_trade_flow_zscore_w128_lag2", "zscore", 128, 2, None),
    ("flow_pressure_decayed_trade_flow_w16_lag0", "decay", 16, 0, 4.0),
    ("flow_pressure_decayed_trade_flow_w32_lag0", "decay", 32, 0, 8.0),
    ("flow_pressure_decayed_trade_flow_w64_lag1", "decay", 64, 1, 16.0),
    ("flow_pressure_decayed_trade_flow_w128_lag2", "decay", 128, 2, 32.0),
    ("flow_pressure_l4g1_param_a", "decay", 24, 0, 6.0),
    ("flow_pressure_l4g1_param_b", "decay", 48, 0, 12.0),
    ("flow_pressure_l4g1_mechanism_a", "zscore", 24, 0, None),
    ("flow_pressure_l4g1_mechanism_b", "ratio", 96, 1, None),
]

# Measure, window and lag of the impact columns, in published order.
IMPACT = [
    ("impact_efficiency_signed_price_impact_w16", "impact", 16, 0),
    ("impact_efficiency_signed_price_impact_w32", "impact", 32, 0),
    ("impact_efficiency_signed_price_impact_w64", "impact", 64, 1),
    ("impact_efficiency_signed_price_impact_w128", "impact", 128, 2),
    ("impact_efficiency_mid_price_response_w16", "mid", 16, 0),
    ("impact_efficiency_mid_price_response_w32", "mid", 32, 0),
    ("impact_efficiency_mid_price_response_w64", "mid", 64, 1),
    ("impact_efficiency_mid_price_response_w128", "mid", 128, 2),
    ("impact_efficiency_ofi_response_w16", "ofi", 16, 0),
    ("impact_efficiency_ofi_response_w32", "ofi", 32, 0),
    ("impact_efficiency_absorption_divergence_w16", "absorption", 16, 0),
    ("impact_efficiency_absorption_divergence_w32", "absorption", 32, 0),
    ("impact_efficiency_l4g1_param_a", "impact", 96, 0),
    ("impact_efficiency_l4g1_param_b", "mid", 96, 0),
    ("impact_efficiency_l4g1_mechanism_a", "ofi", 64, 1),
    ("impact_efficiency_l4g1_mechanism_b", "absorption", 64, 1),
]

# Signal, window, variant, lag and combining operation of the book columns.
BOOK = [
    ("book_imbalance_weighted_depth_imbalance_w16_v0_lag0", "depth", 16, 0, 0, "-"),
    ("book_imbalance_microprice_displacement_w32_v0_lag1", "micro", 32, 0, 1, "+"),
    ("book_imbalance_spread_conditioned_imbalance_w64_v0_lag2", "spread", 64, 0, 2, "*"),
    ("book_imbalance_weighted_depth_imbalance_w128_v1_lag0", "depth", 128, 1, 0, "/"),
    ("book_imbalance_microprice_displacement_w16_v1_lag1", "micro", 16, 1, 1, "-"),
    ("book_imbalance_spread_conditioned_imbalance_w32_v1_lag2", "spread", 32, 1, 2, "+"),
    ("book_imbalance_weighted_depth_imbalance_w64_v2_lag0", "depth", 64, 2, 0, "*"),
    ("book_imbalance_microprice_displacement_w128_v2_lag1", "micro", 128, 2, 1, "/"),
    ("book_imbalance_spread_conditioned_imbalance_w16_v2_lag2", "spread", 16, 2, 2, "-"),
    ("book_imbalance_weighted_depth_imbalance_w32_v3_lag0", "depth", 32, 3, 0, "+"),
    ("book_imbalance_microprice_displacement_w64_v3_lag1", "micro", 64, 3, 1, "*"),
    ("book_imbalance_spread_conditioned_imbalance_w128_v3_lag2", "spread", 128, 3, 2, "/"),
    ("book_imbalance_l4g1_param_a", "micro", 32, 3, 0, "-"),
    ("book_imbalance_l4g1_param_b", "spread", 96, 3, 2, "*"),
    ("book_imbalance_l4g1_mechanism_a", "depth", 48, 4, 0, "*"),
    ("book_imbalance_l4g1_mechanism_b", "micro", 96, 4, 1, "/"),
]

_RESILIENCE_SHAPES = [
    ("spread_adjusted_depth_recovery_w16", "recovery", "l1", 16, 0),
    ("spread_adjusted_depth_recovery_w32_lag0", "recovery", "l1", 32, 0),
    ("spread_adjusted_depth_recovery_w64_lag1", "recovery", "l1", 64, 1),
    ("spread_adjusted_depth_recovery_w128_lag2", "recovery", "l1", 128, 2),
    ("multi_level_depth_recovery_w16_lag0", "recovery", "l5", 16, 0),
    ("multi_level_depth_recovery_w32_lag0", "recovery", "l5", 32, 0),
    ("multi_level_depth_recovery_w64_lag1", "recovery", "l5", 64, 1),
    ("multi_level_depth_recovery_w128_lag2", "recovery", "l5", 128, 2),
    ("shock_recovery_speed_w16_lag0", "speed", "l1", 16, 0),
    ("shock_recovery_speed_w32_lag0", "speed", "l1", 32, 0),
    ("shock_recovery_speed_w64_lag1", "speed", "l1", 64, 1),
    ("shock_recovery_speed_w128_lag2", "speed", "l1", 128, 2),
    ("l4g1_param_a", "speed", "l1", 96, 1),
    ("l4g1_param_b", "speed", "l5", 96, 1),
    ("l4g1_mechanism_a", "speed", "l1", 96, 1),
    ("l4g1_mechanism_b", "speed", "l5", 96, 1),
]
# A shock is a fall below this share of the earlier peak.
SHOCK_SHARE = 0.8

RESILIENCE = [(f"liquidity_resilience_{n}", *rest) for n, *rest in _RESILIENCE_SHAPES]
RESILIENCE_V2 = [(f"liquidity_resilience_v2_{n}", *rest) for n, *rest in _RESILIENCE_SHAPES[:12]]


def _names(table: list[tuple]) -> list[str]:
    return [row[0] for row in table]


def in_window(window: int, lag: int) -> Column:
    """Membership of the last ``window`` events after skipping ``lag``, by newest-first position."""
    return (F.col("rn") > lag) & (F.col("rn") <= lag + window)


def flow_value(kind: str, window: int, lag: int, half_life: float | None) -> Column:
    """Aggregate over last-N rows holding ``v`` (signed volume) and ``rn``."""
    inside = in_window(window, lag)
    v = F.when(inside, F.col("v").cast("double"))
    if kind == "zscore":
        n, mean = F.count(v), F.avg(v)
        variance = F.greatest(F.lit(0.0), F.sum(v * v) / F.nullif(n.cast("double"), F.lit(0.0)) - mean * mean)
        den = F.sqrt(variance) * math.sqrt(window)
        value = F.when(den > 1e-12, F.sum(v) / F.nullif(den, F.lit(0.0)))
    else:
        if kind == "decay":
            age = (F.col("rn") - 1 - lag).cast("double")
            v = v * F.exp(-age * (math.log(2.0) / half_life))
        value = F.sum(v) / F.nullif(F.sum(F.abs(v)), F.lit(0.0))
    return F.coalesce(value, F.lit(0.0))


def signed_trades(trades: DataFrame, need_price: bool = False) -> DataFrame:
    return trades.filter(valid_trade(need_price)).withColumn("v", signed_volume())


@factor_family("flow_pressure", _names(FLOW), inputs=("trades",))
def flow_pressure(streams: Streams, cuts: DataFrame) -> DataFrame:
    """Signed ratio, z-score and decayed flow of recent trades; ready once a valid trade was seen."""
    recent = last_at_cuts(signed_trades(streams.trades), cuts, HISTORY, ["v"])
    values = [flow_value(kind, w, lag, hl).alias(name) for name, kind, w, lag, hl in FLOW]
    return with_readiness(recent.groupBy(*KEYS).agg(*values), _names(FLOW))


def impact_value(kind: str, window: int, lag: int) -> Column:
    """Aggregate over last-N rows holding ``v``, ``price`` and ``rn``; 0 below two trades."""
    inside = in_window(window, lag)
    v = F.when(inside, F.col("v").cast("double"))
    price = F.when(inside, F.col("price").cast("double"))
    rank = F.when(inside, F.col("rn"))
    n, net, size = F.count(v), F.sum(v), F.greatest(F.sum(F.abs(v)), F.lit(1.0))
    first, last = F.max_by(price, rank), F.min_by(price, rank)
    mid = F.greatest(F.lit(1.0), 0.5 * (first + last))
    move = (last - first) / mid
    if kind == "impact":
        value = move * (net / size)
    elif kind == "mid":
        value = move * (net / F.greatest(F.sum(F.abs(v)) * mid, F.lit(1.0)))
    elif kind == "ofi":
        imbalance = net / size
        value = F.when(F.abs(imbalance) > 1e-12, move / F.nullif(imbalance, F.lit(0.0)))
    else:
        value = (net / size) * (1.0 - F.abs(last - first) / mid)
    return F.coalesce(F.when(n >= 2, value), F.lit(0.0))


# Fixed value: the opening-auction checkpoint, where price response is not defined.
OPENING = 92_700_000


@factor_family("impact_efficiency", _names(IMPACT), inputs=("trades",))
def impact_efficiency(streams: Streams, cuts: DataFrame) -> DataFrame:
    """Price response to recent signed volume; ready from the second trade on."""
    recent = last_at_cuts(signed_trades(streams.trades, need_price=True), cuts, HISTORY, ["v", "price"])
    values = [impact_value(kind, w, lag).alias(name) for name, kind, w, lag in IMPACT]
    panel = recent.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_n"), *values)
    reasons = {}
    for name, kind, _, _ in IMPACT:
        ready = F.col("_n") >= 2
        if kind != "absorption":
            ready = ready & (F.col("event") != OPENING)
        reasons[name] = F.when(ready, REASON["ready"]).otherwise(REASON["unknown"])
    return with_readiness(panel, _names(IMPACT), reasons).drop("_n")


def event_normalizer(window: int, count: Column) -> Column:
    scale = F.least(F.lit(1.0), F.greatest(count, F.lit(1)).cast("double") / float(window))
    return F.greatest(F.lit(1e-6), scale / float(window))


BOOK_VARIANTS = sorted({variant for _, kind, _, variant, _, _ in BOOK if kind != "micro"})


def book_signals() -> dict[str, Column]:
    """Every distinct raw snapshot signal the book columns draw on."""
    out = {"micro": book.microprice_displacement()}
    for variant in BOOK_VARIANTS:
        out[f"depth{variant}"] = book.depth_imbalance(variant)
        out[f"spread{variant}"] = book.spread_conditioned(variant)
    return out


def combine_signal(raw: Column, window: int, variant: int, lag: int, op: str, count: Column) -> Column:
    """Clipped, scaled snapshot signal combined with the event-count normaliser."""
    signal = clip(raw, -8.0, 8.0) * (1.0 + 0.25 * variant) / (1.0 + lag)
    norm = event_normalizer(window, count)
    joined = {
        "+": lambda: signal + norm,
        "-": lambda: signal - norm,
        "*": lambda: signal * norm,
        "/": lambda: signal / F.nullif(norm, F.lit(0.0)),
    }[op]()
    return F.when(raw.isNotNull(), F.coalesce(joined, F.lit(0.0))).otherwise(0.0)


@factor_family("book_imbalance", _names(BOOK), inputs=("quotes",))
def book_imbalance(streams: Streams, cuts: DataFrame) -> DataFrame:
    """Depth, microprice and spread-conditioned imbalance of the latest book."""
    raw = {f"_{k}": e for k, e in book_signals().items()}
    # one pass for the book and its count; the arrival key leads the row, so that the largest is the latest
    levels = ["bp", "bv", "ap", "av"]
    seen = totals_at_cuts(streams.quotes, cuts, {"_row": ("max", F.struct(*ORDER_KEY, *levels)), "_count": ("sum", F.lit(1).cast("bigint"))})
    latest = book.with_side_depths(seen.select(*KEYS, "_count", *[F.col("_row")[c].alias(c) for c in levels]), BOOK_VARIANTS)
    base = latest.select(*KEYS, "_count", book.valid_touch().alias("_ok"), *[e.alias(k) for k, e in raw.items()])
    values = [
        combine_signal(F.col("_micro" if k == "micro" else f"_{k}{v}"), w, v, lag, op, F.col("_count")).alias(n)
        for n, k, w, v, lag, op in BOOK
    ]
    panel = base.select(*KEYS, "_ok", *values)
    ok = F.when(F.col("_ok"), REASON["ready"]).otherwise(REASON["unknown"])
    return with_readiness(panel, _names(BOOK), {n: ok for n in _names(BOOK)}).drop("_ok")


def recovery_ratio(series: Column) -> Column:
    """Last over maximum of an oldest-first array, clipped to [0, 1]."""
    peak = F.array_max(series)
    return clip(F.element_at(series, -1) / F.nullif(peak, F.lit(0.0)), 0.0, 1.0)


def shock_speeds(series: np.ndarray) -> np.ndarray:
    """Rebound share per event since the deepest interior fall below 0.8 of an earlier peak.

    One row per symbol and checkpoint, oldest value first; NaN without a shock or a rebound.
    """
    if series.shape[1] < 3:
        return np.full(len(series), np.nan)
    peak = np.maximum.accumulate(series, axis=1)[:, :-2]
    inner, last = series[:, 1:-1], series[:, -1]
    shocked = (peak > 0) & (inner < peak * SHOCK_SHARE)
    at = np.where(shocked, inner, np.inf).argmin(axis=1)
    rows = np.arange(len(series))
    low, top = inner[rows, at], peak[rows, at]
    age = inner.shape[1] - at
    with np.errstate(divide="ignore", invalid="ignore"):
        value = (last - low) / (top - low) / age
    return np.where(shocked[rows, at] & (last > low) & (top > low), value, np.nan)


def shock_speed_udf(shapes: Sequence[tuple[str, str, int, int]]):
    """Pandas UDF over the bounded history arrays: one double per (name, level, window, lag)."""

    @F.pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n, *_ in shapes]))
    def speeds(l1: pd.Series, l5: pd.Series) -> pd.DataFrame:
        levels = {"l1": l1, "l5": l5}
        out = {}
        for name, level, window, lag in shapes:
            values = np.full(len(l1), np.nan)
            rows = [i for i, a in enumerate(levels[level]) if a is not None and len(a) >= window + lag]
            if rows:
                stack = np.stack([levels[level].iloc[i][len(levels[level].iloc[i]) - lag - window :][:window] for i in rows])
                values[rows] = shock_speeds(stack)
            out[name] = pd.Series(values).astype(object).where(~np.isnan(values), None)
        return pd.DataFrame(out)

    return speeds


def _pick(field: str):
    return lambda row: row[field]


def _resilience(streams: Streams, cuts: DataFrame, table: list[tuple]) -> DataFrame:
    depth = streams.quotes.select(
        "date",
        "symbol",
        "local_us",
        "exch_ms",
        "channel",
        "serial",
        book.spread_adjusted_liquidity(1).alias("l1"),
        book.spread_adjusted_liquidity(5).alias("l5"),
    ).withColumn("l5", F.when(F.col("l5") > 0, F.col("l5")).otherwise(F.col("l1")))
    valid = depth.filter("l1 > 0")
    # bounded: at most HISTORY rows per key reach the array
    recent = last_at_cuts(valid, cuts, HISTORY, ["l1", "l5"], crowd=crowded(streams.quotes, STOCK_DAY))
    rows = F.array_sort(F.collect_list(F.struct((-F.col("rn")).alias("pos"), "l1", "l5")))
    series = recent.groupBy(*KEYS).agg(rows.alias("_rows"))
    current = latest_at_cuts(depth, cuts, ["l1"]).select(*KEYS, (F.col("l1") > 0).alias("_valid"))
    names = [row[0] for row in table]
    joined = current.join(series, KEYS, "left").select(
        *KEYS, "_valid", *[F.transform("_rows", _pick(level)).alias(level) for level in ("l1", "l5")]
    )
    shapes = sorted({(f"{lv}_{w}_{lag}", lv, w, lag) for _, kind, lv, w, lag in table if kind == "speed"})
    joined = joined.withColumn("_speed", shock_speed_udf(shapes)("l1", "l5"))
    values = []
    for name, kind, level, window, lag in table:
        size = F.size(level)
        if kind == "recovery":
            part = F.slice(level, F.greatest(size - lag - window + 1, F.lit(1)), window)
            value = F.when(size >= window + lag, recovery_ratio(part))
        else:
            value = F.col("_speed")[f"{level}_{window}_{lag}"]
        values.append(F.when(F.col("_valid"), value).alias(name))
    return with_readiness(joined.select(*KEYS, *values), names)


@factor_family("liquidity_resilience", _names(RESILIENCE), inputs=("quotes",))
def liquidity_resilience(streams: Streams, cuts: DataFrame) -> DataFrame:
    """Depth recovery and post-shock recovery speed; an invalid last book makes every column NULL."""
    return _resilience(streams, cuts, RESILIENCE)


@factor_family("liquidity_resilience_v2", _names(RESILIENCE_V2), inputs=("quotes",))
def liquidity_resilience_v2(streams: Streams, cuts: DataFrame) -> DataFrame:
    """The first twelve resilience columns under their own names."""
    return _resilience(streams, cuts, RESILIENCE_V2)
