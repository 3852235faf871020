"""Column contracts of the tick, panel and label tables."""

from __future__ import annotations

from pyspark.sql import types as T

_BOOK = T.ArrayType(T.LongType())

#: arrival order of a record; compared field by field, never renumbered globally
ORDER_KEY = ["local_us", "exch_ms", "channel", "serial"]
STOCK_DAY = ["date", "symbol"]

ENVELOPE = [
    T.StructField("date", T.StringType()),
    T.StructField("symbol", T.StringType()),
    T.StructField("local_us", T.LongType()),
    T.StructField("exch_ms", T.LongType()),
    T.StructField("channel", T.IntegerType()),
    T.StructField("serial", T.LongType()),
]

QUOTE = T.StructType(
    ENVELOPE
    + [
        T.StructField("int_time", T.IntegerType()),
        T.StructField("status", T.IntegerType()),
        T.StructField("pre_close_px", T.LongType()),
        T.StructField("open_px", T.LongType()),
        T.StructField("high_px", T.LongType()),
        T.StructField("low_px", T.LongType()),
        T.StructField("last_px", T.LongType()),
        T.StructField("bp", _BOOK),
        T.StructField("bv", _BOOK),
        T.StructField("ap", _BOOK),
        T.StructField("av", _BOOK),
        T.StructField("total_vol", T.LongType()),
        T.StructField("total_notional", T.LongType()),
    ]
)

TRADE = T.StructType(
    ENVELOPE
    + [
        T.StructField("int_time", T.IntegerType()),
        T.StructField("market", T.ShortType()),
        T.StructField("price", T.LongType()),
        T.StructField("bsflag", T.StringType()),
        T.StructField("trade_type", T.StringType()),
        T.StructField("trade_index", T.LongType()),
        T.StructField("volume", T.LongType()),
        T.StructField("amount", T.LongType()),
        T.StructField("sell_id", T.LongType()),
        T.StructField("buy_id", T.LongType()),
        T.StructField("biz_index", T.LongType()),
    ]
)

ORDER = T.StructType(
    ENVELOPE
    + [
        T.StructField("int_time", T.IntegerType()),
        T.StructField("market", T.ShortType()),
        T.StructField("order_type", T.StringType()),
        T.StructField("bsflag", T.StringType()),
        T.StructField("order_index", T.LongType()),
        T.StructField("orderorino", T.LongType()),
        T.StructField("biz_index", T.LongType()),
        T.StructField("price", T.LongType()),
        T.StructField("volume", T.LongType()),
    ]
)

ORDER_QUEUE = T.StructType(
    ENVELOPE
    + [
        T.StructField("int_time", T.IntegerType()),
        T.StructField("market", T.ShortType()),
        T.StructField("side", T.StringType()),
        T.StructField("price", T.LongType()),
        T.StructField("total_numbers", T.IntegerType()),
        T.StructField("numbers", T.IntegerType()),
        T.StructField("qty", T.ArrayType(T.IntegerType())),
    ]
)

# Readiness reason codes shared by every factor family.
REASON = {
    "ready": 0,
    "no_input": 1,
    "insufficient_book_depth": 2,
    "insufficient_history": 3,
    "unsupported_event": 4,
    "implementation_pending": 10,
    "unknown": 255,
}

# Checkpoints of a trading day in HHMMSSmmm.
CHECKPOINTS = [
    92700000,
    100000000,
    103000000,
    110000000,
    113000000,
    133000000,
    140000000,
    143000000,
]

# Metrics of the evaluation panel, in column order.
METRICS = [f"D{i}" for i in range(1, 11)] + ["LS", "Monotonicity", "IC", "RankIC"]
