"""Structured Streaming jobs run to completion over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tickloom import fixtures as fx
from tickloom.catalog import query
from tickloom.catalog.lifecycle import LIFE, PAIR_SQL, snapshot_columns
from tickloom.session import checkpoint_dir
from tickloom.streaming import checkpoints as cp
from tickloom.streaming import lifecycle as sl

#: the stand-in trades on after the close, so its last bars end with the day
DAY_MS = 86_400_000

T = f"WITH {fx.FEED_SQL}, {fx.TRADES_SQL}"


class _StreamReader:
    """Lets the stand-in views read a table as a stream: the same code, another source."""

    def __init__(self, spark, schema_source):
        self.spark, self.source = spark, schema_source

    @property
    def read(self):
        return self

    def parquet(self, path: str):
        folder, name = path.rsplit("/", 1)
        return self.spark.readStream.schema(self.source.read.parquet(path).schema).option("pathGlobFilter", name).parquet(folder)


def heartbeats(spark, ticks, ms=sl.CLOSE_MS):
    """A stream with a clock message after ``ms`` of each day of ``ticks``."""
    path = f"{checkpoint_dir(spark)}/beat-{uuid.uuid4().hex}"
    sl.session_ends(ticks.select("date").distinct(), ms).write.parquet(path)
    return spark.readStream.schema("date string, exch_ms bigint").parquet(path)


def finish(stream, spark):
    """Run what is there, then read the sink back."""
    folder = f"{checkpoint_dir(spark)}/live-{uuid.uuid4().hex}"
    q = (
        stream.writeStream.format("parquet").option("compression", "zstd").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
        .outputMode("append").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


@query(
    "live_bars",
    f"""{T}, t AS (SELECT *, epoch_ms(strptime(date, '%Y%m%d')) + exch_ms AS ms FROM trades), b AS (SELECT date, symbol, ms // 1800000 AS slot, arg_min(price, (local_us, serial)) AS open, max(price) AS high, min(price) AS low,
  arg_max(price, (local_us, serial)) AS close, CAST(sum(volume) AS BIGINT) AS volume, count(*) AS ticks FROM t GROUP BY ALL)
SELECT date, symbol, slot * 1800000 AS bar_ms, open, high, low, close, volume, ticks FROM b""",
)
def live_bars(spark, sf_dir):
    """Half-hour bars from a trade stream, the last closed by the heartbeat after the session."""
    trades = fx.trades(_StreamReader(spark, spark), sf_dir)
    bars = finish(cp.bar_stream(trades, "price", "volume", 30, heartbeat=heartbeats(spark, fx.trades(spark, sf_dir), DAY_MS)), spark)
    return bars.select("date", "symbol", F.unix_millis("bar_start").alias("bar_ms"), "open", "high", "low", "close", "volume", "ticks")


def live_events(spark, sf_dir, events=None):
    """What the stateful stream says of the stand-in's orders; ``events`` names what is asked for, else all."""
    reader = _StreamReader(spark, spark)
    beat = heartbeats(spark, fx.lifecycle_orders(spark, sf_dir))
    return finish(sl.lifecycle_stream(fx.lifecycle_trades(reader, sf_dir), fx.lifecycle_orders(reader, sf_dir), beat, events=events), spark)


@query(
    "live_parent_orders",
    f"""{LIFE} SELECT date, symbol, order_id, side, original, CAST(immediate AS BIGINT) AS immediate, CAST(passive AS BIGINT) AS passive, CAST(cancelled AS BIGINT) AS cancelled, estimated, close_reason FROM fin""",
)
def live_parent_orders(spark, sf_dir):
    """Closed parent orders of the stateful stream; a heartbeat ends every session."""
    closed = live_events(spark, sf_dir, ["Closed"])
    return closed.select("date", "symbol", "order_id", "side", "original", "immediate", "passive", "cancelled", "estimated", "close_reason")


@query("live_pairs", PAIR_SQL.format(columns="date, symbol, serial, b_est OR s_est AS estimated, resolved_ms"))
def live_pairs(spark, sf_dir):
    """Trade pairs of the two stateful streams, with both parents as they stood when the second one became known."""
    events = live_events(spark, sf_dir)
    path = events.inputFiles()
    stream = spark.readStream.schema(events.schema).parquet(path[0].rsplit("/", 1)[0])
    pairs = sl.resolved_pairs(finish(sl.pair_stream(stream), spark), events)
    return pairs.select("date", "symbol", "serial", "estimated", "resolved_ms", *snapshot_columns())
