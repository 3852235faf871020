"""Checkpoint panels and bars from live ticks.

Each micro-batch lands in a tick store and the checkpoints that its arrivals fire are published by
the batch code over that store, so the live panel is the batch panel.  Both writes replace their
own partitions: a replayed micro-batch changes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators.cuts import market_cuts
from tickloom.plans.registry import FAMILIES, Streams
from tickloom.schema import CHECKPOINTS, ORDER_KEY
from tickloom.streaming.lifecycle import event_time


def _overwrite(df: DataFrame, path: str, *keys: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def publish_checkpoints(stream: DataFrame, store: str, panel: str, family: str, checkpoints: Sequence[int] = tuple(CHECKPOINTS)):
    """A ``foreachBatch`` writer for one trade stream; ``stream`` carries the trade columns.

    Returns the configured ``DataStreamWriter``; the caller adds checkpoint location and trigger.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        _overwrite(batch.withColumn("batch", F.lit(batch_id)), store, "date", "batch")
        touched = batch.select("date").distinct()
        ticks = spark.read.parquet(store).withColumn("date", F.col("date").cast("string"))
        ticks = ticks.join(F.broadcast(touched), "date", "left_semi").drop("batch")
        cuts = market_cuts([ticks], checkpoints)
        # what arrived may change every checkpoint whose cut does not lie before it, published or not
        first = batch.groupBy(F.col("date").cast("string").alias("date")).agg(F.min(F.struct(*ORDER_KEY)).alias("_first"))
        cuts = cuts.join(F.broadcast(first), "date").filter("cut >= _first").drop("_first")
        fired = FAMILIES[family].build(Streams(trades=ticks), cuts)
        _overwrite(fired, panel, "date", "event")

    return stream.writeStream.foreachBatch(step)


def bar_stream(ticks: DataFrame, price: str, volume: str, minutes: int = 1, delay: str = "20 seconds", heartbeat: DataFrame | None = None) -> DataFrame:
    """Minute bars in append mode: a bar leaves when the watermark has passed its end; heartbeats (date, exch_ms) move it on."""
    if heartbeat is not None:
        ticks = ticks.unionByName(heartbeat.select("date", "exch_ms"), allowMissingColumns=True)
    timed = ticks.withColumn("event_time", event_time(F.col("date"), F.col("exch_ms"))).withWatermark("event_time", delay)
    order = F.struct("local_us", "serial")
    bars = timed.groupBy("date", "symbol", F.window("event_time", f"{minutes} minutes")).agg(
        F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"), F.sum(volume).alias("volume"), F.count("local_us").alias("ticks")
    )
    # by the count: a filter on the key would be pushed below the watermark and take the heartbeats away
    return bars.filter("ticks > 0").select("date", "symbol", F.col("window.start").alias("bar_start"), "open", "high", "low", "close", "volume", "ticks")
