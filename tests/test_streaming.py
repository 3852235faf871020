"""Live bars and checkpoints against their batch twins; fixed-width ingest."""

import os
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from tickloom import fixtures as fx
from tickloom.operators.cuts import market_cuts
from tickloom.operators.sequence import last_rows, number_rows, running
from tickloom.plans import event_families as ev
from tickloom.plans.registry import Streams
from tickloom.sources import ticks
from tickloom.streaming import checkpoints as cp
from tickloom.streaming.lifecycle import event_time

SF = "/root/testdata/sf0.001"


def feed(spark, folder: Path, df, slices: int):
    """Write ``df`` as arrival-ordered files and read it as a stream, one file per micro-batch."""
    rows = df.orderBy("local_us", "serial").toPandas()
    folder.mkdir()
    for i in range(slices):
        part = rows.iloc[i * len(rows) // slices : (i + 1) * len(rows) // slices]
        f = folder / f"{i:03d}.parquet"
        spark.createDataFrame(part, df.schema).coalesce(1).toPandas().to_parquet(f)
        os.utime(f, (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_live_checkpoints_equal_batch(spark, tmp_path):
    t = fx.trades(spark, SF).filter("date = '19970104'").withColumn("symbol", F.col("symbol").cast("bigint"))
    stream = feed(spark, tmp_path / "in", t, 4)
    q = cp.publish_checkpoints(stream, str(tmp_path / "store"), str(tmp_path / "panel"), "flow_pressure").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    name = "flow_pressure_signed_trade_flow_w16"
    live = {(r.symbol, r.event): round(r[name], 9) for r in spark.read.parquet(str(tmp_path / "panel")).collect()}
    batch = {(r.symbol, r.event): round(r[name], 9) for r in ev.flow_pressure(Streams(trades=t), market_cuts([t])).collect()}
    assert live == batch and len(batch) > 20


def test_bar_stream_equals_batch(spark, tmp_path):
    t = fx.trades(spark, SF).filter("date = '19970104'")
    stream = feed(spark, tmp_path / "in", t, 3)
    q = cp.bar_stream(stream, "price", "volume", 30).writeStream.format("memory").queryName("bars").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    live = {(r.symbol, r.bar_start): (r.open, r.close, r.volume) for r in spark.table("bars").collect()}
    timed = t.withColumn("event_time", event_time(F.col("date"), F.col("exch_ms")))
    order = F.struct("local_us", "serial")
    b = timed.groupBy("symbol", F.window("event_time", "30 minutes").alias("w")).agg(F.min_by("price", order).alias("o"), F.max_by("price", order).alias("c"), F.sum("volume").alias("v"))
    batch = {(r.symbol, r.w.start): (r.o, r.c, r.v) for r in b.collect()}
    assert live and all(batch[k] == v for k, v in live.items())


def test_fixed_width_files(spark, tmp_path):
    dtype = np.dtype([("symbol", "S9"), ("int_time", "<i4"), ("px", "<u4", (3,)), ("vol", "<i8")])
    rows = np.array([(b"600000.SH", 93000000, (1, 2, 3), 10), (b"000001.SZ", 93001000, (4, 5, 6), 20)], dtype=dtype)
    (tmp_path / "good.npq").write_bytes(rows.tobytes())
    (tmp_path / "bad.npq").write_bytes(rows.tobytes()[:-1])
    good, bad = ticks.read_fixed_width(spark, str(tmp_path), dtype)
    got = sorted((r.symbol, r.int_time, list(r.px), r.vol) for r in good.collect())
    assert got == [("000001.SZ", 93001000, [4, 5, 6], 20), ("600000.SH", 93000000, [1, 2, 3], 10)]
    assert [Path(r.path).name for r in bad.collect()] == ["bad.npq"]


def test_compressed_files_and_paths(spark, tmp_path):
    import zstandard

    dtype = np.dtype([("symbol", "S9"), ("vol", "<i8")])
    folder = tmp_path / "209" / "2024" / "20240102" / "day" / "src"
    folder.mkdir(parents=True)
    rows = np.array([(b"600000.SH", 7)], dtype=dtype)
    (folder / "600000.myzst").write_bytes(zstandard.ZstdCompressor().compress(rows.tobytes()))
    good, bad = ticks.read_fixed_width(spark, str(folder), dtype, compressed=True)
    r = good.select(F.col("symbol").alias("code"), "vol", *ticks.path_parts("path")).collect()[0]
    assert (r.code, r.vol, r.mi_type, r.date, r.daynight, r.source, r.symbol) == ("600000.SH", 7, "209", "20240102", "day", "src", "600000")
    assert bad.count() == 0


def test_tick_table_round_trip(spark, tmp_path):
    t = fx.trades(spark, SF).withColumn("symbol", F.col("symbol").cast("string"))
    ticks.write_ticks(t, str(tmp_path / "mi_type=256"))
    back = ticks.trades(spark, str(tmp_path), dates=["19970104"], symbols=["3"])
    assert back.count() == t.filter("date = '19970104' AND symbol = '3'").count() > 0


def test_sequence_operators_on_one_hot_key(spark):
    """One key, many blocks: positions, running sums and last rows equal the plain ones."""
    n = 5000
    df = spark.range(n).select(F.lit("d").alias("date"), F.lit("hot").alias("symbol"), (F.col("id") * 1_000_000).alias("local_us"), F.col("id").alias("exch_ms"), F.lit(1).alias("channel"), F.col("id").alias("serial"), (F.col("id") % 7).alias("v"))
    df = df.repartition(7, "v")
    got = running(number_rows(df, ["date", "symbol"]), ["date", "symbol"], {"s": ("sum", F.col("v"))}).toPandas().sort_values("serial")
    assert got["seq"].tolist() == list(range(1, n + 1))
    assert got["s"].tolist() == (got["v"].cumsum()).tolist()
    last = last_rows(df, ["date", "symbol"], 130).toPandas().sort_values("rn")
    assert last["serial"].tolist() == list(range(n - 1, n - 131, -1))
