"""Tick tables: partitioned scans, legacy layouts, fixed-width ingest and path discovery."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.schema import ORDER, ORDER_QUEUE, QUOTE, TRADE

# Message type ids of the record files.
MESSAGE = {"quote": 209, "order_trade": 231, "order_queue": 252, "order_legacy": 253, "trade_legacy": 254, "trade": 256, "order": 257}

# Legacy column names mapped to the current ones.
LEGACY_TRADE = {"record_id": "trade_index", "trade_price": "price", "trade_volume": "volume", "trade_amount": "amount", "side": "bsflag", "order_kind": "trade_type"}
LEGACY_ORDER = {"order_id": "order_index", "order_price": "price", "order_volume": "volume", "side": "bsflag", "order_kind": "order_type"}


def _scan(spark: SparkSession, root: str, schema: T.StructType, dates: Sequence[str] | None, symbols: Sequence[str] | None) -> DataFrame:
    df = spark.read.schema(schema).parquet(root)
    if dates is not None:
        df = df.filter(F.col("date").isin(*dates))
    if symbols is not None:
        df = df.filter(F.col("symbol").isin(*symbols))
    return df


def quotes(spark: SparkSession, root: str, dates: Sequence[str] | None = None, symbols: Sequence[str] | None = None) -> DataFrame:
    """Book snapshots; dates prune partitions and symbols reach the file scan."""
    return _scan(spark, f"{root}/mi_type={MESSAGE['quote']}", QUOTE, dates, symbols)


def trades(spark: SparkSession, root: str, dates: Sequence[str] | None = None, symbols: Sequence[str] | None = None) -> DataFrame:
    return _scan(spark, f"{root}/mi_type={MESSAGE['trade']}", TRADE, dates, symbols)


def orders(spark: SparkSession, root: str, dates: Sequence[str] | None = None, symbols: Sequence[str] | None = None) -> DataFrame:
    return _scan(spark, f"{root}/mi_type={MESSAGE['order']}", ORDER, dates, symbols)


def order_queue(spark: SparkSession, root: str, dates: Sequence[str] | None = None, symbols: Sequence[str] | None = None) -> DataFrame:
    return _scan(spark, f"{root}/mi_type={MESSAGE['order_queue']}", ORDER_QUEUE, dates, symbols)


def queue_details(queue: DataFrame) -> DataFrame:
    """One row per queued order with its place in the queue."""
    return queue.select("date", "symbol", "side", "price", "serial", F.posexplode("qty").alias("place", "queued"))


def from_legacy(df: DataFrame, mapping: dict[str, str], schema: T.StructType) -> DataFrame:
    """Rename a legacy layout and fill the columns it does not have with NULL."""
    renamed = df.select(*[F.col(c).alias(mapping.get(c, c)) for c in df.columns])
    return renamed.select(*[(F.col(f.name) if f.name in renamed.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def split_order_trade(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Combined rows to the trade and the order shape, by the message type they carry."""
    trade = df.filter(F.col("mi_type_quote").isin(MESSAGE["trade"], MESSAGE["trade_legacy"]))
    order = df.filter(F.col("mi_type_quote").isin(MESSAGE["order"], MESSAGE["order_legacy"]))
    return from_legacy(trade, {}, TRADE), from_legacy(order, {}, ORDER)


def futures(spark: SparkSession, root: str, product: str, contracts: DataFrame, dates: Sequence[str] | None = None) -> DataFrame:
    """Ticks of the contracts of a product; the contract table is one row per product and date."""
    df = spark.read.parquet(root)
    if dates is not None:
        df = df.filter(F.col("date").isin(*dates))
    wanted = contracts.filter(F.col("product") == product).select("date", "symbol")
    return df.join(wanted, ["date", "symbol"], "left_semi")


def path_parts(path_column: str = "_metadata.file_path") -> list:
    """mi, date, day or night, source and symbol of a record file path."""
    p = F.col(path_column)
    pattern = r"/(\d+)/(?:\d{4}/)?(\d{8})/(day|night)/([^/]+)/([^/.]+)\."
    names = ["mi_type", "date", "daynight", "source", "symbol"]
    return [F.regexp_extract(p, pattern, i + 1).alias(n) for i, n in enumerate(names)]


def read_fixed_width(spark: SparkSession, path: str, dtype: np.dtype, compressed: bool = False) -> tuple[DataFrame, DataFrame]:
    """Record files to rows, and the files whose size is not a whole number of records.

    A file is one symbol-day of one stream.  Splitting happens file by file; records are decoded
    with numpy in slices, so a task holds one file's bytes and one slice of rows.
    """
    files = spark.read.format("binaryFile").load(path).select(F.col("path"), "content")
    fields = {n: dtype.fields[n][0] for n in dtype.names}
    kinds = {"i": T.LongType(), "u": T.LongType(), "f": T.DoubleType(), "S": T.StringType()}

    def spark_type(d: np.dtype) -> T.DataType:
        base = kinds[d.base.kind]
        return T.ArrayType(base) if d.shape else base

    schema = T.StructType([T.StructField("path", T.StringType())] + [T.StructField(n, spark_type(d)) for n, d in fields.items()])
    size = dtype.itemsize

    def payload(raw: bytes) -> bytes:
        if not compressed:
            return raw
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(raw)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = payload(raw)
                if len(data) % size:
                    continue
                rows = np.frombuffer(data, dtype=dtype)
                for at in range(0, len(rows), 65_536):
                    part = rows[at : at + 65_536]
                    columns = [pa.array([p] * len(part))]
                    for n, d in fields.items():
                        v = part[n]
                        if d.base.kind == "S":
                            columns.append(pa.array([x.decode("utf8", "replace").rstrip("\x00") for x in v]))
                        elif d.shape:
                            columns.append(pa.array(v.astype("int64" if d.base.kind in "iu" else "float64").tolist()))
                        else:
                            columns.append(pa.array(v.astype("int64" if d.kind in "iu" else "float64")))
                    yield pa.RecordBatch.from_arrays(columns, names=["path", *fields])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(p, len(payload(raw))) for p, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            bad = [(p, n) for p, n in out if n % size]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in bad], pa.string()), pa.array([n for _, n in bad], pa.int64())], names=["path", "bytes"])

    return files.mapInArrow(decode, schema), files.mapInArrow(check, "path string, bytes bigint")


def write_ticks(df: DataFrame, path: str) -> None:
    """Partitioned by date; a stock-day may span several files of the same date."""
    spread = F.pmod(F.xxhash64("symbol", "serial"), F.lit(32))
    df.repartition("date", spread).sortWithinPartitions("symbol", "local_us").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)
