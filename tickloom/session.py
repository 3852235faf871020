"""Session defaults.

The library only relies on settings that are correct under any value; these
defaults make plans better, never right.
"""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # last-N per symbol keeps up to 4096 rows; let the map side prune to that too
    "spark.sql.optimizer.windowGroupLimitThreshold": "5000",
    # small but CPU-heavy results keep their parallelism; has no effect once partitions pass this size
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # what a later step reads of an earlier one is a table or a checkpoint: shuffle files go when the execution that needed them ends
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


def build_session(app: str = "tickloom", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    # checkpoints are removed once nothing refers to them
    builder = builder.config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, so that Python tasks find it wherever the driver runs."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="spark-", dir="/tmp"), "tickloom.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for file in sorted(root.rglob("*.py")):
            archive.write(file, file.relative_to(root.parent))
    context.addPyFile(str(target))
    _SHIPPED.add(context.applicationId)


def apply_defaults(spark: SparkSession) -> SparkSession:
    """Set the runtime defaults on a session somebody else created and ship the package to it."""
    for key, value in DEFAULTS.items():
        spark.conf.set(key, value)
    ship_package(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names, or a test folder where it names none."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        folder = configured
    elif spark.sparkContext.getCheckpointDir():
        return spark.sparkContext.getCheckpointDir()
    elif spark.sparkContext.master.startswith("local"):
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    else:
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of every executor."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The rows as a table in the checkpoint folder: for what several steps read, each with columns of its own."""
    path = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_written(*tables: DataFrame) -> None:
    """Deletes the files of tables that ``written`` made, once all that reads them is written itself."""
    for df in tables:
        spark = df.sparkSession
        for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
            if folder.rsplit("/", 1)[1].startswith("table-"):
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
