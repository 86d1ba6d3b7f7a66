"""Session settings and the one place where lineage is cut."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # a union of sides that are split into unlike numbers of partitions at run time
    # fails with the partitioning that Spark 4.1 works out for it
    "spark.sql.unionOutputPartitioning": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # rows of whole texts: a batch stays a few megabytes
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    # keyed streaming state (transformWithState) needs this provider
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(master: str | None = None, app: str = "newsloom", **extra: str) -> SparkSession:
    """A session with the engine's settings; `extra` keys use `__` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    # checkpoint files go when nothing refers to them any more
    builder = builder.config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return prepare(builder.getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings to a session made elsewhere and give its
    workers this package."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    ship_package(spark)
    return spark


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send the package to the Python workers, once per application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parent
        archive = shutil.make_archive(
            tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/newsloom", "zip", root.parent, root.name)
        spark.sparkContext.addPyFile(archive)
        _shipped.add(app)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: the session's own setting, or a
    temporary folder only when Spark runs on this one machine."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Write `df` as Parquet into the shared folder and continue from the files,
    so a lost executor re-reads them instead of recomputing the whole history.
    The files are columnar: later steps read only the columns they use. `discard`
    removes them early; otherwise they go with the folder."""
    path = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored._cut_path = path
    return stored


def discard(stored: DataFrame) -> None:
    """Remove the files of a table that `cut` wrote, once nothing reads it."""
    path = getattr(stored, "_cut_path", None)
    if path:
        jvm = stored.sparkSession._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(stored.sparkSession._jsc.hadoopConfiguration()).delete(target, True)
