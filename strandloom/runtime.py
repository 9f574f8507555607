"""Session settings, table access and lineage cuts shared by every operator.

Nothing here is specific to one operator. `materialize` is the only place where
intermediate results touch storage: it writes Parquet into the folder that the
cluster names in ``spark.checkpoint.dir`` (shared by all executors, so a lost
executor costs a task retry and nothing else) and reads it back, which also
resets the optimizer's size estimates between rounds of an iteration.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_LOCAL_FALLBACK: dict[str, str] = {}
_SHIPPED: set[str] = set()


def local_session(cpus: int | str = "*", shuffle: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benches on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("strandloom")
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python, once an application; they need not have it installed."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    package = os.path.dirname(os.path.abspath(__file__))
    if os.path.isdir(package):
        path = os.path.join(tempfile.mkdtemp(prefix="strandloom-"), "strandloom.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, files in os.walk(package):
                for f in files:
                    if f.endswith(".py"):
                        full = os.path.join(folder, f)
                        z.write(full, os.path.join("strandloom", os.path.relpath(full, package)))
        context.addPyFile(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given Parquet tables, a file or a folder of files."""
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shuffle_partitions(spark: SparkSession, times: float = 1.0, least: int = 1) -> int:
    """Partitions for an explicit repartition, following the session's setting."""
    return max(least, int(int(spark.conf.get("spark.sql.shuffle.partitions", "200")) * times))


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a local one only where the session has none (tests)."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_FALLBACK:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _LOCAL_FALLBACK[app] = "file://" + tempfile.mkdtemp(prefix="strandloom-")
    return _LOCAL_FALLBACK[app]


def _filesystem(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh place in the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_folder(spark)}/strandloom-{label}-{uuid.uuid4().hex}"
    fs, where = _filesystem(spark, path)
    fs.deleteOnExit(where)
    return path


def materialize(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write `df` to the shared folder and read it back: (frame, path)."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Remove a table written by `materialize` that nothing reads any more."""
    fs, where = _filesystem(spark, path)
    fs.delete(where, True)


def materialize_split(df: DataFrame, flag: str, label: str) -> tuple[tuple[DataFrame, str], tuple[DataFrame, str]]:
    """Write `df` in two tables by a BOOLEAN column that is never null, in one pass: ((true rows, path), (false rows, path)).

    Either can be discarded on its own; a table without rows has no folder, and discarding it does nothing."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.partitionBy(flag).parquet(path)
    own = StructType([f for f in df.schema.fields if f.name != flag])

    def part(value: bool) -> tuple[DataFrame, str]:
        where = f"{path}/{flag}={str(value).lower()}"
        fs, at = _filesystem(spark, where)
        rows = spark.read.schema(own).parquet(where) if fs.exists(at) else spark.createDataFrame([], own)
        return rows.withColumn(flag, F.lit(value)).select(*df.columns), where

    return part(True), part(False)
