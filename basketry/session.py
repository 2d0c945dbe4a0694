"""Sessions: settings that the library relies on, and shipping its code to the executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED = "basketry.shipped"
_DIR = "basketry.dir"
_RUN = "run"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def session(name: str = "basketry", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution. ``master`` only where spark-submit does not set it."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per session, as ``--py-files`` would.

    Operators with Python kernels call it, so that they also work where only the driver has the package on its path.
    """
    if spark.conf.get(_BATCH) == "10000":  # Spark's default; rows may carry whole texts, so a worker holds fewer at once
        spark.conf.set(_BATCH, "1000")
    if spark.conf.get(_SHIPPED, "") == spark.sparkContext.applicationId:
        return
    root = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="ship-"), "basketry.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(path)
    spark.conf.set(_SHIPPED, spark.sparkContext.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (``spark.checkpoint.dir``).

    Where it is unset, a local master gets a temporary folder of its own; a cluster is refused,
    since executors would not see each other's files.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """This application's own folder in the shared one. It is deleted when the driver's JVM ends, as are the tables in it."""
    path = f"{shared_dir(spark)}/{_RUN}-{spark.sparkContext.applicationId}"
    if spark.conf.get(_DIR, "") != path:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(folder)
        files.deleteOnExit(folder)
        spark.conf.set(_DIR, path)
    return path


def table(df: DataFrame) -> DataFrame:
    """Write ``df`` to the run's folder and read it back: lineage ends here and a lost executor costs nothing."""
    path = f"{run_dir(df.sparkSession)}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
