"""A folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def hadoop_path(spark: SparkSession, path: str) -> tuple:
    """The file system of a path, and the path as it wants it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a folder of our own (gone at exit) serves a local master, as in tests; on a
    cluster other machines would not see it, so there it is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        local = tempfile.mkdtemp(prefix="siltstone-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        folder = f"file://{local}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder below it, deleted when the application ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    system, p = hadoop_path(spark, path)
    system.mkdirs(p)  # deleteOnExit takes note of existing paths alone
    system.deleteOnExit(p)
    return path


def staged(rows: DataFrame, name: str) -> DataFrame:
    """The rows, written there once."""
    path = scratch_path(rows.sparkSession, name)
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


#: Rows and bytes of one Arrow batch: texts can be long, and a batch is held by the JVM and by Python at once.
ARROW_ROWS, ARROW_BYTES = 1000, 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bound the size of the batches that Python workers get."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)):
        now = spark.conf.get(key, str(most + 1))  # a smaller setting of the user's stays
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))
