"""Writing an intermediate table once where a plan reads it several times."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, spark.checkpoint.dir. Only where driver and tasks are one process on one machine
    (tests) may it be unset; then it is a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="radiopos-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def place(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df as Parquet in the shared folder, read back. It is deleted when the application ends."""
    spark = df.sparkSession
    path = place(spark, name)
    df.write.options(**options).parquet(path)
    jvm = spark.sparkContext._jvm
    written = jvm.org.apache.hadoop.fs.Path(path)
    written.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(written)
    return spark.read.schema(df.schema).parquet(path)
