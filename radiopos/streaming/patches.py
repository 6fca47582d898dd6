"""Link metrics of new patches as they arrive: each file holds the paths of one whole patch.

A patch's file begins with a row without rx, its header, so that a patch without paths is known as well. What is finished
stands in a ledger, a row a patch: its saved and failed links and the batch that wrote it. The ledger's row is written after
the patch's results and replaces itself, so a batch that is replayed, or files that are delivered again under a new
checkpoint, change nothing: patches that the ledger lists are left out, others are written anew.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import radio
from ..sources import tables

PATHS = "patch_idx int, rx long, tx long, re double, im double"
LEDGER = "saved long, failed long, batch long, patch_idx int"


def patch_gains(paths: DataFrame) -> DataFrame:
    """The gain of each link of each patch."""
    links = paths.filter("rx IS NOT NULL")
    return links.groupBy("patch_idx", "rx", "tx").agg(F.sum(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("gain"))


def patch_metrics(paths: DataFrame) -> DataFrame:
    gains = patch_gains(paths)
    return gains.withColumns(radio.link_metrics(F.col("gain")))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def progress(ledger: DataFrame) -> DataFrame:
    """last_completed_patch, total_saved and failed_count, as a run that goes on needs them; -1 and zeros before the first."""
    return ledger.agg(F.coalesce(F.max("patch_idx"), F.lit(-1)).alias("last_completed_patch"), F.coalesce(F.sum("saved"), F.lit(0)).alias("total_saved"), F.coalesce(F.sum("failed"), F.lit(0)).alias("failed_count"))


def commit(batch: DataFrame, number: int, sink: str, ledger: str) -> None:
    """Writes what a batch brings: results of its new patches, then their rows in the ledger. Links without a finite gain
    are counted as failed."""
    spark = batch.sparkSession
    new = batch.join(read_ledger(spark, ledger).select("patch_idx").distinct(), "patch_idx", "left_anti").persist()
    try:
        fine = F.coalesce(~F.isnan("gain") & (F.abs("gain") != float("inf")), F.lit(False))
        metrics = patch_metrics(new).withColumn("fine", fine)
        tables.write_patch_results(metrics.filter("fine").drop("fine"), sink)
        counts = metrics.groupBy("patch_idx").agg(F.count_if("fine").alias("saved"), F.count_if(~F.col("fine")).alias("failed"))
        done = new.select("patch_idx").distinct().join(counts, "patch_idx", "left")
        done = done.select(F.coalesce("saved", F.lit(0)).alias("saved"), F.coalesce("failed", F.lit(0)).alias("failed"), F.lit(number).cast("long").alias("batch"), "patch_idx")
        tables.write_patch_results(done, ledger)
    finally:
        new.unpersist()


def run_available(spark: SparkSession, source: str, sink: str, checkpoint: str, files_per_batch: int = 100, ledger: str | None = None) -> None:
    """Processes files not seen before, then stops. The ledger stands beside the results unless it has a place."""
    ledger = ledger or f"{sink.rstrip('/')}-ledger"
    stream = spark.readStream.schema(PATHS).options(maxFilesPerTrigger=files_per_batch, recursiveFileLookup=True).parquet(source)
    writer = stream.writeStream.foreachBatch(lambda batch, number: commit(batch, number, sink, ledger))
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
