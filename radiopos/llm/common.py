"""Helpers shared by the operators: staging in the shared folder, text columns, two-level running sums."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import staging

#: Words of every operator are maximal runs of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage is cut, lost executors cost nothing."""
    return staging.stage(df, name, compression="zstd")


def small(batches: Iterator, rows: int = 500) -> Iterator:
    """Arrow batches cut to `rows` rows, so that a worker's own copies of long texts stay few."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def text_of(column: str = "text") -> Column:
    """The text with null as the empty string."""
    return F.coalesce(F.col(column), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def running_start(df: DataFrame, key: str, order: str, value: str, out: str, rows: int, ties: tuple[str, ...] = ()) -> DataFrame:
    """Adds out: the sum of value over the rows of the same key that come before, in a hashed order of `order`; rows
    of equal order follow each other by value and `ties`.

    `rows` is the number of rows (or near it). Each key is cut into about sqrt(rows) chunks, so a key that holds
    a third of all rows has chunks of about sqrt(rows) / 3 rows, and neither the window within a chunk nor the
    one over a key's chunk sums gathers a whole key in one task. key must not be null.
    """
    cut = df.withColumn("_chunk", F.pmod(F.xxhash64(order), F.lit(math.isqrt(rows) + 1)))
    sums = cut.groupBy(key, "_chunk").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(key, "_chunk", F.coalesce(F.sum("_sum").over(before), F.lit(0)).cast("long").alias("_base"))
    inside = Window.partitionBy(key, "_chunk").orderBy(order, value, *ties).rowsBetween(Window.unboundedPreceding, -1)
    return (
        cut.withColumn("_inner", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(sums, [key, "_chunk"])
        .withColumn(out, (F.col("_base") + F.col("_inner")).cast("long"))
        .drop("_chunk", "_base", "_inner")
    )
