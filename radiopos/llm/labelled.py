"""A bounded, repeatable sample of labelled documents, for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common


def held_out(modulus: int, remainder: int) -> Column:
    """Whether a document's labels are never learned from: crc32(doc_id as text) mod modulus is remainder."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == remainder, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, out: Column, size: int) -> DataFrame:
    """At most `size` rows (doc_id, y, text), those of the smallest hash among labelled rows that are not held out.

    Null labels and documents whose labels contradict each other evenly take no part. The labelled ids are at
    most `size` rows, so broadcasting them is bounded by that parameter whatever the tables hold.
    """
    known = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~out)
    votes = known.groupBy("doc_id").agg(F.avg(label).alias("vote")).filter("vote != 0.5")
    chosen = votes.orderBy(F.xxhash64("doc_id"), "doc_id").limit(size).select("doc_id", (F.col("vote") > 0.5).cast("int").alias("y"))
    return docs.select("doc_id", common.text_of().alias("text")).join(F.broadcast(chosen), "doc_id")

