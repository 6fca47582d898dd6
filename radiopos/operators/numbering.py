"""Dense numbers, ranks and counts in a given order, without sorting a table or a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import draws
from ..staging import stage

_WITHIN = 2**33 - 1  # the part of monotonically_increasing_id that counts within a partition
#: md5 digits that deal a group's keys into 4096 parts.
_DIGITS = 3


def _ranged(df: DataFrame, keys: tuple[str, ...], name: str) -> DataFrame:
    """df sorted into value ranges of all keys, one a shuffle partition, and written: _part, and _at from 0 within it."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    at = F.monotonically_increasing_id().bitwiseAND(F.lit(_WITHIN))
    return stage(ordered.select("*", F.spark_partition_id().alias("_part"), at.alias("_at")), name)


def dense(df: DataFrame, out: str, *keys: str) -> DataFrame:
    """Numbers the rows from 0 in the order of keys, which are unique together. One row a partition is broadcast."""
    ranged = _ranged(df, keys, "numbered")
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    return ranged.join(F.broadcast(offsets), "_part").withColumn(out, F.col("_offset") + F.col("_at")).drop("_part", "_at", "_offset")


def within(df: DataFrame, out: str, group: list[str], *order: str) -> DataFrame:
    """Numbers the rows of each group from 0 in order; group and order are unique together. A group may be any share
    of the rows: the numbers run through the whole table, and each group takes off its first one."""
    numbered = dense(df, "_no", *group, *order)
    first = numbered.groupBy(*group).agg(F.min("_no").alias("_first"))
    return numbered.join(first, group).withColumn(out, F.col("_no") - F.col("_first")).drop("_no", "_first")


def running(df: DataFrame, out: str, value: str, group: list[str], order: str) -> DataFrame:
    """The sum of value over the rows of the same group that come before; group and order are unique together."""
    ranged = _ranged(df, (*group, order), "running")
    inside = Window.partitionBy("_part", *group).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("_part", *group).agg(F.sum(value).alias("_sum"))
    # a group has a row for each range it lies in
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_base", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum")
    summed = ranged.withColumn("_own", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return summed.join(sums, ["_part", *group]).withColumn(out, F.col("_base") + F.col("_own")).drop("_part", "_at", "_base", "_own")


def least_so_far(df: DataFrame, out: str, value: str, group: list[str], order: str) -> DataFrame:
    """The least value over the rows of the same group up to each row; group and order are unique together. A group has a
    row for each range it lies in, and no task has more of it than a range."""
    ranged = _ranged(df, (*group, order), "least")
    inside = Window.partitionBy("_part", *group).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy("_part", *group).agg(F.min(value).alias("_least")).withColumn("_base", F.min("_least").over(earlier))
    parts = parts.select(F.col("_part").alias("_p"), *(F.col(g).alias(f"_g{i}") for i, g in enumerate(group)), "_base")
    on = [F.col("_part") == F.col("_p"), *(F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group))]
    joined = ranged.withColumn("_own", F.min(value).over(inside)).join(parts, on)
    return joined.withColumn(out, F.least("_base", "_own")).select(*df.columns, out)


def drawn(keys: DataFrame, group: list[str], key: str, seed: int, rank: str = "_rank", size: str = "_size") -> DataFrame:
    """Ranks from 1 in the order of a seeded md5 of key (unique in its group), and the sizes of the groups. The first
    digits of the md5 deal a group into parts; ranks within a part and counts of the parts before add up."""
    dealt = keys.withColumn("_md5", draws.key(seed, key)).withColumn("_deal", F.substring("_md5", 1, _DIGITS))
    inside = Window.partitionBy(*group, "_deal").orderBy("_md5", key)
    parts = dealt.groupBy(*group, "_deal").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*group).orderBy("_deal").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).withColumn(size, F.sum("_n").over(Window.partitionBy(*group))).drop("_n")
    ranked = dealt.withColumn("_in", F.row_number().over(inside)).join(parts, [*group, "_deal"])
    return ranked.withColumn(rank, F.col("_before") + F.col("_in")).drop("_md5", "_deal", "_before", "_in")
