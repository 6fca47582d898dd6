"""Hard, medium and easy splits without spatial leakage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..staging import stage
from . import buildings, numbering

SPLITS = ("train", "hard_test", "hard_val", "medium_test", "medium_val", "easy_test", "easy_val")


def second_side(share: float, n: Column) -> Column:
    """How many of n keys the second side gets: ceil(share * n); none of a group of one, and at least one stays
    first unless the share is 1."""
    if not 0 <= share <= 1:
        raise ValueError(f"a share is between 0 and 1, not {share}")
    if share in (0, 1):
        return F.lit(0) if share == 0 else n
    return F.when(n <= 1, 0).otherwise(F.least(F.ceil(F.lit(share) * n), n - 1))


def draw(keys: DataFrame, group: Sequence[str], key: str, share: float, seed: int, out: str = "second") -> DataFrame:
    """keys (one row a key) with a flag for the second side of each group, drawn in the order of a seeded md5."""
    ranked = numbering.drawn(keys, [*group], key, seed)
    return ranked.withColumn(out, F.col("_rank") <= second_side(share, F.col("_size"))).drop("_rank", "_size")


def hard(df: DataFrame, test: dict[str, Column], val: dict[str, Column], margin: float = 0.0) -> DataFrame:
    """split by place: hard_test in the test box, else hard_val in the val box, else null; a margin shrinks them."""
    boxes = [geo.grown(b, -margin) if margin else b for b in (test, val)]
    lat, lon = F.col("latitude"), F.col("longitude")
    return df.withColumn("split", F.when(geo.inside(lat, lon, boxes[0]), "hard_test").when(geo.inside(lat, lon, boxes[1]), "hard_val"))


def medium(keys: DataFrame, train: float, test: float, seed: int) -> DataFrame:
    """Whole UEs of each campaign: the share 1 - train is held out; of that, the share test becomes val."""
    return _twice(keys, ["campaign_id"], "ue_id", train, test, seed, "medium")


def easy(keys: DataFrame, train: float, test: float, seed: int) -> DataFrame:
    """Crops of each UE, as medium does with UEs."""
    return _twice(keys, ["campaign_id", "ue_id"], "crop_id", train, test, seed, "easy")


def _twice(keys: DataFrame, group: list[str], key: str, train: float, test: float, seed: int, name: str) -> DataFrame:
    held = draw(keys, group, key, 1 - train, seed, "_out")
    again = draw(held.filter("_out"), group, key, test, seed + 1, "_val")
    named = again.withColumn("split", F.when(F.col("_val"), f"{name}_val").otherwise(f"{name}_test")).drop("_out", "_val")
    return held.filter(~F.col("_out")).withColumn("split", F.lit("train")).drop("_out").unionByName(named)


def without_overlap(train: DataFrame, test: dict[str, Column], val: dict[str, Column], half: Column, largest: float) -> DataFrame:
    """Train crops that meet neither box. Only UEs in a box grown by twice the largest crop's diagonal are tested."""
    buffer = 2 * largest * 2**0.5
    lat, lon = F.col("latitude"), F.col("longitude")
    own = geo.box(F.col("center_lat"), F.col("center_lon"), half.cast("double"))
    near = [geo.inside(lat, lon, geo.grown(b, buffer)) & geo.meets(own, b) for b in (test, val)]
    return train.filter(~(near[0] | near[1]))


def without_held_out_crops(split: DataFrame, cell: float = 0.005) -> DataFrame:
    """split: crop_id, split, center_lat, center_lon, half. Train crops whose box meets the box of any crop of another
    split go, so no train crop shows a place that a held-out crop shows."""
    boxed = split.withColumns(geo.box(F.col("center_lat"), F.col("center_lon"), F.col("half").cast("double")))
    train, held = (boxed.filter(f).select("crop_id", *geo.named()) for f in ("split = 'train'", "split != 'train'"))
    leaks = buildings.meets_any(train, held, "crop_id", cell)
    return split.join(leaks.withColumn("split", F.lit("train")), ["crop_id", "split"], "left_anti")


def split_index(index: DataFrame, test: dict[str, Column], val: dict[str, Column], medium_train: float, easy_train: float, share: float, seed: int, train_only: bool = False, largest: float | None = None) -> DataFrame:
    """Every crop with its split: hard by place, then medium by UE, then easy by crop; train_only keeps all in train.

    Train crops that meet the test or val box go, so UEs and campaigns left without crops go as well; largest is the
    half-width of the largest crop, and the index has center_lat, center_lon and half. Without largest nothing goes.
    """
    split = _every_split(index, test, val, medium_train, easy_train, share, seed, train_only)
    if largest is None:
        return split
    train = without_overlap(split.filter("split = 'train'"), test, val, F.col("half"), largest)
    return train.unionByName(split.filter("split != 'train'"))


def _every_split(index: DataFrame, test: dict[str, Column], val: dict[str, Column], medium_train: float, easy_train: float, share: float, seed: int, train_only: bool) -> DataFrame:
    if train_only:
        return index.withColumn("split", F.lit("train"))
    placed = stage(hard(index, test, val), "placed")
    rest = placed.filter(F.col("split").isNull()).drop("split")
    ues = medium(rest.select("campaign_id", "ue_id").distinct(), medium_train, share, seed)
    by_ue = stage(rest.join(ues, ["campaign_id", "ue_id"]), "by-ue")
    crops = easy(by_ue.filter("split = 'train'").drop("split"), easy_train, share, seed + 2)
    return placed.filter(F.col("split").isNotNull()).unionByName(by_ue.filter("split != 'train'")).unionByName(crops)


def campaigns(df: DataFrame) -> DataFrame:
    """The campaigns of all splits together."""
    return df.select("campaign_id").distinct()


def of_campaigns(df: DataFrame, chosen: Sequence[int]) -> DataFrame:
    """Rows of the chosen campaigns (a handful), in every split."""
    return df.filter(F.col("campaign_id").isin(*chosen))


def split_counts(df: DataFrame) -> DataFrame:
    point = F.struct("campaign_id", "ue_id", "crop_id")
    return df.groupBy("split").agg(F.count_distinct(point).alias("n_points"))
