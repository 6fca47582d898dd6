"""Scoring of predicted places."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo, radio

TOLERANCES = (1, 5, 10, 20, 30, 40, 50)


def errors(predictions: DataFrame, width: int) -> DataFrame:
    """Predicted pixel, and the error in metres: pixels times the map's metres a pixel."""
    y, x = radio.peak(F.col("heatmap"), width)
    out = predictions.withColumns({"pred_y": y, "pred_x": x})
    pixels = F.sqrt(F.pow(F.col("pred_y") - F.col("ue_y"), 2) + F.pow(F.col("pred_x") - F.col("ue_x"), 2))
    return out.withColumn("error_m", pixels * F.col("original_img_size") / width)


def summary(scored: DataFrame, by: str) -> DataFrame:
    """n, mean error and root mean square a group; a null group is the total."""
    return scored.rollup(by).agg(F.count(F.lit(1)).alias("n"), F.avg("error_m").alias("mean_error_m"), F.sqrt(F.avg(F.col("error_m") * F.col("error_m"))).alias("rmse_m"))


def accuracy(scored: DataFrame, by: Sequence[str] = (), tolerances: Sequence[float] = TOLERANCES) -> DataFrame:
    """One row a group and tolerance: share of errors below it. One pass over the rows, whatever the tolerances."""
    shares = scored.groupBy(*by).agg(*(F.avg((F.col("error_m") < t).cast("double")).alias(f"t{i}") for i, t in enumerate(tolerances)))
    long = F.inline(F.array(*(F.struct(F.lit(float(t)).alias("tolerance"), F.col(f"t{i}").alias("accuracy")) for i, t in enumerate(tolerances))))
    return shares.select(*by, long)


def size_bins(scored: DataFrame, edges: Sequence[float], size: str = "original_img_size") -> DataFrame:
    """bin_start, bin_end, n, mean_error_m for [a, b), the last bin closed; sizes outside go, empty bins stay with 0
    rows. With fewer than two edges one row holds everything."""
    edges = sorted(edges)
    if len(edges) < 2:
        return scored.agg(F.lit(None).cast("double").alias("bin_start"), F.lit(None).cast("double").alias("bin_end"), F.count(F.lit(1)).alias("n"), F.avg("error_m").alias("mean_error_m"))
    no = F.size(F.filter(F.array(*(F.lit(float(e)) for e in edges)), lambda e: e <= F.col(size))) - 1
    last = len(edges) - 2
    placed = scored.filter(F.col(size).between(edges[0], edges[-1])).withColumn("bin", F.least(no, F.lit(last)))
    found = placed.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("error_m").alias("mean_error_m"))
    bins = scored.sparkSession.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))], "bin int, bin_start double, bin_end double")
    return bins.join(found, "bin", "left").select("bin_start", "bin_end", F.coalesce("n", F.lit(0)).alias("n"), "mean_error_m")


def epoch_means(metrics: DataFrame) -> DataFrame:
    """Mean of the batches' means, and the mean weighted by batch rows."""
    weighted = F.try_divide(F.sum(F.col("metric") * F.col("rows")), F.sum("rows"))
    return metrics.groupBy("loader", "epoch").agg(F.avg("metric").alias("macro"), weighted.alias("weighted"))


def domain_scores(rows: DataFrame, by: str) -> DataFrame:
    """Accuracy and binary cross entropy of logits against labels 0 and 1."""
    p = radio.sigmoid(F.col("logit"))
    loss = F.greatest(F.col("logit"), F.lit(0.0)) - F.col("logit") * F.col("label") + F.log1p(F.exp(-F.abs("logit")))
    return rows.groupBy(by).agg(F.avg(((p > 0.5).cast("int") == F.col("label")).cast("double")).alias("accuracy"), F.avg(loss).alias("bce"))


def heatmap_losses(rows: DataFrame, by: str, smooth: float = 1.0) -> DataFrame:
    """Mean cross entropy of logits over all pixels, and the Dice loss over a group (a batch)."""
    both = F.zip_with("logits", "target", lambda z, t: F.struct(z.alias("z"), t.alias("t")))
    bce = lambda v: F.greatest(v["z"], F.lit(0.0)) - v["z"] * v["t"] + F.log1p(F.exp(-F.abs(v["z"])))
    total = lambda f: F.aggregate(both, F.lit(0.0), lambda s, v: s + f(v))
    parts = rows.select(by, F.size("logits").alias("n"), total(bce).alias("bce"), total(lambda v: radio.sigmoid(v["z"]) * v["t"]).alias("both"), total(lambda v: radio.sigmoid(v["z"])).alias("p"), total(lambda v: v["t"]).alias("t"))
    dice = 1 - (2 * F.sum("both") + smooth) / (F.sum("p") + F.sum("t") + smooth)
    return parts.groupBy(by).agg((F.sum("bce") / F.sum("n")).alias("bce"), dice.alias("dice"))


def reconstructed(scored: DataFrame, width: int) -> DataFrame:
    """Predicted latitude and longitude, and the geodesic distance to the true place."""
    metres = F.col("original_img_size") / width
    lat, lon = geo.pixel_place(F.col("center_lat"), F.col("center_lon"), F.col("original_img_size") / 2, F.col("pred_y") * metres, F.col("pred_x") * metres)
    out = scored.withColumns({"pred_lat": lat, "pred_lon": lon})
    return out.withColumn("distance_m", geo.geodesic(F.col("ue_lat"), F.col("ue_lon"), F.col("pred_lat"), F.col("pred_lon")))


def display_sample(rows: DataFrame, n: int, order: Column, one_per: list[str] | None = None) -> DataFrame:
    """n rows by a hashed order; of those one a UE if asked."""
    some = rows.orderBy(order).limit(n)
    return some.dropDuplicates(one_per) if one_per else some
