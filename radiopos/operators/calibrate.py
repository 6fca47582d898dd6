"""Simulated against measured signals: corrections, indices, rank correlation and trials."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import radio
from ..staging import stage
from . import links, numbering
from .numbering import dense


#: Corrected coordinates of base stations by location key.
CORRECTIONS = {
    "41.871766_12.461936": (41.87255347, 12.46204160),
    "41.868917_12.462432": (41.86982378, 12.46159222),
    "41.870385_12.46081": (41.86982378, 12.46159222),
    "41.865419_12.465402": (41.86603287, 12.46527750),
    "41.869046_12.46551": (41.86603287, 12.46527750),
    "41.871251_12.464301": (41.87255347, 12.46204160),
    "41.871046_12.471436": (41.87131243, 12.46805397),
    "41.873666_12.453575": (41.87290044, 12.45348311),
    "41.864758_12.469067": (41.86384904, 12.46890104),
    "41.866025_12.465944": (41.86603287, 12.46527750),
}


def corrections(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in CORRECTIONS.items()], "BS_location string, new_lat double, new_lon double")


def corrected(links: DataFrame, corrections: DataFrame) -> DataFrame:
    """Links with the corrected station coordinates where BS_location is listed, and the key made anew; corrections
    (BS_location, new_lat, new_lon) are a handful of rows."""
    out = links.join(corrections, "BS_location", "left")
    out = out.withColumns({"BSLatitude": F.coalesce("new_lat", "BSLatitude"), "BSLongitude": F.coalesce("new_lon", "BSLongitude")})
    key = radio.location_key(F.col("BSLatitude"), F.col("BSLongitude"), 8)
    return out.withColumn("BS_location", F.when(F.col("new_lat").isNotNull(), key).otherwise(F.col("BS_location"))).drop("new_lat", "new_lon")


def appearance_index(rows: DataFrame, key: str, order: str, out: str) -> DataFrame:
    """(key, first order value, dense number from 0) by first appearance; order is a number."""
    return dense(rows.groupBy(key).agg(F.min(order).alias("first_row")), out, "first_row").select(key, "first_row", out)


def dense_cube(rows: DataFrame, metrics: list[str], order: str, fill: float = radio.MISSING) -> DataFrame:
    """Every (tx, rx) of a scene with its last metrics, missing ones filled."""
    last = rows.groupBy("tx_idx", "rx_idx").agg(*(F.max_by(m, order).alias(m) for m in metrics))
    grid = links.every_pair(rows.select("rx_idx").distinct(), rows.select("tx_idx").distinct())
    full = grid.join(last, ["tx_idx", "rx_idx"], "left")
    return full.select("tx_idx", "rx_idx", *(F.coalesce(m, F.lit(fill)).alias(m) for m in metrics))


def average_ranks(counts: DataFrame, group: list[str], value: str, count: str, out: str) -> DataFrame:
    """group, value, out: ranks from 1 of values that occur `count` times each; ties share their mean rank."""
    each = counts.groupBy(*group, value).agg(F.sum(count).alias("_times"))
    ranked = numbering.running(each, "_before", "_times", group, value)
    return ranked.select(*group, value, (F.col("_before") + (F.col("_times") + 1) / 2.0).alias(out))


def spearman(rows: DataFrame, group: list[str], a: str, b: str) -> DataFrame:
    """group, n, rho; null for constant or single rows. group, a and b are not null.

    Rows become counts of (group, a, b) first. Ranks come from running sums over value ranges, so no group is sorted
    in one task; as the mean rank is (n + 1) / 2, sums of products about it give the correlation in one pass.
    """
    counts = stage(rows.groupBy(*group, F.col(a).alias("_x"), F.col(b).alias("_y")).agg(F.count(F.lit(1)).alias("_c")), "rank-counts")
    ranked = counts.join(average_ranks(counts, group, "_x", "_c", "_a"), [*group, "_x"]).join(average_ranks(counts, group, "_y", "_c", "_b"), [*group, "_y"])
    sizes = counts.groupBy(*group).agg(F.sum("_c").alias("n"))
    x, y = (F.col(c) - (F.col("n") + 1) / 2.0 for c in ("_a", "_b"))
    sums = ranked.join(sizes, group).groupBy(*group, "n").agg(F.sum(F.col("_c") * x * y).alias("_xy"), F.sum(F.col("_c") * x * x).alias("_xx"), F.sum(F.col("_c") * y * y).alias("_yy"))
    return sums.select(*group, "n", F.try_divide(F.col("_xy"), F.sqrt("_xx") * F.sqrt("_yy")).alias("rho"))


def spearman_both(rows: DataFrame, group: list[str], real: str, simulated: str, missing: float = radio.MISSING) -> DataFrame:
    """rho over all rows and over those whose real value is not the missing mark."""
    full = spearman(rows, group, real, simulated)
    part = spearman(rows.filter(F.col(real) != missing), group, real, simulated).withColumnsRenamed({"n": "n_filtered", "rho": "rho_filtered"})
    return full.join(part, group, "left")


def student_tail(t: float, n: float) -> float:
    """Two-sided tail of Student's t with n degrees of freedom, by the incomplete beta's continued fraction."""
    x = n / (n + t * t)
    a, b = n / 2, 0.5
    if x in (0.0, 1.0):
        return x
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(b, a, 1 - x)
    return _beta(a, b, x)


def _beta(a: float, b: float, x: float) -> float:
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    value = d
    for m in range(1, 300):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + step * d if abs(1 + step * d) > 1e-300 else 1e-300)
            c = 1 + step / c if abs(1 + step / c) > 1e-300 else 1e-300
            value *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * value


def p_value(rho: float | None, n: int) -> float | None:
    if rho is None or rho != rho or n < 3:
        return None
    return 0.0 if abs(rho) >= 1 else student_tail(rho * math.sqrt((n - 2) / (1 - rho * rho)), n - 2)


def with_p_value(correlations: DataFrame) -> DataFrame:
    """Adds the two-sided p-value; runs over aggregated rows only."""

    @F.pandas_udf("double")
    def of(rho: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([p_value(r, k) for r, k in zip(rho, n, strict=True)], dtype="float64")

    return correlations.withColumn("p_value", of("rho", "n"))


def best_trial(trials: DataFrame) -> DataFrame:
    """The trial of least score for each station; a failed one (null) scores 1, ties go to the earlier trial."""
    scored = trials.withColumn("score", F.coalesce("score", F.lit(1.0)))
    best = F.min(F.struct("score", "trial")).alias("_b")
    return scored.groupBy("bs_idx").agg(best, F.count(F.lit(1)).alias("n_trials")).select("bs_idx", F.col("_b.trial").alias("best_trial"), F.col("_b.score").alias("best_score"), "n_trials")


def trial_history(trials: DataFrame) -> DataFrame:
    """Every trial with its score (1 if it failed) and the best score up to it, for each station in order of trials."""
    scored = trials.select("bs_idx", "trial", F.coalesce("score", F.lit(1.0)).alias("score"))
    return numbering.least_so_far(scored, "best_so_far", "score", ["bs_idx"], "trial")


def trial_scores(trials: DataFrame, real: str = "real_rssi", simulated: str = "sim_rssi") -> DataFrame:
    """bs_idx, trial, score = -rho over the links of each trial (1 where undefined): all trials in one job."""
    found = spearman(trials, ["bs_idx", "trial"], real, simulated)
    return found.select("bs_idx", "trial", F.coalesce(0.0 - F.col("rho"), F.lit(1.0)).alias("score"))


def best_epoch(metrics: DataFrame) -> DataFrame:
    """Best epoch by the least monitored value, and the last one."""
    return metrics.agg(F.min_by("epoch", F.struct("value", "epoch")).alias("best_epoch"), F.max("epoch").alias("last_epoch"))
