"""Preparing measurements: flattening, cleaning, de-duplication, cell positions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The order of numbers in a row of the raw matrix.
MATRIX = ("npci", "enode", "rssi", "nsinr", "nrsrp", "nrsrq", "toa", "operator_id", "campaign_id")
CELL_KEY = ("enode", "mnc", "npci")
MEASUREMENT_KEY = ("latitude", "longitude", *CELL_KEY)


def flatten_measurements(observed: DataFrame, interpolated: DataFrame | None = None) -> DataFrame:
    """lat, lon, info (array of rows) to one row a measurement, with a flag for interpolated ones."""

    def flat(raw: DataFrame, flag: bool) -> DataFrame:
        rows = raw.select(F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), F.explode("info").alias("row"))
        return rows.select("latitude", "longitude", *(F.try_element_at("row", F.lit(i)).alias(n) for i, n in enumerate(MATRIX, 1)), F.lit(flag).alias("interpolated"))

    out = flat(observed, False)
    return out if interpolated is None else out.unionByName(flat(interpolated, True))


def normalise_ids(df: DataFrame) -> DataFrame:
    """Whole ids: operator_id (null: 0) becomes mnc."""
    out = df.withColumn("mnc", F.coalesce("operator_id", F.lit(0)).cast("int")).drop("operator_id")
    return out.withColumns({c: F.col(c).cast("long") for c in ("npci", "enode", "campaign_id") if c in out.columns})


def drop_missing(df: DataFrame) -> DataFrame:
    """Rows without any null or NaN."""
    numbers = [n for n, t in df.dtypes if t in ("double", "float")]
    out = df.na.drop("any")
    for n in numbers:
        out = out.filter(~F.isnan(n))
    return out


def deduplicate(df: DataFrame, keys: Sequence[str] = MEASUREMENT_KEY, tie: Sequence[str] = ()) -> DataFrame:
    """One row a key, observed before interpolated, then the least of `tie`; with a total tie-break the result is
    the same on any partitioning. Each task keeps its least row a key before the shuffle."""
    order = ["interpolated", *tie]
    rest = [c for c in df.columns if c not in keys and c not in order]
    least = df.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("_row"))  # each value once, as all of it is shuffled
    return least.select(*keys, "_row.*").select(*df.columns)


def placed_cells(cells: DataFrame) -> DataFrame:
    """Cells of known position; longitude 0 means unknown."""
    return cells.filter(F.col("cell_lon").isNotNull() & (F.col("cell_lon") != 0))


def attach_cells(measurements: DataFrame, cells: DataFrame, keys: Sequence[str] = CELL_KEY) -> DataFrame:
    """Measurements with the position of their cell; those without one go. Spark broadcasts the cells if small."""
    return measurements.join(placed_cells(cells), list(keys))


def attach_passive(passive: DataFrame, measurements: DataFrame, keys: Sequence[str], required: str) -> DataFrame:
    """Passive rows with the measurement of the same cell and place; places meet at six decimals."""
    rounded = {c: F.round(c, 6) for c in ("latitude", "longitude") if c in keys}
    return passive.withColumns(rounded).join(measurements.withColumns(rounded), list(keys), "left").filter(F.col(required).isNotNull())


def ue_positions(df: DataFrame) -> DataFrame:
    return df.select("latitude", "longitude").distinct()


def campaign_profile(df: DataFrame) -> DataFrame:
    places = F.struct("latitude", "longitude")
    return df.groupBy("campaign_id").agg(F.count_distinct(places).alias("n_ues"), F.count(F.lit(1)).alias("n_rows"))


def campaign_map(df: DataFrame, left: str, right: str) -> DataFrame:
    """Which values of `right` occur with each `left`, sorted."""
    return df.groupBy(left).agg(F.array_sort(F.collect_set(right)).alias("matches"))


def fill_rssi(df: DataFrame, column: str = "rssi", value: float = -90.0) -> tuple[DataFrame, Column]:
    """df with missing values filled, and the aggregate that counts them in the original."""
    return df.na.fill({column: value}), F.count_if(F.col(column).isNull())
