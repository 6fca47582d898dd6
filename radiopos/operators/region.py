"""Regions: bounds, patches, and the filter with its fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo


def bounds(df: DataFrame, lat: str, lon: str) -> DataFrame:
    return df.agg(F.min(lat).alias("min_lat"), F.max(lat).alias("max_lat"), F.min(lon).alias("min_lon"), F.max(lon).alias("max_lon"))


def center_and_reach(df: DataFrame) -> DataFrame:
    """The middle of bounds and the distance to the farthest corner."""
    lat, lon = (F.col("min_lat") + F.col("max_lat")) / 2, (F.col("min_lon") + F.col("max_lon")) / 2
    corners = [geo.haversine(lat, lon, F.col(a), F.col(b)) for a in ("min_lat", "max_lat") for b in ("min_lon", "max_lon")]
    return df.withColumns({"center_lat": lat, "center_lon": lon, "reach_m": F.greatest(*corners)})


def stage_masks(box: tuple[float, float, float, float], slack: float = 0.2) -> list[tuple[str, Column]]:
    """Filters in the order they are tried: both ends in the box, the station only, the station in a wider box."""
    b = geo.literals(*box)
    wide = geo.literals(box[0] - slack * (box[1] - box[0]), box[1] + slack * (box[1] - box[0]), box[2] - slack * (box[3] - box[2]), box[3] + slack * (box[3] - box[2]))
    bs, ue = ("BSLatitude", "BSLongitude"), ("UELatitude", "UELongitude")
    on = lambda at, x: geo.inside(F.col(at[0]), F.col(at[1]), x)
    return [("both", on(bs, b) & on(ue, b)), ("station", on(bs, b)), ("wider", on(bs, wide))]


def region_counts(links: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Rows each stage would keep, in one pass."""
    return links.agg(F.count(F.lit(1)).alias("n_all"), *(F.count_if(m).alias(f"n_{name}") for name, m in stage_masks(box)))


def region_filter(links: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """The rows of the first stage that keeps any, with its name. One aggregate row decides."""
    counts = region_counts(links, box).first()
    for name, mask in stage_masks(box):
        if counts[f"n_{name}"]:
            return links.filter(mask).withColumn("stage", F.lit(name))
    raise ValueError(f"no link has its base station near {box}")


def station_summary(links: DataFrame, order: str, limit: int | None = 5) -> DataFrame:
    out = links.groupBy("BS_location").agg(F.count(F.lit(1)).alias("n"), F.min_by("BSLatitude", order).alias("lat"), F.min_by("BSLongitude", order).alias("lon"))
    return out if limit is None else out.orderBy(F.col("n").desc(), "BS_location").limit(limit)


def patches(spark: SparkSession, box: tuple[float, float, float, float], rows: int, columns: int) -> DataFrame:
    """Tiles of the box numbered row by row; row 0 lies at the north edge."""
    lo_lat, hi_lat, lo_lon, hi_lon = box
    h, w = (hi_lat - lo_lat) / rows, (hi_lon - lo_lon) / columns
    row, column = F.expr(f"id div {columns}"), F.col("id") % columns
    out = spark.range(rows * columns).select(F.col("id").alias("patch_idx"), row.alias("row"), column.alias("column"))
    return out.withColumns({"max_lat": hi_lat - F.col("row") * h, "min_lat": hi_lat - (F.col("row") + 1) * h, "min_lon": lo_lon + F.col("column") * w, "max_lon": lo_lon + (F.col("column") + 1) * w})


def patch_of(lat: Column, lon: Column, box: tuple[float, float, float, float], rows: int, columns: int) -> Column:
    """The tile of a point; null outside. The south and east edges belong to the last row and column."""
    row = F.least(F.floor((box[1] - lat) / ((box[1] - box[0]) / rows)), F.lit(rows - 1))
    column = F.least(F.floor((lon - box[2]) / ((box[3] - box[2]) / columns)), F.lit(columns - 1))
    return F.when(geo.inside(lat, lon, geo.literals(*box)), (row * columns + column).cast("long"))


def patch_info(tiles: DataFrame, buildings: DataFrame) -> DataFrame:
    """Tiles with their centre and the number of buildings whose patch_idx they are."""
    counts = buildings.groupBy("patch_idx").agg(F.count(F.lit(1)).alias("n_buildings"))
    out = tiles.join(counts, "patch_idx", "left").withColumn("n_buildings", F.coalesce("n_buildings", F.lit(0)))
    return out.withColumns({"center_lat": (F.col("min_lat") + F.col("max_lat")) / 2, "center_lon": (F.col("min_lon") + F.col("max_lon")) / 2})


def area_id(*bounds_columns: Column) -> Column:
    """The first 12 hex digits of the md5 of the bounds as text."""
    return F.substring(F.md5(F.format_string("_".join(["%.6f"] * len(bounds_columns)), *bounds_columns)), 1, 12)


def ground_planes(tiles: DataFrame, x0: Column, x1: Column, y0: Column, y1: Column, margin: float, z: float = -0.5) -> DataFrame:
    """Two triangles under each tile, `margin` wider on every side."""
    at = lambda x, y: F.struct(x.alias("x"), y.alias("y"), F.lit(z).alias("z"))
    a, b, c, d = at(x0 - margin, y0 - margin), at(x1 + margin, y0 - margin), at(x1 + margin, y1 + margin), at(x0 - margin, y1 + margin)
    both = F.array(F.struct(a.alias("p"), b.alias("q"), c.alias("r")), F.struct(a.alias("p"), c.alias("q"), d.alias("r")))
    return tiles.select("patch_idx", F.posexplode(both).alias("triangle", "t")).select("patch_idx", "triangle", "t.*")
