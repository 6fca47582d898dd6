"""Square map crops around measured places and the base stations in them."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import draws, geo, radio
from .numbering import dense


def numbered_ues(ues: DataFrame, keys: tuple[str, ...] = ("latitude", "longitude")) -> DataFrame:
    """Dense numbers from 0 in key order, as `ue`."""
    return dense(ues, "ue", *keys)


def random_ue_crops(spark: SparkSession, n: int, ues: DataFrame, n_ues: int, seed: int) -> DataFrame:
    """n crops, each on a uniformly drawn numbered UE."""
    return spark.range(n).withColumnRenamed("id", "crop_id").withColumn("ue", draws.whole(seed, n_ues, "crop_id")).join(ues, "ue")


def crops_per_ue(ues: DataFrame, k: int) -> DataFrame:
    """k crops for each UE, numbered ue * k + j."""
    return ues.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn("crop_id", F.col("ue") * k + F.col("j"))


def grid_crops(ues: DataFrame, half: float, g: int, first: int = 0, last: int | None = None) -> DataFrame:
    """(g + 1)^2 centres on a regular grid over the box of `half` metres around each UE; first and last cut the
    numbers of the grid points."""
    bounds = geo.box(F.col("latitude"), F.col("longitude"), F.lit(float(half)))
    steps = F.sequence(F.lit(0), F.lit(g))
    out = ues.withColumns(bounds).withColumn("gy", F.explode(steps)).withColumn("gx", F.explode(steps)).withColumn("grid_no", F.col("gy") * (g + 1) + F.col("gx"))
    out = out.filter(F.col("grid_no").between(first, (g + 1) ** 2 - 1 if last is None else last))
    along = lambda lo, hi, i: F.col(lo) + (F.col(hi) - F.col(lo)) * F.col(i) / g
    return out.withColumns({"center_lat": along("min_lat", "max_lat", "gy"), "center_lon": along("min_lon", "max_lon", "gx")}).drop("min_lat", "max_lat", "min_lon", "max_lon")


def jittered(crops: DataFrame, half: Column, u: Column, v: Column, share: float = 0.9) -> DataFrame:
    """A centre drawn in the box of share * half around the UE, by u and v in [0, 1)."""
    b = geo.box(F.col("latitude"), F.col("longitude"), half * share)
    return crops.withColumns({"center_lat": b["min_lat"] + (b["max_lat"] - b["min_lat"]) * u, "center_lon": b["min_lon"] + (b["max_lon"] - b["min_lon"]) * v})


def half_sizes(crops: DataFrame, mean: float, deviation: float, least: float, most: float, seed: int) -> DataFrame:
    """Half-sizes of a normal distribution within [least, most], cut to whole metres. Drawing again outside the bounds
    is the same as one draw from the distribution between them, so a number between their shares is turned around."""
    if deviation == 0:
        return crops.withColumn("half", F.lit(int(mean)))
    normal = NormalDist(mean, deviation)
    low, high = normal.cdf(least), normal.cdf(most)
    share = low + (high - low) * draws.uniform(seed, "crop_id")
    size = F.least(F.greatest(mean + deviation * draws.normal_quantile(share), F.lit(float(least))), F.lit(float(most)))
    return crops.withColumn("half", size.cast("int"))


def outside(crops: DataFrame) -> Column:
    """Counts crops whose UE lies outside."""
    return F.count_if(~geo.inside(F.col("latitude"), F.col("longitude"), geo.box(F.col("center_lat"), F.col("center_lon"), F.col("half").cast("double"))))


def cells_in_crops(crops: DataFrame, measurements: DataFrame) -> DataFrame:
    """Measurements of a crop's UE whose cell lies in the crop: an equi-join on the place, the box on top."""
    boxed = crops.withColumns(geo.box(F.col("center_lat"), F.col("center_lon"), F.col("half").cast("double")))
    return boxed.join(measurements, ["latitude", "longitude"]).filter(geo.inside(F.col("cell_lat"), F.col("cell_lon"), geo.named()))


def distinct_cells(found: DataFrame, keys: tuple[str, ...] = ("enode", "mnc", "npci")) -> DataFrame:
    """One row a cell and crop, observed before interpolated. Keys may have the place of the crop's UE too, by which
    cells_in_crops has left the rows: then they stay where they are."""
    keys = ("crop_id", *keys)
    rest = [c for c in found.columns if c not in keys]
    least = found.groupBy(*keys).agg(F.min_by(F.struct(*rest), "interpolated").alias("_row"))
    return least.select(*keys, "_row.*").select(*found.columns)


def crop_documents(found: DataFrame) -> DataFrame:
    """One row a crop with its campaign (that of the least cell), UE and base stations as an array, cells in order."""
    found = geo.crop_position(found, "cell_lat", "cell_lon", "center_lat", "center_lon", "half", "bs_y", "bs_x")
    found = geo.crop_position(found, "latitude", "longitude", "center_lat", "center_lon", "half", "ue_y", "ue_x")
    metrics = F.struct("rssi", "nsinr", "nrsrp", "nrsrq")
    station = F.struct("enode", "mnc", "npci", "cell_lat", "cell_lon", "bs_y", "bs_x", metrics.alias("measurements"), "interpolated")
    return found.groupBy("crop_id", "latitude", "longitude", "center_lat", "center_lon", "half").agg(
        F.min_by("campaign_id", F.struct("enode", "mnc", "npci")).alias("campaign_id"),
        F.first("ue_y").alias("ue_y"),
        F.first("ue_x").alias("ue_x"),
        F.array_sort(F.collect_list(station)).alias("base_stations"),
    )


def to_documents(crops: DataFrame) -> DataFrame:
    """Rows of crop_documents as nested documents (tables.DOCUMENT)."""
    at = lambda a, b: F.array(F.col(a).cast("double"), F.col(b).cast("double"))
    metrics = {"RSSI": "rssi", "NSINR": "nsinr", "NRSRP": "nrsrp", "NRSRQ": "nrsrq"}
    no = lambda n: F.lit(None).cast("double").alias(n)

    def station(b: Column) -> Column:
        measured = F.struct(*(b["measurements"][c].cast("double").alias(n) for n, c in metrics.items()), no("ToA"), no("bs_power_dbm"))
        places = {"lat_lon": ("cell_lat", "cell_lon"), "proj_map_pos": ("bs_y", "bs_x")}
        return F.struct(
            b["npci"].cast("int").alias("npci"), b["enode"].cast("long").alias("enode"), b["mnc"].cast("int").alias("mnc"),
            *(F.array(b[y], b[x]).alias(n) for n, (y, x) in places.items()), measured.alias("measurements"), b["interpolated"].alias("interpolated"),
        )

    return crops.select(
        F.col("campaign_id").cast("string").alias("campaign"),
        radio.ue_key(F.col("latitude"), F.col("longitude")).alias("ue_id"),
        F.col("crop_id").cast("string").alias("crop_id"),
        F.col("campaign_id").cast("int").alias("campaign_id"),
        F.struct(F.col("center_lat").alias("lat"), F.col("center_lon").alias("lon")).alias("center_coord"),
        F.col("half").cast("int").alias("half_square_size_meters"),
        F.struct(at("latitude", "longitude").alias("lat_lon"), at("ue_y", "ue_x").alias("proj_map_pos")).alias("UE"),
        F.transform("base_stations", station).alias("BaseStations"),
    )


def from_documents(documents: DataFrame) -> DataFrame:
    """One row a base station of nested documents: campaign, ue_id, crop_id, half, places, the station and its metrics."""
    each = documents.select("campaign", "ue_id", "crop_id", "half_square_size_meters", "center_coord", "UE", F.explode("BaseStations").alias("b"))
    pair = lambda c, a, b: [F.get(F.col(c), F.lit(i)).alias(n) for i, n in enumerate((a, b))]
    return each.select(
        "campaign", "ue_id", "crop_id", F.col("half_square_size_meters").alias("half"), F.col("center_coord.lat").alias("center_lat"), F.col("center_coord.lon").alias("center_lon"),
        *pair("UE.lat_lon", "latitude", "longitude"), *pair("UE.proj_map_pos", "ue_y", "ue_x"), "b.npci", "b.enode", "b.mnc",
        *pair("b.lat_lon", "cell_lat", "cell_lon"), *pair("b.proj_map_pos", "bs_y", "bs_x"), *(F.col(f"b.measurements.{c.upper()}").alias(c) for c in ("rssi", "nsinr", "nrsrp", "nrsrq")), "b.interpolated",
    )


def documents_index(documents: DataFrame) -> DataFrame:
    """campaign, ue_id, crop_id and the number of observed base stations of each document."""
    observed = F.size(F.filter("BaseStations", lambda b: ~F.coalesce(b["interpolated"], F.lit(False))))
    return documents.select("campaign", "ue_id", "crop_id", observed.cast("long").alias("num_bs"))


def crop_index(found: DataFrame, *more: str) -> DataFrame:
    """campaign_id, ue_id, crop_id, num_bs (observed only), num_bs_all, and `more` columns that a crop has one value of."""
    return found.groupBy("campaign_id", "ue_id", "crop_id", *more).agg(F.count_if(~F.col("interpolated")).alias("num_bs"), F.count(F.lit(1)).alias("num_bs_all"))


def index_map(index: DataFrame, count: str = "num_bs") -> DataFrame:
    """ue_id and, for export, a JSON document of one nested map campaign -> ue -> crop -> count: a document a UE, as
    a campaign's map would be one value of any size."""
    entry = F.struct(F.col("crop_id").cast("string"), F.col(count).cast("int"))
    per_ue = index.groupBy("campaign_id", "ue_id").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("crops"))
    return per_ue.select("campaign_id", "ue_id", F.to_json(F.create_map(F.col("campaign_id").cast("string"), F.create_map("ue_id", "crops"))).alias("document"))
