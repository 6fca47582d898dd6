"""Queries that write a table in the shared folder and read it back."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import crops, evaluate, links, measurements
from ..sources import tables
from ..staging import place
from . import oracle_geo as og
from .crop_queries import _BASE, _INDEX, _ROW, _index, _placed, _staged
from .fixtures import cte, view
from .link_queries import ORACLES as LINK_ORACLES
from .link_queries import patch_pairs
from .sample_queries import ORACLES as SAMPLE_ORACLES

QUERIES: dict = {}
ORACLES: dict = {}


def _register(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


@_register("cleaned_table", f"{_BASE} SELECT {_ROW}, cell_lat, cell_lon FROM placed")
def cleaned_table(spark: SparkSession, d: str) -> DataFrame:
    path = place(spark, "cleaned")
    tables.write_measurements(_placed(spark, d), path)
    back = tables.read_measurements(spark, path).withColumn("campaign_id", F.col("campaign_id").cast("long"))
    return back.select(*_ROW.split(", "), "cell_lat", "cell_lon")


@_register("index_export", f"{_INDEX} SELECT 0 AS dataset_idx, CAST(campaign_id AS VARCHAR) AS campaign_id, ue_id, CAST(crop_id AS VARCHAR) AS crop_id, CAST(num_bs AS INTEGER) AS num_bs FROM ix")
def index_export(spark: SparkSession, d: str) -> DataFrame:
    path = place(spark, "index")
    tables.write_index(crops.index_map(_index(_staged(spark, d))), path)
    return tables.read_index(spark, [path], lines=True)


@_register("prediction_table", SAMPLE_ORACLES["localisation_error"].replace("SELECT vec_id, CAST(pred_y", "SELECT vec_id AS crop_id, CAST(pred_y"))
def prediction_table(spark: SparkSession, d: str) -> DataFrame:
    path = place(spark, "predictions")
    made = view(spark, d, "predictions").withColumnsRenamed({"vec_id": "crop_id"}).withColumns({"domain": F.lit("target"), "difficulty": F.col("difficulty").cast("string")})
    tables.write_predictions(made, path)
    out = evaluate.errors(tables.read_predictions(spark, path), 8)
    return out.select("crop_id", "pred_y", "pred_x", F.round("error_m", 6).alias("error_m"))


_PAIRS = LINK_ORACLES["patch_pairs"].replace("SELECT patch_idx, ue_idx, bs_idx, round(bs_alt, 5) AS bs_alt, ", "SELECT patch_idx, ue_idx, bs_idx, ")
_AT = _PAIRS.rindex("SELECT patch_idx, ue_idx, bs_idx")


@_register("pair_table", f"{_PAIRS[:_AT]}SELECT count(*) AS n_rows, count(DISTINCT ue_idx) AS n_ues, count(DISTINCT bs_idx) AS n_bs FROM ({_PAIRS[_AT:]})")
def pair_table(spark: SparkSession, d: str) -> DataFrame:
    """Pairs by patch, written, some patches written again after a failure, read back and counted."""
    path = place(spark, "pairs")
    pairs = patch_pairs(spark, d).withColumnRenamed("ue_idx", "ue_id")
    tables.write_patch_results(pairs, path)
    tables.write_patch_results(pairs.filter("patch_idx < 3"), path)
    return links.verified(tables.read_pairs(spark, path))


_RESULT = """SELECT bs_idx, CASE WHEN row_id % 17 = 0 THEN concat('x', ue_idx) ELSE concat('', ue_idx) END AS ue_id, BSLatitude AS bs_lat, BSLongitude AS bs_lon, CAST(20 + bs_idx AS {string}) AS bs_alt, 15 * bs_idx AS bs_azimuth,
  UELatitude AS ue_lat, UELongitude AS ue_lon, RSSI AS real_rssi, sim_rssi, sim_rssi + 90e0 AS sim_nsinr, sim_rssi - 20e0 AS sim_nrsrp, -10e0 AS sim_nrsrq"""


@_register("final_rows", f"""WITH {cte('links')}, r AS ({_RESULT.format(string='VARCHAR')}, (UELatitude - BSLatitude) * 111000e0 AS n_, (UELongitude - BSLongitude) * 111000e0 * cos(radians(BSLatitude)) AS e_ FROM links)
SELECT CAST(bs_idx AS INTEGER) AS bs_idx, CAST(ue_id AS INTEGER) AS ue_id, bs_lat, bs_lon, CAST(bs_alt AS DOUBLE) AS bs_alt, CAST(bs_azimuth AS DOUBLE) AS bs_azimuth, ue_lat, ue_lon, round(sqrt(n_ * n_ + e_ * e_), 4) AS distance_m, round(atan2(e_, n_), 7) AS bearing_rad, sim_rssi, sim_nsinr, sim_nrsrp, sim_nrsrq
FROM r WHERE TRY_CAST(ue_id AS INTEGER) IS NOT NULL""")
def final_rows(spark: SparkSession, d: str) -> DataFrame:
    raw = spark.sql(f"{_RESULT.format(string='STRING')} FROM {{links}}", links=view(spark, d, "links"))
    distance, bearing = geo.flat_offset(*map(F.col, ("bs_lat", "bs_lon", "ue_lat", "ue_lon")))
    out = links.final_rows(raw.withColumns({"distance_m": distance, "bearing_rad": bearing}))
    return out.withColumns({"distance_m": F.round("distance_m", 4), "bearing_rad": F.round("bearing_rad", 7)})


@_register("layer_table", f"WITH {cte('buildings')} SELECT feature_id, 4 AS corners, height, levels, kind, round(min_lat, 9) AS lat, round(max_lon, 9) AS lon FROM buildings")
def layer_table(spark: SparkSession, d: str) -> DataFrame:
    """A building layer made from its source once and then read from where it is kept."""
    at = lambda lat, lon: F.struct(F.col(lat).alias("lat"), F.col(lon).alias("lon"))
    shape = F.array(at("min_lat", "min_lon"), at("min_lat", "max_lon"), at("max_lat", "max_lon"), at("max_lat", "min_lon"))
    source = view(spark, d, "buildings").select("feature_id", shape.alias("shape"), F.slice(F.array(shape), 1, 0).alias("holes"), "height", "levels", "kind")
    path = place(spark, "layer")
    tables.read_layer(spark, path, source)
    kept = tables.read_layer(spark, path)
    return kept.select("feature_id", F.size("shape").alias("corners"), "height", "levels", "kind", F.round(F.col("shape")[0]["lat"], 9).alias("lat"), F.round(F.col("shape")[1]["lon"], 9).alias("lon"))


@_register("whole_ids", f"WITH {cte('measurements')} SELECT latitude, longitude, campaign_id, enode, npci, CASE WHEN mnc = 88 THEN 0 ELSE mnc END AS mnc, l_linenumber AS line FROM measurements")
def whole_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids that come as fractions, operators without a number as null."""
    m = view(spark, d, "measurements").withColumn("operator_id", F.when(F.col("mnc") != 88, F.col("mnc").cast("double")))
    raw = m.withColumns({c: F.col(c).cast("double") for c in ("npci", "enode", "campaign_id")}).drop("mnc")
    return measurements.normalise_ids(raw).select("latitude", "longitude", "campaign_id", "enode", "npci", "mnc", F.col("l_linenumber").alias("line"))


_NORMAL = NormalDist(300, 100)
_SHARE = f"({_NORMAL.cdf(150)!r} + {_NORMAL.cdf(500) - _NORMAL.cdf(150)!r} * {og.uniform(42, 'crop_id')})"


@_register("crop_sizes", f"WITH c AS (SELECT o_orderkey AS crop_id FROM orders) SELECT crop_id, CAST(trunc(least(greatest(300e0 + 100e0 * ({og.normal_quantile('share')}), 150e0), 500e0)) AS INTEGER) AS half FROM (SELECT *, {_SHARE} AS share FROM c)")
def crop_sizes(spark: SparkSession, d: str) -> DataFrame:
    made = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("crop_id"))
    return crops.half_sizes(made, 300, 100, 150, 500, 42)
