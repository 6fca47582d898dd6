"""Pairs of devices and base stations, and link metrics of propagation paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import draws, geo, radio
from . import numbering


def uniform_points(spark: SparkSession, n: int, bounds: tuple[float, float, float, float], seed: int, name: str) -> DataFrame:
    """n points uniform in (min_lat, max_lat, min_lon, max_lon)."""
    lo_lat, hi_lat, lo_lon, hi_lon = bounds
    at = lambda lo, hi, tag: F.lit(lo) + (hi - lo) * draws.uniform(seed, F.lit(tag), "id")
    return spark.range(n).select(F.col("id").alias(f"{name}_idx"), at(lo_lat, hi_lat, "lat").alias(f"{name}_lat"), at(lo_lon, hi_lon, "lon").alias(f"{name}_lon"))


def drawn_near(rows: DataFrame, key: str, lat: str, lon: str, n: int, spread: float, seed: int) -> DataFrame:
    """n points uniform in the box of `spread` degrees around each row's place, drawn by its key."""
    u = lambda tag: draws.uniform(seed, F.lit(tag), key, "j")
    out = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return out.withColumns({"ue_lat": F.col(lat) + spread * (2.0 * u("lat") - 1.0), "ue_lon": F.col(lon) + spread * (2.0 * u("lon") - 1.0)})


def around_stations(stations: DataFrame, n: int, n_stations: int, radius: float, seed: int, area_uniform: bool = False) -> DataFrame:
    """n devices shared evenly among stations numbered in bs_no from 0; the first ones get the remainder. The
    radius is drawn linearly, or uniformly by area."""
    share = F.lit(n // n_stations) + F.when(F.col("bs_no") < n % n_stations, 1).otherwise(0)
    out = stations.withColumn("_k", share).filter("_k > 0").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("_k") - 1))).drop("_k")
    u = draws.uniform(seed, F.lit("r"), "bs_no", "j")
    distance = radius * (F.sqrt(u) if area_uniform else u)
    lat, lon = geo.polar(F.col("bs_lat"), F.col("bs_lon"), distance, 2 * F.pi() * draws.uniform(seed, F.lit("a"), "bs_no", "j"))
    return out.withColumns({"ue_lat": lat, "ue_lon": lon})


def patch_stations(patches: DataFrame, k: int, seed: int) -> DataFrame:
    """k base stations a patch: place, altitude of 20 to 60 m, azimuth."""
    out = patches.withColumn("bs_idx", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    u = lambda tag: draws.uniform(seed, F.lit(tag), "patch_idx", "bs_idx")
    along = lambda lo, hi, tag: F.col(lo) + (F.col(hi) - F.col(lo)) * u(tag)
    return out.withColumns({"bs_lat": along("min_lat", "max_lat", "lat"), "bs_lon": along("min_lon", "max_lon", "lon"), "bs_alt": 20 + 40 * u("alt"), "bs_azimuth": 360 * u("azimuth")})


def _measured(pairs: DataFrame) -> DataFrame:
    distance, bearing = geo.flat_offset(F.col("bs_lat"), F.col("bs_lon"), F.col("ue_lat"), F.col("ue_lon"))
    return pairs.withColumns({"distance_m": distance, "bearing_rad": bearing})


def pairs_by_key(ues: DataFrame, stations: DataFrame, key: str) -> DataFrame:
    """Every device with every station of the same key (a patch or region), with distance and bearing."""
    return _measured(ues.join(stations, key))


#: Rows of the smaller side that go to every task as one array; more of them join in blocks of as many.
BLOCK = 2000
_SALTS = 64


def every_pair(left: DataFrame, right: DataFrame, block: int = BLOCK) -> DataFrame:
    """Every row of left with every row of right, which is the smaller side. Up to `block` rows of it are broadcast.
    More are cut into blocks; a row of left then meets each block by an equi-join on block and salt."""
    n = right.count()
    rows = F.collect_list(F.struct(*right.columns)).alias("_all")
    if n <= block:
        one = right.agg(rows).withColumn("_k", F.lit(0))
        return left.withColumn("_k", F.lit(0)).join(F.broadcast(one), "_k").select(*left.columns, F.inline("_all"))
    blocks = -(-n // block)
    dealt = right.withColumn("_block", F.pmod(F.xxhash64(*right.columns), F.lit(blocks)))
    packed = dealt.groupBy("_block").agg(rows).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.lit(_SALTS)).cast("int")).withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    return salted.join(packed, ["_block", "_salt"]).select(*left.columns, F.inline("_all"))


def all_pairs(ues: DataFrame, stations: DataFrame) -> DataFrame:
    """Every device with every station of a scene, with distance and bearing."""
    return _measured(every_pair(ues, stations))


def pair_profile(pairs: DataFrame) -> DataFrame:
    """n_ues, n_bs, n_pairs and the largest spread of one device's coordinates."""
    spread = F.greatest(F.max("ue_lat") - F.min("ue_lat"), F.max("ue_lon") - F.min("ue_lon"))
    per_ue = pairs.groupBy("ue_idx").agg(F.count(F.lit(1)).alias("n"), spread.alias("spread"))
    a = per_ue.agg(F.count(F.lit(1)).alias("n_ues"), F.sum("n").alias("n_pairs"), F.max("spread").alias("max_spread"))
    b = pairs.agg(F.count_distinct("bs_idx").alias("n_bs"))
    return a.withColumn("_k", F.lit(0)).join(b.withColumn("_k", F.lit(0)), "_k").drop("_k")


def chunks(pairs: DataFrame, group: str, order: str, size: int) -> DataFrame:
    """Chunk numbers of `size` rows a group, in order; group and order are unique together."""
    return numbering.within(pairs, "_in", [group], order).withColumn("chunk", F.floor(F.col("_in") / size).cast("long")).drop("_in")


#: Columns of a final simulated row and their types.
FINAL_ROW = {"bs_idx": "int", "ue_id": "int", **dict.fromkeys(("bs_lat", "bs_lon", "bs_alt", "bs_azimuth", "ue_lat", "ue_lon", "distance_m", "bearing_rad", "sim_rssi", "sim_nsinr", "sim_nrsrp", "sim_nrsrq"), "double")}


def final_rows(results: DataFrame) -> DataFrame:
    """The columns of the final simulated table in their types. Rows with a value that has no such type are left out;
    saved_share counts them."""
    typed = results.select(*(F.col(c).try_cast(t).alias(c) for c, t in FINAL_ROW.items()))
    return typed.na.drop("any", subset=["bs_idx", "ue_id"])


def verified(rows: DataFrame) -> DataFrame:
    """What a table read back holds: n_rows, n_ues and n_bs."""
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("ue_id").alias("n_ues"), F.count_distinct("bs_idx").alias("n_bs"))


def link_metrics(paths: DataFrame, tx_dbm: float = 0.0) -> DataFrame:
    """paths rx, tx, re, im: path gain and metrics of each link."""
    gain = paths.groupBy("rx", "tx").agg(F.sum(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("gain"))
    return gain.withColumns(radio.link_metrics(F.col("gain"), tx_dbm))


def results_onto_pairs(pairs: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    return pairs.join(results, keys)


def saved_share(rows: DataFrame, ok: str) -> DataFrame:
    saved, failed = F.count_if(F.col(ok)), F.count_if(~F.coalesce(F.col(ok), F.lit(False)))
    return rows.agg(saved.alias("saved"), failed.alias("failed"), F.try_divide(100.0 * saved, F.count(F.lit(1))).alias("percent"))
