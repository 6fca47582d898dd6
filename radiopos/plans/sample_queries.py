"""Queries on samples, rasters, predictions and their scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import draws, radio
from ..operators import crops, evaluate, measurements, raster, samples, scoring
from ..staging import stage
from . import oracle_geo as og
from .crop_queries import _BASE, _IN, _JIT, METRICS, _deduplicated, _found, _staged
from .fixtures import cte, view

QUERIES: dict = {}
ORACLES: dict = {}
MEANS, SCALES = ({k: t[k] for k in ("rssi", "nsinr")} for t in (radio.FEATURE_MEANS, radio.FEATURE_SCALES))
EDGES = (200.0, 400.0, 800.0, 1200.0, 1600.0)


def _register(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


# sequences: the stations measured at a place play a crop's


def _stations(spark: SparkSession, d: str) -> DataFrame:
    m = _deduplicated(spark, d).withColumn("crop_id", radio.ue_key(F.col("latitude"), F.col("longitude")))
    return m.withColumn("bs_order", F.col("enode"))


_ST = f"{_BASE}, st AS (SELECT *, replace(printf('%.6f_%.6f', latitude, longitude), '.', 'p') AS crop_id FROM dedup)"
_CAP = "cap AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY crop_id ORDER BY enode) AS INTEGER) AS bs_no FROM st) WHERE bs_no <= 3 AND NOT interpolated)"


@_register("bs_sequence", f"{_ST}, {_CAP} SELECT crop_id, bs_no, enode, (coalesce(rssi, 0e0) + 64e0) / 57e0 AS z_rssi, (coalesce(nsinr, 0e0) + 5e0) / 94e0 AS z_nsinr FROM cap")
def bs_sequence(spark: SparkSession, d: str) -> DataFrame:
    capped = samples.capped(_stations(spark, d), 3)
    return samples.station_features(capped, MEANS, SCALES).select("crop_id", "bs_no", "enode", "z_rssi", "z_nsinr")


@_register("pad_sequence", f"""{_ST}, {_CAP}, s AS (SELECT crop_id, list([(coalesce(rssi, 0e0) + 64e0) / 57e0, (coalesce(nsinr, 0e0) + 5e0) / 94e0] ORDER BY bs_no) AS v FROM cap GROUP BY crop_id), b AS (SELECT *, substr(crop_id, 1, 6) AS batch FROM s)
SELECT crop_id, batch, CAST(len(v) AS INTEGER) AS length, CAST(max(len(v)) OVER (PARTITION BY batch) AS INTEGER) AS padded, round(list_sum(flatten(v)), 6) + 0e0 AS total FROM b""")
def pad_sequence(spark: SparkSession, d: str) -> DataFrame:
    capped = samples.station_features(samples.capped(_stations(spark, d), 3), MEANS, SCALES)
    rows = samples.sequences(capped, ["z_rssi", "z_nsinr"]).withColumn("batch", F.substring("crop_id", 1, 6))
    total = F.aggregate(F.flatten("sequence"), F.lit(0.0), lambda s, x: s + x)
    return samples.padded(rows, "batch", 2).select("crop_id", "batch", "length", F.size("sequence").alias("padded"), (F.round(total, 6) + 0.0).alias("total"))


@_register("random_sequence", f"""{_ST}, n AS (SELECT *, count(*) OVER (PARTITION BY crop_id) AS n, row_number() OVER (PARTITION BY crop_id ORDER BY {og.md5_key(6, 'crop_id', 'enode')}) AS bs_no FROM st)
SELECT crop_id, enode FROM n WHERE NOT interpolated AND bs_no <= least(least(n, 3), 1 + CAST(floor({og.uniform(7, 'crop_id')} * greatest(least(n, 3), 1)) AS BIGINT))""")
def random_sequence(spark: SparkSession, d: str) -> DataFrame:
    return samples.capped(_stations(spark, d), 3, seed=6).select("crop_id", "enode")


@_register("power_dropout", f"{_ST}, {_CAP} SELECT crop_id, bs_no, CASE WHEN {og.uniform(8, 'crop_id', 'bs_no')} < 0.3e0 THEN 0e0 ELSE nrsrp END AS bs_power_dbm FROM cap")
def power_dropout(spark: SparkSession, d: str) -> DataFrame:
    capped = samples.capped(_stations(spark, d), 3).withColumn("bs_power_dbm", F.col("nrsrp"))
    return samples.power_dropped(capped, 0.3, 8).select("crop_id", "bs_no", "bs_power_dbm")


@_register("domain_pairs", f"""WITH s AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS no FROM customer), t AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS target_no FROM supplier)
SELECT c_custkey, s_suppkey FROM (SELECT *, CAST(floor({og.uniform(1, 'no')} * (SELECT count(*) FROM supplier)) AS BIGINT) AS target_no FROM s) JOIN t USING (target_no)""")
def domain_pairs(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.calibrate import appearance_index

    read = lambda t, k: appearance_index(spark.read.parquet(f"{d}/{t}.parquet").select(k), k, k, "no").select(k, "no")
    source, target = read("customer", "c_custkey"), read("supplier", "s_suppkey")
    return samples.paired(source, target, target.count(), 1).select("c_custkey", "s_suppkey")


@_register("epoch_sample", f"""WITH c AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS no FROM (SELECT DISTINCT o_orderkey FROM orders)), n AS (SELECT count(*) AS n FROM c)
SELECT range AS draw, o_orderkey FROM (SELECT range, CAST(floor({og.uniform(2, '0', 'range')} * (SELECT n FROM n)) AS BIGINT) AS no FROM range((SELECT n // 2 FROM n))) JOIN c USING (no)""")
def epoch_sample(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.calibrate import appearance_index

    crops = appearance_index(spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey"), "o_orderkey", "o_orderkey", "no")
    n = crops.count()
    return samples.epoch_sample(crops, n // 2, n, 0, 2).select("draw", "o_orderkey")


@_register("campaign_subsample", f"""WITH {cte('measurements')}, k AS (SELECT DISTINCT campaign_id, replace(printf('%.6f_%.6f', latitude, longitude), '.', 'p') AS ue_id FROM measurements),
r AS (SELECT *, row_number() OVER (PARTITION BY campaign_id ORDER BY {og.md5_key(3, 'ue_id')}, ue_id) AS r, count(*) OVER (PARTITION BY campaign_id) AS n FROM k) SELECT campaign_id, ue_id FROM r WHERE campaign_id <> 0 OR r <= floor(n * 0.25e0)""")
def campaign_subsample(spark: SparkSession, d: str) -> DataFrame:
    m = view(spark, d, "measurements")
    keys = m.select("campaign_id", radio.ue_key(F.col("latitude"), F.col("longitude")).alias("ue_id")).distinct()
    return samples.subsampled(keys, 0, 0.25, 3)


@_register("display_sample", f"WITH {cte('predictions')} SELECT vec_id FROM predictions ORDER BY {og.md5_key(4, 'vec_id')} LIMIT 100")
def display_sample(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.display_sample(view(spark, d, "predictions").select("vec_id"), 100, draws.key(4, "vec_id"))


@_register("env_split", """WITH e AS (SELECT o_custkey AS env, row_number() OVER (ORDER BY o_custkey) AS pos FROM (SELECT DISTINCT o_custkey FROM orders)), n AS (SELECT count(*) AS n FROM e),
second AS (SELECT DISTINCT o_custkey AS env FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT env, 'test' AS part FROM e, n WHERE pos > n * 0.9e0 AND env NOT IN (SELECT env FROM second) UNION SELECT env, 'train' FROM e, n WHERE pos <= n * 0.9e0 UNION SELECT env, 'train' FROM second""")
def env_split(spark: SparkSession, d: str) -> DataFrame:
    orders = spark.read.parquet(f"{d}/orders.parquet").withColumnRenamed("o_custkey", "env")
    second = orders.filter("o_orderpriority = '1-URGENT'").select("env").distinct()
    return samples.environment_split(orders, "env", second, 0.9)


# rasters


def _stamped(spark: SparkSession, d: str) -> DataFrame:
    s = spark.read.parquet(f"{d}/lineitem.parquet")
    px = lambda c, n: (F.col(c) % n).cast("int")
    return s.groupBy(F.col("l_suppkey").alias("crop_id"), F.col("l_linenumber").alias("bs_no")).agg(F.min("l_partkey").alias("k"), F.min("l_quantity").alias("rssi")).withColumns({"py": px("k", 97), "px": px("k", 89)})


_STAMPED = "s AS (SELECT l_suppkey AS crop_id, l_linenumber AS bs_no, min(l_quantity) AS rssi, min(l_partkey) % 97 AS py, min(l_partkey) % 89 AS px FROM lineitem GROUP BY ALL)"


@_register("bs_stamps", f"WITH {_STAMPED}, p AS (SELECT crop_id, bs_no, rssi, CAST(py + a AS INTEGER) AS y, CAST(px + b AS INTEGER) AS x FROM s, range(-3, 3) AS v(a), range(-3, 3) AS w(b)) SELECT crop_id, y, x, arg_max(rssi, bs_no) AS value FROM p WHERE y >= 0 AND x >= 0 GROUP BY crop_id, y, x")
def bs_stamps(spark: SparkSession, d: str) -> DataFrame:
    return samples.stamps(_stamped(spark, d), "rssi")


_mirror = lambda at, c: "(" + " + ".join(f"CASE WHEN abs({e}) <= 12 THEN exp(-({e}) * ({e}) / 18e0) ELSE 0e0 END" for e in (f"({at} - {c})", f"(-1 - {at} - {c})", f"(191 - {at} - {c})")) + ")"


@_register("target_heatmap", f"WITH {_STAMPED}, o AS (SELECT crop_id, CAST(py % 96 AS INTEGER) AS py, CAST(px AS INTEGER) AS px FROM s WHERE bs_no = 1), p AS (SELECT crop_id, py, px, CAST(py + a AS INTEGER) AS y, CAST(px + b AS INTEGER) AS x FROM o, range(-12, 13) AS v(a), range(-12, 13) AS w(b)), r AS (SELECT *, {_mirror('y', 'py')} * {_mirror('x', 'px')} AS raw FROM p WHERE y BETWEEN 0 AND 95 AND x BETWEEN 0 AND 95) SELECT crop_id, y, x, round(raw / max(raw) OVER (PARTITION BY crop_id), 9) AS value FROM r")
def target_heatmap(spark: SparkSession, d: str) -> DataFrame:
    ues = _stamped(spark, d).filter("bs_no = 1").select("crop_id", (F.col("py") % 96).alias("py"), "px")
    return samples.target_heatmap(ues, 96).withColumn("value", F.round("value", 9))


@_register("raster_downsample", f"""WITH {_STAMPED}, p AS (SELECT crop_id, CAST(py AS INTEGER) AS y, CAST(px AS INTEGER) AS x, max(rssi) AS value FROM s GROUP BY ALL),
e AS (SELECT crop_id, ty, tx, value * greatest(least((y + 1) * 40e0 / 101e0, ty + 1e0) - greatest(y * 40e0 / 101e0, ty), 0e0) * greatest(least((x + 1) * 40e0 / 101e0, tx + 1e0) - greatest(x * 40e0 / 101e0, tx), 0e0) AS w FROM p, range(0, 40) AS v(ty), range(0, 40) AS q(tx) WHERE ty BETWEEN floor(y * 40e0 / 101e0) AND ceil((y + 1) * 40e0 / 101e0) AND tx BETWEEN floor(x * 40e0 / 101e0) AND ceil((x + 1) * 40e0 / 101e0))
SELECT crop_id, CAST(ty AS BIGINT) AS ty, CAST(tx AS BIGINT) AS tx, round(sum(w), 6) AS value FROM e GROUP BY crop_id, ty, tx HAVING round(sum(w), 6) <> 0""")
def raster_downsample(spark: SparkSession, d: str) -> DataFrame:
    pixels = _stamped(spark, d).groupBy("crop_id", F.col("py").alias("y"), F.col("px").alias("x")).agg(F.max("rssi").alias("value"))
    sides = pixels.select("crop_id").distinct().withColumn("side", F.lit(101))
    out = raster.downsampled(pixels, sides, 40)
    return out.withColumn("value", F.round("value", 6)).filter("value != 0").withColumns({c: F.col(c).cast("long") for c in ("ty", "tx")})


@_register("building_raster", f"WITH {cte('buildings')} SELECT feature_id % 50 AS crop_id, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x FROM (SELECT feature_id, size, feature_id % 60 AS y0, feature_id % 70 AS x0 FROM buildings) b, range(0, 121) AS v(y), range(0, 121) AS w(x) WHERE y >= y0 AND y < y0 + size AND x >= x0 AND x < x0 + size GROUP BY ALL")
def building_raster(spark: SparkSession, d: str) -> DataFrame:
    b = view(spark, d, "buildings").select((F.col("feature_id") % 50).alias("crop_id"), F.lit(121).alias("side"), F.col("size").cast("double").alias("n"), (F.col("feature_id") % 60).cast("double").alias("y0"), (F.col("feature_id") % 70).cast("double").alias("x0"))
    at = lambda y, x: F.struct(y.alias("row"), x.alias("column"))
    y0, x0, n = F.col("y0"), F.col("x0"), F.col("n")
    ring = F.array(at(y0, x0), at(y0, x0 + n), at(y0 + n, x0 + n), at(y0 + n, x0))
    return raster.building_pixels(b.withColumn("ring", ring))


_L_SHAPE = "y >= y0 AND y < y0 + size AND x >= x0 AND x < x0 + size AND NOT (y >= y0 + size / 2e0 AND x >= x0 + size / 2e0) AND NOT (y >= y0 + size / 8e0 AND y < y0 + size / 4e0 AND x >= x0 + size / 8e0 AND x < x0 + size / 4e0)"


@_register("courtyard_raster", f"WITH {cte('buildings')} SELECT feature_id % 50 AS crop_id, CAST(py AS BIGINT) AS y, CAST(px AS BIGINT) AS x FROM (SELECT feature_id, size, feature_id % 60 AS y0, feature_id % 70 AS x0 FROM buildings) b, (SELECT range AS py, range + 0.5e0 AS y FROM range(0, 121)) AS v, (SELECT range AS px, range + 0.5e0 AS x FROM range(0, 121)) AS w WHERE {_L_SHAPE} GROUP BY ALL")
def courtyard_raster(spark: SparkSession, d: str) -> DataFrame:
    """L-shaped buildings with a courtyard."""
    b = view(spark, d, "buildings").select((F.col("feature_id") % 50).alias("crop_id"), F.lit(121).alias("side"), F.col("size").cast("double").alias("n"), (F.col("feature_id") % 60).cast("double").alias("y0"), (F.col("feature_id") % 70).cast("double").alias("x0"))
    at = lambda y, x: F.struct((F.col("y0") + F.col("n") * y).alias("row"), (F.col("x0") + F.col("n") * x).alias("column"))
    ring = F.array(at(0.0, 0.0), at(0.0, 1.0), at(0.5, 1.0), at(0.5, 0.5), at(1.0, 0.5), at(1.0, 0.0))
    hole = F.array(at(0.125, 0.125), at(0.125, 0.25), at(0.25, 0.25), at(0.25, 0.125))
    return raster.building_pixels(b.withColumns({"ring": ring, "holes": F.array(hole)}))


_SEGMENTS = "SELECT p_partkey % 50 AS crop_id, CAST(p_partkey % 97 AS DOUBLE) AS y0, CAST(p_partkey % 89 AS DOUBLE) AS x0, p_partkey % 97 + p_size / 2e0 AS y1, p_partkey % 89 + CAST(p_partkey % 31 AS DOUBLE) AS x1"
_ALONG = "least(greatest(coalesce(((y - y0) * (y1 - y0) + (x - x0) * (x1 - x0)) / nullif((y1 - y0) * (y1 - y0) + (x1 - x0) * (x1 - x0), 0e0), 0e0), 0e0), 1e0)"


@_register("road_raster", f"WITH s AS ({_SEGMENTS} FROM part), g AS (SELECT *, {_ALONG} AS t FROM s, (SELECT range AS py, range + 0.5e0 AS y FROM range(0, 121)) AS v, (SELECT range AS px, range + 0.5e0 AS x FROM range(0, 121)) AS w WHERE y BETWEEN y0 - 2 AND y1 + 2 AND x BETWEEN x0 - 2 AND x1 + 2) SELECT crop_id, CAST(py AS BIGINT) AS y, CAST(px AS BIGINT) AS x FROM g WHERE sqrt(pow(y - y0 - t * (y1 - y0), 2) + pow(x - x0 - t * (x1 - x0), 2)) <= 2 GROUP BY ALL")
def road_raster(spark: SparkSession, d: str) -> DataFrame:
    segments = spark.sql(f"{_SEGMENTS} FROM parquet.`{d}/part.parquet`").withColumn("side", F.lit(121))
    return raster.road_pixels(segments)


_DOCS = f"""{_JIT}, found AS (SELECT * FROM jbox JOIN placed USING (latitude, longitude) WHERE {_IN}),
at_ AS (SELECT *, 300e0 - (pn - cn) AS bs_y, 300e0 + pe AS bs_x, 300e0 - (un - cn) AS ue_y, 300e0 + ue AS ue_x FROM {og.mercator(og.mercator(og.mercator('(SELECT * EXCLUDE (ue) FROM found)', 'cell_lat', 'cell_lon', 'center_lon', 1.0, 'pe', 'pn'), 'center_lat', 'center_lon', 'center_lon', 1.0, 'ce', 'cn'), 'latitude', 'longitude', 'center_lon', 1.0, 'ue', 'un')}),
cap AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY crop_id ORDER BY enode, mnc, npci) AS bs_no FROM at_) WHERE bs_no <= 3 AND NOT interpolated AND crop_id % 5 <> 0)"""


def _documents(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Crop documents, and the sides of their maps, a fifth of which are wrong."""
    made = crops.crop_documents(_found(_staged(spark, d, *METRICS)))
    docs = stage(made.drop("latitude", "longitude"), "crop-documents")
    side = F.when(F.col("crop_id") % 5 == 0, 600).otherwise(601)
    return docs, docs.select("crop_id", side.alias("rows"), F.lit(601).alias("columns"))


@_register("sample_table", f"""{_DOCS} SELECT crop_id, count(*) AS length, round(sum(bs_y) / 601e0, 6) + 0e0 AS y_sum, round(sum(bs_x) / 601e0, 6) + 0e0 AS x_sum, round(sum((coalesce(rssi, 0e0) + 64e0) / 57e0), 6) + 0e0 AS z_sum,
round(min(ue_y) / 601e0 * 224, 4) AS target_y, round(min(ue_x) / 601e0 * 224, 4) AS target_x, 224 / 601e0 AS scale FROM cap GROUP BY crop_id""")
def sample_table(spark: SparkSession, d: str) -> DataFrame:
    docs, maps = _documents(spark, d)
    rows = samples.assemble(samples.checked(docs, maps), 224, 3, {"rssi": MEANS["rssi"]}, {"rssi": SCALES["rssi"]})
    total = lambda i: F.round(F.aggregate("sequence", F.lit(0.0), lambda s, v: s + v[i]), 6) + 0.0
    places = (F.round(c, 4).alias(c) for c in ("target_y", "target_x"))
    return rows.select("crop_id", F.size("sequence").cast("long").alias("length"), total(0).alias("y_sum"), total(1).alias("x_sum"), total(2).alias("z_sum"), *places, "scale")


@_register("sample_inputs", f"""{_DOCS}, px AS (SELECT crop_id, bs_no, (coalesce(rssi, 0e0) + 64e0) / 57e0 AS z, CAST(trunc(bs_y / 601e0 * 224) AS INTEGER) + a AS y, CAST(trunc(bs_x / 601e0 * 224) AS INTEGER) + b AS x FROM cap, range(-3, 3) AS v(a), range(-3, 3) AS w(b)),
st AS (SELECT crop_id, y, x, arg_max(z, bs_no) AS z FROM px WHERE y BETWEEN 0 AND 223 AND x BETWEEN 0 AND 223 GROUP BY crop_id, y, x), g AS (SELECT DISTINCT crop_id, CAST(crop_id % 224 AS INTEGER) AS y, CAST(enode % 224 AS INTEGER) AS x FROM cap)
SELECT crop_id, count(*) AS n_pixels, count(z) AS n_stamped, round(sum(z), 5) + 0e0 AS z_sum FROM st FULL JOIN g USING (crop_id, y, x) GROUP BY crop_id""")
def sample_inputs(spark: SparkSession, d: str) -> DataFrame:
    """Input channels: a map with a pixel for each station, and the stations' stamps on it."""
    docs, maps = _documents(spark, d)
    stations = stage(samples.stations_on_map(samples.checked(docs, maps), 224, 3, {"rssi": MEANS["rssi"]}, {"rssi": SCALES["rssi"]}), "stations")
    kept = samples.checked(docs, maps).select("crop_id", F.posexplode("base_stations").alias("no", "bs")).filter("no < 3 AND NOT bs.interpolated")
    ground = kept.select("crop_id", (F.col("crop_id") % 224).cast("int").alias("y"), (F.col("bs.enode") % 224).cast("int").alias("x")).distinct().withColumn("value", F.lit(255.0))
    out = samples.input_pixels(ground, stations, "z_rssi", 224)
    return out.groupBy("crop_id").agg(F.count(F.lit(1)).alias("n_pixels"), F.count("third").alias("n_stamped"), (F.round(F.sum("third"), 5) + 0.0).alias("z_sum"))


# predictions


_ARG = "list_position(heatmap, list_max(heatmap)) - 1"
_PRED = f"WITH {cte('predictions')}, e AS (SELECT *, ({_ARG}) // 8 AS pred_y, ({_ARG}) % 8 AS pred_x FROM predictions), s AS (SELECT *, sqrt(pow(pred_y - ue_y, 2) + pow(pred_x - ue_x, 2)) * original_img_size / 8e0 AS error_m FROM e)"


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.errors(view(spark, d, "predictions"), 8)


@_register("localisation_error", f"{_PRED} SELECT vec_id, CAST(pred_y AS BIGINT) AS pred_y, CAST(pred_x AS BIGINT) AS pred_x, round(error_m, 6) AS error_m FROM s")
def localisation_error(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("vec_id", "pred_y", "pred_x", F.round("error_m", 6).alias("error_m"))


@_register("score_summary", f"{_PRED} SELECT difficulty, count(*) AS n, round(avg(error_m), 6) AS mean_error_m, round(sqrt(avg(error_m * error_m)), 6) AS rmse_m FROM s GROUP BY ROLLUP (difficulty)")
def score_summary(spark: SparkSession, d: str) -> DataFrame:
    out = evaluate.summary(_scored(spark, d), "difficulty")
    return out.select("difficulty", "n", F.round("mean_error_m", 6).alias("mean_error_m"), F.round("rmse_m", 6).alias("rmse_m"))


@_register("accuracy_curve", f"{_PRED} SELECT difficulty, tolerance, round(avg(CASE WHEN error_m < tolerance THEN 1e0 ELSE 0e0 END), 9) AS accuracy FROM s, (VALUES (1e0), (5e0), (10e0), (20e0), (30e0), (40e0), (50e0)) AS v(tolerance) GROUP BY difficulty, tolerance")
def accuracy_curve(spark: SparkSession, d: str) -> DataFrame:
    out = evaluate.accuracy(_scored(spark, d), ["difficulty"])
    return out.select("difficulty", "tolerance", F.round("accuracy", 9).alias("accuracy"))


@_register("size_bins", f"{_PRED}, b AS (SELECT * FROM (VALUES (200e0, 400e0), (400e0, 800e0), (800e0, 1200e0), (1200e0, 1600e0)) AS v(bin_start, bin_end)) SELECT bin_start, bin_end, count(error_m) AS n, round(avg(error_m), 6) AS mean_error_m FROM b LEFT JOIN s ON original_img_size >= bin_start AND (original_img_size < bin_end OR bin_end = 1600e0 AND original_img_size = 1600e0) GROUP BY bin_start, bin_end")
def size_bins(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.size_bins(_scored(spark, d), EDGES).withColumn("mean_error_m", F.round("mean_error_m", 6))


@_register("reconstruct_latlon", f"""{_PRED}, r AS (SELECT *, {og.north('center_lat', 'original_img_size / 2 - pred_y * original_img_size / 8e0')} AS pred_lat FROM s)
SELECT vec_id, round(pred_lat, 7) AS pred_lat, round({og.east('pred_lat', 'center_lon', 'pred_x * original_img_size / 8e0 - original_img_size / 2')}, 7) AS pred_lon FROM r""")
def reconstruct_latlon(spark: SparkSession, d: str) -> DataFrame:
    truth = _scored(spark, d).withColumns({"ue_lat": F.col("center_lat"), "ue_lon": F.col("center_lon")})
    out = evaluate.reconstructed(truth, 8)
    return out.select("vec_id", F.round("pred_lat", 7).alias("pred_lat"), F.round("pred_lon", 7).alias("pred_lon"))


@_register("reconstruct_distance", f"""{_PRED}, r AS (SELECT *, {og.north('center_lat', 'original_img_size / 2 - pred_y * original_img_size / 8e0')} AS pred_lat FROM s),
q AS (SELECT *, {og.east('pred_lat', 'center_lon', 'pred_x * original_img_size / 8e0 - original_img_size / 2')} AS pred_lon FROM r) SELECT vec_id, round(distance_m, 4) AS distance_m FROM {og.geodesic('q', 'center_lat', 'center_lon', 'pred_lat', 'pred_lon', 'distance_m')}""")
def reconstruct_distance(spark: SparkSession, d: str) -> DataFrame:
    """The geodesic from the map's centre to the predicted place."""
    truth = _scored(spark, d).withColumns({"ue_lat": F.col("center_lat"), "ue_lon": F.col("center_lon")})
    return evaluate.reconstructed(truth, 8).select("vec_id", F.round("distance_m", 4).alias("distance_m"))


@_register("epoch_macro", f"WITH {cte('epoch_metrics')} SELECT loader, epoch, round(avg(metric), 9) AS macro, round(sum(metric * rows) / sum(rows), 9) AS weighted FROM epoch_metrics GROUP BY loader, epoch")
def epoch_macro(spark: SparkSession, d: str) -> DataFrame:
    out = evaluate.epoch_means(view(spark, d, "epoch_metrics"))
    return out.select("loader", "epoch", F.round("macro", 9).alias("macro"), F.round("weighted", 9).alias("weighted"))


@_register("domain_accuracy", "WITH l AS (SELECT user_id % 5 AS batch, (value - 50e0) / 20e0 AS z, CAST(event_id % 2 AS INTEGER) AS y FROM events) SELECT batch, round(avg(CASE WHEN (1e0 / (1e0 + exp(-z)) > 0.5e0) = (y = 1) THEN 1e0 ELSE 0e0 END), 9) AS accuracy, round(avg(greatest(z, 0e0) - z * y + ln(1e0 + exp(-abs(z)))), 9) AS bce FROM l GROUP BY batch")
def domain_accuracy(spark: SparkSession, d: str) -> DataFrame:
    events = spark.read.parquet(f"{d}/events.parquet")
    rows = events.select((F.col("user_id") % 5).alias("batch"), ((F.col("value") - 50.0) / 20.0).alias("logit"), (F.col("event_id") % 2).cast("int").alias("label"))
    out = evaluate.domain_scores(rows, "batch")
    return out.select("batch", F.round("accuracy", 9).alias("accuracy"), F.round("bce", 9).alias("bce"))


@_register("heatmap_losses", f"""WITH {cte('predictions')}, p AS (SELECT difficulty, CAST(unnest(heatmap) AS DOUBLE) AS z, unnest(list_transform(heatmap, lambda v, i: CASE WHEN i % 8 = 1 THEN 1e0 ELSE 0e0 END)) AS t FROM predictions)
SELECT difficulty, round(avg(greatest(z, 0e0) - z * t + ln(1e0 + exp(-abs(z)))), 8) AS bce, round(1 - (2 * sum(t / (1e0 + exp(-z))) + 1e0) / (sum(1e0 / (1e0 + exp(-z))) + sum(t) + 1e0), 8) AS dice FROM p GROUP BY difficulty""")
def heatmap_losses(spark: SparkSession, d: str) -> DataFrame:
    p = view(spark, d, "predictions").select("difficulty", F.transform("heatmap", lambda v: v.cast("double")).alias("logits"), F.transform("heatmap", lambda v, i: F.when(i % 8 == 0, 1.0).otherwise(0.0)).alias("target"))
    out = evaluate.heatmap_losses(p, "difficulty")
    return out.select("difficulty", F.round("bce", 8).alias("bce"), F.round("dice", 8).alias("dice"))


@_register("score_baseline", "SELECT vec_id AS crop_id, CAST(4 AS BIGINT) AS pred_y, CAST(4 AS BIGINT) AS pred_x FROM embeddings WHERE label IN (0, 1)")
def score_baseline(spark: SparkSession, d: str) -> DataFrame:
    s = view(spark, d, "predictions").select(F.col("vec_id").alias("crop_id"), F.col("difficulty").cast("string").alias("split"))
    found = scoring.score(s, scoring.center_predictor(8), ["0", "1"])
    y, x = radio.peak(F.col("heatmap"), 8)
    return found.select("crop_id", y.alias("pred_y"), x.alias("pred_x"))


@_register("fill_rssi", f"WITH {cte('measurements')} SELECT campaign_id, count(*) FILTER (WHERE rssi IS NULL) AS filled, round(avg(coalesce(rssi, -90e0)), 7) AS mean_rssi FROM measurements GROUP BY campaign_id")
def fill_rssi(spark: SparkSession, d: str) -> DataFrame:
    m = view(spark, d, "measurements")
    filled, missing = measurements.fill_rssi(m)
    means = filled.groupBy("campaign_id").agg(F.round(F.avg("rssi"), 7).alias("mean_rssi"))
    return m.groupBy("campaign_id").agg(missing.alias("filled")).join(means, "campaign_id")


