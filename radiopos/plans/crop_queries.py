"""Queries on measurements, crops and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, radio
from ..operators import crops, measurements, region, splits
from ..staging import stage
from . import oracle_geo as og
from .fixtures import BOX, TIE, cte, u, view

HALF = 300
TEST_BOX, VAL_BOX = (41.82, 41.823, 12.46, 12.464), (41.823, 41.826, 12.46, 12.464)
QUERIES: dict = {}
ORACLES: dict = {}


def _register(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def _deduplicated(spark: SparkSession, d: str) -> DataFrame:
    return measurements.deduplicate(measurements.drop_missing(view(spark, d, "measurements")), tie=TIE)


def _placed(spark: SparkSession, d: str) -> DataFrame:
    return measurements.attach_cells(_deduplicated(spark, d), view(spark, d, "cells"))


#: What crops and their index need of measurements; documents have METRICS too.
NEEDED, METRICS = (*measurements.MEASUREMENT_KEY, "campaign_id", "interpolated"), ("rssi", "nsinr", "nrsrp", "nrsrq")


def _staged(spark: SparkSession, d: str, *more: str) -> DataFrame:
    """_placed, written once: crops and their numbers read it several times. Columns: NEEDED, more and the cell's place."""
    m = measurements.drop_missing(view(spark, d, "measurements"))
    kept = list(dict.fromkeys((*NEEDED, *TIE, *more)))
    found = measurements.deduplicate(m.select(*kept), tie=TIE).select(*NEEDED, *more)
    return stage(measurements.attach_cells(found, view(spark, d, "cells").select(*measurements.CELL_KEY, "cell_lat", "cell_lon")), "placed-measurements")


_DEDUP = f"""dedup AS (SELECT * EXCLUDE (n_) FROM (SELECT *, row_number() OVER (PARTITION BY latitude, longitude, enode, mnc, npci
  ORDER BY interpolated, {", ".join(TIE)}) AS n_ FROM measurements WHERE rssi IS NOT NULL) WHERE n_ = 1)"""
_PLACED = _DEDUP + ",\nplaced AS (SELECT d.*, c.cell_lat, c.cell_lon FROM dedup d JOIN cells c USING (enode, mnc, npci) WHERE c.cell_lon IS NOT NULL AND c.cell_lon <> 0)"
_BASE = f"WITH {cte('measurements', 'cells')},\n{_PLACED}"
_ROW = "latitude, longitude, enode, mnc, npci, campaign_id, rssi, nsinr, nrsrp, nrsrq, interpolated"


@_register("measurement_dedup", f"WITH {cte('measurements')},\n{_DEDUP} SELECT {_ROW} FROM dedup")
def measurement_dedup(spark: SparkSession, d: str) -> DataFrame:
    return _deduplicated(spark, d).select(*_ROW.split(", "))


@_register("complete_measurements", f"WITH {cte('measurements')} SELECT {_ROW} FROM measurements WHERE rssi IS NOT NULL AND nsinr IS NOT NULL AND nrsrp IS NOT NULL AND nrsrq IS NOT NULL")
def complete_measurements(spark: SparkSession, d: str) -> DataFrame:
    return measurements.drop_missing(view(spark, d, "measurements").select(*_ROW.split(", ")))


@_register("cell_join", f"{_BASE} SELECT {_ROW}, cell_lat, cell_lon FROM placed")
def cell_join(spark: SparkSession, d: str) -> DataFrame:
    return _placed(spark, d).select(*_ROW.split(", "), "cell_lat", "cell_lon")


@_register("ue_positions", f"{_BASE} SELECT DISTINCT latitude, longitude FROM placed")
def ue_positions(spark: SparkSession, d: str) -> DataFrame:
    return measurements.ue_positions(_placed(spark, d))


@_register("campaign_profile", f"{_BASE} SELECT campaign_id, count(DISTINCT (latitude, longitude)) AS n_ues, count(*) AS n_rows FROM placed GROUP BY campaign_id")
def campaign_profile(spark: SparkSession, d: str) -> DataFrame:
    return measurements.campaign_profile(_placed(spark, d))


@_register("campaign_map", f"WITH {cte('measurements')} SELECT enode, list_sort(list(DISTINCT campaign_id)) AS matches FROM measurements GROUP BY enode")
def campaign_map(spark: SparkSession, d: str) -> DataFrame:
    return measurements.campaign_map(view(spark, d, "measurements"), "enode", "campaign_id")


_FLAT = ("npci", "enode", "rssi", "nsinr", "nrsrp", "nrsrq", "toa", "operator_id", "campaign_id")


@_register("flatten_measurements", f"""WITH {cte('measurements')} SELECT latitude, longitude, CAST(npci AS DOUBLE) AS npci, CAST(enode AS DOUBLE) AS enode, rssi, nsinr, nrsrp, nrsrq,
  CAST(l_linenumber AS DOUBLE) AS toa, CAST(mnc AS DOUBLE) AS operator_id, CAST(campaign_id AS DOUBLE) AS campaign_id, interpolated FROM measurements""")
def flatten_measurements(spark: SparkSession, d: str) -> DataFrame:
    m = view(spark, d, "measurements").withColumns({"toa": F.col("l_linenumber"), "operator_id": F.col("mnc")})

    def raw(flag: bool) -> DataFrame:
        row = F.array(*(F.col(c).cast("double") for c in _FLAT))
        return m.filter(F.col("interpolated") == flag).groupBy(F.col("latitude").alias("lat"), F.col("longitude").alias("lon")).agg(F.collect_list(row).alias("info"))

    return measurements.flatten_measurements(raw(False), raw(True))


@_register("passive_join", f"""WITH {cte('measurements')}, passive AS (SELECT DISTINCT latitude, longitude, enode, mnc, npci FROM measurements), {_DEDUP}
  SELECT p.latitude, p.longitude, p.enode, p.mnc, p.npci, m.rssi FROM passive p JOIN dedup m USING (latitude, longitude, enode, mnc, npci) WHERE m.rssi IS NOT NULL""")
def passive_join(spark: SparkSession, d: str) -> DataFrame:
    keys = list(measurements.MEASUREMENT_KEY)
    passive = view(spark, d, "measurements").select(*keys).distinct()
    return measurements.attach_passive(passive, _deduplicated(spark, d).select(*keys, "rssi"), keys, "rssi")


@_register("operator_labels", f"""WITH {cte('cells')} SELECT enode, CASE mnc WHEN 1 THEN '"Op"[1]' WHEN 10 THEN '"Op"[2]' WHEN 88 THEN '"Op"[3]' END AS label,
  TRY_CAST(nullif(regexp_extract('cell ' || enode || CASE WHEN enode % 5 = 0 THEN '' ELSE ' NPCI:' || npci END || ' x', 'NPCI:([0-9]+)', 1), '') AS INTEGER) AS number,
  'bs_' || enode || '_' || mnc AS plain FROM cells""")
def operator_labels(spark: SparkSession, d: str) -> DataFrame:
    c = view(spark, d, "cells")
    name = F.concat(F.lit("cell "), F.col("enode").cast("string"), F.when(F.col("enode") % 5 == 0, "").otherwise(F.concat(F.lit(" NPCI:"), F.col("npci").cast("string"))), F.lit(" x"))
    untidy = F.concat(F.lit("('bs' "), F.col("enode").cast("string"), F.lit("/"), F.col("mnc").cast("string"), F.lit(")"))
    return c.select("enode", radio.operator_label(F.col("mnc")).alias("label"), radio.cell_number(name).alias("number"), radio.plain_id(untidy).alias("plain"))


@_register("ue_keys", f"""WITH {cte('measurements')}, k AS (SELECT DISTINCT latitude, longitude FROM measurements)
  SELECT replace(printf('%.6f_%.6f', latitude, longitude), '.', 'p') AS ue_id, latitude AS lat, longitude AS lon FROM k""")
def ue_keys(spark: SparkSession, d: str) -> DataFrame:
    key = measurements.ue_positions(view(spark, d, "measurements")).select(radio.ue_key(F.col("latitude"), F.col("longitude")).alias("ue_id"))
    lat, lon = radio.parsed_key(F.col("ue_id"))
    return key.select("ue_id", lat.alias("lat"), lon.alias("lon"))


# crops


def _centred(df: DataFrame) -> DataFrame:
    return measurements.ue_positions(df).withColumns({"center_lat": F.col("latitude"), "center_lon": F.col("longitude"), "half": F.lit(HALF)})


_IN = "cell_lat BETWEEN min_lat AND max_lat AND cell_lon BETWEEN min_lon AND max_lon"
_CENTRED = f"{_BASE},\nboxed AS (SELECT *, {og.box('latitude', 'longitude', '300e0')} FROM (SELECT DISTINCT latitude, longitude FROM placed))"


@_register("crop_bs_count", f"{_CENTRED} SELECT latitude, longitude, count(*) AS num_bs, max(rssi) AS best_rssi FROM boxed JOIN placed USING (latitude, longitude) WHERE {_IN} GROUP BY latitude, longitude")
def crop_bs_count(spark: SparkSession, d: str) -> DataFrame:
    placed = _staged(spark, d, "rssi")
    found = crops.cells_in_crops(_centred(placed), placed)
    return found.groupBy("latitude", "longitude").agg(F.count(F.lit(1)).alias("num_bs"), F.max("rssi").alias("best_rssi"))


_KEY = "replace(printf('%.6f_%.6f', latitude, longitude), '.', 'p')"
_UES = "ues AS (SELECT latitude, longitude, row_number() OVER (ORDER BY latitude, longitude) - 1 AS ue FROM (SELECT DISTINCT latitude, longitude FROM placed))"
_JIT = f"""{_BASE},\n{_UES},
per AS (SELECT *, ue * 2 + j AS crop_id FROM ues, (VALUES (0), (1)) AS v(j)),
around AS (SELECT *, {og.box('latitude', 'longitude', '300e0 * 0.9e0')} FROM per),
jit AS (SELECT ue, j, crop_id, latitude, longitude, min_lat + (max_lat - min_lat) * {u('crop_id', 1103515245, 3)} AS center_lat, min_lon + (max_lon - min_lon) * {u('crop_id', 1220703125, 4)} AS center_lon FROM around),
jbox AS (SELECT *, {og.box('center_lat', 'center_lon', '300e0')} FROM jit)"""


def _jittered(placed: DataFrame) -> DataFrame:
    # dealt by place as measurements are for their join, before a UE becomes crops
    per = crops.crops_per_ue(crops.numbered_ues(measurements.ue_positions(placed)).repartition("latitude", "longitude"), 2)
    return crops.half_sizes(crops.jittered(per, F.lit(float(HALF)), F.expr(u("crop_id", 1103515245, 3)), F.expr(u("crop_id", 1220703125, 4))), HALF, 0, 0, 0, 0)


@_register("jittered_crops", f"{_JIT} SELECT crop_id, round(center_lat, 7) AS center_lat, round(center_lon, 7) AS center_lon, latitude NOT BETWEEN min_lat AND max_lat OR longitude NOT BETWEEN min_lon AND max_lon AS outside FROM jbox")
def jittered_crops(spark: SparkSession, d: str) -> DataFrame:
    made = _jittered(_staged(spark, d))
    out = ~geo.inside(F.col("latitude"), F.col("longitude"), geo.box(F.col("center_lat"), F.col("center_lon"), F.col("half").cast("double")))
    return made.select("crop_id", F.round("center_lat", 7).alias("center_lat"), F.round("center_lon", 7).alias("center_lon"), out.alias("outside"))


_PLACE = ("latitude", "longitude")


def _found(placed: DataFrame) -> DataFrame:
    """Crops with their cells; from the join on all is done where a place's rows are."""
    return crops.distinct_cells(crops.cells_in_crops(_jittered(placed), placed), (*_PLACE, *measurements.CELL_KEY))


def _indexed(placed: DataFrame, *more: str) -> DataFrame:
    """The index with each UE's place."""
    found = _found(placed).withColumn("ue_id", radio.ue_key(F.col("latitude"), F.col("longitude")))
    return crops.crop_index(found, *_PLACE, *more)


def _index(placed: DataFrame) -> DataFrame:
    return _indexed(placed).drop(*_PLACE)


_INDEX = f"""{_JIT},
found AS (SELECT *, {_KEY} AS ue_id FROM jbox JOIN placed USING (latitude, longitude) WHERE {_IN}),
ix AS (SELECT campaign_id, ue_id, crop_id, count(*) FILTER (WHERE NOT interpolated) AS num_bs, count(*) AS num_bs_all FROM found GROUP BY ALL)"""


@_register("crop_index", f"{_INDEX} SELECT * FROM ix")
def crop_index(spark: SparkSession, d: str) -> DataFrame:
    return _index(_staged(spark, d))


@_register("grid_crops", f"""{_BASE}, around AS (SELECT *, {og.box('latitude', 'longitude', '300e0')} FROM (SELECT DISTINCT latitude, longitude FROM placed)),
grid AS (SELECT latitude, longitude, gy, gx, min_lat + (max_lat - min_lat) * gy / 2e0 AS center_lat, min_lon + (max_lon - min_lon) * gx / 2e0 AS center_lon FROM around, (VALUES (0), (1), (2)) AS a(gy), (VALUES (0), (1), (2)) AS b(gx)),
gbox AS (SELECT latitude, longitude, gy, gx, {og.box('center_lat', 'center_lon', '300e0')} FROM grid)
SELECT gy, gx, count(*) AS n_bs, count(DISTINCT (latitude, longitude)) AS n_crops FROM gbox JOIN placed USING (latitude, longitude) WHERE {_IN} GROUP BY gy, gx""")
def grid_crops(spark: SparkSession, d: str) -> DataFrame:
    placed = _staged(spark, d)
    made = crops.grid_crops(measurements.ue_positions(placed), HALF, 2).withColumn("half", F.lit(HALF))
    found = crops.cells_in_crops(made, placed)
    per_crop = found.groupBy("gy", "gx", "latitude", "longitude").agg(F.count(F.lit(1)).alias("n"))
    return per_crop.groupBy("gy", "gx").agg(F.sum("n").alias("n_bs"), F.count(F.lit(1)).alias("n_crops"))


@_register("random_crops", f"""{_BASE},\n{_UES}, n AS (SELECT count(*) AS n FROM ues), drawn AS (SELECT range AS crop_id, CAST(floor({og.uniform(42, 'range')} * (SELECT n FROM n)) AS BIGINT) AS ue FROM range((SELECT n // 2 FROM n)))
SELECT crop_id, ue, latitude, longitude FROM drawn JOIN ues USING (ue)""")
def random_crops(spark: SparkSession, d: str) -> DataFrame:
    ues = crops.numbered_ues(measurements.ue_positions(_staged(spark, d)))
    n = ues.count()
    return crops.random_ue_crops(spark, n // 2, ues, n, 42).select("crop_id", "ue", "latitude", "longitude")


def _projection_sql() -> str:
    source = "(SELECT DISTINCT latitude, longitude, cell_lat, cell_lon FROM boxed JOIN placed USING (latitude, longitude) WHERE " + _IN + ")"
    one = og.mercator(source, "cell_lat", "cell_lon", "longitude", 1.0, "pe", "pn")
    two = og.mercator(one, "latitude", "longitude", "longitude", 1.0, "ce", "cn")
    return f"{_CENTRED} SELECT latitude, longitude, cell_lat, cell_lon, round(300e0 - (pn - cn), 3) AS bs_y, round(300e0 + pe, 3) AS bs_x FROM {two}"


@_register("crop_projection", _projection_sql())
def crop_projection(spark: SparkSession, d: str) -> DataFrame:
    placed = _staged(spark, d)
    found = crops.cells_in_crops(_centred(placed), placed).select("latitude", "longitude", "center_lat", "center_lon", "half", "cell_lat", "cell_lon").distinct()
    out = geo.crop_position(found, "cell_lat", "cell_lon", "center_lat", "center_lon", "half", "bs_y", "bs_x")
    return out.select("latitude", "longitude", "cell_lat", "cell_lon", F.round("bs_y", 3).alias("bs_y"), F.round("bs_x", 3).alias("bs_x"))


@_register("crop_documents", f"""{_JIT}, found AS (SELECT * FROM jbox JOIN placed USING (latitude, longitude) WHERE {_IN})
SELECT crop_id, count(*) AS n_bs, arg_min(campaign_id, (enode, mnc, npci)) AS campaign_id, list(enode ORDER BY enode, mnc, npci) AS enodes FROM found GROUP BY crop_id""")
def crop_documents(spark: SparkSession, d: str) -> DataFrame:
    made = crops.crop_documents(_found(_staged(spark, d, *METRICS)))
    return made.select("crop_id", F.size("base_stations").cast("long").alias("n_bs"), "campaign_id", F.transform("base_stations", lambda b: b["enode"]).alias("enodes"))


def _metres_sql() -> str:
    source = f"(SELECT *, {BOX[0] + 0.006!r} AS clat, {BOX[2] + 0.007!r} AS clon FROM (SELECT DISTINCT latitude, longitude FROM measurements))"
    one = og.mercator(source, "clat", "clon", "15e0", geo.UTM_SCALE, "ce", "cn")
    two = og.mercator(one, "latitude", "longitude", "15e0", geo.UTM_SCALE, "pe", "pn")
    return f"WITH {cte('measurements')} SELECT latitude, longitude, round(pe - ce, 3) AS x, round(pn - cn, 3) AS y, round(latitude, 6) AS back_lat, round(longitude, 6) AS back_lon FROM {two}"


@_register("local_metres", _metres_sql())
def local_metres(spark: SparkSession, d: str) -> DataFrame:
    """To local metres and back: the way back must give the place itself."""
    center = (BOX[0] + 0.006, BOX[2] + 0.007)
    there = geo.local_metres(measurements.ue_positions(view(spark, d, "measurements")), "latitude", "longitude", *center)
    back = geo.local_degrees(there, "x", "y", *center, "back_lat", "back_lon")
    return back.select("latitude", "longitude", *(F.round(c, n).alias(c) for c, n in (("x", 3), ("y", 3), ("back_lat", 6), ("back_lon", 6))))


# splits


def _boxes() -> tuple[dict[str, Column], dict[str, Column]]:
    return geo.literals(*TEST_BOX), geo.literals(*VAL_BOX)


_inside = lambda b: f"latitude BETWEEN {b[0]}e0 AND {b[1]}e0 AND longitude BETWEEN {b[2]}e0 AND {b[3]}e0"
_HARD = f"CASE WHEN {_inside(TEST_BOX)} THEN 'hard_test' WHEN {_inside(VAL_BOX)} THEN 'hard_val' END"


@_register("split_hard", f"WITH {cte('measurements')} SELECT campaign_id, {_KEY} AS ue_id, {_HARD} AS split FROM (SELECT DISTINCT campaign_id, latitude, longitude FROM measurements)")
def split_hard(spark: SparkSession, d: str) -> DataFrame:
    keys = view(spark, d, "measurements").select("campaign_id", "latitude", "longitude").distinct()
    return splits.hard(keys, *_boxes()).select("campaign_id", radio.ue_key(F.col("latitude"), F.col("longitude")).alias("ue_id"), "split")


def _drawn(source: str, group: str, key: str, share: str, seed: int, flag: str) -> str:
    n = f"count(*) OVER (PARTITION BY {group})"
    order = f"row_number() OVER (PARTITION BY {group} ORDER BY {og.md5_key(seed, key)}, {key})"
    return f"(SELECT *, {order} <= CASE WHEN {n} <= 1 THEN 0 ELSE least(ceil({share} * {n}), {n} - 1) END AS {flag} FROM {source})"


def _twice(source: str, group: str, key: str, train: float, test: float, seed: int, name: str) -> str:
    first = _drawn(source, group, key, repr(1 - train), seed, "out_")
    again = _drawn(f"(SELECT * FROM {first} WHERE out_)", group, key, repr(test), seed + 1, "val_")
    return f"(SELECT * EXCLUDE (out_), 'train' AS split FROM {first} WHERE NOT out_ UNION ALL SELECT * EXCLUDE (out_, val_), CASE WHEN val_ THEN '{name}_val' ELSE '{name}_test' END FROM {again})"


@_register("split_medium", f"WITH {cte('measurements')}, k AS (SELECT DISTINCT campaign_id, {_KEY} AS ue_id FROM measurements) SELECT * FROM {_twice('k', 'campaign_id', 'ue_id', 0.9, 0.5, 0, 'medium')}")
def split_medium(spark: SparkSession, d: str) -> DataFrame:
    keys = view(spark, d, "measurements").select("campaign_id", radio.ue_key(F.col("latitude"), F.col("longitude")).alias("ue_id")).distinct()
    return splits.medium(keys, 0.9, 0.5, 0)


@_register("split_easy", f"WITH {cte('measurements')}, k AS (SELECT DISTINCT campaign_id, {_KEY} AS ue_id, enode AS crop_id FROM measurements) SELECT * FROM {_twice('k', 'campaign_id, ue_id', 'crop_id', 0.99, 0.5, 2, 'easy')}")
def split_easy(spark: SparkSession, d: str) -> DataFrame:
    key = radio.ue_key(F.col("latitude"), F.col("longitude")).alias("ue_id")
    return splits.easy(view(spark, d, "measurements").select("campaign_id", key, F.col("enode").alias("crop_id")).distinct(), 0.99, 0.5, 2)


_SPLIT = f"""{_INDEX}, pl AS (SELECT DISTINCT {_KEY} AS ue_id, latitude, longitude FROM placed), full_ AS (SELECT * FROM ix JOIN pl USING (ue_id)),
hd AS (SELECT *, {_HARD} AS split FROM full_), rest AS (SELECT * EXCLUDE (split) FROM hd WHERE split IS NULL),
md AS (SELECT * FROM rest JOIN {_twice('(SELECT DISTINCT campaign_id, ue_id FROM rest)', 'campaign_id', 'ue_id', 0.9, 0.5, 0, 'medium')} USING (campaign_id, ue_id)),
left_ AS (SELECT * EXCLUDE (split) FROM md WHERE split = 'train'),
ez AS (SELECT * FROM {_twice('left_', 'campaign_id, ue_id', 'crop_id', 0.5, 0.5, 2, 'easy')}),
sp AS (SELECT * FROM hd WHERE split IS NOT NULL UNION ALL BY NAME SELECT * FROM md WHERE split <> 'train' UNION ALL BY NAME SELECT * FROM ez)"""


def _splits(placed: DataFrame) -> DataFrame:
    return splits.split_index(_indexed(placed), *_boxes(), 0.9, 0.5, 0.5, 0)


@_register("split_counts", f"{_SPLIT} SELECT split, count(DISTINCT (campaign_id, ue_id, crop_id)) AS n_points FROM sp GROUP BY split")
def split_counts(spark: SparkSession, d: str) -> DataFrame:
    return splits.split_counts(_splits(_staged(spark, d)))


def _grown(b: tuple, m: float) -> str:
    c = f"cos(radians(({b[0]}e0 + {b[1]}e0) / 2e0))"
    return f"latitude BETWEEN {b[0]}e0 - {m!r} / 111000e0 AND {b[1]}e0 + {m!r} / 111000e0 AND longitude BETWEEN {b[2]}e0 - {m!r} / (111000e0 * {c}) AND {b[3]}e0 + {m!r} / (111000e0 * {c})"


_hits = lambda b: f"({_grown(b, 2 * 300 * 2**0.5)} AND min_lat <= {b[1]}e0 AND {b[0]}e0 <= max_lat AND min_lon <= {b[3]}e0 AND {b[2]}e0 <= max_lon)"


@_register("train_overlap_drop", f"{_JIT}, tr AS (SELECT * FROM jbox WHERE {_HARD} IS NULL) SELECT crop_id, latitude, longitude FROM tr WHERE NOT ({_hits(TEST_BOX)} OR {_hits(VAL_BOX)})")
def train_overlap_drop(spark: SparkSession, d: str) -> DataFrame:
    train = splits.hard(_jittered(_staged(spark, d)), *_boxes()).filter("split IS NULL")
    return splits.without_overlap(train, *_boxes(), F.col("half"), HALF).select("crop_id", "latitude", "longitude")


def _geometric(placed: DataFrame) -> DataFrame:
    """The index with each crop's centre and half-width."""
    return _indexed(placed, "center_lat", "center_lon", "half")


_LEAKS = f"({_hits(TEST_BOX)} OR {_hits(VAL_BOX)})"
_GEOMETRY = "(SELECT crop_id, min_lat, max_lat, min_lon, max_lon FROM jbox)"


@_register("split_without_leaks", f"{_SPLIT} SELECT campaign_id, ue_id, crop_id, split FROM sp JOIN {_GEOMETRY} USING (crop_id) WHERE split <> 'train' OR NOT {_LEAKS}")
def split_without_leaks(spark: SparkSession, d: str) -> DataFrame:
    out = splits.split_index(_geometric(_staged(spark, d)), *_boxes(), 0.9, 0.5, 0.5, 0, largest=HALF)
    return out.select("campaign_id", "ue_id", "crop_id", "split")


@_register("train_only_without_leaks", f"{_SPLIT} SELECT campaign_id, count(DISTINCT ue_id) AS n_ues, count(*) AS n_crops FROM full_ JOIN {_GEOMETRY} USING (crop_id) WHERE NOT {_LEAKS} GROUP BY campaign_id")
def train_only_without_leaks(spark: SparkSession, d: str) -> DataFrame:
    out = splits.split_index(_geometric(_staged(spark, d)), *_boxes(), 0.9, 0.5, 0.5, 0, train_only=True, largest=HALF)
    return out.groupBy("campaign_id").agg(F.count_distinct("ue_id").alias("n_ues"), F.count(F.lit(1)).alias("n_crops"))


@_register("split_campaigns", f"{_SPLIT} SELECT campaign_id, count(*) FILTER (WHERE campaign_id IN (1, 3) AND split <> 'train') AS n_held_out FROM sp GROUP BY campaign_id")
def split_campaigns(spark: SparkSession, d: str) -> DataFrame:
    """Campaigns of all splits, and what is held out of two chosen ones."""
    found = stage(_splits(_staged(spark, d)), "splits")
    held = splits.of_campaigns(found, (1, 3)).filter("split != 'train'").groupBy("campaign_id").agg(F.count(F.lit(1)).alias("n_held_out"))
    return splits.campaigns(found).join(held, "campaign_id", "left").select("campaign_id", F.coalesce("n_held_out", F.lit(0)).alias("n_held_out"))


@_register("eval_first_crop", f"""{_SPLIT}, ok AS (SELECT * FROM sp WHERE split <> 'train' AND num_bs >= 1)
SELECT campaign_id, ue_id, crop_id, split, n_bs FROM (SELECT *, num_bs AS n_bs, row_number() OVER (PARTITION BY campaign_id, ue_id ORDER BY crop_id) AS r_ FROM ok) WHERE r_ = 1""")
def eval_first_crop(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import samples

    found = stage(_splits(_staged(spark, d)), "splits")
    key = ["campaign_id", "ue_id", "crop_id"]
    chosen = samples.eligible(found.filter("split != 'train'").select(*key, "split"), found.select(*key, "num_bs", "num_bs_all"), 1)
    return samples.first_per_ue(chosen).select(*key, "split", "n_bs")


@_register("region_bounds", f"""WITH {cte('measurements')}, b AS (SELECT min(latitude) AS min_lat, max(latitude) AS max_lat, min(longitude) AS min_lon, max(longitude) AS max_lon FROM measurements),
c AS (SELECT *, (min_lat + max_lat) / 2 AS center_lat, (min_lon + max_lon) / 2 AS center_lon FROM b)
SELECT min_lat, max_lat, min_lon, max_lon, round(greatest({', '.join(og.haversine('center_lat', 'center_lon', a, b) for a in ('min_lat', 'max_lat') for b in ('min_lon', 'max_lon'))}), 3) AS reach_m FROM c""")
def region_bounds(spark: SparkSession, d: str) -> DataFrame:
    out = region.center_and_reach(region.bounds(view(spark, d, "measurements"), "latitude", "longitude"))
    return out.select("min_lat", "max_lat", "min_lon", "max_lon", F.round("reach_m", 3).alias("reach_m"))
