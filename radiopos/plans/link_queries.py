"""Queries on pairs, links, calibration, regions and buildings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, radio
from ..operators import buildings, calibrate, links, measurements, region
from . import oracle_geo as og
from .fixtures import BOX, TABLES, cte, u, view

QUERIES: dict = {}
ORACLES: dict = {}
ROWS, COLUMNS = 4, 5
REGION = (41.822, 41.829, 12.462, 12.471)


def _register(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def _sql(spark: SparkSession, d: str, text: str) -> DataFrame:
    return spark.sql(text.format(string="STRING", **{t: f"parquet.`{d}/{t}.parquet`" for t in TABLES}))


def _bs_ue(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    v = view(spark, d, "links")
    bs = v.select("bs_idx", F.col("BSLatitude").alias("bs_lat"), F.col("BSLongitude").alias("bs_lon")).distinct()
    ue = v.select("ue_idx", F.col("UELatitude").alias("ue_lat"), F.col("UELongitude").alias("ue_lon")).distinct()
    return bs, ue


_BU = f"WITH {cte('links')}, bs AS (SELECT DISTINCT bs_idx, BSLatitude AS bs_lat, BSLongitude AS bs_lon FROM links), ue AS (SELECT DISTINCT ue_idx, UELatitude AS ue_lat, UELongitude AS ue_lon FROM links)"
_OFFSET = """(ue_lat - bs_lat) * 111000e0 AS n_, (ue_lon - bs_lon) * 111000e0 * cos(radians(bs_lat)) AS e_"""
_MEASURED = "round(sqrt(n_ * n_ + e_ * e_), 4) AS distance_m, round(atan2(e_, n_), 7) AS bearing_rad"


def _rounded(pairs: DataFrame, *columns: str) -> DataFrame:
    return pairs.select(*columns, F.round("distance_m", 4).alias("distance_m"), F.round("bearing_rad", 7).alias("bearing_rad"))


@_register("ue_bs_pairs", f"{_BU} SELECT ue_idx, bs_idx, {_MEASURED} FROM (SELECT *, {_OFFSET} FROM ue CROSS JOIN bs)")
def ue_bs_pairs(spark: SparkSession, d: str) -> DataFrame:
    bs, ue = _bs_ue(spark, d)
    return _rounded(links.all_pairs(ue, bs), "ue_idx", "bs_idx")


@_register("pair_profile", f"{_BU} SELECT (SELECT count(*) FROM ue) AS n_ues, (SELECT count(*) FROM ue) * (SELECT count(*) FROM bs) AS n_pairs, 0e0 AS max_spread, (SELECT count(*) FROM bs) AS n_bs")
def pair_profile(spark: SparkSession, d: str) -> DataFrame:
    bs, ue = _bs_ue(spark, d)
    return links.pair_profile(links.all_pairs(ue, bs))


_PATCH = f"least(floor(({BOX[1]}e0 - ue_lat) / (({BOX[1]}e0 - {BOX[0]}e0) / {ROWS})), {ROWS - 1}) * {COLUMNS} + least(floor((ue_lon - {BOX[2]}e0) / (({BOX[3]}e0 - {BOX[2]}e0) / {COLUMNS})), {COLUMNS - 1})"
_TILES = f"""tiles AS (SELECT range AS patch_idx, {BOX[1]}e0 - (range // {COLUMNS}) * (({BOX[1]}e0 - {BOX[0]}e0) / {ROWS}) AS max_lat, {BOX[1]}e0 - (range // {COLUMNS} + 1) * (({BOX[1]}e0 - {BOX[0]}e0) / {ROWS}) AS min_lat,
  {BOX[2]}e0 + (range % {COLUMNS}) * (({BOX[3]}e0 - {BOX[2]}e0) / {COLUMNS}) AS min_lon, {BOX[2]}e0 + (range % {COLUMNS} + 1) * (({BOX[3]}e0 - {BOX[2]}e0) / {COLUMNS}) AS max_lon FROM range({ROWS * COLUMNS}))"""
_along = lambda lo, hi, tag: f"{lo} + ({hi} - {lo}) * {og.uniform(9, tag, 'patch_idx', 'bs_idx')}"
_STATIONS = f"""stations AS (SELECT patch_idx, bs_idx, {_along('min_lat', 'max_lat', "'lat'")} AS bs_lat, {_along('min_lon', 'max_lon', "'lon'")} AS bs_lon,
  20 + 40 * {og.uniform(9, "'alt'", 'patch_idx', 'bs_idx')} AS bs_alt FROM tiles, (VALUES (0), (1), (2)) AS v(bs_idx))"""


@_register("patch_pairs", f"{_BU}, {_TILES}, {_STATIONS}, placed AS (SELECT *, CAST({_PATCH} AS BIGINT) AS patch_idx FROM ue WHERE ue_lat BETWEEN {BOX[0]}e0 AND {BOX[1]}e0 AND ue_lon BETWEEN {BOX[2]}e0 AND {BOX[3]}e0) SELECT patch_idx, ue_idx, bs_idx, round(bs_alt, 5) AS bs_alt, {_MEASURED} FROM (SELECT *, {_OFFSET} FROM placed JOIN stations USING (patch_idx))")
def patch_pairs(spark: SparkSession, d: str) -> DataFrame:
    _, ue = _bs_ue(spark, d)
    ue = ue.withColumn("patch_idx", region.patch_of(F.col("ue_lat"), F.col("ue_lon"), BOX, ROWS, COLUMNS))
    stations = links.patch_stations(region.patches(spark, BOX, ROWS, COLUMNS), 3, 9).select("patch_idx", "bs_idx", "bs_lat", "bs_lon", "bs_alt")
    out = links.pairs_by_key(ue, stations, "patch_idx").withColumn("bs_alt", F.round("bs_alt", 5))
    return _rounded(out, "patch_idx", "ue_idx", "bs_idx", "bs_alt")


@_register("patch_grid", f"{_BU}, {_TILES}, placed AS (SELECT CAST({_PATCH} AS BIGINT) AS patch_idx FROM ue WHERE ue_lat BETWEEN {BOX[0]}e0 AND {BOX[1]}e0 AND ue_lon BETWEEN {BOX[2]}e0 AND {BOX[3]}e0), n AS (SELECT patch_idx, count(*) AS n FROM placed GROUP BY patch_idx) SELECT patch_idx, round(min_lat, 7) AS min_lat, round(max_lon, 7) AS max_lon, substr(md5(printf('%.6f_%.6f', min_lat, max_lon)), 1, 12) AS area, coalesce(n, 0) AS n_ues FROM tiles LEFT JOIN n USING (patch_idx)")
def patch_grid(spark: SparkSession, d: str) -> DataFrame:
    _, ue = _bs_ue(spark, d)
    n = ue.groupBy(region.patch_of(F.col("ue_lat"), F.col("ue_lon"), BOX, ROWS, COLUMNS).alias("patch_idx")).agg(F.count(F.lit(1)).alias("n"))
    tiles = region.patches(spark, BOX, ROWS, COLUMNS).join(n, "patch_idx", "left")
    return tiles.select("patch_idx", F.round("min_lat", 7).alias("min_lat"), F.round("max_lon", 7).alias("max_lon"), region.area_id(F.col("min_lat"), F.col("max_lon")).alias("area"), F.coalesce("n", F.lit(0)).alias("n_ues"))


@_register("stations_around", f"""{_BU}, b AS (SELECT *, row_number() OVER (ORDER BY bs_idx) - 1 AS bs_no FROM bs), t AS (SELECT count(*) AS k FROM b), n AS (SELECT count(*) AS n FROM ue)
SELECT bs_idx, bs_no, j, round(bs_lat + 250e0 * {og.uniform(4, "'r'", 'bs_no', 'j')} * cos(2 * pi() * {og.uniform(4, "'a'", 'bs_no', 'j')}) / 111000e0, 7) AS ue_lat FROM b, t, n, range((SELECT n // k + 1 FROM t, n)) AS r(j)
WHERE j < n // k + CASE WHEN bs_no < n % k THEN 1 ELSE 0 END""")
def stations_around(spark: SparkSession, d: str) -> DataFrame:
    bs, ue = _bs_ue(spark, d)
    numbered = calibrate.appearance_index(bs, "bs_idx", "bs_idx", "bs_no").select("bs_idx", "bs_no").join(bs, "bs_idx")
    made = links.around_stations(numbered, ue.count(), bs.count(), 250.0, 4)
    return made.select("bs_idx", "bs_no", F.col("j").cast("long").alias("j"), F.round("ue_lat", 7).alias("ue_lat"))


@_register("pair_chunks", f"{_BU} SELECT bs_idx, chunk, count(*) AS n, min(row_id) AS first_row FROM (SELECT *, CAST((row_number() OVER (PARTITION BY bs_idx ORDER BY row_id) - 1) // 256 AS BIGINT) AS chunk FROM links) GROUP BY bs_idx, chunk")
def pair_chunks(spark: SparkSession, d: str) -> DataFrame:
    cut = links.chunks(view(spark, d, "links"), "bs_idx", "row_id", 256)
    return cut.groupBy("bs_idx", "chunk").agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first_row"))


_GAIN = "g AS (SELECT rx, tx, sum(re * re + im * im) AS gain FROM paths GROUP BY rx, tx), r AS (SELECT *, greatest(10e0 * log10(greatest(gain, 1e-30)), -140e0) AS rssi FROM g), p AS (SELECT *, pow(10e0, rssi / 10e0) AS power FROM r)"


@_register("link_metrics", f"WITH {cte('paths')}, {_GAIN} SELECT rx, tx, round(rssi, 6) AS rssi, round(rssi - 10e0 * log10(pow(10e0, -10e0) + pow(10e0, -11e0)), 6) AS nsinr, round(10e0 * log10(power / 1008e0) + 30e0, 6) AS nrsrp, round(10e0 * log10(84e0 * (power / 1008e0) / power), 6) AS nrsrq FROM p")
def link_metrics(spark: SparkSession, d: str) -> DataFrame:
    out = links.link_metrics(view(spark, d, "paths"))
    return out.select("rx", "tx", *(F.round(c, 6).alias(c) for c in ("rssi", "nsinr", "nrsrp", "nrsrq")))


@_register("results_onto_pairs", f"WITH {cte('paths')}, {_GAIN}, k AS (SELECT DISTINCT rx, tx FROM paths) SELECT tx, count(*) AS n, round(avg(rssi), 5) AS mean_rssi FROM k JOIN p USING (rx, tx) GROUP BY tx")
def results_onto_pairs(spark: SparkSession, d: str) -> DataFrame:
    paths = view(spark, d, "paths")
    out = links.results_onto_pairs(paths.select("rx", "tx").distinct(), links.link_metrics(paths), ["rx", "tx"])
    return out.groupBy("tx").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("rssi"), 5).alias("mean_rssi"))


@_register("saved_share", f"WITH {cte('links')} SELECT count(*) FILTER (WHERE ok) AS saved, count(*) FILTER (WHERE NOT ok) AS failed, 100e0 * count(*) FILTER (WHERE ok) / count(*) AS percent FROM (SELECT RSSI IS NOT NULL AS ok FROM links)")
def saved_share(spark: SparkSession, d: str) -> DataFrame:
    return links.saved_share(view(spark, d, "links").withColumn("ok", F.col("RSSI").isNotNull()), "ok")


@_register("path_loss", "WITH s AS (SELECT l_orderkey AS link, sum(sqrt(pow(l_discount * 1e-5, 2) + pow(l_tax * 1e-5, 2))) AS h FROM lineitem GROUP BY l_orderkey) SELECT link, round((-10e0 * log10(greatest(h * h, 1e-30)) - 84e0) / 196e0, 7) AS loss FROM s")
def path_loss(spark: SparkSession, d: str) -> DataFrame:
    p = view(spark, d, "paths").groupBy(F.col("rx").alias("link")).agg(F.collect_list(F.struct("re", "im")).alias("v"))
    loss = radio.path_loss(F.transform("v", lambda x: x["re"]), F.transform("v", lambda x: x["im"]))
    return p.select("link", F.round(loss, 7).alias("loss"))


# calibration


_CORRECTIONS = "cor AS (SELECT DISTINCT concat_ws('_', round(BSLatitude, 6), round(BSLongitude, 6)) AS BS_location, round(BSLatitude + 1e-4, 5) AS new_lat, round(BSLongitude - 1e-4, 5) AS new_lon FROM links WHERE bs_idx % 7 = 0)"


@_register("bs_corrections", f"WITH {cte('links')}, {_CORRECTIONS}, l AS (SELECT *, concat_ws('_', round(BSLatitude, 6), round(BSLongitude, 6)) AS BS_location FROM links), j AS (SELECT row_id, l.BS_location AS old_, coalesce(new_lat, BSLatitude) AS BSLatitude, coalesce(new_lon, BSLongitude) AS BSLongitude, new_lat FROM l LEFT JOIN cor USING (BS_location)) SELECT row_id, BSLatitude, BSLongitude, CASE WHEN new_lat IS NULL THEN old_ ELSE concat_ws('_', round(BSLatitude, 8), round(BSLongitude, 8)) END AS BS_location FROM j")
def bs_corrections(spark: SparkSession, d: str) -> DataFrame:
    from ..sources import tables

    v = tables.with_location_keys(view(spark, d, "links"))
    cor = v.filter("bs_idx % 7 = 0").select("BS_location", F.round(F.col("BSLatitude") + 1e-4, 5).alias("new_lat"), F.round(F.col("BSLongitude") - 1e-4, 5).alias("new_lon")).distinct()
    return calibrate.corrected(v, cor).select("row_id", "BSLatitude", "BSLongitude", "BS_location")


_NO = "SELECT {k}, first_row, row_number() OVER (ORDER BY first_row) - 1 AS {o} FROM (SELECT {k}, min(row_id) AS first_row FROM links GROUP BY {k})"


@_register("tx_rx_index", f"WITH {cte('links')} SELECT 'tx' AS side, bs_idx AS key, first_row, no FROM ({_NO.format(k='bs_idx', o='no')}) UNION ALL SELECT 'rx', ue_idx, first_row, no FROM ({_NO.format(k='ue_idx', o='no')})")
def tx_rx_index(spark: SparkSession, d: str) -> DataFrame:
    v = view(spark, d, "links")
    side = lambda s, k: calibrate.appearance_index(v, k, "row_id", "no").select(F.lit(s).alias("side"), F.col(k).alias("key"), "first_row", "no")
    return side("tx", "bs_idx").union(side("rx", "ue_idx"))


@_register("dense_cube", f"WITH {cte('links')}, last_ AS (SELECT bs_idx AS tx_idx, ue_idx AS rx_idx, arg_max(RSSI, row_id) FILTER (WHERE RSSI IS NOT NULL) AS rssi, arg_max(sim_rssi, row_id) AS sim FROM links GROUP BY ALL) SELECT tx_idx, rx_idx, coalesce(rssi, -90e0) AS rssi, coalesce(sim, -90e0) AS sim_rssi FROM (SELECT DISTINCT bs_idx AS tx_idx FROM links) CROSS JOIN (SELECT DISTINCT ue_idx AS rx_idx FROM links) LEFT JOIN last_ USING (tx_idx, rx_idx)")
def dense_cube(spark: SparkSession, d: str) -> DataFrame:
    v = view(spark, d, "links").withColumnsRenamed({"bs_idx": "tx_idx", "ue_idx": "rx_idx", "RSSI": "rssi"})
    known = v.withColumn("at", F.when(F.col("rssi").isNotNull(), F.col("row_id")))
    cube = calibrate.dense_cube(known, ["rssi"], "at").join(calibrate.dense_cube(v, ["sim_rssi"], "row_id"), ["tx_idx", "rx_idx"])
    return cube.select("tx_idx", "rx_idx", "rssi", "sim_rssi")


def _rho(source: str, group: str) -> str:
    rank = lambda c: f"rank() OVER (PARTITION BY {group} ORDER BY {c}) + (count(*) OVER (PARTITION BY {group}, {c}) - 1) / 2e0"
    return f"SELECT {group}, count(*) AS n, round(covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0), 9) AS rho FROM (SELECT {group}, {rank('RSSI')} AS a, {rank('sim_rssi')} AS b FROM {source}) GROUP BY {group}"


@_register("spearman", f"WITH {cte('links')}, f AS (SELECT bs_idx, coalesce(RSSI, -90e0) AS RSSI, sim_rssi FROM links), a AS ({_rho('f', 'bs_idx')}), b AS ({_rho('(SELECT * FROM f WHERE RSSI <> -90e0)', 'bs_idx')}) SELECT bs_idx, a.n, a.rho, b.n AS n_filtered, b.rho AS rho_filtered FROM a LEFT JOIN b USING (bs_idx)")
def spearman(spark: SparkSession, d: str) -> DataFrame:
    filled, _ = measurements.fill_rssi(view(spark, d, "links"), "RSSI")
    out = calibrate.spearman_both(filled, ["bs_idx"], "RSSI", "sim_rssi")
    return out.select("bs_idx", "n", F.round("rho", 9).alias("rho"), "n_filtered", F.round("rho_filtered", 9).alias("rho_filtered"))


_STEPS = 4000
_AREA = lambda upto: f"({upto}) * sum(pow(cos(({upto}) * (k + 0.5e0) / {_STEPS}), d - 1))"


@_register("spearman_p_value", f"""WITH {cte('links')}, f AS (SELECT bs_idx, coalesce(RSSI, -90e0) AS RSSI, sim_rssi FROM links), r AS ({_rho('f', 'bs_idx')}), q AS (SELECT *, n - 2 AS d, atan(abs(rho) / sqrt(1 - rho * rho)) AS a FROM r)
SELECT bs_idx, n, rho, round(1 - ({_AREA('a')}) / ({_AREA('pi() / 2')}), 5) + 0e0 AS p_value FROM q, (SELECT range AS k FROM range({_STEPS})) GROUP BY bs_idx, n, rho, a, d""")
def spearman_p_value(spark: SparkSession, d: str) -> DataFrame:
    filled, _ = measurements.fill_rssi(view(spark, d, "links"), "RSSI")
    out = calibrate.with_p_value(calibrate.spearman(filled, ["bs_idx"], "RSSI", "sim_rssi"))
    return out.select("bs_idx", "n", F.round("rho", 9).alias("rho"), (F.round("p_value", 5) + 0.0).alias("p_value"))


@_register("trial_scores", f"WITH {cte('links')}, t AS (SELECT bs_idx, ue_idx % 5 AS trial, coalesce(RSSI, -90e0) AS RSSI, sim_rssi FROM links), r AS ({_rho('t', 'bs_idx, trial')}) SELECT bs_idx, trial, coalesce(0e0 - rho, 1e0) + 0e0 AS score FROM r")
def trial_scores(spark: SparkSession, d: str) -> DataFrame:
    filled, _ = measurements.fill_rssi(view(spark, d, "links"), "RSSI")
    out = calibrate.trial_scores(filled.withColumn("trial", F.col("ue_idx") % 5), "RSSI", "sim_rssi")
    return out.select("bs_idx", "trial", (F.round("score", 9) + 0.0).alias("score"))


@_register("trial_history", f"WITH {cte('trials')} SELECT bs_idx, trial, coalesce(score, 1e0) AS score, min(coalesce(score, 1e0)) OVER (PARTITION BY bs_idx ORDER BY trial) AS best_so_far FROM trials")
def trial_history(spark: SparkSession, d: str) -> DataFrame:
    return calibrate.trial_history(view(spark, d, "trials"))


@_register("best_trial", f"WITH {cte('trials')}, s AS (SELECT bs_idx, trial, coalesce(score, 1e0) AS score FROM trials) SELECT bs_idx, arg_min(trial, (score, trial)) AS best_trial, min(score) AS best_score, count(*) AS n_trials FROM s GROUP BY bs_idx")
def best_trial(spark: SparkSession, d: str) -> DataFrame:
    return calibrate.best_trial(view(spark, d, "trials"))


@_register("best_epoch", f"WITH {cte('epoch_metrics')}, m AS (SELECT epoch, round(avg(metric), 9) AS value FROM epoch_metrics GROUP BY epoch) SELECT arg_min(epoch, (value, epoch)) AS best_epoch, max(epoch) AS last_epoch FROM m")
def best_epoch(spark: SparkSession, d: str) -> DataFrame:
    per = view(spark, d, "epoch_metrics").groupBy("epoch").agg(F.round(F.avg("metric"), 9).alias("value"))
    return calibrate.best_epoch(per)


# regions


def _masks(b: tuple) -> list[str]:
    w = (b[0] - 0.2 * (b[1] - b[0]), b[1] + 0.2 * (b[1] - b[0]), b[2] - 0.2 * (b[3] - b[2]), b[3] + 0.2 * (b[3] - b[2]))
    on = lambda s, x: f"({s}Latitude BETWEEN {x[0]!r} AND {x[1]!r} AND {s}Longitude BETWEEN {x[2]!r} AND {x[3]!r})"
    return [f"{on('BS', b)} AND {on('UE', b)}", on("BS", b), on("BS", w)]


@_register("region_counts", f"WITH {cte('links')} SELECT count(*) AS n_all, {', '.join(f'count(*) FILTER (WHERE {m}) AS n_{n}' for n, m in zip(('both', 'station', 'wider'), _masks(REGION), strict=True))} FROM links")
def region_counts(spark: SparkSession, d: str) -> DataFrame:
    return region.region_counts(view(spark, d, "links"), REGION)


@_register("region_filter", f"WITH {cte('links')} SELECT row_id, 'both' AS stage, coalesce(RSSI, -90e0) AS RSSI FROM links WHERE {_masks(REGION)[0]}")
def region_filter(spark: SparkSession, d: str) -> DataFrame:
    filled, _ = measurements.fill_rssi(region.region_filter(view(spark, d, "links"), REGION), "RSSI")
    return filled.select("row_id", "stage", "RSSI")


#: Boxes whose links are found by both ends, by the station alone, and by the station in the wider box.
_CASCADE = (REGION, (BOX[0] - 1e-6, BOX[0] + 1e-6, BOX[2] - 1e-6, BOX[2] + 1e-6), (BOX[0] + 1.5e-6, BOX[0] + 1.15e-5, BOX[2] - 1e-6, BOX[2] + 3e-6))


def _cascade_sql() -> str:
    parts = []
    for i, b in enumerate(_CASCADE):
        masks = _masks(b)
        stage = "CASE " + " ".join(f"WHEN (SELECT count(*) FROM links WHERE {m}) > 0 THEN '{n}'" for n, m in zip(("both", "station", "wider"), masks, strict=True)) + " END"
        keep = " ".join(f"WHEN '{n}' THEN {m}" for n, m in zip(("both", "station", "wider"), masks, strict=True))
        parts.append(f"SELECT {i} AS box, stage, count(*) AS n, min(row_id) AS first_row FROM (SELECT *, {stage} AS stage FROM links) WHERE CASE stage {keep} END GROUP BY stage")
    return f"WITH {cte('links')} " + " UNION ALL ".join(parts)


@_register("region_cascade", _cascade_sql())
def region_cascade(spark: SparkSession, d: str) -> DataFrame:
    v = view(spark, d, "links")
    found = [region.region_filter(v, b).groupBy("stage").agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first_row")).select(F.lit(i).alias("box"), "*") for i, b in enumerate(_CASCADE)]
    return found[0].union(found[1]).union(found[2])


@_register("station_summary", f"WITH {cte('links')}, l AS (SELECT *, concat_ws('_', round(BSLatitude, 6), round(BSLongitude, 6)) AS BS_location FROM links) SELECT BS_location, count(*) AS n, arg_min(BSLatitude, row_id) AS lat, arg_min(BSLongitude, row_id) AS lon FROM l GROUP BY BS_location")
def station_summary(spark: SparkSession, d: str) -> DataFrame:
    from ..sources import tables

    return region.station_summary(tables.with_location_keys(view(spark, d, "links")), "row_id", None)


# buildings


_SIMPLE = """CASE WHEN h BETWEEN 5 AND 200 THEN h WHEN n BETWEEN 1 AND 50 THEN 3 * n ELSE CASE kind WHEN 'house' THEN 8e0 WHEN 'apartments' THEN 20e0 WHEN 'office' THEN 15e0 WHEN 'industrial' THEN 12e0 ELSE 10e0 END END"""


@_register("building_height", f"WITH {cte('buildings')}, p AS (SELECT *, TRY_CAST(trim(replace(height, 'm', '')) AS DOUBLE) AS h, TRY_CAST(levels AS DOUBLE) AS n FROM buildings) SELECT feature_id, {_SIMPLE} AS height_m FROM p")
def building_height(spark: SparkSession, d: str) -> DataFrame:
    b = view(spark, d, "buildings")
    return b.select("feature_id", radio.building_height(F.col("height"), F.col("levels"), F.col("kind")).alias("height_m"))


_UNIT = lambda c: f"(SELECT CASE WHEN v BETWEEN 2 AND 200 THEN v END FROM (SELECT CASE WHEN lower({c}) LIKE '%ft%' THEN x * 0.3048e0 ELSE x END AS v FROM (SELECT TRY_CAST(nullif(regexp_extract({c}, '^\\s*([0-9]+(?:\\.[0-9]+)?)', 1), '') AS DOUBLE) AS x)))"
_FLOOR = "CASE kind WHEN 'industrial' THEN 4.5e0 WHEN 'office' THEN 3.5e0 ELSE 3e0 END"
_LOW = "CASE kind WHEN 'apartments' THEN 12e0 WHEN 'office' THEN 10e0 WHEN 'industrial' THEN 6e0 WHEN 'house' THEN 5.5e0 ELSE CASE WHEN size > 40 THEN 12e0 WHEN size > 14 THEN 8e0 ELSE 5e0 END END"
_HIGH = "CASE kind WHEN 'apartments' THEN 25e0 WHEN 'office' THEN 20e0 WHEN 'industrial' THEN 12e0 WHEN 'house' THEN 8.5e0 ELSE CASE WHEN size > 40 THEN 25e0 WHEN size > 14 THEN 18e0 ELSE 12e0 END END"


@_register("building_height_units", f"WITH {cte('buildings')} SELECT feature_id, coalesce({_UNIT('height_ft')}, {_UNIT('height')}, CASE WHEN TRY_CAST(levels AS DOUBLE) BETWEEN 1 AND 50 THEN TRY_CAST(levels AS DOUBLE) * {_FLOOR} END, round({_LOW} + ({_HIGH} - {_LOW}) * {og.uniform(3, 'feature_id')}, 1)) AS height_m FROM buildings")
def building_height_units(spark: SparkSession, d: str) -> DataFrame:
    b = view(spark, d, "buildings").withColumn("area", F.when(F.col("size") > 40, 1500.0).when(F.col("size") > 14, 500.0).otherwise(100.0))
    return buildings.heights_drawn(b, ["height_ft", "height"], ["levels"], 3, area="area").select("feature_id", "height_m")


@_register("patch_buildings", f"WITH {cte('buildings')}, {_TILES}, c AS (SELECT CAST({_PATCH.replace('ue_lat', 'min_lat').replace('ue_lon', 'min_lon')} AS BIGINT) AS patch_idx, count(*) AS n FROM buildings WHERE min_lat BETWEEN {BOX[0]}e0 AND {BOX[1]}e0 AND min_lon BETWEEN {BOX[2]}e0 AND {BOX[3]}e0 GROUP BY ALL) SELECT patch_idx, round((min_lat + max_lat) / 2, 7) AS center_lat, round((min_lon + max_lon) / 2, 7) AS center_lon, coalesce(n, 0) AS n_buildings FROM tiles LEFT JOIN c USING (patch_idx)")
def patch_buildings(spark: SparkSession, d: str) -> DataFrame:
    b = view(spark, d, "buildings").select(region.patch_of(F.col("min_lat"), F.col("min_lon"), BOX, ROWS, COLUMNS).alias("patch_idx"))
    info = region.patch_info(region.patches(spark, BOX, ROWS, COLUMNS), b)
    return info.select("patch_idx", F.round("center_lat", 7).alias("center_lat"), F.round("center_lon", 7).alias("center_lon"), "n_buildings")


_UE_BOX = f"(SELECT s_suppkey AS crop_id, {og.box(u('s_suppkey', 1103515245, 12345) + ' * 0.012e0 + 41.82e0', u('s_suppkey', 1220703125, 54321) + ' * 0.014e0 + 12.46e0', '100e0')} FROM supplier)"


@_register("crop_buildings", f"WITH {cte('buildings')}, c AS {_UE_BOX} SELECT crop_id, feature_id FROM buildings b JOIN c ON b.min_lat <= c.max_lat AND c.min_lat <= b.max_lat AND b.min_lon <= c.max_lon AND c.min_lon <= b.max_lon")
def crop_buildings(spark: SparkSession, d: str) -> DataFrame:
    s = _sql(spark, d, f"SELECT s_suppkey AS crop_id, {u('s_suppkey', 1103515245, 12345)} * 0.012e0 + 41.82e0 AS lat, {u('s_suppkey', 1220703125, 54321)} * 0.014e0 + 12.46e0 AS lon FROM {{supplier}}")
    boxes = s.withColumns(geo.box(F.col("lat"), F.col("lon"), F.lit(100.0))).drop("lat", "lon")
    features = view(spark, d, "buildings").select("feature_id", *geo.named())
    return buildings.in_crops(features, boxes, 0.001)


_CORNER = "(VALUES (0, 0, 0), (1, 1, 0), (2, 1, 1), (3, 0, 1)) AS {n}({n}_, {n}x, {n}y)"
_FAN = "SELECT '{side}' AS side, no, CASE no WHEN 1 THEN 2 ELSE 1 END AS xs, CASE no WHEN 1 THEN 1 ELSE 2 END AS ys, {zs} AS zs FROM (VALUES (1), (2)) AS v(no)"
_WALL = f"SELECT 'wall', 2 * i_ + k, CASE k WHEN 0 THEN ix + 2 * jx ELSE 2 * ix + jx END, CASE k WHEN 0 THEN iy + 2 * jy ELSE 2 * iy + jy END, k + 1 FROM {_CORNER.format(n='i')}, {_CORNER.format(n='j')}, (VALUES (0), (1)) AS w(k) WHERE j_ = (i_ + 1) % 4"


@_register("building_triangles", f"WITH {cte('buildings')}, t AS ({_FAN.format(side='roof', zs=3)} UNION ALL {_FAN.format(side='ground', zs=0)} UNION ALL {_WALL}) SELECT feature_id AS id, side, CAST(no AS INTEGER) AS no, xs * CAST(size AS DOUBLE) AS x_sum, ys * CAST(size AS DOUBLE) AS y_sum, zs * CAST(size AS DOUBLE) AS z_sum FROM buildings, t")
def building_triangles(spark: SparkSession, d: str) -> DataFrame:
    b = view(spark, d, "buildings")
    side = F.col("size").cast("double")
    at = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    zero = F.lit(0.0)
    prints = b.select(F.col("feature_id").alias("id"), F.array(at(zero, zero), at(side, zero), at(side, side), at(zero, side)).alias("exterior"), side.alias("height"))
    total = lambda c: (F.col(f"p.{c}") + F.col(f"q.{c}") + F.col(f"r.{c}")).alias(f"{c}_sum")
    return buildings.triangles(prints).select("id", "side", F.col("no").cast("int").alias("no"), *map(total, "xyz"))


_CENTER = (BOX[0] + 0.006, BOX[2] + 0.007)


def _footprint_sql() -> str:
    source = f"(SELECT *, {_CENTER[0]!r} AS clat, {_CENTER[1]!r} AS clon FROM buildings)"
    for n, (lat, lon) in enumerate((("clat", "clon"), ("min_lat", "min_lon"), ("max_lat", "max_lon"))):
        source = og.mercator(source, lat, lon, "15e0", geo.UTM_SCALE, f"e{n}", f"n{n}")
    high = "CASE WHEN h BETWEEN 5 AND 200 THEN h WHEN n BETWEEN 1 AND 50 THEN 3 * n ELSE CASE kind WHEN 'house' THEN 8e0 WHEN 'apartments' THEN 20e0 WHEN 'office' THEN 15e0 WHEN 'industrial' THEN 12e0 ELSE 10e0 END END"
    return f"""WITH {cte('buildings')}, p AS (SELECT *, TRY_CAST(trim(replace(height, 'm', '')) AS DOUBLE) AS h, TRY_CAST(levels AS DOUBLE) AS n FROM {source})
SELECT feature_id || '_' || part AS id, 4 AS corners, CASE part WHEN 0 THEN 1 ELSE 0 END AS n_holes, round(e1 - e0, 3) + 0e0 AS x0, round(n1 - n0, 3) + 0e0 AS y0, round(e2 - e0, 3) + 0e0 AS x2, round(n2 - n0, 3) + 0e0 AS y2, {high} AS height_m FROM p, (VALUES (0), (1)) AS v(part)"""


@_register("footprints", _footprint_sql())
def footprints(spark: SparkSession, d: str) -> DataFrame:
    """Buildings of two parts, the first with a hole; a third part of two points is no polygon."""
    b = view(spark, d, "buildings")
    at = lambda lat, lon: F.struct(F.col(lat).alias("lat"), F.col(lon).alias("lon"))
    ring = F.array(at("min_lat", "min_lon"), at("min_lat", "max_lon"), at("max_lat", "max_lon"), at("max_lat", "min_lon"))
    part = lambda r, holes: F.struct(r.alias("exterior"), holes.alias("interiors"))
    none = F.slice(F.array(ring), 1, 0)
    parts = F.array(part(ring, F.array(ring)), part(ring, none), part(F.slice(ring, 1, 2), none))
    prints = buildings.footprints(b.select("feature_id", "height", "levels", "kind", parts.alias("parts")), *_CENTER)
    corner = lambda i, c: (F.round(F.col("exterior")[i][c], 3) + 0.0).alias(f"{c}{i}")
    return prints.select("id", F.size("exterior").alias("corners"), F.size("interiors").alias("n_holes"), corner(0, "x"), corner(0, "y"), corner(2, "x"), corner(2, "y"), F.col("height").alias("height_m"))


def _shaped(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Buildings as rings with a quarter as a hole, and crops of 100 m around the stations."""
    at = lambda y, x: F.struct((F.col("min_lat") + y * (F.col("max_lat") - F.col("min_lat"))).alias("lat"), (F.col("min_lon") + x * (F.col("max_lon") - F.col("min_lon"))).alias("lon"))
    ring = lambda a, b: F.array(at(a, a), at(a, b), at(b, b), at(b, a))
    b = view(spark, d, "buildings").select("feature_id", ring(0.0, 1.0).alias("shape"), F.array(ring(0.25, 0.5)).alias("holes"))
    s = _sql(spark, d, f"SELECT s_suppkey AS crop_id, {u('s_suppkey', 1103515245, 12345)} * 0.012e0 + 41.82e0 AS lat, {u('s_suppkey', 1220703125, 54321)} * 0.014e0 + 12.46e0 AS lon FROM {{supplier}}")
    return b, s.withColumns(geo.box(F.col("lat"), F.col("lon"), F.lit(100.0))).drop("lat", "lon")


def _overlap(lo: str, hi: str) -> str:
    side = lambda c: f"greatest(least(b.min_{c} + {hi} * (b.max_{c} - b.min_{c}), c.max_{c}) - greatest(b.min_{c} + {lo} * (b.max_{c} - b.min_{c}), c.min_{c}), 0e0)"
    return f"{side('lat')} * {side('lon')}"


@_register("clipped_buildings", f"WITH {cte('buildings')}, c AS {_UE_BOX}, a AS (SELECT crop_id, feature_id, {_overlap('0e0', '1e0')} AS whole, {_overlap('0.25e0', '0.5e0')} AS hole FROM buildings b, c) SELECT crop_id, feature_id, round((whole - hole) * 1e12, 2) AS area FROM a WHERE whole * 1e12 > 1e-3")
def clipped_buildings(spark: SparkSession, d: str) -> DataFrame:
    """Area within each crop, in square microdegrees."""
    cut = buildings.clipped_features(*_shaped(spark, d), 0.001)
    return cut.filter("outline * 1e12 > 1e-3").select("crop_id", "feature_id", F.round(F.col("area") * 1e12, 2).alias("area"))


_ENTER = ", ".join(f"least((c.{a}_{k} - b.min_{k}) / (b.max_{k} - b.min_{k}), (c.{z}_{k} - b.min_{k}) / (b.max_{k} - b.min_{k}))" for k in ("lat", "lon") for a, z in [("min", "max")])
_LEAVE = _ENTER.replace("least(", "greatest(")


@_register("clipped_roads", f"WITH {cte('buildings')}, c AS {_UE_BOX}, a AS (SELECT crop_id, feature_id, b.max_lat - b.min_lat AS run, greatest(0e0, {_ENTER}) AS enter, least(1e0, {_LEAVE}) AS leave FROM buildings b, c) SELECT crop_id, feature_id, CAST(0 AS INTEGER) AS no, round((leave - enter) * run * 1e6, 4) AS rise FROM a WHERE leave > enter")
def clipped_roads(spark: SparkSession, d: str) -> DataFrame:
    """Diagonals of the buildings as roads: how far each climbs within a crop, in microdegrees."""
    features, boxes = _shaped(spark, d)
    roads = features.select("feature_id", F.array(F.get("shape", F.lit(0)), F.get("shape", F.lit(2))).alias("shape"))
    cut = buildings.clipped_roads(roads, boxes, 0.001)
    return cut.select("crop_id", "feature_id", F.col("no").cast("int").alias("no"), F.round((F.col("lat1") - F.col("lat0")) * 1e6, 4).alias("rise"))


@_register("ground_planes", f"{_BU}, {_TILES}, b AS (SELECT CAST({_PATCH} AS BIGINT) AS patch_idx, min(ue_idx) AS x0, max(ue_idx) AS x1 FROM ue WHERE ue_lat BETWEEN {BOX[0]}e0 AND {BOX[1]}e0 AND ue_lon BETWEEN {BOX[2]}e0 AND {BOX[3]}e0 GROUP BY ALL) SELECT patch_idx, triangle, CASE triangle WHEN 0 THEN 2 * (x1 + 10e0) + (x0 - 10e0) ELSE 2 * (x0 - 10e0) + (x1 + 10e0) END AS x_sum FROM b, (VALUES (0), (1)) AS v(triangle)")
def ground_planes(spark: SparkSession, d: str) -> DataFrame:
    _, ue = _bs_ue(spark, d)
    patch = region.patch_of(F.col("ue_lat"), F.col("ue_lon"), BOX, ROWS, COLUMNS).alias("patch_idx")
    tiles = ue.groupBy(patch).agg(F.min("ue_idx").cast("double").alias("x0"), F.max("ue_idx").cast("double").alias("x1")).filter("patch_idx IS NOT NULL")
    planes = region.ground_planes(tiles, F.col("x0"), F.col("x1"), F.col("x0"), F.col("x1"), 10.0)
    return planes.select("patch_idx", "triangle", (F.col("p.x") + F.col("q.x") + F.col("r.x")).alias("x_sum"))


@_register("geodesic_check", f"{_BU}, p AS (SELECT DISTINCT bs_lat, bs_lon, ue_lat, ue_lon, bs_idx, ue_idx FROM links l JOIN bs USING (bs_idx) JOIN ue USING (ue_idx)) SELECT bs_idx, ue_idx, round({og.haversine('bs_lat', 'bs_lon', 'ue_lat', 'ue_lon')}, 3) AS sphere_m FROM p")
def geodesic_check(spark: SparkSession, d: str) -> DataFrame:
    bs, ue = _bs_ue(spark, d)
    pairs = view(spark, d, "links").select("bs_idx", "ue_idx").distinct().join(bs, "bs_idx").join(ue, "ue_idx")
    return pairs.select("bs_idx", "ue_idx", F.round(geo.haversine(*map(F.col, ("bs_lat", "bs_lon", "ue_lat", "ue_lon"))), 3).alias("sphere_m"))


@_register("uniform_ues", f"WITH {cte('cells')} SELECT enode, CAST(range AS INTEGER) AS j, round(cell_lat + 0.002e0 * (2e0 * {og.uniform(5, chr(39) + 'lat' + chr(39), 'enode', 'range')} - 1e0), 7) AS ue_lat, round(cell_lon + 0.002e0 * (2e0 * {og.uniform(5, chr(39) + 'lon' + chr(39), 'enode', 'range')} - 1e0), 7) AS ue_lon FROM cells, range(10)")
def uniform_ues(spark: SparkSession, d: str) -> DataFrame:
    """Ten devices drawn about every cell."""
    made = links.drawn_near(view(spark, d, "cells"), "enode", "cell_lat", "cell_lon", 10, 0.002, 5)
    return made.select("enode", "j", F.round("ue_lat", 7).alias("ue_lat"), F.round("ue_lon", 7).alias("ue_lon"))
