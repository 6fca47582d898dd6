"""Readers and writers. Schemas are explicit; a file missing required columns is an error that names them."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import radio
from ..staging import stage

LINKS_REQUIRED = ("BSLatitude", "BSLongitude", "UELatitude", "UELongitude", "RSSI", "NSINR", "NRSRP", "NRSRQ")
SIM_LINKS = "bs_idx int, ue_id int, bs_lat double, bs_lon double, bs_alt double, bs_azimuth double, ue_lat double, ue_lon double, distance_m double, bearing_rad double, sim_rssi double, sim_nsinr double, sim_nrsrp double, sim_nrsrq double"
CROP = (
    "campaign_id int, center_coord struct<lat:double,lon:double>, half_square_size_meters int, UE struct<lat_lon:array<double>,proj_map_pos:array<double>>, "
    "BaseStations array<struct<npci:int,enode:long,mnc:int,lat_lon:array<double>,proj_map_pos:array<double>,measurements:struct<RSSI:double,NSINR:double,NRSRP:double,NRSRQ:double,ToA:double,bs_power_dbm:double>,interpolated:boolean>>"
)
INDEX = "map<string,map<string,map<string,int>>>"
PARAMETERS = "best_parameters struct<latitude:double,longitude:double,altitude:double,azimuth:double>, latitude double, longitude double, altitude double, azimuth double, bs_idx int, target_bs_idx int"


def require(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"columns are missing: {missing}")
    return df


def read_cells(spark: SparkSession, path: str, id_column: str = "eNodeBID", fmt: str = "csv") -> DataFrame:
    """The cell inventory: cell number from the name, station, operator and position."""
    raw = spark.read.format(fmt).options(header=True).load(path)
    require(raw, ("Name", id_column, "Latitude", "Longitude", "MNC"))
    number = lambda c, t: F.col(c).try_cast(t)
    return raw.select(radio.cell_number(F.col("Name")).alias("npci"), number(id_column, "long").alias("enode"), number("MNC", "int").alias("mnc"), number("Latitude", "double").alias("cell_lat"), number("Longitude", "double").alias("cell_lon"))


def read_sim_links(spark: SparkSession, path: str) -> DataFrame:
    """Simulated links under the names of measurements; transmit power is 0 where the file has none."""
    raw = spark.read.options(header=True, inferSchema=False).csv(path)
    require(raw, ("bs_idx", "ue_id", "bs_lat", "bs_lon", "ue_lat", "ue_lon", "sim_rssi", "sim_nsinr", "sim_nrsrp", "sim_nrsrq"))
    power = F.col("bs_power_dbm").cast("double") if "bs_power_dbm" in raw.columns else F.lit(0.0)
    renamed = {"ue_lat": "latitude", "ue_lon": "longitude", "bs_lat": "cell_lat", "bs_lon": "cell_lon", "sim_rssi": "rssi", "sim_nsinr": "nsinr", "sim_nrsrp": "nrsrp", "sim_nrsrq": "nrsrq"}
    columns = [F.col(a).cast("double").alias(b) for a, b in renamed.items()]
    fixed = (F.lit(-1).alias("npci"), F.lit(-1).alias("mnc"), F.lit(0).alias("campaign_id"), F.lit(-1.0).alias("toa"), F.lit(False).alias("interpolated"))
    return raw.select(F.col("bs_idx").cast("int").alias("enode"), *columns, power.alias("bs_power_dbm"), *fixed)


def _numbers(raw: DataFrame, texts: tuple[str, ...] = ()) -> DataFrame:
    """Columns of a CSV, read as text, as numbers, but for those in `texts`; nothing is read to guess types."""
    return raw.select(*(F.col(f"`{c}`") if c in texts else F.col(f"`{c}`").try_cast("double").alias(c) for c in raw.columns))


def read_links(spark: SparkSession, path: str) -> DataFrame:
    """Measured links with location keys, derived where the file has none."""
    raw = require(spark.read.options(header=True).csv(path), LINKS_REQUIRED)
    return with_location_keys(_numbers(raw, ("BS_location", "UE_location")))


def with_location_keys(links: DataFrame) -> DataFrame:
    for name, lat, lon in (("BS_location", "BSLatitude", "BSLongitude"), ("UE_location", "UELatitude", "UELongitude")):
        if name not in links.columns:
            links = links.withColumn(name, radio.location_key(F.col(lat), F.col(lon)))
    return links


def read_passive(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of numbers whose first column is an unnamed index."""
    raw = spark.read.options(header=True).csv(path)
    return _numbers(raw.drop(raw.columns[0]))


def parameter_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(good, bad) station parameters of corrected_*_result.json files, a document each."""
    raw = spark.read.options(wholetext=True, pathGlobFilter="corrected_*_result.json").text(path)
    good, bad = checked(raw.select(F.col("_metadata.file_path").alias("path"), "value"), PARAMETERS, ())
    pick = lambda c: F.coalesce(F.col(f"best_parameters.{c}"), F.col(c))
    in_name = F.nullif(F.regexp_extract(_numbered(-1), r"bs_(\d+)", 1), F.lit("")).try_cast("int")
    columns = [pick("latitude").alias("latitude"), pick("longitude").alias("longitude"), F.coalesce(pick("altitude"), F.lit(30.0)).alias("altitude"), F.coalesce(pick("azimuth"), F.lit(0.0)).alias("azimuth")]
    return good.select(F.coalesce("bs_idx", "target_bs_idx", in_name).alias("bs_idx"), *columns), bad


def read_best_parameters(spark: SparkSession, path: str) -> DataFrame:
    """Station parameters of corrected_*_result.json files; unreadable files are skipped, an empty result is an error."""
    out = parameter_files(spark, path)[0]
    if not out.head(1):
        raise ValueError(f"no readable corrected_*_result.json under {path}")
    return out.orderBy("bs_idx")


#: A crop document with the place it has among documents, as write_documents leaves it, one a line.
DOCUMENT = "campaign string, ue_id string, crop_id string, " + CROP
_NEEDED = ("campaign", "ue_id", "crop_id", "center_coord", "half_square_size_meters", "UE", "BaseStations")


def checked(raw: DataFrame, schema: str, needed: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """raw: path and value, a JSON text. (good, bad): the documents with their path, and path, reason and value of those that
    are no JSON objects of the schema or lack a needed field. Texts are parsed once, into a written table both read."""
    parsed = F.from_json("value", f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE"})
    doc = raw.select("path", "value", parsed.alias("doc"))
    names = [f.name for f in doc.schema["doc"].dataType.fields if f.name != "_corrupt_record"]
    empty = F.lit(True)
    for n in names:
        empty &= F.col(f"doc.{n}").isNull()
    reason = F.when(F.col("doc").isNull() | F.col("doc._corrupt_record").isNotNull(), "not JSON of the schema").when(empty, "no document")
    for n in needed:
        reason = reason.when(F.col(f"doc.{n}").isNull(), f"no {n}")
    told = stage(doc.select("path", "doc", reason.alias("reason"), F.when(reason.isNotNull(), F.col("value")).alias("raw")), "checked-documents")
    good = told.filter("reason IS NULL").select("path", *(F.col(f"doc.{n}") for n in names))
    return good, told.filter("reason IS NOT NULL").select("path", "reason", "raw")


def write_bad(bad: DataFrame, path: str) -> None:
    """Appends what could not be read to a table of path, reason and raw, by reason."""
    bad.write.mode("append").partitionBy("reason").parquet(path)


def _numbered(part: int) -> Column:
    return F.try_element_at(F.split("path", "/"), F.lit(part))


def crop_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(good, bad) crop documents, a file each, with (campaign, ue_id, crop_id) from the last parts of their path.
    A file of no bytes is in neither, as Spark's readers pass over it."""
    raw = spark.read.options(wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json").text(path)
    good, bad = checked(raw.select(F.col("_metadata.file_path").alias("path"), "value"), CROP, ("BaseStations",))
    return good.select(_numbered(-3).alias("campaign"), _numbered(-2).alias("ue_id"), F.regexp_replace(_numbered(-1), r"\.[^.]*$", "").alias("crop_id"), *good.columns[1:]), bad


def read_crops(spark: SparkSession, path: str) -> DataFrame:
    """Crop documents, a file each; crop_files has the bad ones too."""
    return crop_files(spark, path)[0]


def read_documents(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(good, bad) crop documents of write_documents; the path of a bad one is its file's."""
    raw = spark.read.option("recursiveFileLookup", True).text(path)
    good, bad = checked(raw.select(F.col("_metadata.file_path").alias("path"), "value"), DOCUMENT, _NEEDED)
    return good.drop("path"), bad


def write_documents(documents: DataFrame, path: str, rows_per_file: int = 20_000) -> None:
    """Crop documents (DOCUMENT) as JSON lines by campaign. Files hold ranges of UEs, at most rows_per_file documents each,
    however many a campaign has, compressed; read_documents reads them back."""
    fields = [f.name for f in _schema(documents, DOCUMENT).fields]
    line = documents.select("campaign", "ue_id", "crop_id", F.to_json(F.struct(*fields)).alias("value"))
    ordered = line.repartitionByRange("campaign", "ue_id", "crop_id").sortWithinPartitions("campaign", "ue_id", "crop_id")
    ordered.select(F.col("campaign").alias("of_campaign"), "value").write.mode("overwrite").options(maxRecordsPerFile=rows_per_file, compression="gzip").partitionBy("of_campaign").text(path)


def _schema(documents: DataFrame, schema: str) -> StructType:
    """The schema, whose columns the table must have."""
    wanted = StructType.fromDDL(schema)
    require(documents, tuple(f.name for f in wanted.fields))
    return wanted


def read_index(spark: SparkSession, paths: list[str], lines: bool = False) -> DataFrame:
    """Nested index maps of several datasets: dataset_idx, campaign_id, ue_id, crop_id, num_bs. A file is one document,
    or has one a line, as write_index writes them."""
    out = None
    for i, path in enumerate(paths):
        nested = spark.read.option("wholetext", not lines).text(path).select(F.from_json("value", INDEX).alias("m"))
        flat = nested.select(F.explode("m").alias("campaign_id", "ues")).select("campaign_id", F.explode("ues").alias("ue_id", "crops")).select(F.lit(i).alias("dataset_idx"), "campaign_id", "ue_id", F.explode("crops").alias("crop_id", "num_bs"))
        out = flat if out is None else out.unionByName(flat)
    return out


def read_knn_predictions(spark: SparkSession, path: str) -> DataFrame:
    raw = _numbers(spark.read.options(header=True).csv(path), ("Filename",))
    names = ("Filename", "Center_Lat", "Center_Lon", "X", "Y", "Original_UE_Lat", "Original_UE_Lon", "Reconstructed_Lat", "Reconstructed_Lon")
    empty = {c: F.lit(None).cast("double") for c in ("out", "original_img_size", "ue_loc_y", "ue_loc_x")}
    return require(raw, names).select(*names).withColumns(empty)


PREDICTIONS = "crop_id long, heatmap array<float>, ue_y double, ue_x double, original_img_size double, center_lat double, center_lon double, domain string, difficulty string"


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Predictions as write_predictions left them. Only the asked domains and difficulties are opened where they are
    filtered; a table has no order of files, so what needs one sorts by crop_id."""
    return spark.read.schema(PREDICTIONS).parquet(path)


#: Layers: rings or lines of (lat, lon).
LAYER = "feature_id long, shape array<struct<lat:double,lon:double>>, holes array<array<struct<lat:double,lon:double>>>, height string, levels string, kind string"


def layer_path(folder: str, bounds: tuple[float, float, float, float], name: str) -> str:
    """Where a layer of an area is kept: by the md5 of the bounds, as region.area_id has it."""
    text = "_".join(f"{b:.6f}" for b in bounds)
    return f"{folder}/{hashlib.md5(text.encode(), usedforsecurity=False).hexdigest()[:12]}/{name}"


def _current(spark: SparkSession, path: str, must: bool) -> str | None:
    """The version of a layer that was written to its end, if there is one; `must` raises Spark's error if there is nothing."""
    try:
        named = spark.read.text(f"{path}/current").head(1)
    except AnalysisException as e:
        if must or e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return f"{path}/{named[0].value}" if named else None


def read_layer(spark: SparkSession, path: str, source: DataFrame | None = None) -> DataFrame:
    """A building or road layer (LAYER) kept at path. Where there is none it is made from `source` and kept there: as a version
    of its own that `current` names once it is whole, so what a killed writer left is never read."""
    version = _current(spark, path, source is None)
    if version is None:
        if source is None:
            raise ValueError(f"no whole layer at {path}")
        name = f"version-{uuid.uuid4().hex}"
        whole = [n.split(" ")[0] for n in LAYER.split(", ")]
        source.select(*whole).write.parquet(f"{path}/{name}")
        spark.createDataFrame([(name,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/current")
        version = f"{path}/{name}"
    return spark.read.schema(LAYER).parquet(version)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """The pair table of write_patch_results; an empty one is an error, as nothing can follow from it."""
    pairs = spark.read.parquet(path)
    if not pairs.head(1):
        raise ValueError(f"no pairs under {path}")
    return pairs


def read_path_responses(spark: SparkSession, path: str, freq: float) -> DataFrame:
    """One frequency of responses written with partitionBy("freq"): other partitions are not opened."""
    return spark.read.parquet(path).filter(F.col("freq") == freq)


def write_measurements(cleaned: DataFrame, path: str) -> None:
    """The cleaned measurement table, by campaign."""
    cleaned.write.mode("overwrite").partitionBy("campaign_id").parquet(path)


def read_measurements(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_index(index_map: DataFrame, path: str) -> None:
    """The documents of crops.index_map, one a line."""
    index_map.select(F.col("document").alias("value")).write.mode("overwrite").text(path)


def write_crops(crops: DataFrame, path: str) -> None:
    """One table by campaign, sorted by UE: a folder a UE would be too many files. A large campaign is several ranges."""
    crops.repartitionByRange("campaign_id", "latitude", "longitude").sortWithinPartitions("campaign_id", "latitude", "longitude").write.mode("overwrite").partitionBy("campaign_id").parquet(path)


def write_splits(splits: DataFrame, path: str) -> None:
    splits.write.mode("overwrite").partitionBy("split").parquet(path)


def write_predictions(predictions: DataFrame, path: str) -> None:
    predictions.write.mode("overwrite").partitionBy("domain", "difficulty").parquet(path)


def write_filtered(links: DataFrame, folder: str, center_lat: float, center_lon: float) -> str:
    """A CSV folder named after the region's centre."""
    path = f"{folder}/filtered_{center_lat:.4f}_{center_lon:.4f}"
    links.write.mode("overwrite").options(header=True).csv(path)
    return path


def write_patch_results(results: DataFrame, path: str) -> None:
    """Replaces the patches in results and leaves the others: safe to run again after a failure."""
    results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("patch_idx").parquet(path)
