"""What is written comes back, in the layout readers can prune."""

import os

from pyspark.sql import functions as F

from radiopos.operators import samples
from radiopos.sources import tables


def test_partitioned_writers(spark, tmp_path):
    d = str(tmp_path)
    crops = spark.range(20).select((F.col("id") % 3).alias("campaign_id"), F.col("id").alias("crop_id"), F.lit(1.0).alias("latitude"), F.lit(2.0).alias("longitude"))
    tables.write_crops(crops, f"{d}/crops")
    assert sorted(x for x in os.listdir(f"{d}/crops") if "=" in x) == [f"campaign_id={i}" for i in range(3)]
    assert spark.read.parquet(f"{d}/crops").count() == 20
    tables.write_splits(crops.withColumn("split", F.when(F.col("crop_id") < 5, "easy_test").otherwise("train")), f"{d}/splits")
    assert spark.read.parquet(f"{d}/splits").filter("split = 'easy_test'").count() == 5
    tables.write_predictions(crops.withColumns({"domain": F.lit("source"), "difficulty": F.col("campaign_id")}), f"{d}/pred")
    assert spark.read.parquet(f"{d}/pred").filter("difficulty = 1").count() == 7
    path = tables.write_filtered(crops, d, 41.87, 12.46)
    assert path.endswith("filtered_41.8700_12.4600") and spark.read.csv(path, header=True).count() == 20


def test_patch_results_replace_only_their_patches(spark, tmp_path):
    first = spark.createDataFrame([(0, 1.0), (1, 1.0)], "patch_idx int, v double")
    tables.write_patch_results(first, f"{tmp_path}/p")
    tables.write_patch_results(spark.createDataFrame([(1, 2.0)], "patch_idx int, v double"), f"{tmp_path}/p")
    assert {(r.patch_idx, r.v) for r in spark.read.parquet(f"{tmp_path}/p").collect()} == {(0, 1.0), (1, 2.0)}


def test_one_frequency_prunes_the_others(spark, tmp_path):
    rows = spark.range(12).select((F.col("id") % 3).cast("double").alias("freq"), F.col("id").alias("ue"))
    rows.write.partitionBy("freq").parquet(f"{tmp_path}/r")
    out = tables.read_path_responses(spark, f"{tmp_path}/r", 1.0)
    assert out.count() == 4
    assert "PartitionFilters: [isnotnull(freq" in out._jdf.queryExecution().toString()


def test_knn_predictions(spark, tmp_path):
    names = "Filename,Center_Lat,Center_Lon,X,Y,Original_UE_Lat,Original_UE_Lon,Reconstructed_Lat,Reconstructed_Lon"
    (tmp_path / "k.csv").write_text(f"{names},more\na,1,2,3,4,5,6,7,8,9\n")
    r = tables.read_knn_predictions(spark, f"{tmp_path}/k.csv").first()
    assert r.X == 3 and r.original_img_size is None and "more" not in r.asDict()


def test_subsample_and_capped_counts(spark):
    crops = spark.range(100).select((F.col("id") % 2).alias("campaign_id"), F.col("id").cast("string").alias("ue_id"))
    got = {r.campaign_id: r["count"] for r in samples.subsampled(crops, 0, 0.33, 1).groupBy("campaign_id").count().collect()}
    assert got == {0: 16, 1: 50}
    assert samples.subsampled(crops, 0, 0.0, 1).count() == 50
    assert samples.subsampled(crops, -1, 0.0, 1).count() == 100
