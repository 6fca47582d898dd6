"""Files, streams and predictions: what is bad is reported, what is half written is not read, what is replayed changes nothing."""

import json
import os
import random

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F


from radiopos.operators import buildings, crops, raster, scoring, splits
from radiopos.sources import tables
from radiopos.streaming import patches

LAYER = [(1, [(41.0, 12.0), (41.1, 12.0), (41.1, 12.1)], [], "3", None, "house")]


def test_a_killed_writer_leaves_no_layer(spark, tmp_path):
    path = tables.layer_path(str(tmp_path), (41.9, 41.8, 12.5, 12.4), "buildings")
    source = spark.createDataFrame(LAYER, tables.LAYER)
    with pytest.raises(AnalysisException):
        tables.read_layer(spark, path)
    # a version that was never named, and a `current` that was begun only
    source.union(source).write.parquet(f"{path}/version-dead")
    os.makedirs(f"{path}/current/_temporary")
    with pytest.raises(ValueError):
        tables.read_layer(spark, path)
    assert tables.read_layer(spark, path, source).count() == 1
    assert tables.read_layer(spark, path, source.union(source)).count() == 1  # kept, not made again
    assert tables.read_layer(spark, path).first().kind == "house"


def test_layers_are_kept_by_area(spark):
    from radiopos.operators import region

    bounds = (41.9, 41.8, 12.5, 12.4)
    named = spark.range(1).select(region.area_id(*map(F.lit, bounds)).alias("id")).first().id
    assert tables.layer_path("/x", bounds, "roads") == f"/x/{named}/roads"


def test_bad_files_are_reported(spark, tmp_path):
    folder = tmp_path / "crops" / "3" / "41p8_12p4"
    folder.mkdir(parents=True)
    texts = {"a": json.dumps({"campaign_id": 3, "BaseStations": []}), "b": "{oops", "c": "", "d": "[1, 2]", "e": json.dumps({"campaign_id": 4}), "f": "{}", "g": json.dumps({"BaseStations": "none"})}
    for name, text in texts.items():
        (folder / f"{name}.json").write_text(text)
    good, bad = tables.crop_files(spark, str(tmp_path / "crops"))
    assert [(r.campaign, r.ue_id, r.crop_id) for r in good.collect()] == [("3", "41p8_12p4", "a")]
    got = {r.path[-6]: (r.reason, r.raw) for r in bad.collect()}
    # Spark's readers have no row for the empty file c
    assert set(got) == set("bdefg") and all(got[k][1] == texts[k] for k in got)
    assert got["e"][0] == "no BaseStations" and got["f"][0] == "no document"
    tables.write_bad(bad, f"{tmp_path}/bad")
    tables.write_bad(bad.limit(1), f"{tmp_path}/bad")
    assert spark.read.parquet(f"{tmp_path}/bad").count() == 6
    (tmp_path / "parameters").mkdir()
    (tmp_path / "parameters" / "corrected_bs_4_result.json").write_text('{"best_parameters": {"latitude": 1.0, "longitude": 2.0}}')
    (tmp_path / "parameters" / "corrected_z_result.json").write_text("{broken")
    good, bad = tables.parameter_files(spark, f"{tmp_path}/parameters")
    assert good.first().bs_idx == 4 and [r.raw for r in bad.collect()] == ["{broken"]


def test_documents_come_back_in_files_of_bounded_size(spark, tmp_path):
    station = [(1, 7, 2, 41.9, 12.5, 10.0, 20.0, (-70.0, None, 1.0, 2.0), False), (2, 7, 2, None, 12.5, 10.0, 20.0, None, True)]
    rows = [(i, 41.8 + i * 1e-4, 12.4, 41.8, 12.4, 300, 5, 1.5, 2.5, station if i % 3 else []) for i in range(50)]
    bs = "array<struct<enode:long,mnc:int,npci:int,cell_lat:double,cell_lon:double,bs_y:double,bs_x:double,measurements:struct<rssi:double,nsinr:double,nrsrp:double,nrsrq:double>,interpolated:boolean>>"
    made = spark.createDataFrame(rows, f"crop_id long, latitude double, longitude double, center_lat double, center_lon double, half int, campaign_id int, ue_y double, ue_x double, base_stations {bs}")
    docs = crops.to_documents(made)
    tables.write_documents(docs, f"{tmp_path}/docs", rows_per_file=8)
    files = [f for f in os.listdir(f"{tmp_path}/docs/of_campaign=5") if f.startswith("part")]
    assert len(files) >= 7
    good, bad = tables.read_documents(spark, f"{tmp_path}/docs")
    assert bad.isEmpty() and good.count() == 50
    want = docs.select(*good.columns)
    assert sorted(map(repr, good.collect())) == sorted(map(repr, want.collect()))
    flat = crops.from_documents(good).filter("crop_id = '4'").orderBy("enode").collect()
    assert [(r.enode, r.rssi, r.cell_lat, r.interpolated, r.ue_x) for r in flat] == [(1, -70.0, 41.9, False, 2.5), (2, None, None, True, 2.5)]
    assert {r.num_bs for r in crops.documents_index(good).collect()} == {0, 1}


def test_the_ledger_knows_empty_patches_and_replays(spark, tmp_path):
    source, sink = f"{tmp_path}/in", f"{tmp_path}/out"
    header = lambda p: (p, None, None, None, None)
    files = {0: [header(0), (0, 1, 1, 1e-5, 0.0), (0, 2, 1, None, 0.0), (0, 3, 1, float("nan"), 0.0)], 1: [header(1)], 2: [(2, 1, 1, 2e-5, 0.0)]}
    for rows in files.values():
        spark.createDataFrame(rows, patches.PATHS).coalesce(1).write.mode("append").parquet(source)
    patches.run_available(spark, source, sink, f"{tmp_path}/mark", files_per_batch=1)
    ledger = lambda: sorted((r.patch_idx, r.saved, r.failed, r.batch) for r in patches.read_ledger(spark, f"{sink}-ledger").collect())
    first = ledger()
    assert [r[:3] for r in first] == [(0, 1, 2), (1, 0, 0), (2, 1, 0)]
    assert tuple(patches.progress(patches.read_ledger(spark, f"{sink}-ledger")).first()) == (2, 2, 2)
    results = sorted(os.listdir(f"{sink}/patch_idx=0"))
    # all files again under a new checkpoint, with a new one
    spark.createDataFrame([header(9), (9, 5, 5, 1e-5, 0.0)], patches.PATHS).coalesce(1).write.mode("append").parquet(source)
    patches.run_available(spark, source, sink, f"{tmp_path}/other", files_per_batch=2)
    assert [r for r in ledger() if r[0] < 9] == first and ledger()[-1][:3] == (9, 1, 0)
    assert sorted(os.listdir(f"{sink}/patch_idx=0")) == results
    # a batch whose results were written but not its ledger rows is written again, once
    batch = spark.createDataFrame([header(11), (11, 1, 1, 1e-5, 0.0)], patches.PATHS)
    tables.write_patch_results(patches.patch_metrics(batch.filter("rx IS NOT NULL")).withColumn("rx", F.lit(99).cast("long")), sink)
    patches.commit(batch, 7, sink, f"{sink}-ledger")
    assert [r.rx for r in spark.read.parquet(sink).filter("patch_idx = 11").collect()] == [1]
    assert patches.progress(patches.read_ledger(spark, f"{tmp_path}/none")).first().last_completed_patch == -1


def test_predictions_carry_truth_and_one_model_a_worker(spark, tmp_path):
    rows = [(i, 1.0 * i, 2.0, 400.0, 41.8, 12.4, "target", "abc"[i % 3], [float(i)] * 2, "x") for i in range(90)]
    samples = spark.createDataFrame(rows, "crop_id long, ue_y double, ue_x double, original_img_size double, center_lat double, center_lon double, domain string, difficulty string, v array<float>, more string").repartition(6)
    loads = f"{tmp_path}/loads"
    os.makedirs(loads)

    def model():
        with open(f"{loads}/{os.getpid()}", "a") as f:
            f.write("x")
        return lambda b: np.array([[v[0], v[1], 0.0, 1.0] for v in b["v"]]).reshape(len(b), 4)

    got = scoring.score_to(samples, model, ["v"], f"{tmp_path}/p", ["a", "b"]).collect()
    assert len(got) == 60 and all(r.heatmap == [r.ue_y, r.ue_y, 0.0, 1.0] and r.crop_id == r.ue_y for r in got)
    assert sorted(d for d in os.listdir(f"{tmp_path}/p/domain=target") if "=" in d) == ["difficulty=a", "difficulty=b"]
    assert all(os.path.getsize(f"{loads}/{f}") == 1 for f in os.listdir(loads))
    with pytest.raises(Exception, match="heat maps"):
        scoring.predictions(samples, lambda: lambda b: np.zeros((1, 4)), ["v"]).collect()


@pytest.mark.parametrize("cell", [0.01, 0.3])
def test_boxes_that_meet_any(spark, cell):
    rng = random.Random(3)
    box = lambda i, n: (lambda y, x, h, w: (i, y, y + h, x, x + w))(rng.uniform(0, n), rng.uniform(0, n), rng.choice([0.0, 0.02, 0.3]), rng.choice([0.01, 0.2]))
    mine, others = [box(i, 2) for i in range(150)], [box(i, 1.5) for i in range(40)] + [(99, 0.5, 0.5, 0.5, 0.5)]
    schema = "crop_id long, min_lat double, max_lat double, min_lon double, max_lon double"
    got = {r.crop_id for r in buildings.meets_any(spark.createDataFrame(mine, schema), spark.createDataFrame(others, schema), cell=cell).collect()}
    assert got == {m[0] for m in mine if any(m[1] <= o[2] and o[1] <= m[2] and m[3] <= o[4] and o[3] <= m[4] for o in others)}
    assert buildings.meets_any(spark.createDataFrame(mine, schema), spark.createDataFrame([], schema)).isEmpty()


def test_train_crops_that_see_held_out_crops_go(spark):
    at = lambda i, s, m: (i, s, 41.8 + m / 111_000, 12.4, 100)
    rows = [at(1, "train", 0), at(2, "hard_test", 150), at(3, "train", 600), at(4, "easy_val", 900), at(5, "train", 2000), at(2, "train", 5000)]
    out = splits.without_held_out_crops(spark.createDataFrame(rows, "crop_id int, split string, center_lat double, center_lon double, half int"))
    assert sorted((r.crop_id, r.split) for r in out.collect()) == [(2, "hard_test"), (2, "train"), (3, "train"), (4, "easy_val"), (5, "train")]


def test_map_of_a_square_and_a_road(spark):
    """A 20 m square north-east of the centre with a 10 m courtyard, and a road along the crop's west-east line that goes
    beyond the crop."""
    lat, lon = 41.8, 12.4
    d_lat, d_lon = 1 / 111_072.0, 1 / 83_000.0
    ring = lambda lo, hi: [(lat + y * d_lat, lon + x * d_lon) for y, x in ((lo, lo), (lo, hi), (hi, hi), (hi, lo))]
    houses = spark.createDataFrame([(1, ring(20, 40), [ring(25, 35)], None, None, None), (2, ring(900, 950), [], None, None, None)], tables.LAYER)
    roads = spark.createDataFrame([(1, [(lat, lon - 500 * d_lon), (lat, lon + 500 * d_lon)], [], None, None, None)], tables.LAYER)
    centre = spark.createDataFrame([(5, lat, lon, 50), (6, lat + 1, lon, 50)], "crop_id int, center_lat double, center_lon double, half int")
    got = raster.map_pixels(houses, roads, centre).collect()
    assert {r.crop_id for r in got} == {5}
    house, road = ([(r.y, r.x) for r in got if getattr(r, c)] for c in ("building", "road"))
    assert len(house) == pytest.approx(20 * 20 - 10 * 10, abs=25)
    assert all(10 <= y <= 30 and 70 <= x <= 90 for y, x in house) and (20, 80) not in house
    assert len(road) == pytest.approx(4 * 101, abs=8) and {x for _, x in road} >= set(range(100)) and all(47 <= y <= 52 for y, _ in road)
