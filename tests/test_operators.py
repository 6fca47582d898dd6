"""Operators on small literal tables."""

import json
import math

import pytest
from pyspark.sql import functions as F

from radiopos.functions import geo
from radiopos.operators import buildings, calibrate, crops, evaluate, links, measurements, numbering, raster, region, samples, scoring, splits
from radiopos.sources import tables
from radiopos.streaming import patches


@pytest.mark.parametrize("share", [0, 0.1, 0.01, 0.5, 1])
def test_split_sizes(spark, share):
    sizes = (1, 2, 10, 99, 100, 101)
    rows = [(n, i) for n in sizes for i in range(n)]
    drawn = splits.draw(spark.createDataFrame(rows, "g int, k int"), ["g"], "k", share, 0)
    got = {r.g: r.n for r in drawn.groupBy("g").agg(F.count_if("second").alias("n")).collect()}
    for n in sizes:
        want = 0 if share == 0 else n if share == 1 else 0 if n == 1 else min(math.ceil(share * n), n - 1)
        assert got[n] == want


def test_share_is_checked(spark):
    with pytest.raises(ValueError):
        splits.second_side(1.5, F.lit(3))


def test_splits_cover_and_do_not_leak(spark):
    ix = spark.range(4000).select((F.col("id") % 3).alias("campaign_id"), (F.col("id") / 7).cast("int").cast("string").alias("ue_id"), F.col("id").alias("crop_id"), (41.82 + (F.col("id") / 7).cast("int") % 100 * 1e-4).alias("latitude"), F.lit(12.461).alias("longitude"))
    test, val = geo.literals(41.82, 41.823, 12.46, 12.464), geo.literals(41.823, 41.826, 12.46, 12.464)
    out = splits.split_index(ix, test, val, 0.9, 0.5, 0.5, 0)
    assert out.count() == 4000 and out.select("crop_id").distinct().count() == 4000
    assert {r[0] for r in out.select("split").distinct().collect()} == set(splits.SPLITS)
    again = splits.split_index(ix.repartition(9), test, val, 0.9, 0.5, 0.5, 0)
    assert out.select("crop_id", "split").exceptAll(again.select("crop_id", "split")).isEmpty()
    medium = out.filter("split LIKE 'medium%'").select("campaign_id", "ue_id").distinct()
    assert medium.join(out.filter("split = 'train'"), ["campaign_id", "ue_id"], "left_semi").isEmpty()
    train = out.filter("split = 'train'").withColumns({"center_lat": F.col("latitude"), "center_lon": F.col("longitude"), "half": F.lit(50)})
    kept = splits.without_overlap(train, test, val, F.col("half"), 50).withColumns(geo.box(F.col("center_lat"), F.col("center_lon"), F.lit(50.0)))
    assert 0 < kept.count() < train.count()
    assert kept.filter(geo.meets(geo.named(), test) | geo.meets(geo.named(), val)).isEmpty()


def test_dense_numbers(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k"))
    got = numbering.dense(df, "no", "k").orderBy("k").collect()
    assert [r.no for r in got] == list(range(1000))


def test_half_sizes(spark):
    out = crops.half_sizes(spark.range(500).withColumnRenamed("id", "crop_id"), 300, 100, 200, 400, 1)
    r = out.agg(F.min("half"), F.max("half"), F.count_distinct("half"), F.avg("half")).first()
    assert r[0] >= 200 and r[1] <= 400 and r[2] > 50 and r[3] == pytest.approx(300, abs=12)


def test_index_map_round_trip(spark, tmp_path):
    rows = [(1, "a", 10, 2), (1, "a", 11, 0), (1, "b", 12, 5), (2, "c", 13, 1)]
    out = crops.index_map(spark.createDataFrame(rows, "campaign_id int, ue_id string, crop_id int, num_bs int"))
    assert {r.document for r in out.collect()} == {'{"1":{"a":{"10":2,"11":0}}}', '{"1":{"b":{"12":5}}}', '{"2":{"c":{"13":1}}}'}
    tables.write_index(out, f"{tmp_path}/index")
    back = tables.read_index(spark, [f"{tmp_path}/index"], lines=True).collect()
    assert sorted((int(r.campaign_id), r.ue_id, int(r.crop_id), r.num_bs) for r in back) == rows


def test_ranks_within_groups(spark):
    """A group with nearly all rows, ties, and groups of one row."""
    import random

    rng = random.Random(2)
    rows = [("hot", i, float(rng.randint(0, 40))) for i in range(3000)] + [("b", i, 1.0) for i in range(5)] + [("c", 0, 2.0)]
    df = spark.createDataFrame(rows, "g string, k int, v double").repartition(7)
    got = {(r.g, r.k): r.no for r in numbering.within(df, "no", ["g"], "v", "k").collect()}
    for g in ("hot", "b", "c"):
        order = sorted((v, k) for h, k, v in rows if h == g)
        assert [got[g, k] for _, k in order] == list(range(len(order)))
    counts = df.groupBy("g", "v").count()
    ranks = {(r.g, r.v): r.r for r in calibrate.average_ranks(counts, ["g"], "v", "count", "r").collect()}
    for (g, v), r in ranks.items():
        below, same = (sum(h == g and (w < v if k else w == v) for h, _, w in rows) for k in (1, 0))
        assert r == below + (same + 1) / 2
    drawn = numbering.drawn(df, ["g"], "k", 3).collect()
    assert sorted(r._rank for r in drawn if r.g == "hot") == list(range(1, 3001)) and {r._size for r in drawn if r.g == "b"} == {5}


def test_least_so_far(spark):
    """A group with nearly all rows, a null group, null values and one row alone."""
    import random

    rng = random.Random(4)
    rows = [("hot", i, rng.choice([None, rng.randint(0, 10**6)])) for i in range(2000)] + [(None, i, 50 - i) for i in range(5)] + [("c", 0, None)]
    got = {(r.g, r.k): r.low for r in numbering.least_so_far(spark.createDataFrame(rows, "g string, k int, v int").repartition(5), "low", "v", ["g"], "k").collect()}
    assert len(got) == len(rows)
    now = {}
    for g, k, v in rows:
        now[g] = min((x for x in (now.get(g), v) if x is not None), default=None)
        assert got[g, k] == now[g]


def test_every_pair_in_blocks(spark):
    left, right = spark.range(50).toDF("a"), spark.range(23).toDF("b")
    assert sorted(map(tuple, links.every_pair(left, right, block=4).collect())) == [(a, b) for a in range(50) for b in range(23)]
    assert links.every_pair(left, right).count() == 1150 and links.every_pair(left, right.limit(0)).count() == 0


def test_observed_rows_win(spark):
    rows = [(1.0, 1, True, -5.0), (1.0, 1, False, -9.0), (1.0, 1, False, -8.0), (2.0, None, True, -1.0)]
    df = spark.createDataFrame(rows, "latitude double, enode int, interpolated boolean, rssi double")
    out = measurements.deduplicate(df, ("latitude", "enode"), ("rssi",))
    assert out.columns == df.columns and sorted(map(tuple, out.collect())) == [(1.0, 1, False, -9.0), (2.0, None, True, -1.0)]


def test_clipped_rings_have_the_area_of_their_pixels(spark):
    import random

    rng = random.Random(5)
    ring = "array<struct<lat:double,lon:double>>"
    rows = []
    for i in range(40):  # star-shaped about a point, in a box of 40 x 40
        cy, cx, n = rng.uniform(5, 35), rng.uniform(5, 35), rng.randint(3, 9)
        angles = [2 * math.pi * (k + rng.uniform(0, 0.4)) / n for k in range(n)]
        rows.append((i, [(cy + r * math.sin(a), cx + r * math.cos(a)) for a, r in ((a, rng.uniform(2, 18)) for a in angles)], []))
    box = {"min_lat": 10.0, "max_lat": 30.0, "min_lon": 12.0, "max_lon": 33.0}
    cropped = spark.createDataFrame([(1, *box.values())], f"crop_id int, {', '.join(f'{k} double' for k in box)}")
    out = buildings.clipped_features(spark.createDataFrame(rows, f"feature_id long, shape {ring}, holes array<{ring}>"), cropped, 7.0)
    got = {r.feature_id: r.area for r in out.select("feature_id", buildings.ring_area(F.col("shape")).alias("area")).collect()}

    def inside(y, x, pts):
        hits = sum((p[0] > y) != (q[0] > y) and x < p[1] + (y - p[0]) * (q[1] - p[1]) / (q[0] - p[0]) for p, q in zip(pts, pts[1:] + pts[:1], strict=True))
        return hits % 2 == 1

    for i, pts, _ in rows:
        step = 0.25
        cells = sum(inside(10 + step * (a + 0.5), 12 + step * (b + 0.5), pts) for a in range(80) for b in range(84))
        assert got.get(i, 0.0) == pytest.approx(cells * step * step, abs=1.5)


def test_clipping_keeps_holes_and_copies_no_expression(spark):
    ring = "array<struct<lat:double,lon:double>>"
    square = lambda a, b: [(a, a), (a, b), (b, b), (b, a)]
    box = spark.createDataFrame([(5, 1.0, 5.0, 1.0, 5.0)], "crop_id int, min_lat double, max_lat double, min_lon double, max_lon double")
    rows = [(1, square(2.0, 4.0), [square(2.5, 3.0)]), (2, square(3.0, 7.0), [square(4.0, 6.0), square(6.0, 6.5)]), (3, square(0.0, 9.0), None), (4, square(6.0, 7.0), [])]
    rows += [(5, [(2.0, 2.0), (3.0, 3.0)], []), (6, [], []), (7, [(0.0, 4.0), (2.0, 6.0), (6.0, 6.0), (6.0, 0.0), (0.0, 0.0)], [])]
    out = buildings.clipped_features(spark.createDataFrame(rows, f"feature_id long, shape {ring}, holes array<{ring}>"), box, 2.0)
    got = {r.feature_id: (r.outline, r.area, len(r.holes)) for r in out.collect()}
    assert got == {1: (4.0, 3.75, 1), 2: (4.0, 3.0, 1), 3: (16.0, 16.0, 0), 7: (16.0, 16.0, 0)}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("zip_with") <= 10


def test_roads_are_cut_at_the_box(spark):
    line = [(0.0, 0.0), (4.0, 4.0), (4.0, 9.0), (9.0, 9.0)]
    roads = spark.createDataFrame([(1, line), (2, [(0.0, 0.0)]), (3, [(9.5, 0.0), (9.5, 2.0)])], "feature_id long, shape array<struct<lat:double,lon:double>>")
    box = spark.createDataFrame([(5, 1.0, 5.0, 2.0, 6.0)], "crop_id int, min_lat double, max_lat double, min_lon double, max_lon double")
    out = sorted(map(tuple, buildings.clipped_roads(roads, box, 2.0).collect()))
    assert out == [(5, 1, 0, 2.0, 2.0, 4.0, 4.0), (5, 1, 1, 4.0, 4.0, 4.0, 6.0)]


def test_holes_stay_empty(spark):
    at = lambda y, x: {"row": float(y), "column": float(x)}
    square = lambda a, b: [at(a, a), at(a, b), at(b, b), at(b, a)]
    ring = "array<struct<row:double,column:double>>"
    df = spark.createDataFrame([(1, 1, 20, square(2, 12), [square(4, 6), square(8, 11)]), (1, 2, 20, square(14, 16), None)], f"crop_id int, building_id int, side int, ring {ring}, holes array<{ring}>")
    assert raster.building_pixels(df).count() == 100 - 4 - 9 + 4


def test_splits_with_geometry_do_not_leak(spark):
    ix = spark.range(3000).select((F.col("id") % 3).alias("campaign_id"), F.col("id").cast("string").alias("ue_id"), F.col("id").alias("crop_id"), (41.815 + F.col("id") % 150 * 1e-4).alias("latitude"), F.lit(12.461).alias("longitude"))
    ix = ix.withColumns({"center_lat": F.col("latitude"), "center_lon": F.col("longitude"), "half": F.lit(50)})
    boxes = geo.literals(41.82, 41.823, 12.46, 12.464), geo.literals(41.823, 41.826, 12.46, 12.464)
    for only in (False, True):
        out = splits.split_index(ix, *boxes, 0.9, 0.5, 0.5, 0, train_only=only, largest=50)
        train = out.filter("split = 'train'").withColumns(geo.box(F.col("center_lat"), F.col("center_lon"), F.lit(50.0)))
        assert train.count() > 100 and train.filter(geo.meets(geo.named(), boxes[0]) | geo.meets(geo.named(), boxes[1])).isEmpty()
    assert splits.campaigns(out).count() == 3 and {r[0] for r in splits.of_campaigns(out, [2]).select("campaign_id").distinct().collect()} == {2}


@pytest.mark.parametrize(("t", "n", "p"), [(2.228139, 10, 0.05), (3.169273, 10, 0.01), (12.706205, 1, 0.05), (1.959964, 10**7, 0.05), (2.570582, 5, 0.05), (1.0, 1, 0.5), (0.0, 7, 1.0), (5.0, 3, 0.0153924)])
def test_student_tails_of_tables(t, n, p):
    assert calibrate.student_tail(t, n) == pytest.approx(p, abs=2e-6)


def test_normal_quantiles(spark):
    from statistics import NormalDist

    from radiopos.functions import draws

    shares = [1e-9, 1e-4, 0.02, 0.024, 0.025, 0.3, 0.5, 0.8, 0.976, 0.99, 1 - 1e-6]
    got = spark.createDataFrame([(s,) for s in shares], "s double").select("s", draws.normal_quantile(F.col("s")).alias("z")).collect()
    assert all(r.z == pytest.approx(NormalDist().inv_cdf(r.s), rel=2e-9, abs=2e-9) for r in got)


def test_layers_are_made_once(spark, tmp_path):
    from pyspark.errors import AnalysisException

    path = f"{tmp_path}/layer"
    with pytest.raises(AnalysisException):
        tables.read_layer(spark, path)
    made = lambda kind: spark.createDataFrame([(1, [(41.0, 12.0), (41.1, 12.0)], None, None, None, kind)], tables.LAYER)
    assert tables.read_layer(spark, path, made("road")).first().kind == "road"
    assert tables.read_layer(spark, path, made("other")).first().kind == "road"


def test_uniform_points_stay_in_bounds(spark):
    r = links.uniform_points(spark, 500, (1.0, 2.0, 3.0, 5.0), 1, "ue").agg(F.min("ue_lat"), F.max("ue_lat"), F.min("ue_lon"), F.max("ue_lon")).first()
    assert 1.0 <= r[0] < 1.05 and 1.95 < r[1] < 2.0 and 3.0 <= r[2] < 3.1 and 4.9 < r[3] < 5.0


def test_region_cascade(spark):
    names = "BSLatitude double, BSLongitude double, UELatitude double, UELongitude double"
    box = (0.0, 1.0, 0.0, 1.0)
    stage = lambda rows: {r.stage for r in region.region_filter(spark.createDataFrame(rows, names), box).collect()}
    assert stage([(0.5, 0.5, 0.5, 0.5), (0.5, 0.5, 9.0, 9.0)]) == {"both"}
    assert stage([(0.5, 0.5, 9.0, 9.0)]) == {"station"}
    assert stage([(1.1, 0.5, 9.0, 9.0)]) == {"wider"}
    with pytest.raises(ValueError):
        stage([(5.0, 5.0, 5.0, 5.0)])


def test_spearman_and_p_value(spark):
    rows = [("a", float(i), float(i * i)) for i in range(10)] + [("b", 1.0, float(i)) for i in range(5)] + [("c", 1.0, 2.0)] + [("d", float(x), float(y)) for x, y in ((1, 2), (2, 1), (3, 4), (4, 3), (5, 5), (6, 7), (7, 6))]
    out = {r.g: r for r in calibrate.with_p_value(calibrate.spearman(spark.createDataFrame(rows, "g string, a double, b double"), ["g"], "a", "b")).collect()}
    assert out["a"].rho == pytest.approx(1) and out["a"].p_value == 0
    assert out["b"].rho is None and out["c"].rho is None and out["b"].p_value is None
    assert out["d"].rho == pytest.approx(1 - 6 * 6 / (7 * 48))
    assert out["d"].p_value == pytest.approx(0.00680719, abs=1e-5)


def test_corrections(spark):
    rows = [("41.870385_12.46081", 41.870385, 12.46081), ("1.0_2.0", 1.0, 2.0)]
    out = {r.BSLatitude: r.BS_location for r in calibrate.corrected(spark.createDataFrame(rows, "BS_location string, BSLatitude double, BSLongitude double"), calibrate.corrections(spark)).collect()}
    assert out == {41.86982378: "41.86982378_12.46159222", 1.0: "1.0_2.0"}


def test_dense_cube_fills_and_takes_the_last(spark):
    rows = [(0, 0, 1, -50.0), (0, 0, 2, -60.0), (1, 1, 3, -70.0)]
    got = {(r.tx_idx, r.rx_idx): r.rssi for r in calibrate.dense_cube(spark.createDataFrame(rows, "tx_idx int, rx_idx int, n int, rssi double"), ["rssi"], "n").collect()}
    assert got == {(0, 0): -60.0, (1, 1): -70.0, (0, 1): -90.0, (1, 0): -90.0}


def test_size_bins(spark):
    rows = [(199.0, 1.0), (200.0, 2.0), (400.0, 3.0), (1600.0, 5.0), (1601.0, 9.0)]
    df = spark.createDataFrame(rows, "original_img_size double, error_m double")
    got = [(r.bin_start, r.n, r.mean_error_m) for r in evaluate.size_bins(df, [400.0, 200.0, 1600.0, 1000.0]).orderBy("bin_start").collect()]
    assert got == [(200.0, 1, 2.0), (400.0, 1, 3.0), (1000.0, 1, 5.0)]
    assert evaluate.size_bins(df, [1.0]).first().n == 5


def test_target_heatmap_mirrors_at_the_edge(spark):
    rows = samples.target_heatmap(spark.createDataFrame([(1, 0, 50)], "crop_id int, py int, px int"), 96).collect()
    at = {(r.y, r.x): r.value for r in rows}
    assert max(at.values()) == 1 and at[0, 50] == 1 and min(y for y, _ in at) == 0
    assert at[1, 50] / at[0, 50] == pytest.approx((math.exp(-1 / 18) + math.exp(-4 / 18)) / (1 + math.exp(-1 / 18)))


def test_stamps_overwrite_and_clip(spark):
    rows = [(1, 1, 0, 0, 5.0), (1, 2, 2, 2, 7.0)]
    got = {(r.y, r.x): r.value for r in samples.stamps(spark.createDataFrame(rows, "crop_id int, bs_no int, py int, px int, v double"), "v").collect()}
    assert got[0, 0] == 7.0 and got[4, 4] == 7.0 and (5, 4) not in got and (-1, 0) not in got and len(got) == 25


def test_downsampling_keeps_mass(spark):
    px = spark.createDataFrame([(1, y, x, 2.0) for y in range(10) for x in range(10)], "crop_id int, y int, x int, value double")
    out = raster.downsampled(px, spark.createDataFrame([(1, 10)], "crop_id int, side int"), 4)
    assert [round(r.value, 9) for r in out.collect()] == [2.0] * 16


def test_raster_shapes(spark):
    at = lambda y, x: {"row": float(y), "column": float(x)}
    ring = "crop_id int, building_id int, side int, ring array<struct<row:double,column:double>>"
    polygon = spark.createDataFrame([(1, 1, 20, [at(2, 2), at(2, 8), at(8, 8), at(8, 2)]), (1, 2, 20, [at(-5, -5), at(-5, 3), at(3, 3), at(3, -5)])], ring)
    found = raster.building_pixels(polygon)
    assert found.count() == 36 + 9 - 1
    road = raster.road_pixels(spark.createDataFrame([(1, 20, 10.0, 0.0, 10.0, 20.0)], "crop_id int, side int, y0 double, x0 double, y1 double, x1 double"))
    assert road.count() == 4 * 20
    both = raster.crop_pixels(found, road)
    assert both.agg(F.max("building"), F.max("road")).first()[:] == (255, 255)
    assert raster.channel(both, "mean").agg(F.min("value")).first()[0] == 127.5


def test_footprints_and_triangles(spark):
    point = lambda a, b: {"lat": 41.82 + a * 1e-4, "lon": 12.46 + b * 1e-4}
    ring = [point(0, 0), point(0, 1), point(1, 1), point(1, 0)]
    schema = "feature_id long, height string, levels string, kind string, parts array<struct<exterior:array<struct<lat:double,lon:double>>,interiors:array<array<struct<lat:double,lon:double>>>>>"
    rows = [(7, "12 m", None, None, [(ring, [ring[:3]]), (ring[:2], None)]), (8, None, "2", None, [(ring, None)])]
    got = {r.id: r for r in buildings.footprints(spark.createDataFrame(rows, schema), 41.82, 12.46).collect()}
    assert set(got) == {"7_0", "8_0"} and (got["7_0"].height, got["8_0"].height) == (12, 6)
    assert len(got["7_0"].exterior) == 4 and len(got["7_0"].interiors) == 1 and got["8_0"].interiors == []
    out = buildings.triangles(buildings.footprints(spark.createDataFrame(rows, schema), 41.82, 12.46))
    assert {(r.side, r["count"]) for r in out.groupBy("side").count().collect()} == {("roof", 4), ("ground", 4), ("wall", 16)}


def test_all_pairs(spark):
    ues = spark.createDataFrame([(i, 41.0, 12.0) for i in range(5)], "ue_idx int, ue_lat double, ue_lon double")
    bs = spark.createDataFrame([(j, 41.001, 12.0) for j in range(3)], "bs_idx int, bs_lat double, bs_lon double")
    pairs = links.all_pairs(ues, bs)
    assert links.pair_profile(pairs).first().asDict() == {"n_ues": 5, "n_pairs": 15, "max_spread": 0.0, "n_bs": 3}
    assert pairs.first().distance_m == pytest.approx(111.0)


def test_scoring_with_a_predictor(spark):
    s = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "crop_id long, split string")
    out = scoring.score(s, scoring.center_predictor(4), ["a"]).collect()
    assert {r.crop_id for r in out} == {1, 3} and all(r.heatmap[10] == 1 and sum(r.heatmap) == 1 for r in out)


def test_assembled_samples(spark):
    st = "struct<enode:long,bs_y:double,bs_x:double,interpolated:boolean,measurements:struct<rssi:double,nsinr:double>>"
    rows = [(1, 100, 30.0, 40.0, [(5, 10.0, 20.0, False, (-60.0, None)), (6, 1.0, 2.0, True, (-60.0, 1.0)), (7, 3.0, 4.0, False, (-50.0, 1.0))])]
    df = spark.createDataFrame(rows, f"crop_id int, half int, ue_y double, ue_x double, base_stations array<{st}>")
    r = samples.assemble(df, 224, 2, {"rssi": -65.0, "nsinr": 0.0}, {"rssi": 5.0, "nsinr": 2.0}).first()
    assert r.sequence == [[10 / 201, 20 / 201, 1.0, 0.0]] and r.target_y == pytest.approx(30 / 201 * 224) and r.scale == pytest.approx(224 / 201)


# readers and writers


def test_readers(spark, tmp_path):
    d = str(tmp_path)
    head = "BSLatitude,BSLongitude,UELatitude,UELongitude,RSSI,NSINR,NRSRP,NRSRQ\n"
    (tmp_path / "links.csv").write_text(head + "41.5,12.46081,41.6,12.4,-50,1,2,3\n")
    assert tables.read_links(spark, f"{d}/links.csv").first().BS_location == "41.5_12.46081"
    (tmp_path / "bad.csv").write_text("RSSI\n1\n")
    with pytest.raises(ValueError, match="BSLatitude"):
        tables.read_links(spark, f"{d}/bad.csv")
    (tmp_path / "cells.csv").write_text("Name,eNodeBID,Latitude,Longitude,MNC,Other\nx NPCI:12 y,5,41.0,12.0,88,z\nq,6,,,1,\n")
    cells = tables.read_cells(spark, f"{d}/cells.csv").collect()
    assert tuple(cells[0]) == (12, 5, 88, 41.0, 12.0) and cells[1].npci is None
    (tmp_path / "sim.csv").write_text("bs_idx,ue_id,bs_lat,bs_lon,ue_lat,ue_lon,sim_rssi,sim_nsinr,sim_nrsrp,sim_nrsrq\n3,1,41,12,42,13,-50,1,2,3\n")
    r = tables.read_sim_links(spark, f"{d}/sim.csv").first()
    assert (r.enode, r.bs_power_dbm, r.npci, r.interpolated, r.latitude) == (3, 0.0, -1, False, 42.0)
    (tmp_path / "passive.csv").write_text(",a\n0,5\n")
    assert tables.read_passive(spark, f"{d}/passive.csv").columns == ["a"]


def test_best_parameters(spark, tmp_path):
    (tmp_path / "corrected_bs_4_result.json").write_text('{"best_parameters": {"latitude": 1.0, "longitude": 2.0}}')
    (tmp_path / "corrected_x_result.json").write_text('{"bs_idx": 0, "latitude": 3.0, "longitude": 4.0, "altitude": 50.0, "azimuth": 9.0}')
    (tmp_path / "corrected_z_result.json").write_text("{broken")
    got = [tuple(r) for r in tables.read_best_parameters(spark, str(tmp_path)).collect()]
    assert got == [(0, 3.0, 4.0, 50.0, 9.0), (4, 1.0, 2.0, 30.0, 0.0)]


def test_documents_and_indices(spark, tmp_path):
    folder = tmp_path / "crops" / "3" / "41p8_12p4"
    folder.mkdir(parents=True)
    (folder / "c1.json").write_text(json.dumps({"campaign_id": 3, "half_square_size_meters": 300, "BaseStations": [{"npci": 1, "interpolated": False}, {"npci": 2, "interpolated": True}]}))
    (folder / "c2.json").write_text("{oops")
    r = tables.read_crops(spark, str(tmp_path / "crops")).collect()
    assert [(x.campaign, x.ue_id, x.crop_id, len(x.BaseStations)) for x in r] == [("3", "41p8_12p4", "c1", 2)]
    (tmp_path / "i.json").write_text('{"0": {"u": {"c": 2, "d": 0}}}')
    got = {tuple(x) for x in tables.read_index(spark, [str(tmp_path / "i.json")] * 2).collect()}
    assert got == {(i, "0", "u", c, n) for i in (0, 1) for c, n in (("c", 2), ("d", 0))}


def test_streamed_patches_equal_the_batch(spark, tmp_path):
    paths = spark.range(300).selectExpr("cast(id % 3 as int) patch_idx", "id % 20 rx", "id % 4 tx", "id * 1e-7 re", "id * 2e-7 im")
    source, sink, mark = (f"{tmp_path}/{n}" for n in ("in", "out", "mark"))
    names = ["patch_idx", "rx", "tx", "rssi"]
    for patch in range(3):
        paths.filter(F.col("patch_idx") == patch).coalesce(1).write.mode("append").parquet(source)
        patches.run_available(spark, source, sink, mark)
    patches.run_available(spark, source, sink, mark)
    got = spark.read.parquet(sink).select(*names)
    want = patches.patch_metrics(paths).select(*names)
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()


_BOUNDS = "min_lat double, max_lat double, min_lon double, max_lon double"


def test_pairs_of_one_cell_are_many_tasks_work(spark):
    boxes = spark.createDataFrame([(i, 0.1, 0.9, 0.1, 0.9) for i in range(5)], f"crop_id int, {_BOUNDS}")
    features = spark.createDataFrame([(i, 0.5, 0.6, 0.5, 0.6) for i in range(400)], f"feature_id long, {_BOUNDS}").coalesce(1)
    out = buildings.in_crops(features, boxes, 1.0).select("crop_id", "feature_id", F.spark_partition_id().alias("part")).collect()
    assert len({r[:2] for r in out}) == len(out) == 2000
    assert len({r.part for r in out}) > 2


def test_segments_go_through_one_join(spark):
    line = [(0.0, 0.0), (4.0, 4.0)]
    roads = spark.createDataFrame([(1, line)], "feature_id long, shape array<struct<lat:double,lon:double>>")
    out = buildings.clipped_roads(roads, spark.createDataFrame([(5, 1.0, 5.0, 2.0, 6.0)], f"crop_id int, {_BOUNDS}"), 2.0)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


def test_clipped_pairs_are_neither_written_nor_shuffled(spark):
    ring = "array<struct<lat:double,lon:double>>"
    features = spark.createDataFrame([(1, [(0.0, 0.0), (0.0, 4.0), (4.0, 4.0)], None)], f"feature_id long, shape {ring}, holes array<{ring}>")
    out = buildings.clipped_features(features, spark.createDataFrame([(5, 1.0, 5.0, 2.0, 6.0)], f"crop_id int, {_BOUNDS}"), 2.0)
    plan = out._jdf.queryExecution().executedPlan().toString()
    # features and crops are, once for those inside and once for those to be cut
    assert plan.count("Exchange hashpartitioning") == 4 and "features-in-crops" not in plan
    assert [(r.crop_id, r.feature_id, r.area) for r in out.collect()] == [(5, 1, 4.0)]


def test_boxes_that_meet_dense_ones_are_not_spread_over_cells(spark, monkeypatch):
    """Of boxes whose middle lies in a filled cell no other cell is asked."""
    staged = {}
    plain = buildings.stage
    monkeypatch.setattr(buildings, "stage", lambda df, name, **o: staged.setdefault(name, plain(df, name, **o)))
    one = lambda rows: spark.createDataFrame(rows, f"crop_id int, {_BOUNDS}")
    mine = one([(1, 2.2, 7.7, 2.2, 7.7), (2, 9.2, 13.0, 9.2, 13.0), (3, 20.0, 21.0, 20.0, 21.0), (4, 9.6, 9.8, 1.0, 2.0), (5, 9.95, 9.99, 1.0, 2.0)])
    out = buildings.meets_any(mine, one([(9, 0.0, 9.9, 0.0, 9.9), (8, 0.0, 9.9, 0.0, 9.9)]), cell=1.0)
    assert sorted(r.crop_id for r in out.collect()) == [1, 2, 4]
    assert sorted(r.crop_id for r in staged["middle-cells"].filter("_in").collect()) == [1]
    assert staged["covered-cells"].count() == 100


def test_each_value_is_shuffled_once(spark):
    rows = [(1.0, 1, False, -9.0, 5), (1.0, 1, False, -8.0, 6), (1.0, 1, True, -99.0, 7)]
    df = spark.createDataFrame(rows, "latitude double, enode int, interpolated boolean, rssi double, campaign int")
    out = measurements.deduplicate(df, ("latitude", "enode"), ("rssi",))
    assert [tuple(r) for r in out.collect()] == [rows[0]]
    assert "min_by" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_documents_are_kept_compressed(spark, tmp_path):
    d = str(tmp_path / "docs")
    plain = "campaign string, ue_id string, crop_id string, campaign_id int"
    made = spark.createDataFrame([("1", "a", str(i), 1) for i in range(9)], plain)
    wanted = tables._schema.__globals__["StructType"].fromDDL(tables.DOCUMENT)
    made = made.select(*(F.col(f.name) if f.name in made.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in wanted.fields))
    tables.write_documents(made, d, 4)
    assert {p.name.split(".")[-1] for p in (tmp_path / "docs").rglob("part-*")} == {"gz"}


def test_places_come_with_the_index(spark):
    from radiopos.plans import crop_queries

    placed = crop_queries._staged(spark, "/root/testdata/sf0.001")
    assert not {"l_extendedprice", "rssi"} & set(placed.columns)
    plan = crop_queries._geometric(placed)._jdf.queryExecution().optimizedPlan().toString()
    # measurements with crops, and the crops' numbers with their offsets; no second set of crops
    assert plan.count("Join ") == 2
