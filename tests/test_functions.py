"""Geodesy, metrics, heights and keys on hand-made rows."""

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from radiopos.functions import draws, geo, radio

CENTER = (41.8698541, 12.4622493)


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()


def test_utm_of_a_known_point(spark):
    df = spark.createDataFrame([CENTER], "lat double, lon double")
    r = geo.transverse_mercator(df, "lat", "lon", F.lit(15.0), geo.UTM_SCALE, "e", "n").first()
    assert r.e + geo.UTM_EASTING == pytest.approx(289394.180, abs=2e-3)
    assert r.n == pytest.approx(4638440.523, abs=2e-3)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.floats(35, 65), st.floats(9, 21)), min_size=20, max_size=20))
def test_local_metres_round_trip(spark, points):
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "i int, lat double, lon double")
    there = geo.local_metres(df, "lat", "lon", *CENTER)
    for r in geo.local_degrees(there, "x", "y", *CENTER, "lat2", "lon2").collect():
        assert (r.lat2, r.lon2) == (pytest.approx(r.lat, abs=1e-8), pytest.approx(r.lon, abs=1e-8))


@pytest.mark.parametrize("metres", [-500.0, 0.5, 300.0, 800.0])
@pytest.mark.parametrize("place", [(41.8, 12.4), (59.92, 10.75)])
def test_destinations_agree_with_the_geodesic(spark, place, metres):
    lat, lon = map(F.lit, place)
    up, right = geo.north_of(lat, F.lit(metres)), geo.east_of(lat, lon, F.lit(metres))
    r = one(spark, n=geo.geodesic(lat, lon, up, lon), e=geo.geodesic(lat, lon, lat, right), same=geo.geodesic(lat, lon, lat, lon))
    assert r.n == pytest.approx(abs(metres), abs=2e-3) and r.e == pytest.approx(abs(metres), abs=2e-3) and r.same == 0


def test_boxes(spark):
    a, b = geo.literals(0.0, 1.0, 0.0, 1.0), geo.literals(1.0, 2.0, 1.0, 2.0)
    far = geo.literals(1.1, 2.0, 0.0, 1.0)
    at = lambda x, y: geo.inside(F.lit(x), F.lit(y), a)
    r = one(spark, touch=geo.meets(a, b), apart=geo.meets(a, far), edge=at(1.0, 0.0), out=at(1.0000001, 0.5), back=geo.grown(geo.grown(a, 100.0), -100.0)["max_lat"])
    assert (r.touch, r.apart, r.edge, r.out) == (True, False, True, False) and r.back == pytest.approx(1.0)


def test_crop_position_is_metric(spark):
    lat, lon = F.lit(41.8), F.lit(12.4)
    df = spark.range(1).select(geo.north_of(lat, F.lit(300.0)).alias("lat"), geo.east_of(lat, lon, F.lit(100.0)).alias("lon"), lat.alias("clat"), lon.alias("clon"), F.lit(300).alias("half"))
    r = geo.crop_position(df, "lat", "lon", "clat", "clon", "half", "y", "x").first()
    assert r.y == pytest.approx(0, abs=0.01) and r.x == pytest.approx(400, abs=0.01)


def test_link_metrics(spark):
    r = one(spark, **radio.link_metrics(F.lit(1e-9)))
    assert r.rssi == pytest.approx(-90) and r.nrsrq == pytest.approx(10 * math.log10(84 / 1008))
    assert r.nsinr == pytest.approx(-90 - 10 * math.log10(1e-10 + 1e-11)) and r.nrsrp == pytest.approx(-90 - 10 * math.log10(1008) + 30)
    assert one(spark, **radio.link_metrics(F.lit(0.0))).rssi == -140


HEIGHTS = [("12", None, "x", 12), ("12 m", None, "x", 12), ("4", "3", "x", 9), ("", "0", "house", 8), (None, "51", "office", 15), (None, "50", None, 150), ("abc", None, "apartments", 20), (None, None, None, 10)]


def test_building_heights(spark):
    df = spark.createDataFrame([(i, h, n, k) for i, (h, n, k, _) in enumerate(HEIGHTS)], "i int, h string, n string, k string")
    got = [r.m for r in df.select("i", radio.building_height(F.col("h"), F.col("n"), F.col("k")).alias("m")).orderBy("i").collect()]
    assert got == [w for *_, w in HEIGHTS]


def test_heights_with_units(spark):
    rows = [(0, "40 ft", None, "x"), (1, "1", "4", "office"), (2, None, None, "apartments"), (3, "3 m", None, "x")]
    df = spark.createDataFrame(rows, "i int, h string, n string, k string")
    got = [r.m for r in df.select("i", radio.height_with_units([F.col("h")], [F.col("n")], F.col("k"), F.lit(0.5)).alias("m")).orderBy("i").collect()]
    assert got == [pytest.approx(12.192), 14.0, 18.5, 3.0]


def test_keys(spark):
    key = radio.ue_key(F.lit(41.82), F.lit(12.46))
    lat, lon = radio.parsed_key(key)
    bad = radio.parsed_key(F.lit("nonsense"))
    r = one(spark, key=key, lat=lat, lon=lon, bad=bad[0], loc=radio.location_key(F.lit(12.46081), F.lit(41.5)), cell=radio.cell_number(F.lit("a NPCI:77 b")), none=radio.cell_number(F.lit("a")), op=radio.operator_label(F.lit(5)))
    assert (r.key, r.lat, r.lon, r.bad) == ("41p820000_12p460000", 41.82, 12.46, None)
    assert (r.loc, r["cell"], r["none"], r.op) == ("12.46081_41.5", 77, None, None)


def test_peak_takes_the_first_largest(spark):
    y, x = radio.peak(F.array(*map(F.lit, (0.0, 3.0, float("nan"), 3.0))), 2)
    assert tuple(one(spark, y=y, x=x)) == (0, 1)


def test_draws_repeat_and_are_uniform(spark):
    df = spark.range(20_000).withColumn("u", draws.uniform(1, "id")).withColumn("z", draws.normal(1, "id"))
    a, b = (d.agg(F.avg("u"), F.min("u"), F.max("u"), F.avg("z"), F.stddev("z")).first() for d in (df, df.repartition(7)))
    assert a[0] == pytest.approx(b[0]) and a[0] == pytest.approx(0.5, abs=0.02) and 0 <= a[1] and a[2] < 1
    assert a[3] == pytest.approx(0, abs=0.03) and a[4] == pytest.approx(1, abs=0.03)
