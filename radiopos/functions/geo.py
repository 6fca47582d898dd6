"""Geodesy as closed-form Column expressions on the WGS-84 ellipsoid."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: WGS-84 axis and flattening; mean radius; metres in a degree for the flat approximation.
AXIS, FLATTENING = 6378137.0, 1 / 298.257223563
RADIUS, DEGREE = 6_371_000.0, 111_000.0
#: UTM zone 33 scale, central meridian and false easting.
UTM_SCALE, UTM_MERIDIAN, UTM_EASTING = 0.9996, 15.0, 500_000.0
_E2 = FLATTENING * (2 - FLATTENING)
_N = FLATTENING / (2 - FLATTENING)
#: Krüger's series to the fourth order in the third flattening.
KRUGER_A = AXIS / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
ALPHA = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
)
BETA = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
    17 * _N**3 / 480 - 37 * _N**4 / 840,
    4397 * _N**4 / 161280,
)
DELTA = (
    2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45,
    7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45,
    56 * _N**3 / 15 - 136 * _N**4 / 35,
    4279 * _N**4 / 630,
)
_ROOT = 2 * math.sqrt(_N) / (1 + _N)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres on the mean sphere."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * RADIUS * F.asin(F.sqrt(h))


def _meridional(lat: Column) -> Column:
    return AXIS * (1 - _E2) / F.pow(1 - _E2 * F.pow(F.sin(lat), 2), 1.5)


def north_of(lat: Column, metres: Column) -> Column:
    """Latitude `metres` north along the ellipsoid, with the radius of curvature half way."""
    phi = F.radians(lat)
    return lat + F.degrees(metres / _meridional(phi + metres / (2 * _meridional(phi))))


def east_of(lat: Column, lon: Column, metres: Column) -> Column:
    phi = F.radians(lat)
    normal = AXIS / F.sqrt(1 - _E2 * F.pow(F.sin(phi), 2))
    return lon + F.degrees(metres / (normal * F.cos(phi)))


def box(lat: Column, lon: Column, half: Column) -> dict[str, Column]:
    """The cardinal box `half` metres around a point."""
    return {"min_lat": north_of(lat, -half), "max_lat": north_of(lat, half), "min_lon": east_of(lat, lon, -half), "max_lon": east_of(lat, lon, half)}


def grown(bounds: dict[str, Column], metres: Column | float) -> dict[str, Column]:
    """The box with `metres` more on each side (negative: less), at 111,000 m a degree."""
    middle = F.radians((bounds["min_lat"] + bounds["max_lat"]) / 2)
    d_lat, d_lon = F.lit(metres) / DEGREE, F.lit(metres) / (DEGREE * F.cos(middle))
    return {"min_lat": bounds["min_lat"] - d_lat, "max_lat": bounds["max_lat"] + d_lat, "min_lon": bounds["min_lon"] - d_lon, "max_lon": bounds["max_lon"] + d_lon}


def inside(lat: Column, lon: Column, bounds: dict[str, Column]) -> Column:
    """Whether the point is in the box, its edges included."""
    return lat.between(bounds["min_lat"], bounds["max_lat"]) & lon.between(bounds["min_lon"], bounds["max_lon"])


def meets(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Whether two boxes share a point; touching counts."""
    return (a["min_lat"] <= b["max_lat"]) & (b["min_lat"] <= a["max_lat"]) & (a["min_lon"] <= b["max_lon"]) & (b["min_lon"] <= a["max_lon"])


def literals(min_lat: float, max_lat: float, min_lon: float, max_lon: float) -> dict[str, Column]:
    return {"min_lat": F.lit(min_lat), "max_lat": F.lit(max_lat), "min_lon": F.lit(min_lon), "max_lon": F.lit(max_lon)}


def named(prefix: str = "") -> dict[str, Column]:
    return {k: F.col(prefix + k) for k in ("min_lat", "max_lat", "min_lon", "max_lon")}


def transverse_mercator(df: DataFrame, lat: str, lon: str, meridian: Column, scale: float, east: str, north: str) -> DataFrame:
    """Adds metres east of the meridian and north of the equator. Terms are staged as columns, so the plan stays small."""
    s = F.sin(F.radians(lat))
    df = df.withColumn("_t", F.sinh(F.atanh(s) - _ROOT * F.atanh(_ROOT * s))).withColumn("_l", F.radians(F.col(lon) - meridian))
    df = df.withColumn("_xi", F.atan2(F.col("_t"), F.cos("_l"))).withColumn("_eta", F.atanh(F.sin("_l") / F.sqrt(1 + F.col("_t") * F.col("_t"))))
    x, e = F.col("_xi"), F.col("_eta")
    to_east = sum((a * F.cos(2 * j * x) * F.sinh(2 * j * e) for j, a in enumerate(ALPHA, 1)), e)
    to_north = sum((a * F.sin(2 * j * x) * F.cosh(2 * j * e) for j, a in enumerate(ALPHA, 1)), x)
    return df.withColumns({east: scale * KRUGER_A * to_east, north: scale * KRUGER_A * to_north}).drop("_t", "_l", "_xi", "_eta")


def inverse_mercator(df: DataFrame, east: str, north: str, meridian: Column, scale: float, lat: str, lon: str) -> DataFrame:
    df = df.withColumn("_x", F.col(north) / (scale * KRUGER_A)).withColumn("_e", F.col(east) / (scale * KRUGER_A))
    x, e = F.col("_x"), F.col("_e")
    df = df.withColumn("_xi", x - sum((b * F.sin(2 * j * x) * F.cosh(2 * j * e) for j, b in enumerate(BETA, 1)), F.lit(0.0)))
    df = df.withColumn("_eta", e - sum((b * F.cos(2 * j * x) * F.sinh(2 * j * e) for j, b in enumerate(BETA, 1)), F.lit(0.0)))
    df = df.withColumn("_chi", F.asin(F.sin("_xi") / F.cosh("_eta")))
    phi = sum((d * F.sin(2 * j * F.col("_chi")) for j, d in enumerate(DELTA, 1)), F.col("_chi"))
    lam = meridian + F.degrees(F.atan2(F.sinh("_eta"), F.cos("_xi")))
    return df.withColumns({lat: F.degrees(phi), lon: lam}).drop("_x", "_e", "_xi", "_eta", "_chi")


def local_metres(df: DataFrame, lat: str, lon: str, center_lat: float, center_lon: float, x: str = "x", y: str = "y") -> DataFrame:
    """Metres east and north of the centre in UTM zone 33."""
    meridian = F.lit(UTM_MERIDIAN)
    df = df.withColumns({"_clat": F.lit(center_lat), "_clon": F.lit(center_lon)})
    df = transverse_mercator(df, "_clat", "_clon", meridian, UTM_SCALE, "_ce", "_cn")
    df = transverse_mercator(df, lat, lon, meridian, UTM_SCALE, x, y)
    return df.withColumns({x: F.col(x) - F.col("_ce"), y: F.col(y) - F.col("_cn")}).drop("_clat", "_clon", "_ce", "_cn")


def local_degrees(df: DataFrame, x: str, y: str, center_lat: float, center_lon: float, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Latitude and longitude of metres east and north of the centre in UTM zone 33."""
    meridian = F.lit(UTM_MERIDIAN)
    df = df.withColumns({"_clat": F.lit(center_lat), "_clon": F.lit(center_lon)})
    df = transverse_mercator(df, "_clat", "_clon", meridian, UTM_SCALE, "_ce", "_cn")
    df = df.withColumns({"_pe": F.col(x) + F.col("_ce"), "_pn": F.col(y) + F.col("_cn")})
    return inverse_mercator(df, "_pe", "_pn", meridian, UTM_SCALE, lat, lon).drop("_clat", "_clon", "_ce", "_cn", "_pe", "_pn")


def crop_position(df: DataFrame, lat: str, lon: str, center_lat: str, center_lon: str, half: str, row: str, column: str) -> DataFrame:
    """Row and column of a point on the crop's 1 m grid: transverse Mercator about the crop's centre."""
    df = transverse_mercator(df, lat, lon, F.col(center_lon), 1.0, "_pe", "_pn")
    df = transverse_mercator(df, center_lat, center_lon, F.col(center_lon), 1.0, "_ce", "_cn")
    return df.withColumns({row: F.col(half) - (F.col("_pn") - F.col("_cn")), column: F.col(half) + F.col("_pe")}).drop("_pe", "_pn", "_ce", "_cn")


def flat_offset(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> tuple[Column, Column]:
    """(distance, bearing) at 111,000 m a degree, with the cosine of the first latitude."""
    north, east = (lat2 - lat1) * DEGREE, (lon2 - lon1) * DEGREE * F.cos(F.radians(lat1))
    return F.sqrt(north * north + east * east), F.atan2(east, north)


def polar(lat: Column, lon: Column, metres: Column, angle: Column) -> tuple[Column, Column]:
    """The point at an angle (0: north) and distance, at 111,000 m a degree."""
    return lat + metres * F.cos(angle) / DEGREE, lon + metres * F.sin(angle) / (DEGREE * F.cos(F.radians(lat)))


def pixel_place(lat: Column, lon: Column, half: Column, row: Column, column: Column) -> tuple[Column, Column]:
    """Latitude and longitude of a pixel (metres) of a crop: north first, then east."""
    up = north_of(lat, half - row)
    return up, east_of(up, lon, column - half)


def geodesic(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres on the ellipsoid by Andoyer and Lambert; millimetres off below a kilometre. Equal points: 0."""
    b1, b2 = (F.atan((1 - FLATTENING) * F.tan(F.radians(x))) for x in (lat1, lat2))
    p, q = (b1 + b2) / 2, (b2 - b1) / 2
    h = F.pow(F.sin((b2 - b1) / 2), 2) + F.cos(b1) * F.cos(b2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    sigma = 2 * F.asin(F.sqrt(h))
    up = (sigma - F.sin(sigma)) * F.pow(F.sin(p) * F.cos(q), 2) / F.pow(F.cos(sigma / 2), 2)
    down = (sigma + F.sin(sigma)) * F.pow(F.cos(p) * F.sin(q), 2) / F.pow(F.sin(sigma / 2), 2)
    return F.when(h == 0, 0.0).otherwise(AXIS * (sigma - FLATTENING / 2 * (up + down)))
