"""Radio metrics, keys, building heights and heat maps as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Thermal noise and interference (dBm), subcarriers and reference symbols, floors.
NOISE_DBM, INTERFERENCE_DBM = -100.0, -110.0
SUBCARRIERS, SYMBOLS = 1008.0, 84.0
LEAST_GAIN, LEAST_RSSI, MISSING = 1e-30, -140.0, -90.0
#: Operator labels by id.
OPERATORS = {1: '"Op"[1]', 10: '"Op"[2]', 88: '"Op"[3]'}
#: Means and scales of the features.
FEATURE_MEANS = {"rssi": -64.0, "nsinr": -5.0, "nrsrp": -83.0, "nrsrq": -19.0, "bs_power_dbm": 0.0}
FEATURE_SCALES = {"rssi": 57.0, "nsinr": 94.0, "nrsrp": 114.0, "nrsrq": 41.0, "bs_power_dbm": 1.0}
#: Default heights by building type; floor heights; ranges of heights by type, amenity and footprint.
DEFAULT_HEIGHTS = ((("house", "residential"), 8.0), (("office", "commercial"), 15.0), (("industrial", "warehouse"), 12.0), (("apartment", "apartments"), 20.0))
FLOOR_HEIGHTS = ((("industrial", "warehouse"), 4.5), (("commercial", "office", "retail"), 3.5))
KIND_RANGES = (
    (("house", "residential", "detached", "semi_detached"), 5.5, 8.5),
    (("apartments", "dormitory"), 12.0, 25.0),
    (("commercial", "office", "retail"), 10.0, 20.0),
    (("industrial", "warehouse", "manufacture"), 6.0, 12.0),
    (("church", "cathedral", "chapel"), 15.0, 35.0),
    (("school", "university"), 8.0, 15.0),
    (("hospital",), 15.0, 30.0),
)
AMENITY_RANGES = ((("place_of_worship",), 12.0, 25.0), (("school", "university"), 8.0, 15.0))
AREA_RANGES = ((1000.0, 12.0, 25.0), (200.0, 8.0, 18.0))
SMALL_RANGE, UNKNOWN_RANGE = (5.0, 12.0), (8.0, 15.0)


def ue_key(lat: Column, lon: Column) -> Column:
    return F.translate(F.format_string("%.6f_%.6f", lat, lon), ".", "p")


def parsed_key(key: Column) -> tuple[Column, Column]:
    """Latitude and longitude of a UE key; null for a bad one."""
    parts = F.split(F.replace(key, F.lit("p"), F.lit(".")), "_")
    number = lambda i: F.try_element_at(parts, F.lit(i)).try_cast("double")
    good = F.size(parts) == 2
    return F.when(good, number(1)), F.when(good, number(2))


def location_key(lat: Column, lon: Column, digits: int = 6) -> Column:
    return F.concat_ws("_", F.round(lat, digits).cast("string"), F.round(lon, digits).cast("string"))


def cell_number(name: Column) -> Column:
    """The number after NPCI: in a cell's name."""
    return F.nullif(F.regexp_extract(name, r"NPCI:(\d+)", 1), F.lit("")).try_cast("int")


def plain_id(text: Column) -> Column:
    """Without quotes and parentheses; other separators become underscores."""
    return F.regexp_replace(F.regexp_replace(text, r"['\"()]", ""), r"[^A-Za-z0-9_]+", "_")


def operator_label(mnc: Column) -> Column:
    return F.create_map(*(x for k, v in OPERATORS.items() for x in (F.lit(k), F.lit(v))))[mnc]


def _db(x: Column) -> Column:
    return 10 * F.log10(x)


def _watts(dbm: Column | float) -> Column:
    return F.pow(F.lit(10.0), F.lit(dbm) / 10)


def link_metrics(gain: Column, tx_dbm: Column | float = 0.0) -> dict[str, Column]:
    """rssi, nsinr, nrsrp and nrsrq of a path gain. The reference symbols' power is the 1008th part, as dBm plus 30."""
    rssi = F.greatest(F.lit(tx_dbm) + _db(F.greatest(gain, F.lit(LEAST_GAIN))), F.lit(LEAST_RSSI))
    power = _watts(rssi)
    symbol = power / SUBCARRIERS
    return {"rssi": rssi, "nsinr": rssi - _db(_watts(NOISE_DBM) + _watts(INTERFERENCE_DBM)), "nrsrp": _db(symbol) + 30, "nrsrq": _db(SYMBOLS * symbol / power)}


def path_loss(re: Column, im: Column, mean: float = 84.0, deviation: float = 14.0) -> Column:
    """Standardised loss of an array of complex path responses (two arrays): -10 log10 (sum |h|)^2, by variance."""
    total = F.aggregate(F.zip_with(re, im, lambda a, b: F.sqrt(a * a + b * b)), F.lit(0.0), lambda s, h: s + h)
    return (-_db(F.greatest(total * total, F.lit(LEAST_GAIN))) - mean) / deviation**2


def standardised(value: Column, mean: float, scale: float, fill: float | None = None) -> Column:
    """(value - mean) / scale; a missing value is raw 0 unless a fill is given."""
    return (F.coalesce(value, F.lit(0.0 if fill is None else fill)) - mean) / scale


def building_height(height: Column, levels: Column, kind: Column) -> Column:
    """Metres from the height (an m is dropped; 5 to 200), else 3 a level (1 to 50), else by type, else 10."""
    h = F.trim(F.replace(height, F.lit("m"), F.lit(""))).try_cast("double")
    n = levels.try_cast("double")
    by_kind = (F.when(F.lower(kind).isin(*kinds), metres) for kinds, metres in DEFAULT_HEIGHTS)
    return F.coalesce(F.when(h.between(5, 200), h), F.when(n.between(1, 50), 3 * n), *by_kind, F.lit(10.0))


def height_with_units(heights: list[Column], levels: list[Column], kind: Column, drawn: Column, amenity: Column | None = None, area: Column | None = None) -> Column:
    """Metres from the first height that parses with its unit (2 to 200), else levels (1 to 50) by the type's floor
    height, else a range at the drawn share in [0, 1) with one decimal: by type, amenity or footprint (square metres)."""

    def metres(text: Column) -> Column:
        low = F.lower(F.trim(text))
        number = F.nullif(F.regexp_extract(low, r"^([0-9]*\.?[0-9]+)", 1), F.lit("")).try_cast("double")
        value = F.when(low.rlike(r"^[0-9]*\.?[0-9]+\s*(?:ft|feet|')"), number * 0.3048).otherwise(number)
        return F.when(value.between(2, 200), value)

    floor = F.coalesce(*(F.when(kind.isin(*kinds), m) for kinds, m in FLOOR_HEIGHTS), F.lit(3.0))
    by_level = (F.when(n.between(1, 50), n * floor) for n in (x.try_cast("double") for x in levels))
    at = lambda lo, hi: F.round(lo + (hi - lo) * drawn, 1)
    ranges = [F.when(kind.isin(*kinds), at(lo, hi)) for kinds, lo, hi in KIND_RANGES]
    if amenity is not None:
        ranges += [F.when(amenity.isin(*kinds), at(lo, hi)) for kinds, lo, hi in AMENITY_RANGES]
    if area is not None:
        ranges += [F.when(area > least, at(lo, hi)) for least, lo, hi in AREA_RANGES] + [F.when(area.isNotNull(), at(*SMALL_RANGE))]
    return F.coalesce(*map(metres, heights), *by_level, *ranges, at(*UNKNOWN_RANGE))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def peak(heatmap: Column, width: Column | int) -> tuple[Column, Column]:
    """Row and column of the first largest value; NaN values are left out."""
    clean = F.transform(heatmap, lambda v: F.when(~F.isnan(v), v))
    at = F.array_position(clean, F.array_max(clean)) - 1
    width = F.lit(width).cast("long")
    return F.floor(at / width).cast("long"), (at % width).cast("long")
