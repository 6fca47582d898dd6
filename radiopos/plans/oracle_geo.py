"""Geodesy in SQL, for the oracles only."""

from __future__ import annotations

from ..functions import draws, geo

E2 = geo.FLATTENING * (2 - geo.FLATTENING)


def north(lat: str, m: str) -> str:
    meridional = lambda p: f"({geo.AXIS * (1 - E2)!r} / pow(1e0 - {E2!r} * pow(sin({p}), 2), 1.5e0))"
    return f"({lat} + degrees(({m}) / {meridional(f'(radians({lat}) + ({m}) / (2e0 * {meridional(f'radians({lat})')}))')}))"


def east(lat: str, lon: str, m: str) -> str:
    return f"({lon} + degrees(({m}) / (({geo.AXIS!r} / sqrt(1e0 - {E2!r} * pow(sin(radians({lat})), 2))) * cos(radians({lat})))))"


def box(lat: str, lon: str, half: str) -> str:
    return f"{north(lat, f'-({half})')} AS min_lat, {north(lat, half)} AS max_lat, {east(lat, lon, f'-({half})')} AS min_lon, {east(lat, lon, half)} AS max_lon"


def mercator(source: str, lat: str, lon: str, meridian: str, scale: float, e: str, n: str) -> str:
    """SELECT *, e, n FROM source with the transverse Mercator coordinates."""
    root = repr(geo._ROOT)
    s = f"sin(radians({lat}))"
    t = f"SELECT *, sinh(atanh({s}) - {root} * atanh({root} * {s})) AS t_, radians({lon} - {meridian}) AS l_ FROM {source}"
    x = f"SELECT *, atan2(t_, cos(l_)) AS x_, atanh(sin(l_) / sqrt(1e0 + t_ * t_)) AS e_ FROM ({t})"
    hyper = {f: f"((exp(2e0 * {{j}} * e_) {sign} exp(-2e0 * {{j}} * e_)) / 2e0)" for f, sign in (("sinh", "-"), ("cosh", "+"))}
    to_e = " + ".join(["e_", *(f"{a!r} * cos(2e0 * {j} * x_) * {hyper['sinh'].format(j=j)}" for j, a in enumerate(geo.ALPHA, 1))])
    to_n = " + ".join(["x_", *(f"{a!r} * sin(2e0 * {j} * x_) * {hyper['cosh'].format(j=j)}" for j, a in enumerate(geo.ALPHA, 1))])
    k = repr(scale * geo.KRUGER_A)
    return f"(SELECT * EXCLUDE (t_, l_, x_, e_), {k} * ({to_e}) AS {e}, {k} * ({to_n}) AS {n} FROM ({x}))"


def haversine(a: str, b: str, c: str, d: str) -> str:
    h = f"(pow(sin((radians({c}) - radians({a})) / 2e0), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2e0), 2))"
    return f"(2e0 * {geo.RADIUS!r} * asin(sqrt({h})))"


def geodesic(source: str, lat1: str, lon1: str, lat2: str, lon2: str, out: str) -> str:
    """SELECT *, out FROM source with the metres on the ellipsoid by Andoyer and Lambert."""
    f = repr(geo.FLATTENING)
    a = f"SELECT *, atan((1e0 - {f}) * tan(radians({lat1}))) AS b1_, atan((1e0 - {f}) * tan(radians({lat2}))) AS b2_ FROM {source}"
    b = f"SELECT *, (b1_ + b2_) / 2e0 AS p_, (b2_ - b1_) / 2e0 AS q_, pow(sin((b2_ - b1_) / 2e0), 2) + cos(b1_) * cos(b2_) * pow(sin(radians({lon2} - {lon1}) / 2e0), 2) AS h_ FROM ({a})"
    c = f"SELECT *, 2e0 * asin(sqrt(h_)) AS s_ FROM ({b})"
    up = "(s_ - sin(s_)) * pow(sin(p_) * cos(q_), 2) / pow(cos(s_ / 2e0), 2)"
    down = "(s_ + sin(s_)) * pow(cos(p_) * sin(q_), 2) / nullif(pow(sin(s_ / 2e0), 2), 0e0)"
    return f"(SELECT * EXCLUDE (b1_, b2_, p_, q_, h_, s_), CASE WHEN h_ = 0 THEN 0e0 ELSE {geo.AXIS!r} * (s_ - {f} / 2e0 * ({up} + {down})) END AS {out} FROM ({c}))"


def normal_quantile(share: str) -> str:
    def power(x: str, of: tuple[float, ...]) -> str:
        out = repr(of[0])
        for a in of[1:]:
            out = f"({out} * {x} + {a!r})"
        return out

    tail = lambda p: f"({power(f'sqrt(-2e0 * ln({p}))', draws._C)} / ({power(f'sqrt(-2e0 * ln({p}))', draws._D)} * sqrt(-2e0 * ln({p})) + 1e0))"
    q = f"({share} - 0.5e0)"
    middle = f"({power(f'({q} * {q})', draws._A)} * {q} / ({power(f'({q} * {q})', draws._B)} * ({q} * {q}) + 1e0))"
    return f"CASE WHEN {share} < {draws._TAIL!r} THEN {tail(share)} WHEN {share} > {1 - draws._TAIL!r} THEN -{tail(f'(1e0 - {share})')} ELSE {middle} END"


def uniform(seed: int, *parts: str) -> str:
    key = " || ':' || ".join([f"'{seed}'", *(f"CAST({p} AS VARCHAR)" for p in parts)])
    return f"(CAST(('0x' || substr(md5({key}), 1, 13)) AS BIGINT) / 4503599627370496e0)"


def md5_key(seed: int, *parts: str) -> str:
    return "md5(" + " || ':' || ".join([f"'{seed}'", *(f"CAST({p} AS VARCHAR)" for p in parts)]) + ")"
