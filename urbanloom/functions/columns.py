"""Scalar functions as Column expressions; all of them stay in generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0088


def rounded(value: Column, digits: int = 6) -> Column:
    """Rounded, with negative zero turned into zero."""
    return F.round(value, digits) + F.lit(0.0)


def canonical_id(value: Column) -> Column:
    """Trimmed, without a ``cell_id``/``location_id`` prefix, integral decimals as integers; missing ones raise."""
    text = F.trim(value.cast("string"))
    text = F.regexp_replace(text, "(?i)^(cell_id|location_id)[_ ]?", "")
    text = F.when(text.rlike("^[+-]?[0-9]+[.]0+$"), F.regexp_replace(text, "[.]0+$", "")).otherwise(text)
    bad = text.isNull() | F.lower(text).isin("", "nan", "none")
    return F.when(bad, F.raise_error(F.lit("missing location identifier"))).otherwise(text)


def percent_change(counterfactual: Column, baseline: Column) -> Column:
    """100 (c - b) / b; NaN where the baseline is 0."""
    return F.when(baseline != 0, 100 * (counterfactual - baseline) / baseline).otherwise(F.lit(float("nan")))


def strict_percent_change(counterfactual: Column, baseline: Column) -> Column:
    """As percent_change, and NaN unless both are finite."""
    finite = lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.when(finite(counterfactual) & finite(baseline) & (baseline != 0), 100 * (counterfactual - baseline) / baseline).otherwise(F.lit(float("nan")))


def package_percent_change(counterfactual: Column, baseline: Column) -> Column:
    """Null where the baseline is within 1e-12 of 0."""
    return F.when(F.abs(baseline) > 1e-12, 100 * (counterfactual - baseline) / baseline)


def hat_percent(hat: Column) -> Column:
    return 100 * (hat - 1)


def is_changed(hat: Column) -> Column:
    """Not close to 1 (relative 1e-5, absolute 1e-8)."""
    return F.abs(hat - 1) > 1e-8 + 1e-5


def near_zero_snapped(value: Column) -> Column:
    return F.when(F.abs(value) < 1e-10, 0.0).otherwise(value)


def to_minutes(value: Column, unit: str) -> Column:
    scale = {"minutes": value, "seconds": value / 60, "hours": value * 60}
    if unit not in scale:
        raise ValueError(f"unknown time unit {unit!r}")
    return scale[unit]


def metres_per_minute(kmh: float) -> float:
    return kmh * 1000 / 60


def strict_double(value: Column, label: str) -> Column:
    """The value as a double; a value that is no number raises."""
    number = F.try_cast(value, "double") if hasattr(F, "try_cast") else value.try_cast("double")
    return F.when(number.isNull(), F.raise_error(F.concat(F.lit(f"{label} is not numeric: "), F.coalesce(value.cast("string"), F.lit("null"))))).otherwise(number)


def coerced_double(value: Column) -> Column:
    """The value as a double, NaN where it is no number."""
    return F.coalesce(value.try_cast("double"), F.lit(float("nan")))


def distance(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.hypot(x1 - x0, y1 - y0)


def haversine_km(lon0: Column, lat0: Column, lon1: Column, lat1: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat1 - lat0) / 2), 2) + F.cos(F.radians(lat0)) * F.cos(F.radians(lat1)) * F.pow(F.sin(F.radians(lon1 - lon0) / 2), 2)
    return 2 * EARTH_RADIUS_KM * F.asin(F.sqrt(a))


def slug(value: Column) -> Column:
    text = F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), "[^a-z0-9]+", "-")
    return F.regexp_replace(text, "^-+|-+$", "")


def significant3(value: float) -> str:
    """Three significant digits, for the few class labels made on the driver."""
    return f"{value:.3g}"


# Polygons are arrays of rings, rings arrays of (x, y) structs. A ring inside an even number of the others is a shell, else a hole.


def _turns(ring: Column) -> Column:
    return F.zip_with(ring, F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def _sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda total, x: total + x)


def ring_signed_area(ring: Column) -> Column:
    return _sum(F.transform(_turns(ring), lambda t: t["a"]["x"] * t["b"]["y"] - t["b"]["x"] * t["a"]["y"])) / 2


def ring_signs(rings: Column) -> Column:
    """1 for each ring that is a shell, -1 for a hole. Rings that touch do so in points, so the middle of an edge decides."""

    def sign(ring: Column, k: Column) -> Column:
        x, y = ((F.get(ring, F.lit(0))[c] + F.get(ring, F.lit(1))[c]) / 2 for c in "xy")
        around = F.filter(rings, lambda other, j: (j != k) & point_in_ring(x, y, other))
        return F.when(F.size(around) % 2 == 0, 1.0).otherwise(-1.0)

    return F.when(F.size(rings) == 1, F.array(F.lit(1.0))).otherwise(F.transform(rings, sign))


def polygon_area(rings: Column) -> Column:
    return _sum(F.zip_with(rings, ring_signs(rings), lambda ring, sign: sign * F.abs(ring_signed_area(ring))))


def polygon_centroid(rings: Column) -> Column:
    """(x, y) of the centroid of all shells less all holes; the mean of the points where the area is 0."""
    weights = F.zip_with(rings, ring_signs(rings), lambda ring, sign: sign * F.abs(ring_signed_area(ring)))
    whole = _sum(weights)
    moment = lambda axis: _sum(F.zip_with(rings, weights, lambda ring, w: F.when(w != 0, w * ring_centroid(ring)[axis]).otherwise(0.0)))
    points = F.flatten(rings)
    mean = lambda axis: F.try_divide(_sum(F.transform(points, lambda p: p[axis])), F.size(points))
    return F.struct(*[F.when(whole != 0, moment(axis) / whole).otherwise(mean(axis)).alias(axis) for axis in "xy"])


def ring_centroid(ring: Column) -> Column:
    """(x, y) of a ring's centroid; the mean of its points where its area is 0."""
    cross = lambda t: t["a"]["x"] * t["b"]["y"] - t["b"]["x"] * t["a"]["y"]
    area = ring_signed_area(ring)
    x = _sum(F.transform(_turns(ring), lambda t: (t["a"]["x"] + t["b"]["x"]) * cross(t)))
    y = _sum(F.transform(_turns(ring), lambda t: (t["a"]["y"] + t["b"]["y"]) * cross(t)))
    mean = lambda axis: _sum(F.transform(ring, lambda p: p[axis])) / F.size(ring)
    return F.struct(
        F.when(area != 0, x / (6 * area)).otherwise(mean("x")).alias("x"),
        F.when(area != 0, y / (6 * area)).otherwise(mean("y")).alias("y"),
    )


def point_in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd rule by crossings of a ray to the right."""
    crosses = F.filter(
        _turns(ring),
        lambda t: ((t["a"]["y"] > y) != (t["b"]["y"] > y))
        & (x < t["a"]["x"] + (y - t["a"]["y"]) * (t["b"]["x"] - t["a"]["x"]) / F.when(t["b"]["y"] != t["a"]["y"], t["b"]["y"] - t["a"]["y"]).otherwise(1.0)),
    )
    return F.size(crosses) % 2 == 1


def point_in_polygon(x: Column, y: Column, rings: Column) -> Column:
    inside = F.size(F.filter(rings, lambda ring: point_in_ring(x, y, ring)))
    return inside % 2 == 1


def box_ring(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    point = lambda a, b: F.struct(a.cast("double").alias("x"), b.cast("double").alias("y"))
    return F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1))


def box_overlap(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Overlap area of two boxes (x0, y0, x1, y1)."""
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


# Transverse Mercator on WGS84 by the Krüger series to the sixth order in n.
_A, _FLAT = 6378137.0, 1 / 298.257223563
_N = _FLAT / (2 - _FLAT)
_RECTIFIED = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64 + _N**6 / 256)
_ALPHA = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180 - 127 * _N**5 / 288 + 7891 * _N**6 / 37800,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440 + 281 * _N**5 / 630 - 1983433 * _N**6 / 1935360,
    61 * _N**3 / 240 - 103 * _N**4 / 140 + 15061 * _N**5 / 26880 + 167603 * _N**6 / 181440,
    49561 * _N**4 / 161280 - 179 * _N**5 / 168 + 6601661 * _N**6 / 7257600,
    34729 * _N**5 / 80640 - 3418889 * _N**6 / 1995840,
    212378941 * _N**6 / 319334400,
)
_BETA = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360 - 81 * _N**5 / 512 + 96199 * _N**6 / 604800,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440 + 46 * _N**5 / 105 - 1118711 * _N**6 / 3870720,
    17 * _N**3 / 480 - 37 * _N**4 / 840 - 209 * _N**5 / 4480 + 5569 * _N**6 / 90720,
    4397 * _N**4 / 161280 - 11 * _N**5 / 504 - 830251 * _N**6 / 7257600,
    4583 * _N**5 / 161280 - 108847 * _N**6 / 3991680,
    20648693 * _N**6 / 638668800,
)
_ECC = math.sqrt(_FLAT * (2 - _FLAT))
UTM_SCALE, UTM_EAST, UTM_SOUTH = 0.9996, 500_000.0, 10_000_000.0


def utm_zone(lon: Column) -> Column:
    return (F.floor((lon + 180) / 6) % 60 + 1).cast("int")


def utm_forward(lon: Column, lat: Column, zone: Column) -> Column:
    """(x, y) in metres in a UTM zone; southern latitudes get the false northing."""
    delta = F.radians(lon - (zone * 6 - 183))
    s = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(s) - _ECC * F.atanh(_ECC * s))
    xi, eta = F.atan2(t, F.cos(delta)), F.atanh(F.sin(delta) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for k, a in enumerate(_ALPHA, 1):
        x = x + a * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
        y = y + a * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
    north = F.when(lat < 0, UTM_SOUTH).otherwise(0.0)
    return F.struct((UTM_EAST + UTM_SCALE * _RECTIFIED * x).alias("x"), (north + UTM_SCALE * _RECTIFIED * y).alias("y"))


def utm_inverse(x: Column, y: Column, zone: Column, south: Column) -> Column:
    """(lon, lat) in degrees of a point in a UTM zone."""
    eta = (x - UTM_EAST) / (UTM_SCALE * _RECTIFIED)
    xi = (y - F.when(south, UTM_SOUTH).otherwise(0.0)) / (UTM_SCALE * _RECTIFIED)
    a, b = xi, eta
    for k, c in enumerate(_BETA, 1):
        a = a - c * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
        b = b - c * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
    tau = F.sin(a) / F.sqrt(F.pow(F.sinh(b), 2) + F.pow(F.cos(a), 2))
    sine = tau / F.sqrt(1 + tau * tau)
    for _ in range(6):  # the conformal latitude's fixed point settles below 1e-15 radians
        sine = F.tanh(F.asinh(tau) + _ECC * F.atanh(_ECC * sine))
    return F.struct((zone * 6 - 183 + F.degrees(F.atan2(F.sinh(b), F.cos(a)))).alias("lon"), F.degrees(F.asin(sine)).alias("lat"))


def web_mercator(lon: Column, lat: Column) -> Column:
    return F.struct((F.radians(lon) * _A).alias("x"), (F.log(F.tan(F.radians(lat) / 2 + math.pi / 4)) * _A).alias("y"))
