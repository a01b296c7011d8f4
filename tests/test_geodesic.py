"""Places on lines of a sphere against dense sampling, and the interactive routing against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from urbanloom.functions import columns as C
from urbanloom.operators import geodesic, networks, routing


def km(p, q):
    (a, b), (c, d) = (np.radians(p), np.radians(q))
    h = math.sin((d - b) / 2) ** 2 + math.cos(b) * math.cos(d) * math.sin((c - a) / 2) ** 2
    return 2 * C.EARTH_RADIUS_KM * math.asin(math.sqrt(h))


def unit(p):
    lam, phi = np.radians(p)
    return np.array([math.cos(phi) * math.cos(lam), math.cos(phi) * math.sin(lam), math.sin(phi)])


def on_arc(p, q, share):
    a, b = unit(p), unit(q)
    angle = math.acos(min(1.0, a @ b))
    v = a if angle == 0 else (math.sin((1 - share) * angle) * a + math.sin(share * angle) * b) / math.sin(angle)
    return math.degrees(math.atan2(v[1], v[0])), math.degrees(math.atan2(v[2], math.hypot(v[0], v[1])))


def test_nearest_place_on_a_segment(spark):
    rng = np.random.default_rng(2)
    rows = [tuple(map(float, (*rng.uniform(-2, 2, 2), *rng.uniform(-2, 2, 2), *rng.uniform(-2, 2, 2)))) for _ in range(60)]
    rows += [(0.0, 1.0, 0.5, 0.5, 0.5, 0.5), (10.0, 60.0, 0.0, 60.0, 20.0, 60.0), (170.0, 10.0, 179.0, 10.0, -179.0, 10.5)]
    frame = spark.createDataFrame(rows, "lon double, lat double, a double, b double, c double, d double")
    got = frame.withColumn("at", geodesic.nearest_on_segment(*[F.col(c) for c in frame.columns])).collect()
    for r in got:
        sampled = min(km((r.lon, r.lat), on_arc((r.a, r.b), (r.c, r.d), t)) for t in np.linspace(0, 1, 2001))
        found = km((r.lon, r.lat), (r["at"].lon, r["at"].lat))
        assert found <= sampled + 1e-9 and found == pytest.approx(sampled, abs=1e-2)


def test_along_a_line(spark):
    line = [(0.0, 50.0), (0.1, 50.0), (0.1, 50.0), (0.1, 50.2)]
    segs = networks.segments(spark, [line])
    first, total = km(line[0], line[1]), km(line[0], line[1]) + km(line[2], line[3])
    places = spark.createDataFrame([(0, x) for x in (-1.0, 0.0, first / 2, first + 1, total, total + 9)], "line_id long, location double")
    got = {r.location: (r.lon, r.lat) for r in geodesic.along(segs, places).collect()}
    assert got[-1.0] == pytest.approx(line[0]) and got[0.0] == pytest.approx(line[0]) and got[total + 9] == pytest.approx(line[3]) and got[total] == pytest.approx(line[3])
    assert got[first / 2] == pytest.approx(on_arc(line[0], line[1], 0.5)) and km(got[first + 1], line[1]) == pytest.approx(1)
    near = geodesic.nearest_on_lines(spark.createDataFrame([(7, 0.11, 50.1)], "point_id long, x double, y double"), segs).first()
    assert near.km == pytest.approx(km((0.11, 50.1), (near.lon, near.lat))) and near.location == pytest.approx(first + km(line[1], (near.lon, near.lat)), abs=1e-9)


POINTS = [(0.0, 50.0), (0.05, 50.01), (0.1, 50.001), (0.2, 50.02), (0.11, 50.09)]


def times(frame):
    found = np.full((len(POINTS), len(POINTS)), np.nan)
    for r in frame.collect():
        found[r.o_idx, r.d_idx] = r.minutes
    return found


def brute(lines, stations, off, on):
    """Straight lines of one segment each, cut at crossings and entries, by Floyd's method."""
    def nearest(p):
        best = min(((km(p, at), k, km(a, at), at) for k, (a, b) in enumerate(lines) for at in [min((on_arc(a, b, t) for t in np.linspace(0, 1, 20001)), key=lambda q: km(p, q))]), key=lambda x: x[0])
        return best

    entries = [nearest(p) for p in (stations or POINTS)]
    stops = {k: [(0.0, a), (km(a, b), b)] for k, (a, b) in enumerate(lines)}
    for i, (p, q) in enumerate(lines):
        for j, (r, s) in enumerate(lines):
            d, e, f = np.subtract(q, p), np.subtract(s, r), np.subtract(r, p)
            cross = d[0] * e[1] - d[1] * e[0]
            if i != j and cross and 0 <= (t := (f[0] * e[1] - f[1] * e[0]) / cross) <= 1 and 0 <= (f[0] * d[1] - f[1] * d[0]) / cross <= 1:
                at = (p[0] + t * d[0], p[1] + t * d[1])
                stops[i].append((km(p, at), at))
    for _, k, place, at in entries:
        stops[k].append((place, at))
    name = lambda p: (round(p[0], 5), round(p[1], 5))
    nodes = sorted({name(p) for s in stops.values() for _, p in s})
    far = np.where(np.eye(len(nodes)) > 0, 0.0, np.inf)
    for s in stops.values():
        s.sort()
        for (x, p), (y, q) in zip(s, s[1:], strict=False):
            i, j = nodes.index(name(p)), nodes.index(name(q))
            far[i, j] = far[j, i] = min(far[i, j], y - x)
    for k in range(len(nodes)):
        far = np.minimum(far, far[:, k, None] + far[None, k])
    at = [nodes.index(name(p)) for *_, p in entries]
    out = np.array([[1.0 if i == j else km(p, q) / off * 60 for j, q in enumerate(POINTS)] for i, p in enumerate(POINTS)])
    for i, p in enumerate(POINTS):
        for j, q in enumerate(POINTS):
            if stations:
                routes = [km(p, entries[a][3]) / off * 60 + far[at[a], at[b]] / on * 60 + km(q, entries[b][3]) / off * 60 for a in range(len(at)) for b in range(len(at))]
            else:
                routes = [(entries[i][0] + entries[j][0]) / off * 60 + far[at[i], at[j]] / on * 60]
            out[i, j] = min(out[i, j], *routes)
    return out


LINES = [((0.0, 50.0), (0.21, 50.0)), ((0.1, 49.95), (0.1, 50.1))]
STATIONS = [(0.01, 50.001), (0.1, 50.08), (0.2, 50.01)]


@pytest.mark.parametrize("stations", [None, STATIONS])
def test_composed_networks(spark, monkeypatch, stations):
    points = spark.createDataFrame([(k, *p) for k, p in enumerate(POINTS)], "loc_idx long, x double, y double")
    network = lambda lines, places: routing.Network.of(spark, [list(line) for line in lines], places or [])
    before, after = geodesic.composed_times(points, network(LINES[:1], stations[:2] if stations else None), network(LINES[1:], stations[2:] if stations else None), 5.0, 60.0)
    assert times(before) == pytest.approx(brute(LINES[:1], stations[:2] if stations else None, 5.0, 60.0), abs=2e-2)
    assert times(after) == pytest.approx(brute(LINES, stations, 5.0, 60.0), abs=2e-2)
    monkeypatch.setattr(routing, "MAX_ACCESS_BYTES", 0)
    if stations:
        again = geodesic.network_times(points, network(LINES, stations).segs, network(LINES, stations).stations, 5.0, 60.0)
        assert times(again) == pytest.approx(times(after), abs=1e-9)
    monkeypatch.undo()
    direct = times(geodesic.network_times(points, None, None, 5.0, 60.0))
    assert np.diag(direct) == pytest.approx(1) and direct[0, 2] == pytest.approx(km(POINTS[0], POINTS[2]) / 5 * 60)
