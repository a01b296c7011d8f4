"""Interpolation, shocks, grids, routing, overlays and classes against known figures and brute force."""

import heapq
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from urbanloom.errors import GridInputError, ScenarioInputError
from urbanloom.functions import columns as C
from urbanloom.operators import geometry, matrices, networks, paths, reporting, routing, spatial
from urbanloom.plans import registry


def ring(*points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


def box(x0, y0, x1, y1):
    return [ring((x0, y0), (x1, y0), (x1, y1), (x0, y1))]


def polygons(spark, rows, id_name, columns=""):
    return spark.createDataFrame(rows, f"{id_name} long, rings {spatial.RINGS}{columns}")


@pytest.mark.parametrize("exact", [True, False])
def test_area_interpolation(spark, exact):
    source = polygons(spark, [(0, box(0, 0, 1, 1), 100.0, 10.0), (1, box(1, 0, 2, 1), 200.0, 30.0)], "source_id", ", population double, rent double")
    target = polygons(spark, [(1, box(0, 0, 1.5, 1)), (2, box(1.5, 0, 2, 1)), (3, box(9, 9, 10, 10))], "target_id")
    got = {r.target_id: r for r in spatial.area_interpolate(source, target, ["population"], ["rent"], bucket=1.0, exact_boxes=exact).collect()}
    assert got[1].population == pytest.approx(200) and got[2].population == pytest.approx(100) and got[3].population == 0
    assert got[1].rent == pytest.approx(25 / 1.5) and got[2].rent == pytest.approx(30) and math.isnan(got[3].rent)
    report = spatial.allocation_report(source, spatial.area_interpolate(source, target, ["population"], bucket=1.0, exact_boxes=exact), ["population"]).first()
    assert report.ratio == pytest.approx(1)
    with pytest.raises(GridInputError, match="no column"):
        spatial.area_interpolate(source, target, ["jobs"])


def test_overlap_of_concave_polygons_and_holes():
    shared = lambda a, b: geometry.shared_areas([a], [b])[0]
    u = [np.array([(0, 0), (6, 0), (6, 5), (4, 5), (4, 2), (2, 2), (2, 5), (0, 5)], float)]
    assert shared(u, [np.array([(0, 3), (6, 3), (6, 4), (0, 4)], float)]) == pytest.approx(4)
    assert shared(u, u) == pytest.approx(24)
    holed = [np.array([(0, 0), (4, 0), (4, 4), (0, 4)], float), np.array([(1, 1), (3, 1), (3, 3), (1, 3)], float)]
    assert shared(holed, [np.array([(0, 0), (2, 0), (2, 2), (0, 2)], float)]) == pytest.approx(3)
    assert shared([np.array([(0, 0), (2, 0), (2, 2), (0, 2)], float)], holed) == pytest.approx(3)


def test_shocks(spark):
    places = polygons(spark, [(0, box(0, 0, 10, 10)), (1, box(10, 0, 20, 10))], "loc_idx")
    policy = polygons(spark, [(0, box(0, 0, 5, 10), 1.2)], "policy_id", ", productivity_hat double")
    got = {r.loc_idx: r for r in spatial.shock_hats(policy, places, bucket=10.0).collect()}
    assert got[0].productivity_hat == pytest.approx(1.1) and got[1].productivity_hat == 1 and got[0].amenity_hat == 1
    assert got[0].coverage == pytest.approx(0.5) and got[1].coverage == 0
    two = polygons(spark, [(0, box(0, 0, 8, 10), 1.2), (1, box(2, 0, 10, 10), 1.1)], "policy_id", ", productivity_hat double")
    with pytest.raises(ScenarioInputError, match="overlap"):
        spatial.shock_hats(two, places, bucket=10.0)
    with pytest.raises(ScenarioInputError, match="positive"):
        spatial.shock_hats(policy.withColumn("productivity_hat", F.lit(0.0)), places, bucket=10.0)
    with pytest.raises(ScenarioInputError, match="no hat"):
        spatial.shock_hats(policy.drop("productivity_hat"), places, bucket=10.0)


def test_hexagons_have_the_square_s_area_and_tile(spark):
    grid = spatial.hexagon_grid(spark, (0, 0, 5000, 4000), (2500, 2000), 1000.0)
    areas = grid.select(C.polygon_area(F.col("rings")).alias("a")).agg(F.min("a"), F.max("a")).first()
    assert areas[0] == pytest.approx(1e6) and areas[1] == pytest.approx(1e6)
    probe = spark.createDataFrame([(float(x), float(y)) for x in range(137, 5000, 531) for y in range(211, 4000, 617)], "px double, py double")
    hits = probe.crossJoin(grid).where(C.point_in_polygon(F.col("px"), F.col("py"), F.col("rings"))).groupBy("px", "py").count()
    assert hits.count() == probe.count() and hits.where("count <> 1").count() == 0


def test_square_grid_covers_its_bounds(spark):
    cells = spatial.square_grid(spark, (0, 0, 2500, 1000), (1250, 500), 1000.0).collect()
    assert [c.grid_sequence for c in sorted(cells, key=lambda c: (-c.y0, c.x0))] == list(range(1, len(cells) + 1))
    assert min(c.x0 for c in cells) <= 0 and max(c.x1 for c in cells) >= 2500 and min(c.y0 for c in cells) <= 0


def test_utm_against_known_points(spark):
    """Zone 33's central meridian, the equator, and the quarter meridian's length times the scale."""
    rows = [(15.0, 0.0), (15.0, 60.0), (12.0, -35.0), (16.5, 48.2)]
    frame = spark.createDataFrame(rows, "lon double, lat double").withColumn("p", C.utm_forward(F.col("lon"), F.col("lat"), F.lit(33)))
    got = [(r.p.x, r.p.y) for r in frame.collect()]
    assert got[0] == pytest.approx((500_000, 0), abs=1e-6)
    assert got[1] == pytest.approx((500_000, 0.9996 * 6654072.819), abs=1e-2)
    assert got[2][1] > 6_000_000
    back = frame.withColumn("q", C.utm_inverse(F.col("p.x"), F.col("p.y"), F.lit(33), F.col("lat") < 0)).collect()
    assert all(abs(r.q.lon - a) < 1e-9 and abs(r.q.lat - b) < 1e-9 for r, (a, b) in zip(back, rows, strict=True))


POINTS = [(0, 500), (600, 450), (1200, 550), (1800, 500), (2400, 450), (3000, 550)]
STATIONS = [(0.0, 0.0), (1500.0, 0.0), (3000.0, 0.0)]
EXPECTED = [
    [0, 9.0311959341, 18.0156182242, 18.8180564137, 23.8930571429, 20.8930571429],
    [9.0311959341, 0, 9.1241437954, 18.0156182242, 27.0, 24.6430571429],
    [18.0156182242, 9.1241437954, 0, 9.0311959341, 18.0623918682, 20.2191016360],
    [18.8180564137, 18.0156182242, 9.0311959341, 0, 9.0311959341, 18.0156182242],
    [23.8930571429, 27.0, 18.0623918682, 9.0311959341, 0, 9.1241437954],
    [20.8930571429, 24.6430571429, 20.2191016360, 18.0156182242, 9.1241437954, 0],
]


def places(spark, points=POINTS):
    return spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(points)], "loc_idx long, x double, y double")


def as_array(od, n):
    m = np.full((n, n), np.nan)
    for r in od.collect():
        m[r.o_idx, r.d_idx] = r.minutes
    return m


def test_standalone_routing(spark):
    edges = routing.augmented_graph(places(spark), routing.Network.of(spark, [STATIONS], STATIONS), routing.RoutingSettings(), 700.0)
    times = as_array(paths.shortest_paths(edges, places(spark)), 6)
    assert times == pytest.approx(np.array(EXPECTED), abs=1e-9)
    assert as_array(paths.relaxation(edges, places(spark)), 6) == pytest.approx(times, abs=1e-12)
    fixed = as_array(matrices.intrazonal(paths.shortest_paths(edges, places(spark)), "configured_constant", 1.0), 6)
    assert (np.diag(fixed) == 1).all()


def test_direct_station_access(spark, monkeypatch):
    points = [(0, 500), (1000, 500), (2000, 500), (3000, 500)]
    settings = routing.RoutingSettings(walking_kmh=5, network_kmh=60)
    run = lambda c: as_array(routing.travel_times(places(spark, points), routing.Network.of(spark, [[(0, 0), (3000, 0)]], STATIONS), settings, "legacy_access_network_egress", c), 4)
    walk, ride = 5000 / 60, 1000.0
    p, s = np.array(points, float), np.array(STATIONS)
    access = np.hypot(*(p[:, None] - s[None]).transpose(2, 0, 1)) / walk
    net = np.abs(s[:, None, 0] - s[None, :, 0]) / ride
    direct = np.hypot(*(p[:, None] - p[None]).transpose(2, 0, 1)) / walk
    brute = np.minimum(direct, (access[:, None, :, None] + net[None, None] + access[None, :, None, :]).min(axis=(2, 3)))
    assert run(None) == pytest.approx(brute, abs=1e-12)
    monkeypatch.setattr(routing, "MAX_ACCESS_BYTES", 0)  # the same by joins of tables
    assert run(None) == pytest.approx(brute, abs=1e-12)
    joined = run(1)
    monkeypatch.undo()
    one = run(1)
    assert one == pytest.approx(joined, abs=1e-12)
    assert one == pytest.approx(one.T) and (one <= direct + 1e-12).all()


def test_null_counterfactual_is_identical(spark):
    points = places(spark, [(0, 0), (1000, 0), (0, 1000)])
    od = matrices.intrazonal(routing.travel_times(points, None, routing.RoutingSettings(walking_kmh=20, network_kmh=33)), "configured_constant", 1.0)
    row = matrices.summary(od, od).first()
    assert (row.improved, row.unchanged, row.slower) == (0, 9, 0)


def test_unreachable_and_components(spark):
    edges = spark.createDataFrame([("p:0", "p:1", 1.0, "point_walk")], "src string, dst string, minutes double, kind string")
    points = places(spark, [(0, 0), (1, 0), (9, 9)])
    od = paths.shortest_paths(edges, points)
    assert od.where(F.col("minutes") == float("inf")).count() == 4
    with pytest.raises(ValueError, match="unreachable"):
        routing.require_reachable(od)
    assert routing.require_reachable(od, "keep") is od
    nodes = spark.createDataFrame([(k,) for k in range(4)], "node long")
    got = {r.node: r.component for r in spatial.components(nodes, spark.createDataFrame([(0, 1), (2, 1)], "a long, b long")).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3}


def as_lines(segs):
    lines = {}
    for r in segs.orderBy("line_id", "seg").collect():
        lines.setdefault(r.line_id, []).append(((r.x0, r.y0), (r.x1, r.y1)))
    return lines


def test_snapping_and_splitting(spark):
    snap = lambda lines, tolerance: as_lines(networks.snap_ends(networks.segments(spark, lines), tolerance))
    lines = snap([[(0, 0), (10, 0)], [(10.6, 0), (20, 0)], [(50, 0), (60, 0)]], 1.0)
    assert lines[0][0][1] == lines[1][0][0] == pytest.approx((10.3, 0)) and lines[2] == [((50, 0), (60, 0))]
    assert snap([[(0, 0), (0.1, 0)]], 0) == {0: [((0, 0), (0.1, 0))]}
    assert networks.moved_ends([(0, 0), (0.5, 0), (1.2, 0)], 1.0) == {(0, 0): (0.25, 0), (0.5, 0): (0.85, 0), (1.2, 0): (0.85, 0)}
    stations = spark.createDataFrame([(0, 5.0, 0.3)], "station long, x double, y double")
    split = networks.split_at_stations(networks.segments(spark, [[(0, 0), (10, 0)], [(0, float("nan")), (1, 1)]]), stations, 0.5)
    pieces = as_lines(split.segs)
    assert len(pieces[0]) == 3 and pieces[0][1] == (pytest.approx((4.6, 0)), pytest.approx((5.4, 0)))
    assert [r.line_id for r in split.failed.collect()] == [1] and len(pieces[1]) == 1


def brute_crossings(lines):
    parts = [(i, k, np.array(p), np.array(q)) for i, line in enumerate(lines) for k, (p, q) in enumerate(zip(line, line[1:], strict=False))]
    found = set()
    for a, (i, k, p, q) in enumerate(parts):
        for j, m, r, s in parts[a + 1 :]:
            d, e, f = q - p, s - r, r - p
            cross = d[0] * e[1] - d[1] * e[0]
            if abs(cross) < 1e-12:
                continue
            t, u = (f[0] * e[1] - f[1] * e[0]) / cross, (f[0] * d[1] - f[1] * d[0]) / cross
            if 0 <= t <= 1 and 0 <= u <= 1:
                found |= {x for x in ((i, k, round(t, 9)), (j, m, round(u, 9))) if 0 < x[2] < 1}
    return found


@pytest.mark.parametrize("size", [None, 3.0, 40.0, 1000.0])
def test_crossings_against_all_pairs(spark, size):
    rng = np.random.default_rng(8)
    lines = [[tuple(map(float, p)) for p in np.cumsum(rng.normal(0, 12, (9, 2)), axis=0) + rng.uniform(-30, 30, 2)] for _ in range(8)]
    got = networks.crossings(networks.segments(spark, lines), size).collect()
    expect = brute_crossings(lines)
    assert len(expect) > 30 and {(r.line_id, r.seg, round(r.t, 9)) for r in got} == expect
    for r in got:
        p, q = lines[r.line_id][r.seg : r.seg + 2]
        assert (r.x, r.y) == pytest.approx((p[0] + r.t * (q[0] - p[0]), p[1] + r.t * (q[1] - p[1])), abs=1e-8)


def test_parallel_lines_cut_each_other_at_their_ends(spark):
    lines = [[(0, 0), (10, 0)], [(4, 0), (20, 0)], [(0, 1), (9, 1)], [(3, 0), (3, 0)]]
    assert {(r.line_id, r.t) for r in networks.crossings(networks.segments(spark, lines)).collect()} == {(0, 0.4), (1, 0.375)}
    whole = as_lines(networks.noded(networks.segments(spark, lines)))
    assert whole[0] == [((0, 0), (4, 0)), ((4, 0), (10, 0))] and whole[1] == [((4, 0), (10, 0)), ((10, 0), (20, 0))] and 3 not in whole


def test_noding_crossings(spark):
    def distances(lines, stations):
        network = routing.Network.of(spark, lines, stations)
        metres, snapped = networks.station_distances(network.segs, network.stations)
        n = len(stations)
        found = np.zeros((n, n))
        for r in metres.collect():
            found[r.s, r.t] = r.metres
        return found, [(r.x, r.y) for r in snapped.orderBy("station").collect()]

    metres, snapped = distances([[(0, 0), (10, 0)], [(5, -5), (5, 5)]], [(0, 1), (5.2, 5)])
    assert snapped == [(0.0, 0.0), (5.0, 5.0)]
    assert metres == pytest.approx(np.array([[0, 10], [10, 0]]))
    # Two stations on one segment, and one on the crossing.
    metres, _ = distances([[(0, 0), (10, 0)], [(5, -5), (5, 5)]], [(1, 1), (4, -2), (5, 0)])
    assert metres == pytest.approx(np.array([[0, 6, 4], [6, 0, 2], [4, 2, 0]]))
    with pytest.raises(ValueError, match="connect"):
        distances([[(0, 0), (1, 0)], [(5, 5), (6, 5)]], [(0, 0), (6, 5)])


def test_breakpoints_repeat_no_place(spark):
    rows = [(0, 0.0, 1), (0, 5e-9, 0), (0, 1.2e-8, 2), (0, 1.0, 1), (0, 1.0, 0), (0, 2.0, 2), (1, 0.0, 1)]
    frame = spark.createDataFrame([(a, b, b, 0.0, c) for a, b, c in rows], "line_id long, location double, x double, y double, rank int")
    # Each place is compared with the one before it; a stop is where its first rank is.
    got = {(r.line_id, r.location, r["rank"]): (r.stop, r["at"].x) for r in networks.breakpoints(frame).collect()}
    assert [got[r] for r in rows] == [(1, 5e-9), (1, 5e-9), (1, 5e-9), (2, 1.0), (2, 1.0), (3, 2.0), (1, 0.0)]


def heap_times(n, edges, origin):
    best, heap = {origin: 0.0}, [(0.0, origin)]
    while heap:
        d, a = heapq.heappop(heap)
        if d > best[a]:
            continue
        for b, w in edges[a]:
            if d + w < best.get(b, float("inf")):
                best[b] = d + w
                heapq.heappush(heap, (d + w, b))
    return [best.get(k, float("inf")) for k in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_labels_against_a_heap(seed):
    rng = np.random.default_rng(seed)
    n, m = 80, 160
    a, b = rng.integers(0, n, m), rng.integers(0, n, m)
    w = rng.choice([0.0, 1.0, 2.5, 40.0], m) + rng.uniform(0, 1, m) * (seed > 0)
    edges = [[] for _ in range(n)]
    for x, y, c in zip(a.tolist(), b.tolist(), w.tolist(), strict=True):
        edges[x].append((y, c))
        edges[y].append((x, c))
    origins = np.array([0, 5, 33, 79])
    got = paths.labels(paths.Arcs.both_ways(a, b, w, n), origins)
    for k, o in enumerate(origins):
        assert got[:, k].tolist() == pytest.approx(heap_times(n, edges, int(o)), abs=1e-12)


def test_large_graphs_stay_in_tables(spark, monkeypatch):
    points = places(spark, [(float(k % 5), float(k // 5)) for k in range(25)])
    edges = routing.walking_graph(points, routing.RoutingSettings(), 2.0)
    dense = as_array(paths.shortest_paths(edges, points), 25)
    monkeypatch.setattr(paths, "MAX_GRAPH_BYTES", 0)
    assert as_array(paths.shortest_paths(edges, points), 25) == pytest.approx(dense, abs=1e-12)
    monkeypatch.undo()
    monkeypatch.setattr(paths, "BATCH", 7)
    monkeypatch.setattr(paths, "PIECE_ROWS", 60)
    assert as_array(paths.shortest_paths(edges, points), 25) == pytest.approx(dense, abs=1e-12)


def test_graph_report(spark):
    points, network = places(spark), routing.Network.of(spark, [STATIONS], STATIONS)
    split = routing.split_network(network, routing.RoutingSettings())
    report = {r.kind: r.n_edges for r in routing.graph_report(routing.augmented_graph(points, network, routing.RoutingSettings(), 700.0, split), points, split.failed).collect()}
    assert report["walking_components"] == 1 and report["failed_splits"] == 0 and report["station_connector"] == len(STATIONS)


@pytest.mark.parametrize("k", [1, 3])
def test_nearest_against_brute_force(spark, k):
    rng = np.random.default_rng(4)
    a, b = rng.uniform(0, 100, (40, 2)), np.concatenate((rng.uniform(0, 10, (15, 2)), rng.uniform(90, 100, (5, 2))))
    left = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(a)], "point_id long, x double, y double")
    right = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(b)], "target_id long, x double, y double")
    got = {(r.point_id, r["rank"]): r.target_id for r in spatial.nearest(left, right, k, 5.0).collect()}
    far = np.hypot(*(a[:, None] - b[None]).transpose(2, 0, 1))
    assert got == {(i, r + 1): int(j) for i in range(40) for r, j in enumerate(np.argsort(far[i])[:k])}


def test_network_layers(spark):
    segs = lambda lines: networks.segments(spark, lines)
    before, after = segs([[(0, 5), (10, 5)], [(0, 8), (5, 8)]]), segs([[(0, 5), (20, 5)]])
    existing, added, removed = reporting.overlay_layers(before, after)
    assert existing.select("line_id").distinct().count() == 2
    assert added.agg(F.sum("length")).first()[0] == pytest.approx(9)
    assert removed.agg(F.sum("length")).first()[0] > 3
    assert reporting.overlay_layers(before, None) == (before, None, None)
    assert reporting.overlay_layers(None, after) == (None, after, None)


def test_map_classes(spark):
    pooled = spark.createDataFrame([(float(x),) for x in (-12, -8, -4, -1, 0, 2, 3, 6, 10, 20)], "pct double")
    q1, q2, q3 = reporting.symmetric_thresholds(pooled, "pct").first()
    assert 0 < q1 < q2 < q3
    values = [-2 * q3, -q2, -q1 / 2, 0, q1 / 2, q2, 2 * q3]
    classes = lambda vs, limits: [r.c for r in spark.createDataFrame([(k, None if v is None else float(v)) for k, v in enumerate(vs)], "k long, v double").withColumn("c", reporting.map_class(F.col("v"), *[F.lit(x).cast("double") for x in limits])).orderBy("k").collect()]
    assert classes(values, (q1, q2, q3)) == [0, 1, 3, 3, 3, 5, 6] and len(reporting.class_labels(q1, q2, q3)) == 7
    flat = spark.createDataFrame([(-2.0,), (-2.0,), (0.0,), (2.0,), (2.0,)], "pct double")
    limits = reporting.symmetric_thresholds(flat, "pct").first()
    assert tuple(limits) == (1.0, 2.0, 4.0)
    assert classes([0.0, 0.0, None, float("nan")], (None, None, None)) == [3, 3, None, None] and reporting.class_labels(None) == ["No change"]


def test_identifiers_and_changes(spark):
    frame = spark.createDataFrame([(" cell_id_7 ",), ("LOCATION_ID 12.00",), ("-3.0",), ("a.0",)], "v string")
    assert [r[0] for r in frame.select(C.canonical_id(F.col("v"))).collect()] == ["7", "12", "-3", "a.0"]
    for bad in ("nan", " ", None):
        with pytest.raises(Exception, match="missing location identifier"):
            spark.createDataFrame([(bad,)], "v string").select(C.canonical_id(F.col("v"))).collect()
    got = spark.createDataFrame([(2.0, 0.0), (3.0, 2.0)], "c double, b double").select(C.percent_change(F.col("c"), F.col("b")).alias("p")).collect()
    assert math.isnan(got[0].p) and got[1].p == 50


def test_nearest_line_against_all_pairs(spark):
    draw = random.Random(5)
    lines = [(k, draw.uniform(0, 9000), draw.uniform(0, 9000)) for k in range(40)]
    lines = [(k, x, y, x + draw.uniform(-900, 900), y + draw.uniform(-900, 900)) for k, x, y in lines] + [(40, 5.0, 5.0, 5.0, 5.0), (41, 5.0, 5.0, 5.0, 5.0)]
    points = [(k, draw.uniform(-500, 9500), draw.uniform(-500, 9500)) for k in range(60)] + [(60, 90_000.0, -70_000.0), (61, 5.0, 5.0), (62, None, 1.0), (63, float("nan"), 1.0)]

    def gap(x, y, x0, y0, x1, y1):
        dx, dy = x1 - x0, y1 - y0
        t = max(0.0, min(1.0, ((x - x0) * dx + (y - y0) * dy) / (dx * dx + dy * dy))) if dx or dy else 0.0
        return math.hypot(x - x0 - t * dx, y - y0 - t * dy)

    segments = spark.createDataFrame([*lines, (42, None, 0.0, 0.0, 0.0)], "line_id long, x0 double, y0 double, x1 double, y1 double")
    places = spark.createDataFrame(points, "point_id long, x double, y double")
    expected = {k: min((gap(x, y, *line[1:]), line[0]) for line in lines) for k, x, y in points[:62]}
    for cell in (None, 3000.0):
        got = {r.point_id: (r.distance, r.line_id) for r in spatial.nearest_line(places, segments, cell).collect()}
        assert got.keys() == expected.keys()
        assert all(got[k][1] == expected[k][1] and abs(got[k][0] - expected[k][0]) < 1e-6 for k in got)
    assert spatial.nearest_line(places, segments.limit(0)).count() == spatial.nearest_line(places.limit(0), segments).count() == 0


def test_detours_side_by_side_are_exact(spark):
    """Triangles of 3, 4 and 5 are at 1.4 and not above it, at any size."""
    ways = spark.range(1, 400).select((F.col("id") * 7000.0).alias("minutes"), F.hypot(F.col("id") * 3000.0, F.col("id") * 4000.0).alias("direct"))
    row = matrices.detour_stats_of(ways, 1.4).first()
    assert (row.p99, row.maximum, row.n_above) == (1.4, 1.4, 0)


def test_a_grid_with_detours_at_the_warning_agrees_with_counting(spark, tmp_path):
    side = 24
    spark.range(side * side).select(F.col("id").alias("s_suppkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    steps = [(abs(a % side - b % side), abs(a // side - b // side)) for a in range(side * side) for b in range(side * side) if a != b]
    above = sum(25 * (i + j) ** 2 > 49 * (i * i + j * j) for i, j in steps)  # (i + j) / sqrt(i^2 + j^2) > 7 / 5 in whole numbers
    assert registry.detour_stats(spark, str(tmp_path)).first().n_above == above


def test_all_pairs_are_dealt_to_tasks(spark, monkeypatch):
    points = places(spark, [(k, 2 * k) for k in range(40)]).coalesce(1)
    monkeypatch.setattr(matrices, "TASK_PAIRS", 100)
    od = matrices.direct_minutes(points, 4.0)
    assert od.rdd.getNumPartitions() == 16 and od.select("o_idx", "d_idx").distinct().count() == 1600
    monkeypatch.setattr(matrices, "MAX_BROADCAST_ROWS", 0)
    assert sorted(matrices.direct_minutes(points, 4.0).collect()) == sorted(od.collect())


def test_a_wide_matrix_has_two_columns_at_any_size(spark):
    n = 1500
    points = spark.range(n).select(F.col("id").alias("loc_idx"), (F.col("id") % 40 * 1.0).alias("x"), (F.col("id") / 40).alias("y"))
    sites = points.select("loc_idx", F.col("loc_idx").cast("string").alias("location_id"))
    od = matrices.direct_minutes(points, 20.0)
    header, rows = matrices.long_to_rows(od, sites)
    assert header[:2] == ["location_id_0", "location_id_1"] and len(header) == n and rows.columns == ["location_id", "minutes"]
    back = matrices.rows_to_long(header, rows, sites)
    assert back.count() == n * n
    both = back.join(od.withColumnRenamed("minutes", "was"), ["o_idx", "d_idx"])
    assert both.where("minutes = was").count() == n * n
    with pytest.raises(Exception, match="not one for each"):
        matrices.long_to_rows(od.where("not (o_idx = 3 and d_idx = 5)"), sites)[1].count()


@pytest.mark.parametrize("shape", ["grid", "tree", "parts", "thick"])
def test_dissected_graphs_have_the_same_times(shape):
    rng, side = np.random.default_rng(3), 18
    n = side * side
    x, y = np.arange(n) % side * 1.0, np.arange(n) // side * 1.0
    if shape == "tree":
        a = np.arange(1, n)
        b = rng.integers(0, a)
    elif shape == "thick":
        a, b = np.triu_indices(n, 1)
    else:
        right, up = np.flatnonzero(x < side - 1), np.flatnonzero(y < side - 1)
        a, b = np.concatenate([right, up]), np.concatenate([right + 1, up + side])
        if shape == "parts":
            keep = (x[a] < 9) == (x[b] < 9)
            a, b = a[keep], b[keep]
    arcs = paths.Arcs.both_ways(a, b, rng.uniform(1, 9, len(a)), n)
    some = n // 3  # the others have no place of their own
    dissection, origins = paths.Dissection.of(arcs, np.where(np.arange(some) == 5, np.nan, x[:some]), y[:some]), np.array([0, 7, 7, 200, n - 1])
    assert len(dissection.bound) > 1
    np.testing.assert_allclose(dissection.times(origins)[dissection.number], paths.labels(arcs, origins), rtol=1e-12)


def test_a_dissection_takes_few_sums_on_a_grid_and_is_refused_beyond_a_bound(monkeypatch):
    side = 64
    n = side * side
    x, y = np.arange(n) % side * 1000.0, np.arange(n) // side * 1000.0
    right, up = np.flatnonzero(np.arange(n) % side < side - 1), np.arange(n - side)
    arcs = paths.Arcs.both_ways(np.concatenate([right, up]), np.concatenate([right + 1, up + side]), np.full(len(right) + len(up), 1000.0), n)
    dissection = paths.Dissection.of(arcs, x, y)
    assert sum(i.size + o.size for i, o in zip(dissection.inner, dissection.outer, strict=True)) < 100 * n
    wanted = (np.abs(x[:, None] - x[[0, 77]]) + np.abs(y[:, None] - y[[0, 77]])).tolist()
    assert dissection.times(np.array([0, 77]))[dissection.number].tolist() == wanted
    monkeypatch.setattr(paths, "MAX_DISSECTION_SUMS", 1 << 10)
    assert paths.Dissection.of(arcs, x, y) is None


def test_stations_apart_are_refused_before_the_search(spark, monkeypatch):
    network = routing.Network.of(spark, [[(0.0, 0.0), (9.0, 0.0)], [(0.0, 50.0), (9.0, 50.0)]], [(1.0, 0.0), (2.0, 50.0)])
    for bound in (paths.MAX_GRAPH_BYTES, 0):
        monkeypatch.setattr(paths, "MAX_GRAPH_BYTES", bound)
        with pytest.raises(ValueError, match="connect all stations"):
            networks.station_distances(network.segs, network.stations)


def test_walks_that_no_way_needs_are_left_out(spark, monkeypatch):
    """Many stations on a line: the walks held are few, so a bound that all walks exceed does not lead to tables; times as by tables."""
    n, m = 120, 60
    rng = np.random.default_rng(5)
    points = places(spark, [(float(x), float(y)) for x, y in rng.uniform(0, 60_000, (n, 2))])
    network = routing.Network.of(spark, [[(0.0, 0.0), (59_000.0, 0.0)]], [(1000.0 * k, 0.0) for k in range(m)])
    settings = routing.RoutingSettings()
    run = lambda: as_array(routing.travel_times(points, network, settings, "direct_station_access"), n)
    with monkeypatch.context() as patch:
        patch.setattr(routing, "MAX_ACCESS_BYTES", 0)
        tables = run()
    monkeypatch.setattr(routing, "MAX_ACCESS_BYTES", 8 * n * m)
    monkeypatch.setattr(routing, "direct_station_access", None)
    assert run() == pytest.approx(tables, abs=1e-9)


def test_hubs_do_not_keep_a_graph_from_being_cut():
    """Stations near thousands of locations, as in the augmented graph."""
    side = 60
    n = side * side
    x, y = np.arange(n) % side * 1000.0, np.arange(n) // side * 1000.0
    right, up, places_ = np.flatnonzero(np.arange(n) % side < side - 1), np.arange(n - side), np.arange(n)
    near = [n + np.clip(places_ % side // 6 + k, 0, 9) for k in (-1, 0, 1)]
    a, b = np.concatenate([right, up, *[places_] * 3]), np.concatenate([right + 1, up + side, *near])
    cost = np.random.default_rng(1).uniform(1, 9, len(a))
    arcs = paths.Arcs.both_ways(a, b, cost, n + 10)
    dissection, origins = paths.Dissection.of(arcs, x, y), np.array([5, n - 1])
    assert sum(i.size + o.size for i, o in zip(dissection.inner, dissection.outer, strict=True)) < 120 * n
    np.testing.assert_allclose(dissection.times(origins)[dissection.number], paths.labels(arcs, origins), rtol=1e-12)


def test_pairs_come_in_runs_that_compress(tmp_path, monkeypatch):
    """Each origin's 30,000 destinations in one go took over two bytes a pair for their numbers alone."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.parquet as pq

    from urbanloom.operators import paths

    monkeypatch.setattr(paths, "PIECE_ROWS", 100_000)
    origins, destinations = np.arange(40) * 7, np.arange(30_000) * 3
    minutes = np.round(np.arange(40)[:, None] % 4 + np.arange(30_000) * 0.37, 6)
    batches = list(paths.in_runs(origins, destinations, minutes))
    assert max(b.num_rows for b in batches) <= 100_000
    table = pa.Table.from_batches(batches)
    o, d, m = (table.column(c).to_numpy() for c in ("o_idx", "d_idx", "minutes"))
    order = np.lexsort((d, o))
    np.testing.assert_array_equal(o[order], np.repeat(origins, 30_000))
    np.testing.assert_array_equal(d[order], np.tile(destinations, 40))
    np.testing.assert_array_equal(m[order], minutes.ravel())
    pq.write_table(table, tmp_path / "runs.parquet", compression="snappy")
    assert (tmp_path / "runs.parquet").stat().st_size < 2 * len(o)


def test_a_graph_s_names_reach_the_driver_in_arrow_alone(spark, monkeypatch):
    """As Python's strings and rows, the names of a large graph filled the driver."""
    points = places(spark, [(float(k % 3), float(k // 3)) for k in range(6)])
    edges = routing.walking_graph(points, routing.RoutingSettings(), 2.0)
    wanted = as_array(paths.relaxation(edges, points), 6)
    monkeypatch.setattr(type(points), "toPandas", lambda self: pytest.fail("rows by way of Python"))
    found = paths.shortest_paths(edges, points)
    monkeypatch.undo()
    assert as_array(found, 6) == pytest.approx(wanted, abs=1e-12)
