"""Repair and shared areas against counting points of a fine raster, and against figures known in closed form."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from urbanloom.functions import columns as C
from urbanloom.operators import geometry, spatial


def box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


def area(rings):
    return sum(geometry.signed_area(r) for r in rings)


BOWTIE = [[(0, 0), (2, 2), (2, 0), (0, 2)]]


@pytest.mark.parametrize(
    ("rings", "expected", "count"),
    [
        (BOWTIE, 2.0, 2),
        ([box(0, 0, 4, 4), box(1, 1, 2, 2)], 15.0, 2),
        ([box(0, 0, 4, 4), box(1, 1, 3, 3), box(1.5, 1.5, 2, 2)], 12.25, 3),
        ([box(0, 0, 2, 2), box(1, 1, 3, 3)], 6.0, 2),
        ([box(0, 0, 2, 2), box(2, 0, 4, 2)], 8.0, 1),
        ([box(0, 0, 2, 2), box(0, 0, 2, 2)], 0.0, 0),
        ([box(0, 0, 2, 2), [(5, 5), (6, 6)], []], 4.0, 1),
        ([[*box(0, 0, 2, 2), (0, 0)]], 4.0, 1),
        ([[(0, 0), (2, 0), (5, 0), (2, 0), (2, 2), (0, 2)]], 4.0, 1),
        ([box(0, 0, 4, 4), [(0, 2), (1, 1), (2, 2), (1, 3)]], 14.0, None),
        ([[(0, 0), (4, 0), (4, 4), (2, 0), (0, 4)]], 8.0, 2),
        ([box(0, 0, 1, 1), box(3, 3, 4, 4)], 2.0, 2),
        ([[(0, 0), (1, 1), (2, 2)]], 0.0, 0),
    ],
)
def test_valid_faces(rings, expected, count):
    made = geometry.valid_faces([[{"x": float(x), "y": float(y)} for x, y in r] for r in rings])
    assert area(made) == pytest.approx(expected, abs=1e-12)
    assert count is None or len(made) == count
    again = geometry.valid_faces(made)
    assert area(again) == pytest.approx(expected, abs=1e-12) and all(len(set(map(tuple, r.tolist()))) == len(r) for r in again)


@pytest.mark.parametrize("seed", range(8))
def test_faces_hold_the_same_points(seed):
    """Random stars that cross themselves: the repaired rings hold just the points inside the given ones."""
    rng = np.random.default_rng(seed)
    rings = [rng.uniform(0, 10, (rng.integers(3, 9), 2)) for _ in range(rng.integers(1, 4))]
    made = geometry.valid_faces(rings)
    points = rng.uniform(0, 10, (4000, 2))
    edges = lambda rs: (np.concatenate(rs), np.concatenate([np.roll(r, -1, axis=0) for r in rs]))
    was = geometry.inside(points, *edges(rings))
    assert (geometry.inside(points, *edges(made)) == was).all()
    assert area(made) == pytest.approx(100 * was.mean(), abs=4.0)
    assert not geometry.edge_cuts(*edges(made))


@pytest.mark.parametrize("seed", range(6))
def test_shared_areas_against_points(seed):
    rng = np.random.default_rng(100 + seed)
    left = [geometry.valid_faces([rng.uniform(0, 10, (6, 2)), rng.uniform(2, 8, (5, 2))]) for _ in range(4)]
    right = [geometry.valid_faces([rng.uniform(0, 10, (5, 2))]), [np.array(box(2, 2, 7, 7), float)], geometry.valid_faces([np.array(box(0, 0, 9, 9)), np.array(box(3, 3, 5, 5))]), left[3]]
    points = rng.uniform(0, 10, (20000, 2))
    held = lambda rs: geometry.inside(points, np.concatenate(rs), np.concatenate([np.roll(r, -1, axis=0) for r in rs]))
    for found, p, q in zip(geometry.shared_areas(left, right), left, right, strict=True):
        assert found == pytest.approx(100 * (held(p) & held(q)).mean(), abs=1.5)
    assert geometry.shared_areas([left[3]], [left[3]])[0] == pytest.approx(area(left[3]), rel=1e-9)
    assert geometry.shared_areas([], []).tolist() == []


def test_layers_are_repaired(spark):
    ring = lambda r: [{"x": float(x), "y": float(y)} for x, y in r]
    rows = [(0, [ring(r) for r in BOWTIE], {"a": "1"}), (1, [ring(box(0, 0, 1, 1)), ring(box(3, 3, 4, 4))], {}), (2, None, None), (3, [], {"b": "é"}), (4, [ring([(0, 0), (1, 1)])], {})]
    frame = spark.createDataFrame(rows, f"feature long, coords {spatial.RINGS}, properties map<string,string>")
    got = {r.feature: r for r in geometry.repaired(frame).withColumn("area", C.polygon_area(F.col("coords"))).withColumn("at", C.polygon_centroid(F.col("coords"))).collect()}
    assert [got[k].area for k in range(5)] == [2.0, 2.0, 0.0, 0.0, 0.0] and [len(got[k].coords) for k in range(5)] == [2, 2, 0, 0, 0]
    assert got[0].properties == {"a": "1"} and got[3].properties == {"b": "é"} and got[2].properties is None
    assert (got[0]["at"].x, got[0]["at"].y) == pytest.approx((1, 1)) and (got[1]["at"].x, got[1]["at"].y) == pytest.approx((2, 2))


def test_areas_do_not_depend_on_the_rings_directions(spark):
    ring = lambda r: [{"x": float(x), "y": float(y)} for x, y in r]
    holed = [box(0, 0, 4, 4), box(1, 1, 3, 3), box(1.5, 1.5, 2.5, 2.5)]
    rows = [(k, [ring(r[:: -1 if k >> j & 1 else 1]) for j, r in enumerate(holed)]) for k in range(8)]
    frame = spark.createDataFrame(rows, f"k long, rings {spatial.RINGS}").select("k", C.polygon_area(F.col("rings")).alias("area"), C.polygon_centroid(F.col("rings")).alias("at"))
    assert all(r.area == pytest.approx(13) and (r["at"].x, r["at"].y) == pytest.approx((2, 2)) for r in frame.collect())
