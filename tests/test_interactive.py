"""A drawn scenario over a city layer, from features to cards, views and a package."""

import json
import math
import zipfile

import pytest
from pyspark.sql import functions as F

from urbanloom.errors import GridInputError
from urbanloom.operators import geodesic, routing, spatial, variants
from urbanloom.plans import interactive, packages
from urbanloom.plans.parameters import Parameters
from urbanloom.sources import files

SIDE = 0.01


def ring(x, y, side=SIDE):
    return [{"x": x, "y": y}, {"x": x + side, "y": y}, {"x": x + side, "y": y + side}, {"x": x, "y": y + side}]


def city_layer(spark, n=6):
    rows = []
    for i in range(n):
        for j in range(n):
            busy = (i + j) % 5 != 0
            rows.append((i * n + j, 0, "polygon", [ring(10 + i * SIDE, 50 + j * SIDE)], {"DEVLE": "1" if busy else "0", "Pop_Den1": str(100 + 10 * i), "emp_sh": str(0.01 * (1 + j)) if busy else "0", "pop_sh": "0.1" if busy else "0"}, "f", "EPSG:4326"))
    return spark.createDataFrame(rows, files.LAYER)


def test_areas_on_a_sphere(spark):
    frame = spark.createDataFrame([([ring(10.0, 50.0, 1.0)],), ([ring(0.0, 0.0, 1.0), ring(0.25, 0.25, 0.5)],)], f"rings {spatial.RINGS}")
    band = lambda low, high: geodesic.RADIUS_KM**2 * math.radians(1) * (math.sin(math.radians(high)) - math.sin(math.radians(low)))
    got = [r.a for r in frame.select(geodesic.polygon_area_km2(F.col("rings")).alias("a")).collect()]
    assert got[0] == pytest.approx(band(50, 51), rel=1e-9)
    assert got[1] == pytest.approx(band(0, 1) - 0.5 * band(0.25, 0.75), rel=1e-6)


def test_from_drawing_to_package(spark, tmp_path):
    layer = city_layer(spark)
    cells = interactive.prepared_grid(layer, 1.5)
    people = sum((100 + 10 * (r.feature // 6)) * r.a for r in layer.where("properties['DEVLE'] = '1'").withColumn("a", geodesic.polygon_area_km2(F.col("coords"))).collect())
    totals = cells.agg(F.sum("population"), F.sum("employment_model"), F.count(F.lit(1)), F.min("land_area"), F.max("land_area")).first()
    assert totals[0] == pytest.approx(people, rel=1e-9) == totals[1] and 10 < totals[2] < 40 and totals[3] == pytest.approx(2.25e6, rel=0.01) == totals[4]
    assert [r.location_id for r in cells.orderBy("loc_idx").collect()] == [str(k + 1) for k in range(totals[2])]
    with pytest.raises(GridInputError, match="choose a larger size"):
        interactive.prepared_grid(layer, 1.5, limit=5)
    with pytest.raises(GridInputError, match="no developed"):
        interactive.prepared_grid(layer.where("properties['DEVLE'] = '0'"), 1.5)
    document = json.dumps({"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"kind": "transport"}, "geometry": {"type": "LineString", "coordinates": [[10.0, 50.03], [10.06, 50.03]]}},
        {"type": "Feature", "properties": {"kind": "station"}, "geometry": {"type": "Point", "coordinates": [10.005, 50.03]}},
        {"type": "Feature", "properties": {"kind": "station"}, "geometry": {"type": "Point", "coordinates": [10.055, 50.03]}},
        {"type": "Feature", "properties": {"kind": "shock", "amenity_pct": 10}, "geometry": {"type": "Polygon", "coordinates": [[[9.9, 49.9], [10.03, 49.9], [10.03, 50.2], [9.9, 50.2], [9.9, 49.9]]]}},
    ]})
    scenario = interactive.Scenario.of(files.drawn_features(spark, document))
    hats = {r.loc_idx: r for r in interactive.hats(cells, scenario).collect()}
    for r in cells.collect():
        assert hats[r.loc_idx].amenity_hat == pytest.approx(1.1 if r.lon < 10.03 else 1.0) and hats[r.loc_idx].productivity_hat == 1
    said = []
    p = Parameters(damping=0.5, tolerance=1e-4)
    by_closure, local = interactive.simulate(spark, cells, None, scenario, 5.0, 60.0, p, ("closed",), report=said.append)
    assert set(by_closure) == {"closed_city", "fixed_distribution"} and by_closure["closed_city"]["converged"] and said
    cards = {c["label"]: c for c in by_closure["closed_city"]["cards"]}
    assert cards["Expected utility"]["change"] > 0 and cards["Commuting time, immediate"]["change"] < 0 and cards["Population"]["change"] == pytest.approx(0, abs=1e-9)
    views = variants.browser_views(local["closed_city"], "population")
    assert views.count() == 4 * totals[2] and views.where("view = 'absolute'").agg(F.sum("value")).first()[0] == pytest.approx(0, abs=1e-6)
    run = {"prepared_grid": {"type": "FeatureCollection", "features": [{}] * totals[2]}, "model_input": {"ids": []}, "result": {"by_closure": by_closure}}
    names = packages.write_run_package(str(tmp_path / packages.package_name("town", "Málaga", "2026-11-28T01:02:03.000Z")), run, local, ["population", "wage"], spark)
    with zipfile.ZipFile(tmp_path / "town-ma-laga-20261128T010203Z.zip") as archive:
        assert archive.namelist() == names and b"Expected utility" in archive.read("results/aggregate_summary.csv")


def test_without_a_drawing_nothing_changes(spark):
    cells = interactive.prepared_grid(city_layer(spark, 4), 2.0, "square")
    empty = interactive.Scenario.of(files.drawn_features(spark, '{"type": "FeatureCollection", "features": []}'))
    line = routing.Network.of(spark, [[(10.0, 50.02), (10.04, 50.02)]], [])
    by_closure, _ = interactive.simulate(spark, cells, line, empty, 5.0, 40.0, Parameters(damping=0.5, tolerance=1e-4), ("closed",))
    assert all(abs(c["change"]) < 1e-3 for c in by_closure["closed_city"]["cards"])
