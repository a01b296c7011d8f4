"""File formats, configuration and a whole appraisal from layers."""

import csv
import json
import struct
import zipfile

import pytest
import yaml
from pyspark.sql import functions as F

from urbanloom.errors import ConfigurationError, GridInputError, MatrixInputError
from urbanloom.operators import reporting, variants
from urbanloom.plans import config as configuration
from urbanloom.plans import outputs, stages
from urbanloom.plans.parameters import Parameters
from urbanloom.sources import files

UTM = 'PROJCS["WGS_1984_UTM_Zone_33N",GEOGCS["GCS_WGS_1984"]]'


def shapefile(kind: int, shapes: list[list[list[tuple[float, float]]]], rows: list[dict[str, str]], folder, name: str, prj: str = UTM):
    body = b""
    for k, parts in enumerate(shapes):
        if kind == 1:
            record = struct.pack("<i2d", 1, *parts[0][0])
        else:
            points = [p for part in parts for p in part]
            starts, at = [], 0
            for part in parts:
                starts.append(at)
                at += len(part)
            record = struct.pack("<i4d2i", kind, 0, 0, 0, 0, len(parts), len(points)) + struct.pack(f"<{len(parts)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in points)
        body += struct.pack(">2i", k + 1, len(record) // 2) + record
    (folder / f"{name}.shp").write_bytes(b"\0" * 100 + body)
    (folder / f"{name}.prj").write_text(prj)
    names = list(rows[0]) if rows else []
    header = struct.pack("<B3BIHH20x", 3, 0, 0, 0, len(rows), 33 + 32 * len(names), 1 + 20 * len(names))
    fields = b"".join(n.encode().ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([20, 0]) + b"\0" * 14 for n in names) + b"\r"
    (folder / f"{name}.dbf").write_bytes(header + fields + b"".join(b" " + b"".join(str(r[n]).encode().ljust(20) for n in names) for r in rows))


def square(x, y, side=1000.0):
    return [[(x, y), (x, y + side), (x + side, y + side), (x + side, y), (x, y)]]


def test_geopackage_publish_and_read(spark, tmp_path):
    target = tmp_path / "points.gpkg"
    target.write_text("junk")
    files.write_geopackage([("point", [[(1.0, 2.0)]], {"name": "a"}), ("polygon", square(0, 0, 2.0), {"name": "b"})], str(target), "places")
    rows = files.read_geopackage(spark, str(target), "places").orderBy("feature").collect()
    assert [r.kind for r in rows] == ["point", "polygon"] and rows[0].properties["name"] == "a" and rows[0].crs == "EPSG:4326"
    assert [p.name for p in tmp_path.iterdir()] == ["points.gpkg"]
    with pytest.raises(GridInputError, match="no layer"):
        files.read_geopackage(spark, str(target), "other")


def test_shapefile_and_zip(spark, tmp_path):
    shapefile(3, [[[(0, 0), (1, 1)], [(5, 5), (6, 6), (7, 7)]]], [{"kind": "rail"}], tmp_path, "lines")
    rows = files.read_shapefile(spark, str(tmp_path / "lines.shp")).orderBy("part").collect()
    assert [len(r.coords[0]) for r in rows] == [2, 3] and rows[0].crs == "EPSG:32633" and rows[0].properties["kind"] == "rail"
    with zipfile.ZipFile(tmp_path / "lines.zip", "w") as archive:
        for suffix in (".shp", ".dbf", ".prj"):
            archive.write(tmp_path / f"lines{suffix}", f"lines{suffix}")
    assert files.read_shapefile(spark, str(tmp_path / "lines.zip")).count() == 2
    (tmp_path / "lines.prj").unlink()
    with pytest.raises(GridInputError, match="coordinate system"):
        files.read_shapefile(spark, str(tmp_path / "lines.shp"))


def test_geojson_and_package(spark, tmp_path):
    document = files.to_geojson([("line", [[(0, 0), (1, 1)]], {"kind": "transport"}), ("point", [[(2, 3)]], {"kind": "station"})])
    assert [r.role for r in files.drawn_features(spark, document).orderBy("feature").collect()] == ["transport", "station"]
    many = json.dumps({"type": "FeatureCollection", "features": [{"geometry": {"type": "MultiPoint", "coordinates": [[0, 0], [1, 1]]}, "properties": None}]})
    assert len(files.geojson_features(many)) == 2
    files.write_package(str(tmp_path / "run.zip"), {"scenario.json": {"a": 1}, "notes.txt": "x"})
    with zipfile.ZipFile(tmp_path / "run.zip") as archive:
        assert json.loads(archive.read("scenario.json")) == {"a": 1} and archive.infolist()[0].compress_type == zipfile.ZIP_STORED


def test_matrix_labels_are_checked(spark, tmp_path):
    places = spark.createDataFrame([("a", 0), ("b", 1)], "location_id string, loc_idx long")
    path = tmp_path / "m.csv"
    path.write_text("location_id,location_id_b,location_id_a\nb,0,2\na,3,0\n")
    got = {(r.o_idx, r.d_idx): r.minutes for r in files.read_matrix(spark, str(path), places).collect()}
    assert got == {(1, 1): 0, (1, 0): 2, (0, 1): 3, (0, 0): 0}
    path.write_text("location_id,location_id_a\na,0\n")
    with pytest.raises(MatrixInputError, match="b missing"):
        files.read_matrix(spark, str(path), places)
    path.write_text("location_id,location_id_a,location_id_b\na,0,-1\nb,1,0\n")
    with pytest.raises(MatrixInputError, match="negative"):
        files.read_matrix(spark, str(path), places)


def test_matrix_lines(spark, tmp_path):
    places = spark.createDataFrame([('b "x", y', 1), ("a", 0)], "location_id string, loc_idx long")
    pairs = [(0, 0, 0.0), (0, 1, 2.5), (1, 0, 1e-4), (1, 1, 0.0), (7, 0, 1.0), (0, 7, 1.0)]
    od = spark.createDataFrame(pairs, "o_idx long, d_idx long, minutes double")
    path = tmp_path / "m.csv"
    files.write_matrix(od, places, str(path))
    with path.open(newline="") as lines:
        rows = list(csv.reader(lines))
    assert rows[0] == ["location_id", "location_id_a", 'location_id_b "x", y']
    assert [(r[0], *map(float, r[1:])) for r in rows[1:]] == [("a", 0, 2.5), ('b "x", y', 1e-4, 0)]
    for bad, message in ((od.where("not (o_idx = 0 and d_idx = 1)"), "origin a has 1 pairs"), (od.where("o_idx = 0"), "1 of 2 origins"), (od.unionByName(od), "has 4 pairs")):
        with pytest.raises(MatrixInputError, match=message):
            files.write_matrix(bad, places, str(path))
    assert [p.name for p in tmp_path.iterdir()] == ["m.csv"]


def test_floor_rank_percentiles(spark):
    values = [float(x % 37) for x in range(1000)]
    frame = spark.createDataFrame([(x,) for x in [*values, None, float("nan")]], "v double").repartition(7)
    got = reporting.floor_rank_percentiles(frame, "v", (0.0, 0.025, 0.5, 0.975, 1.0)).first()
    assert list(got) == [sorted(values)[int(s * 999)] for s in (0.0, 0.025, 0.5, 0.975, 1.0)]
    assert list(reporting.floor_rank_percentiles(frame.limit(0), "v").first()) == [None, None]


def test_city_catalogue(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text('metro_id,metro_name\n2,"Springfield, IL-MO"\n1,"avalon, NJ"\n')
    catalogue = files.city_catalogue(spark, str(path))
    assert [r.city for r in files.cities_in(catalogue).collect()] == ["avalon", "Springfield"]
    assert [r.metro_id for r in files.cities_in(catalogue, "MO").collect()] == ["2"]


def configured(tmp_path, **changes):
    base = {
        "paths": {"standardized_input": "std", "output": "out", "source_grid_folder": "grid", "counterfactual_network": "net/lines.shp", "counterfactual_stations": "net/stations.shp"},
        "grid": {"mode": "generate_from_source_layers", "cell_geometry": "square", "cell_size_km": 1.0, "population_source_variable": "pop", "employment_source_variable": "emp", "total_population": 1000},
        "ttmatrix": {"off_network_speed_kmh": 5, "network_speed_kmh": 60, "intrazonal_rule": "configured_constant", "intrazonal_minutes": 1.0},
        "model": {"production_share_labor": 0.8, "expenditure_share_consumption": 0.75, "commuting_elasticity": 4, "commuting_time_coefficient": 0.01, "productivity_spatial_decay": 0.2, "amenity_spatial_decay": 0.3, "productivity_spillover": 0.05, "amenity_spillover": 0.05},
        "numerics": {"damping_equilibrium": 0.4}, "scenario": {"shocks_shapefile": "net/policy.shp", "amenity_hat_variable": "amen"},
    }
    path = tmp_path / "config" / "project.yaml"
    path.parent.mkdir(exist_ok=True)
    path.write_text(yaml.safe_dump(configuration.merged(base, changes)))
    return configuration.load_config(str(path))


def test_configuration(tmp_path):
    config, root = configured(tmp_path)
    assert root == tmp_path and config["paths"]["output"] == str(tmp_path / "out") and config["ttmatrix"]["point_station_neighbors"] == 3
    for change, message in (
        ({"model": {"construction_land_share": 0.3}}, "add up"), ({"grid": {"cell_geometry": "triangle"}}, "one of"), ({"paths": {"baseline_network": "x"}}, "go together"),
        ({"ttmatrix": {"network_speed_kmh": None}}, "required"), ({"ttmatrix": {"point_walking_neighbors": 0}}, "1 or more"), ({"grid": {"cell_size_km": 0}}, "required|positive"),
        ({"paths": {"output": None}}, "paths.output"), ({"grid": {"mode": "standardize_existing_output"}}, "source_grid_csv"),
    ):
        with pytest.raises(ConfigurationError, match=message):
            configured(tmp_path, **change)
    config, _ = configured(tmp_path, ttmatrix={"routing_method": "legacy_access_network_egress", "station_candidates": 2})
    assert config["ttmatrix"]["routing_method"] == "direct_station_access" and config["ttmatrix"]["legacy_station_candidates"] == 2
    assert Parameters.from_config(config).damping == 0.4
    config, _ = configured(tmp_path, model={"city_closure": "BOTH"}, grid={"cell_geometry": "Hexagon", "missing_value_rule": "drop"}, ttmatrix={"source": "TTMATRIX", "routing_method": "Standalone_TTMatrix"})
    assert config["model"]["city_closure"] == "both" and config["grid"]["cell_geometry"] == "hexagon" and config["ttmatrix"]["source"] == "ttmatrix"
    with pytest.raises(ConfigurationError, match="missing_value_rule"):
        configured(tmp_path, grid={"missing_value_rule": "guess"})
    ready = {"mode": "standardize_existing_output", "id_variable": "id", "population_variable": "p", "employment_variable": "e", "rent_variable": "r"}
    config, _ = configured(tmp_path, grid=ready, paths={"source_grid_csv": "a.csv", "source_grid_geometry": "a.shp"})
    assert config["grid"]["geometry_id_variable"] == "id"
    with pytest.raises(ConfigurationError):
        Parameters(alpha=1.0)


def test_whole_appraisal(spark, tmp_path):
    for folder in ("grid", "net"):
        (tmp_path / folder).mkdir()
    cells = [(i, j) for i in range(3) for j in range(3)]
    shapefile(5, [square(500_000 + 1000 * i, 1000 * j) for i, j in cells], [{"pop": 10 + i + j, "emp": 5 + 2 * i} for i, j in cells], tmp_path / "grid", "zones")
    shapefile(3, [[[(500_500, 500), (501_500, 500), (502_500, 500)]]], [{"id": 1}], tmp_path / "net", "lines")
    shapefile(1, [[[(500_500, 500)]], [[(502_500, 500)]]], [{"id": 1}, {"id": 2}], tmp_path / "net", "stations")
    shapefile(5, [square(500_000, 0, 500.0)], [{"amen": 1.2}], tmp_path / "net", "policy")
    config, _ = configured(tmp_path)
    tables = stages.run(spark, config)
    rows = tables["aggregate_changes"].collect()
    assert [(r.Specification, r.Closure) for r in rows] == [(s, c) for s in ("with_spillovers", "no_spillovers") for c in ("closed", "open", "fixed_distribution")]
    assert all(r.Converged for r in rows) and all(r.ImmediateCommuteTimeChangePct < 0 for r in rows)
    local = tables["block_outcomes_closed_city"]
    assert len(local.columns) == 22 and local.count() >= 9
    assert (tmp_path / "out" / "aggregate_changes.csv").exists() and (tmp_path / "std" / "shocks" / "shocks.csv").exists()
    assert files.read_shapefile(spark, str(tmp_path / "std" / "grid.shp")).count() == files.read_geopackage(spark, str(tmp_path / "std" / "grid.gpkg"), "grid").count() >= 9
    assert files.read_geopackage(spark, str(tmp_path / "std" / "shocks" / "shocks.gpkg")).first().crs == "EPSG:4326"
    published = files.read_locations(spark, str(tmp_path / "std" / "locations.csv"))
    near = outputs.read_centroids(spark, str(tmp_path / "std" / "centroids.gpkg"), published).collect()
    assert len(near) == published.count() and all(abs(r.x - 15) < 0.1 and abs(r.y) < 0.1 for r in near)
    with zipfile.ZipFile(tmp_path / "out" / "run_package.zip") as archive:
        assert {"scenario.json", "inputs/locations.csv", "results/aggregate_changes.csv", "run_report.json"} <= set(archive.namelist())
    assert "map_classes" not in tables and tables["console_summary"].where("label = 'spill_closed'").count() == 1
    (tmp_path / "out" / "map_classes.csv").write_text("stale")
    (tmp_path / "out" / "notes.csv").write_text("the user's")
    config["reporting"]["make_maps"] = True
    again = stages.run(spark, config, model_only=True, skip_maps=True)["aggregate_changes"].collect()
    assert [r.ExpectedUtilityPct for r in again] == pytest.approx([r.ExpectedUtilityPct for r in rows], abs=1e-6)
    assert not (tmp_path / "out" / "map_classes.csv").exists() and (tmp_path / "out" / "notes.csv").exists()
    # The baseline inverted from the sources, then a counterfactual from the saved state over the published inputs.
    inverted = stages.run(spark, config, invert_only=True)["inverted_primitives"]
    assert inverted.count() == local.count() and (tmp_path / "out" / "inversion" / "baseline_inversion.json").exists()
    said = []
    saved = stages.run(spark, config, saved_inversion=True, skip_maps=True, report=said.append)["aggregate_changes"].collect()
    assert [r.ExpectedUtilityPct for r in saved] == pytest.approx([r.ExpectedUtilityPct for r in rows], abs=1e-6) and any("open city" in x for x in said)
    # The published grid and its centroids again, with times made anew.
    config["project"]["run_grid"] = False
    reused = stages.run(spark, config, prepare_only=True)
    config["project"]["run_grid"] = True
    fresh = stages.run(spark, config, prepare_only=True)
    locations = fresh["locations"]
    both = reused["locations"].join(locations.select("location_id", F.col("x").alias("x0"), F.col("y").alias("y0")), "location_id")
    assert both.count() == local.count() and both.where("abs(x - x0) > 0.01 or abs(y - y0) > 0.01").count() == 0
    times = reused["counterfactual"].join(fresh["counterfactual"].withColumnRenamed("minutes", "m"), ["o_idx", "d_idx"])
    assert times.count() == local.count() ** 2 and times.where("abs(minutes - m) > 1e-3").count() == 0
    report = json.loads((tmp_path / "std" / "grid_report.json").read_text())["allocation"]
    assert report[0]["candidate_pairs"] >= report[0]["positive_pairs"] >= 9
    assert locations.agg(F.sum("population")).first()[0] == pytest.approx(1000)
    assert locations.agg(F.sum("employment_model")).first()[0] == pytest.approx(1000)
    assert locations.agg(F.avg("rent_floor_space")).first()[0] == pytest.approx(1)


def test_ready_grids(spark):
    def layer(polygons):
        point = lambda p: {"x": 500_000.0 + p[0], "y": float(p[1])}
        rows = [(k, 0, "polygon", [[point(p) for p in ring] for ring in rings], {"id": name}, "f", "EPSG:32631") for k, (name, rings) in enumerate(polygons)]
        return spark.createDataFrame(rows, files.LAYER)

    attributes = spark.createDataFrame([("2.0", "3", "1", "1"), ("1", "1", "4", "2")], "id string, p string, e string, r string")
    settings = {"id_variable": "id", "population_variable": "p", "employment_variable": "e", "rent_variable": "r"}
    square, bowtie = [(0, 0), (10, 0), (10, 10), (0, 10)], [(20, 0), (30, 10), (30, 0), (20, 10)]
    got = stages.prepare_grid_inputs(attributes, layer([("1", [square]), ("2", [bowtie])]), settings).orderBy("loc_idx").collect()
    assert [(r.location_id, r.land_area, r.employment_model) for r in got] == [("2", 50.0, 0.8), ("1", 100.0, 3.2)] and (got[0].x, got[0].y) == pytest.approx((500_025, 5))
    for polygons, message in (([("1", [square])], "without geometry"), ([("1", [square]), ("2", [bowtie]), ("2.0", [square])], "repeated"), ([("1", [square]), ("2", [[(0, 0), (1, 1), (2, 2)]])], "land area: 2")):
        with pytest.raises(GridInputError, match=message):
            stages.prepare_grid_inputs(attributes, layer(polygons), settings)
    with pytest.raises(GridInputError, match="nonnegative"):
        stages.prepare_grid_inputs(attributes.replace("3", "-3", "p"), layer([("1", [square]), ("2", [bowtie])]), settings)


def test_payload(spark):
    payload = {"ids": ["a", "b"], "population": [60, 40], "employment": [50, 50], "rent": [1, 1.2], "land_area": [1, 1], "travel_time_baseline": [[1, 2], [2, 1]], "travel_time_counterfactual": [[0.9, 1.8], [1.8, 0.9]]}
    out = stages.run_payload(spark, payload, Parameters(damping=0.2))
    assert set(out["aggregate"]) == {"closed", "open", "fixed_distribution"} and out["local"]["open"].count() == 2


def test_reports(spark):
    pairs = {"employment": (10, 11), "population": (10, 9), "wage": (1, 1), "output": (2, 3), "annual_land_rent": (1, 2), "rent_residential": (1, 1.5), "rent_commercial": (2, 3)}
    row = {"location_id": "a"} | {k: float(v) for n, (x, y) in pairs.items() for k, v in ((f"{n}_baseline", x), (f"{n}_counterfactual", y), (f"{n}_pct", 100 * (y / x - 1)))}
    local = spark.createDataFrame([row, row | {"location_id": "b", "employment_pct": -4.0}])
    aggregate = spark.createDataFrame([("with_spillovers", "fixed_distribution", 1e-12)], "Specification string, Closure string, OutputPct double")
    hats = spark.createDataFrame([(0, 1.0, 1.2, 1.0), (1, 1.0, 0.7, 1.0)], "loc_idx long, productivity_hat double, amenity_hat double, structural_density_hat double")
    made = outputs.report_tables({"aggregate_changes": aggregate, "block_outcomes_open_city": local}, hats)
    assert {r.outcome for r in made["map_classes"].collect()} == {"employment", "population", "wage", "output", "annual_land_rent", "rent"}
    assert made["console_summary"].collect() == [(0.0, "spill_fixed")]
    ranges = {r.primitive: (r.largest, r.legend) for r in made["shock_map_ranges"].collect()}
    assert ranges["productivity_hat"] == (0.0, "No imposed change") and ranges["amenity_hat"][0] == pytest.approx(30)
    assert outputs.scenario_report(hats)["amenity_hat_changed"] == 2
    views = {r.view: r.value for r in variants.browser_views(local, "employment").where("location_id = 'a'").collect()}
    assert views == {"baseline": 10, "counterfactual": 11, "absolute": 1, "pct": pytest.approx(10)}


def test_checked_join_and_variants(spark):
    frame = lambda *rows: spark.createDataFrame(list(rows), "k string, v int")
    layer = frame(("a", 1), ("b", 2)).select("k")
    assert sorted(tuple(r) for r in outputs.checked_join(layer, frame(("a", 5), ("z", 6)), "k").collect()) == [("a", 5), ("b", None)]
    for bad, message in ((frame(("a", 5), ("a", 6)), "more than once"), (frame(("z", 1)), "is in the table")):
        with pytest.raises(GridInputError, match=message):
            outputs.checked_join(layer, bad, "k")
    assert outputs.checked_join(layer.limit(0), frame(("z", 1)), "k").count() == 0
    assert str(outputs.variant_folder("out", "x")) == "out/x" and str(outputs.variant_folder("out", None)) == "out"
    for name in ("a/b", ".."):
        with pytest.raises(ConfigurationError, match="single folder"):
            outputs.variant_folder("out", name)
    layer = spark.createDataFrame([(0, {"POP_SH": "0.1"}), (1, {"DEVLE": "0", "pop_sh": "x"}), (2, {"Emp_Sh": "2", "emp_sh": "0"}), (3, {})], "feature int, properties map<string,string>")
    assert [r.feature for r in variants.browser_sources(layer).collect()] == [0]


def test_shapefile_export(spark, tmp_path):
    hole = [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)], [(1.0, 1.0), (1.0, 2.0), (2.0, 2.0), (1.0, 1.0)]]
    files.write_shapefile([("polygon", hole, {"loc_id": "ä1", "population": 2.5}), ("polygon", hole[:1], {"loc_id": None})], str(tmp_path / "g.shp"), 32733)
    rows = files.read_shapefile(spark, str(tmp_path / "g.shp")).orderBy("feature").collect()
    assert [r.properties for r in rows] == [{"loc_id": "ä1", "population": "2.5"}, {"loc_id": "", "population": ""}]
    assert rows[0].crs == "EPSG:32733" and [len(ring) for ring in rows[0].coords] == [5, 4]
    assert [(p.x, p.y) for p in rows[0].coords[0]] == hole[0][::-1]
    files.write_shapefile([], str(tmp_path / "none.shp"), 4326)
    assert len((tmp_path / "none.shp").read_bytes()) == 100
    files.write_shapefile([("polygon", hole, {"employment_raw": 1, "employment_model": 2})], str(tmp_path / "g.shp"), 4326)
    assert files.read_shapefile(spark, str(tmp_path / "g.shp")).first().properties == {"employment": "1", "employme_1": "2"}
    with pytest.raises(GridInputError, match="distinct"):
        files.write_shapefile([("polygon", hole, {f"population_{k}": k for k in range(12)})], str(tmp_path / "g.shp"), 4326)
