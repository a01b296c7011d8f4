"""The stages of an appraisal: grid, travel times, shocks, model and report."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping
from pathlib import Path
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanloom.errors import GridInputError, MatrixInputError, ScenarioInputError, UnsupportedCrs
from urbanloom.functions import columns as C
from urbanloom.lineage import cut, numbered
from urbanloom.operators import economy, geometry, matrices, networks, reporting, routing, spatial
from urbanloom.plans import config as configuration
from urbanloom.plans import outputs, state
from urbanloom.plans.parameters import Parameters
from urbanloom.sources import files


def _projector(crs: str, target: str):
    """A function from an (x, y) struct column in ``crs`` to one in ``target``: identity, or WGS84 to UTM or web Mercator."""
    if crs == target:
        return lambda p: p
    if crs == "EPSG:4326" and (target.startswith("EPSG:326") or target.startswith("EPSG:327")):
        zone, south = int(target[-2:]), target.startswith("EPSG:327")

        def forward(p):
            q = C.utm_forward(p["x"], p["y"], F.lit(zone))
            shift = F.when(p["y"] < 0, F.lit(0.0 if south else -C.UTM_SOUTH)).otherwise(F.lit(C.UTM_SOUTH if south else 0.0))
            return F.struct(q["x"].alias("x"), (q["y"] + shift).alias("y"))

        return forward
    if target == "EPSG:4326" and (crs.startswith("EPSG:326") or crs.startswith("EPSG:327")):
        south = crs.startswith("EPSG:327")

        def inverse(p):
            q = C.utm_inverse(p["x"], p["y"], F.lit(int(crs[-2:])), F.lit(south))
            return F.struct(q["lon"].alias("x"), q["lat"].alias("y"))

        return inverse
    if crs == "EPSG:4326" and target == "EPSG:3857":
        return lambda p: C.web_mercator(p["x"], p["y"])
    if crs == "EPSG:3857" and target == "EPSG:4326":
        radius = 6378137.0
        return lambda p: F.struct(F.degrees(p["x"] / radius).alias("x"), F.degrees(F.atan(F.sinh(p["y"] / radius))).alias("y"))
    raise UnsupportedCrs(f"{crs} to {target}")


def reprojected(layer: DataFrame, target: str) -> DataFrame:
    """A LAYER with all its coordinates in ``target``; one system a layer."""
    found = [r.crs for r in layer.select("crs").distinct().collect()]
    if len(found) != 1:
        raise GridInputError(f"a layer needs one coordinate system, not {found}")
    move = _projector(found[0], target)
    return layer.withColumn("coords", F.transform("coords", lambda ring: F.transform(ring, move))).withColumn("crs", F.lit(target))


def projected_crs(layer: DataFrame, configured: str | None) -> str:
    """The configured projected system, or the UTM zone of the layer's middle."""
    if configured:
        if configured == "EPSG:4326":
            raise GridInputError("areas and distances need a projected coordinate system")
        return configured
    crs = layer.select("crs").first().crs
    if crs != "EPSG:4326":
        return crs
    lon, lat = middle(extent(layer, "coords"))
    zone = int((lon + 180) // 6) % 60 + 1
    return f"EPSG:{326 if lat >= 0 else 327}{zone:02d}"


def extent(layer: DataFrame, rings: str) -> tuple[float, float, float, float]:
    return tuple(layer.select(spatial.bounds_of(F.col(rings)).alias("b")).agg(F.min("b.x0"), F.min("b.y0"), F.max("b.x1"), F.max("b.y1")).first())


def middle(bounds: tuple[float, float, float, float]) -> tuple[float, float]:
    return (bounds[0] + bounds[2]) / 2, (bounds[1] + bounds[3]) / 2


def grid_centre(layer: DataFrame, crs: str) -> tuple[float, float]:
    """The middle of a layer's bounds in degrees, in ``crs``; of the projected bounds where degrees are not to be had."""
    try:
        x, y = middle(extent(reprojected(layer, "EPSG:4326"), "coords"))
        move = _projector("EPSG:4326", crs)
    except UnsupportedCrs:
        return middle(extent(reprojected(layer, crs), "coords"))
    at = layer.sparkSession.range(1).select(move(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"))).alias("p")).first().p
    return at.x, at.y


def read_layer(spark: SparkSession, path: str, layer: str | None = None) -> DataFrame:
    return files.read_geopackage(spark, path, layer) if path.endswith(".gpkg") else files.read_shapefile(spark, path)


def read_polygon_folder(spark: SparkSession, folder: str) -> DataFrame:
    """All shapefiles, then all GeoPackages of a folder, by name, in the first one's system; polygons only."""
    names = [*sorted(str(p) for p in Path(folder).glob("*.shp")), *sorted(str(p) for p in Path(folder).glob("*.gpkg"))]
    if not names:
        raise GridInputError(f"no layers in {folder}")
    out, crs = None, None
    for k, name in enumerate(names):
        layer = read_layer(spark, name)
        if layer.where("kind <> 'polygon'").limit(1).count():
            raise GridInputError(f"{name} holds geometry that is no polygon")
        crs = crs or layer.select("crs").first().crs
        layer = reprojected(layer, crs).withColumn("layer", F.lit(k))
        out = layer if out is None else out.unionByName(layer)
    return numbered(out, ["layer", "feature", "part"], "source_id")


def generate_grid_inputs(layer: DataFrame, settings: Mapping[str, Any]) -> tuple[DataFrame, DataFrame]:
    """(locations, report): cells, interpolation, retention, balancing, rent, area and centroids."""
    spark = layer.sparkSession
    crs = projected_crs(layer, settings.get("analysis_crs"))
    population, employment = settings["population_source_variable"], settings["employment_source_variable"]
    developed, rent = settings.get("developed_source_variable"), settings.get("rent_source_variable")
    names = {"population": population, "employment_raw": employment} | ({"developed": developed} if developed else {}) | ({"rent_raw": rent} if rent else {})
    values = [F.col("properties")[source].try_cast("double").alias(ours) for ours, source in names.items()]
    keys = layer.select(F.explode(F.map_keys("properties")).alias("k")).distinct()
    if missing := set(names.values()) - {r.k for r in keys.collect()}:
        raise GridInputError(f"source layers have no {', '.join(sorted(missing))}")
    source = geometry.repaired(reprojected(layer, crs)).where(F.size("coords") > 0).select("source_id", F.col("coords").alias("rings"), *values, *([F.col("properties")[settings["original_id_variable"]].alias("original_id")] if settings.get("original_id_variable") else []))
    extensive, intensive = ["population", "employment_raw"], [c for c in ("developed", "rent_raw") if c in names]
    original = settings["cell_geometry"] == "original"
    if original:
        cells = spatial.original_grid(source, "original_id" if settings.get("original_id_variable") else None)
        filled = [F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in extensive]
        grid = cells.select("grid_sequence", "location_id", "rings", *filled, *intensive)
    else:
        size = float(settings["cell_size_km"]) * 1000
        bounds, centre = extent(source, "rings"), grid_centre(layer, crs)
        made = spatial.square_grid(spark, bounds, centre, size) if settings["cell_geometry"] == "square" else spatial.hexagon_grid(spark, bounds, centre, size)
        target = made.select(F.col("grid_sequence").alias("target_id"), "rings")
        found = spatial.area_interpolate(source, target, extensive, intensive, bucket=size)
        grid = target.join(found, "target_id").withColumnsRenamed({"target_id": "grid_sequence"}).withColumn("location_id", F.col("grid_sequence").cast("string"))
    grid = grid.withColumns({c: F.coalesce(F.nanvl(F.col(c), F.lit(0.0)), F.lit(0.0)) for c in intensive})
    grid = grid if "developed" in grid.columns else grid.withColumn("developed", F.lit(0.0))
    kept = numbered(spatial.retained(grid, original), ["grid_sequence"], "loc_idx")
    total = float(settings["total_population"])
    ready = spatial.share_scaled(spatial.positive_replaced(kept, "population"), "population", total)
    ready = spatial.employment_balanced(spatial.positive_replaced(ready, "employment_raw"))
    if rent:
        ready = spatial.rent_normalized(ready, "rent_raw")
    else:
        ready = spatial.synthetic_rent(ready, float(settings.get("synthetic_rent_population_elasticity", 0.25)), float(settings.get("synthetic_rent_random_spread", 0.1)), int(settings.get("random_seed", 1)))
    centre = C.polygon_centroid(F.col("rings"))
    out = ready.select(
        "loc_idx", "location_id", "population", "employment_raw", "employment_model", "rent_floor_space", C.polygon_area(F.col("rings")).alias("land_area"),
        centre["x"].alias("x"), centre["y"].alias("y"), "rings", F.lit(crs).alias("crs"),
    )
    report = spatial.allocation_report(source, grid, extensive)
    if not original:
        report = report.crossJoin(F.broadcast(spatial.overlap_counts(source, target, size)))
    return out, report


def prepare_grid_inputs(attributes: DataFrame, polygons: DataFrame, settings: Mapping[str, Any]) -> DataFrame:
    """Standardise a ready-made grid: attributes joined with polygons by id, employment balanced, areas in metres.

    Polygons are repaired; one without area raises. Without ``geometry_id_variable`` both sides use ``id_variable``.
    """
    # The file's order is the locations' order.
    ids = attributes.withColumn("__order", F.monotonically_increasing_id()).select(
        "__order", C.canonical_id(F.col(settings["id_variable"])).alias("location_id"), C.coerced_double(F.col(settings["population_variable"])).alias("population"),
        C.coerced_double(F.col(settings["employment_variable"])).alias("employment_raw"), C.coerced_double(F.col(settings["rent_variable"])).alias("rent_floor_space"),
    )
    ids = cut(ids)
    for c, label in (("population", "population"), ("employment_raw", "employment"), ("rent_floor_space", "rent")):
        odd = [str(r.location_id) for r in ids.where(F.col(c).isNull() | F.isnan(c)).orderBy("__order").select("location_id").limit(5).collect()]
        if odd:
            raise GridInputError(f"{label} is missing or not numeric at locations {', '.join(odd)}")
    if ids.groupBy("location_id").count().where("count > 1").limit(1).count():
        raise GridInputError("attributes with repeated location identifiers")
    sums = ids.agg(F.min("population"), F.sum("population"), F.min("employment_raw"), F.sum("employment_raw"), F.min("rent_floor_space")).first()
    for name, least, total in (("population", *sums[:2]), ("employment", *sums[2:4])):
        if total is None or least < 0 or total <= 0:
            raise GridInputError(f"{name} must be nonnegative everywhere and positive in all")
    if sums[4] <= 0:
        raise GridInputError("observed rents must be positive everywhere")
    crs = projected_crs(polygons, settings.get("target_crs"))
    named = settings.get("geometry_id_variable") or settings["id_variable"]
    shapes = geometry.repaired(reprojected(polygons, crs).select(C.canonical_id(F.col("properties")[named]).alias("location_id"), F.col("coords").alias("rings")), "rings")
    shapes = cut(shapes)
    if shapes.where("location_id is null").limit(1).count():
        raise GridInputError(f"geometry without {named}")
    if shapes.groupBy("location_id").count().where("count > 1").limit(1).count():
        raise GridInputError("geometry with repeated location identifiers")
    flat = [r.location_id for r in ids.join(shapes, "location_id").where((F.size("rings") == 0) | (C.polygon_area(F.col("rings")) <= 0)).select("location_id").limit(5).collect()]
    if flat:
        raise GridInputError(f"locations without land area: {', '.join(flat)}")
    if ids.join(shapes, "location_id", "left_anti").limit(1).count():
        raise GridInputError("locations without geometry")
    centre = C.polygon_centroid(F.col("rings"))
    joined = spatial.employment_balanced(numbered(ids.join(shapes, "location_id"), ["__order"], "loc_idx").drop("__order"))
    return joined.withColumns({"land_area": C.polygon_area(F.col("rings")), "x": centre["x"], "y": centre["y"], "crs": F.lit(crs)})


def read_network(lines: DataFrame, stations: DataFrame, crs: str) -> routing.Network:
    """The network in ``crs``; a station that is no point counts by its vertices' mean."""
    points = F.flatten("coords")
    mean = lambda name: F.aggregate(points, F.lit(0.0), lambda total, p: total + p[name]) / F.size(points)
    told = reprojected(stations, crs).where(F.size(points) > 0).select("feature", "part", mean("x").alias("x"), mean("y").alias("y"))
    places = cut(numbered(told, ["feature", "part"], "station").select("station", "x", "y"))
    if places.isEmpty():
        raise MatrixInputError("the station layer is empty")
    return routing.Network(cut(networks.layer_segments(reprojected(lines, crs))), places)


def generate_travel_times(locations: DataFrame, layers: Mapping[str, routing.Network | None], settings: Mapping[str, Any]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(baseline, counterfactual, report); without a counterfactual network the baseline's times are taken over."""
    points = locations.select("loc_idx", "x", "y")
    routes = routing.RoutingSettings(
        float(settings["off_network_speed_kmh"]), float(settings["network_speed_kmh"]), float(settings["snap_tolerance_m"]), float(settings["station_split_buffer_m"]),
        int(settings["point_station_neighbors"]), int(settings["point_walking_neighbors"]), float(settings["station_connector_minutes"]),
    )
    candidates, tasks = settings["legacy_station_candidates"], None if str(settings["workers"]).lower() == "auto" or int(settings["workers"]) == 1 else int(settings["workers"])
    spread = points.agg(F.max("x") - F.min("x"), F.max("y") - F.min("y"), F.count(F.lit(1))).first()
    cell = max(1.0, math.sqrt(max(1.0, spread[0]) * max(1.0, spread[1]) / spread[2]) * 1.5)

    def times(network: routing.Network | None) -> DataFrame:
        return routing.require_reachable(routing.travel_times(points, network, routes, settings["routing_method"], None if candidates == "all" else int(candidates), cell, tasks), settings["unreachable_rule"])

    before = cut(times(layers.get("baseline")))
    after = before if layers.get("counterfactual") is None else cut(times(layers["counterfactual"]))
    direct = matrices.direct_minutes(points, routes.walking_kmh)
    fix = lambda od: matrices.intrazonal(od, settings["intrazonal_rule"], float(settings["intrazonal_minutes"]))
    # Detours are measured before the diagonal's constant.
    report = matrices.detour_stats(after, direct, float(settings["detour_warning_ratio"])).crossJoin(matrices.path_stats(after)).crossJoin(matrices.summary(fix(before), fix(after)))
    return fix(before), fix(after), report


def prepare_travel_times(spark: SparkSession, locations: DataFrame, baseline_path: str, counterfactual_path: str, settings: Mapping[str, Any]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(baseline, counterfactual, report) of user matrices: aligned by label, in minutes, with the diagonal's rule."""
    read = lambda path: matrices.intrazonal(matrices.convert_unit(files.read_matrix(spark, path, locations), settings["time_unit"]), settings["intrazonal_rule"], float(settings["intrazonal_minutes"]))
    before, after = read(baseline_path), read(counterfactual_path)
    return before, after, matrices.summary(before, after)


def prepare_primitive_shocks(locations: DataFrame, policies: DataFrame | None, settings: Mapping[str, Any]) -> DataFrame:
    """loc_idx and the three hats; without policies all are 1."""
    if policies is None:
        return locations.select("loc_idx", *[F.lit(1.0).alias(h) for h in spatial.HATS])
    crs = locations.select("crs").first().crs
    fields = {h: settings.get(f"{h}_variable") for h in spatial.HATS}
    given = [C.strict_double(F.col("properties")[f], f).alias(h) for h, f in fields.items() if f]
    if policies.where("kind <> 'polygon'").limit(1).count():
        raise ScenarioInputError("shocks need polygons")
    if locations.where(C.polygon_area(F.col("rings")) <= 0).limit(1).count():
        raise ScenarioInputError("locations without area")
    shapes = geometry.repaired(reprojected(policies, crs)).where(F.size("coords") > 0).select(F.monotonically_increasing_id().alias("policy_id"), F.col("coords").alias("rings"), *given)
    shapes = cut(shapes)
    return spatial.shock_hats(shapes, locations.select("loc_idx", "rings")).drop("coverage")


def specifications(p: Parameters, spillovers=(True, False)) -> list[tuple[str, Parameters]]:
    return [("with_spillovers" if x else "no_spillovers", p if x else p.without_spillovers()) for x in spillovers]


def invert_baseline(spark: SparkSession, locations: DataFrame, before: DataFrame, p: Parameters, spillovers=(True, False), folder: str | None = None) -> dict[str, economy.Inversion]:
    """The inversions by specification, saved in ``folder`` for later counterfactuals where one is given."""
    town = economy.City.of(locations)
    found = economy.invert_variants(town, economy.BlockedKernels(len(town.population), before), specifications(p, spillovers))
    if folder:
        state.save(spark, folder, found, p, locations, before)
    return found


def run_model(
    spark: SparkSession, locations: DataFrame, before: DataFrame, after: DataFrame, hats: DataFrame, p: Parameters, closures=("closed", "open"), spillovers=(True, False), report=None,
    inversions: Mapping[str, economy.Inversion] | None = None,
) -> dict[str, DataFrame]:
    """The result tables by name: aggregate_changes, block_outcomes_*, welfare_decomposition, inverted_primitives.

    ``inversions``: those of a saved state; without them the baseline is inverted here.
    """
    town = economy.City.of(locations)
    given = hats.orderBy("loc_idx").toPandas()
    shocks = {"productivity": given.productivity_hat.to_numpy(float), "amenity": given.amenity_hat.to_numpy(float), "density": given.structural_density_hat.to_numpy(float)}
    kernels = economy.BlockedKernels(len(town.population), before, after)
    inversions = inversions or economy.invert_variants(town, kernels, specifications(p, spillovers))
    solved = economy.solved_rows(spark, economy.appraise(town, kernels, p, shocks, closures, spillovers, report, inversions)).persist()
    out = {"aggregate_changes": economy.aggregate_of(solved).orderBy(F.col("Specification").desc(), F.array_position(F.array(*[F.lit(c) for c in ("closed", "open", "fixed_distribution")]), F.col("Closure")))}
    first = inversions["with_spillovers" if "with_spillovers" in inversions else "no_spillovers"]
    out["inverted_primitives"] = locations.select("loc_idx", "location_id").join(spark.createDataFrame(economy.primitives(first)), "loc_idx").orderBy("loc_idx").select("location_id", *economy.PRIMITIVES[:5])
    local = economy.outcomes_of(solved, locations)
    for spilling in spillovers:
        name, suffix = ("with_spillovers", "") if spilling else ("no_spillovers", "_no_spillovers")
        mine = F.col("Specification") == name
        for closure in (*closures, "fixed_distribution"):
            out[f"block_outcomes_{closure}_city{suffix}"] = local.where(mine & (F.col("Closure") == closure)).drop("Specification", "Closure")
        welfare = solved.where(mine & F.col("welfare").isNotNull())
        parts = [f"{k}_{unit}" for unit in ("log_change", "pct") for k in ("commuting", "productivity_wage", "amenity", "total")]
        out[f"welfare_decomposition{suffix}"] = welfare.select(*[F.col("welfare")[k].alias(k) for k in parts])
    return out


def run_payload(spark: SparkSession, payload: Mapping[str, Any], p: Parameters | None = None) -> dict[str, Any]:
    """The interactive entry: arrays in, aggregate cards and local tables out, closed, open and fixed in one call."""
    n = len(payload["ids"])
    population = np.maximum(np.array(payload["population"], float), 1e-6)
    jobs = np.maximum(np.array(payload["employment"], float), 1e-6)
    city = economy.City(population, jobs * population.sum() / jobs.sum(), np.array(payload["rent"], float), np.array(payload["land_area"], float))
    kernels = economy.DenseKernels(*(np.array(payload[k], float).reshape(n, n) for k in ("travel_time_baseline", "travel_time_counterfactual")))
    shocks = np.array(payload.get("shocks") or np.ones((n, 3)), float)
    hats = dict(zip(("productivity", "amenity", "density"), shocks.T, strict=True))
    p = p or Parameters()
    solved = economy.appraise(city, kernels, p, hats, spillovers=(True,))
    return {"aggregate": {s.closure: row for _, _, s, row, _ in solved}, "local": {s.closure: reporting.local_outcomes(spark, list(payload["ids"]), q, b, s) for _, b, s, _, q in solved}}


def in_output_crs(locations: DataFrame, crs: str) -> tuple[DataFrame, int]:
    """(locations with rings and centroids in ``crs``, its EPSG number)."""
    own = locations.select("crs").first()
    move = _projector(own.crs if own else crs, crs)
    centre = move(F.struct("x", "y"))
    moved = locations.withColumns({"rings": F.transform("rings", lambda ring: F.transform(ring, move)), "x": centre["x"], "y": centre["y"], "crs": F.lit(crs)})
    return moved, int(crs.removeprefix("EPSG:"))


def run(
    spark: SparkSession, config: Mapping[str, Any], prepare_only: bool = False, model_only: bool = False, skip_maps: bool = False, report: Callable[[str], None] | None = None,
    invert_only: bool = False, saved_inversion: bool = False,
) -> dict[str, DataFrame]:
    """A configured appraisal from layers or tables to result files, layers, reports and a package of them all.

    ``invert_only`` saves the baseline's inversion and stops; ``saved_inversion`` starts from a saved one, read like the
    other inputs of a run that only models. ``report`` is told of the solvers' progress.
    """
    paths, standard = config["paths"], Path(config["paths"]["standardized_input"])
    output = outputs.variant_folder(paths["output"], config["project"].get("variant"))
    timers = outputs.Timers()
    configuration.save_config(config, str(output / "runtime_config.json"))
    with timers.step("prepare"):
        locations, before, after, hats = prepared(spark, config, model_only or saved_inversion)
    if prepare_only:
        return {"locations": locations, "baseline": before, "counterfactual": after, "hats": hats}
    p = Parameters.from_config(config)
    closures = ("closed", "open") if config["model"]["city_closure"] == "both" else (config["model"]["city_closure"],)
    spillovers = (True, False) if config["project"]["run_no_spillover_comparison"] else (True,)
    folder = str(output / "inversion")
    if invert_only:
        with timers.step("invert"):
            found = invert_baseline(spark, locations, before, p, spillovers, folder)
        primitives = spark.createDataFrame(economy.primitives(next(iter(found.values())))).join(locations.select("loc_idx", "location_id"), "loc_idx")
        table = primitives.orderBy("loc_idx").select("location_id", *economy.PRIMITIVES[:5])
        files.write_csv(table, str(output / "inverted_primitives.csv"))
        return {"inverted_primitives": table}
    inversions = state.load(spark, folder, p, locations, before, [name for name, _ in specifications(p, spillovers)]) if saved_inversion else None
    tables = run_model(spark, locations, before, after, hats, p, closures, spillovers, report, inversions)
    maps = config["reporting"]["make_maps"] and not skip_maps
    tables |= {k: v for k, v in outputs.report_tables(tables, hats).items() if maps or k == "console_summary"}
    for name, table in tables.items():
        with timers.step(name):
            files.write_csv(table, str(output / f"{name}.csv"))
    stale = outputs.purge(output, list(tables))
    files.write_json({"seconds": timers.seconds, "tables": list(tables), "deleted": stale}, str(output / "run_report.json"))
    outputs.package(str(output / "run_package.zip"), config, output, standard, list(tables))
    return tables


def published_locations(spark: SparkSession, standard: Path, crs: str | None = None) -> DataFrame:
    """The locations of an earlier run's grid: table, polygons and centroids as it published them, in a projected system."""
    table = numbered(files.read_locations(spark, str(standard / "locations.csv")).withColumnRenamed("loc_idx", "__line"), ["__line"], "loc_idx").drop("__line")
    grid = files.read_geopackage(spark, str(standard / "grid.gpkg"), "grid")
    metric, own = projected_crs(grid, crs), grid.select("crs").first().crs
    shapes = reprojected(grid, metric).select(C.canonical_id(F.col("properties")["location_id"]).alias("location_id"), F.col("coords").alias("rings"))
    at = outputs.read_centroids(spark, str(standard / "centroids.gpkg"), table).select("location_id", _projector(own, metric)(F.struct("x", "y")).alias("at"))
    joined = outputs.checked_join(outputs.checked_join(table, shapes, "location_id"), at, "location_id")
    if joined.where("rings is null").limit(1).count():
        raise GridInputError("published locations without a polygon")
    return joined.select(*table.columns, "rings", F.col("at.x").alias("x"), F.col("at.y").alias("y"), F.lit(metric).alias("crs"))


def prepared(spark: SparkSession, config: Mapping[str, Any], model_only: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(locations, baseline, counterfactual, hats): made from the sources and published, or read from a run before."""
    paths, standard = config["paths"], Path(config["paths"]["standardized_input"])
    if model_only or config["project"].get("reuse_standardized_inputs"):
        locations = numbered(files.read_locations(spark, str(standard / "locations.csv")).withColumnRenamed("loc_idx", "__line"), ["__line"], "loc_idx").drop("__line").persist()
        before = files.read_matrix(spark, str(standard / "travel_times_baseline.csv"), locations)
        after = files.read_matrix(spark, str(standard / "travel_times_counterfactual.csv"), locations)
        shocks = standard / "shocks" / "shocks.csv"
        hats = files.read_shocks(spark, str(shocks), locations) if shocks.exists() else locations.select("loc_idx", *[F.lit(1.0).alias(h) for h in spatial.HATS])
    else:
        grid, project = config["grid"], config["project"]
        if not project["run_grid"]:
            locations = published_locations(spark, standard, grid.get("analysis_crs") or grid.get("target_crs"))
        elif grid["mode"] == "generate_from_source_layers":
            locations, allocation = generate_grid_inputs(read_polygon_folder(spark, paths["source_grid_folder"]), grid)
            files.write_json({"allocation": [r.asDict() for r in allocation.collect()]}, str(standard / "grid_report.json"))
        else:
            attributes = spark.read.option("header", True).csv(paths["source_grid_csv"])
            locations = prepare_grid_inputs(attributes, read_layer(spark, paths["source_grid_geometry"]), grid)
        locations = cut(locations)
        matrix = config["ttmatrix"]
        if not project["run_ttmatrix"]:
            before, after = (files.read_matrix(spark, str(standard / f"travel_times_{k}.csv"), locations) for k in ("baseline", "counterfactual"))
            report = matrices.summary(before, after)
        elif matrix["source"] == "user_provided":
            before, after, report = prepare_travel_times(spark, locations, paths["baseline_matrix"], paths["counterfactual_matrix"], matrix)
        else:
            crs = locations.select("crs").first().crs
            layers = {k: read_network(read_layer(spark, paths[f"{k}_network"]), read_layer(spark, paths[f"{k}_stations"]), crs) if paths.get(f"{k}_network") else None for k in ("baseline", "counterfactual")}
            before, after, report = generate_travel_times(locations, layers, matrix)
        scenario = config["scenario"]
        policies = read_layer(spark, scenario["shocks_shapefile"], scenario.get("shocks_layer")) if scenario.get("shocks_shapefile") else None
        hats = prepare_primitive_shocks(locations, policies, scenario)
        files.write_csv(locations.orderBy("loc_idx").select(*files.LOCATIONS.names), str(standard / "locations.csv"))
        files.write_matrix(before, locations, str(standard / "travel_times_baseline.csv"))
        files.write_matrix(after, locations, str(standard / "travel_times_counterfactual.csv"))
        files.write_json(report.first().asDict(), str(standard / "travel_time_report.json"))
        shown, epsg = in_output_crs(locations, config["grid"]["output_crs"])
        outputs.publish_layers(shown, standard, epsg)
        shocks = standard / "shocks" / "shocks.csv"
        if policies is None:
            for stale in (shocks, shocks.with_suffix(".gpkg")):
                stale.unlink(missing_ok=True)  # a stale scenario must not be read by a later run
        else:
            files.write_csv(hats.join(locations.select("loc_idx", "location_id"), "loc_idx").orderBy("loc_idx").select(*files.SHOCKS.names), str(shocks))
            outputs.publish_shocks(shown, hats, shocks.with_suffix(".gpkg"), epsg)
        files.write_json(outputs.scenario_report(hats), str(standard / "scenario_report.json"))
    return locations, before, after, hats
