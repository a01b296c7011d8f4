"""The interactive variant: a city layer in degrees becomes cells, drawn features a scenario, both an appraisal and a package."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from urbanloom.errors import GridInputError
from urbanloom.functions import columns as C
from urbanloom.lineage import cut
from urbanloom.operators import economy, geodesic, geometry, networks, reporting, routing, spatial, variants
from urbanloom.plans.parameters import Parameters

#: Cells of a city at most, and the least count of people or jobs that a cell has in the model.
MOST_CELLS, LEAST_COUNT = 2000, 1e-6
#: Percentages that a drawn polygon may carry, and the hats that they make.
SHOCKS = {"productivity_pct": "productivity_hat", "amenity_pct": "amenity_hat", "structural_density_pct": "structural_density_hat"}


def _property(name: str):
    return F.coalesce(F.nanvl(F.col("properties")[name].try_cast("double"), F.lit(0.0)), F.lit(0.0))


def prepared_grid(layer: DataFrame, size_km: float, shape: str = "hexagon", limit: int = MOST_CELLS) -> DataFrame:
    """Cells with people, jobs or developed land: loc_idx, location_id, grid_sequence, lon, lat, population, employment_model,
    rent_floor_space, land_area (square metres), rings.

    ``layer``: a LAYER in degrees whose properties tell developed land, shares of residents and jobs, and a density of
    people. A feature counts where its centroid lies: people are its density times its area. More than ``limit`` cells raise.
    """
    spark = layer.sparkSession
    active = cut(geometry.repaired(variants.browser_sources(layer)).where(F.size("coords") > 0))
    if active.isEmpty():
        raise GridInputError("the city layer has no developed, lived-in or worked-in feature")
    density = F.filter(F.map_entries("properties"), lambda e: e["key"].startswith("pop_den"))
    people = F.coalesce(F.get(density, F.lit(0))["value"].try_cast("double"), F.lit(0.0))
    centre = C.polygon_centroid(F.col("coords"))
    sources = active.select(
        centre["x"].alias("x"), centre["y"].alias("y"), F.greatest(F.lit(0.0), people * geodesic.polygon_area_km2(F.col("coords"))).alias("population"),
        F.greatest(F.lit(0.0), _property("emp_sh")).alias("employment_raw"), (_property("devle") > 0).cast("double").alias("developed"),
    )
    bounds = tuple(active.select(spatial.bounds_of(F.col("coords")).alias("b")).agg(F.min("b.x0"), F.min("b.y0"), F.max("b.x1"), F.max("b.y1")).first())
    cells = cut(variants.browser_grid(spark, bounds, size_km, shape, limit=4 * limit + 1000))
    sums = variants.browser_attribution(cells, sources, ["population", "employment_raw", "developed"])
    kept = spatial.retained(cells.join(sums, "grid_sequence").withColumn("land_area", 1e6 * geodesic.polygon_area_km2(F.col("rings"))))
    if (n := kept.count()) > limit:
        raise GridInputError(f"{n} cells; choose a larger size to stay within {limit}")
    # The interactive grid is bounded by its limit, so one task numbers its cells.
    numbered = kept.withColumn("loc_idx", F.row_number().over(W.orderBy("grid_sequence")).cast("long") - 1).withColumn("location_id", (F.col("loc_idx") + 1).cast("string"))
    totals = numbered.agg(F.sum("population").alias("people"), F.sum("employment_raw").alias("jobs"))
    balanced = numbered.crossJoin(F.broadcast(totals)).withColumn("employment_model", F.when(F.col("jobs") > 0, F.col("employment_raw") / F.col("jobs") * F.col("people")).otherwise(F.col("population")))
    rented = spatial.browser_rent(balanced)
    return cut(rented.select("loc_idx", "location_id", "grid_sequence", "lon", "lat", "population", "employment_model", "rent_floor_space", "land_area", "rings"))


@dataclass(frozen=True)
class Scenario:
    """What was drawn: a network of transport lines and stations, and polygons with percentages."""

    network: routing.Network | None
    shocks: DataFrame

    @classmethod
    def of(cls, drawn: DataFrame) -> Scenario:
        """``drawn``: a LAYER in degrees whose property ``kind`` is transport, station or shock."""
        kind = F.col("properties")["kind"]
        lines = drawn.where((kind == "transport") & (F.col("kind") == "line"))
        points = drawn.where((kind == "station") & (F.col("kind") == "point"))
        at = F.col("coords")[0][0]
        stations = points.select(F.col("feature").alias("station"), at["x"].alias("x"), at["y"].alias("y"))
        shocks = geometry.repaired(drawn.where((kind == "shock") & (F.col("kind") == "polygon"))).where(F.size("coords") > 0)
        given = shocks.select(F.col("coords").alias("rings"), *[F.col("properties")[pct].try_cast("double").alias(pct) for pct in SHOCKS])
        network = None if lines.isEmpty() and stations.isEmpty() else routing.Network(networks.layer_segments(lines), stations)
        return cls(network, given)


def hats(cells: DataFrame, scenario: Scenario) -> DataFrame:
    """loc_idx and the three hats, the products over the drawn polygons that hold a cell's centre."""
    found = variants.browser_shocks(cells, scenario.shocks, SHOCKS)
    return cells.select("loc_idx", "grid_sequence").join(found, "grid_sequence").select("loc_idx", *SHOCKS.values())


def simulate(
    spark: SparkSession, cells: DataFrame, baseline: routing.Network | None, scenario: Scenario, off_kmh: float, on_kmh: float, p: Parameters | None = None, closures: Sequence[str] = ("closed", "open"),
    spillovers: bool = True, report: Callable[[str], None] | None = None,
) -> tuple[dict[str, dict[str, Any]], dict[str, DataFrame]]:
    """(by closure the cards, convergence, iterations and seconds; by closure the local outcomes) of a prepared grid."""
    began, p = time.monotonic(), p or Parameters()
    points = cut(cells.select("loc_idx", F.col("lon").alias("x"), F.col("lat").alias("y")))
    before, after = geodesic.composed_times(points, baseline, scenario.network, off_kmh, on_kmh)
    counted = cells.withColumns({c: F.greatest(F.col(c), F.lit(LEAST_COUNT)) for c in ("population", "employment_model")})
    town = economy.City.of(spatial.share_scaled(counted, "employment_model", float(counted.agg(F.sum("population")).first()[0])))
    given = hats(cells, scenario).orderBy("loc_idx").toPandas()
    shocks = dict(zip(("productivity", "amenity", "density"), (given[h].to_numpy(float) for h in SHOCKS.values()), strict=True))
    kernels = economy.BlockedKernels(len(town.population), before, after)
    solved = economy.appraise(town, kernels, p, shocks, closures, (spillovers,), report)
    ids = [r.location_id for r in cells.orderBy("loc_idx").select("location_id").collect()]
    by_closure, local = {}, {}
    for _, a, b, row, q in solved:
        name = b.closure if b.closure == "fixed_distribution" else f"{b.closure}_city"
        by_closure[name] = {"cards": cards(q, a, b, row), "converged": bool(b.converged), "iterations": int(b.iterations), "elapsed_seconds": round(time.monotonic() - began, 3)}
        local[name] = reporting.local_outcomes(spark, ids, q, a, b)
    return by_closure, local


def cards(p: Parameters, before: economy.Solution, after: economy.Solution, row: Mapping[str, Any]) -> list[dict[str, Any]]:
    """Label, baseline, counterfactual and percentage of each aggregate that has levels; of the others the percentage."""
    sums = {"Population": (before.population, after.population), "GDP": (before.state["output"].sum(), after.state["output"].sum()), "Total land rent": (economy.land_rent(p, before).sum(), economy.land_rent(p, after).sum())}
    levels = {"Expected utility": (before.utility, after.utility)} | sums
    keys = {"Expected utility": "ExpectedUtilityPct", "Population": "PopulationPct", "GDP": "GDPPct", "Total land rent": "TotalLandRentPct"}
    out = [{"label": label, "baseline": float(a), "counterfactual": float(b), "change": row[keys[label]]} for label, (a, b) in levels.items()]
    changes = {"Commuting time, immediate": "ImmediateCommuteTimeChangePct", "Commuting time, after moves": "PostRelocationCommuteTimeChangePct", "Commuter minutes": "TotalCommuterMinutesChangePct"}
    return out + [{"label": label, "baseline": None, "counterfactual": None, "change": row[key]} for label, key in changes.items()]
