"""What a run leaves behind: layers, map classes, diagnostics, the summary and the run package."""

from __future__ import annotations

import re
import time
from collections.abc import Mapping, Sequence
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanloom.errors import ConfigurationError, GridInputError, ShockMapError
from urbanloom.functions import columns as C
from urbanloom.operators import reporting, spatial
from urbanloom.sources import files

#: Tables that a run may publish; those of an earlier run that this one does not make are deleted.
OWN_TABLES = re.compile(r"(aggregate_changes|block_outcomes_\w+|welfare_decomposition\w*|inverted_primitives|map_classes|map_thresholds|shock_map_ranges|console_summary)\.csv")


class Timers:
    """Seconds of each named step of a run, for its report."""

    def __init__(self) -> None:
        self.seconds: dict[str, float] = {}

    @contextmanager
    def step(self, name: str):
        began = time.monotonic()
        try:
            yield
        finally:
            self.seconds[name] = round(self.seconds.get(name, 0.0) + time.monotonic() - began, 3)


def variant_folder(output: str | Path, variant: str | None) -> Path:
    """The folder of a named variant inside the output folder; a name may not leave it."""
    if not variant:
        return Path(output)
    if re.search(r"[/\\]", variant) or variant in (".", ".."):
        raise ConfigurationError(f"variant {variant!r} must be a single folder name")
    return Path(output) / variant


# Layers


def layer_features(locations: DataFrame, columns: Sequence[str], kind: str = "polygon") -> list[tuple[str, list, dict]]:
    """Features in the locations' order: their rings, or their centroids as points. One a location, as the solver's vectors."""
    shape = F.col("rings") if kind == "polygon" else F.array(F.array(F.struct("x", "y")))
    rows = locations.orderBy("loc_idx").select(shape.alias("shape"), *columns).toLocalIterator()
    return [(kind, [[(p.x, p.y) for p in ring] for ring in row["shape"]], {c: row[c] for c in columns}) for row in rows]


def publish_layers(locations: DataFrame, folder: Path, epsg: int) -> None:
    """grid.gpkg (layer grid), grid.shp and centroids.gpkg (layer centroids, with lon and lat where the locations have them)."""
    columns = [c for c in files.LOCATIONS.names if c in locations.columns]
    cells = layer_features(locations, columns)
    files.write_geopackage(cells, str(folder / "grid.gpkg"), "grid", epsg)
    files.write_shapefile([(kind, parts, {"loc_id" if k == "location_id" else k: v for k, v in given.items()}) for kind, parts, given in cells], str(folder / "grid.shp"), epsg)
    files.write_geopackage(layer_features(locations, ["location_id", "x", "y"], "point"), str(folder / "centroids.gpkg"), "centroids", epsg)


def publish_shocks(locations: DataFrame, hats: DataFrame, path: Path, epsg: int) -> None:
    """The shock polygons: locations with their three hats."""
    joined = locations.select("loc_idx", "location_id", "rings").join(hats.select("loc_idx", *spatial.HATS), "loc_idx")
    files.write_geopackage(layer_features(joined, ["location_id", *spatial.HATS]), str(path), "shocks", epsg)


def read_centroids(spark: SparkSession, path: str, locations: DataFrame) -> DataFrame:
    """loc_idx, location_id, x, y of a published centroid layer, for each location; a location without one is an error."""
    points = files.read_geopackage(spark, path, "centroids").select(C.canonical_id(F.col("properties")["location_id"]).alias("location_id"), F.col("coords")[0][0].alias("p"))
    joined = checked_join(locations.select("loc_idx", "location_id"), points, "location_id")
    missing = [r.location_id for r in joined.where("p is null").select("location_id").limit(5).collect()]
    if missing:
        raise GridInputError(f"no centroid for {', '.join(missing)}")
    return joined.select("loc_idx", "location_id", F.col("p.x").alias("x"), F.col("p.y").alias("y"))


def checked_join(layer: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """The layer's rows, each with at most one of the table: repeated keys on a side, or no match at all, are errors."""
    for name, side in (("layer", layer), ("table", table)):
        twice = [str(r[key]) for r in side.groupBy(key).count().where("count > 1").limit(5).collect()]
        if twice:
            raise GridInputError(f"the {name} has {key} more than once: {', '.join(twice)}")
    joined = layer.join(table.withColumn("__found", F.lit(True)), key, "left")
    if joined.agg(F.count(F.lit(1)).alias("n"), F.count("__found").alias("found")).where("n > 0 and found = 0").count():
        raise GridInputError(f"no {key} of the layer is in the table")
    return joined.drop("__found")


# Tables


def shock_map_ranges(hats: DataFrame) -> DataFrame:
    """primitive, largest, legend: each shock map's scale runs from -largest to largest percent."""
    pct = reporting.shock_percent(hats)
    if pct.where(F.col("pct").isNull() | F.isnan("pct")).limit(1).count():
        raise ShockMapError("hats must be numbers")
    found = pct.groupBy("primitive").agg(F.max(F.abs("pct")).alias("largest"))
    bound = F.format_string("%.3g", "largest")
    legend = F.when(F.col("largest") <= 1e-12, "No imposed change").otherwise(F.concat(F.lit("-"), bound, F.lit(" to "), bound, F.lit(" %")))
    return found.select("primitive", "largest", legend.alias("legend")).orderBy("primitive")


def report_tables(tables: Mapping[str, DataFrame], hats: DataFrame | None = None) -> dict[str, DataFrame]:
    """map_classes and map_thresholds (pooled over the run's cities with spillovers), shock_map_ranges, console_summary."""
    local = None
    for closure in ("closed", "open"):
        if (table := tables.get(f"block_outcomes_{closure}_city")) is not None:
            table = table.withColumn("Closure", F.lit(closure))
            local = table if local is None else local.unionByName(table)
    out = {"console_summary": reporting.console_names(reporting.snapped_aggregate(tables["aggregate_changes"]))}
    if local is not None:
        local = local.persist()
        outcomes = reporting.price_outcomes(local)
        classes = reporting.pooled_classes(reporting.with_mean_rent(local), outcomes)
        out["map_classes"] = classes.orderBy("outcome", "Closure", "location_id")
        out["map_thresholds"] = reporting.symmetric_thresholds(classes, "pct", ["outcome"]).orderBy("outcome")
    if hats is not None:
        out["shock_map_ranges"] = shock_map_ranges(hats)
    return out


def purge(folder: Path, made: Sequence[str]) -> list[str]:
    """Delete tables of earlier runs that this run did not make; the names of those deleted."""
    stale = [p for p in sorted(folder.glob("*.csv")) if OWN_TABLES.fullmatch(p.name) and p.stem not in made]
    for path in stale:
        path.unlink()
    return [p.name for p in stale]


def scenario_report(hats: DataFrame) -> dict:
    """Of each hat: its least, mean and largest value and how many locations it changes."""
    row = hats.agg(F.count(F.lit(1)).alias("locations"), *[f(h).alias(f"{h}_{name}") for h in spatial.HATS for name, f in (("min", F.min), ("mean", F.avg), ("max", F.max))],
                   *[F.count_if(F.abs(F.col(h) - 1) > 1e-12).alias(f"{h}_changed") for h in spatial.HATS]).first()
    return row.asDict()


def package(path: str, config: Mapping, output: Path, standard: Path, made: Sequence[str]) -> None:
    """One zip of a run: the configuration, the standardised inputs and every table that the run published."""
    documents: dict[str, Mapping | str] = {"scenario.json": dict(config)}
    for source in (standard / "locations.csv", standard / "shocks" / "shocks.csv", standard / "grid_report.json", standard / "travel_time_report.json", standard / "scenario_report.json", output / "run_report.json"):
        if source.exists():
            documents[f"inputs/{source.name}" if source.is_relative_to(standard) else source.name] = source.read_text(encoding="utf-8")
    for name in made:
        documents[f"results/{name}.csv"] = (output / f"{name}.csv").read_text(encoding="utf-8")
    files.write_package(path, documents)
