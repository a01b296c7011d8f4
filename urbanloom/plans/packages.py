"""The interactive variant's run package: settings, layers, inputs, and tables of cells and cards by closure."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanloom.functions import columns as C
from urbanloom.sources import files

#: The columns of the summary of cards, fixed by those who read it.
SUMMARY = "closure string, measure string, baseline double, counterfactual double, percentage_change double, converged boolean, iterations int, elapsed_seconds double"


def safe_slug(value: str | None, otherwise: str = "run") -> str:
    """Lower-case letters and digits of a name, joined by hyphens. Letters with marks are taken apart, and the marks divide."""
    plain = unicodedata.normalize("NFKD", str(value or otherwise))
    return re.sub("^-|-$", "", re.sub("[^a-zA-Z0-9]+", "-", plain)).lower() or otherwise


def package_name(prefix: str, name: str | None, completed: str) -> str:
    """prefix-slug-stamp.zip; ``completed`` is an ISO time, whose hyphens, colons and milliseconds go."""
    stamp = re.sub(r"\.\d{3}Z$", "Z", re.sub("[-:]", "", completed))
    return f"{prefix}-{safe_slug(name)}-{stamp}.zip"


def cell_results(local: DataFrame, outcomes: Sequence[str]) -> DataFrame:
    """location_id and, of each outcome, its value before and after, the difference, and the percentage (null for a baseline of 0)."""
    columns = [F.col("location_id")]
    for name in outcomes:
        a, b = F.col(f"{name}_baseline"), F.col(f"{name}_counterfactual")
        columns += [a, b, (b - a).alias(f"{name}_absolute_change"), C.package_percent_change(b, a).alias(f"{name}_percentage_change")]
    return local.select(*columns)


def aggregate_summary(spark: SparkSession, by_closure: Mapping[str, Mapping[str, Any]]) -> DataFrame:
    """A row for each card of each closure. A card has label, baseline, counterfactual and change; a closure cards, converged, iterations, elapsed_seconds."""
    number = lambda v: None if v is None else float(v)
    rows = [
        (name, card["label"], number(card.get("baseline")), number(card.get("counterfactual")), number(card.get("change")), result.get("converged"), result.get("iterations"), number(result.get("elapsed_seconds")))
        for name, result in by_closure.items()
        for card in result.get("cards") or []
    ]
    return spark.createDataFrame(rows, SUMMARY)


def write_run_package(path: str, run: Mapping[str, Any], local: Mapping[str, DataFrame], outcomes: Sequence[str], spark: SparkSession) -> list[str]:
    """Write a completed run's zip; the names in it. Maps are not drawn.

    ``run`` has settings, city, started_at, completed_at, source_grid_url, the feature collections prepared_grid,
    drawn_features, baseline_network and baseline_stations, model_input, and result (by_closure). A package is of a city
    that a browser holds: its cells are bounded by the interactive grid's limit.
    """
    missing = [k for k in ("result", "model_input", "prepared_grid") if not run.get(k)]
    if missing or not run["result"].get("by_closure"):
        raise ValueError("a package needs a completed run")
    layers = {k: run.get(k) or {"type": "FeatureCollection", "features": []} for k in ("prepared_grid", "drawn_features", "baseline_network", "baseline_stations")}
    counts = {name: len(layers[key]["features"]) for name, key in (("prepared_cells", "prepared_grid"), ("drawn_features", "drawn_features"), ("baseline_lines", "baseline_network"), ("baseline_stations", "baseline_stations"))}
    settings = {k: v for k, v in (run.get("settings") or {}).items() if k != "features"}
    scenario = {"run_started_at": run.get("started_at"), "run_completed_at": run.get("completed_at"), "city": run.get("city"), "settings": settings, "counts": counts, "source_grid_url": run.get("source_grid_url")}
    by_closure = run["result"]["by_closure"]
    documents: dict[str, Any] = {
        "README.md": f"# Run package\n\n{counts['prepared_cells']} cells, closures: {', '.join(by_closure)}.\n", "scenario/settings.json": scenario, "scenario/drawn_features.geojson": layers["drawn_features"],
        "scenario/baseline_network.geojson": layers["baseline_network"], "scenario/baseline_stations.geojson": layers["baseline_stations"], "inputs/prepared_grid.geojson": layers["prepared_grid"],
        "inputs/model_input.json": run["model_input"], "results/all_closures.json": run["result"], "results/aggregate_summary.csv": aggregate_summary(spark, by_closure).toPandas(),
    }
    for name in by_closure:
        documents[f"results/{name}_cell_results.csv"] = cell_results(local[name], outcomes).toPandas()
    files.write_package(path, documents)
    return list(documents)
