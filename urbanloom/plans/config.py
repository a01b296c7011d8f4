"""Configuration: defaults, deep merge, path resolution and cross-field checks."""

from __future__ import annotations

import copy
import json
from collections.abc import Mapping
from pathlib import Path
from typing import Any

from urbanloom.errors import ConfigurationError

#: Default values that runs of existing configurations rely on.
DEFAULTS: dict[str, Any] = {
    "project": {"run_grid": True, "run_ttmatrix": True, "run_inversion": True, "run_simulation": True, "run_no_spillover_comparison": True, "reuse_standardized_inputs": False},
    "paths": {"baseline_network": None, "baseline_stations": None, "counterfactual_network": None, "counterfactual_stations": None, "baseline_matrix": None, "counterfactual_matrix": None},
    "grid": {
        "mode": "standardize_existing_output", "cell_geometry": "square", "original_id_variable": None, "analysis_crs": None, "output_crs": "EPSG:4326", "developed_source_variable": None,
        "rent_source_variable": None, "geometry_id_variable": None, "target_crs": None, "missing_value_rule": "stop", "synthetic_rent_population_elasticity": 0.25, "synthetic_rent_random_spread": 0.10, "random_seed": 1,
    },
    "ttmatrix": {
        "source": "ttmatrix", "routing_method": "standalone_ttmatrix", "point_station_neighbors": 3, "point_walking_neighbors": 5, "snap_tolerance_m": 1.0, "station_split_buffer_m": 0.5,
        "station_connector_minutes": 0.0001, "detour_warning_ratio": 2.0, "workers": 1, "legacy_station_candidates": "all", "time_unit": "minutes", "intrazonal_rule": "keep", "intrazonal_minutes": 0.0,
        "unreachable_rule": "stop",
    },
    "model": {"city_closure": "both", "productivity_spillover": 0.0, "amenity_spillover": 0.0, "construction_capital_share": 0.75, "construction_land_share": 0.25},
    "numerics": {"tolerance_equilibrium": 1e-6, "maximum_iterations": 10_000, "damping_equilibrium": 0.10, "print_every": 25},
    "scenario": {"shocks_shapefile": None, "shocks_layer": None, "analysis_crs": None, "productivity_hat_variable": None, "amenity_hat_variable": None, "structural_density_hat_variable": None},
    "reporting": {"make_maps": False},
}
ALIASES = {("grid", "synthetic_rent_exponent"): "synthetic_rent_population_elasticity", ("ttmatrix", "station_candidates"): "legacy_station_candidates"}
METHOD_ALIASES = {"legacy_access_network_egress": "direct_station_access"}


def merged(base: Mapping[str, Any], update: Mapping[str, Any]) -> dict[str, Any]:
    """``update`` over ``base``: mappings merge key by key, anything else replaces."""
    out = copy.deepcopy(dict(base))
    for key, value in update.items():
        out[key] = merged(out[key], value) if isinstance(value, Mapping) and isinstance(out.get(key), Mapping) else copy.deepcopy(value)
    return out


def required(config: Mapping[str, Any], name: str) -> Any:
    """The value of a dotted key; missing, null and empty ones are errors."""
    value: Any = config
    for part in name.split("."):
        value = value.get(part) if isinstance(value, Mapping) else None
    if value is None or value == "":
        raise ConfigurationError(f"{name} is required")
    return value


def resolved_path(value: str | None, root: Path) -> str | None:
    if value is None:
        return None
    path = Path(value).expanduser()
    return str(path if path.is_absolute() else (root / path).resolve())


def checked(config: dict[str, Any]) -> dict[str, Any]:
    """Enumerations and cross-field rules; the configuration itself is returned."""
    for (section, old), new in ALIASES.items():
        if old in config[section]:
            config[section][new] = config[section].pop(old)
    grid, matrix, model = config["grid"], config["ttmatrix"], config["model"]
    method = str(matrix["routing_method"]).lower()
    matrix["routing_method"] = METHOD_ALIASES.get(method, method)
    choices = {
        "grid.mode": (grid["mode"], ("generate_from_source_layers", "standardize_existing_output")),
        "grid.cell_geometry": (grid["cell_geometry"], ("square", "hexagon", "original")),
        "grid.missing_value_rule": (grid["missing_value_rule"], ("stop", "drop")),
        "ttmatrix.source": (matrix["source"], ("ttmatrix", "user_provided")),
        "ttmatrix.routing_method": (matrix["routing_method"], ("standalone_ttmatrix", "direct_station_access")),
        "ttmatrix.time_unit": (matrix["time_unit"], ("minutes", "seconds", "hours")),
        "ttmatrix.intrazonal_rule": (matrix["intrazonal_rule"], ("keep", "configured_constant")),
        "model.city_closure": (model["city_closure"], ("closed", "open", "both")),
    }
    for name, (value, allowed) in choices.items():
        if str(value).lower() not in allowed:
            raise ConfigurationError(f"{name} is {value!r}; it must be one of {', '.join(allowed)}")
        section, key = name.split(".")
        config[section][key] = str(value).lower()  # choices may be written in any case
    if grid["mode"] == "generate_from_source_layers":
        for name in ("paths.source_grid_folder", "grid.population_source_variable", "grid.employment_source_variable", "grid.total_population"):
            required(config, name)
        if grid["cell_geometry"] != "original" and float(required(config, "grid.cell_size_km")) <= 0:
            raise ConfigurationError("grid.cell_size_km must be positive")
    elif not config["project"]["reuse_standardized_inputs"]:
        for name in ("paths.source_grid_csv", "paths.source_grid_geometry", *[f"grid.{k}_variable" for k in ("id", "population", "employment", "rent")]):
            required(config, name)
        grid["geometry_id_variable"] = grid.get("geometry_id_variable") or grid["id_variable"]
    for name in ("paths.standardized_input", "paths.output"):
        required(config, name)
    for prefix in ("baseline", "counterfactual"):
        if (config["paths"][f"{prefix}_network"] is None) != (config["paths"][f"{prefix}_stations"] is None):
            raise ConfigurationError(f"{prefix} network and stations go together")
    if matrix["source"] == "user_provided":
        required(config, "paths.baseline_matrix")
        required(config, "paths.counterfactual_matrix")
    else:
        for name in ("off_network_speed_kmh", "network_speed_kmh"):
            if float(required(config, f"ttmatrix.{name}")) <= 0:
                raise ConfigurationError(f"ttmatrix.{name} must be positive")
    for name in ("point_station_neighbors", "point_walking_neighbors"):
        if int(matrix[name]) < 1:
            raise ConfigurationError(f"ttmatrix.{name} must be 1 or more")
    for name, other in (("workers", "auto"), ("legacy_station_candidates", "all")):
        if matrix[name] != other and int(matrix[name]) < 1:
            raise ConfigurationError(f"ttmatrix.{name} must be 1 or more, or {other}")
    if abs(float(model["construction_land_share"]) + float(model["construction_capital_share"]) - 1) > 1e-10:
        raise ConfigurationError("construction shares must add up to 1")
    return config


def load_config(path: str) -> tuple[dict[str, Any], Path]:
    """(configuration, project root): YAML over the defaults, with paths resolved from the root."""
    import yaml

    place = Path(path).expanduser().resolve()
    given = yaml.safe_load(place.read_text(encoding="utf-8"))
    if not isinstance(given, Mapping):
        raise ConfigurationError("the configuration must be a mapping")
    root = place.parent.parent if place.parent.name == "config" else place.parent
    config = checked(merged(DEFAULTS, given))
    config["paths"] = {k: resolved_path(v, root) for k, v in config["paths"].items()}
    if config["scenario"]["shocks_shapefile"]:
        config["scenario"]["shocks_shapefile"] = resolved_path(config["scenario"]["shocks_shapefile"], root)
    return config, root


def save_config(config: Mapping[str, Any], path: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(config, indent=2, default=str), encoding="utf-8")
