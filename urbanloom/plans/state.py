"""The saved state of an inversion: a Parquet table of its vectors and a JSON sidecar, so that counterfactuals need not invert.

A state is for the locations, parameters and baseline times that it was made from; a run with others is refused.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import asdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanloom.errors import ConfigurationError
from urbanloom.operators import economy
from urbanloom.plans.parameters import Parameters
from urbanloom.sources import files

#: Raised when the table's columns or the sidecar's keys change.
VERSION = 1
TABLE, SIDECAR = "baseline_inversion.parquet", "baseline_inversion.json"
FUNDAMENTALS = ("productivity", "amenity", "density", "land_area")
START = ("wage", "income", "theta", "q_res", "q_com", "employment", "population")
NUMBERS = ("utility", "iterations", "converged", "residence_gap", "workplace_gap")


def fingerprint(locations: DataFrame, before: DataFrame) -> dict[str, str | int]:
    """What a state must be used with: the locations' ids, margins, rents and areas in order, and the baseline's times."""
    digest = lambda frame, columns: frame.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*columns).cast("decimal(38,0)"))).first()
    n, places = digest(locations, ["loc_idx", "location_id", "population", "employment_model", "rent_floor_space", "land_area"])
    pairs, times = digest(before, ["o_idx", "d_idx", F.col("minutes").cast("double")])
    return {"locations": n, "locations_digest": str(places), "pairs": pairs, "times_digest": str(times)}


def _table(name: str, inversion: economy.Inversion) -> pd.DataFrame:
    f, n = inversion.fundamentals, len(inversion.fundamentals.density)
    columns = {"specification": [name] * n, "loc_idx": np.arange(n, dtype=np.int64)}
    columns |= {f"fundamental_{c}": np.asarray(getattr(f, c), float) for c in FUNDAMENTALS}
    columns |= {f"start_{c}": np.asarray(f.start[c], float) for c in START} | {f"state_{c}": np.asarray(v, float) for c, v in inversion.state.items()}
    return pd.DataFrame(columns | {"residence_factor": inversion.residence_factor, "workplace_factor": inversion.workplace_factor})


def save(spark: SparkSession, folder: str, inversions: Mapping[str, economy.Inversion], p: Parameters, locations: DataFrame, before: DataFrame) -> None:
    """Write the state; an inversion that did not converge is refused."""
    for name, inversion in inversions.items():
        if not inversion.converged:
            raise RuntimeError(f"{name}: the baseline did not balance (gaps {inversion.residence_gap:.3g}, {inversion.workplace_gap:.3g})")
    frame = pd.concat([_table(name, x) for name, x in inversions.items()], ignore_index=True)
    spark.createDataFrame(frame).write.mode("overwrite").parquet(f"{folder}/{TABLE}")
    numbers = {name: {k: getattr(x, k) for k in NUMBERS} for name, x in inversions.items()}
    files.write_json({"version": VERSION, "parameters": asdict(p), "made_from": fingerprint(locations, before), "specifications": numbers}, f"{folder}/{SIDECAR}")


def load(spark: SparkSession, folder: str, p: Parameters, locations: DataFrame, before: DataFrame, specifications: Sequence[str]) -> dict[str, economy.Inversion]:
    """The inversions of the named specifications. A state of another version, other parameters or other inputs raises."""
    try:
        with open(f"{folder}/{SIDECAR}", encoding="utf-8") as stream:
            sidecar = json.load(stream)
    except FileNotFoundError:
        raise ConfigurationError(f"no saved inversion in {folder}; invert the baseline first") from None
    if sidecar.get("version") != VERSION:
        raise ConfigurationError(f"the saved inversion has version {sidecar.get('version')}, not {VERSION}; invert the baseline again")
    # How a fixed point is sought may differ between the inversion and its counterfactuals; the economy may not.
    ours, theirs = asdict(p), sidecar["parameters"]
    differing = [k for k in ours if k not in ("damping", "tolerance", "maximum_iterations", "print_every") and ours[k] != theirs.get(k)]
    if differing:
        raise ConfigurationError(f"the saved inversion was made with another {', '.join(differing)}")
    if (found := fingerprint(locations, before)) != sidecar["made_from"]:
        raise ConfigurationError(f"the saved inversion was made from other {', '.join(k for k in found if found[k] != sidecar['made_from'].get(k))}")
    if missing := [name for name in specifications if name not in sidecar["specifications"]]:
        raise ConfigurationError(f"the saved inversion has no {', '.join(missing)}")
    rows = spark.read.parquet(f"{folder}/{TABLE}").where(F.col("specification").isin(list(specifications))).orderBy("specification", "loc_idx").toPandas()
    out = {}
    for name in specifications:
        own = rows[rows.specification == name]
        column = lambda c, own=own: own[c].to_numpy(float)
        f = economy.Fundamentals(*[column(f"fundamental_{c}") for c in FUNDAMENTALS], {c: column(f"start_{c}") for c in START})
        state = {c.removeprefix("state_"): column(c) for c in own.columns if c.startswith("state_")}
        numbers = sidecar["specifications"][name]
        out[name] = economy.Inversion(f, state, numbers["utility"], column("residence_factor"), column("workplace_factor"), numbers["iterations"], numbers["converged"], numbers["residence_gap"], numbers["workplace_gap"])
    return out
