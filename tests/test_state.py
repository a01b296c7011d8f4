"""A saved inversion gives the results of a fresh one, and is refused where it does not belong."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from urbanloom.errors import ConfigurationError
from urbanloom.operators import economy
from urbanloom.plans import stages, state
from urbanloom.plans.parameters import Parameters


@pytest.fixture(scope="module")
def inputs(spark):
    n, rng = 6, np.random.default_rng(5)
    xy = rng.uniform(0, 9, (n, 2))
    t = np.hypot(*(xy[:, None] - xy[None]).transpose(2, 0, 1)) + 1
    jobs, people = rng.uniform(10, 30, n), rng.uniform(10, 30, n)
    jobs *= people.sum() / jobs.sum()
    rows = [(k, f"L{k}", float(people[k]), float(jobs[k]), float(rng.uniform(0.8, 1.2)), 1.0) for k in range(n)]
    locations = spark.createDataFrame(rows, "loc_idx long, location_id string, population double, employment_model double, rent_floor_space double, land_area double").cache()
    pairs = lambda m: spark.createDataFrame([(i, j, float(m[i, j])) for i in range(n) for j in range(n)], "o_idx long, d_idx long, minutes double").cache()
    hats = locations.select("loc_idx", (1 + 0.02 * (F.col("loc_idx") % 2)).alias("productivity_hat"), F.lit(1.0).alias("amenity_hat"), F.lit(1.0).alias("structural_density_hat"))
    return locations, pairs(t), pairs(0.9 * t), hats


def test_counterfactual_from_a_saved_inversion(spark, inputs, tmp_path, monkeypatch):
    locations, before, after, hats = inputs
    p = Parameters(damping=0.5, tolerance=1e-4)
    saved = stages.invert_baseline(spark, locations, before, p, folder=str(tmp_path))
    loaded = state.load(spark, str(tmp_path), p, locations, before, ["with_spillovers", "no_spillovers"])
    for name, one in saved.items():
        two = loaded[name]
        assert one.utility == two.utility and one.iterations == two.iterations and set(one.state) == set(two.state)
        assert (one.fundamentals.productivity == two.fundamentals.productivity).all() and (one.workplace_factor == two.workplace_factor).all()
    fresh = stages.run_model(spark, locations, before, after, hats, p, ("closed",))
    monkeypatch.setattr(economy, "invert_variants", None)  # nothing is inverted again
    said = []
    again = stages.run_model(spark, locations, before, after, hats, p, ("closed",), report=said.append, inversions=loaded)
    assert fresh["aggregate_changes"].collect() == again["aggregate_changes"].collect() and any("closed city" in x for x in said)
    assert fresh["inverted_primitives"].collect() == again["inverted_primitives"].collect()


def test_states_that_do_not_belong_are_refused(spark, inputs, tmp_path):
    locations, before, after, _ = inputs
    p, folder = Parameters(damping=0.5, tolerance=1e-4), str(tmp_path)
    load = lambda p=p, locations=locations, before=before, names=("no_spillovers",): state.load(spark, folder, p, locations, before, names)
    with pytest.raises(ConfigurationError, match="invert the baseline first"):
        load()
    stages.invert_baseline(spark, locations, before, p, (False,), folder)
    assert load(Parameters(damping=0.1))["no_spillovers"].converged
    with pytest.raises(ConfigurationError, match="another epsilon"):
        load(Parameters(epsilon=5.0))
    with pytest.raises(ConfigurationError, match="other times_digest"):
        load(before=after)
    with pytest.raises(ConfigurationError, match="other locations_digest"):
        load(locations=locations.withColumn("population", F.col("population") + 1))
    with pytest.raises(ConfigurationError, match="has no with_spillovers"):
        load(names=("with_spillovers",))
    sidecar = tmp_path / state.SIDECAR
    sidecar.write_text(json.dumps(json.loads(sidecar.read_text()) | {"version": 0}))
    with pytest.raises(ConfigurationError, match="version 0"):
        load()
    with pytest.raises(RuntimeError, match="did not balance"):
        state.save(spark, folder, {"x": economy.Inversion(None, {}, 1.0, None, None, 1, False, 1.0, 1.0)}, p, locations, before)
