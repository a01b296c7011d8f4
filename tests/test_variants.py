"""The alternatives agree with the main methods where they should."""

import numpy as np
import pytest

from urbanloom.operators import economy, variants
from urbanloom.plans.parameters import Parameters


def town():
    rng = np.random.default_rng(9)
    n = 8
    xy = rng.uniform(0, 20, (n, 2))
    t0 = np.hypot(*(xy[:, None] - xy[None]).transpose(2, 0, 1)) + 1
    population, jobs = rng.uniform(20, 60, n), rng.uniform(20, 60, n)
    jobs *= population.sum() / jobs.sum()
    return economy.City(population, jobs, rng.uniform(0.8, 1.2, n), np.ones(n)), economy.DenseKernels(t0, 0.9 * t0)


def test_multiplicative_inversion_gives_the_same_percentages():
    city, kernels = town()
    p = Parameters(damping=0.4, tolerance=1e-8)
    a, b = economy.invert(city, kernels, p), variants.multiplicative_inversion(city, kernels, p)
    assert b.converged
    assert np.exp(np.log(b.state["total_productivity"]).mean()) == pytest.approx(1)
    assert a.state["theta"] == pytest.approx(b.state["theta"], abs=1e-4)
    changes = []
    for inverted in (a, b):
        before = economy.solve_closure("closed", p, inverted.fundamentals, kernels)
        after = economy.solve_closure("closed", p, inverted.fundamentals, kernels, matrix=1)
        changes.append(after.utility / before.utility)
        checks = variants.self_checks(p, kernels, after, 1)
        assert checks["residents"] < 1e-9 and checks["workers"] < 1e-9 and checks["income"] < 1e-3
    assert changes[0] == pytest.approx(changes[1], abs=1e-5)


def test_rounded_rule():
    one = lambda a, b: {"wage": (np.array(a), np.array(b))}
    same = variants.rounded_gaps(one([1.001, 2.0], [1.002, 2.0]))
    assert same["equal"] and same["largest"] == same["wage"] == same["objective"] == 0
    other = variants.rounded_gaps(one([1.0, 2.0], [1.02, 2.0]))
    gap = np.log(103) - np.log(101)
    assert not other["equal"] and other["wage"] == pytest.approx(gap) and other["objective"] == pytest.approx(1e6 * gap**2 / 2)
    assert variants.rounded(np.array([0.125, -0.125, 2.5]), 100).tolist() == [13, -13, 250]


@pytest.mark.parametrize("closure", ["closed", "open"])
def test_rounded_closures_reach_the_same_city(spark, closure):
    """They stop earlier than the main solver, so their cities agree to the digits that they compare."""
    city, kernels = town()
    p = Parameters(damping=0.4, tolerance=1e-10)
    inverted = economy.invert(city, kernels, p)
    utility = inverted.utility if closure == "open" else None
    said = []
    close = variants.solve_rounded(closure, p, inverted.fundamentals, kernels, utility, 1, said.append)
    exact = economy.solve_closure(closure, p, inverted.fundamentals, kernels, inverted.utility, 1)
    assert close.converged and close.iterations <= variants.ROUNDED_ITERATIONS and len(said) == close.iterations
    for name, digits in (("wage", 0.05), ("q_res", 0.05), ("theta", 0.05)):
        assert close.state[name] == pytest.approx(exact.state[name], abs=digits)
    assert close.utility == pytest.approx(exact.utility, rel=5e-3)
    rows = variants.convergence_table(spark, close).orderBy("iteration").collect()
    assert [r.iteration for r in rows] == list(range(1, close.iterations + 1)) and rows[-1].wage == 0 and rows[0].largest >= rows[-1].largest
    plain = variants.convergence_table(spark, exact).collect()
    assert len(plain) == exact.iterations and plain[0].wage is None


def test_rounded_weights_follow_the_gap(monkeypatch):
    """Far from agreement half of the prediction is taken, near it a quarter; a city that never agrees raises."""
    city, kernels = town()
    p = Parameters()
    f = economy.invert(city, kernels, p).fundamentals
    monkeypatch.setattr(variants, "ROUNDED_ITERATIONS", 1)
    with pytest.raises(RuntimeError, match="did not converge in 1"):
        variants.solve_rounded("closed", p, f.shocked(productivity=3.0), kernels)
    first, tripled = [], f.shocked(productivity=3.0)
    for weight in (0.25, 0.5):
        monkeypatch.setattr(variants, "FAR_WEIGHT", weight)
        monkeypatch.setattr(variants, "ROUNDED_ITERATIONS", 999)
        first.append(variants.solve_rounded("closed", p, tripled, kernels).iterations)
    assert first[1] < first[0]


def test_inversion_draws_anew_after_a_breakdown():
    city, kernels = town()
    p = Parameters()

    class Breaking(economy.DenseKernels):
        calls = 0

        def answer(self, requests):
            self.calls += 1
            out = super().answer(requests)
            if self.calls == 2:
                out[0].back[:] = np.nan
            return out

    broken = Breaking(*kernels.minutes)
    found = variants.multiplicative_inversion(city, broken, p)
    assert found.converged and found.restarts == 1
    assert found.state["total_productivity"] == pytest.approx(variants.multiplicative_inversion(city, kernels, p).state["total_productivity"], rel=1e-6)
    # The stream that the draws come from, by its published first number for this seed.
    assert np.random.RandomState(1).random_sample() == pytest.approx(0.417022004702574, abs=1e-15)


def test_inversion_goes_on_from_pass_to_pass():
    city, kernels = town()
    p = Parameters()
    whole = variants.multiplicative_inversion(city, kernels, p)
    short = variants.multiplicative_inversion(city, kernels, p, passes=200, updates=5)
    assert whole.passes == 1 and short.passes > 1 and short.iterations == whole.iterations
    with pytest.raises(RuntimeError, match="did not agree in 1 passes"):
        variants.multiplicative_inversion(city, kernels, p, passes=1, updates=3)


def test_interactive_grid_and_shocks(spark):
    cells = variants.browser_grid(spark, (10.0, 50.0, 10.1, 50.05), 1.0).cache()
    sources = spark.createDataFrame([(10.05, 50.02, 3.0), (10.051, 50.021, 4.0), (50.0, 0.0, 9.0)], "x double, y double, population double")
    assert variants.browser_attribution(cells, sources, ["population"]).agg({"population": "sum"}).first()[0] == 7
    ring = [{"x": x, "y": y} for x, y in ((9.0, 49.0), (11.0, 49.0), (11.0, 51.0), (9.0, 51.0))]
    policies = spark.createDataFrame([([ring], 10.0), ([ring], -10.0)], "rings array<array<struct<x:double,y:double>>>, pct double")
    hats = [r.hat for r in variants.browser_shocks(cells, policies).collect()]
    assert len(hats) == cells.count() and all(h == pytest.approx(0.99) for h in hats)
    with pytest.raises(ValueError, match="cells"):
        variants.browser_grid(spark, (10.0, 50.0, 11.0, 51.0), 0.5)
