"""Alternatives to the main methods: the multiplicative inversion, the rounded closures, self-checks, and the interactive
variant's geometry."""

from __future__ import annotations

import math
from collections.abc import Mapping

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanloom.functions import columns as C
from urbanloom.operators import economy, spatial
from urbanloom.operators.economy import Products
from urbanloom.plans.parameters import TINY, Parameters

KM_PER_DEGREE_LON, KM_PER_DEGREE_LAT = 111.32, 110.574


def rounded(values: np.ndarray | float, scale: float) -> np.ndarray:
    """Whole multiples of 1 / scale, halves away from zero."""
    values = np.asarray(values, float) * scale
    return np.sign(values) * np.floor(np.abs(values) + 0.5)


#: Passes of an inversion, updates in a pass, what of a worker counts as agreement, and the seed and spread of draws after a breakdown.
PASSES, UPDATES, WORKER_PARTS = 10, 199, 1e4
SEED, SPREAD = 1, 0.05


def inverting_by_updates(city: economy.City, p: Parameters, passes: int = PASSES, updates: int = UPDATES, report=None) -> economy.Solver:
    """Productivity and amenity by damped multiplicative updates until workers and residents agree to 1 / WORKER_PARTS.

    Wages follow from zero profits given productivity and rent. An update moves productivity and amenity half way to those
    at which the ratio of observed to predicted counts, to 1 / epsilon, would be made good; then the geometric mean of
    productivity is 1 and the flows' mass the population. A pass that has not agreed after its updates is followed by
    another from where it stands. Where a count is no number, both are drawn anew near 1, from one stream of the Mersenne
    Twister over the whole inversion, workplaces first.
    """
    total = float(city.employment.sum())
    works, lives = city.employment > 0, city.population > 0
    decay, draws = p.epsilon * p.kappa, np.random.RandomState(SEED)
    a, b = np.where(works, 1.0, 0.0), np.where(lives, 1.0, 0.0)
    drawn = lambda on: 1 - SPREAD + 2 * SPREAD * draws.random_sample(int(on.sum()))
    done, steps, restarts = False, 0, 0
    for pass_ in range(1, passes + 1):
        for step in range(1, updates + 1):
            with np.errstate(all="ignore"):
                wage = np.where(works, p.alpha * a ** (1 / p.alpha) * ((1 - p.alpha) / city.rent) ** ((1 - p.alpha) / p.alpha), 0.0)
                r = np.where(lives, b**p.epsilon * city.rent ** (-(1 - p.beta) * p.epsilon), 0.0)
                s = np.where(works, wage**p.epsilon, 0.0)
            found = yield Products([(0, decay, None, s)], lambda at, _, r=r: r[at], (0, decay, None))
            steps += 1
            with np.errstate(all="ignore"):
                mass = float(r @ found.rows[0])
                people, jobs = total * r * found.rows[0] / mass, total * s * found.back / mass
                gaps = [float(np.abs(rounded(seen - have, WORKER_PARTS)[on]).max()) for seen, have, on in ((city.employment, jobs, works), (city.population, people, lives))]
            if report:
                report(f"inversion pass {pass_}, update {step}: largest gap {max(gaps) / WORKER_PARTS:.4g}")
            if gaps == [0.0, 0.0]:
                done = True
                break
            if np.isnan(gaps).any():
                restarts += 1
                a[works], b[lives] = drawn(works), drawn(lives)
            else:
                move = lambda seen, have, on: np.where(on, 0.5 + 0.5 * np.divide(seen, have, out=np.ones_like(have), where=on & (have > 0)) ** (1 / p.epsilon), 1.0)
                a, b = a * move(city.employment, jobs, works), b * move(city.population, people, lives)
            a[works] = a[works] / np.exp(np.log(a[works]).mean())
            if np.isfinite(mass) and mass > 0:
                b = b * (total / mass) ** (1 / p.epsilon)
        if done:
            break
    if not done:
        raise RuntimeError(f"the inversion did not agree in {passes} passes; largest gaps {gaps[0] / WORKER_PARTS:.4g} workers, {gaps[1] / WORKER_PARTS:.4g} residents")
    by_land = lambda x: np.divide(x, city.land_area, out=np.zeros_like(x), where=city.land_area > 0)
    products = yield Products([
        (0, decay, None, s * wage), (0, decay, None, s), (0, p.productivity_decay, None, by_land(city.employment)), (0, p.amenity_decay, None, by_land(city.population)),
    ])
    paid, reach, near_jobs, near_people = products.rows
    # Income of the residents that the data show, by the chances to work at each wage.
    income = np.where(lives, city.population * paid / np.where(lives, reach, 1.0), 0.0)
    space = economy.floor_space(city, wage, income, p)
    productivity = np.where(works, a / np.maximum(near_jobs, TINY) ** p.productivity_spillover, 0.0)
    amenity = np.where(lives, b / np.maximum(near_people, TINY) ** p.amenity_spillover, 0.0)
    start = {"wage": wage, "income": income, "theta": space["theta"], "q_res": city.rent, "q_com": city.rent, "employment": city.employment, "population": city.population}
    state = start | {"output": space["output"], "combined_rent": city.rent, "total_productivity": a, "total_amenity": b, "productivity": productivity, "amenity": amenity}
    made = economy.Fundamentals(productivity, amenity, space["density"], city.land_area, start)
    share = float(np.abs(people - city.population).max()) / total, float(np.abs(jobs - city.employment).max()) / total
    out = economy.Inversion(made, state, p.gamma_constant * mass ** (1 / p.epsilon), r / mass, s, steps, done, *share)
    out.restarts, out.passes = restarts, pass_
    return out


def multiplicative_inversion(city: economy.City, kernels: economy.Kernels, p: Parameters, passes: int = PASSES, updates: int = UPDATES) -> economy.Inversion:
    return economy.together(kernels, [inverting_by_updates(city, p, passes, updates)])[0]


def rounded_gaps(pairs: Mapping[str, tuple[np.ndarray, np.ndarray]], digits: int = 2) -> dict[str, float | bool]:
    """The rounded stopping rule's measures over (guessed, predicted) vectors by name: whether all are equal to the digits,
    each one's largest gap of logs of rounded values plus one, the largest of all, and the mean squared one times 1e6."""
    parts = {k: np.abs(np.log(rounded(a, 10.0**digits) + 1) - np.log(rounded(b, 10.0**digits) + 1)) for k, (a, b) in pairs.items()}
    equal = all(np.array_equal(rounded(a, 10.0**digits), rounded(b, 10.0**digits)) for a, b in pairs.values())
    gaps = {k: float(np.max(v, initial=0.0)) for k, v in parts.items()}
    return {"equal": equal} | gaps | {"largest": max(gaps.values()), "objective": 1e6 / len(parts) * sum(float(np.mean(v**2)) if v.size else 0.0 for v in parts.values())}


#: Iterations of a rounded closure, and the weights of predicted values near and far from agreement.
ROUNDED_ITERATIONS, NEAR, NEAR_WEIGHT, FAR_WEIGHT = 999, 0.1, 0.25, 0.5
PATH_COLUMNS = ("wage", "q_com", "q_res", "theta", "largest", "objective")


def solving_rounded(closure: str, p: Parameters, f: economy.Fundamentals, reservation_utility: float | None = None, matrix: int = 0, report=None) -> economy.Solver:
    """A closed or open city, sought until guesses and predictions agree to two digits.

    Output uses the productivity of this iteration's jobs, flows the amenity of the iteration before. Each guess moves
    by NEAR_WEIGHT of the way to its prediction where its own largest gap is below NEAR, else by FAR_WEIGHT; the rents
    move together, by the residential one's gap. A city that has not agreed in ROUNDED_ITERATIONS raises.
    """
    if closure not in ("closed", "open"):
        raise ValueError("closure must be 'closed' or 'open'")
    if closure == "open" and reservation_utility is None:
        raise ValueError("an open city needs a reservation utility")
    works, lives = f.productivity > 0, f.amenity > 0
    mixed, shops_only, homes_only = works & lives, works & ~lives, lives & ~works
    floor = f.density * f.land_area**p.land_share
    wage = np.where(works, f.start["wage"], 0.0)
    q_res, q_com = np.where(lives, f.start["q_res"], 0.0), np.where(works, f.start["q_com"], 0.0)
    theta, people, jobs = np.array(f.start["theta"], float), f.start["population"], f.start["employment"]
    total, decay = float(jobs.sum()), p.epsilon * p.kappa
    by_land = lambda x: np.divide(x, f.land_area, out=np.zeros_like(x), where=f.land_area > 0)
    spilled = lambda own, near, strength: np.where(own > 0, own * np.maximum(near, TINY) ** strength, 0.0)
    near = yield Products([(matrix, p.amenity_decay, None, by_land(people))])
    amenity = spilled(f.amenity, near.rows[0], p.amenity_spillover)
    over = lambda top, bottom, on, otherwise: np.where(on, np.divide(top, bottom, out=np.zeros_like(top), where=on & (bottom > 0)), otherwise)
    path: list[dict] = []
    for k in range(1, ROUNDED_ITERATIONS + 1):
        s = np.where(works, wage**p.epsilon, 0.0)
        r = np.where(lives, amenity**p.epsilon * np.maximum(q_res, TINY) ** (-(1 - p.beta) * p.epsilon), 0.0)
        found = yield Products([(matrix, decay, None, s), (matrix, decay, None, s * wage)], lambda at, _, r=r: r[at], (matrix, decay, None))
        reach, paid = found.rows
        mass = float(r @ reach)
        if not np.isfinite(mass) or mass <= 0:
            raise RuntimeError("commuting probabilities are undefined")
        people, jobs, income = total * r * reach / mass, total * s * found.back / mass, total * r * paid / mass
        utility = p.gamma_constant * mass ** (1 / p.epsilon)
        near = yield Products([(matrix, p.productivity_decay, None, by_land(jobs)), (matrix, p.amenity_decay, None, by_land(people))])
        productivity = spilled(f.productivity, near.rows[0], p.productivity_spillover)
        lagged, amenity = amenity, spilled(f.amenity, near.rows[1], p.amenity_spillover)
        output = np.where(works, productivity * jobs**p.alpha * (theta * floor) ** (1 - p.alpha), 0.0)
        new_wage = over(p.alpha * output, jobs, works, 0.0)
        joint = over((1 - p.alpha) * output + (1 - p.beta) * income, floor, mixed, 0.0)
        new_com = np.where(mixed, joint, over((1 - p.alpha) * output, theta * floor, shops_only, q_com))
        new_res = np.where(mixed, joint, over((1 - p.beta) * income, (1 - theta) * floor, homes_only, q_res))
        new_theta = over((1 - p.alpha) * output, joint * floor, mixed, theta)
        gaps = rounded_gaps({"wage": (wage, new_wage), "q_com": (q_com, new_com), "q_res": (q_res, new_res), "theta": (theta, new_theta)})
        settled = gaps["equal"]
        if closure == "open":
            settled = settled and bool(rounded(utility, 100) == rounded(reservation_utility, 100))
            gaps["largest"] = max(gaps["largest"], abs(float(np.log(utility / reservation_utility))))
        path.append({"iteration": k} | {c: gaps[c] for c in PATH_COLUMNS})
        if report:
            report(f"{closure} city, iteration {k} of {ROUNDED_ITERATIONS}: largest gap {gaps['largest']:.3e}")
        if settled:
            break
        step = {c: NEAR_WEIGHT if gaps[c] < NEAR else FAR_WEIGHT for c in ("wage", "q_res", "theta")}
        blend = lambda old, new, w: w * new + (1 - w) * old
        wage, q_com, q_res, theta = blend(wage, new_wage, step["wage"]), blend(q_com, new_com, step["q_res"]), blend(q_res, new_res, step["q_res"]), blend(theta, new_theta, step["theta"])
        if closure == "open":
            total = 0.95 * total + 0.05 * total * (utility / reservation_utility) ** p.epsilon
    else:
        raise RuntimeError(f"{closure}-city equilibrium did not converge in {ROUNDED_ITERATIONS} iterations")
    state = {
        "wage": wage, "income": income, "theta": theta, "output": output, "q_res": q_res, "q_com": q_com, "employment": jobs, "population": people,
        "combined_rent": np.where(lives, q_res, q_com), "total_productivity": productivity, "total_amenity": lagged, "productivity": f.productivity, "amenity": f.amenity,
    }
    return economy.Solution(closure, state, f, r / mass, s, total, utility, True, len(path), path)


def solve_rounded(closure: str, p: Parameters, f: economy.Fundamentals, kernels: economy.Kernels, reservation_utility: float | None = None, matrix: int = 0, report=None) -> economy.Solution:
    return economy.together(kernels, [solving_rounded(closure, p, f, reservation_utility, matrix, report)])[0]


def convergence_table(spark: SparkSession, solution: economy.Solution) -> DataFrame:
    """iteration and the gaps of a solution's path, a row for each iteration; a path of largest gaps only has that one."""
    rows = [step if isinstance(step, dict) else {"iteration": k, "largest": step} for k, step in enumerate(solution.path, 1)]
    return spark.createDataFrame([tuple(r.get(c) for c in ("iteration", *PATH_COLUMNS)) for r in rows], "iteration int, " + ", ".join(f"{c} double" for c in PATH_COLUMNS))


def self_checks(p: Parameters, kernels: economy.Kernels, solution: economy.Solution, matrix: int = 0) -> dict[str, float]:
    """Mean residuals of a solution's margins: residents and workers by its factors, and total income paid and earned."""
    e, decay = solution.state, p.epsilon * p.kappa
    reach, paid = kernels.rows([(matrix, decay, None, solution.column_factor), (matrix, decay, None, solution.column_factor * e["wage"])])
    people = solution.population * solution.row_factor * reach
    jobs = solution.population * solution.column_factor * kernels.columns((matrix, decay, None, solution.row_factor))
    return {
        "residents": float(np.mean(np.abs(people - e["population"]))), "workers": float(np.mean(np.abs(jobs - e["employment"]))),
        "income": float(abs((solution.population * solution.row_factor * paid).sum() - e["income"].sum())),
    }


def browser_grid(spark: SparkSession, bounds: tuple[float, float, float, float], size_km: float, shape: str = "hexagon", limit: int = 2000) -> DataFrame:
    """Cells over lon/lat bounds on the local plane: grid_sequence, lon, lat (centres), rings in degrees; more than ``limit`` raise."""
    lon0, lat0 = (bounds[0] + bounds[2]) / 2, (bounds[1] + bounds[3]) / 2
    kx, ky = KM_PER_DEGREE_LON * math.cos(math.radians(lat0)), KM_PER_DEGREE_LAT
    box = ((bounds[0] - lon0) * kx, (bounds[1] - lat0) * ky, (bounds[2] - lon0) * kx, (bounds[3] - lat0) * ky)
    cells = spatial.hexagon_grid(spark, box, (0.0, 0.0), size_km) if shape == "hexagon" else spatial.square_grid(spark, box, (0.0, 0.0), size_km)
    if cells.limit(limit + 1).count() > limit:
        raise ValueError(f"more than {limit} cells; choose a larger size")
    back = F.transform("rings", lambda ring: F.transform(ring, lambda p: F.struct((p["x"] / kx + lon0).alias("x"), (p["y"] / ky + lat0).alias("y"))))
    centre = C.polygon_centroid(F.col("rings"))
    return cells.select("grid_sequence", (centre["x"] / kx + lon0).alias("lon"), (centre["y"] / ky + lat0).alias("lat"), back.alias("rings"))


def browser_attribution(cells: DataFrame, sources: DataFrame, columns: list[str], bucket: float = 0.05) -> DataFrame:
    """grid_sequence and sums over the sources (x, y: centroids in degrees) that lie in each cell."""
    keyed = cells.select("grid_sequence", "rings", F.explode(spatial._cells(spatial.bounds_of(F.col("rings")), bucket)).alias("cell"))
    points = sources.select(F.col("x").alias("px"), F.col("y").alias("py"), *columns, F.struct(F.floor(F.col("x") / bucket).alias("i"), F.floor(F.col("y") / bucket).alias("j")).alias("cell"))
    inside = points.join(keyed, "cell").where(C.point_in_polygon(F.col("px"), F.col("py"), F.col("rings")))
    return inside.groupBy("grid_sequence").agg(*[F.sum(c).alias(c) for c in columns])


def browser_sources(layer: DataFrame) -> DataFrame:
    """A LAYER's features with developed land, residents or jobs; the names of their properties in lower case.

    Of names that differ in case only, the last by code point gives the value: a map has no order of its own.
    """
    entries = F.array_sort(F.map_entries("properties"))
    names = F.array_distinct(F.transform(F.map_keys("properties"), F.lower))
    last = F.transform(names, lambda n: F.element_at(F.filter(entries, lambda e: F.lower(e["key"]) == n), -1)["value"])
    named = F.map_from_arrays(names, last)
    positive = [F.coalesce(F.col("properties")[name].try_cast("double"), F.lit(0.0)) for name in ("devle", "pop_sh", "emp_sh")]
    return layer.withColumn("properties", named).where(F.greatest(*[F.nanvl(x, F.lit(0.0)) for x in positive]) > 0)


def browser_views(local: DataFrame, outcome: str) -> DataFrame:
    """location_id, view, value: an outcome before, after, their difference and its percentage (null for a baseline of 0)."""
    a, b = F.col(f"{outcome}_baseline"), F.col(f"{outcome}_counterfactual")
    views = {"baseline": a, "counterfactual": b, "absolute": b - a, "pct": F.when(F.abs(a) > 1e-12, 100 * (b / a - 1))}
    return local.select("location_id", F.explode(F.array(*[F.struct(F.lit(k).alias("view"), v.alias("value")) for k, v in views.items()])).alias("r")).select("location_id", "r.*")


def browser_shocks(cells: DataFrame, policies: DataFrame, columns: Mapping[str, str] | None = None, bucket: float = 0.05) -> DataFrame:
    """grid_sequence and hats: the products over policies (rings and percentages) whose polygon holds a cell's centre, else 1.

    ``columns``: hats by the percentages they come of; a null percentage changes nothing. Centres and polygons meet in the
    cells of a raster.
    """
    columns = columns or {"pct": "hat"}
    keyed = policies.select(F.col("rings").alias("policy"), *columns, F.explode(spatial._cells(spatial.bounds_of(F.col("rings")), bucket)).alias("cell"))
    centres = cells.select("grid_sequence", "lon", "lat", F.struct(F.floor(F.col("lon") / bucket).alias("i"), F.floor(F.col("lat") / bucket).alias("j")).alias("cell"))
    inside = centres.join(keyed, "cell").where(C.point_in_polygon(F.col("lon"), F.col("lat"), F.col("policy")))
    found = inside.groupBy("grid_sequence").agg(*[F.product(1 + F.coalesce(F.col(pct), F.lit(0.0)) / 100).alias(hat) for pct, hat in columns.items()])
    return cells.select("grid_sequence").join(found, "grid_sequence", "left").select("grid_sequence", *[F.coalesce(hat, F.lit(1.0)).alias(hat) for hat in columns.values()])
