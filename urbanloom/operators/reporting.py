"""Local and aggregate result tables, map classes and network overlays."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanloom.functions import columns as C
from urbanloom.lineage import cut
from urbanloom.operators import economy, spatial
from urbanloom.plans.parameters import Parameters


def state_frame(spark: SparkSession, ids: Sequence[str], solution: economy.Solution | economy.Inversion) -> DataFrame:
    """loc_idx, location_id and the thirteen named columns of a state."""
    data = {"loc_idx": np.arange(len(ids), dtype=np.int64), "location_id": list(ids)} | {c: np.asarray(solution.state[c], float) for c in economy.STATE_COLUMNS}
    return spark.createDataFrame(pd.DataFrame(data))


def local_outcomes(spark: SparkSession, ids: Sequence[str], p: Parameters, before: economy.Solution, after: economy.Solution) -> DataFrame:
    """Twenty-two columns: the id, and seven outcomes before, after and in percent."""
    data: dict[str, object] = {"location_id": list(ids)}
    pairs = {name: (before.state[key], after.state[key]) for name, key in economy.OUTCOMES.items()} | {"annual_land_rent": (economy.land_rent(p, before), economy.land_rent(p, after))}
    for name, (a, b) in pairs.items():
        data[f"{name}_baseline"], data[f"{name}_counterfactual"] = np.asarray(a, float), np.asarray(b, float)
    frame = spark.createDataFrame(pd.DataFrame(data))
    columns = [F.col("location_id")]
    for name in pairs:
        columns += [F.col(f"{name}_baseline"), F.col(f"{name}_counterfactual"), C.percent_change(F.col(f"{name}_counterfactual"), F.col(f"{name}_baseline")).alias(f"{name}_pct")]
    return frame.select(*columns)


def aggregate_frame(spark: SparkSession, rows: Sequence[dict]) -> DataFrame:
    order = [f.split()[0] for f in economy.AGGREGATE_SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r[c] for c in order) for r in rows], economy.AGGREGATE_SCHEMA)


def snapped_aggregate(frame: DataFrame) -> DataFrame:
    """Percentages within 1e-10 of 0 become 0."""
    return frame.select(*[C.near_zero_snapped(F.col(c)).alias(c) if c.endswith("Pct") else F.col(c) for c in frame.columns])


def welfare_frame(spark: SparkSession, solution: economy.Solution) -> DataFrame:
    return spark.createDataFrame(pd.DataFrame([solution.welfare]))


def welfare_long(wide: DataFrame) -> DataFrame:
    """component, log_change, pct: four rows."""
    parts = ("commuting", "productivity_wage", "amenity", "total")
    return wide.select(F.explode(F.array(*[F.struct(F.lit(k).alias("component"), F.col(f"{k}_log_change").alias("log_change"), F.col(f"{k}_pct").alias("pct")) for k in parts])).alias("r")).select("r.*")


def appraisal_measures(flows0: DataFrame, flows1: DataFrame, od0: DataFrame, od1: DataFrame) -> DataFrame:
    """t00, t01, t11: mean minutes of the flows before and after on the times before and after. Flows have share."""
    key = ["o_idx", "d_idx"]
    mean = lambda flows, od, name: flows.join(od, key).agg((F.sum(F.col("share") * F.col("minutes")) / F.sum("share")).alias(name))
    return mean(flows0, od0, "t00").crossJoin(mean(flows0, od1, "t01")).crossJoin(mean(flows1, od1, "t11"))


def appraisal_measures_of(pairs: DataFrame) -> DataFrame:
    """The same of pairs that have both flows (share0, share1) and both times (m0, m1) side by side."""
    mean = lambda share, minutes: F.sum(F.col(share) * F.col(minutes)) / F.sum(share)
    return pairs.agg(mean("share0", "m0").alias("t00"), mean("share0", "m1").alias("t01"), mean("share1", "m1").alias("t11"))


def symmetric_thresholds(frame: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """q1, q2, q3 of the absolute values over 1e-12: quartiles, or 0.5, 1 and 2 medians where these do not rise."""
    size = F.abs(F.col(column))
    valid = frame.where(F.col(column).isNotNull() & ~F.isnan(column) & (size < float("inf")) & (size > 1e-12)).select(*by, size.alias("size"))
    found = valid.groupBy(*by).agg(F.percentile("size", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    q = [F.col("q")[k] for k in range(3)]
    rising = (q[1] - q[0] > 1e-12) & (q[2] - q[1] > 1e-12)
    return found.select(*by, *[F.when(rising, q[k]).otherwise(q[1] * factor).alias(f"q{k + 1}") for k, factor in enumerate((0.5, 1.0, 2.0))])


def map_class(value: Column, q1: Column, q2: Column, q3: Column) -> Column:
    """0 to 6, 3 in the middle; null stays null; without thresholds every value is in 3."""
    finite = value.isNotNull() & ~F.isnan(value)
    return F.when(
        finite,
        F.when(q1.isNull(), 3).when(value >= q3, 6).when(value >= q2, 5).when(value > q1, 4).when(value <= -q3, 0).when(value <= -q2, 1).when(value < -q1, 2).otherwise(3),
    ).cast("int")


def class_labels(q1: float | None, q2: float | None = None, q3: float | None = None) -> list[str]:
    if q1 is None:
        return ["No change"]
    s = C.significant3
    return [f"≤ {s(-q3)}", f"{s(-q3)} to {s(-q2)}", f"{s(-q2)} to {s(-q1)}", f"{s(-q1)} to {s(q1)}", f"{s(q1)} to {s(q2)}", f"{s(q2)} to {s(q3)}", f"≥ {s(q3)}"]


def pooled_classes(local: DataFrame, outcomes: Sequence[str]) -> DataFrame:
    """location_id, Closure, outcome, pct, class: thresholds of each outcome are pooled over the closures."""
    long = local.select("location_id", "Closure", F.explode(F.array(*[F.struct(F.lit(o).alias("outcome"), F.col(f"{o}_pct").alias("pct")) for o in outcomes])).alias("r")).select("location_id", "Closure", "r.*")
    limits = symmetric_thresholds(long, "pct", ["outcome"])
    joined = long.join(F.broadcast(limits), "outcome", "left")  # one row an outcome
    return joined.select("location_id", "Closure", "outcome", "pct", map_class(F.col("pct"), F.col("q1"), F.col("q2"), F.col("q3")).alias("class"))


def price_outcomes(local: DataFrame) -> list[str]:
    """The outcomes to map: residential and commercial rent count as one where their changes coincide everywhere."""
    a, b = F.col("rent_residential_pct"), F.col("rent_commercial_pct")
    close = F.abs(a - b) <= 1e-8 + 1e-10 * F.abs(b)
    both_nan = F.isnan(a) & F.isnan(b)
    same = local.agg(F.every(close | both_nan).alias("same")).first().same
    base = ["employment", "population", "wage", "output", "annual_land_rent"]
    return base + (["rent"] if same else ["rent_residential", "rent_commercial"])


def with_mean_rent(local: DataFrame) -> DataFrame:
    return local.withColumn("rent_pct", (F.col("rent_residential_pct") + F.col("rent_commercial_pct")) / 2)


def floor_rank_percentiles(frame: DataFrame, column: str, shares: Sequence[float] = (0.025, 0.975)) -> DataFrame:
    """Percentiles by floor rank (no interpolation): the value at floor(share * (n - 1)) of the sorted values; null if there are none.

    Values are sorted over ranges; the driver gets the ranges' sizes only, and each rank is then a place in one range.
    """
    value = F.col(column)
    # A generated id is the range's number in the upper bits and the place in it in the lower 33.
    ranked = cut(frame.where(value.isNotNull() & ~F.isnan(value)).select(value.alias("v")).sort("v").withColumn("place", F.monotonically_increasing_id()))
    sizes = ranked.groupBy(F.shiftright("place", 33).alias("part")).count().orderBy("part").collect()
    total = sum(r["count"] for r in sizes)

    def place(share: float) -> int:
        rest = math.floor(share * (total - 1))
        for r in sizes:
            if rest < r["count"]:
                return (r.part << 33) + rest
            rest -= r["count"]
        return -1

    return ranked.agg(*[F.max(F.when(F.col("place") == place(s), F.col("v"))).alias(f"p{k}") for k, s in enumerate(shares)])


def shock_percent(hats: DataFrame) -> DataFrame:
    """loc_idx, primitive, pct: 100 (hat - 1), long."""
    return hats.select("loc_idx", F.explode(F.array(*[F.struct(F.lit(h).alias("primitive"), C.hat_percent(F.col(h)).alias("pct")) for h in spatial.HATS])).alias("r")).select("loc_idx", "r.*")


def console_names(frame: DataFrame) -> DataFrame:
    """The aggregate table with one label for specification and closure."""
    short = F.when(F.col("Specification") == "with_spillovers", "spill").otherwise("nospill")
    closure = F.when(F.col("Closure") == "fixed_distribution", "fixed").otherwise(F.col("Closure"))
    return frame.withColumn("label", F.concat_ws("_", short, closure)).drop("Specification", "Closure")


# Network overlays: the parts of one network's lines farther than a tolerance from the other's.


def _uncovered(p: np.ndarray, q: np.ndarray, other: np.ndarray, tolerance: float) -> list[tuple[float, float]]:
    """Stretches [t0, t1] of the segment pq farther than the tolerance from all segments of ``other`` (x0 y0 x1 y1)."""
    d = q - p
    length = float(np.hypot(*d))
    covered: list[tuple[float, float]] = []
    for x0, y0, x1, y1 in other:
        a, b = np.array([x0, y0]), np.array([x1, y1])
        near: list[float] = []
        for centre in (a, b):  # within the discs at the ends
            f = p - centre
            half, rest = float(f @ d) / (length * length), (float(f @ f) - tolerance * tolerance) / (length * length)
            if (disc := half * half - rest) >= 0:
                near.append(-half - disc**0.5)
                near.append(-half + disc**0.5)
                covered.append((near[-2], near[-1]))
        v = b - a
        size = float(np.hypot(*v))
        if size == 0:
            continue
        u, n = v / size, np.array([-v[1], v[0]]) / size
        lo, hi = 0.0, 1.0
        for start, slope, low, high in ((float((p - a) @ u), float(d @ u), 0.0, size), (float((p - a) @ n), float(d @ n), -tolerance, tolerance)):
            if abs(slope) < 1e-15:
                if not low <= start <= high:
                    lo, hi = 1.0, 0.0
                continue
            t0, t1 = sorted(((low - start) / slope, (high - start) / slope))
            lo, hi = max(lo, t0), min(hi, t1)
        if lo < hi:
            covered.append((lo, hi))
    free, at = [], 0.0
    for lo, hi in sorted((max(0.0, a), min(1.0, b)) for a, b in covered):
        if hi <= lo:
            continue
        if lo > at:
            free.append((at, lo))
        at = max(at, hi)
    if at < 1:
        free.append((at, 1.0))
    return [(a, b) for a, b in free if (b - a) * length > 1e-9]


def link_differences(segs: DataFrame, other: DataFrame, tolerance: float = 1.0, bucket: float = 1000.0) -> DataFrame:
    """line_id, x0, y0, x1, y1, length: what of ``segs`` is farther than the tolerance from ``other``. Buckets bound the pairs."""
    rings = lambda grow: F.struct((F.least("x0", "x1") - grow).alias("x0"), (F.least("y0", "y1") - grow).alias("y0"), (F.greatest("x0", "x1") + grow).alias("x1"), (F.greatest("y0", "y1") + grow).alias("y1"))
    left = segs.withColumn("key", F.monotonically_increasing_id())
    mine = left.select("key", F.explode(spatial._cells(rings(0.0), bucket)).alias("cell"))
    theirs = other.select(F.array("x0", "y0", "x1", "y1").alias("segment"), F.explode(spatial._cells(rings(tolerance), bucket)).alias("cell"))
    near = mine.join(theirs, "cell").groupBy("key").agg(F.collect_set("segment").alias("near"))

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.itertuples():
                p, q = np.array([r.x0, r.y0]), np.array([r.x1, r.y1])
                around = np.array([list(s) for s in r.near], float).reshape(-1, 4) if r.near is not None else np.empty((0, 4))
                if not (p == q).all():
                    out += [(r.line_id, *(p + a * (q - p)), *(p + b * (q - p)), (b - a) * float(np.hypot(*(q - p)))) for a, b in _uncovered(p, q, around, tolerance)]
            yield pd.DataFrame(out, columns=["line_id", "x0", "y0", "x1", "y1", "length"]).astype({"line_id": "int64"})

    return left.join(near, "key", "left").select("line_id", "x0", "y0", "x1", "y1", "near").mapInPandas(run, "line_id long, x0 double, y0 double, x1 double, y1 double, length double")


def overlay_layers(baseline: DataFrame | None, counterfactual: DataFrame | None) -> tuple[DataFrame | None, DataFrame | None, DataFrame | None]:
    """(existing, added, removed): a missing counterfactual inherits the baseline; a missing baseline makes all of it added."""
    if counterfactual is None:
        return baseline, None, None
    if baseline is None:
        return None, counterfactual, None
    return baseline, link_differences(counterfactual, baseline), link_differences(baseline, counterfactual)
