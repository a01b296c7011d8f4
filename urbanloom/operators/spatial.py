"""Grids, area interpolation, shocks, nearest neighbours and components."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from urbanloom.errors import GridInputError, ScenarioInputError
from urbanloom.functions import columns as C
from urbanloom.lineage import cut, numbered
from urbanloom.operators import geometry

RINGS = "array<array<struct<x:double,y:double>>>"


def square_grid(spark: SparkSession, bounds: tuple[float, float, float, float], centre: tuple[float, float], side: float) -> DataFrame:
    """grid_sequence from 1, row by row from the top left; x0, y0, x1, y1 and rings."""
    x_min, y_min, x_max, y_max = bounds
    n_cols, n_rows = int((x_max - x_min) // side + 1), int((y_max - y_min) // side + 1)
    left, top = centre[0] - n_cols * side / 2, centre[1] + n_rows * side / 2
    col, row = F.col("id") % n_cols, F.floor(F.col("id") / n_cols)
    x0, y1 = F.lit(left) + col * side, F.lit(top) - row * side
    cells = spark.range(n_cols * n_rows).select((F.col("id") + 1).alias("grid_sequence"), x0.alias("x0"), (y1 - side).alias("y0"), (x0 + side).alias("x1"), y1.alias("y1"))
    return cells.withColumn("rings", F.array(C.box_ring(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))))


def hexagon_grid(spark: SparkSession, bounds: tuple[float, float, float, float], centre: tuple[float, float], size: float) -> DataFrame:
    """Pointy-topped hexagons of the area of a square of ``size``, laid out about ``centre``, row by row from the top left; grid_sequence, x, y (centres) and rings."""
    x_min, y_min, x_max, y_max = bounds
    side = math.sqrt(2 * size * size / (3 * math.sqrt(3)))
    dx, dy = math.sqrt(3) * side, 1.5 * side
    n_cols, n_rows = math.ceil((x_max - x_min) / dx) + 3, math.ceil((y_max - y_min) / dy) + 3
    row, col = F.floor(F.col("id") / n_cols), F.col("id") % n_cols
    x = F.lit(centre[0] - (n_cols - 1) * dx / 2) + col * dx + (row % 2) * (dx / 2)
    y = F.lit(centre[1] + (n_rows - 1) * dy / 2) - row * dy
    centres = spark.range(n_cols * n_rows).select((F.col("id") + 1).alias("grid_sequence"), x.alias("x"), y.alias("y"))
    corner = lambda k: F.struct((F.col("x") + side * math.cos(math.radians(30 + 60 * k))).alias("x"), (F.col("y") + side * math.sin(math.radians(30 + 60 * k))).alias("y"))
    return centres.withColumn("rings", F.array(F.array(*[corner(k) for k in range(6)])))


def original_grid(source: DataFrame, id_col: str | None = None) -> DataFrame:
    """Every source polygon is a cell; ids come from a unique column or from the order."""
    cells = numbered(source, ["source_id"], "grid_sequence", 1)
    if id_col is None:
        return cells.withColumn("location_id", F.col("grid_sequence").cast("string"))
    named = cells.withColumn("location_id", C.canonical_id(F.col(id_col)))
    if named.groupBy("location_id").count().where("count > 1").limit(1).count():
        raise GridInputError(f"{id_col} is not unique")
    return named


def bounds_of(rings: Column) -> Column:
    points = F.flatten(rings)
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        areas = geometry.shared_areas(batch.column(2).to_pylist(), batch.column(3).to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(areas)], ["source_id", "target_id", "overlap"])


def _cells(box: Column, size: float) -> Column:
    across = F.sequence(F.floor(box["x0"] / size), F.floor(box["x1"] / size))
    up = F.sequence(F.floor(box["y0"] / size), F.floor(box["y1"] / size))
    return F.flatten(F.transform(across, lambda i: F.transform(up, lambda j: F.struct(i.alias("i"), j.alias("j")))))


def polygon_overlaps(source: DataFrame, target: DataFrame, bucket: float, exact_boxes: bool = False) -> DataFrame:
    """source_id, target_id, overlap > 0. Buckets of a raster meet by equality; bounding boxes then areas refine.

    ``exact_boxes`` says that both sides are axis-aligned boxes, whose overlap is an expression and needs no Python.
    """
    side = lambda frame, name: frame.select(F.col(f"{name}_id"), F.col("rings").alias(f"{name}_rings"), bounds_of(F.col("rings")).alias(f"{name}_box"))
    left = side(source, "source").withColumn("cell", F.explode(_cells(F.col("source_box"), bucket)))
    right = side(target, "target").withColumn("cell", F.explode(_cells(F.col("target_box"), bucket)))
    a, b = F.col("source_box"), F.col("target_box")
    touching = (a["x0"] < b["x1"]) & (b["x0"] < a["x1"]) & (a["y0"] < b["y1"]) & (b["y0"] < a["y1"])
    # A pair that shares several buckets is kept in the one with its overlap's lower left corner.
    home = (F.floor(F.greatest(a["x0"], b["x0"]) / bucket) == F.col("cell.i")) & (F.floor(F.greatest(a["y0"], b["y0"]) / bucket) == F.col("cell.j"))
    pairs = left.join(right, "cell").where(touching & home)
    if exact_boxes:
        shared = C.box_overlap((a["x0"], a["y0"], a["x1"], a["y1"]), (b["x0"], b["y0"], b["x1"], b["y1"]))
        found = pairs.select("source_id", "target_id", shared.alias("overlap"))
    else:
        found = pairs.select("source_id", "target_id", "source_rings", "target_rings").mapInArrow(_overlaps, "source_id long, target_id long, overlap double")
    return found.where("overlap > 0")


def overlap_counts(source: DataFrame, target: DataFrame, bucket: float = 1000.0, exact_boxes: bool = False) -> DataFrame:
    """One row: candidate_pairs, whose bounding boxes meet or touch, and positive_pairs, which share area."""
    side = lambda frame, name: frame.select(bounds_of(F.col("rings")).alias(name))
    a, b = F.col("a"), F.col("b")
    # A pair is counted in the cell with the lower left corner of what its boxes share.
    home = (F.floor(F.greatest(a["x0"], b["x0"]) / bucket) == F.col("cell.i")) & (F.floor(F.greatest(a["y0"], b["y0"]) / bucket) == F.col("cell.j"))
    touching = (a["x0"] <= b["x1"]) & (b["x0"] <= a["x1"]) & (a["y0"] <= b["y1"]) & (b["y0"] <= a["y1"])
    met = side(source, "a").withColumn("cell", F.explode(_cells(a, bucket))).join(side(target, "b").withColumn("cell", F.explode(_cells(b, bucket))), "cell").where(home & touching)
    shared = polygon_overlaps(source, target, bucket, exact_boxes).agg(F.count(F.lit(1)).alias("positive_pairs"))
    return met.agg(F.count(F.lit(1)).alias("candidate_pairs")).crossJoin(F.broadcast(shared))  # a row each


def area_interpolate(
    source: DataFrame, target: DataFrame, extensive: Sequence[str], intensive: Sequence[str] = (), bucket: float = 1000.0, exact_boxes: bool = False
) -> DataFrame:
    """target_id and the columns: extensive ones allocated by the source's share, intensive ones averaged by overlap.

    Null extensive values count as 0; null intensive ones stay out of the average. Cells without overlap get 0 and NaN.
    """
    missing = [c for c in (*extensive, *intensive) if c not in source.columns]
    if missing:
        raise GridInputError(f"source has no column {', '.join(missing)}")
    sized = source.withColumn("source_area", C.polygon_area(F.col("rings")))
    if sized.where("source_area <= 0").limit(1).count():
        raise GridInputError("source polygons without area")
    columns = list(dict.fromkeys((*extensive, *intensive)))
    values = sized.select("source_id", "source_area", *[F.col(c).cast("double").alias(c) for c in columns])
    joined = polygon_overlaps(source, target, bucket, exact_boxes).join(values, "source_id")
    sums = [F.sum(F.coalesce(F.col(c), F.lit(0.0)) * F.col("overlap") / F.col("source_area")).alias(c) for c in extensive]
    weight = lambda c: F.sum(F.when(F.col(c).isNotNull(), F.col("overlap")))
    sums += [(F.sum(F.col(c) * F.col("overlap")) / weight(c)).alias(c) for c in intensive]
    found = joined.groupBy("target_id").agg(*sums, F.sum("overlap").alias("covered"))
    out = target.select("target_id").join(found, "target_id", "left")
    return out.select("target_id", *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in extensive], *[F.coalesce(F.col(c), F.lit(float("nan"))).alias(c) for c in intensive])


def allocation_report(source: DataFrame, allocated: DataFrame, extensive: Sequence[str]) -> DataFrame:
    """variable, source_total, allocated_total, ratio."""
    reports = []
    for c in extensive:
        s, a = source.agg(F.sum(F.coalesce(F.col(c), F.lit(0.0))).alias("source_total")), allocated.agg(F.sum(c).alias("allocated_total"))
        reports.append(s.crossJoin(a).select(F.lit(c).alias("variable"), "*", F.when(F.col("source_total") != 0, F.col("allocated_total") / F.col("source_total")).alias("ratio")))
    out = reports[0]
    for r in reports[1:]:
        out = out.unionByName(r)
    return out


def positive_replaced(frame: DataFrame, column: str) -> DataFrame:
    """Negatives become 0, then zeros the smallest positive value."""
    value = F.greatest(F.coalesce(F.col(column).cast("double"), F.lit(0.0)), F.lit(0.0))
    least = frame.agg(F.min(F.when(value > 0, value)).alias("__least"))  # one row
    checked = F.when(F.col("__least").isNull(), F.raise_error(F.lit(f"no positive value of {column}"))).otherwise(F.col("__least"))
    return frame.crossJoin(F.broadcast(least)).withColumn(column, F.when(value > 0, value).otherwise(checked.cast("double"))).drop("__least")


def share_scaled(frame: DataFrame, column: str, total: float | Column) -> DataFrame:
    sums = frame.agg(F.sum(column).alias("__sum"))
    return frame.crossJoin(F.broadcast(sums)).withColumn(column, F.col(column) / F.col("__sum") * total).drop("__sum")


def employment_balanced(frame: DataFrame) -> DataFrame:
    """Add employment_model: employment_raw scaled to the total population."""
    sums = frame.agg(F.sum("population").alias("__p"), F.sum("employment_raw").alias("__e"))
    return frame.crossJoin(F.broadcast(sums)).withColumn("employment_model", F.col("employment_raw") * F.col("__p") / F.col("__e")).drop("__p", "__e")


def rent_normalized(frame: DataFrame, column: str, out: str = "rent_floor_space") -> DataFrame:
    """Positive-replaced and divided by its mean."""
    filled = positive_replaced(frame, column)
    mean = filled.agg(F.avg(column).alias("__mean"))
    return filled.crossJoin(F.broadcast(mean)).withColumn(out, F.col(column) / F.col("__mean")).drop("__mean")


def synthetic_rent(frame: DataFrame, elasticity: float = 0.25, spread: float = 0.1, seed: int = 1) -> DataFrame:
    """Rent from population and uniform draws of the seeded generator, divided by its mean; loc_idx gives the order."""
    n = frame.count()
    draws = np.random.default_rng(seed).uniform(1 - spread, 1 + spread, n)
    drawn = frame.sparkSession.createDataFrame(pd.DataFrame({"loc_idx": np.arange(n, dtype=np.int64), "__u": draws}))
    raw = frame.join(drawn, "loc_idx").withColumn("rent_floor_space", F.pow(F.col("population"), elasticity) * F.col("__u")).drop("__u")
    return rent_normalized(raw, "rent_floor_space")


def browser_rent(frame: DataFrame) -> DataFrame:
    """The interactive variant's rent: a power of relative population with a sine ripple."""
    mean = frame.agg(F.avg("population").alias("__m"))
    ripple = 1 + 0.1 * F.sin(12.9898 * (F.col("loc_idx") + 1))
    return frame.crossJoin(F.broadcast(mean)).withColumn("rent_floor_space", F.pow(F.greatest(F.col("population"), F.lit(1e-6)) / F.col("__m"), 0.25) * ripple).drop("__m")


def retained(frame: DataFrame, original: bool = False) -> DataFrame:
    """Cells with population, employment or developed land; all cells of an original geometry."""
    kept = frame if original else frame.where("population > 0 or employment_raw > 0 or coalesce(developed, 0) > 0")
    if not kept.limit(1).count():
        raise GridInputError("no cell has population, employment or developed land")
    return kept


HATS = ("productivity_hat", "amenity_hat", "structural_density_hat")


def policy_overlaps(policies: DataFrame, bucket: float, exact_boxes: bool = False, tolerance: float = 1e-8) -> DataFrame:
    """left_id, right_id, overlap: pairs of policy polygons that overlap by more than the tolerance."""
    a = policies.select(F.col("policy_id").alias("source_id"), "rings")
    b = policies.select(F.col("policy_id").alias("target_id"), "rings")
    found = polygon_overlaps(a, b, bucket, exact_boxes).where((F.col("source_id") < F.col("target_id")) & (F.col("overlap") > tolerance))
    return found.select(F.col("source_id").alias("left_id"), F.col("target_id").alias("right_id"), "overlap")


def shock_hats(policies: DataFrame, locations: DataFrame, bucket: float = 1000.0, exact_boxes: bool = False) -> DataFrame:
    """loc_idx, the three hats and coverage: 1 + sum of (hat - 1) * overlap / area; no overlap leaves 1."""
    given = [h for h in HATS if h in policies.columns]
    if not given:
        raise ScenarioInputError("policy polygons carry no hat")
    bad = F.lit(False)
    for h in given:
        bad = bad | F.col(h).isNull() | F.isnan(h) | (F.col(h) <= 0)
    if policies.where(bad).limit(1).count():
        raise ScenarioInputError("hats must be finite and positive")
    if policy_overlaps(policies, bucket, exact_boxes).limit(1).count():
        raise ScenarioInputError("policy polygons overlap")
    source = policies.select(F.col("policy_id").alias("source_id"), "rings", *given)
    target = locations.select(F.col("loc_idx").alias("target_id"), "rings")
    area = locations.select(F.col("loc_idx").alias("target_id"), C.polygon_area(F.col("rings")).alias("area"))
    joined = polygon_overlaps(source, target, bucket, exact_boxes).join(source.drop("rings"), "source_id").join(area, "target_id")
    share = F.col("overlap") / F.col("area")
    found = joined.groupBy("target_id").agg(F.sum(share).alias("coverage"), *[F.sum((F.col(h) - 1) * share).alias(h) for h in given])
    checked = F.when(F.col("coverage") > 1.000001, F.raise_error(F.lit("policy polygons cover a location more than once")).cast("double")).otherwise(F.least(F.coalesce("coverage", F.lit(0.0)), F.lit(1.0)))
    out = locations.select(F.col("loc_idx").alias("target_id")).join(found, "target_id", "left")
    hats = [(1 + F.coalesce(F.col(h), F.lit(0.0))).alias(h) if h in given else F.lit(1.0).alias(h) for h in HATS]
    return out.select(F.col("target_id").alias("loc_idx"), *hats, F.coalesce(checked, F.lit(0.0)).alias("coverage"))


def nearest(points: DataFrame, targets: DataFrame, k: int, cell: float, other_than_self: bool = False, max_rounds: int = 12) -> DataFrame:
    """point_id, target_id, distance, rank: the k nearest targets; ties go to the smaller target id.

    Points look at targets of their own and the eight adjoining cells of a raster. A point whose k-th find is no
    farther than a cell's side is settled; the others look again with cells twice as large. The first cells have at least
    the side ``cell``, and that at which as many as k targets would lie about a point if they were spread evenly.
    ``points`` has point_id, x, y, ``targets`` target_id, x, y.
    """
    both = targets.select("x", "y", F.lit(1).alias("n")).unionByName(points.select("x", "y", F.lit(0).alias("n")))
    spread = both.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), (F.max("x") - F.min("x")).alias("w"), (F.max("y") - F.min("y")).alias("h")).first()
    k = min(k, spread.n - int(other_than_self))
    even = math.sqrt(max(spread.w or 0.0, spread.h or 0.0, cell) * max(min(spread.w or 0.0, spread.h or 0.0), cell) * max(k, 1) / max(spread.n, 1)) / 1.5
    order = W.partitionBy("point_id").orderBy("distance", "target_id")
    left, settled, size = points, None, max(cell, even)
    for round_ in range(max_rounds):
        raster = lambda c: F.floor(F.col(c) / size).cast("long")  # noqa: E731,B023
        near = F.array(*[F.struct((raster("x") + i).alias("i"), (raster("y") + j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
        seek = left.select("point_id", F.col("x").alias("px"), F.col("y").alias("py"), F.explode(near).alias("cell"))
        there = targets.select("target_id", F.col("x").alias("tx"), F.col("y").alias("ty"), F.struct(raster("x").alias("i"), raster("y").alias("j")).alias("cell"))
        pairs = seek.join(there, "cell").withColumn("distance", C.distance(F.col("px"), F.col("py"), F.col("tx"), F.col("ty")))
        if other_than_self:
            pairs = pairs.where("point_id <> target_id")
        ranked = pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("point_id", F.struct("rank", "target_id", "distance").alias("found"))
        # A point's finds come as one array, k long at most, so that one table holds the settled points and those that look again.
        met = cut(left.join(ranked.groupBy("point_id").agg(F.sort_array(F.collect_list("found")).alias("found")), "point_id", "left"))
        done = F.coalesce((F.size("found") == k) & (F.element_at("found", -1)["distance"] <= size), F.lit(False))
        found = met.where(done).select("point_id", F.explode("found").alias("f")).select("point_id", "f.target_id", "f.distance", "f.rank")
        settled = found if settled is None else settled.unionByName(found)
        left = met.where(~done).select("point_id", "x", "y")
        if left.isEmpty():
            return settled
        size *= 2
    raise RuntimeError(f"nearest targets not settled in {max_rounds} rounds")


def walking_edges(points: DataFrame, k: int, cell: float) -> DataFrame:
    """a < b, distance: the union of everyone's k nearest others, each pair once."""
    found = nearest(points.select(F.col("loc_idx").alias("point_id"), "x", "y"), points.select(F.col("loc_idx").alias("target_id"), "x", "y"), k, cell, other_than_self=True)
    return found.select(F.least("point_id", "target_id").alias("a"), F.greatest("point_id", "target_id").alias("b"), "distance").distinct()


def within_radius(points: DataFrame, radius: float) -> DataFrame:
    """point_id, other_id: pairs of points within a radius, each point with itself too, by adjoining raster cells."""
    raster = lambda c: F.floor(F.col(c) / radius).cast("long")
    near = F.array(*[F.struct((raster("x") + i).alias("i"), (raster("y") + j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    seek = points.select("point_id", F.col("x").alias("px"), F.col("y").alias("py"), F.explode(near).alias("cell"))
    there = points.select(F.col("point_id").alias("other_id"), F.col("x").alias("ox"), F.col("y").alias("oy"), F.struct(raster("x").alias("i"), raster("y").alias("j")).alias("cell"))
    return seek.join(there, "cell").where(C.distance(F.col("px"), F.col("py"), F.col("ox"), F.col("oy")) <= radius).select("point_id", "other_id")


def nearest_line(points: DataFrame, segments: DataFrame, cell: float | None = None) -> DataFrame:
    """point_id, line_id, distance, px, py: the nearest point on the nearest segment; ties go to the smaller line id.

    Rounds as in nearest(): a point meets the segments whose boxes reach its own or the eight adjoining cells, and is settled by
    one no farther than a cell's side; cells double until they span everything. Points and segments without coordinates are left out.
    """
    numbers = lambda frame, names: frame.where(~F.isnan(sum((F.col(c) for c in names), F.lit(0.0)))).na.drop(subset=list(names))
    lines, left = numbers(segments.select("line_id", "x0", "y0", "x1", "y1"), ("x0", "y0", "x1", "y1")), numbers(points.select("point_id", "x", "y"), ("x", "y"))
    side = F.greatest(F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0")))
    ends = [(f(F.least(p, q)) if f is F.min else f(F.greatest(p, q))) for p, q in (("x0", "x1"), ("y0", "y1")) for f in (F.min, F.max)]
    box = lines.agg(F.count(F.lit(1)), F.avg(side), *ends).first()
    around = left.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    length2 = dx * dx + dy * dy
    t = F.when(length2 > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col("x") - F.col("x0")) * dx + (F.col("y") - F.col("y0")) * dy) / length2))).otherwise(0.0)

    def best(pairs: DataFrame) -> DataFrame:
        met = pairs.withColumn("t", t).withColumn("px", F.col("x0") + F.col("t") * dx).withColumn("py", F.col("y0") + F.col("t") * dy)
        far = met.withColumn("distance", C.distance(F.col("x"), F.col("y"), F.col("px"), F.col("py")))
        return far.groupBy("point_id").agg(F.min(F.struct("distance", "line_id", "px", "py")).alias("b")).select("point_id", "b.line_id", "b.distance", "b.px", "b.py")

    if not box[0] or around[0] is None:
        return best(left.join(lines, F.lit(False)))
    spread = max(max(box[3], around[1]) - min(box[2], around[0]), max(box[5], around[3]) - min(box[4], around[2]))
    size, settled = cell or max(box[1], spread / math.sqrt(box[0])) or 1.0, None
    while True:
        raster = lambda c: F.floor(F.col(c) / size).cast("long")  # noqa: E731,B023
        adjoining = _cells(F.struct(((raster("x") - 0.5) * size).alias("x0"), ((raster("y") - 0.5) * size).alias("y0"), ((raster("x") + 1.5) * size).alias("x1"), ((raster("y") + 1.5) * size).alias("y1")), size)
        reach = F.struct(F.least("x0", "x1").alias("x0"), F.least("y0", "y1").alias("y0"), F.greatest("x0", "x1").alias("x1"), F.greatest("y0", "y1").alias("y1"))
        found = cut(best(left.withColumn("cell", F.explode(adjoining)).join(lines.withColumn("cell", F.explode(_cells(reach, size))), "cell")).where(F.col("distance") <= size))
        settled = found if settled is None else settled.unionByName(found)
        left = cut(left.join(found, "point_id", "left_anti"))
        if left.isEmpty():
            return settled
        if size > 2 * spread:
            raise RuntimeError("nearest lines not settled")
        size *= 2


def components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """node, component (its smallest node): minima spread over edges, with labels followed to their own labels."""
    both = cut(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))))
    labels = nodes.select("node", F.col("node").alias("component"))
    for _ in range(max_rounds):
        offered = both.join(labels, both.v == labels.node).groupBy("u").agg(F.min("component").alias("offer"))
        lower = labels.join(offered, labels.node == offered.u, "left").select("node", F.least("component", F.coalesce("offer", "component")).alias("low"))
        jump = lower.select(F.col("node").alias("j"), F.col("low").alias("jumped"))
        fresh = lower.join(jump, F.col("low") == F.col("j")).select("node", F.least("low", "jumped").alias("component"))
        fresh = cut(fresh)
        changed = fresh.alias("f").join(labels.alias("l"), "node").where("f.component <> l.component").limit(1).count()
        labels = fresh
        if not changed:
            return labels
    raise RuntimeError(f"components not settled in {max_rounds} rounds")
