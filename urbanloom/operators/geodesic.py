"""Lines and points in degrees on a sphere: lengths, places along lines, nearest places, and the interactive variant's routing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from urbanloom.functions import columns as C
from urbanloom.lineage import cut
from urbanloom.operators import networks, paths, routing, spatial

RADIUS_KM = C.EARTH_RADIUS_KM
#: Decimal places of degrees at which two places of a network are one node.
NODE_DIGITS = 7
#: Kilometres below which an edge is none.
LEAST_EDGE = 1e-10
KM_PER_DEGREE_LAT = RADIUS_KM * math.pi / 180


def _unit(lon: Column, lat: Column) -> tuple[Column, Column, Column]:
    lam, phi = F.radians(lon), F.radians(lat)
    return F.cos(phi) * F.cos(lam), F.cos(phi) * F.sin(lam), F.sin(phi)


def _cross(a, b):
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def _dot(a, b) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def nearest_on_segment(lon: Column, lat: Column, lon0: Column, lat0: Column, lon1: Column, lat1: Column) -> Column:
    """The place of a segment (the shorter great-circle arc between its ends) that is nearest to a point: lon, lat.

    The point goes to the arc's plane along the plane's normal; where that falls outside the arc, the nearer end counts.
    """
    p, a, b = _unit(lon, lat), _unit(lon0, lat0), _unit(lon1, lat1)
    n = _cross(a, b)
    length2 = _dot(n, n)
    off = _dot(p, n) / F.when(length2 > 0, length2)
    foot = tuple(x - off * y for x, y in zip(p, n, strict=True))
    inside = (length2 > 1e-30) & (_dot(_cross(a, foot), n) > 0) & (_dot(_cross(foot, b), n) > 0)
    nearer = C.haversine_km(lon, lat, lon0, lat0) <= C.haversine_km(lon, lat, lon1, lat1)
    end = F.when(nearer, F.struct(lon0.alias("lon"), lat0.alias("lat"))).otherwise(F.struct(lon1.alias("lon"), lat1.alias("lat")))
    at = F.struct(F.degrees(F.atan2(foot[1], foot[0])).alias("lon"), F.degrees(F.atan2(foot[2], F.hypot(foot[0], foot[1]))).alias("lat"))
    return F.when(inside, at).otherwise(end)


def polygon_area_km2(rings: Column) -> Column:
    """Square kilometres of a polygon in degrees on the sphere: half the sum of each vertex' sine of latitude times the
    longitudes from the vertex before to the one after; shells less holes."""

    def ring_area(ring: Column) -> Column:
        around = lambda k, step: F.get(ring, (k + step) % F.size(ring))["x"]
        terms = F.transform(ring, lambda p, k: F.radians(around(k, F.lit(1)) - around(k, F.size(ring) - 1)) * F.sin(F.radians(p["y"])))
        return F.abs(F.aggregate(terms, F.lit(0.0), lambda total, x: total + x)) * (RADIUS_KM**2 / 2)

    signed = F.zip_with(rings, C.ring_signs(rings), lambda ring, sign: sign * ring_area(ring))
    return F.aggregate(signed, F.lit(0.0), lambda total, x: total + x)


def measured(segs: DataFrame) -> DataFrame:
    """Segments in degrees with km, their length, and before, the length of their line up to them."""
    km = C.haversine_km(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    upto = W.partitionBy("line_id").orderBy("seg").rowsBetween(W.unboundedPreceding, -1)
    return segs.withColumn("km", km).withColumn("before", F.coalesce(F.sum("km").over(upto), F.lit(0.0)))


def along(segs: DataFrame, places: DataFrame) -> DataFrame:
    """``places`` (line_id, location in km) with lon, lat: so far along their line; before its start and beyond its end, the ends."""
    lines = measured(segs).withColumn("total", F.sum("km").over(W.partitionBy("line_id")))
    met = places.join(lines, "line_id").withColumn("at", F.least(F.greatest(F.col("location"), F.lit(0.0)), F.col("total")))
    on = met.where((F.col("at") >= F.col("before")) & (F.col("at") <= F.col("before") + F.col("km")))
    one = on.withColumn("first", F.row_number().over(W.partitionBy(*[F.col(c) for c in places.columns]).orderBy("seg"))).where("first = 1")
    a, b = _unit(F.col("x0"), F.col("y0")), _unit(F.col("x1"), F.col("y1"))
    angle, part = F.col("km") / RADIUS_KM, (F.col("at") - F.col("before")) / RADIUS_KM
    weights = F.sin(angle - part), F.sin(part)
    v = tuple(weights[0] * x + weights[1] * y for x, y in zip(a, b, strict=True))
    still = F.col("km") == 0
    lon, lat = F.degrees(F.atan2(v[1], v[0])), F.degrees(F.atan2(v[2], F.hypot(v[0], v[1])))
    return one.select(*places.columns, F.when(still, F.col("x0")).otherwise(lon).alias("lon"), F.when(still, F.col("y0")).otherwise(lat).alias("lat"))


def nearest_on_lines(points: DataFrame, segs: DataFrame) -> DataFrame:
    """point_id, line_id, location (km along the line), lon, lat, km: the nearest place on any line. ``points``: point_id, x, y in degrees.

    The segment is chosen on the local plane by raster rounds, the place on it on the sphere.
    """
    middle = segs.agg(F.avg((F.col("y0") + F.col("y1")) / 2)).first()[0] or 0.0
    kx, ky = KM_PER_DEGREE_LAT * math.cos(math.radians(middle)), KM_PER_DEGREE_LAT
    lines = measured(segs).withColumn("piece", F.struct("line_id", "seg"))
    flat = lines.select(F.col("piece").alias("line_id"), *[(F.col(c) * (kx if c[0] == "x" else ky)).alias(c) for c in ("x0", "y0", "x1", "y1")])
    chosen = spatial.nearest_line(points.select("point_id", (F.col("x") * kx).alias("x"), (F.col("y") * ky).alias("y")), flat).select("point_id", F.col("line_id").alias("piece"))
    met = points.select("point_id", "x", "y").join(chosen, "point_id").join(lines, "piece").withColumn("at", nearest_on_segment(F.col("x"), F.col("y"), F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")))
    location = F.col("before") + F.least(C.haversine_km(F.col("x0"), F.col("y0"), F.col("at.lon"), F.col("at.lat")), F.col("km"))
    return met.select("point_id", "line_id", location.alias("location"), "at.lon", "at.lat", C.haversine_km(F.col("x"), F.col("y"), F.col("at.lon"), F.col("at.lat")).alias("km"))


def _node(lon: Column, lat: Column) -> Column:
    fixed = lambda v: F.format_string(f"%.{NODE_DIGITS}f", v + 0.0)
    return F.concat(F.lit("n:"), fixed(lon), F.lit(","), fixed(lat))


def network_edges(segs: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(src, dst, km along lines between their breakpoints; point_id, node of the entries).

    Breakpoints are ends, crossings and ``entries`` (point_id, line_id, location, lon, lat). Crossings are those of the lines
    in the plane of degrees; a line's own crossings do not count.
    """
    lines = cut(measured(segs))
    place = lambda location, lon, lat, rank, entry=None: (location.alias("location"), lon.alias("x"), lat.alias("y"), F.lit(rank).alias("rank"), (entry if entry is not None else F.lit(None).cast("long")).alias("point_id"))
    first = lines.select("line_id", F.struct("seg", F.lit(0.0).alias("location"), F.col("x0").alias("lon"), F.col("y0").alias("lat")).alias("e"))
    last = lines.select("line_id", F.struct("seg", (F.col("before") + F.col("km")).alias("location"), F.col("x1").alias("lon"), F.col("y1").alias("lat")).alias("e"))
    ends = first.groupBy("line_id").agg(F.min("e").alias("e")).unionByName(last.groupBy("line_id").agg(F.max("e").alias("e"))).select("line_id", *place(F.col("e.location"), F.col("e.lon"), F.col("e.lat"), 1))
    at = networks.crossings(segs.select("line_id", "seg", "x0", "y0", "x1", "y1"), between_lines=True).join(lines, ["line_id", "seg"])
    on = nearest_on_segment(F.col("x"), F.col("y"), F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    upto = F.col("before") + C.haversine_km(F.col("x0"), F.col("y0"), F.col("on.lon"), F.col("on.lat"))
    crossed = at.withColumn("on", on).select("line_id", *place(upto, F.col("x"), F.col("y"), 0))
    entered = entries.select("line_id", *place(F.col("location"), F.col("lon"), F.col("lat"), 2, F.col("point_id")))
    stops = cut(networks.breakpoints(ends.unionByName(crossed).unionByName(entered)).withColumn("node", _node(F.col("at.x"), F.col("at.y"))))
    row = stops.groupBy("line_id", "stop", "node").agg(F.min("location").alias("location"))
    on_line = W.partitionBy("line_id").orderBy("stop")
    pairs = row.select(F.col("node").alias("src"), F.lead("node").over(on_line).alias("dst"), (F.lead("location").over(on_line) - F.col("location")).alias("km"))
    return pairs.where(F.col("dst").isNotNull() & (F.col("src") != F.col("dst")) & (F.col("km") > LEAST_EDGE)), stops.where("point_id is not null").select("point_id", "node")


def network_times(points: DataFrame, segs: DataFrame | None, stations: DataFrame | None, off_kmh: float, on_kmh: float) -> DataFrame:
    """o_idx, d_idx, minutes: the least of the direct way and one over the network, entered at stations or, with none, at
    each location's nearest place on it. ``points``: loc_idx, x, y; ``stations``: station, x, y; all in degrees.

    A location's own direct time is 1 minute, which a shorter way to the network and back beats.
    """
    off, on = C.metres_per_minute(off_kmh) / 1000, C.metres_per_minute(on_kmh) / 1000
    if segs is None or segs.isEmpty():
        return routing.station_minutes(points, None, None, off_kmh, sphere=True, own_minutes=1.0)
    by_station = stations is not None and not stations.isEmpty()
    enter = stations.select(F.col("station").alias("point_id"), "x", "y") if by_station else points.select(F.col("loc_idx").alias("point_id"), "x", "y")
    entries = cut(nearest_on_lines(enter, segs))
    edges, nodes = network_edges(segs, entries)
    own = nodes.join(entries, "point_id").select(F.concat(F.lit("p:"), F.col("point_id").cast("string")).alias("src"), F.col("node").alias("dst"), F.lit(0.0).alias("minutes") if by_station else (F.col("km") / off).alias("minutes"))
    found = paths.shortest_paths(edges.select("src", "dst", (F.col("km") / on).alias("minutes")).unionByName(own), enter.withColumnRenamed("point_id", "loc_idx"))
    if by_station:
        places = entries.select(F.col("point_id").alias("station"), F.col("lon").alias("x"), F.col("lat").alias("y"))
        return routing.station_minutes(points, places, found.select(F.col("o_idx").alias("s"), F.col("d_idx").alias("t"), "minutes"), off_kmh, sphere=True, own_minutes=1.0)
    there = lambda side, idx: points.select(F.col("loc_idx").alias(idx), F.col("x").alias(f"{side}x"), F.col("y").alias(f"{side}y"))
    back = entries.select(F.col("point_id").alias("o_idx"), (2 * F.col("km") / off).alias("there_and_back"))
    pairs = found.join(there("o", "o_idx").join(back, "o_idx"), "o_idx").join(there("d", "d_idx"), "d_idx")
    same = F.col("o_idx") == F.col("d_idx")
    direct = F.when(same, 1.0).otherwise(C.haversine_km(F.col("ox"), F.col("oy"), F.col("dx"), F.col("dy")) / off)
    return pairs.select("o_idx", "d_idx", F.least(direct, F.when(same, F.col("there_and_back")).otherwise(F.col("minutes"))).alias("minutes"))


def composed_times(points: DataFrame, baseline: routing.Network | None, drawn: routing.Network | None, off_kmh: float, on_kmh: float) -> tuple[DataFrame, DataFrame]:
    """(baseline, counterfactual) times: the counterfactual's network is the baseline's with the drawn lines and stations added.

    Ids of drawn lines and stations follow those of the baseline.
    """
    before = network_times(points, baseline.segs if baseline else None, baseline.stations if baseline else None, off_kmh, on_kmh)
    if drawn is None:
        return before, before
    if baseline is None:
        return before, network_times(points, drawn.segs, drawn.stations, off_kmh, on_kmh)
    after = {}
    for frame, key in (("segs", "line_id"), ("stations", "station")):
        old, new = getattr(baseline, frame), getattr(drawn, frame)
        most = old.agg(F.max(key)).first()[0]
        after[frame] = old.unionByName(new.withColumn(key, F.col(key) + F.lit(0 if most is None else most + 1)))
    return before, network_times(points, after["segs"], after["stations"], off_kmh, on_kmh)
