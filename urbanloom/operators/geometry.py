"""Polygons as arrays of rings: repair, orientation and shared areas, in NumPy on the rows of a batch.

A polygon's inside is where a ray crosses its rings an odd number of times, so rings may come in any order and
direction. Here shells run counter-clockwise and holes clockwise, and areas are sums of signed ring areas.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Vertices of subjects that are clipped at once.
CLIP_VALUES = 1 << 21
#: How far apart, in units of the polygon's extent, two vertices are the same.
SAME_VERTEX = 1e-12


def signed_area(ring: np.ndarray) -> float:
    x, y = (ring - ring[0]).T if len(ring) else (np.zeros(0), np.zeros(0))
    return float(np.dot(x, np.roll(y, -1)) - np.dot(np.roll(x, -1), y)) / 2


def opened(ring: Sequence) -> np.ndarray:
    """A ring's vertices without repeats one after the other and without the closing one."""
    points = np.array([(p["x"], p["y"]) for p in ring] if len(ring) and not isinstance(ring[0], tuple | list | np.ndarray) else ring, float).reshape(-1, 2)
    points = points[np.isfinite(points).all(axis=1)]
    return points[(points != np.roll(points, 1, axis=0)).any(axis=1)] if len(points) > 1 else points


def inside(points: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether points lie inside the edges a to b, by the even-odd rule."""
    out = np.zeros(len(points), bool)
    step = max(1, (1 << 22) // max(1, len(a)))
    for k in range(0, len(points), step):
        x, y = points[k : k + step, 0, None], points[k : k + step, 1, None]
        spans = (a[:, 1] > y) != (b[:, 1] > y)
        rise = np.where(b[:, 1] == a[:, 1], 1.0, b[:, 1] - a[:, 1])
        out[k : k + step] = (spans & (x < a[:, 0] + (y - a[:, 1]) * (b[:, 0] - a[:, 0]) / rise)).sum(axis=1) % 2 == 1
    return out


def oriented(rings: Sequence[np.ndarray]) -> list[np.ndarray]:
    """Rings that do not cross: those inside an even number of others counter-clockwise, the rest clockwise."""
    out = []
    for k, ring in enumerate(rings):
        others = [r for j, r in enumerate(rings) if j != k]
        middle = (ring[:1] + ring[1:2]) / 2
        depth = sum(bool(inside(middle, r, np.roll(r, -1, axis=0))[0]) for r in others)
        out.append(ring if (signed_area(ring) > 0) == (depth % 2 == 0) else ring[::-1])
    return out


def edge_cuts(a: np.ndarray, b: np.ndarray) -> dict[int, list[tuple[float, tuple[float, float]]]]:
    """Where edges a to b are cut by others: inside, by edge, as share and place. Edges are compared where their x meet."""
    low, high = np.minimum(a[:, 0], b[:, 0]), np.maximum(a[:, 0], b[:, 0])
    order = np.argsort(low, kind="stable")
    starts, cuts = low[order], defaultdict(list)
    for place, i in enumerate(order):
        others = order[place + 1 : np.searchsorted(starts, high[i], side="right")]
        if not len(others):
            continue
        others = others[(np.maximum(a[others, 1], b[others, 1]) >= min(a[i, 1], b[i, 1])) & (np.minimum(a[others, 1], b[others, 1]) <= max(a[i, 1], b[i, 1]))]
        d, e, f = b[i] - a[i], b[others] - a[others], a[others] - a[i]
        cross = d[0] * e[:, 1] - d[1] * e[:, 0]
        straight = np.abs(cross) <= SAME_VERTEX * np.hypot(*d) * np.hypot(e[:, 0], e[:, 1])
        safe = np.where(straight, 1.0, cross)
        t, u = (f[:, 0] * e[:, 1] - f[:, 1] * e[:, 0]) / safe, (f[:, 0] * d[1] - f[:, 1] * d[0]) / safe
        meets = ~straight & (t >= -SAME_VERTEX) & (t <= 1 + SAME_VERTEX) & (u >= -SAME_VERTEX) & (u <= 1 + SAME_VERTEX)
        for k in np.flatnonzero(meets):
            j = others[k]
            ends = [p for p in (a[i], b[i], a[j], b[j]) if np.hypot(*(p - (a[i] + t[k] * d))) <= SAME_VERTEX * max(1.0, np.abs(p).max())]
            at = tuple((ends[0] if ends else a[i] + t[k] * d).tolist())
            cuts[int(i)].append((float(t[k]), at))
            cuts[int(j)].append((float(u[k]), at))
        for k in np.flatnonzero(straight):
            j = others[k]
            for on, of in ((i, j), (j, i)):
                v = b[on] - a[on]
                for p in (a[of], b[of]):
                    w = p - a[on]
                    if abs(v[0] * w[1] - v[1] * w[0]) <= SAME_VERTEX * max(1.0, np.abs(p).max()) * np.hypot(*v):
                        cuts[int(on)].append((float(w @ v) / float(v @ v), tuple(p.tolist())))
    return {k: found for k, v in cuts.items() if (found := sorted(x for x in set(v) if 0 < x[0] < 1 and x[1] not in (tuple(a[k].tolist()), tuple(b[k].tolist()))))}


def valid_faces(rings: Sequence[Sequence]) -> list[np.ndarray]:
    """The rings of the polygon's inside: oriented, none crossing itself or another.

    Edges are cut at all their meetings; parts that lie on each other cancel by twos; what is left is walked with the
    inside on the left, at each vertex along the edge that bounds the same part of the inside.
    """
    rings = [r for r in map(opened, rings) if len(r) > 2]
    if not rings:
        return []
    a, b = np.concatenate(rings), np.concatenate([np.roll(r, -1, axis=0) for r in rings])
    shared = Counter(map(tuple, np.concatenate([np.hstack([a, b]), np.hstack([b, a])]).tolist()))
    cuts = edge_cuts(a, b)
    if not cuts and max(shared.values()) == 1 and len(set(map(tuple, a.tolist()))) == len(a):
        return oriented(rings)
    pieces: Counter = Counter()
    for k, (p, q) in enumerate(zip(map(tuple, a.tolist()), map(tuple, b.tolist()), strict=True)):
        stops = [p, *[at for _, at in cuts.get(k, ())], q]
        for s, e in zip(stops, stops[1:], strict=False):
            if s != e:
                pieces[min(s, e), max(s, e)] += 1
    edges = np.array([x for x, n in pieces.items() if n % 2], float).reshape(-1, 2, 2)
    if not len(edges):
        return []
    start, end = edges[:, 0], edges[:, 1]
    along = end - start
    beside = (start + end) / 2 + 1e-7 * np.stack([-along[:, 1], along[:, 0]], axis=1)
    left = inside(beside, start, end)
    start, end = np.where(left[:, None], start, end), np.where(left[:, None], end, start)
    leaving = defaultdict(list)
    for k, p in enumerate(map(tuple, start.tolist())):
        leaving[p].append(k)
    angle = np.arctan2(*(end - start).T[::-1])
    out, used = [], np.zeros(len(start), bool)
    for first in range(len(start)):
        ring, k = [], first
        while not used[k]:
            used[k] = True
            ring.append(start[k])
            onward = [j for j in leaving[tuple(end[k].tolist())] if not used[j]]
            if not onward:
                break
            back = angle[k] + np.pi
            k = min(onward, key=lambda j: ((back - angle[j]) % (2 * np.pi)) or 2 * np.pi)
        out += [np.array(loop) for loop in simple_loops(list(map(tuple, np.array(ring).reshape(-1, 2).tolist()))) if len(loop) > 2]
    return out


def simple_loops(ring: list[tuple[float, float]]) -> list[list[tuple[float, float]]]:
    """A closed walk taken apart where it comes back to a vertex, as where a hole touches its shell."""
    out, walk, place = [], [], {}
    for p in ring:
        if p in place:
            k = place[p]
            out.append(walk[k:])
            for q in walk[k:]:
                del place[q]
            del walk[k:]
        place[p] = len(walk)
        walk.append(p)
    return [*out, walk]


def repaired(frame: DataFrame, column: str = "coords") -> DataFrame:
    """The frame with valid, oriented rings in ``column``; of a polygon without area, none. Null rings count as none."""
    at = frame.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            faces = [[[{"x": float(x), "y": float(y)} for x, y in ring] for ring in valid_faces(rings or [])] for rings in batch.column(at).to_pylist()]
            columns = batch.columns
            columns[at] = pa.array(faces, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return frame.mapInArrow(run, frame.schema)


def clipped_areas(subjects: Sequence[np.ndarray], windows: np.ndarray) -> np.ndarray:
    """Signed areas of rings inside convex counter-clockwise windows, pair by pair. ``windows``: pairs x vertices x 2."""
    out = np.zeros(len(subjects))
    sizes = np.array([len(s) for s in subjects])
    order, k = np.argsort(sizes, kind="stable"), 0
    while k < len(order):
        # Rings of a kind of size together, as many as the bound of values allows, a ring at least.
        rows = order[k : k + max(1, CLIP_VALUES // (8 * int(sizes[order[k]])))]
        rows = rows[sizes[rows] <= 2 * sizes[rows[0]]]
        points = np.zeros((len(rows), int(sizes[rows[-1]]), 2))
        for place, r in enumerate(rows):
            points[place, : sizes[r]] = subjects[r]
        out[rows] = _clip(points, sizes[rows], windows[rows])
        k += len(rows)
    return out


def _clip(points: np.ndarray, counts: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Sutherland and Hodgman's clipping, a half-plane of all pairs at a time; concave subjects get bridges without area."""
    for k in range(windows.shape[1]):
        a, b = windows[:, k, None], windows[:, (k + 1) % windows.shape[1], None]
        number = np.arange(points.shape[1])
        real = number < counts[:, None]
        after = np.where(number + 1 < counts[:, None], number + 1, 0)
        following = np.take_along_axis(points, after[:, :, None], axis=1)
        turn = lambda p: (b[..., 0] - a[..., 0]) * (p[..., 1] - a[..., 1]) - (b[..., 1] - a[..., 1]) * (p[..., 0] - a[..., 0])  # noqa: B023,E731
        here, there = turn(points), turn(following)
        crosses = real & (((here > 0) & (there < 0)) | ((here < 0) & (there > 0)))
        share = here / np.where(crosses, here - there, 1.0)
        met = points + share[:, :, None] * (following - points)
        slots = np.stack([points, met], axis=2).reshape(len(points), -1, 2)
        kept = np.stack([real & (here >= 0), crosses], axis=2).reshape(len(points), -1)
        counts = kept.sum(axis=1)
        width = max(1, int(counts.max(initial=0)))
        first = np.argsort(~kept, axis=1, kind="stable")[:, :width]
        points = np.take_along_axis(slots, first[:, :, None], axis=1)
    number = np.arange(points.shape[1])
    base = points[:, :1]
    p = np.where((number < counts[:, None])[:, :, None], points - base, 0.0)
    q = np.take_along_axis(p, np.where(number + 1 < counts[:, None], number + 1, 0)[:, :, None], axis=1)
    return np.where(counts > 2, (p[..., 0] * q[..., 1] - q[..., 0] * p[..., 1]).sum(axis=1) / 2, 0.0)


def _convex(ring: np.ndarray) -> bool:
    step = np.roll(ring, -1, axis=0) - ring
    nexts = np.roll(step, -1, axis=0)
    turns = step[:, 0] * nexts[:, 1] - step[:, 1] * nexts[:, 0]
    return bool((turns >= 0).all()) and abs(np.arctan2(turns, (step * nexts).sum(axis=1)).sum() - 2 * np.pi) < 1e-6


def shared_areas(left: Sequence[Sequence], right: Sequence[Sequence]) -> np.ndarray:
    """Areas that polygons share, pair by pair.

    A convex right side clips at once. Any other is a sum of triangles between one of its vertices and each of its edges,
    which count as the edges turn about the vertex.
    """
    seen: dict[int, list[np.ndarray]] = {}

    def rings_of(polygon: Sequence) -> list[np.ndarray]:
        key = id(polygon)
        if key not in seen:
            rings = [r for r in map(opened, polygon) if len(r) > 2]
            seen[key] = oriented(rings) if rings else []
        return seen[key]

    jobs = defaultdict(list)
    for k, (p, q) in enumerate(zip(left, right, strict=True)):
        mine, other = rings_of(p), rings_of(q)
        if len(other) == 1 and _convex(other[0]):
            faces = [(1.0, other[0])]
        else:
            faces = []
            for ring in other:
                for s, e in zip(ring, np.roll(ring, -1, axis=0), strict=True):
                    triangle = np.array([other[0][0], s, e])
                    area = signed_area(triangle)
                    if area:
                        faces.append((1.0, triangle) if area > 0 else (-1.0, triangle[::-1]))
        for sign, face in faces:
            jobs[len(face)] += [(k, sign, subject, face) for subject in mine]
    out = np.zeros(len(left))
    for group in jobs.values():
        found = clipped_areas([j[2] for j in group], np.stack([j[3] for j in group]))
        np.add.at(out, [j[0] for j in group], found * np.array([j[1] for j in group]))
    return np.maximum(out, 0.0)
