"""SimHash near-duplicates with pigeonring filtering.

A fingerprint has 64 bits; a bit is 1 if it is set in over half of the features' XXH64 hashes. Fingerprints
within ``radius`` differing bits link. The bits are cut into ``segments`` on a ring. If two fingerprints differ
in at most ``radius`` bits, then from some segment on, every chain of l consecutive segments has at most
floor(l * radius / segments) differences (the strong form of the pigeonhole principle on a ring). The longest
chain with a budget of 0 is the key by which candidates meet; the longer chains prune the pairs, one after the
other; the chain of all segments is the full Hamming check. No link is lost.

Equal fingerprints meet first and count as one node, so copies never make pairs. Within a key's group only a
minimum spanning forest of the links leaves the task, never all pairs. A key with more than ``BLOCK`` nodes is
split into blocks, and each pair of blocks is a task of its own.

Edge cases: a text without words, null included, has fingerprint 0 and links like any other; fewer words than
a shingle give one feature, the whole sequence. Repeated rows are rows of their own in one component. A row
whose id is null keeps a row but links nothing: its component is null. Very long texts are read whole; votes
are summed in pieces. An empty table gives an empty result. Other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urbanloom.llm.common import cut, shuffle_partitions, text_or_empty
from urbanloom.llm.components import connected_components

SEED = 42
#: Nodes of a key's group that are compared in one task at most, times two.
BLOCK = 2048
#: Keys with more nodes than BLOCK that are looked up by broadcast at most; beyond, by a join.
MAX_BROADCAST_KEYS = 20_000
#: Rows compared at once in a task.
CHUNK = 1 << 16


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """XXH64 of each run of ``width`` words (lower-cased A-Z, joined by spaces), repeats included."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    return np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        piece = hashes[at : at + (1 << 16)]
        votes += np.unpackbits(piece.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits((2 * votes > len(hashes)).astype(np.uint8), bitorder="little")
    return int(bits.view(np.uint64)[0])


def _fingerprints(width: int, distinct: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.empty(batch.num_rows, np.uint64)
            for k, text in enumerate(batch.column(1)):
                hashes = shingle_hashes(text.as_py() or "", width)
                prints[k] = fingerprint(np.unique(hashes) if distinct else hashes)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distinct: bool = False) -> DataFrame:
    """doc_id, fp (a signed long holding the 64 bits). ``distinct`` counts each feature of a text once."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return base.mapInArrow(_fingerprints(shingle, distinct), "doc_id long, fp long")


def ring(radius: int, segments: int) -> tuple[list[tuple[int, int]], int]:
    """The segments as (shift, bits), and the length of the longest chain that may not differ."""
    edges = [64 * k // segments for k in range(segments + 1)]
    parts = [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]
    free = max(length for length in range(segments + 1) if length * radius // segments == 0)
    if free == 0:
        raise ValueError("more segments than the radius are needed")
    return parts, free


def _chain_key(start: int, parts: list[tuple[int, int]], free: int):
    key = F.lit(start).cast("long")
    for step in range(free):
        shift, bits = parts[(start + step) % len(parts)]
        value = F.shiftrightunsigned(F.col("fp"), shift).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
        key = F.shiftleft(key, bits).bitwiseOR(value)
    return key


def spanning_forest(left: np.ndarray, right: np.ndarray, weight: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the edges of a minimum spanning forest (Borůvka), and every node's root; ties are broken by order."""
    root, kept = np.arange(n), []
    order = np.argsort(weight, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    live = np.arange(len(left))
    while len(live):
        a, b = root[left[live]], root[right[live]]
        apart = a != b
        live, a, b = live[apart], a[apart], b[apart]
        if not len(live):
            break
        best = np.full(n, len(rank), np.int64)
        np.minimum.at(best, a, rank[live])
        np.minimum.at(best, b, rank[live])
        chosen = np.unique(best[best < len(rank)])
        edges = order[chosen]
        kept.append(edges)
        p, q = root[left[edges]], root[right[edges]]
        while True:  # each round hooks the larger root onto the smaller one, then shortens all paths
            low, high = np.minimum(p, q), np.maximum(p, q)
            split = low != high
            if not split.any():
                break
            np.minimum.at(root, high[split], low[split])
            while True:
                shorter = root[root]
                if (shorter == root).all():
                    break
                root = shorter
            p, q = root[p], root[q]
    return (np.unique(np.concatenate(kept)) if kept else np.empty(0, np.int64)), root


def linked_pairs(keys: np.ndarray, prints: np.ndarray, starts: np.ndarray, radius: int, segments: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row pairs of equal key (rows come sorted by key) that pass every chain's budget: left, right, distance, in pieces."""
    parts, free = ring(radius, segments)
    masks = np.array([((1 << bits) - 1) << shift for shift, bits in parts], np.uint64)
    ends = np.searchsorted(keys, keys, side="right")
    at, offset = np.arange(len(keys)), 1
    at = at[at + 1 < ends]
    while len(at):
        pairs, differ = at, prints[at] ^ prints[at + offset]
        total = np.zeros(len(at), np.int64)
        for length in range(free + 1, segments + 1):
            # The chain's first segments are equal by the key, so only the later ones count.
            segment = (starts[pairs] + length - 1) % segments
            total = total + np.bitwise_count(differ & masks[segment])
            fits = total <= length * radius // segments
            pairs, differ, total = pairs[fits], differ[fits], total[fits]
            if not len(pairs):
                break
        if len(pairs):
            yield pairs, pairs + offset, total
        offset += 1
        at = at[at + offset < ends[at]]


class Forests:
    """The first ``levels`` edge-disjoint minimum spanning forests of links that come in pieces, in bounded memory.

    Links are held back and thinned out to the forests' whenever PAIRS have come. A link whose ends every forest
    joins already by edges no longer than it is changes nothing and is dropped at once.
    """

    PAIRS = 400_000

    def __init__(self, node: np.ndarray, levels: int):
        self.node, self.levels = node, levels
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.count, self.known = 0, []

    def add(self, left: np.ndarray, right: np.ndarray, distance: np.ndarray) -> None:
        if len(self.known) == self.levels:
            idle = np.ones(len(left), bool)
            for root, longest in self.known:
                idle &= (root[left] == root[right]) & (distance >= longest[root[left]])
            left, right, distance = left[~idle], right[~idle], distance[~idle]
        if len(left):
            self.held.append((left, right, distance))
            self.count += len(left)
            if self.count > self.PAIRS:
                self.thin()

    def thin(self) -> np.ndarray:
        """Keep the forests' links only; returns their levels."""
        if not self.held:
            return np.empty(0, np.int64)
        left, right, distance = (np.concatenate(c) for c in zip(*self.held, strict=True))
        low, high = np.minimum(self.node[left], self.node[right]).astype(np.uint64), np.maximum(self.node[left], self.node[right]).astype(np.uint64)
        mixed = (low * np.uint64(0x9E3779B97F4A7C15)) ^ (high * np.uint64(0xC2B2AE3D27D4EB4F))
        weight = (distance.astype(np.uint64) << np.uint64(56)) | (mixed >> np.uint64(8))
        over, found, self.known = np.arange(len(left)), [], []
        for _ in range(self.levels):
            tree, root = spanning_forest(left[over], right[over], weight[over], len(self.node))
            longest = np.zeros(len(self.node), np.int64)
            np.maximum.at(longest, root[left[over[tree]]], distance[over[tree]])
            self.known.append((root, longest))
            found.append(over[tree])
            over = np.delete(over, tree)
        kept = np.concatenate(found)
        self.held, self.count = [(left[kept], right[kept], distance[kept])], 0
        return np.repeat(np.arange(1, self.levels + 1), [len(f) for f in found])

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """left, right, distance, level."""
        level = self.thin()
        if not self.held:
            return level, level, level, level
        return *self.held[0], level


def whole_groups(edges):
    """``edges`` over rows (key, part, ...), sorted by both, a few whole groups at a time; a list column becomes a matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            fresh = [np.asarray(c.flatten()).reshape(batch.num_rows, -1) if pa.types.is_list(c.type) else np.asarray(c) for c in batch.columns]
            held = fresh if held is None else [np.concatenate(pair) for pair in zip(held, fresh, strict=True)]
            if len(held[0]) >= CHUNK:
                key, part = held[0], held[1]
                last = int(np.flatnonzero((key != key[-1]) | (part != part[-1]))[-1]) + 1 if ((key != key[-1]) | (part != part[-1])).any() else 0
                if last:
                    yield edges([column[:last] for column in held])
                    held = [column[last:] for column in held]
        if held is not None and len(held[0]):
            yield edges(held)

    return run


def _forest(radius: int, segments: int, forests: int):
    """Sorted rows (key, part, start, fp, node) to forest edges (u, v, distance, level), a few whole groups at a time.

    Level 1 is the minimum spanning forest of the links, level 2 that of the links left without it, and so on.
    """

    def edges(rows: list[np.ndarray]) -> pa.RecordBatch:
        key, part, start, fp, node = rows
        group = np.concatenate(([0], np.cumsum((key[1:] != key[:-1]) | (part[1:] != part[:-1])))) if len(key) else key
        made = Forests(node, forests)
        for piece in linked_pairs(group, fp.view(np.uint64), start, radius, segments):
            made.add(*piece)
        left, right, distance, level = made.links()
        columns = [pa.array(node[left]), pa.array(node[right]), pa.array(distance.astype(np.int32)), pa.array(level.astype(np.int32))]
        return pa.RecordBatch.from_arrays(columns, names=["u", "v", "distance", "level"])

    return whole_groups(edges)


def dealt(keyed: DataFrame, by: str) -> DataFrame:
    """Add ``part``: the rows of a key with more than BLOCK meet in parts, one for each pair of its blocks."""
    crowded = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK).select("key", F.ceil(F.col("n") / BLOCK).cast("long").alias("blocks"))
    known = crowded.limit(MAX_BROADCAST_KEYS + 1).collect()
    if len(known) <= MAX_BROADCAST_KEYS:
        crowded = F.broadcast(keyed.sparkSession.createDataFrame(known, "key long, blocks long"))
    marked = keyed.join(crowded, "key", "left") if known else keyed.withColumn("blocks", F.lit(None).cast("long"))
    own = F.pmod(F.xxhash64(by), F.col("blocks"))
    meets = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda other: F.least(own, other) * F.col("blocks") + F.greatest(own, other))
    return marked.withColumn("part", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(meets)))


def hamming_links(nodes: DataFrame, radius: int, segments: int, forests: int = 1) -> DataFrame:
    """u, v, distance, level: for each key's group a minimum spanning forest of its links. ``nodes``: fp (distinct), node."""
    parts, free = ring(radius, segments)
    keyed = nodes.select(
        "fp", "node", F.explode(F.array(*[F.struct(F.lit(k).alias("start"), _chain_key(k, parts, free).alias("key")) for k in range(segments)])).alias("s")
    ).select("s.key", F.col("s.start").cast("long").alias("start"), "fp", "node")
    count = shuffle_partitions(nodes.sparkSession)
    placed = dealt(keyed, "fp").select("key", "part", "start", "fp", "node").repartition(count, "key", "part").sortWithinPartitions("key", "part")
    return placed.mapInArrow(_forest(radius, segments, forests), "u long, v long, distance int, level int")


def nodes_of(prints: DataFrame) -> DataFrame:
    """fp, node (the smallest id): equal fingerprints meet in sums that start before the shuffle."""
    return prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node"))


def simhash_components(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3, segments: int = 7, distinct: bool = False
) -> DataFrame:
    """doc_id, fp, component_id: a row per row; the component is the smallest id reachable over links."""
    prints = cut(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle, distinct=distinct))
    nodes = cut(nodes_of(prints))
    roots = connected_components(hamming_links(nodes, radius, segments).select("u", "v"))
    placed = cut(nodes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id")))
    # Both sides are read from files, so that Spark splits a fingerprint that a third of all rows have.
    joined = prints.where("doc_id is not null").join(placed, "fp").select("doc_id", "fp", "component_id")
    return joined.unionByName(prints.where("doc_id is null").withColumn("component_id", F.lit(None).cast("long")))


def hex_digits(fp: Column) -> Column:
    """16 lowercase hexadecimal digits of a fingerprint."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
