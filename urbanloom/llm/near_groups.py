"""One document of each group of near-duplicates: SimHash candidates, then an exact completion.

Texts are near-duplicates if the Jaccard similarity of their sets of ``width``-word shingles is ``similarity`` or
more; groups are the components of that relation.

1. Exact copies (equal md5) become one class, a node with a number of its own, so no two texts share a number.
2. Fingerprints of the texts' distinct words, which move little under edits, give candidates by pigeonring
   filtering (simhash.hamming_links()), thinned to minimum spanning forests and verified on the whole texts.
3. What these miss is found exactly. In one order of all shingles, two similar sets share one of the first
   m - ceil(similarity m) + 1 of each. The order is rarest first by counts over all texts: chunks of texts send
   buckets 6 bytes for each distinct shingle, and buckets answer with a byte for how frequent it is. Only shingles
   that several texts have, and that stand among a text's rarest, make rows at all, so a passage that many otherwise
   different texts share makes none. Texts that share such a shingle, may be similar by their parities and whose
   groups are still apart are joined by spanning forests, never by all pairs; the texts of each cluster so joined
   meet once more, whole, and give a spanning forest of the pairs that are similar.

Edge cases: rows without words, null texts included, are alike. A null id sorts last; of rows with the same id and
text one stays. Very long texts are read whole; a text is one row of one chunk. Hot texts meet in partial sums, hot
shingles once a chunk. An empty table gives an empty result. All input columns stay, however they are called.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanloom.llm.common import Scratch, bounded, cut, shuffle_partitions, text_or_empty
from urbanloom.llm.components import connected_components
from urbanloom.llm.simhash import Forests, dealt, fingerprint, hamming_links, whole_groups

#: Bytes of texts that a chunk has about, and shingles that a bucket gets about.
CHUNK_BYTES, BUCKET_SHINGLES = 4 << 20, 1_000_000
#: Bytes of texts whose words are hashed at once.
PIECE = 1 << 22
#: Longer words are hashed one by one.
LONG_WORD = 64
#: Parity cells of a set of shingles.
BITS = 256
#: Parity cells where whole sets are at hand; texts and shingles of a block of a cluster.
CELLS, MEMBERS, MEMBER_SHINGLES = 4096, 512, 1 << 20
#: Counts of a shingle in a chunk are sent in so many bits.
COUNT_BITS = 6

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LETTER = np.random.Generator(np.random.PCG64(42)).integers(0, 2**64, 256, np.uint64)
_LETTER[65:91] = _LETTER[97:123]
_POWER = np.cumprod(np.concatenate(([1], np.full(LONG_WORD, 0x9E3779B97F4A7C15, np.uint64))).astype(np.uint64))
_NEXT = np.uint64(0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word (A-Z lower-cased), end to end, and the number of words of each text."""
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    inside = ~_SPACE[data]
    turns = np.diff(inside.view(np.int8), prepend=0)  # a text's end is white space
    begin, end = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)
    text_ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    counts = np.diff(np.searchsorted(begin, text_ends), prepend=0)
    if not len(begin):
        return np.empty(0, np.uint64), counts
    sizes = end - begin
    starts = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum())) - np.repeat(starts, sizes)
    terms = _LETTER[data[inside]] * _POWER[np.minimum(place, LONG_WORD)]
    hashes = np.add.reduceat(terms, starts) + sizes.astype(np.uint64)
    for k in np.flatnonzero(sizes > LONG_WORD):
        hashes[k] = xxhash.xxh64_intdigest(data[begin[k] : end[k]].tobytes().lower(), 42)
    return _mixed(hashes), counts


def _pieces(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, texts) of about PIECE bytes."""
    at = size = 0
    for k, text in enumerate(texts):
        size += len(text)
        if size >= PIECE:
            yield at, texts[at : k + 1]
            at, size = k + 1, 0
    if at < len(texts):
        yield at, texts[at:]


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Each text's set of shingles as sorted hashes. Fewer words are one shingle; texts without words share one."""
    sets: list[np.ndarray] = []
    for _, piece in _pieces(texts):
        words, counts = word_hashes(piece)
        runs = np.zeros(max(0, len(words) - width + 1), np.uint64)
        for k in range(width):
            runs = runs * _NEXT + words[k : k + len(runs)]
        runs = _mixed(runs)
        at = 0
        for n in counts.tolist():
            if n >= width:
                sets.append(np.unique(runs[at : at + n - width + 1]))
            else:
                value = n
                for w in words[at : at + n].tolist():
                    value = (value * int(_NEXT) + w) % 2**64
                sets.append(_mixed(np.array([value], np.uint64)))
            at += n
    return sets


def _bytes(column: pa.Array) -> list[bytes]:
    return [t.as_py() for t in column.cast(pa.binary())]


def _word_prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, text) to (node, fp) by the distinct words."""
    for batch in batches:
        prints: list[int] = []
        for _, piece in _pieces(_bytes(batch.column(1))):
            words, counts = word_hashes(piece)
            ends = np.cumsum(counts)
            prints += [fingerprint(np.unique(words[a:b])) for a, b in zip(ends - counts, ends, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(prints, np.uint64).view(np.int64))], names=["node", "fp"])


def _similarity(width: int):
    """(u, v, text of u, text of v) to (u, v, similarity): Jaccard of the sets of word shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = np.empty(part.num_rows)
                for k, (a, b) in enumerate(zip(*(shingle_sets(_bytes(part.column(c)), width) for c in (2, 3)), strict=True)):
                    shared = len(np.intersect1d(a, b, assume_unique=True))
                    found[k] = shared / (len(a) + len(b) - shared)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found)], names=["u", "v", "similarity"])

    return run


def verified_links(links: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """u, v: the links whose texts' shingles are similar enough. ``texts``: node, text."""
    involved = bounded(cut(links.select(F.explode(F.array("u", "v")).alias("node")).distinct()))
    few = cut(texts.select("node", "text").join(involved, "node"))
    paired = links.join(few.select(F.col("node").alias("u"), F.col("text").alias("text_u")), "u").join(few.select(F.col("node").alias("v"), F.col("text").alias("text_v")), "v")
    found = paired.select("u", "v", "text_u", "text_v").mapInArrow(_similarity(width), "u long, v long, similarity double")
    return cut(found.where(F.col("similarity") >= similarity).select("u", "v"))


class ChunkSets:
    """A chunk's texts as sets of shingles, and its distinct shingles by bucket."""

    def __init__(self, table: pa.Table, width: int, buckets: int):
        order = np.argsort(np.asarray(table.column("node")), kind="stable")
        table = table.take(pa.array(order))
        self.node = np.asarray(table.column("node"))
        self.sets = shingle_sets([t for c in table.column("text").chunks for t in _bytes(c)], width)
        every = np.concatenate(self.sets)
        self.distinct, self.of, self.times = np.unique(every, return_inverse=True, return_counts=True)
        bucket = ((self.distinct >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.flatnonzero(np.diff(bucket[order])) + 1
        self.parts = [(int(bucket[p[0]]), p) for p in np.split(order, edges) if len(p)]


def _announce(width: int, buckets: int):
    """Chunk: (bucket, chunk, packed): six bytes for each distinct shingle, the lowest bits its texts here."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        chunk = ChunkSets(table, width, buckets)
        most = (1 << COUNT_BITS) - 1
        packed = (chunk.distinct & ~np.uint64(most)) | np.minimum(chunk.times, most).astype(np.uint64)
        blobs = [packed[p].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes() for _, p in chunk.parts]
        return pa.table({"bucket": pa.array([b for b, _ in chunk.parts], pa.int64()), "chunk": pa.array([key[0].as_py()] * len(blobs), pa.int64()), "packed": pa.array(blobs, pa.binary())})

    return run


def _answer(table: pa.Table) -> pa.Table:
    """Bucket: (chunk, bucket, classes): a byte for each shingle, 0 if one text has it, else more the more texts have it."""
    packed = table.column("packed").to_pylist()
    sizes = [len(p) // 6 for p in packed]
    values = np.zeros((sum(sizes), 8), np.uint8)
    values[:, :6] = np.frombuffer(b"".join(packed), np.uint8).reshape(-1, 6)
    short = values.view("<u8").ravel()
    order = np.argsort(short, kind="stable")
    key, times = short[order] >> np.uint64(COUNT_BITS), short[order] & np.uint64((1 << COUNT_BITS) - 1)
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    total = np.add.reduceat(times, first).astype(np.float64)
    grade = np.where(total <= 1, 0, np.minimum(255, 1 + np.floor(8 * np.log2(np.maximum(total, 1))))).astype(np.uint8)
    classes = np.empty(len(short), np.uint8)
    classes[order] = np.repeat(grade, np.diff(np.append(first, len(short))))
    blobs = [zlib.compress(c.tobytes(), 1) for c in np.split(classes, np.cumsum(sizes)[:-1])]
    return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "classes": pa.array(blobs, pa.binary())})


SETS = pa.schema([("node", pa.int64()), ("size", pa.int64()), ("keys", pa.list_(pa.int64())), ("bits", pa.list_(pa.int64()))])


def _prefixes(width: int, buckets: int, similarity: float):
    """Chunk and its answers: node, size of the set, keys (its rarest shingles that others have too), parity bits."""

    def run(key: tuple, table: pa.Table, told: pa.Table) -> pa.Table:
        if not table.num_rows:
            return SETS.empty_table()
        chunk = ChunkSets(table, width, buckets)
        said = dict(zip(told.column("bucket").to_pylist(), told.column("classes").to_pylist(), strict=True))
        classes = np.empty(len(chunk.distinct), np.uint8)
        for bucket, part in chunk.parts:
            classes[part] = np.frombuffer(zlib.decompress(said[bucket]), np.uint8)
        of, out = chunk.of.ravel(), {name: [] for name in SETS.names}
        at = 0
        for node, found in zip(chunk.node.tolist(), chunk.sets, strict=True):
            own = classes[of[at : at + len(found)]]
            at += len(found)
            take = len(found) - math.ceil(similarity * len(found) - 1e-6) + 1
            first = np.argsort(own, kind="stable")[:take]  # ties by hash, as the set is sorted
            first = first[own[first] > 0]
            if len(first):
                odd = np.bincount((found % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
                out["node"].append(node)
                out["size"].append(len(found))
                out["keys"].append(found[first].view(np.int64))
                out["bits"].append(np.packbits(odd.astype(np.uint8)).view(np.int64))
        return pa.table(out, SETS)

    return run


def shared_prefixes(texts: DataFrame, width: int, similarity: float, chunk_bytes: int = CHUNK_BYTES, bucket_shingles: int = BUCKET_SHINGLES) -> DataFrame:
    """node, size (of its set of shingles), keys, bits: a row for each text of which one of the rarest shingles is in another text too.

    ``bits`` are the parities of the shingles in BITS cells; the cells that differ between two sets are at most as
    many as the shingles that only one of them has.
    """
    total = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    chunks, buckets = max(1, math.ceil(total / chunk_bytes)), max(1, math.ceil(total / 6 / bucket_shingles))
    by_chunk = texts.select(F.pmod(F.xxhash64("node"), F.lit(chunks)).alias("chunk"), "node", "text").groupBy("chunk")
    sent = by_chunk.applyInArrow(_announce(width, buckets), "bucket long, chunk long, packed binary")
    answers = sent.groupBy("bucket").applyInArrow(_answer, "chunk long, bucket long, classes binary")
    return by_chunk.cogroup(answers.groupBy("chunk")).applyInArrow(_prefixes(width, buckets, similarity), "node long, size long, keys array<long>, bits array<long>")


def pairs_apart(group: np.ndarray, root: np.ndarray, size: np.ndarray, bits: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs of equal group and different root (rows come sorted by both) that may be similar enough: left, right."""
    run = np.concatenate(([0], np.cumsum((group[1:] != group[:-1]) | (root[1:] != root[:-1]))))
    ends, first = np.searchsorted(group, group, side="right"), np.searchsorted(run, run, side="right")
    share, step = (1 - similarity) / (1 + similarity), 0
    at = np.flatnonzero(first < ends)
    while len(at):
        other = first[at] + step
        fits = np.minimum(size[at], size[other]) >= similarity * np.maximum(size[at], size[other]) - 1e-6
        i, j = at[fits], other[fits]
        # Of signed numbers NumPy would count the bits of the absolute value.
        differ = np.bitwise_count((bits[i] ^ bits[j]).view(np.uint64)).sum(axis=1, dtype=np.int64)
        near = differ <= share * (size[i] + size[j]) + 1e-6
        if near.any():
            yield i[near], j[near]
        step += 1
        at = at[first[at] + step < ends[at]]


def _apart(similarity: float):
    """Sorted rows (key, part, root, node, size, bits) to a spanning forest (u, v) of their pairs, a few whole groups at a time."""

    def edges(rows: list[np.ndarray]) -> pa.RecordBatch:
        key, part, root, node, size, bits = rows
        group = np.concatenate(([0], np.cumsum((key[1:] != key[:-1]) | (part[1:] != part[:-1]))))
        names, at = np.unique(node, return_inverse=True)  # a forest over the texts, whichever groups they meet in
        made = Forests(names, 1)
        for i, j in pairs_apart(group, root, size, bits, similarity):
            made.add(at[i], at[j], np.zeros(len(i), np.int64))
        left, right, *_ = made.links()
        return pa.RecordBatch.from_arrays([pa.array(names[left]), pa.array(names[right])], names=["u", "v"])

    return whole_groups(edges)


def candidate_forest(sets: DataFrame, roots: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """u, v: links that join all texts of shared_prefixes() which share a key, may be similar and whose groups by ``roots`` (node, root) are apart.

    A task gives fewer links than it has texts, however many pairs they make.
    """
    keyed = sets.join(roots, "node", "left").select(F.coalesce("root", "node").alias("root"), "node", F.explode("keys").alias("key"))
    mixed = scratch.write(lambda: keyed.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("key"))
    narrow = scratch.write(lambda: keyed.join(bounded(mixed), "key"))
    rows = scratch.write(lambda: narrow.join(sets.select("node", "size", "bits"), "node").select("key", "root", "node", "size", "bits"))
    count = shuffle_partitions(sets.sparkSession)
    placed = dealt(rows, "node").select("key", "part", "root", "node", "size", "bits").repartition(count, "key", "part").sortWithinPartitions("key", "part", "root")
    return scratch.write(lambda: placed.mapInArrow(_apart(similarity), "u long, v long").distinct())


def parities(sets: list[np.ndarray], cells: int) -> np.ndarray:
    """A row of packed parity bits for each set of shingles."""
    odd = np.empty((len(sets), cells // 64), np.uint64)
    for k, found in enumerate(sets):
        ones = np.bincount((found % np.uint64(cells)).astype(np.int64), minlength=cells) & 1
        odd[k] = np.packbits(ones.astype(np.uint8)).view(np.uint64)
    return odd


def similar_forest(sets: list[np.ndarray], root: np.ndarray, block: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Pairs that join everything that links of the similarity join beyond the roots; with two blocks, links between these.

    Pairs that the parities leave possible are looked at from the nearest; whole sets decide, for pairs that are still apart.
    """
    size, bits = np.array([len(s) for s in sets], np.int64), parities(sets, CELLS)
    across, share = len(np.unique(block)) > 1, (1 - similarity) / (1 + similarity)
    left, right, far = [], [], []
    for i in range(len(sets) - 1):
        fits = (root[i + 1 :] != root[i]) & (np.minimum(size[i + 1 :], size[i]) >= similarity * np.maximum(size[i + 1 :], size[i]) - 1e-6)
        if across:
            fits &= block[i + 1 :] != block[i]
        j = i + 1 + np.flatnonzero(fits)
        differ, both = np.bitwise_count(bits[j] ^ bits[i]).sum(axis=1, dtype=np.int64), size[j] + size[i]
        near = differ <= share * both + 1e-6
        left.append(np.full(int(near.sum()), i))
        right.append(j[near])
        far.append(differ[near] / both[near])
    above = {}

    def top(k: int) -> int:
        while (up := above.get(k, k)) != k:
            above[k] = k = above.get(up, up)
        return k

    out, roots = [], root.tolist()
    if not left:
        return out
    left, right = np.concatenate(left), np.concatenate(right)
    order = np.argsort(np.concatenate(far), kind="stable")
    for i, j in zip(left[order].tolist(), right[order].tolist(), strict=True):
        p, q = top(roots[i]), top(roots[j])
        if p == q:
            continue
        shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        if shared / (len(sets[i]) + len(sets[j]) - shared) >= similarity:
            above[p] = q
            out.append((i, j))
    return out


def _similar(width: int, similarity: float):
    """Texts of a part of a cluster (root, node, block, text) to links (u, v)."""

    def run(table: pa.Table) -> pa.Table:
        node = np.asarray(table.column("node"))
        sets = shingle_sets([t for c in table.column("text").chunks for t in _bytes(c)], width)
        links = similar_forest(sets, np.asarray(table.column("root")), np.asarray(table.column("block")), similarity)
        u, v = np.array(links, np.int64).reshape(-1, 2).T
        return pa.table({"u": node[u], "v": node[v]})

    return run


def links_apart(forest: DataFrame, sets: DataFrame, roots: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """u, v: similar texts of the clusters that ``forest`` joins, enough to join all whose groups by ``roots`` are apart.

    A cluster's texts meet in parts of two blocks, each bounded in texts and in shingles, so every two of them meet.
    """
    clusters = cut(connected_components(forest).withColumnRenamed("root", "key"))
    members = cut(clusters.join(sets.select("node", "size"), "node").join(roots, "node", "left").select("key", "node", "size", F.coalesce("root", "node").alias("root")))
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / MEMBERS), F.ceil(F.sum("size") / MEMBER_SHINGLES)).cast("long")
    marked = members.join(bounded(members.groupBy("key").agg(blocks.alias("blocks"))), "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    meets = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda other: F.least("block", other) * F.col("blocks") + F.greatest("block", other))
    told = marked.join(texts.select("node", "text"), "node").select("key", F.explode(meets).alias("part"), "root", "node", "block", "text")
    return cut(told.groupBy("key", "part").applyInArrow(_similar(width, similarity), "u long, v long"))


def classes_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """node, md5, least (none, id), n, text: a row for each different text, with its smallest id and the rows that have both."""
    text = text_or_empty(text_col)
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.md5(text).alias("md5"), text.alias("text"))
    by_id = keyed.groupBy("md5", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    copies = by_id.groupBy("md5").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "n")).alias("least"))
    texts = keyed.groupBy("md5").agg(F.first("text").alias("text"))
    return copies.join(texts, "md5").select(F.monotonically_increasing_id().alias("node"), "md5", "least", "text")


def near_groups(classes: DataFrame, width: int, similarity: float, radius: int, segments: int, scratch: Scratch) -> DataFrame:
    """node, root for the texts of ``classes`` that have a near-duplicate."""
    prints = cut(classes.select("node", "text").mapInArrow(_word_prints, "node long, fp long"))
    by_print = cut(prints.groupBy("fp").agg(F.min("node").alias("first")))
    same_print = prints.join(by_print, "fp").where("node <> first").select(F.col("node").alias("u"), F.col("first").alias("v"))
    near = hamming_links(by_print.select("fp", F.col("first").alias("node")), radius, segments).select("u", "v")
    links = cut(same_print.unionByName(near).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    good = verified_links(links, classes, width, similarity)
    roots = connected_components(good)
    sets = scratch.write(lambda: shared_prefixes(classes, width, similarity))
    forest = candidate_forest(sets, roots, similarity, scratch)
    fresh = links_apart(forest, sets, roots, classes, width, similarity)
    return roots if fresh.isEmpty() else connected_components(good.unionByName(fresh))


def one_of_each_group(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, radius: int = 7, segments: int = 15
) -> DataFrame:
    """The input rows, with all their columns, but one only of each group of near-duplicates: the smallest id's."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    classes = scratch.write(lambda: classes_of(docs, id_col, text_col))
    roots = near_groups(classes, width, similarity, radius, segments, scratch)
    named = classes.select("node", "md5", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    chosen = cut(named.groupBy("root").agg(F.min(F.struct("least", "md5")).alias("best")).select(F.col("best.md5").alias("__md5"), F.col("best.least.id").alias("__id"), F.col("best.least.n").alias("__n")))
    scratch.clear()
    on = F.expr("d.__md5 = c.__md5 and d.__id <=> c.__id")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    marked = docs.select(row, F.md5(text_or_empty(text_col)).alias("__md5"), F.col(id_col).cast("long").alias("__id")).alias("d")
    kept = marked.join(chosen.where("__n = 1").alias("c"), on, "left_semi")
    repeated = chosen.where("__n > 1")
    if not repeated.isEmpty():  # rows alike in id and text
        kept = kept.unionByName(marked.join(repeated.alias("c"), on, "left_semi").dropDuplicates(["__md5", "__id"]))
    return kept.select("__row.*")
