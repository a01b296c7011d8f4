"""Removal of repeated byte strings by a common-prefix-aware distributed merge sort of suffixes.

A byte goes if a ``LENGTH``-byte string that covers it also starts in a document with a smaller id. Matches never
cross documents; strings are judged on the input.

Which suffixes are sorted: in every string of LENGTH bytes, the position of its least-hashed ``KMER``-byte run is
its anchor. It depends on the string's bytes alone, so equal strings have their anchors at equal offsets, and
suffixes need to be sorted at anchors only (about one position in fifteen), with the bytes before them at hand.

Documents are dealt into chunks of about CHUNK_BYTES by a hash of the id. Then:

1. Each chunk sends the hashes of its anchors' runs to buckets, packed; a bucket answers with a bit for each
   that other documents have too. Everything else takes no further part.
2. Each chunk sorts the suffixes at its remaining anchors (equal ones meet, with their least document) and sends
   each bucket its run, front-coded: the length of the prefix shared with the one before, and the rest.
3. A bucket merges its runs with a loser tree. The prefix a string shares with the last output is known from the
   front coding or from earlier games; strings with different known prefixes are ordered by these alone, and
   comparisons start behind them. The merged order's own common prefixes delimit the groups that share an
   anchor. Within a group, the least document of each string is found at every offset and sent back.
4. Each chunk marks the covered bytes and cuts them out.

Edge cases: a null text is empty; texts shorter than LENGTH lose nothing. A null id counts as larger than any
other. Rows with equal ids are the same document and do not cover each other. Any bytes may occur, zeros too.
Very long texts are read in overlapping pieces. An empty table gives an empty result. Other columns are not carried.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanloom.llm.common import text_or_empty

LENGTH = 50
KMER = 20
REACH = LENGTH - KMER + 1  # anchors' offsets in a string: 0 to REACH - 1
CHUNK_BYTES = 4 << 20
#: Anchors that a bucket gets about.
BUCKET_ANCHORS = 1_000_000
PIECE = 1 << 23
WIDTH = LENGTH + REACH - 1  # bytes from the anchor on, then those before it, backwards
KEY = WIDTH + 2  # and the least and the largest offset
LAST = np.iinfo(np.int64).max
_BASE = 0x9E3779B97F4A7C15


def _powers() -> dict[int, np.uint64]:
    found, power, length = {}, _BASE, 1
    while length <= KMER:
        found[length] = np.uint64(power)
        power = power * power % 2**64
        length *= 2
    return found


_POWERS = _powers()


def kmer_hashes(text: np.ndarray) -> np.ndarray:
    """A hash of each run of KMER bytes, by doubling."""
    part = text.astype(np.uint64) + np.uint64(1)
    parts, length = {1: part}, 1
    while 2 * length <= KMER:
        part = part[: len(part) - length] * _POWERS[length] + part[length:]
        length *= 2
        parts[length] = part
    for step in sorted(parts, reverse=True):
        if KMER - length >= step:
            part = part[: len(text) - length - step + 1] * _POWERS[step] + parts[step][length : len(text) - step + 1]
            length += step
    part = (part ^ (part >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return part ^ (part >> np.uint64(32))


def anchors(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """hash, position, first and last start of the strings it is the anchor of; for a text in pieces, all of them."""
    out = []
    for at in range(0, max(1, len(text) - LENGTH + 1), PIECE):
        piece = text[at : at + PIECE + LENGTH - 1]
        if len(piece) < LENGTH:
            break
        hashes = kmer_hashes(piece)
        least = (hashes & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(hashes), dtype=np.uint64)  # ties: the leftmost
        span = 1
        while 2 * span <= REACH:
            least = np.minimum(least[: len(least) - span], least[span:])
            span *= 2
        if span < REACH:
            least = np.minimum(least[: len(least) - (REACH - span)], least[REACH - span :])
        position = (least & np.uint64(0xFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.diff(position, prepend=-1))
        last = np.append(first[1:], len(position)) - 1
        out.append((hashes[position[first]], position[first] + at, first + at, last + at))
    if not out:
        empty = np.empty(0, np.int64)
        return np.empty(0, np.uint64), empty, empty, empty
    return tuple(np.concatenate(column) for column in zip(*out, strict=True))


class Chunk:
    """A chunk's texts end to end and the anchors in them."""

    def __init__(self, table: pa.Table):
        ids = table.column("doc_id").combine_chunks()
        self.nulls = np.asarray(ids.is_null())
        self.ids = np.asarray(ids.fill_null(LAST)).astype(np.int64)
        raw = [t.as_py() for t in table.column("data")]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        self.starts = np.concatenate(([0], np.cumsum(sizes)))
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)
        found = []
        for k, size in enumerate(sizes):
            if size >= LENGTH:
                begin = self.starts[k]
                h, p, a, b = anchors(self.bytes[begin : begin + size])
                found.append((h, np.full(len(h), k), p + begin, p - b, p - a))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.empty(0, np.uint64)] + [np.empty(0, np.int64)] * 4
        self.hash, self.doc, self.position, self.low, self.high = columns

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct hashes, and whether several documents of this chunk have them."""
        order = np.argsort(self.hash, kind="stable")
        sorted_hash, ids = self.hash[order], self.ids[self.doc[order]]
        first = np.flatnonzero(np.concatenate((np.ones(min(1, len(order)), bool), sorted_hash[1:] != sorted_hash[:-1])))
        if not len(first):
            return sorted_hash, np.empty(0, bool)
        return sorted_hash[first], np.minimum.reduceat(ids, first) != np.maximum.reduceat(ids, first)

    def keep(self, repeated: np.ndarray) -> None:
        """Only anchors whose hash is among ``repeated`` (sorted) stay."""
        at = np.searchsorted(repeated, self.hash)
        stay = np.zeros(len(self.hash), bool)
        inside = at < len(repeated)
        stay[inside] = repeated[at[inside]] == self.hash[inside]
        for name in ("hash", "doc", "position", "low", "high"):
            setattr(self, name, getattr(self, name)[stay])

    def suffixes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct suffixes as sorted rows of KEY bytes, their least document and hash, and each anchor's row."""
        n = len(self.hash)
        rows = np.zeros((n, KEY), np.uint8)
        begin, end = self.starts[self.doc], self.starts[self.doc + 1]
        padded = np.concatenate((np.zeros(REACH, np.uint8), self.bytes, np.zeros(LENGTH, np.uint8)))
        at = self.position + REACH
        for k in range(LENGTH):
            rows[:, k] = np.where(self.position + k < end, padded[at + k], 0)
        for k in range(REACH - 1):
            rows[:, LENGTH + k] = np.where(self.position - 1 - k >= begin, padded[at - 1 - k], 0)
        rows[:, WIDTH], rows[:, WIDTH + 1] = self.low, self.high
        flat = np.ascontiguousarray(rows).view(f"V{KEY}").ravel()
        order = np.argsort(flat, kind="stable")
        ordered = rows[order]
        new = np.concatenate((np.ones(min(1, n), bool), (ordered[1:] != ordered[:-1]).any(axis=1)))
        first = np.flatnonzero(new)
        row_of = np.empty(n, np.int64)
        row_of[order] = np.cumsum(new) - 1
        least = np.minimum.reduceat(self.ids[self.doc[order]], first) if n else np.empty(0, np.int64)
        return ordered[first], least, self.hash[order][first], row_of


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def _parts(which: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(value, indices in order) for each value of an array."""
    order = np.argsort(which, kind="stable")
    edges = np.flatnonzero(np.diff(which[order])) + 1
    return [(int(which[part[0]]), part) for part in np.split(order, edges) if len(part)]


def announce(buckets: int):
    """Step 1, chunk: (bucket, chunk, packed): six bytes for each hash, sorted; the lowest bit says 'in several documents here'."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        hashes, several = Chunk(table).runs()
        rows = {"bucket": [], "chunk": [], "packed": []}
        for bucket, part in _parts(bucket_of(hashes, buckets)):
            short = ((hashes[part] << np.uint64(17)) >> np.uint64(16)) & ~np.uint64(1) | several[part].astype(np.uint64)
            rows["bucket"].append(bucket)
            rows["chunk"].append(key[0].as_py())
            rows["packed"].append(short.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes())
        return pa.table(rows, pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("packed", pa.binary())]))

    return run


def answer(table: pa.Table) -> pa.Table:
    """Step 1, bucket: (chunk, bucket, bits): which of a chunk's hashes other documents have too."""
    packed = table.column("packed").to_pylist()
    sizes = [len(p) // 6 for p in packed]
    values = np.zeros((sum(sizes), 8), np.uint8)
    values[:, :6] = np.frombuffer(b"".join(packed), np.uint8).reshape(-1, 6)
    short = values.view("<u8").ravel()
    order = np.argsort(short, kind="stable")
    same = short[order] >> np.uint64(1)
    equal = same[1:] == same[:-1]
    repeated = np.zeros(len(short), bool)
    repeated[order[1:][equal]] = True
    repeated[order[:-1][equal]] = True
    repeated |= (short & np.uint64(1)) == 1
    bits = [np.packbits(part).tobytes() for part in np.split(repeated, np.cumsum(sizes)[:-1])]
    return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "bits": pa.array(bits, pa.binary())})


def _remaining(chunk: Chunk, answers: pa.Table, buckets: int) -> None:
    hashes, _ = chunk.runs()
    said = dict(zip(answers.column("bucket").to_pylist(), answers.column("bits").to_pylist(), strict=True))
    stay = np.zeros(len(hashes), bool)
    for bucket, part in _parts(bucket_of(hashes, buckets)):
        stay[part] = np.unpackbits(np.frombuffer(said[bucket], np.uint8), count=len(part)).astype(bool)
    chunk.keep(hashes[stay])


def front_code(rows: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Lengths of the prefix that each row shares with the one before, and the rests end to end."""
    shared = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        differ = rows[1:] != rows[:-1]
        shared[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    rest = np.arange(rows.shape[1])[None, :] >= shared[:, None]
    return shared.astype(np.uint8), rows[rest].tobytes()


def send_runs(buckets: int):
    """Step 2: (bucket, chunk, shared, rests, least): a chunk's sorted suffixes for each bucket, front-coded."""

    def run(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        rows = {"bucket": [], "chunk": [], "shared": [], "rests": [], "least": []}
        if docs.num_rows:
            chunk = Chunk(docs)
            _remaining(chunk, answers, buckets)
            suffixes, least, hashes, _ = chunk.suffixes()
            for bucket, part in _parts(bucket_of(hashes, buckets)):
                shared, rests = front_code(suffixes[part])
                rows["bucket"].append(bucket)
                rows["chunk"].append(key[0].as_py())
                rows["shared"].append(shared.tobytes())
                rows["rests"].append(rests)
                rows["least"].append(least[part].tobytes())
        kinds = [("bucket", pa.int64()), ("chunk", pa.int64()), ("shared", pa.binary()), ("rests", pa.binary()), ("least", pa.binary())]
        return pa.table(rows, pa.schema(kinds))

    return run


def loser_tree(runs: list[tuple[bytes, bytes]]) -> tuple[list[bytes], list[int], list[int]]:
    """Merge front-coded runs: the strings in order, the run of each, and the prefix each shares with the one before.

    ``ahead[r]`` is the prefix that run r's head shares with the last output. Of two heads the one that shares
    more is the smaller, without a look at either; heads that share as much are compared from there on, and the
    loser's prefix with the winner, the next output, is what the comparison found.
    """
    k = len(runs)
    size = 1
    while size < k:
        size *= 2
    heads: list[bytes | None] = [None] * size
    ahead, at, offset = [0] * size, [0] * size, [0] * size
    for r, (shared, rests) in enumerate(runs):
        if shared:
            heads[r], at[r], offset[r] = rests[:KEY], 1, KEY
    losers = [0] * size

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser."""
        x, y = heads[a], heads[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        p, q = ahead[a], ahead[b]
        if p != q:
            return (a, b) if p > q else (b, a)
        x, y = x[p:], y[p:]
        if x == y:
            ahead[b] = KEY
            return a, b
        n = 0
        for c, d in zip(x, y, strict=True):
            if c != d:
                break
            n += 1
        if x < y:
            ahead[b] = p + n
            return a, b
        ahead[a] = p + n
        return b, a

    def build(node: int) -> int:
        if node >= size:
            return node - size
        won, losers[node] = play(build(2 * node), build(2 * node + 1))
        return won

    winner = build(1) if size > 1 else 0
    strings: list[bytes] = []
    sources: list[int] = []
    prefixes: list[int] = []
    while (head := heads[winner]) is not None:
        strings.append(head)
        sources.append(winner)
        prefixes.append(ahead[winner])
        shared, rests = runs[winner]
        i = at[winner]
        if i < len(shared):
            p = shared[i]
            more = KEY - p
            heads[winner] = head[:p] + rests[offset[winner] : offset[winner] + more]
            ahead[winner] = p
            at[winner], offset[winner] = i + 1, offset[winner] + more
        else:
            heads[winner] = None
        node = (winner + size) >> 1
        while node:
            rival = losers[node]
            # The commonest cases of play(), in line.
            if heads[rival] is None:
                pass
            elif heads[winner] is None or ahead[rival] > ahead[winner]:
                losers[node], winner = winner, rival
            elif ahead[rival] == ahead[winner]:
                winner, losers[node] = play(winner, rival)
            node >>= 1
    return strings, sources, prefixes


def least_by_offset(rows: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For suffixes of KEY bytes: the least document of each string by the anchor's offset in it (LAST: no such string)."""
    out = np.full((len(rows), REACH), LAST, np.int64)
    weights = np.array([pow(_BASE, 2 * k + 1, 2**64) for k in range(LENGTH)], np.uint64)
    for offset in range(REACH):
        has = np.flatnonzero((rows[:, WIDTH] <= offset) & (offset <= rows[:, WIDTH + 1]))
        if not len(has):
            continue
        string = np.concatenate((rows[has, LENGTH : LENGTH + offset], rows[has, : LENGTH - offset]), axis=1)
        mixed = ((string.astype(np.uint64) + np.uint64(1)) * weights).sum(axis=1, dtype=np.uint64)
        mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        _, first, group = np.unique(mixed, return_index=True, return_inverse=True)
        if (string != string[first[group]]).any():  # two strings of one hash
            _, first, group = np.unique(np.ascontiguousarray(string).view(f"V{LENGTH}").ravel(), return_index=True, return_inverse=True)
        best = np.full(len(first), LAST, np.int64)
        np.minimum.at(best, group, least[has])
        out[has, offset] = best[group]
    return out


def merge_runs(table: pa.Table) -> pa.Table:
    """Step 3: (chunk, bucket, row, low, high, least): documents smaller than a chunk knows, by its row and offsets."""
    chunks = table.column("chunk").to_pylist()
    bucket = table.column("bucket")[0].as_py()
    mins = [np.frombuffer(m, np.int64) for m in table.column("least").to_pylist()]
    strings, sources, prefixes = loser_tree(list(zip(table.column("shared").to_pylist(), table.column("rests").to_pylist(), strict=True)))
    source = np.array(sources, np.int64)
    place = np.empty(len(source), np.int64)
    for r, m in enumerate(mins):
        place[source == r] = np.arange(len(m))
    known = np.concatenate(mins)[np.concatenate(([0], np.cumsum([len(m) for m in mins])))[source] + place]
    prefix = np.array(prefixes, np.int64)
    prefix[:1] = 0
    group = np.cumsum(prefix < KMER) - 1
    starts = np.flatnonzero(prefix < KMER)
    # Equal strings first; then groups of several different ones, at every offset.
    fresh = prefix < KEY
    class_of, firsts = np.cumsum(fresh) - 1, np.flatnonzero(fresh)
    class_least = np.minimum.reduceat(known, firsts)
    class_group = group[firsts]
    several = np.bincount(class_group, minlength=len(starts)) > 1
    found_row, found_low, found_high, found_least, found_source = [], [], [], [], []

    def tell(entry: np.ndarray, low: np.ndarray, high: np.ndarray, least: np.ndarray) -> None:
        news = least < known[entry]
        found_row.append(place[entry[news]])
        found_source.append(source[entry[news]])
        found_low.append(low[news])
        found_high.append(high[news])
        found_least.append(least[news])

    alone = np.flatnonzero(~several[group])
    tell(alone, np.zeros(len(alone), np.int64), np.full(len(alone), REACH - 1), class_least[class_of[alone]])
    mixed = np.flatnonzero(several[class_group])
    if len(mixed):
        rows = np.frombuffer(b"".join(strings[i] for i in firsts[mixed]), np.uint8).reshape(-1, KEY)
        by_offset = least_by_offset(rows, class_least[mixed])
        index = np.full(len(firsts), -1, np.int64)
        index[mixed] = np.arange(len(mixed))
        members = np.flatnonzero(several[group])
        # Stretches of offsets with the same least document.
        changes = np.concatenate((np.ones((len(mixed), 1), bool), by_offset[:, 1:] != by_offset[:, :-1]), axis=1)
        row, low = np.nonzero(changes)
        high = np.append(low[1:], 0) - 1
        high[np.append(row[1:] != row[:-1], True)] = REACH - 1
        value = by_offset[row, low]
        begin = np.searchsorted(row, np.arange(len(mixed)))
        count = np.append(begin[1:], len(row)) - begin
        own = index[class_of[members]]
        entry = np.repeat(members, count[own])
        stretch = np.repeat(begin[own], count[own]) + np.arange(len(entry)) - np.repeat(np.cumsum(count[own]) - count[own], count[own])
        tell(entry, low[stretch], high[stretch], value[stretch])
    columns = [np.concatenate(c) for c in (found_source, found_row, found_low, found_high, found_least)]
    out = {"chunk": [], "bucket": [], "row": [], "low": [], "high": [], "least": []}
    for r, part in _parts(columns[0]):
        out["chunk"].append(chunks[r])
        out["bucket"].append(bucket)
        out["row"].append(columns[1][part].astype(np.int32).tobytes())
        out["low"].append(columns[2][part].astype(np.uint8).tobytes())
        out["high"].append(columns[3][part].astype(np.uint8).tobytes())
        out["least"].append(columns[4][part].tobytes())
    return pa.table(out, pa.schema([("chunk", pa.int64()), ("bucket", pa.int64())] + [(c, pa.binary()) for c in ("row", "low", "high", "least")]))


RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))])


def cut_out(buckets: int):
    """Step 4: the result rows of a chunk."""

    def run(key: tuple, docs: pa.Table, told: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return RESULT.empty_table()
        chunk = Chunk(docs)
        answers = told.filter(told.column("bits").is_valid())
        _remaining(chunk, answers, buckets)
        suffixes, least, hashes, row_of = chunk.suffixes()
        parts = dict(_parts(bucket_of(hashes, buckets)))
        edge = np.zeros(len(chunk.bytes) + 1, np.int64)
        if len(suffixes):
            lows = np.repeat(least[:, None], REACH, axis=1)
            offsets = np.arange(REACH)
            news = told.filter(told.column("row").is_valid())
            for bucket, row, low, high, value in zip(*(news.column(c).to_pylist() for c in ("bucket", "row", "low", "high", "least")), strict=True):
                rows = parts[bucket][np.frombuffer(row, np.int32)]
                a, b, v = np.frombuffer(low, np.uint8), np.frombuffer(high, np.uint8), np.frombuffer(value, np.int64)
                inside = (offsets[None, :] >= a[:, None]) & (offsets[None, :] <= b[:, None])
                which, offset = np.nonzero(inside)
                lows[rows[which], offset] = np.minimum(lows[rows[which], offset], v[which])
            own = chunk.ids[chunk.doc]
            step = 1 << 16
            for begin in range(0, len(row_of), step):
                piece = slice(begin, begin + step)
                covers = (lows[row_of[piece]] < own[piece, None]) & (offsets >= chunk.low[piece, None]) & (offsets <= chunk.high[piece, None])
                which, offset = np.nonzero(covers)
                start = chunk.position[piece][which] - offset
                np.add.at(edge, start, 1)
                np.add.at(edge, start + LENGTH, -1)
        covered = np.cumsum(edge[:-1]) > 0
        out = {name: [] for name in RESULT.names}
        for k in range(len(chunk.ids)):
            a, b = chunk.starts[k], chunk.starts[k + 1]
            gone = covered[a:b]
            turns = np.diff(np.concatenate(([0], gone.view(np.int8), [0])))
            out["doc_id"].append(None if chunk.nulls[k] else int(chunk.ids[k]))
            out["n_bytes"].append(int(b - a))
            out["n_removed"].append(int(gone.sum()))
            out["starts"].append(np.flatnonzero(turns == 1))
            out["ends"].append(np.flatnonzero(turns == -1))
            out["n_spans"].append(len(out["starts"][-1]))
            out["kept_sha256"].append(hashlib.sha256(chunk.bytes[a:b][~gone].tobytes()).hexdigest())
        return pa.table(out, RESULT)

    return run


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, bucket_anchors: int = BUCKET_ANCHORS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the removed byte spans: starts, ends. A row per row."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).cast("binary").alias("data"))
    total = base.agg(F.coalesce(F.sum(F.octet_length("data")), F.lit(0))).first()[0]
    chunks = max(1, math.ceil(total / chunk_bytes))
    buckets = max(1, math.ceil(total * 2 / (REACH + 1) / bucket_anchors))
    # The texts are shuffled once: all three uses below are the same exchange.
    dealt = base.select(F.pmod(F.xxhash64("doc_id"), F.lit(chunks)).alias("chunk"), "doc_id", "data")
    by_chunk = dealt.groupBy("chunk")
    told = by_chunk.applyInArrow(announce(buckets), "bucket long, chunk long, packed binary")
    answers = told.groupBy("bucket").applyInArrow(answer, "chunk long, bucket long, bits binary")
    runs = by_chunk.cogroup(answers.groupBy("chunk")).applyInArrow(send_runs(buckets), "bucket long, chunk long, shared binary, rests binary, least binary")
    news = runs.groupBy("bucket").applyInArrow(merge_runs, "chunk long, bucket long, row binary, low binary, high binary, least binary")
    both = answers.unionByName(news, allowMissingColumns=True)
    kinds = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, starts array<long>, ends array<long>"
    return by_chunk.cogroup(both.groupBy("chunk")).applyInArrow(cut_out(buckets), kinds)
