"""Phrase collocations by pivot partitioning, as in MG-FSM.

Words of each language that occur often enough get numbers, the commonest first; all others only divide the text. A
phrase's pivot is its rarest word, at the pivot's first place in the phrase. For every place of every word the task
that reads the text cuts out the fragment in which that place can be the pivot: up to ``longest - 1`` commoner words
on its left, up to as many commoner or equal words on its right. Equal fragments of a task are counted once; fragments go
to buckets by a hash of the pivot, and a bucket mines its own fragments alone and emits the phrases its pivots own.
So every occurrence of a phrase is counted in exactly one place, and common words, which are pivots of few phrases,
receive little. A phrase is counted only if its parts with the pivot were frequent enough in the bucket.

Sizes: a bucket stands for about TOKENS_PER_BUCKET words of the corpus. A pivot that occurs more often than HOT is
divided by its neighbour: phrases that go on after the pivot are mined where the pivot's right word sends them, phrases
that end with it where its left word does, so counts stay whole. What then meets in a bucket are the distinct fragments
of a pair of words, and the commoner a pivot, the fewer commoner words there are to make distinct ones of. A task holds
TOKENS_PER_FLUSH words at a time. Numbers are broadcast in slices of SLICE words; a larger vocabulary takes more
passes over the texts, whose numbers so far are written between them, and gives the same rows.

Scores are exact: products are decimals of 38 digits.

Edge cases: a null text counts as an empty one and a null language as ``und``; only A-Z are lower-cased; repeated rows
count each time; texts of any length are read whole; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from urbanloom.llm.common import Scratch, bounded, text_or_empty

#: Bytes that divide a text into pieces; 0xFF occurs in no UTF-8 text and stands for them.
DIVIDERS = b".,;:!?\n\x0b\x0c\r"
MARK = b"\xff"
FOLD = bytes.maketrans(DIVIDERS + bytes(range(65, 91)), MARK * len(DIVIDERS) + bytes(range(97, 123)))
TOKENS_PER_BUCKET = 250_000
TOKENS_PER_FLUSH = 600_000
#: Occurrences beyond which a pivot is divided.
HOT = 100_000
#: Words whose numbers one broadcast holds.
SLICE = 500_000
#: Distinct words that a task counts before it passes them on.
COUNTED = 300_000
#: Parts of a language in the first of the two rankings.
RANK_PARTS = 32
#: Multipliers of the hashes of fragments and buckets.
MIX, SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def tokens(text: bytes) -> list[bytes]:
    """The words of all pieces in order, with MARK between pieces."""
    return text.translate(FOLD).replace(MARK, b" \xff ").split()


def _inputs(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), text_or_empty(F.col(f"`{text_col}`")).cast("binary").alias("text"))


def word_counts(texts: DataFrame) -> DataFrame:
    """lang, word, n (all occurrences)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = defaultdict(Counter)

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, found in counts.items():
                found.pop(MARK, None)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["lang", "word", "n"])
            counts.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[lang].update(tokens(text))
                if len(counts[lang]) > COUNTED:
                    yield from flush()
        yield from flush()

    found = texts.mapInArrow(run, "lang string, word binary, n long")
    return found.groupBy("lang", F.col("word").cast("string").alias("word")).agg(F.sum("n").alias("n"))


def numbered(frequent: DataFrame, scratch: Scratch) -> DataFrame:
    """The words with id: dense numbers from 0, the commonest first."""
    ordered = scratch.write(lambda: frequent.orderBy(F.desc("n"), "lang", "word").withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    sizes = sorted((r.part, r["count"]) for r in ordered.groupBy(part.alias("part")).count().collect())  # a row for each partition of the sort
    start, starts = 0, []
    for k, size in sizes:
        starts.append((k, start))
        start += size
    known = F.broadcast(ordered.sparkSession.createDataFrame(starts, "part long, start long"))
    return ordered.withColumn("part", part).join(known, "part").select((F.col("start") + F.col("at").bitwiseAND((1 << 33) - 1)).cast("int").alias("id"), "lang", "word", "n")


def _numbers(lexicon: DataFrame, low: int, high: int) -> dict[str, dict[bytes, int]]:
    out: dict[str, dict[bytes, int]] = defaultdict(dict)
    for r in lexicon.where((F.col("id") >= low) & (F.col("id") < high)).select("id", "lang", "word").toLocalIterator():
        out[r.lang][r.word.encode()] = r.id
    return dict(out)


def _encoded(texts: DataFrame, numbers: dict[str, dict[bytes, int]]) -> DataFrame:
    """The texts with ids: numbers of the words found so far as 32-bit integers, -1 for others and between pieces."""
    shared = texts.sparkSession.sparkContext.broadcast(numbers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [_ids(shared.value, lang, text, before).tobytes() for lang, text, before in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.binary())], ["lang", "text", "ids"])

    return texts.mapInArrow(run, "lang string, text binary, ids binary")


def _ids(numbers: dict[str, dict[bytes, int]], lang: str, text: bytes, before: bytes | None) -> np.ndarray:
    words = tokens(text)
    found = np.fromiter(map(numbers.get(lang, {}).get, words, repeat(-1)), np.int32, len(words))
    return found if before is None else np.maximum(found, np.frombuffer(before, np.int32))


def cut_fragments(ids: np.ndarray, longest: int) -> np.ndarray:
    """A row for each place that can be a pivot with a neighbour: the pivot in the middle, -1 where the fragment ends."""
    reach = longest - 1
    edge = np.full(reach, -1, np.int32)
    padded = np.concatenate([edge, ids, edge])
    n, rows = len(ids), np.full((len(ids), 2 * reach + 1), -1, np.int32)
    rows[:, reach] = ids
    for side in (-1, 1):
        open_ = ids >= 0
        for step in range(1, reach + 1):
            near = padded[reach + side * step : reach + side * step + n]
            open_ &= (near >= 0) & ((near < ids) if side < 0 else (near <= ids))
            rows[open_, reach + side * step] = near[open_]
    return rows[(rows[:, reach - 1] >= 0) | (rows[:, reach + 1] >= 0)]


def _hashed(rows: np.ndarray) -> np.ndarray:
    h = np.zeros(len(rows), np.uint64)
    for column in rows.T:
        h = (h ^ column.astype(np.uint64)) * MIX
        h ^= h >> np.uint64(29)
    return h


def combined(rows: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows, their weights and hashes. Rows are compared in whole; two with one hash at worst stay apart."""
    h = _hashed(rows)
    order = np.argsort(h, kind="stable")
    rows, weights, h = rows[order], weights[order], h[order]
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:] != rows[:-1]).any(axis=1)
    begin = np.flatnonzero(first)
    return rows[begin], np.add.reduceat(weights, begin) if len(begin) else weights, h[begin]


def dealt(rows: np.ndarray, weights: np.ndarray, hot: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, weights and buckets. Pivots numbered below ``hot`` are divided: a row goes where its right word sends it, and
    its left part, alone, where its left word does."""
    reach = rows.shape[1] // 2
    divided = rows[:, reach] < hot
    left = rows[divided & (rows[:, reach - 1] >= 0)].copy()
    left[:, reach + 1 :] = -1
    left, left_weights, _ = combined(left, weights[divided & (rows[:, reach - 1] >= 0)])
    whole = ~divided | (rows[:, reach + 1] >= 0)
    rows, weights, divided = rows[whole], weights[whole], divided[whole]
    key = np.concatenate([
        np.where(divided, (rows[:, reach + 1].astype(np.uint64) + np.uint64(1)) * MIX, np.uint64(0)), ~((left[:, reach - 1].astype(np.uint64) + np.uint64(1)) * MIX),
    ])
    rows, weights = np.concatenate([rows, left]), np.concatenate([weights, left_weights])
    key = (rows[:, reach].astype(np.uint64) * MIX ^ key * SPREAD) * SPREAD
    key ^= key >> np.uint64(31)
    return rows, weights, ((key * MIX >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


def _planes(values: np.ndarray) -> bytes:
    """32-bit integers byte place by byte place, which compresses well."""
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int32)


def packed(rows: np.ndarray, weights: np.ndarray) -> bytes:
    reach = rows.shape[1] // 2
    left, right = (rows[:, :reach] >= 0).sum(axis=1), (rows[:, reach + 1 :] >= 0).sum(axis=1)
    near = np.delete(rows, reach, axis=1)
    return b"".join([np.uint32(len(rows)).tobytes(), left.astype(np.uint8).tobytes(), right.astype(np.uint8).tobytes(), _planes(rows[:, reach]), _planes(weights), _planes(near[near >= 0])])


def unpacked(data: bytes, longest: int) -> tuple[np.ndarray, np.ndarray]:
    reach, n = longest - 1, int(np.frombuffer(data, np.uint32, 1)[0])
    left, right = np.frombuffer(data, np.uint8, n, 4), np.frombuffer(data, np.uint8, n, 4 + n)
    at = 4 + 2 * n
    rows = np.full((n, 2 * reach + 1), -1, np.int32)
    steps = np.arange(1, reach + 1)
    used = np.concatenate([(reach + 1 - steps) <= left[:, None], np.zeros((n, 1), bool), steps <= right[:, None]], axis=1)
    rows[:, reach] = _from_planes(data[at : at + 4 * n])
    rows[used] = _from_planes(data[at + 8 * n :])
    return rows, _from_planes(data[at + 4 * n : at + 8 * n])


def _fragments(texts: DataFrame, numbers: dict[str, dict[bytes, int]], hot: int, buckets: int, longest: int) -> DataFrame:
    """bucket, fragments: the last slice's numbers are filled in, then fragments are cut, combined and dealt."""
    shared = texts.sparkSession.sparkContext.broadcast(numbers)

    def pass_on(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        rows = cut_fragments(np.concatenate(held), longest)
        if not len(rows):
            return
        rows, weights, _ = combined(rows, np.ones(len(rows), np.int64))
        rows, weights, bucket = dealt(rows, weights, hot, buckets)
        order = np.argsort(bucket, kind="stable")
        rows, weights, bucket = rows[order], weights[order], bucket[order]
        begin = np.flatnonzero(np.diff(bucket, prepend=-1))
        data = [packed(rows[a:b], weights[a:b]) for a, b in zip(begin, [*begin[1:], len(rows)], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(bucket[begin], pa.int64()), pa.array(data, pa.binary())], ["bucket", "fragments"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size, end = 0, np.array([-1], np.int32)
        for batch in batches:
            for lang, text, before in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                held += [_ids(shared.value, lang, text, before), end]
                size += len(held[-2])
                if size >= TOKENS_PER_FLUSH:
                    yield from pass_on(held)
                    held, size = [], 0
        if held:
            yield from pass_on(held)

    return texts.mapInArrow(run, "bucket long, fragments binary")


def _grouped(columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first row of each distinct row, and each row's number among them."""
    code = columns[:, 0].astype(np.int64)
    size = int(code.max()) + 1
    for column in columns.T[1:]:
        width = int(column.max()) + 1
        if size * width >= 1 << 62:
            distinct, code = np.unique(code, return_inverse=True)
            size = len(distinct)
        code = code * width + column
        size *= width
    _, first, inverse = np.unique(code, return_index=True, return_inverse=True)
    return first, inverse


def mine(rows: np.ndarray, weights: np.ndarray, hot: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Phrases that the rows' pivots own and that occur often enough, and their counts.

    A window of a words before and b after the pivot is counted only where both shorter windows have passed. Of a divided
    pivot's row that goes on to the right, windows that end with the pivot are counted elsewhere.
    """
    reach = rows.shape[1] // 2
    onward = (rows[:, reach] < hot) & (rows[:, reach + 1] >= 0)
    passed = {(0, 0): np.ones(len(rows), bool)}
    for size in range(2, reach + 2):
        for a in range(size):
            b = size - 1 - a
            open_ = (rows[:, reach - a] >= 0) & (rows[:, reach + b] >= 0)
            if a:
                open_ &= passed[a - 1, b]
            if b:
                open_ &= passed[a, b - 1]
            elsewhere = onward & open_ if b == 0 else np.zeros(len(rows), bool)
            at = np.flatnonzero(open_ & ~elsewhere)
            passed[a, b] = elsewhere
            if not len(at):
                continue
            columns = rows[at, reach - a : reach + b + 1]
            first, inverse = _grouped(columns)
            found = np.zeros(len(first), np.int64)
            np.add.at(found, inverse, weights[at])
            good = found >= least
            passed[a, b][at] = good[inverse]
            yield columns[first[good]], found[good]


def phrase_counts(texts: DataFrame, lexicon: DataFrame, n_tokens: int, least: int, longest: int, scratch: Scratch) -> DataFrame:
    """ids (array of word numbers), f: every phrase of 2 to ``longest`` words that occurs ``least`` times or more."""
    hot = lexicon.where(F.col("n") > HOT).count()  # the commonest words have the lowest numbers
    buckets = max(1, -(-n_tokens // TOKENS_PER_BUCKET))
    n_words = lexicon.count()
    texts = texts.withColumn("ids", F.lit(None).cast("binary"))
    for low in range(0, n_words - SLICE, SLICE):
        numbers = _numbers(lexicon, low, low + SLICE)
        texts = scratch.write(lambda texts=texts, numbers=numbers: _encoded(texts, numbers))
    last = max(0, -(-n_words // SLICE) - 1) * SLICE
    fragments = _fragments(texts, _numbers(lexicon, last, n_words), hot, buckets, longest)

    def run(table: pa.Table) -> pa.Table:
        read = [unpacked(x, longest) for x in table.column("fragments").to_pylist()]
        rows, weights = np.concatenate([r for r, _ in read]), np.concatenate([w for _, w in read]).astype(np.int64)
        ids, counts = [], []
        for phrases, found in mine(rows, weights, hot, least):
            ids += phrases.tolist()
            counts.append(found)
        return pa.table({"ids": pa.array(ids, pa.list_(pa.int32())), "f": pa.array(np.concatenate(counts) if counts else [], pa.int64())})

    return scratch.write(lambda: fragments.groupBy("bucket").applyInArrow(run, "ids array<int>, f long"))


def collocations(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", least: int = 100, longest: int = 5, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each language."""
    scratch = Scratch(docs.sparkSession)
    texts = _inputs(docs, text_col, lang_col)
    counted = scratch.write(lambda: word_counts(texts))
    totals = scratch.write(lambda: counted.groupBy("lang").agg(F.sum("n").alias("n")))
    lexicon = scratch.write(lambda: numbered(counted.where(F.col("n") >= least), scratch))
    phrases = phrase_counts(texts, lexicon, int(totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]), least, longest, scratch)
    part = lambda a, b: F.slice("ids", a, b)
    longer = phrases.where(F.size("ids") > 2).select(F.explode(F.array(part(F.lit(1), F.size("ids") - 1), part(F.lit(2), F.size("ids") - 1))).alias("ids"), F.col("f").alias("in_longer"))
    longer = longer.groupBy("ids").agg(F.max("in_longer").alias("in_longer"))
    kept = phrases.join(longer, "ids", "left").where(F.col("in_longer").isNull() | (F.col("in_longer") < F.col("f"))).select("ids", F.col("f").alias("a"))
    known = scratch.write(lambda: phrases.unionByName(lexicon.select(F.array("id").alias("ids"), F.col("n").alias("f"))))
    side = lambda name: known.select(F.col("ids").alias(f"{name}_ids"), F.col("f").alias(name))
    cuts = kept.select("ids", "a", F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k"))
    cuts = cuts.select("*", part(F.lit(1), F.col("k")).alias("l_ids"), part(F.col("k") + 1, F.size("ids")).alias("r_ids")).join(side("l"), "l_ids").join(side("r"), "r_ids")
    langs = lexicon.select("id", "lang").join(bounded(totals), "lang")
    cuts = cuts.withColumn("id", F.element_at("ids", 1)).join(bounded(langs), "id")
    score = F.expr("(cast(1000 as decimal(4,0)) * cast(a as decimal(15,0)) * cast(n as decimal(17,0))) div (cast(l as decimal(17,0)) * cast(r as decimal(17,0)))").cast("long")
    best = cuts.groupBy("ids", "a", "n", "lang").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    spelled = phrases.select("ids", F.posexplode("ids").alias("at", "id")).join(bounded(lexicon.select("id", "word")), "id").groupBy("ids").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("words"))
    named = best.join(spelled, "ids").select("lang", F.array_join(F.col("words.word"), " ").alias("phrase"), "a", "cut.l", "cut.r", "n", "cut.score")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    first = named.withColumn("part", F.pmod(F.hash("phrase"), F.lit(RANK_PARTS))).withColumn("rank", F.row_number().over(W.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    return first.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
