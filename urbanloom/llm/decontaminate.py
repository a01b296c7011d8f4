"""Benchmark decontamination by SimHash of item-sized windows.

For an item of n words, the windows of n words of a text are compared with it by their shingles (runs of
``SHINGLE`` words, A-Z and other letters lower-cased). The stages, all JVM-side:

1. Shingles of every text are looked up among the benchmark's. A window with weighted similarity s >= t shares
   at least 2t/(1+t) of its m shingles with the item: starts with so many hits, and no others, can qualify.
   A text shorter than the item is one window of its whole length; with s >= t it holds at least t m of the shingles.
2. The SimHash of each such window meets those of the items of its size by multi-index Hamming blocks: with
   ``RADIUS`` + 1 blocks at least one is equal, so no pair within the radius is lost.
3. Those pairs are verified: exact similarity of the weighted shingles, sum of the smaller counts over sum of the
   larger ones, at least ``threshold``. A window of less similarity may be beyond the radius, as a fingerprint
   bounds nothing there, so the windows' and items' pairs that step 1 named are verified as well. The result is exact.

Equal texts are judged once, by the text's hash, so copies cost one window each. Items shorter than a shingle
have one shingle, all their words. Edge cases: texts and items that are null or without words match nothing;
a null id stays null in the result; repeated rows give one row per (id, item). Very long texts are read whole.
Empty tables give an empty result. Other columns are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urbanloom.llm.common import bounded, cut, shuffle_partitions, text_or_empty, words

SHINGLE = 5
THRESHOLD = 0.8
#: Of 64 bits, in blocks of 8 bits. Near-verbatim windows are within it; at similarity 0.8 the mean distance is about 10.
RADIUS = 7


def shingles(word_array: Column, width: int) -> Column:
    """Hashes of the runs of ``width`` words. The array is bound first, or it would be made again for each run."""

    def runs(w: Column) -> Column:
        count = F.size(w) - (width - 1)
        return F.when(count >= 1, F.transform(F.sequence(F.lit(1), count), lambda i: F.xxhash64(F.slice(w, i, width)))).otherwise(F.array().cast("array<bigint>"))

    return F.element_at(F.transform(F.array(word_array), runs), 1)


def simhash(hashes: Column) -> Column:
    """64 bits; a bit is 1 if it is set in over half of the hashes. Votes are counted in 32-bit lanes, which no array overflows."""
    lanes = 0x0000000100000001

    def votes(k: int) -> Column:
        return F.aggregate(hashes, F.lit(0).cast("long"), lambda total, h: total + F.shiftrightunsigned(h, k).bitwiseAND(F.lit(lanes)))

    half = F.size(hashes)
    bits = F.lit(0).cast("long")
    for k in range(32):
        total = votes(k)
        for lane in range(2):
            count = F.shiftrightunsigned(total, 32 * lane).bitwiseAND(F.lit(0xFFFFFFFF))
            shift = k + 32 * lane
            bit = 1 << shift if shift < 63 else -(1 << 63)
            bits = bits.bitwiseOR(F.when(2 * count > half, F.lit(bit)).otherwise(F.lit(0)).cast("long"))
    return bits


def weighted_similarity(a: Column, b: Column) -> Column:
    """Of two arrays of hashes as multisets: sum of the smaller counts over sum of the larger ones, by a merge of both."""
    tagged = lambda array, tag: F.transform(array, lambda x: F.struct(x.alias("x"), F.lit(tag).alias("tag")))
    none = F.struct(F.lit(0).cast("long").alias("x"), F.lit(0).alias("na"), F.lit(0).alias("nb"), F.lit(0).alias("shared"))

    def step(state: Column, item: Column) -> Column:
        same, one, two = state["x"] == item["x"], (item["tag"] == 0).cast("int"), (item["tag"] == 1).cast("int")
        return F.struct(
            item["x"].alias("x"), F.when(same, state["na"] + one).otherwise(one).alias("na"), F.when(same, state["nb"] + two).otherwise(two).alias("nb"),
            F.when(same, state["shared"]).otherwise(state["shared"] + F.least(state["na"], state["nb"])).alias("shared"),
        )

    both = F.array_sort(F.concat(tagged(a, 0), tagged(b, 1)))
    shared = F.aggregate(both, none, step, lambda state: state["shared"] + F.least(state["na"], state["nb"]))
    return F.element_at(F.transform(F.array(shared), lambda n: n / (F.size(a) + F.size(b) - n)), 1)


def window_starts(at: Column, m: Column, need: Column, whole: Column) -> Column:
    """Starts s of windows of m shingles with ``need`` of the sorted hits ``at``; 0 also where it has ``whole`` of them.

    The first hit at or behind s is at[i] for s from at[i - 1] + 1 on, and the window has enough where at[i + need - 1] is
    before s + m. These ranges are disjoint, so this is linear in the hits and starts.
    """
    count = F.size(at)

    def starts(i: Column) -> Column:
        low = F.greatest(F.lit(0), F.coalesce(F.get(at, i - 1) + 1, F.lit(0)), F.get(at, i + need - 1) - m + 1)
        return F.when(low <= F.get(at, i), F.sequence(low, F.get(at, i))).otherwise(F.array().cast("array<int>"))

    found = F.when(count >= need, F.flatten(F.transform(F.sequence(F.lit(0), count - need), starts))).otherwise(F.array().cast("array<int>"))
    first = F.when(F.size(F.filter(at, lambda p: p < m)) >= whole, F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    return F.array_union(first, found)


def benchmark_items(items: DataFrame, width: int = SHINGLE, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, n (words), width (of its shingles), grams; items without words are left out."""
    base = items.select(F.col(id_col).alias("item_id"), words(F.lower(text_or_empty(text_col))).alias("w")).where(F.size("w") > 0)
    n = F.size("w")
    short = F.array(F.xxhash64(F.slice(F.col("w"), 1, width)))
    return base.select("item_id", n.alias("n"), F.least(n, F.lit(width)).alias("width"), F.when(n < width, short).otherwise(shingles(F.col("w"), width)).alias("grams"))


def leaks(
    docs: DataFrame, items: DataFrame, *, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
    width: int = SHINGLE, threshold: float = THRESHOLD, radius: int = RADIUS,
) -> DataFrame:
    """key (md5 of a text), item_id, start_word (from 0), n_words, similarity, distance: every verified window."""
    known = cut(benchmark_items(items, width, item_id_col, item_text_col))
    widths = [r[0] for r in known.select("width").distinct().collect()]  # at most SHINGLE values
    # Less a hair, or the product's rounding would ask for one too many where it is a whole number.
    at_least = lambda share, m: F.ceil(F.lit(share) * m - F.lit(1e-6)).cast("int")
    need = lambda m: at_least(2 * threshold / (1 + threshold), m)
    sought = known.select("item_id", "n", "width", F.size("grams").alias("m"), F.explode(F.array_distinct("grams")).alias("gram"))
    sought = bounded(cut(sought))
    text = text_or_empty(text_col)
    base = docs.select(F.md5(text).alias("key"), words(F.lower(text)).alias("w"))
    hits = None
    for size in widths:
        each = base.select("key", F.posexplode(shingles(F.col("w"), size)).alias("pos", "gram"))
        found = each.join(sought.where(F.col("width") == size).select("gram", "item_id", "n", "m", "width"), "gram").select("key", "width", "item_id", "n", "m", "pos")
        hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        hits = sought.select(F.lit("").alias("key"), "width", "item_id", "n", "m", F.lit(0).alias("pos")).limit(0)
    spots = hits.groupBy("key", "width", "item_id", "n", "m").agg(F.array_sort(F.collect_set("pos")).alias("at"))
    # The window at 0 may be a whole text shorter than the item, which needs fewer hits.
    starts = window_starts(F.col("at"), F.col("m"), need(F.col("m")), at_least(threshold, F.col("m")))
    asked = cut(spots.select("key", "width", "item_id", "n", "m", F.explode(starts).alias("start")))
    windows = asked.select("key", "width", "n", "m", "start").distinct()
    windows = cut(windows)
    # One text for each key with windows: copies meet in partial sums.
    keys = bounded(cut(windows.select("key").distinct()))
    texts = docs.select(F.md5(text).alias("key"), text.alias("text")).join(keys, "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))
    parts = []
    for size in widths:
        # Cut here and below, or the optimizer would repeat the shingles for each window, and the window for each bit.
        grams = cut(texts.select("key", shingles(words(F.lower(F.col("text"))), size).alias("all")))
        parts.append(windows.where(F.col("width") == size).join(grams, "key").select("key", "width", "n", "start", F.slice("all", F.col("start") + 1, F.col("m")).alias("grams")))
    sliced = parts[0] if parts else None
    for part in parts[1:]:
        sliced = sliced.unionByName(part)
    if sliced is None:
        return known.select(F.lit("").alias("key"), "item_id", F.lit(0).alias("start_word"), F.lit(0).alias("n_words"), F.lit(0.0).alias("similarity"), F.lit(0).alias("distance")).limit(0)
    # A window cut short by a text's end is none of the item's size, unless it is the whole text.
    full = F.size("grams") == F.when(F.col("n") >= width, F.col("n") - (width - 1)).otherwise(1)
    whole = sliced.where(full | ((F.col("start") == 0) & (F.size("grams") > 0)))
    whole = cut(whole.repartition(shuffle_partitions(docs.sparkSession), "key", "start"))
    printed = cut(whole.withColumn("fp", simhash(F.col("grams"))))
    item_prints = known.withColumn("fp", simhash(F.col("grams"))).select("item_id", "n", F.col("grams").alias("item_grams"), F.col("fp").alias("item_fp"))
    return match_windows(printed, cut(item_prints), asked.select("key", "n", "start", "item_id"), threshold, radius)


def block_values(fp: Column, radius: int) -> Column:
    """The fingerprint's radius + 1 blocks as an array of (block, value)."""
    edges = [64 * k // (radius + 1) for k in range(radius + 2)]
    return F.array(*[
        F.struct(F.lit(k).alias("block"), F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1).cast("long")).alias("value"))
        for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))
    ])


def match_windows(printed: DataFrame, item_prints: DataFrame, asked: DataFrame, threshold: float, radius: int) -> DataFrame:
    """Verified pairs: those within the radius, by their blocks, and the pairs of ``asked`` that are beyond it."""
    left = printed.select("key", "n", "start", "fp", F.explode(block_values(F.col("fp"), radius)).alias("b")).select("key", "n", "start", "fp", "b.block", "b.value")
    right = item_prints.select("item_id", "n", "item_fp", F.explode(block_values(F.col("item_fp"), radius)).alias("b")).select("item_id", "n", "item_fp", "b.block", "b.value")
    near = left.join(right, ["n", "block", "value"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius).select("key", "n", "start", "item_id")
    chosen = near.unionByName(asked).distinct()
    distance = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))
    paired = chosen.join(printed.select("key", "start", "n", "grams", "fp"), ["key", "start", "n"]).join(item_prints.select("item_id", "n", "item_grams", "item_fp"), ["item_id", "n"]).withColumn("distance", distance)
    return (
        paired.withColumn("similarity", weighted_similarity(F.col("grams"), F.col("item_grams")))
        .where(F.col("similarity") >= threshold)
        .select("key", "item_id", F.col("start").alias("start_word"), (F.col("n") - F.size("item_grams") + F.size("grams")).alias("n_words"), "similarity", "distance")
    )


def find_leaks(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, item_id, n_windows, similarity, start_word, n_words: the best window of each item in each document."""
    found = leaks(docs, items, text_col=text_col, **options)
    best = F.max(F.struct(F.col("similarity"), (-F.col("start_word")).alias("early"), F.col("n_words"))).alias("best")
    by_key = cut(found.groupBy("key", "item_id").agg(F.count(F.lit(1)).alias("n_windows"), best))
    ids = docs.select(F.col(id_col).alias("doc_id"), F.md5(text_or_empty(text_col)).alias("key"))
    joined = ids.join(bounded(by_key), "key").select(
        "doc_id", "item_id", "n_windows", F.col("best.similarity").alias("similarity"), (-F.col("best.early")).alias("start_word"), F.col("best.n_words").alias("n_words")
    )
    return joined.distinct()


def drop_leaking(docs: DataFrame, items: DataFrame, *, text_col: str = "text", **options) -> DataFrame:
    """The input rows, with all their columns, whose text holds no benchmark item."""
    leaking = bounded(cut(leaks(docs, items, text_col=text_col, **options).select("key").distinct()))
    return docs.join(leaking.withColumnRenamed("key", "__key"), F.md5(text_or_empty(text_col)) == F.col("__key"), "left_anti")
