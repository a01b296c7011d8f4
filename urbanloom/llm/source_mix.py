"""Mixing sources to target weights by hash-random order and distributed prefix sums.

Targets: sources in code point order, null last, weigh ``weights`` in turn and share all words; none may
exceed ``max_epochs`` times its own size, and the excess is shared again by weight until none is above.
That fixed point is a water level: target = min(max_epochs * size, level * weight). Sorted by how soon they
reach their limit, the sources below the level are a prefix, found by running sums over one row per source.

Order within a source: md5 of the id (a hash-random key), then the id, then the size. The hash range is
split into as many buckets as the source's rows need, so that a source with a third of all rows spreads
over many tasks. Sums by bucket give each bucket's start; running sums inside a bucket give each document's
place; the mix takes whole epochs and then the words before the budget's cut, which falls at the exact word.

Edge cases: a null text has size 0 and is taken 0 times; a null source is a source of its own, last;
a null id sorts as the empty key. Repeated rows are rows of their own, in either order, with equal results
for equal rows up to the cut. An empty table gives an empty result. Columns but id, text, source are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from urbanloom.llm.common import cut, text_or_empty, word_count

#: With up to this number of sources their targets are broadcast; with more, they are joined by a shuffle.
MAX_BROADCAST_SOURCES = 50_000
#: Rows that one bucket of the hash range holds about.
ROWS_PER_BUCKET = 2_000


def source_targets(sizes: DataFrame, weights: Sequence[int] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """The columns of ``sizes`` (one row per source, with source and source_size) and target."""
    ordered = W.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.row_number().over(ordered) - 1, F.lit(len(weights))) + 1)
    everything = W.partitionBy()
    ranked = sizes.withColumn("weight", weight).withColumn("full", max_epochs * F.col("source_size").cast("double"))
    rising = W.orderBy(F.col("full") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = rising.rowsBetween(W.unboundedPreceding, -1)
    running = (
        ranked.withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("weights_from", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("full_before", F.coalesce(F.sum("full").over(before), F.lit(0.0)))
        .withColumn("level_if", (F.col("total") - F.col("full_before")) / F.col("weights_from"))
    )
    # The level is that of the first source that stays below its limit; it falls from there on.
    level = F.max(F.when(F.col("level_if") * F.col("weight") <= F.col("full"), F.col("level_if"))).over(everything)
    target = F.when(level.isNull(), F.col("full")).otherwise(F.least(F.col("full"), level * F.col("weight")))
    return running.select(*sizes.columns, target.alias("target"))


def mix_sources(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = (1, 2, 3),
    max_epochs: int = 3,
    rows_per_bucket: int = ROWS_PER_BUCKET,
    carry: bool = False,
) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, epochs (whole ones), cut (true at the budget's cut).

    With ``carry`` the whole input row comes along as the struct ``row``, for a pipeline that needs the texts.
    """
    size = word_count(text_or_empty(text_col))
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    source = F.col(source_col).cast("string")
    rows = docs.select(
        *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []),
        F.col(id_col).alias("doc_id"), source.alias("source"), size.cast("long").alias("size"), key.alias("key"),
        F.when(source.isNull(), "null").otherwise(F.concat(F.lit("is "), source)).alias("skey"),
    )
    base = cut(rows.drop("row"))  # what is summed reads a few bytes a row
    sizes = base.groupBy("skey", "source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    targets = source_targets(sizes, weights, max_epochs).select("skey", "source_size", "n_rows", "target")
    known = targets.limit(MAX_BROADCAST_SOURCES + 1).collect()
    if len(known) <= MAX_BROADCAST_SOURCES:
        targets = F.broadcast(docs.sparkSession.createDataFrame(known, targets.schema))
    buckets = F.greatest(F.lit(1), F.ceil(F.col("n_rows") / F.lit(float(rows_per_bucket)))).cast("long")
    share = F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / F.lit(float(2**32))
    bucketed = lambda frame: frame.join(targets, "skey").withColumn("bucket", F.floor(share * buckets))
    sums = bucketed(base).groupBy("skey", "bucket").agg(F.sum("size").alias("bucket_size"))
    starts = sums.select(
        "skey", "bucket",
        F.coalesce(F.sum("bucket_size").over(W.partitionBy("skey").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("bucket_start"),
    )
    within = W.partitionBy("skey", "bucket").orderBy("key", F.col("doc_id").isNull(), "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    ranked = bucketed(rows if carry else base).withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0)))
    joined = ranked.join(starts, ["skey", "bucket"])
    budget = F.floor(F.col("target")).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.greatest(F.col("source_size"), F.lit(1)))).otherwise(F.lit(0)).cast("long")
    rest = budget - epochs * F.col("source_size")
    place = F.col("bucket_start") + F.col("before")
    partial = F.least(F.col("size"), F.greatest(F.lit(0).cast("long"), rest - place)).cast("long")
    return joined.select(
        *(["row"] if carry else []), "doc_id", "source", "size", "source_size", "target",
        (epochs * F.col("size") + partial).alias("taken"),
        epochs.alias("epochs"),
        ((partial > 0) & (partial < F.col("size"))).alias("cut"),
    )
