"""Sharding by a minimax contiguous partition of ordered groups of equal texts.

Rows of equal text form a group that no cut divides; groups stand in the order of their texts' md5. The capacity of a
shard is the smallest at which a greedy pass (fill a shard as far as the capacity allows, then begin the next) needs no
more than the given shards; it is found by binary search. A group above the capacity stands alone in its shard, so one
group of copies that holds a third of all bytes does not make the others uneven; the largest shard is still the smallest
that any contiguous partition allows. The cuts then lie next to even shares of what is left, never above the capacity.

The driver never sees the groups. It holds blocks of them, by the first digits of the md5, with their bytes and whether
they are one group. A search over blocks notes each block in which a cut would have to be looked up; those blocks are
divided by two more digits on the cluster, and the search runs again until it notes none: then it is exact. A round
notes less than (64 + 2) x shards blocks of 256 parts each, whatever the size of the table.

A cut is a prefix of an md5, so a row's shard is an expression of its own text: nothing is joined. The place in a shard
is the row's rank by md5 of text and id, by sums over bins of that md5, so a shard with a third of all rows spreads over
many tasks.

Edge cases: a null text counts as an empty one (size 8, checksum 0) and shares its group; null, equal and repeated ids
are rows of their own, and rows alike in id and text take a run of places; with fewer groups than shards some shards stay
empty; an empty table gives an empty result. Columns but id and text are not read; ``write_shards`` keeps them all.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from urbanloom.llm.common import Scratch, text_or_empty

#: Bytes that a row costs besides its text.
ROW_BYTES = 8
#: Digits of the first blocks' prefixes, and digits that a division adds.
FIRST_DIGITS, MORE_DIGITS = 4, 2
#: Rows that one bin of the order within shards holds about, over all shards.
ROWS_PER_BIN = 500
#: Rows alike in id and text that are numbered in one array.
RUN = 1_000


def text_key(text_col: str = "text") -> Column:
    return F.md5(text_or_empty(text_col))


def text_bytes(text_col: str = "text") -> Column:
    return F.octet_length(text_or_empty(text_col)).cast("long") + F.lit(ROW_BYTES).cast("long")


@dataclass(frozen=True)
class ShardPlan:
    """``cuts``: where each shard but the first begins, as a prefix of the md5 ("~" is past the end)."""

    cuts: tuple[str, ...]
    capacity: int

    def shard(self, key: Column) -> Column:
        """The number of cuts at or before the key."""
        passed = [(key >= F.lit(cut)).cast("int") for cut in self.cuts]
        while len(passed) > 1:  # a balanced sum keeps the expression shallow
            passed = [a + b for a, b in zip(passed[::2], passed[1::2], strict=False)] + passed[len(passed) & ~1 :]
        return passed[0] if passed else F.lit(0)


class Blocks:
    """Blocks of groups in order; ``noted`` are those of several groups in which a boundary was looked for."""

    def __init__(self, parts: dict[str, tuple[int, int]]):
        self.prefixes = sorted(parts)
        self.single = [parts[p][1] == 1 for p in self.prefixes]
        self.starts = [0]
        for p in self.prefixes:
            self.starts.append(self.starts[-1] + parts[p][0])
        self.count, self.total = len(self.prefixes), self.starts[-1]
        self.noted: set[int] = set()

    def note(self, block: int) -> None:
        if not self.single[block]:
            self.noted.add(block)

    def below(self, at: int) -> int:
        """The last known boundary at or before a byte."""
        k = min(bisect_right(self.starts, at) - 1, self.count)
        if k < self.count and self.starts[k] < at:
            self.note(k)
        return k

    def reach(self, k: int, capacity: int) -> int:
        """How far a shard that begins at boundary k gets; a block above the capacity stands alone."""
        if k >= self.count:
            return self.count
        end = self.below(self.starts[k] + capacity)
        if end > k:
            return end
        self.note(k)
        return k + 1

    def back(self, k: int, capacity: int) -> int:
        """Where a shard that ends at boundary k begins at the earliest."""
        if k == 0:
            return 0
        at = self.starts[k] - capacity
        begin = bisect_left(self.starts, max(at, 0))
        if begin > 0 and self.starts[begin] > at > 0:
            self.note(begin - 1)
        if begin < k:
            return begin
        self.note(k - 1)
        return k - 1

    def fits(self, capacity: int, shards: int) -> bool:
        k = 0
        for _ in range(shards):
            k = self.reach(k, capacity)
        return k >= self.count

    def smallest_capacity(self, shards: int) -> int:
        low, high = 0, self.total
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (low, middle) if self.fits(middle, shards) else (middle, high)
        return high

    def cuts(self, capacity: int, shards: int) -> list[int]:
        """Boundaries nearest to even shares among those that leave a feasible rest."""
        least = [self.count]
        for _ in range(shards):
            least.append(self.back(least[-1], capacity))
        least.reverse()
        out, k = [], 0
        for n in range(1, shards):
            rest = self.total - self.starts[k]
            share = self.starts[k] + -(-rest // (shards - n + 1))
            near = self.below(share)
            if near < self.count and self.starts[near + 1] - share < share - self.starts[near]:
                near += 1
            k = max(k, min(max(near, least[n]), self.reach(k, capacity)))
            out.append(k)
        return out


def _parts(groups: DataFrame, prefix: Column) -> dict[str, tuple[int, int]]:
    found = groups.groupBy(prefix.alias("prefix")).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n")).where("prefix is not null")
    return {r.prefix: (int(r.bytes), int(r.n)) for r in found.collect()}


def plan_shards(groups: DataFrame, shards: int) -> ShardPlan:
    """``groups`` has a row for each group: key (md5, hexadecimal) and bytes. It is read once a round: pass a table."""
    parts = _parts(groups, F.substring("key", 1, FIRST_DIGITS))
    while True:
        blocks = Blocks(parts)
        capacity = blocks.smallest_capacity(shards)
        at = blocks.cuts(capacity, shards)
        if not blocks.noted:
            return ShardPlan(tuple(blocks.prefixes[k] if k < blocks.count else "~" for k in at), capacity)
        noted = [blocks.prefixes[k] for k in blocks.noted]
        finer = None
        for digits in sorted({len(p) for p in noted}):
            own = F.substring("key", 1, digits).isin([p for p in noted if len(p) == digits])
            part = F.substring("key", 1, digits + MORE_DIGITS)
            finer = F.when(own, part) if finer is None else finer.when(own, part)
        for p in noted:
            del parts[p]
        parts |= _parts(groups, finer)


def assign_shards(docs: DataFrame, *, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: a row for each row of ``docs``."""
    scratch = Scratch(docs.sparkSession)
    alike = scratch.write(
        lambda: docs.select(
            F.col(f"`{id_col}`").alias("doc_id"), text_bytes(text_col).alias("size"), F.crc32(text_or_empty(text_col).cast("binary")).alias("text_crc32"), text_key(text_col).alias("key")
        )
        .groupBy("doc_id", "size", "text_crc32", "key")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    groups = scratch.write(lambda: alike.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("bytes")))
    plan = plan_shards(groups, shards)
    bins = max(1, -(-alike.count() // ROWS_PER_BIN))
    place = F.md5(F.concat("key", F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    share = F.conv(F.substring("place", 1, 8), 16, 10).cast("double") / F.lit(float(2**32))
    rows = alike.withColumn("shard", plan.shard(F.col("key"))).withColumn("place", place).withColumn("bin", F.floor(share * F.lit(bins)))
    before = lambda over: over.rowsBetween(W.unboundedPreceding, -1)
    sums = rows.groupBy("shard", "bin").agg(F.sum("n").alias("bin_n"))
    starts = sums.select("shard", "bin", F.coalesce(F.sum("bin_n").over(before(W.partitionBy("shard").orderBy("bin"))), F.lit(0)).alias("start"))
    within = before(W.partitionBy("shard", "bin").orderBy("place", F.col("doc_id").isNull()))
    ranked = rows.withColumn("first", F.coalesce(F.sum("n").over(within), F.lit(0))).join(starts, ["shard", "bin"])
    runs = ranked.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / RUN))).alias("run"))
    return runs.select(
        "doc_id", "size", "text_crc32", "shard",
        F.explode(F.sequence(F.col("start") + F.col("first") + F.col("run") * RUN, F.col("start") + F.col("first") + F.least(F.col("run") * RUN + RUN, F.col("n")) - 1)).alias("slot"),
    )


def write_shards(docs: DataFrame, folder: str, *, shards: int = 24, files: int = 1, id_col: str = "doc_id", text_col: str = "text", shard_col: str = "shard") -> ShardPlan:
    """Write the rows of ``docs``, all columns, as Parquet in a folder for each shard, about ``files`` files each.

    A column of ``docs`` that is called like ``shard_col`` is refused.
    """
    if shard_col in docs.columns:
        raise ValueError(f"the documents have a column {shard_col}; name another shard_col")
    scratch = Scratch(docs.sparkSession)
    groups = scratch.write(lambda: docs.select(text_key(text_col).alias("key"), text_bytes(text_col).alias("size")).groupBy("key").agg(F.sum("size").alias("bytes")))
    plan = plan_shards(groups, shards)
    file = F.pmod(F.xxhash64(F.col(f"`{id_col}`"), text_key(text_col)), F.lit(files))
    docs.withColumn(shard_col, plan.shard(text_key(text_col))).repartition(F.col(shard_col), file).write.partitionBy(shard_col).parquet(folder)
    scratch.clear()
    return plan
