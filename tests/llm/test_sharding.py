"""Shards against the best contiguous partition by brute force."""

import collections
import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import SCHEMA, awkward, awkward_rows, empty, prose
from urbanloom.llm import sharding


def groups_of(texts):
    sizes = collections.Counter()
    for t in texts:
        sizes[hashlib.md5((t or "").encode()).hexdigest()] += len((t or "").encode()) + 8
    return [sizes[k] for k in sorted(sizes)]


def best_capacity(sizes, shards):
    """The smallest largest shard over all contiguous partitions, by dynamic programming."""
    sums = [0]
    for s in sizes:
        sums.append(sums[-1] + s)
    best = [0] + [float("inf")] * len(sizes)
    for _ in range(shards):
        best = [0] + [min(max(best[j], sums[i] - sums[j]) for j in range(i + 1)) for i in range(1, len(sums))]
    return best[-1]


def check(rows, got, shards):
    expect = collections.Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert collections.Counter((g.doc_id, g.size, g.text_crc32) for g in got) == expect
    slots, sizes, homes = collections.defaultdict(list), collections.Counter(), collections.defaultdict(set)
    for g in got:
        slots[g.shard].append(g.slot)
        sizes[g.shard] += g.size
        homes[(g.size, g.text_crc32)].add(g.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))
    assert all(len(s) == 1 for s in homes.values())
    assert max(sizes.values()) == best_capacity(groups_of([r[1] for r in rows]), shards)
    return sizes


@pytest.mark.parametrize("shards", [1, 3, 24])
def test_awkward_rows(spark, shards):
    got = sharding.assign_shards(awkward(spark), shards=shards).collect()
    check(awkward_rows(), got, shards)
    assert sharding.assign_shards(empty(spark), shards=shards).count() == 0


def documents(spark, rows):
    return spark.createDataFrame([(k, t) for k, t in rows], "doc_id long, text string").repartition(5)


def test_one_group_holds_a_third(spark):
    rows = [(k, prose(k, 20 + k % 31)) for k in range(400)]
    third = sum(len(t) for _, t in rows) // 2
    rows += [(1000 + k, prose(999, 30)) for k in range(third // len(prose(999, 30)))]
    frame = documents(spark, rows)
    got = sharding.assign_shards(frame, shards=24).collect()
    sizes = check(rows, got, 24)
    ordered = sorted(sizes.values())
    # The group stands alone and the other shards are near equal.
    assert len(sizes) == 24 and ordered[-1] > 5 * ordered[-2] and ordered[-2] < 1.35 * sum(ordered[:-1]) / 23
    again = sharding.assign_shards(frame.repartition(2), shards=24).collect()
    assert sorted((g.doc_id, g.shard, g.slot) for g in got) == sorted((g.doc_id, g.shard, g.slot) for g in again)


def test_even_where_a_greedy_pass_would_leave_shards_empty(spark):
    rows = [(k, f"{k:04d}") for k in range(25)]
    sizes = check(rows, sharding.assign_shards(documents(spark, rows), shards=24).collect(), 24)
    assert len(sizes) == 24


def test_few_blocks_are_divided_until_exact(spark, monkeypatch):
    monkeypatch.setattr(sharding, "FIRST_DIGITS", 1)
    monkeypatch.setattr(sharding, "MORE_DIGITS", 1)
    monkeypatch.setattr(sharding, "RUN", 3)
    rows = [(k, prose(k, 1 + k % 97)) for k in range(600)] + [(7, prose(7, 8))] * 10
    check(rows, sharding.assign_shards(documents(spark, rows), shards=7).collect(), 7)


def test_shards_are_written_whole(spark, tmp_path):
    docs = awkward(spark)
    plan = sharding.write_shards(docs, str(tmp_path / "shards"), shards=3, files=2)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert sorted(map(repr, back.drop("shard").collect())) == sorted(map(repr, docs.collect()))
    assert back.where(F.col("shard") != plan.shard(sharding.text_key())).count() == 0
    assert {f.name for f in docs.schema} == {f.name for f in spark.createDataFrame([], SCHEMA).schema}
    with pytest.raises(ValueError):
        sharding.write_shards(docs.withColumn("shard", F.lit(1)), str(tmp_path / "other"))
