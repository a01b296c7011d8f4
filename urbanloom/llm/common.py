"""Helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space of the contracts: a space and U+0009 to U+000D. Written out so that Java and RE2 agree.
SPACE_RUN = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: Column | str) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("string"), F.lit(""))


def words(text: Column) -> Column:
    """The words of a text, in order; no empty strings, an empty array for an empty text."""
    return F.array_remove(F.split(text, SPACE_RUN, -1), "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The cluster's shared folder is in spark.checkpoint.dir; only a local master without it gets a folder of its own."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder and not context.master.startswith(("local[", "local*")) and context.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="urbanloom-checkpoint-"))


def cut(frame: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, which outlives lost executors."""
    ensure_checkpoint_dir(frame.sparkSession)
    return frame.checkpoint(eager)


def checkpoint_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def delete_folder(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Tables of a job's steps in the shared checkpoint folder; ``clear`` deletes them when nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.count = spark, checkpoint_folder(spark, "scratch"), 0

    def write(self, make: Callable[[], DataFrame]) -> DataFrame:
        self.count += 1
        return written(make, self.spark, f"{self.folder}/{self.count}")

    def clear(self) -> None:
        delete_folder(self.spark, self.folder)


def written(make: Callable[[], DataFrame], spark: SparkSession, folder: str | None = None) -> DataFrame:
    """What ``make`` returns, written as a table in the shared checkpoint folder and read again.

    Like cut(), but the shuffle files behind it go as soon as it is written, and the table is compressed.
    """
    folder = folder or checkpoint_folder(spark, "table")
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        make().write.parquet(folder)
    finally:
        spark.conf.set(key, before)
    return spark.read.parquet(folder)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def struct_type(fields: Iterable[tuple[str, T.DataType]]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


def crc_bucket(column: Column, modulus: int) -> Column:
    """crc32 of the value as text, modulo; a null value counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(modulus).cast("long"))


#: Narrow rows that a size-checked broadcast may hold.
MAX_BROADCAST_ROWS = 500_000


def bounded(frame: DataFrame, bound: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """The frame with a broadcast hint if its rows, counted, are within the bound; else as it is, for a shuffled join."""
    return F.broadcast(frame) if frame.limit(bound + 1).count() <= bound else frame
