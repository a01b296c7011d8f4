"""The corpus pipeline: documents through the operators of urbanloom.llm, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanloom.llm import common, decontaminate, near_groups, quality_rules, secret_scan, source_mix


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy of the quality rules keeps."""
    return quality_rules.keep_good(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8)."""
    return near_groups.one_of_each_group(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.drop_leaking(docs, common.table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its secrets replaced by a mark."""
    return secret_scan.redact_secrets(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with the words it takes of each, repeats counted.

    Columns of the documents that are called like one of the mix's own get the suffix ``_input``.
    """
    own = ["size", "source_size", "target", "taken", "epochs", "cut"]
    taken = set(docs.columns) | set(own)
    rows = []
    for name in docs.columns:
        alias = name
        while alias in own or (alias != name and alias in taken):
            alias += "_input"
        rows.append(F.col(f"row.`{name}`").alias(alias))
    return source_mix.mix_sources(docs, carry=True).where("taken > 0").select(*rows, *own)


STAGES = [
    ("quality_rules", keep_quality),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontaminate", drop_benchmark_leaks),
    ("secret_scan", redact_secrets),
    ("source_mix", mix),
]

#: Near-duplicate groups have no SQL. Tests hold groups, leaks, secrets and mixes against brute force, stage by stage, and the
#: pipeline against its stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written as Parquet and read again by the next."""
    folder = common.checkpoint_folder(spark, "pipeline")
    docs, last = common.table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        at = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
        if last:
            common.delete_folder(spark, last)  # its rows have been read for the last time
        last = at
    return docs
