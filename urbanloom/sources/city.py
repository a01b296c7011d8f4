"""A deterministic city derived from the star-schema tables: one location per supplier."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WALK_KMH = 20.0
SPACING = 1000.0
HALF = 500.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def size(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    """Locations and the side of the square they are laid out on; a count from the files' footers."""
    n = table(spark, sf_dir, "supplier").count()
    return n, max(1, math.ceil(math.sqrt(n)))


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """loc_idx, location_id, x, y."""
    _, side = size(spark, sf_dir)
    idx = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        idx.alias("loc_idx"),
        F.concat(F.lit("L"), idx.cast("string")).alias("location_id"),
        ((idx % side) * SPACING).cast("double").alias("x"),
        (F.floor(idx / side) * SPACING).cast("double").alias("y"),
    )


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o_idx (residence), d_idx (workplace), quantity: one row per line item."""
    n, _ = size(spark, sf_dir)
    orders = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % n).alias("o_idx"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("d_idx"), F.col("l_quantity").cast("double").alias("quantity"))
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("o_idx", "d_idx", "quantity")


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trips(spark, sf_dir).groupBy("o_idx", "d_idx").agg(F.count(F.lit(1)).alias("flow"))


def raw_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites with population, employment_raw, rent_raw and land_area, before balancing."""
    n, _ = size(spark, sf_dir)
    trip = trips(spark, sf_dir)
    population = trip.groupBy(F.col("o_idx").alias("loc_idx")).agg(F.count(F.lit(1)).cast("double").alias("population"))
    lines = table(spark, sf_dir, "lineitem")
    employment = lines.groupBy(F.col("l_suppkey").alias("loc_idx")).agg(F.sum(F.col("l_quantity").cast("double")).alias("employment_raw"))
    rents = table(spark, sf_dir, "part").groupBy((F.col("p_partkey") % n).alias("loc_idx")).agg(F.avg(F.col("p_retailprice").cast("double")).alias("rent_raw"))
    joined = sites(spark, sf_dir).join(population, "loc_idx", "left").join(employment, "loc_idx", "left").join(rents, "loc_idx", "left")
    return joined.withColumns({"population": F.coalesce("population", F.lit(0.0)), "employment_raw": F.coalesce("employment_raw", F.lit(0.0)), "land_area": F.lit(1e6)})
