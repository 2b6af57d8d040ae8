"""The driver's tables, and the archive's roles played on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodspark.operators.scratch import shared_path  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as yearly observations of customers: P is abandoned, F active, O neutral."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.concat(F.lit("Q"), F.col("o_custkey").cast("string")).alias("org"),
        F.year("o_orderdate").alias("year"),
        F.col("o_orderpriority").alias("product"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).alias("active_product"),
        (F.col("o_orderstatus") == "P").alias("abandoned"),
        F.col("o_orderkey").alias("pos"),
    )


def customer_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`custkey, tags`: the order priorities of each customer, sorted."""
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("custkey")).agg(F.sort_array(F.collect_set("o_orderpriority")).alias("tags"))
