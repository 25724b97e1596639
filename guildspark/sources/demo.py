"""Abundance tables derived from the supplied star schema, in the library's long form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of lineitem that a task of a shuffle gets at most, about.
LANE_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lanes(rows: DataFrame, most: int) -> int:
    """Partitions for a shuffle of these rows: the session's number, and more where one would get over `most`, so that what a task sorts does not grow with the table."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // most))


def _bought(spark: SparkSession, sf_dir: str, part: DataFrame) -> DataFrame:
    """(sample_id, feature, value): the quantity that each customer bought of the parts (p_partkey, feature)."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("sample_id"))
    n = lanes(li, LANE_ROWS)
    of_part = li.repartition(n, "l_partkey").join(part.repartition(n, "p_partkey"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "feature", "l_quantity")
    joined = of_part.repartition(n, "l_orderkey").join(orders.repartition(n, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select("sample_id", "feature", "l_quantity").repartition(n, "sample_id").groupBy("sample_id", "feature").agg(F.sum("l_quantity").alias("value"))


def bacteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers x brands: (sample_id, feature, value) with the quantity bought; sparse."""
    return _bought(spark, sf_dir, table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("feature")))


def bacteria_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As bacteria(), with taxonomy strings `p_<type>;g_<brand>` as features."""
    return _bought(spark, sf_dir, table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("p_"), "p_type", F.lit(";g_"), "p_brand").alias("feature")))


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers x brands."""
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_quantity")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    joined = li.join(part, li["l_partkey"] == part["p_partkey"])
    return joined.groupBy(F.col("l_suppkey").alias("sample_id"), F.col("p_brand").alias("feature")).agg(F.sum("l_quantity").alias("value"))


def dense_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier, nation, region = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    return supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("s_suppkey").alias("sample_id"), F.col("r_name").alias("condition"))


def fungi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users x event types: the number of events."""
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("sample_id"), F.col("event_type").alias("feature")).agg(F.count("*").cast("double").alias("value"))


def conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata: (sample_id, condition), the customer's market segment."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sample_id"), F.col("c_mktsegment").alias("condition"))
