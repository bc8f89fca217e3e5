"""Driver tables and the graphs, ratings, texts and vectors derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def customer_part_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every purchase as an edge ``user_<custkey> - item_<partkey>`` (duplicates kept)."""
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    items = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    return orders.join(items, orders.o_orderkey == items.l_orderkey).select(
        F.concat(F.lit("user_"), F.col("o_custkey").cast("string")).alias("src"),
        F.concat(F.lit("item_"), F.col("l_partkey").cast("string")).alias("dst"),
    )


def supplier_part_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second bipartite graph: ``supp_<suppkey> - item_<partkey>``; suppliers are hubs."""
    items = load(spark, sf_dir, "lineitem")
    return items.select(
        F.concat(F.lit("supp_"), F.col("l_suppkey").cast("string")).alias("src"),
        F.concat(F.lit("item_"), F.col("l_partkey").cast("string")).alias("dst"),
    )


def ratings_standin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings-shaped table: userId, movieId, rating, timestamp (quantity plays the rating)."""
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    items = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_shipdate")
    return orders.join(items, orders.o_orderkey == items.l_orderkey).select(
        F.col("o_custkey").alias("userId"),
        F.col("l_partkey").alias("movieId"),
        F.col("l_quantity").cast("double").alias("rating"),
        F.unix_timestamp(F.col("l_shipdate").cast("timestamp")).cast("long").alias("timestamp"),
    )


def event_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges ``user_<user_id> - type_<event_type>`` with the event time, for the stream replay."""
    ev = load(spark, sf_dir, "events")
    return ev.select(
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("src"),
        F.concat(F.lit("type_"), F.col("event_type")).alias("dst"),
        F.col("ts").cast("timestamp").alias("ts"),
    )
