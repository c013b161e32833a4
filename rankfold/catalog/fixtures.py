"""Matrices built from the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..matrix import Matrix
from ..vectors import VectorMatrix, vector_rows
from ..sources import from_columns, from_triples, from_vectors

LINE_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def purchases(spark: SparkSession, sf_dir: str) -> Matrix:
    """Customers by parts, the value being the quantity bought. Integer values, sparse."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return from_triples(joined, "o_custkey", "l_partkey", "l_quantity", dup="sum")


def embedding_rows(spark: SparkSession, sf_dir: str) -> Matrix:
    """Embedding vectors, dense."""
    return from_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def embedding_vectors(spark: SparkSession, sf_dir: str) -> VectorMatrix:
    """The same vectors, kept whole."""
    return vector_rows(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def line_columns(spark: SparkSession, sf_dir: str) -> Matrix:
    """Four numeric columns of the line items, ill-conditioned."""
    lines = table(spark, sf_dir, "lineitem")
    # (order, line) alone is not unique in these tables; the price makes the row key unique.
    key = F.concat_ws("/", "l_orderkey", "l_linenumber", F.format_string("%.2f", "l_extendedprice"))
    return from_columns(lines.withColumn("row_key", key), "row_key", LINE_COLUMNS)


def user_events(spark: SparkSession, sf_dir: str) -> Matrix:
    """Users by event types, the value being a count."""
    events = table(spark, sf_dir, "events")
    counts = events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    # One row per event type: a handful of names, ranked in alphabetical order.
    kinds = events.select("event_type").distinct()
    kinds = kinds.withColumn("col_id", F.dense_rank().over(Window.orderBy("event_type")) - 1)
    return from_triples(counts.join(kinds, "event_type"), "user_id", "col_id", "n")
