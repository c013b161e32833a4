"""Matrices from tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark import RDD
from pyspark.ml.linalg import Vector, VectorUDT
from pyspark.ml.linalg import Vectors as MLVectors
from pyspark.mllib.linalg.distributed import IndexedRowMatrix, RowMatrix
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from ..matrix import Matrix
from ..operators.entries import deduplicate
from ..vectors import column_rows


def from_triples(
    df: DataFrame, row: str, col: str, value: str, *, dup: str | None = None, n_rows: int | None = None, n_cols: int | None = None
) -> Matrix:
    """A coordinate table. ``dup`` merges repeated cells ('sum' or 'error'); None trusts them unique."""
    entries = df.select(F.col(row).alias("row_id"), F.col(col).cast("bigint").alias("col_id"), F.col(value).cast("double").alias("value"))
    return Matrix(deduplicate(entries, dup) if dup else entries, n_rows, n_cols)


def from_vectors(df: DataFrame, row: str, vector: str, *, n_rows: int | None = None, n_cols: int | None = None) -> Matrix:
    """One vector per row: an array of numbers, or an ML vector. Zeros are left out.

    A sparse ML vector costs as much as it stores, whatever its length.
    """
    if isinstance(df.schema[vector].dataType, ArrayType):
        cells = df.select(F.col(row).alias("row_id"), F.posexplode(vector).alias("col_id", "value"))
    else:
        v = F.unwrap_udt(F.col(vector))
        place = F.when(v["type"] == 0, v["indices"]).otherwise(F.sequence(F.lit(0), F.size(v["values"]) - 1))
        pairs = F.when(F.size(v["values"]) > 0, F.arrays_zip(place.alias("i"), v["values"].alias("x")))
        cells = df.select(F.col(row).alias("row_id"), F.inline(pairs).alias("col_id", "value"))
    entries = cells.select("row_id", F.col("col_id").cast("bigint").alias("col_id"), F.col("value").cast("double").alias("value"))
    return Matrix(entries.filter("value <> 0"), n_rows, n_cols)


def _ml_vector(v) -> Vector:
    """The vector type of DataFrames; sparse vectors stay sparse."""
    if isinstance(v, Vector):
        return v
    return v.asML() if hasattr(v, "asML") else MLVectors.dense(v)


def from_rdd(spark: SparkSession, rows: RDD, *, n_rows: int | None = None, n_cols: int | None = None) -> Matrix:
    """An RDD of vectors: of pyspark.ml, of pyspark.mllib, or sequences of numbers.

    Row ids are the places in the RDD, so they are stable as long as the RDD's partitions are; numbering takes one job
    that counts all but the last partition. Vectors are handed over one by one: that is what an RDD costs.
    """
    schema = StructType([StructField("row_id", LongType(), False), StructField("features", VectorUDT(), True)])
    numbered = rows.zipWithIndex().map(lambda pair: (pair[1], None if pair[0] is None else _ml_vector(pair[0])))
    return from_vectors(spark.createDataFrame(numbered, schema), "row_id", "features", n_rows=n_rows, n_cols=n_cols)


def from_row_matrix(matrix: RowMatrix | IndexedRowMatrix, *, n_rows: int | None = None, n_cols: int | None = None) -> Matrix:
    """A distributed matrix of pyspark.mllib. A RowMatrix is numbered by place, an IndexedRowMatrix keeps its indices.

    Rows of an IndexedRowMatrix with one index add up.
    """
    spark = SparkSession.active()
    if isinstance(matrix, RowMatrix):
        return from_rdd(spark, matrix.rows, n_rows=n_rows, n_cols=n_cols)
    schema = StructType([StructField("row_id", LongType(), False), StructField("features", VectorUDT(), True)])
    rows = spark.createDataFrame(matrix.rows.map(lambda r: (r.index, _ml_vector(r.vector))), schema)
    entries = from_vectors(rows, "row_id", "features").entries
    return Matrix(deduplicate(entries, "sum"), n_rows, n_cols)


def from_columns(df: DataFrame, row: str, columns: list[str], *, n_rows: int | None = None) -> Matrix:
    """Table columns as matrix columns 0, 1, ... ; zeros are left out. Records with one row id are one row."""
    return column_rows(df, row, columns, n_rows=n_rows)


def read_matrix(spark: SparkSession, path: str, *, n_rows: int | None = None, n_cols: int | None = None, partitions: int | None = None, drop_outside: bool = False) -> Matrix:
    """A matrix from parquet, as ``(row_id, col_id, value)`` or ``(row_id, features)``.

    Zeros are dropped; entries outside ``n_cols`` are an error unless ``drop_outside`` is set. ``partitions`` asks for a parallelism other
    than that of the scan.
    """
    df = spark.read.parquet(path)
    if "features" in df.columns:
        matrix = from_vectors(df, "row_id", "features", n_rows=n_rows, n_cols=n_cols)
    else:
        matrix = from_triples(df, "row_id", "col_id", "value", n_rows=n_rows, n_cols=n_cols)
    entries = replace(matrix, drop_outside=drop_outside).clean()
    if partitions:
        entries = entries.repartition(partitions)
    return Matrix(entries, n_rows, n_cols)
