"""Filters and projections on entries and rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import hashed_unit


def drop_out_of_range(entries: DataFrame, n_cols: int) -> DataFrame:
    """Keep non-zero entries whose column id is below ``n_cols``."""
    return entries.filter((F.col("col_id") >= 0) & (F.col("col_id") < n_cols) & (F.col("value") != 0))


def cap_columns(entries: DataFrame, max_col: int | None) -> DataFrame:
    """Drop entries whose column id (before any base shift) is above ``max_col``."""
    return entries if max_col is None else entries.filter(F.col("col_id") <= max_col)


def shift_columns(entries: DataFrame, base: int) -> DataFrame:
    """Make column ids zero-based."""
    return entries.withColumn("col_id", F.col("col_id") - base) if base else entries


def deduplicate(entries: DataFrame, how: str, order: str | None = None) -> DataFrame:
    """One entry per cell: ``last`` (by the ``order`` column), ``sum``, or ``error`` on a repeat."""
    cell = entries.groupBy("row_id", "col_id")
    if how == "last":
        return cell.agg(F.max_by("value", order).alias("value"))
    if how == "sum":
        return cell.agg(F.sum("value").alias("value"))
    if how == "error":
        message = F.concat(F.lit("duplicate cell at row "), F.col("row_id").cast("string"))
        counted = cell.agg(F.count("*").alias("n"), F.max("value").alias("value"))
        checked = F.when(F.col("n") > 1, F.raise_error(message).cast("double")).otherwise(F.col("value"))
        return counted.select("row_id", "col_id", checked.alias("value"))
    raise ValueError(f"unknown duplicate policy {how!r}, use 'last', 'sum' or 'error'")


def sample_condition(rate: float, seed: int = 0) -> Column:
    """Keep-condition on ``row_id``: whole rows, repeatable, independent of the partitioning."""
    return hashed_unit("row_id", seed) < rate


def sample_rows(entries: DataFrame, rate: float, seed: int = 0) -> DataFrame:
    """Keep each matrix row, with all its entries, with probability ``rate``."""
    return entries if rate >= 1.0 else entries.filter(sample_condition(rate, seed))


def sample_exact(entries: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """Keep exactly ``n`` of the stored rows (all, if there are fewer): those with the smallest hashes.

    Spark keeps at most ``n`` ids per task; the ids kept are joined back, broadcast or not as their size tells.
    """
    rows = entries.select("row_id").distinct().withColumn("unit", hashed_unit("row_id", seed))
    return entries.join(rows.orderBy("unit", "row_id").limit(n).select("row_id"), "row_id", "left_semi")


def sample_rows_modular(entries: DataFrame, rate: float, multiplier: int = 2654435761, buckets: int = 1000) -> DataFrame:
    """Row sampling by a multiplicative hash of an integer ``row_id``, reproducible in plain SQL."""
    return entries.filter(F.pmod(F.col("row_id") * multiplier, F.lit(buckets)) < int(round(rate * buckets)))


def centre_entries(entries: DataFrame, means: DataFrame) -> DataFrame:
    """``[row_id, col_id, value]`` with the column mean taken off the stored entries only."""
    return entries.join(means, "col_id").select("row_id", "col_id", (F.col("value") - F.col("mu")).alias("value"))


def dense_cells(entries: DataFrame, n_cols: int) -> DataFrame:
    """Every cell of every stored row, zeros included: rows x ``n_cols`` records."""
    rows = entries.select("row_id").distinct()
    cells = rows.select("row_id", F.explode(F.sequence(F.lit(0), F.lit(n_cols - 1))).alias("col_id"))
    cells = cells.withColumn("col_id", F.col("col_id").cast("bigint"))
    return cells.join(entries, ["row_id", "col_id"], "left").select(
        "row_id", "col_id", F.coalesce("value", F.lit(0.0)).alias("value")
    )


def centre_dense(entries: DataFrame, means: DataFrame, n_cols: int) -> DataFrame:
    """Every cell of every stored row with the column mean taken off (a dense result)."""
    return (
        dense_cells(entries, n_cols)
        .join(means, "col_id", "left")
        .select("row_id", "col_id", (F.col("value") - F.coalesce("mu", F.lit(0.0))).alias("value"))
    )
