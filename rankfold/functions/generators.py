"""Seed matrices as tables. Every value depends on (column id, component, seed) only, so the
result is the same for any partitioning and after any task retry."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .columns import hashed_unit

# Validation matrix period and offset, and the validation noise variance.
VALIDATION_PERIOD = 10
VALIDATION_OFFSET = 1
VALIDATION_VARIANCE = 0.9644868606768501


def uniform_seed(col_id: Column, j: int, seed: int) -> Column:
    return hashed_unit(col_id, j, seed, 0)


def normal_seed(col_id: Column, j: int, seed: int) -> Column:
    """Standard normal by the Box-Muller transform of two hashed uniforms."""
    radius = F.sqrt(-2.0 * F.log(hashed_unit(col_id, j, seed, 1)))
    return radius * F.cos(2.0 * math.pi * hashed_unit(col_id, j, seed, 2))


def validation_seed(col_id: Column, j: int, seed: int = 0) -> Column:
    """Deterministic test values (i + j) mod 10 + 1; the matrix has rank at most 10."""
    return ((col_id + j) % VALIDATION_PERIOD + VALIDATION_OFFSET).cast("double")


_KINDS = {"normal": normal_seed, "uniform": uniform_seed, "validation": validation_seed}


def seed_table(
    spark: SparkSession, n_cols: int, width: int, kind: str = "normal", seed: int = 0, prefix: str = "w"
) -> DataFrame:
    """``[col_id, w0..w{width-1}]`` with one row per matrix column."""
    if kind not in _KINDS:
        raise ValueError(f"unknown generator {kind!r}, use one of {sorted(_KINDS)}")
    make = _KINDS[kind]
    ids = spark.range(n_cols).withColumnRenamed("id", "col_id")
    return ids.select("col_id", *[make(F.col("col_id"), j, seed).alias(f"{prefix}{j}") for j in range(width)])


def initial_variance(kind: str = "normal", seed: int = 0) -> float:
    """Starting noise variance of the EM iteration: fixed for validation, else uniform in (0, 1)."""
    if kind == "validation":
        return VALIDATION_VARIANCE
    import random

    return random.Random(seed).random()
