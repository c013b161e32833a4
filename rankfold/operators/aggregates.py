"""Distributed aggregates over entries and over tall tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..functions.columns import names, number, shifted

# More products than this in one aggregate switch code generation off, so Arrow batches take over.
MAX_GENERATED_PRODUCTS = 96


def column_sums(entries: DataFrame) -> DataFrame:
    """``[col_id, total]``: sum of each column over its stored entries."""
    return entries.groupBy("col_id").agg(F.sum("value").alias("total"))


def column_means(entries: DataFrame, n_rows: int) -> DataFrame:
    """``[col_id, mu]``: column sums divided by the number of rows, stored or not."""
    return entries.groupBy("col_id").agg((F.sum("value") / F.lit(float(n_rows))).alias("mu"))


def frobenius_norm_squared(entries: DataFrame, means: DataFrame, n_rows: int) -> DataFrame:
    """One row ``[norm2]``: squared Frobenius norm of the centred matrix, never densified.

    A column with n stored cells contributes n*var + n*(avg - mu)^2 for those and mu^2 for each of
    the others. Spark's variance aggregate is numerically stable, and the means meet one row per
    column instead of one per entry.
    """
    per_col = entries.groupBy("col_id").agg(
        F.count("value").alias("n"), F.avg("value").alias("avg"), F.var_pop("value").alias("var")
    )
    mu = F.col("mu")
    cells = means.join(per_col, "col_id").select(
        (F.col("n") * (F.col("var") + (F.col("avg") - mu) * (F.col("avg") - mu)) + (float(n_rows) - F.col("n")) * mu * mu)
        .alias("part")
    )
    return cells.agg(F.coalesce(F.sum("part"), F.lit(0.0)).alias("norm2"))


def absolute_column_norm(cells: DataFrame, value: str = "value") -> DataFrame:
    """One row ``[norm1]``: largest column sum of absolute values (the induced 1-norm)."""
    per_col = cells.groupBy("col_id").agg(F.sum(F.abs(F.col(value))).alias("s"))
    return per_col.agg(F.coalesce(F.max("s"), F.lit(0.0)).alias("norm1"))


def absolute_norm_of_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row ``[norm1]`` of a matrix whose columns are table columns, centred over all rows of ``df``.

    As with entries, only non-zero cells are summed. No row ids, and no exchange but one row per task.
    """
    cells = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns]
    means = df.agg(*[(F.sum(x) / F.count("*")).alias(f"m{j}") for j, x in enumerate(cells)]).first()
    centred = [F.when(x != 0, F.abs(x - F.lit(means[j]))) for j, x in enumerate(cells)]
    sums = df.agg(*[F.coalesce(F.sum(x), F.lit(0.0)).alias(f"s{j}") for j, x in enumerate(centred)])
    return sums.select(F.array_max(F.array(*[f"s{j}" for j in range(len(columns))])).alias("norm1"))


def vector_sum(table: DataFrame, cols: list[str]) -> DataFrame:
    """One row with the sum of each column of a tall table."""
    return table.agg(*[F.sum(c).alias(c) for c in cols])


def array_sum(table: DataFrame, column: str) -> DataFrame:
    """Element-wise sum of an array column: ``[pos, total]``, or ``[row, pos, total]`` of arrays of arrays.

    A task adds its batches up in one array and sends that; no element becomes a row before. Shorter arrays, null ones and
    null elements count as zeros; a position that no array has is left out.
    """
    nested = isinstance(table.schema[column].dataType.elementType, ArrayType)

    def places(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """For each element of a list array, the place in its list; and the elements."""
        lengths = values.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        return np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths), values.flatten()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((1, 0)), np.zeros((1, 0), bool)
        for batch in batches:
            place, values = places(batch.column(0))
            row = np.zeros(len(place), np.int64)
            if nested:
                inner, cells = places(values)
                lengths = values.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                row, place, values = np.repeat(place, lengths), inner, cells
            if not len(place):
                continue
            shape = max(len(total), int(row.max()) + 1), max(total.shape[1], int(place.max()) + 1)
            grow = [(0, s - t) for s, t in zip(shape, total.shape)]
            total, seen = np.pad(total, grow), np.pad(seen, grow)
            x = values.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
            total += np.bincount(row * shape[1] + place, x, minlength=total.size).reshape(shape)
            seen[row, place] = True
        row, place = np.nonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(row.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(total[seen])], ["row", "pos", "total"])

    parts = table.select(column).mapInArrow(run, "row int, pos int, total double")
    return parts.groupBy(*(["row"] if nested else []), "pos").agg(F.sum("total").alias("total"))


def _batch_products(cols: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(cols), len(cols)))
        for batch in batches:
            x = batch[cols].to_numpy(dtype=float)
            total += x.T @ x
        yield pd.DataFrame({"i": np.arange(len(cols)), "row": list(total)})

    return run


def column_products(table: DataFrame, pairs: list[tuple[str, str]]) -> dict[tuple[str, str], float]:
    """Sums of the given column products over a tall table, in one pass.

    Few products are plain aggregates. Many go through Arrow batches, one matrix product per batch
    and one partial matrix per task, summed by Spark.
    """
    if len(pairs) <= MAX_GENERATED_PRODUCTS:
        row = table.agg(*[F.expr(f"sum({a} * {b})") for a, b in pairs]).first()
        return {p: float(v or 0.0) for p, v in zip(pairs, row)}
    cols = sorted({c for p in pairs for c in p})
    index = {c: i for i, c in enumerate(cols)}
    parts = table.select(*cols).mapInPandas(_batch_products(cols), "i int, row array<double>")
    sums = parts.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    total = np.zeros((len(cols), len(cols)))
    for i, j, v in sums.collect():  # len(cols)^2 numbers, the sketch width squared
        total[i, j] = v
    return {(a, b): float(total[index[a], index[b]]) for a, b in pairs}


def product_matrix(products: dict[tuple[str, str], float], left: list[str], right: list[str]) -> np.ndarray:
    """Dense matrix of ``left`` by ``right`` products, mirrored where only (i <= j) is given."""
    out = np.empty((len(left), len(right)))
    for i, a in enumerate(left):
        for j, b in enumerate(right):
            out[i, j] = products[(a, b)] if (a, b) in products else products[(left[j], right[i])]
    return out


def _counted_products(cols: list[str]):
    products = _batch_products(cols)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = 0

        def counted() -> Iterator[pd.DataFrame]:
            nonlocal seen
            for batch in batches:
                seen += len(batch)
                yield batch

        for part in products(counted()):
            yield part.assign(n=seen)

    return run


def gram(table: DataFrame, cols: list[str]) -> DataFrame:
    """``[i, j, g, n]`` for i <= j: the Gram matrix X'X of a tall table and its row count."""
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    if len(pairs) <= MAX_GENERATED_PRODUCTS:
        sums = [F.expr(f"coalesce(sum({cols[i]} * {cols[j]}), 0.0D) AS g_{i}_{j}") for i, j in pairs]
        wide = table.agg(F.count("*").alias("n"), *sums)
        cells = ", ".join(f"struct({i} AS i, {j} AS j, g_{i}_{j} AS g, n AS n)" for i, j in pairs)
        return wide.selectExpr(f"inline(array({cells}))")
    parts = table.select(*cols).mapInPandas(_counted_products(cols), "i int, row array<double>, n bigint")
    cells = parts.select("i", F.posexplode("row").alias("j", "g"), "n").filter("i <= j")
    return cells.groupBy("i", "j").agg(F.sum("g").alias("g"), F.sum("n").alias("n"))


def centred_gram(sketch: DataFrame, cols: list[str], mean: np.ndarray, n_rows: int) -> DataFrame:
    """``[i, j, g]`` for i <= j: Gram of the centred sketch over all ``n_rows`` rows.

    Stored rows are centred before they are multiplied. A row without entries has the centred image
    -mean, so the missing rows add (n_rows - stored) * mean_i * mean_j.
    """
    centred = sketch.selectExpr(*shifted(cols, mean, "x"))
    m = f"array({', '.join(number(v) for v in mean)})"
    absent = f"({number(n_rows)} - n) * get({m}, i) * get({m}, j)"
    return gram(centred, names("x", len(cols))).selectExpr("i", "j", f"g + {absent} AS g")
