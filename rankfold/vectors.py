"""Dense matrices kept as one array per row.

Spelling a dense row out as entries multiplies its size; here a pass is one matrix product per Arrow
batch instead. It needs the column-sized operand in every task, so it is used only while that is
provably small; beyond, the same matrix is laid out as entries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from .functions.columns import names
from .functions.session import kept
from .matrix import BROADCAST_BYTES, Layout, Matrix, table_bytes


@dataclass(frozen=True)
class VectorMatrix:
    """``rows[row_id, features]``; shorter rows are padded with zeros, longer ones than ``n_cols`` are an error."""

    rows: DataFrame
    n_rows: int | None = None
    n_cols: int | None = None

    @property
    def entries(self) -> DataFrame:
        """The non-zero cells as ``[row_id, col_id, value]``."""
        return _explode(self.rows)

    def measured(self) -> VectorMatrix:
        """Fill in missing dimensions: the number of records, and the longest array."""
        if self.n_rows is not None and self.n_cols is not None:
            return self
        rows, longest = self.rows.agg(F.count("*"), F.max(F.size("features"))).first()
        return replace(
            self,
            n_rows=self.n_rows if self.n_rows is not None else rows,
            n_cols=self.n_cols if self.n_cols is not None else max(0, longest or 0),
        )

    def lay_out(self, width: int, *, broadcast_bytes: int = BROADCAST_BYTES, partitions: int | None = None) -> Layout:
        m = self.measured()
        if table_bytes(m.n_cols, width) <= broadcast_bytes:
            return VectorLayout(m, width, broadcast_bytes, partitions)
        return Matrix(m.entries, m.n_rows, m.n_cols).lay_out(width, broadcast_bytes=broadcast_bytes, partitions=partitions)


def vector_rows(df: DataFrame, row: str, vector: str, *, n_rows: int | None = None, n_cols: int | None = None) -> VectorMatrix:
    """One vector per record with a unique row id: an array of numbers or an ML vector."""
    array = F.col(vector) if isinstance(df.schema[vector].dataType, ArrayType) else vector_to_array(vector)
    return VectorMatrix(df.select(F.col(row).alias("row_id"), array.alias("features")), n_rows, n_cols)


@dataclass(frozen=True)
class ColumnMatrix(Matrix):
    """A few table columns as matrix columns; ``entries`` are the non-zero cells of ``records[row_id, features]``.

    The analyses go over one array per row, not over one entry per cell. Records with one row id add up; a row without
    a non-zero cell is not stored.
    """

    records: DataFrame | None = None

    def measured(self) -> VectorMatrix:
        """The records summed per row id and written once; measuring and all passes scan that table."""
        cells = ", ".join(f"coalesce(sum(features[{j}]), 0.0D)" for j in range(self.n_cols))
        stored = self.records.filter("exists(features, x -> x <> 0)")
        rows = stored.groupBy("row_id").agg(F.expr(f"array({cells})").alias("features"))
        return VectorMatrix(kept(rows, "rows"), self.n_rows, self.n_cols).measured()

    def stored(self, path: str | None = None) -> Matrix:
        return Matrix(self.entries, self.n_rows, self.n_cols, self.n_entries, self.drop_outside).stored(path)

    def lay_out(self, width: int, *, broadcast_bytes: int = BROADCAST_BYTES, partitions: int | None = None) -> Layout:
        return self.measured().lay_out(width, broadcast_bytes=broadcast_bytes, partitions=partitions)


def column_rows(df: DataFrame, row: str, columns: list[str], *, n_rows: int | None = None) -> ColumnMatrix:
    """Table columns as matrix columns 0, 1, ... ; zeros are left out."""
    records = df.select(F.col(row).alias("row_id"), F.array(*[F.col(c).cast("double") for c in columns]).alias("features"))
    return ColumnMatrix(_explode(records), n_rows, len(columns), records=records)


def _explode(rows: DataFrame) -> DataFrame:
    cells = rows.select("row_id", F.posexplode("features").alias("col_id", "value"))
    cells = cells.select("row_id", F.col("col_id").cast("bigint").alias("col_id"), F.col("value").cast("double").alias("value"))
    return cells.filter("value <> 0")


def _block(batch: pa.RecordBatch, n_cols: int) -> np.ndarray:
    """The rows of a batch as a matrix; a NULL cell is 0."""
    flat = batch.column("features").flatten()
    if flat.null_count:
        flat = flat.fill_null(0.0)
    return flat.to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(-1, n_cols)


class VectorLayout(Layout):
    """Rows cached as arrays, passes as matrix products."""

    def __init__(self, matrix: VectorMatrix, width: int, broadcast_bytes: int, partitions: int | None):
        self.matrix = matrix
        self.n_rows, self.n_cols = matrix.n_rows, matrix.n_cols
        self.spark = matrix.rows.sparkSession
        self.limit = broadcast_bytes
        self.kind = "vectors"
        self.row_blocks = self.col_blocks = 1
        self._saved_conf = None
        d = self.n_cols
        fitted = (
            f"CASE WHEN size(features) = {d} THEN features WHEN size(features) > {d} THEN "
            f"raise_error('a vector is longer than the matrix is wide') "
            f"ELSE concat(features, array_repeat(0, {d} - size(features))) END AS features"
        )
        rows = matrix.rows.filter("features IS NOT NULL").selectExpr("row_id", fitted)
        self.rows = rows.repartition(partitions) if partitions else rows

    def __enter__(self) -> VectorLayout:
        self.rows = self.rows.persist(StorageLevel.MEMORY_AND_DISK)
        self.entries = _explode(self.rows)
        return self

    def __exit__(self, *exc) -> None:
        self.rows.unpersist()

    def _count_rows(self) -> int:
        return self.rows.count()

    def _dense(self, table: DataFrame, cols: list[str]) -> np.ndarray:
        """A column-sized operand, below the broadcast limit by choice of this layout."""
        if not self._small(self.n_cols, len(cols)):
            raise ValueError("operand too wide for the layout, lay the matrix out for a larger width")
        found = table.select("col_id", *cols).toPandas()
        dense = np.zeros((self.n_cols, len(cols)))
        dense[found["col_id"].to_numpy()] = found[cols].to_numpy(dtype=float)
        return dense

    def sketch(self, table: DataFrame, cols: list[str], prefix: str = "z", where: Column | None = None) -> DataFrame:
        shared, n_cols = self.spark.sparkContext.broadcast(self._dense(table, cols)), self.n_cols
        out = names(prefix, len(cols))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                z = _block(batch, n_cols) @ shared.value
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row_id"), *[pa.array(np.ascontiguousarray(z[:, j])) for j in range(z.shape[1])]], names=["row_id", *out]
                )

        rows = self.rows if where is None else self.rows.filter(where)
        kind = rows.schema["row_id"].dataType.simpleString()
        return rows.mapInArrow(run, ", ".join([f"row_id {kind}", *[f"{c} double" for c in out]]))

    def normal_image(self, table: DataFrame, cols: list[str], mean: np.ndarray, prefix: str = "c") -> DataFrame:
        """One scan: each task adds up X'(X*W - 1*mean) over its batches, Spark adds up the tasks."""
        shared, n_cols = self.spark.sparkContext.broadcast((self._dense(table, cols), mean)), self.n_cols
        out = names(prefix, len(cols))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w, m = shared.value
            total = None
            for batch in batches:
                x = _block(batch, n_cols)
                part = x.T @ (x @ w - m)
                total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(n_cols)), *[pa.array(np.ascontiguousarray(total[:, j])) for j in range(total.shape[1])]],
                    names=["col_id", *out],
                )

        parts = self.rows.select("features").mapInArrow(run, ", ".join(["col_id bigint", *[f"{c} double" for c in out]]))
        return parts.groupBy("col_id").agg(*[F.expr(f"sum({c}) AS {c}") for c in out])

    def cross(self, z: DataFrame, cols: list[str], prefix: str = "c") -> DataFrame:
        joined = self.entries.join(z.select("row_id", *cols), "row_id")
        return joined.groupBy("col_id").agg(*[F.expr(f"sum(value * {c}) AS {prefix}{j}") for j, c in enumerate(cols)])

    def column_means(self) -> DataFrame:
        n_cols, n_rows = self.n_cols, self.n_rows

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(n_cols)
            for batch in batches:
                total += _block(batch, n_cols).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n_cols)), pa.array(total)], names=["col_id", "s"])

        sums = self.rows.select("features").mapInArrow(run, "col_id bigint, s double")
        return sums.groupBy("col_id").agg((F.sum("s") / F.lit(float(n_rows))).alias("mu"))
