"""Probabilistic PCA by expectation maximisation."""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.absolute import absolute_sums
from ..functions.columns import combine, linear, names, number, triangle
from ..functions.generators import initial_variance, seed_table
from ..functions.session import kept
from ..matrix import BROADCAST_BYTES, Layout, Matrix
from ..operators.aggregates import column_products, frobenius_norm_squared, product_matrix
from ..operators.entries import sample_condition
from ..operators.products import long_components, paired_blocks, wide_components
from ..sinks.stats import metrics_table
from .iteration import State, image, start


@dataclass
class PpcaResult:
    """``components[col_id, comp, loading]`` (not orthonormal), the noise variance, and metrics."""

    components: DataFrame
    variance: float
    metrics: DataFrame
    error: float | None
    n_iter: int


def expected_variance_term(inverse: np.ndarray, image_gram: np.ndarray) -> float:
    """Sum over rows of x_i . (y_i - mu)C for the new C = (Y'X)*inverse.

    It equals trace(C' Y'X), so the inner products of Y'X already hold it: no pass over the rows.
    """
    return float(np.trace(inverse.T @ image_gram))


def ppca(
    matrix: Matrix,
    k: int,
    *,
    max_iter: int = 3,
    tol: float = 1e-5,
    err_tol: float = 0.02,
    sample_rate: float | None = None,
    kind: str = "uniform",
    seed: int = 0,
    app: str = "ppca",
    dataset: str = "Untitled",
    broadcast_bytes: int = BROADCAST_BYTES,
    partitions: int | None = None,
) -> PpcaResult:
    """Loadings C of the probabilistic PCA model of the column-centred matrix.

    A round is one pass over the data. It ends after ``max_iter`` rounds, when the noise variance
    changes by at most ``tol`` relatively, or, if ``sample_rate`` is given, when the relative 1-norm
    reconstruction error is at most ``err_tol``. ``sample_rate=1.0`` computes it on all rows, a smaller
    one on that share of them; None runs no error job. ``kind='validation'`` starts from fixed values.
    """
    if max_iter < 1:
        raise ValueError("max_iter must be at least 1")
    began = time.perf_counter()
    spark = matrix.entries.sparkSession
    matrix = matrix.measured()
    n_cells = float(matrix.n_rows) * float(matrix.n_cols)
    records, error, used = [], None, 0
    with matrix.lay_out(k, broadcast_bytes=broadcast_bytes, partitions=partitions) as layout:
        state = start(layout, seed_table(spark, matrix.n_cols, k, kind, seed), k)
        variance = initial_variance(kind, seed)
        norm2 = frobenius_norm_squared(layout.entries, state.table.select("col_id", "mu"), matrix.n_rows).first()[0]
        cols = state.w
        gram = product_matrix(column_products(state.table, triangle(cols, cols)), cols, cols)
        # The first state holds C itself; the E step turns it into the regression matrix M.
        previous, table, prefix, mean = None, state.table, "w", state.mean
        loadings = np.eye(k)
        preprocess = time.perf_counter() - began
        for iteration in range(max_iter):
            began = time.perf_counter()
            s_x = np.linalg.inv(variance * np.eye(k) + gram)
            coef = loadings @ s_x.T
            step = State(table.selectExpr("col_id", "mu", *combine(names(prefix, k), coef, "w")), k, mean @ coef)
            made = image(layout, step)
            x_gram = made.gram + variance * s_x
            loadings = np.linalg.inv(x_gram)
            gram = loadings.T @ made.image_gram @ loadings
            cross = expected_variance_term(loadings, made.image_gram)
            variance = float((norm2 + np.trace(x_gram @ gram) - 2.0 * cross) / n_cells)
            table, prefix, mean = made.table, "c", made.mean
            change = np.inf if previous is None else abs(1.0 - variance / previous)
            previous, used = variance, iteration + 1
            seconds = time.perf_counter() - began
            if sample_rate is not None:
                fitted = table.selectExpr("col_id", "mu", *names("w", k), *combine(made.c, loadings, "v"))
                error = reconstruction_error(layout, fitted, k, step.mean, sample_rate, seed)
            records.append((app, dataset, matrix.n_rows, matrix.n_cols, iteration, preprocess, seconds, error, None))
            if change <= tol or (error is not None and error <= err_tol):
                break
    vectors = table.selectExpr("col_id", *combine(names(prefix, k), loadings, "v"))
    components = long_components(vectors, names("v", k))
    return PpcaResult(components, variance, metrics_table(spark, records), error, used)


def _absolute_sums(row_ids: np.ndarray, x: np.ndarray, col_ids: np.ndarray, c: np.ndarray) -> pd.DataFrame:
    """Per column, the sum over rows of |x . c - z|; the last column of ``c`` is z."""
    return pd.DataFrame({"col_id": col_ids, "dense": absolute_sums(np.column_stack([x, -np.ones(len(x))]), c)})


def _dense_sums(x: DataFrame, k: int, table: DataFrame, n_rows: int, n_cols: int) -> DataFrame:
    """``[col_id, dense]``: per column of ``table[col_id, v0.., z]`` the sum over all rows of X of |x . v - z|."""
    columns = [*names("v", k), "z"]
    parts = paired_blocks(
        x, names("x", k), table, columns, n_rows, n_cols, _absolute_sums, "col_id bigint, dense double", BROADCAST_BYTES
    )
    return parts.groupBy("col_id").agg(F.sum("dense").alias("dense"))


def column_error_sums(layout: Layout, fitted: DataFrame, k: int, x_mean: np.ndarray, rate: float = 1.0, seed: int = 0) -> DataFrame:
    """``[col_id, err, norm]``: per column the sums of |X*C' - A| and |A| over the sampled rows.

    ``fitted[col_id, mu, w0.., v0..]`` holds the regression matrix M (w) and the loadings C (v), and
    ``x_mean`` is mu'*M. With d = x.c - z for z = x_mean.c - mu, a cell without entry has the error
    |d| and a stored cell |d - y|. So the dense sums of |d| are sums over pairs of blocks, most of whose cells
    have one sign (:func:`absolute_sums`), and the stored cells are a correction joined in: the dense matrix is never built.
    """
    where = sample_condition(rate, seed) if rate < 1.0 else None
    w, v = names("w", k), names("v", k)
    x = layout.sketch(fitted, w, "x", where).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        sampled = x.count()
        present = sampled if where is None else layout.present_rows()
        # Rows without entries are alike; a sample holds their share.
        absent = (layout.n_rows - present) * min(rate, 1.0)
        c = fitted.selectExpr("col_id", "mu", *v, f"{linear(v, x_mean)} - mu AS z")
        dense = _dense_sums(x, k, c, layout.n_rows, layout.n_cols)
        stored = layout.entries if where is None else layout.entries.filter(where)
        cells = layout.join_columns(layout.join_rows(stored, x, k), c, k + 2)
        d = F.expr(" + ".join(f"x{j} * v{j}" for j in range(k)) + " - z")
        y, mu = F.col("value"), F.col("mu")
        extra = cells.groupBy("col_id").agg(
            F.sum(F.abs(d - y) - F.abs(d)).alias("extra"), F.sum(F.abs(y - mu) - F.abs(mu)).alias("centred")
        )
        none = F.lit(0.0)
        sums = (
            c.join(dense, "col_id", "left")
            .join(extra, "col_id", "left")
            .select(
                "col_id",
                (F.coalesce("dense", none) + F.coalesce("extra", none) + F.abs("z") * float(absent)).alias("err"),
                (F.abs(mu) * float(sampled + absent) + F.coalesce("centred", none)).alias("norm"),
            )
        )
        return kept(sums, "error-sums")
    finally:
        x.unpersist()


#: Columns whose dense sums are computed together, the product of their number and k + 1 being sent to every task.
BATCH_COLUMNS = 256
#: Such batches, before all columns that are left are computed in one job.
BATCHES = 8


@dataclass
class ColumnError:
    """The largest column sums of |X*C' - A| and |A|, and for how many columns the dense sum was computed."""

    error: float
    norm: float
    computed: int

    @property
    def ratio(self) -> float:
        return self.error / self.norm if self.norm else float("nan")


def _column_sums_of(x: DataFrame, k: int, loadings: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """For a few columns the sums over the rows of X of |x . c - z|: one pass, one partial sum per task."""
    shared = x.sparkSession.sparkContext.broadcast((loadings, shifts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, z = shared.value
        total = np.zeros(len(z))
        for batch in batches:
            part = np.stack([batch.column(j).to_numpy(zero_copy_only=False) for j in range(k)], axis=1)
            for lo in range(0, len(part), 4096):
                total += np.abs(part[lo : lo + 4096] @ c.T - z).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(z))), pa.array(total)], ["j", "s"])

    rows = x.select(*names("x", k)).mapInArrow(run, "j bigint, s double").groupBy("j").agg(F.sum("s").alias("s")).collect()
    shared.destroy()
    out = np.zeros(len(shifts))
    for j, total in rows:
        out[j] = total
    return out


def largest_column_error(
    layout: Layout, fitted: DataFrame, k: int, x_mean: np.ndarray, rate: float = 1.0, seed: int = 0, batch: int = BATCH_COLUMNS
) -> ColumnError:
    """The largest column sum of |X*C' - A| over the sampled rows, exactly, without the sums of all columns.

    ``fitted`` and ``x_mean`` are as in :func:`column_error_sums`. With d = x.c - z a column's dense sum of |d| over n rows is
    at most sqrt(n * sum of d^2), and that follows from the k x k Gram matrix of X. Stored cells correct it by a sparse
    join, exactly. So every column has an upper bound at the cost of its entries; columns are then computed in
    batches by decreasing bound, until no other bound reaches the largest sum found. Where many bounds are about equal,
    that takes many columns: those left after BATCHES batches are computed in one job.
    """
    where = sample_condition(rate, seed) if rate < 1.0 else None
    w, v, xs = names("w", k), names("v", k), names("x", k)
    x = layout.sketch(fitted, w, "x", where).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        sampled, *sums = x.agg(F.count("*"), *[F.coalesce(F.sum(c), F.lit(0.0)) for c in xs]).first()
        present = sampled if where is None else layout.present_rows()
        absent = (layout.n_rows - present) * min(rate, 1.0)
        gram = product_matrix(column_products(x, triangle(xs, xs)), xs, xs)
        c = fitted.selectExpr("col_id", "mu", *v, f"{linear(v, x_mean)} - mu AS z")
        stored = layout.entries if where is None else layout.entries.filter(where)
        cells = layout.join_columns(layout.join_rows(stored, x, k), c, k + 2)
        d = F.expr(" + ".join(f"x{j} * v{j}" for j in range(k)) + " - z")
        y, mu = F.col("value"), F.col("mu")
        extra = cells.groupBy("col_id").agg(
            F.sum(F.abs(d - y) - F.abs(d)).alias("extra"), F.sum(F.abs(y - mu) - F.abs(mu)).alias("centred")
        )
        # sum of (x.c - z)^2 = c'Gc - 2 z s.c + n z^2, with a margin for the rounding of large terms that cancel
        square = " + ".join(f"v{i} * ({linear(v, gram[i])})" for i in range(k))
        size = " + ".join(f"v{i} * v{i} * {number(gram[i, i])}" for i in range(k))
        bounded = c.join(extra, "col_id", "left").selectExpr(
            "col_id", *v, "z",
            f"coalesce(extra, 0.0D) + abs(z) * {number(absent)} AS known",
            f"abs(mu) * {number(sampled + absent)} + coalesce(centred, 0.0D) AS norm",
            f"{square} - 2.0D * z * ({linear(v, np.array(sums, float))}) + {number(sampled)} * z * z AS square",
            f"{size} + {number(sampled)} * z * z AS size",
        )
        bound = f"known + sqrt({number(sampled)} * (greatest(square, 0.0D) + 1e-12D * {k + 1} * size))"
        bounded = kept(bounded.selectExpr("col_id", *v, "z", "known", "norm", f"{bound} AS bound"), "bounds")
        norm = bounded.agg(F.max("norm")).first()[0] or 0.0
        best, computed, left = 0.0, 0, bounded
        for _ in range(BATCHES):
            top = left.orderBy(F.desc("bound"), "col_id").limit(batch).collect()  # at most `batch` rows of k + 5 numbers
            top = [r for r in top if r["bound"] >= best]
            if not top:
                return ColumnError(best, norm, computed)
            dense = _column_sums_of(x, k, np.array([[r[j] for j in v] for r in top]), np.array([r["z"] for r in top]))
            best = max(best, float((dense + np.array([r["known"] for r in top])).max()))
            computed += len(top)
            last = top[-1]
            after = (F.col("bound") < last["bound"]) | ((F.col("bound") == last["bound"]) & (F.col("col_id") > last["col_id"]))
            left = bounded.filter(after & (F.col("bound") >= best))
        rest = left.count()
        if rest:
            dense = _dense_sums(x, k, left.select("col_id", *v, "z"), layout.n_rows, rest)
            best = max(best, left.join(dense, "col_id").agg(F.max(F.col("known") + F.col("dense"))).first()[0])
        return ColumnError(best, norm, computed + rest)
    finally:
        x.unpersist()


def reconstruction_error(layout: Layout, fitted: DataFrame, k: int, x_mean: np.ndarray, rate: float = 1.0, seed: int = 0) -> float:
    """Relative 1-norm reconstruction error: largest column sum of |X*C' - A| over that of |A|."""
    return largest_column_error(layout, fitted, k, x_mean, rate, seed).ratio


def relative_reconstruction_error(
    matrix: Matrix, components: DataFrame, k: int, *, rate: float = 1.0, seed: int = 0, broadcast_bytes: int = BROADCAST_BYTES
) -> ColumnError:
    """How much of the centred matrix A is lost by A*V*V': the largest column sums of |A*V*V' - A| and of |A|.

    ``components`` is the long table ``[col_id, comp, loading]`` of orthonormal components; the result's ``ratio`` is the
    relative error in the induced 1-norm. Works on entries and on vectors; ``rate`` samples whole rows.
    """
    v = names("v", k)
    with matrix.lay_out(k + 2, broadcast_bytes=broadcast_bytes) as layout:
        table = wide_components(components.filter(F.col("comp") < k), k)
        state = layout.state(table, v)
        mean = np.array([float(m) for m in state.agg(*[F.coalesce(F.expr(f"sum(mu * {c})"), F.lit(0.0)) for c in v]).first()])
        # columns without loadings keep their mean as the only part of z
        means = layout.column_means().join(table, "col_id", "full")
        fitted = means.selectExpr(
            "col_id", "coalesce(mu, 0.0D) AS mu", *[f"coalesce({c}, 0.0D) AS {a}{j}" for a in "wv" for j, c in enumerate(v)]
        )
        return largest_column_error(layout, kept(fitted, "fitted"), k, mean, rate, seed)
