"""A single singular value by block power iteration."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame

from ..functions.generators import seed_table
from ..functions.session import local_table
from ..functions.small import round_half_up
from ..matrix import BROADCAST_BYTES, Matrix
from ..sinks.stats import metrics_table
from .iteration import advance, sketch_width, factor, orthogonal_image, start


def kth_singular_value(
    matrix: Matrix,
    k: int,
    *,
    oversample: int | None = None,
    max_iter: int = 50,
    digits: int | None = 4,
    kind: str = "normal",
    seed: int = 0,
    broadcast_bytes: int = BROADCAST_BYTES,
    partitions: int | None = None,
) -> DataFrame:
    """One row ``[k, sigma, iterations]``: the k-th singular value of the column-centred matrix.

    Rounded to ``digits`` decimals; stops when the rounded value repeats. ``digits=None`` runs all
    iterations and does not round. 0 if the matrix has fewer than k non-zero singular values.
    """
    return kth_singular_value_run(
        matrix, k, oversample=oversample, max_iter=max_iter, digits=digits, kind=kind, seed=seed,
        broadcast_bytes=broadcast_bytes, partitions=partitions,
    )[0]


def kth_singular_value_run(
    matrix: Matrix, k: int, *, oversample: int | None, max_iter: int, digits: int | None, kind: str, seed: int,
    broadcast_bytes: int = BROADCAST_BYTES, partitions: int | None = None,
    app: str = "kth_singular_value", dataset: str = "Untitled",
) -> tuple[DataFrame, DataFrame]:
    """The value and the per-iteration metrics."""
    began = time.perf_counter()
    spark = matrix.entries.sparkSession
    matrix = matrix.measured()
    if k < 1 or max_iter < 1:
        raise ValueError("k and max_iter must be at least 1")
    width = sketch_width(k, oversample, matrix.n_rows, matrix.n_cols)
    records, value, used = [], 0.0, 0
    with matrix.lay_out(width, broadcast_bytes=broadcast_bytes, partitions=partitions) as layout:
        state = start(layout, seed_table(spark, matrix.n_cols, width, kind, seed), width)
        preprocess = time.perf_counter() - began
        for iteration in range(max_iter):
            began = time.perf_counter()
            made, inverse = orthogonal_image(layout, state)
            factors = factor(made, inverse, state)
            new = round_half_up(factors.sigma[k - 1], digits) if len(factors.sigma) >= k else 0.0
            used = iteration + 1
            seconds = time.perf_counter() - began
            records.append((app, dataset, matrix.n_rows, matrix.n_cols, iteration, preprocess, seconds, None, new))
            if new == value and digits is not None:
                break
            value = new
            if len(factors.sigma) == 0:
                break
            state = advance(made, factors, state)
    result = local_table(spark, [(k, float(value), used)], "k int, sigma double, iterations int")
    return result, metrics_table(spark, records)
