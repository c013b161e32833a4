"""Principal components by iterated randomized sketching."""

from __future__ import annotations

import time
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import combine, names
from ..functions.generators import seed_table
from ..functions.session import local_table
from ..functions.small import round_half_up
from ..matrix import BROADCAST_BYTES, Matrix
from ..operators.basis import fix_signs
from ..operators.products import long_components
from ..sinks.stats import metrics_table
from .iteration import advance, sketch_width, factor, orthogonal_image, start
from .residual import residual_norm_on


@dataclass
class PcaResult:
    """``components[col_id, comp, loading]``, ``sigmas[comp, sigma]`` and per-iteration ``metrics``."""

    components: DataFrame
    sigmas: DataFrame
    metrics: DataFrame
    sigma: list[float]
    n_iter: int


def randomized_pca(
    matrix: Matrix,
    k: int,
    *,
    oversample: int | None = None,
    max_iter: int = 50,
    tol: float = 0.0,
    sigma_k1: float | None = None,
    norm_iter: int = 5,
    norm_oversample: int | None = None,
    sigma_digits: int | None = 4,
    kind: str = "normal",
    seed: int = 0,
    app: str = "randomized_pca",
    dataset: str = "Untitled",
    broadcast_bytes: int = BROADCAST_BYTES,
    partitions: int | None = None,
) -> PcaResult:
    """The first ``k`` principal components of the column-centred matrix.

    With ``sigma_k1`` (the known (k+1)-th singular value) each iteration is followed by a relative
    spectral error, and the loop ends when it is at most ``tol``. Otherwise it ends when the leading
    singular values no longer change at ``sigma_digits`` decimals; None runs all ``max_iter``
    iterations. ``oversample`` columns are added to the sketch; None takes up to 5, as far as the matrix
    has rows and columns. ``k`` may be as large as the smaller of its dimensions. Component signs make the largest loading positive.
    """
    if max_iter < 1:
        raise ValueError("max_iter must be at least 1")
    began = time.perf_counter()
    spark = matrix.entries.sparkSession
    matrix = matrix.measured()
    if k < 1:
        raise ValueError("k must be at least 1")
    width = sketch_width(k, oversample, matrix.n_rows, matrix.n_cols)
    if sigma_k1 is not None:
        sketch_width(1, norm_oversample, matrix.n_rows, matrix.n_cols)
    records = []
    with matrix.lay_out(width, broadcast_bytes=broadcast_bytes, partitions=partitions) as layout:
        state = start(layout, seed_table(spark, matrix.n_cols, width, kind, seed), width)
        preprocess = time.perf_counter() - began
        previous = None
        for iteration in range(max_iter):
            began = time.perf_counter()
            made, inverse = orthogonal_image(layout, state)
            factors = factor(made, inverse, state)
            found = min(k, len(factors.sigma))
            vectors = made.table.selectExpr("col_id", *combine(made.c, factors.coef[:, :found], "v"))
            if found:
                state = advance(made, factors, state)
            sigma = np.zeros(k)
            sigma[:found] = factors.sigma[:found]
            seconds = time.perf_counter() - began
            error = None
            if sigma_k1 is not None and found:
                norm, _, _ = residual_norm_on(layout, vectors, found, norm_iter, norm_oversample, 4, kind, seed + 1)
                error = (norm - float(sigma_k1)) / float(sigma_k1)
            last = float(sigma[found - 1]) if found else 0.0
            records.append((app, dataset, matrix.n_rows, matrix.n_cols, iteration, preprocess, seconds, error, last))
            rounded = [round_half_up(s, sigma_digits) for s in sigma]
            if not found or (error is not None and error <= tol):
                break
            if sigma_k1 is None and sigma_digits is not None and rounded == previous:
                break
            previous = rounded
    components = fix_signs(long_components(vectors, names("v", found))) if found else _no_components(vectors)
    sigmas = local_table(spark, [(j, float(s)) for j, s in enumerate(sigma)], "comp int, sigma double")
    return PcaResult(components, sigmas, metrics_table(spark, records), [float(s) for s in sigma], len(records))


def _no_components(vectors: DataFrame) -> DataFrame:
    return vectors.select("col_id", F.lit(0).alias("comp"), F.lit(0.0).alias("loading")).filter(F.lit(False))
