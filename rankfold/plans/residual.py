"""Spectral norm of what is left of the matrix outside given components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import names
from ..functions.generators import seed_table
from ..functions.session import local_table
from ..functions.small import round_half_up
from ..matrix import BROADCAST_BYTES, Layout, Matrix
from ..operators.basis import orthonormalise
from ..operators.products import wide_components
from .iteration import advance, sketch_width, factor, orthogonal_image, start


def residual_norm_on(
    layout: Layout, vectors: DataFrame, k: int, max_iter: int, oversample: int | None, digits: int | None,
    kind: str, seed: int, orthonormal: bool = True,
) -> tuple[float, int, int]:
    """(norm, iterations, basis width) for ``vectors[col_id, v0..]`` on a matrix already laid out."""
    width = sketch_width(1, oversample, layout.n_rows, layout.n_cols)
    basis = vectors.select("col_id", *names("v", k))
    if orthonormal:
        made = orthonormalise(basis, names("v", k))
        k = len(made.columns) - 1
        basis = made.selectExpr("col_id", *[f"u{j} AS v{j}" for j in range(k)])
    state = start(layout, seed_table(layout.spark, layout.n_cols, width, kind, seed), width, basis, k)
    value, used = 0.0, 0
    for iteration in range(max_iter):
        made, inverse = orthogonal_image(layout, state)
        factors = factor(made, inverse, state)
        new = round_half_up(factors.sigma[0], digits) if len(factors.sigma) else 0.0
        used = iteration + 1
        if new == value and digits is not None:
            break
        value = new
        if len(factors.sigma) == 0:
            break
        state = advance(made, factors, state)
    return value, used, k


def _width(components: DataFrame) -> int:
    last = components.agg(F.max("comp")).first()[0]
    if last is None:
        raise ValueError("no components given")
    return int(last) + 1


def residual_spectral_norm(
    matrix: Matrix,
    components: DataFrame,
    *,
    k: int | None = None,
    max_iter: int = 5,
    oversample: int | None = None,
    digits: int | None = 4,
    orthonormalise_first: bool = True,
    kind: str = "normal",
    seed: int = 0,
    broadcast_bytes: int = BROADCAST_BYTES,
    partitions: int | None = None,
) -> DataFrame:
    """One row ``[norm, iterations]``: the spectral norm of A*(I - V*V').

    ``components[col_id, comp, loading]`` is V. ``orthonormalise_first=False`` uses V as it is given
    (an offline check, for which 3 digits are the custom).
    """
    k = k or _width(components)
    matrix = matrix.measured()
    with matrix.lay_out(max(sketch_width(1, oversample, matrix.n_rows, matrix.n_cols), k), broadcast_bytes=broadcast_bytes, partitions=partitions) as layout:
        norm, used, _ = residual_norm_on(
            layout, wide_components(components, k), k, max_iter, oversample, digits, kind, seed, orthonormalise_first
        )
    return local_table(matrix.entries.sparkSession, [(float(norm), used)], "norm double, iterations int")


def relative_error(matrix: Matrix, components: DataFrame, sigma_k1: float, **options) -> DataFrame:
    """One row ``[norm, sigma_k1, error]`` with the signed error (norm - sigma_k1) / sigma_k1."""
    norm = residual_spectral_norm(matrix, components, **options)
    s = F.lit(float(sigma_k1))
    return norm.select("norm", s.alias("sigma_k1"), ((F.col("norm") - s) / s).alias("error"))
