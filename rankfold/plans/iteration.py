"""One pass of subspace iteration, shared by all analyses.

The state is a table with one row per matrix column: the column mean ``mu``, an optional basis
``v0..`` to keep out, and the seed ``w0..``. A pass computes C = A'*A*W in one job and writes it
next to W, which also cuts the lineage. One more job over that column-sized table returns every
inner product the factorisations need: because Z = A*W, the Gram matrix Z'Z of the sketch is W'C,
so it costs no second pass over the data. Only these sketch-sized matrices reach the driver; the
next seed is a column expression over the table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from ..functions.columns import combine, names, shifted, triangle
from ..functions.session import ensure_checkpoint_dir
from ..functions.small import inverse_factor, spectrum, whitening
from ..matrix import Layout, zeros_if_missing
from ..operators.aggregates import column_products, product_matrix
from ..operators.tsqr import absent_row, tsqr_r

# Singular values below this share of the largest are taken from a QR instead of the squared matrix.
SMALL_SIGMA = 1e-6


@dataclass
class State:
    """``table[col_id, mu, v0.., w0..]`` with the products of the mean with W."""

    table: DataFrame
    width: int
    mean: np.ndarray
    basis_width: int = 0
    basis_gram: np.ndarray | None = None  # V'V
    basis_mean: np.ndarray | None = None  # mu'V

    @property
    def w(self) -> list[str]:
        return names("w", self.width)

    @property
    def v(self) -> list[str]:
        return names("v", self.basis_width)


@dataclass
class Image:
    """``table[col_id, mu, v0.., w0.., c0..]`` with C = A'*A*W, and its inner products."""

    table: DataFrame
    width: int
    gram: np.ndarray  # W'C = Z'Z
    image_gram: np.ndarray  # C'C
    mean: np.ndarray  # mu'C
    overlap: np.ndarray  # V'C

    @property
    def c(self) -> list[str]:
        return names("c", self.width)


def start(layout: Layout, seed: DataFrame, width: int, basis: DataFrame | None = None, basis_width: int = 0) -> State:
    """The first state: seed, column means and (kept out of the seed) the basis."""
    ensure_checkpoint_dir(layout.spark)
    w, v = names("w", width), names("v", basis_width)
    table = layout.state(seed, w)
    if basis is not None:
        table = table.join(basis.select("col_id", *v), "col_id", "left").selectExpr("col_id", "mu", *zeros_if_missing(v), *w)
    table = table.checkpoint()
    pairs = [("mu", c) for c in [*w, *v]] + triangle(v, v) + [(a, b) for a in v for b in w]
    found = column_products(table, pairs)
    mean = product_matrix(found, ["mu"], w)[0]
    if basis is None:
        return State(table, width, mean)
    basis_gram = product_matrix(found, v, v)
    basis_mean = product_matrix(found, ["mu"], v)[0]
    coef = np.vstack([np.eye(width), -product_matrix(found, v, w)])
    table = table.selectExpr("col_id", "mu", *v, *combine(w + v, coef, "w"))
    return State(table, width, np.concatenate([mean, basis_mean]) @ coef, basis_width, basis_gram, basis_mean)


def image(layout: Layout, state: State) -> Image:
    """C = A'*A*W, written next to W, and all inner products."""
    c, w, v = names("c", state.width), state.w, state.v
    made = layout.normal_image(state.table, w, state.mean)
    if layout.small_columns(state.width):
        made = made.hint("shuffle_hash")
    table = state.table.join(made, "col_id", "left").selectExpr("col_id", "mu", *v, *w, *zeros_if_missing(c)).checkpoint()
    pairs = triangle(w, c) + triangle(c, c) + [("mu", a) for a in c] + [(a, b) for a in v for b in c]
    found = column_products(table, pairs)
    overlap = product_matrix(found, v, c) if v else np.zeros((0, state.width))
    return Image(
        table, state.width, product_matrix(found, w, c), product_matrix(found, c, c), product_matrix(found, ["mu"], c)[0], overlap
    )


def orthogonal_image(layout: Layout, state: State) -> tuple[Image, np.ndarray]:
    """The image and R^-1, so that C*R^-1 = A'*Q for an orthonormal basis Q of A*W.

    If the Gram matrix is too ill-conditioned, the sketch is factored by a distributed QR instead,
    the seed is replaced by W*R^-1 and the pass is made again with the now well-conditioned seed.
    A rank-deficient sketch loses the directions that are zero to working precision.
    """
    made = image(layout, state)
    inverse = inverse_factor(made.gram)
    if inverse is not None:
        return made, inverse
    z = layout.sketch(state.table, state.w)
    cols = names("z", state.width)
    centred = z.selectExpr(*shifted(cols, state.mean, "z"))
    r = tsqr_r(absent_row(centred, cols, state.mean, layout.n_rows - layout.present_rows()), cols)
    coef = whitening(r)
    if coef.shape[1] == 0:
        return made, np.zeros((state.width, 0))
    better = State(
        state.table.selectExpr("col_id", "mu", *state.v, *combine(state.w, coef, "w")),
        coef.shape[1], state.mean @ coef, state.basis_width, state.basis_gram, state.basis_mean,
    )
    made = image(layout, better)
    inverse = inverse_factor(made.gram)
    return made, inverse if inverse is not None else np.eye(made.width)


@dataclass
class Factors:
    """Singular values of B = Q'*A (deflated if there is a basis) and its right vectors, as
    ``coef`` over the columns ``c0.. v0..`` of the image table."""

    sigma: np.ndarray
    coef: np.ndarray


def factor(made: Image, inverse: np.ndarray, state: State) -> Factors:
    """Singular value decomposition of B without collecting B.

    B' = (I - V V')*C*R^-1 is a column expression; its Gram matrix follows from the inner products.
    """
    k = made.overlap
    gram = made.image_gram
    lift = inverse
    if state.basis_width:
        gram = gram - 2.0 * k.T @ k + k.T @ state.basis_gram @ k
        lift = np.vstack([inverse, -k @ inverse])
    if inverse.shape[1] == 0:
        return Factors(np.zeros(0), np.zeros((lift.shape[0], 0)))
    sigma, left = spectrum(inverse.T @ gram @ inverse)
    if sigma[0] > 0 and sigma[-1] < SMALL_SIGMA * sigma[0]:
        cols = made.c + names("v", state.basis_width)
        b = made.table.selectExpr(*combine(cols, lift, "b"))
        _, sigma, vt = np.linalg.svd(tsqr_r(b, names("b", lift.shape[1])))
        left = vt.T
    keep = sigma > (sigma[0] if sigma.size else 0.0) * len(sigma) * np.finfo(float).eps * 8
    return Factors(sigma[keep], lift @ (left[:, : len(sigma)][:, keep] / sigma[keep]))


def advance(made: Image, factors: Factors, state: State) -> State:
    """The next state: W becomes the right singular vectors of B (the span of B').

    With a basis that is not orthonormal, (I - V V') is applied to the seed once more.
    """
    coef = factors.coef
    cols = made.c + state.v
    mean = made.mean
    if state.basis_width:
        mean = np.concatenate([made.mean, state.basis_mean])
        in_basis = np.hstack([made.overlap, state.basis_gram]).dot(coef)  # V'W
        coef = coef - np.vstack([np.zeros((made.width, coef.shape[1])), in_basis])
    table = made.table.selectExpr("col_id", "mu", *state.v, *combine(cols, coef, "w"))
    return State(table, coef.shape[1], mean @ coef, state.basis_width, state.basis_gram, state.basis_mean)


#: Columns added to a sketch if the caller does not say how many.
OVERSAMPLE = 5


def sketch_width(k: int, oversample: int | None, n_rows: int, n_cols: int) -> int:
    """k and the oversampling, which by default stops at the smaller dimension."""
    most = min(n_rows, n_cols)
    width = k + (max(0, min(OVERSAMPLE, most - k)) if oversample is None else oversample)
    if width < 1 or width > most:
        raise ValueError(f"sketch width {width} must be between 1 and min(rows, columns) = {most}")
    return width
