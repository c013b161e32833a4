"""Operators on tall tables of basis vectors keyed by ``col_id``."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import combine, names, triangle
from .aggregates import column_products, product_matrix


def orthonormalise(table: DataFrame, cols: list[str], method: str = "svd") -> DataFrame:
    """``[col_id, u0..]``: an orthonormal basis of the span of ``cols``.

    ``svd`` gives the left singular vectors by falling singular value (their signs are free, see
    :func:`fix_signs`); ``cholesky`` gives the Gram-Schmidt basis in column order.
    """
    pairs = triangle(cols, cols)
    g = product_matrix(column_products(table, pairs), cols, cols)
    if method == "cholesky":
        coef = np.linalg.inv(np.linalg.cholesky(g).T)
    elif method == "svd":
        eig, vec = np.linalg.eigh(g)
        order = np.argsort(eig)[::-1]
        keep = order[eig[order] > max(eig[order[0]], 0.0) * len(cols) * np.finfo(float).eps * 8]
        coef = vec[:, keep] / np.sqrt(eig[keep])
    else:
        raise ValueError(f"unknown method {method!r}, use 'svd' or 'cholesky'")
    return table.selectExpr("col_id", *combine(cols, coef, "u"))


def deflate(table: DataFrame, cols: list[str], basis: DataFrame, basis_cols: list[str], prefix: str = "w") -> DataFrame:
    """``[col_id, w0..]`` = (I - V*V')*W for two ``col_id`` tables."""
    joined = table.selectExpr("col_id", *[f"{c} AS l{j}" for j, c in enumerate(cols)]).join(
        basis.selectExpr("col_id", *[f"{c} AS r{j}" for j, c in enumerate(basis_cols)]), "col_id", "left"
    )
    left, right = names("l", len(cols)), names("r", len(basis_cols))
    joined = joined.fillna(0.0, right)
    pairs = [(b, a) for b in right for a in left]
    overlap = product_matrix(column_products(joined, pairs), right, left)
    coef = np.vstack([np.eye(len(left)), -overlap])
    return joined.selectExpr("col_id", *combine(left + right, coef, prefix))


def fix_signs(components: DataFrame) -> DataFrame:
    """Flip each component so that its largest loading by size (ties: smallest column) is positive."""
    rank = F.struct(F.abs("loading"), -F.col("col_id"))
    lead = components.groupBy("comp").agg(F.signum(F.max_by("loading", rank)).alias("sign"))
    # One row per component.
    return components.join(F.broadcast(lead), "comp").select(
        "col_id", "comp", (F.col("loading") * F.when(F.col("sign") < 0, -1.0).otherwise(1.0)).alias("loading")
    )


def leading_components(components: DataFrame, k: int) -> DataFrame:
    """The first ``k`` components."""
    return components.filter(F.col("comp") < k)


def kth_value(sigmas: DataFrame, k: int) -> DataFrame:
    """One row ``[sigma]``: the k-th largest of ``[comp, sigma]``; NULL if there are fewer."""
    top = sigmas.orderBy(F.desc("sigma")).limit(k)
    return top.agg(F.when(F.count("*") >= k, F.min("sigma")).alias("sigma"))


__all__ = ["deflate", "fix_signs", "kth_value", "leading_components", "orthonormalise"]
