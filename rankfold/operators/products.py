"""Products of the matrix with tall tables, written as joins.

These work on plain DataFrames and leave the join strategy to Catalyst and adaptive execution. The
iterative analyses use the same products through :class:`rankfold.matrix.Layout`, which keeps Y in
place between passes.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import combine, names, number
from ..functions.session import kept
from ..matrix import BROADCAST_BYTES, from_blocks, table_bytes, to_blocks


#: Copies of the dense side for hot ids, and the share of all entries from which on an id is hot: at most 1 / share are.
SALTS, HOT_SHARE = 32, 1 / 256


def hot_ids(entries: DataFrame, key: str, share: float = HOT_SHARE) -> DataFrame:
    """``[key]``: the ids that hold more than ``share`` of the entries, fewer than 1 / share of them.

    Counted exactly; counts are combined in each task, so a hot id sends one row per task.
    """
    counts = kept(entries.groupBy(key).agg(F.count("*").alias("n")), "counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    return counts.filter(F.col("n") > share * total).select(key)


def spread_join(entries: DataFrame, table: DataFrame, key: str, salts: int = SALTS, share: float = HOT_SHARE) -> DataFrame:
    """entries joined with a table that is unique in ``key``, no task getting all entries of a hot id.

    Entries of a hot id are dealt over ``salts`` partitions by the other id, and only the table's rows of hot ids are
    copied for them, fewer than salts / share rows. Needs no adaptive skew handling.
    """
    hot = hot_ids(entries, key, share).withColumn("hot", F.lit(True))
    other = "row_id" if key == "col_id" else "col_id"
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64(other), F.lit(salts))).otherwise(0).cast("int")
    left = entries.join(F.broadcast(hot), key, "left").withColumn("salt", salt).drop("hot")
    last = F.when(F.col("hot"), salts - 1).otherwise(0)
    right = table.join(F.broadcast(hot), key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), last))).drop("hot")
    return left.join(right, [key, "salt"]).drop("salt")


def _sums(entries: DataFrame, dense: DataFrame, cols: list[str], prefix: str, on: str, by: str, spread: bool) -> DataFrame:
    w = to_blocks(dense, [on], cols)
    x = [c for c in w.columns if c.startswith("x")]
    if "blk" in w.columns:
        # One row per id, so that hot ids are copied once; the blocks are taken apart after the join.
        w = w.groupBy(on).agg(F.collect_list(F.struct("blk", *x)).alias("blocks")) if spread else w
    joined = spread_join(entries, w, on) if spread else entries.join(w, on)
    if "blocks" in joined.columns:
        joined = joined.select("row_id", "col_id", "value", F.inline("blocks"))
    blk = ["blk"] if "blk" in joined.columns else []
    sums = joined.groupBy(by, *blk).agg(*[F.expr(f"sum(value * {c}) AS {c}") for c in x])
    return from_blocks(sums, by, len(cols), prefix)


def sketch(entries: DataFrame, table: DataFrame, cols: list[str], prefix: str = "z", spread: bool = False) -> DataFrame:
    """``[row_id, z0..]`` = Y*W for the stored rows, W being ``cols`` of a ``col_id`` table.

    ``spread`` splits hot columns over tasks, see :func:`spread_join`; sums per row are combined in each task anyway.
    """
    return _sums(entries, table, cols, prefix, "col_id", "row_id", spread)


sketch_sums = sketch


def cross_product(entries: DataFrame, sketch: DataFrame, cols: list[str], prefix: str = "c", spread: bool = False) -> DataFrame:
    """``[col_id, c0..]`` = Y'*Z, Z being ``cols`` of a ``row_id`` table; ``spread`` splits hot rows over tasks."""
    return _sums(entries, sketch, cols, prefix, "row_id", "col_id", spread)


def mean_image(means: DataFrame, table: DataFrame, cols: list[str], prefix: str = "m") -> DataFrame:
    """One row ``[m0..]`` = mu'*W."""
    return means.join(table, "col_id").agg(
        *[F.expr(f"coalesce(sum(mu * {c}), 0.0D) AS {prefix}{j}") for j, c in enumerate(cols)]
    )


def collect_row(one_row: DataFrame) -> np.ndarray:
    """A one-row aggregate as a NumPy vector."""
    return np.array([float(v) for v in one_row.first()])


def centre_sketch(sketch: DataFrame, cols: list[str], mean: np.ndarray) -> DataFrame:
    """The sketch of the centred matrix, Z - 1*m', for the stored rows."""
    return sketch.selectExpr("row_id", *[f"{c} - {number(m)} AS {c}" for c, m in zip(cols, mean)])


def mean_correction(cross: DataFrame, cols: list[str], means: DataFrame, sums: np.ndarray, mean: np.ndarray, n_rows: int) -> DataFrame:
    """Subtract mu_i * (sum_j - N*m_j): what the mean part of A' adds to Y'(Z - 1*m').

    The bracket vanishes up to rounding when mu is the column sum over N; it matters only for means
    that come from elsewhere.
    """
    rest = [number(sums[j] - n_rows * mean[j]) for j in range(len(cols))]
    return cross.join(means, "col_id", "left").selectExpr(
        "col_id", *[f"{c} - coalesce(mu, 0.0D) * {r} AS {c}" for c, r in zip(cols, rest)]
    )


def transform(table: DataFrame, key: str, cols: list[str], coef: np.ndarray, prefix: str) -> DataFrame:
    """A tall table times a small dense matrix, row by row."""
    return table.selectExpr(key, *combine(cols, coef, prefix))


def orthonormal_image(entries: DataFrame, table: DataFrame, cols: list[str], mean: np.ndarray, r_inverse: np.ndarray) -> DataFrame:
    """``[col_id, b0..]`` = A'*Q with Q = A*(W*R^-1) formed on the fly: the Q'A pass, transposed."""
    q = transform(centre_sketch(sketch(entries, table, cols), names("z", len(cols)), mean), "row_id", names("z", len(cols)), r_inverse, "q")
    return cross_product(entries, q, names("q", r_inverse.shape[1]), "b")


def project(entries: DataFrame, components: DataFrame, k: int, centre: np.ndarray | None = None) -> DataFrame:
    """``[row_id, comp, score]`` = Y*C, zero scores left out; ``centre`` (mu'*C) gives (Y - 1*mu')*C.

    ``components`` is the long table ``[col_id, comp, loading]``.
    """
    scores = sketch(entries, wide_components(components, k), names("v", k), "p")
    return score_cells(scores, k, centre if centre is not None else np.zeros(k))


def score_cells(scores: DataFrame, k: int, shift: np.ndarray) -> DataFrame:
    """``[row_id, comp, score]`` of the wide table ``[row_id, p0..]`` less a shift per component, without zeros."""
    cells = ", ".join(f"struct({j} AS comp, p{j} - {number(shift[j])} AS score)" for j in range(k))
    return scores.selectExpr("row_id", f"inline(array({cells}))").filter("score <> 0")


def wide_components(components: DataFrame, k: int, prefix: str = "v") -> DataFrame:
    """``[col_id, v0..v{k-1}]`` from ``[col_id, comp, loading]``."""
    pick = [F.expr(f"coalesce(sum(CASE WHEN comp = {j} THEN loading END), 0.0D) AS {prefix}{j}") for j in range(k)]
    return components.groupBy("col_id").agg(*pick)


def long_components(table: DataFrame, cols: list[str]) -> DataFrame:
    """``[col_id, comp, loading]`` from a wide table."""
    cells = ", ".join(f"struct({j} AS comp, {c} AS loading)" for j, c in enumerate(cols))
    return table.selectExpr("col_id", f"inline(array({cells}))")


def paired_blocks(
    scores: DataFrame,
    cols: list[str],
    table: DataFrame,
    table_cols: list[str],
    n_rows: int,
    n_cols: int,
    combine_blocks: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], pd.DataFrame],
    schema: str,
    block_bytes: int = BROADCAST_BYTES // 4,
) -> DataFrame:
    """Apply ``combine_blocks(row_ids, X, col_ids, C)`` to every pair of a row and a column block.

    For results that are dense by definition. Both operands are replicated along a grid of hashed
    blocks, each below ``block_bytes``; a task sees one block of each. Ids are unique on both
    sides, so the blocks are even.
    """
    k = len(cols)
    least = int(scores.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    col_blocks = max(1, -(-table_bytes(n_cols, k) // block_bytes))
    row_blocks = max(1, -(-table_bytes(n_rows, k) // block_bytes))
    if row_blocks * col_blocks < least:
        # Blocks of rows and of columns about equally large: the fewest copies.
        row_blocks = max(row_blocks, min(least, round(math.sqrt(least * n_rows / max(1, n_cols)))))
        col_blocks = max(col_blocks, -(-least // row_blocks))

    def block(key: str, count: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(count)).cast("int")

    def every(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    left = scores.select("row_id", *[F.col(c).alias(f"x{j}") for j, c in enumerate(cols)], block("row_id", row_blocks).alias("rb"))
    left = left.withColumn("cb", every(col_blocks))
    right = table.select("col_id", *[F.col(c).alias(f"v{j}") for j, c in enumerate(table_cols)], block("col_id", col_blocks).alias("cb"))
    right = right.withColumn("rb", every(row_blocks))
    x_cols, v_cols = names("x", k), names("v", len(table_cols))
    empty = [f.split()[0] for f in schema.split(",")]

    def run(rows: pd.DataFrame, columns: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or columns.empty:
            return pd.DataFrame(columns=empty)
        return combine_blocks(
            rows["row_id"].to_numpy(), rows[x_cols].to_numpy(float), columns["col_id"].to_numpy(), columns[v_cols].to_numpy(float)
        )

    return left.groupBy("rb", "cb").cogroup(right.groupBy("rb", "cb")).applyInPandas(run, schema)


def reconstruct(scores: DataFrame, cols: list[str], table: DataFrame, table_cols: list[str], n_rows: int, n_cols: int) -> DataFrame:
    """``[row_id, col_id, xhat]`` = X*C': every cell of every row of X, a dense result."""

    def cells(row_ids, x, col_ids, c):
        return pd.DataFrame(
            {"row_id": np.repeat(row_ids, len(col_ids)), "col_id": np.tile(col_ids, len(row_ids)), "xhat": (x @ c.T).ravel()}
        )

    kind = scores.schema["row_id"].dataType.simpleString()
    # The output of a task is a block of cells, so the operand blocks are kept small.
    return paired_blocks(
        scores, cols, table, table_cols, n_rows, n_cols, cells, f"row_id {kind}, col_id bigint, xhat double", 256 * 1024
    )


def residual_cells(reconstructed: DataFrame, entries: DataFrame, shift: DataFrame) -> DataFrame:
    """``[row_id, col_id, value]`` = X*C' - Y - z with z given per column as ``[col_id, shift]``."""
    return (
        reconstructed.join(entries, ["row_id", "col_id"], "left")
        .join(shift, "col_id", "left")
        .select(
            "row_id",
            "col_id",
            (F.col("xhat") - F.coalesce("value", F.lit(0.0)) - F.coalesce("shift", F.lit(0.0))).alias("value"),
        )
    )
