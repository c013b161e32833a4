"""R factor of a tall-skinny table by local QR and a staged merge of the small factors."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import names, number
from ..functions.session import kept

# R factors merged by one task of a merge stage.
FAN_IN = 32


def _factor(blocks: Iterator[np.ndarray], width: int) -> np.ndarray:
    r = np.zeros((0, width))
    for block in blocks:
        r = np.linalg.qr(np.vstack([r, block]), mode="r")
    return r * np.where(np.diag(r) < 0, -1.0, 1.0)[:, None]


def _local_r(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = _factor((batch.to_numpy(dtype=float) for batch in batches), width)
        if len(r):
            yield pd.DataFrame(r, columns=names("r", width)).assign(place=TaskContext.get().partitionId())

    return run


def _merged_r(width: int):
    def run(factors: pd.DataFrame) -> pd.DataFrame:
        ordered = factors.sort_values("place", kind="stable")[names("r", width)].to_numpy(dtype=float)
        r = _factor(iter([ordered]), width)
        return pd.DataFrame(r, columns=names("r", width)).assign(place=int(factors["parent"].iloc[0]))

    return run


def tsqr_table(table: DataFrame, cols: list[str], fan_in: int = FAN_IN) -> DataFrame:
    """``[r0..r{s-1}]``: the upper triangular R with non-negative diagonal, X = QR.

    A task keeps one R while its batches stream by, so memory is one batch. The factors, s rows each, are written with
    the number of their task. The tree is planned from the highest number that there really is: factor p goes to node
    p // fan_in of the next level, so a node merges at most ``fan_in`` factors, in the order of their tasks.
    """
    width = len(cols)
    r = names("r", width)
    schema = ", ".join(f"{c} double" for c in r) + ", place bigint"
    factors = kept(table.select(*cols).mapInPandas(_local_r(width), schema), "factors")
    last = factors.agg(F.max("place")).first()[0]
    while last:
        last = last // fan_in
        nodes = factors.withColumn("parent", F.floor(F.col("place") / fan_in).cast("bigint"))
        factors = nodes.groupBy("parent").applyInPandas(_merged_r(width), schema)
    return factors.select(*r)


def tsqr_r(table: DataFrame, cols: list[str], fan_in: int = FAN_IN) -> np.ndarray:
    """The same factor as a NumPy matrix with non-negative diagonal."""
    rows = tsqr_table(table, cols, fan_in).collect()  # at most s rows of s numbers
    r = np.array([list(row) for row in rows], dtype=float).reshape(-1, len(cols))
    return r[np.argsort([np.argmax(row != 0) for row in r], kind="stable")] if len(r) else r


def absent_row(table: DataFrame, cols: list[str], mean: np.ndarray, n_absent: int) -> DataFrame:
    """Append the image of ``n_absent`` empty rows to a centred sketch.

    n0 equal rows -m have the same R factor as the single row sqrt(n0)*m.
    """
    if n_absent <= 0:
        return table.select(*cols)
    scale = math.sqrt(n_absent)
    row = table.sparkSession.range(1).selectExpr(*[f"{number(scale * m)} AS {c}" for c, m in zip(cols, mean)])
    return table.select(*cols).unionByName(row)
