"""Projection of a matrix on given components, placed by the size of the components.

A projection is one product, so Y is neither cached nor partitioned in advance unless the components are too large to be
broadcast. In every route Y is the streamed side:

* components below the limit are broadcast; entries are summed per row, combined in each task before the exchange;
* larger ones are replicated along the grid of :class:`rankfold.matrix.Layout`, to which Y is dealt once, so neither a hot
  row nor a hot column meets in one task; the scores are written while Y is placed;
* vectors are multiplied batch by batch without an exchange, if the components are below the limit.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import names
from ..functions.session import kept
from ..matrix import BROADCAST_BYTES, Layout, Matrix, table_bytes
from ..operators.aggregates import column_means
from ..operators.products import collect_row, mean_image, score_cells, sketch_sums, wide_components
from ..vectors import VectorLayout, VectorMatrix


def project(
    matrix: Matrix | VectorMatrix,
    components: DataFrame,
    k: int,
    *,
    centred: bool = False,
    broadcast_bytes: int = BROADCAST_BYTES,
    partitions: int | None = None,
) -> DataFrame:
    """``[row_id, comp, score]`` = Y*C, or (Y - 1*mu')*C if ``centred``; zero scores are left out.

    ``components`` is the long table ``[col_id, comp, loading]``, of which the first ``k`` are used; a column without
    loadings counts as zeros. Rows that are not stored have no scores, also if centred (theirs would all be -mu'C).
    """
    m = matrix.measured()
    v = names("v", k)
    table = wide_components(components.filter(F.col("comp") < k), k)
    if not m.n_cols or not m.n_rows:
        return score_cells(sketch_sums(m.entries, table, v, "p"), k, np.zeros(k))
    small = table_bytes(m.n_cols, k) <= broadcast_bytes
    if isinstance(m, VectorMatrix) and small:
        layout = VectorLayout(m, k, broadcast_bytes, partitions)
        mean = np.zeros(k)
        if centred:
            mean = collect_row(mean_image(layout.column_means(), table, v))
        return score_cells(layout.sketch(table, v, "p"), k, mean)
    y = Matrix(m.entries, m.n_rows, m.n_cols, getattr(m, "n_entries", None), getattr(m, "drop_outside", False))
    mean = np.zeros(k)
    if centred:
        mean = collect_row(mean_image(column_means(y.clean(), y.n_rows), table, v))
    if small:
        return score_cells(sketch_sums(y.clean(), F.broadcast(table), v, "p"), k, mean)
    with Layout(y, k, broadcast_bytes, partitions) as layout:
        return score_cells(kept(layout.sketch(table, v, "p"), "scores"), k, mean)


