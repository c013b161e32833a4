"""Low-rank analysis of large matrices held as Spark tables."""

import sys

from pyspark import cloudpickle

from .matrix import Matrix
from .plans import (
    PcaResult,
    PpcaResult,
    kth_singular_value,
    ppca,
    project,
    randomized_pca,
    relative_error,
    relative_reconstruction_error,
    residual_spectral_norm,
)
from .vectors import VectorMatrix, vector_rows

__all__ = [
    "Matrix", "PcaResult", "PpcaResult", "VectorMatrix", "kth_singular_value", "ppca", "project", "randomized_pca",
    "relative_error", "relative_reconstruction_error", "residual_spectral_norm", "vector_rows",
]

# Ship the few functions that run in Python workers by value: executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
