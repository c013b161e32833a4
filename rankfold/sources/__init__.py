from .tables import from_columns, from_rdd, from_row_matrix, from_triples, from_vectors, read_matrix
from .text import read_components, read_coo, read_dense

__all__ = ["from_columns", "from_rdd", "from_row_matrix", "from_triples", "from_vectors", "read_components", "read_coo", "read_dense", "read_matrix"]
