from .ppca import ColumnError, PpcaResult, ppca, reconstruction_error, relative_reconstruction_error
from .pca import PcaResult, randomized_pca
from .projection import project
from .residual import relative_error, residual_spectral_norm
from .sigma import kth_singular_value

__all__ = [
    "ColumnError", "PcaResult", "PpcaResult", "kth_singular_value", "ppca", "project", "randomized_pca",
    "reconstruction_error", "relative_error", "relative_reconstruction_error", "residual_spectral_norm",
]
