"""Algebra on sketch-sized (s x s) matrices, the only matrices that reach the driver."""

from __future__ import annotations

import numpy as np

# Above this condition number (after unit scaling) the Gram route loses too many digits.
GRAM_CONDITION_LIMIT = 1e10


def gram_condition(gram: np.ndarray) -> float:
    """Condition number of a Gram matrix after scaling its diagonal to one."""
    diag = np.diag(gram)
    if not np.all(np.isfinite(gram)) or np.any(diag <= 0):
        return np.inf
    scale = 1.0 / np.sqrt(diag)
    eig = np.linalg.eigvalsh(gram * np.outer(scale, scale))
    return np.inf if eig[0] <= 0 else float(eig[-1] / eig[0])


def inverse_factor(gram: np.ndarray) -> np.ndarray | None:
    """R^-1 for gram = R'R, or None if the Gram matrix is too ill-conditioned to factor."""
    if gram_condition(gram) > GRAM_CONDITION_LIMIT:
        return None
    upper = np.linalg.cholesky(gram).T
    return np.linalg.inv(upper)


def whitening(r: np.ndarray) -> np.ndarray:
    """T with orthonormal (X T) for X = Q r, restricted to the numerical rank of r."""
    _, sing, vt = np.linalg.svd(r)
    if sing.size == 0 or sing[0] == 0.0:
        return np.zeros((r.shape[1], 0))
    keep = sing > sing[0] * max(r.shape) * np.finfo(float).eps * 8
    return vt[keep].T / sing[keep]


def spectrum(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Singular values (falling) and left vectors of B, from B B'."""
    eig, vec = np.linalg.eigh((gram + gram.T) / 2)
    order = np.argsort(eig)[::-1]
    return np.sqrt(np.clip(eig[order], 0.0, None)), vec[:, order]


def round_half_up(value: float, digits: int | None) -> float:
    """Fixed-point rounding used by the stopping rules."""
    if digits is None:
        return float(value)
    return float(np.floor(value * 10.0**digits + 0.5) / 10.0**digits)
