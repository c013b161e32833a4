"""SetSketch registers of hashed sets: building, banding, and joint likelihood estimates.

Every element sends out a Poisson stream of points; each point falls on one random register, and a
register keeps the smallest point it gets, stored as 1 - log_b(point), truncated to 0..q+1. Streams of
one element are the same in every set, so registers of a union are the maxima (mergeable), and equal
registers are as likely as shared elements (locality-sensitive).
"""

from __future__ import annotations

import numpy as np

from .scan import mix

B, RATE, Q = 1.001, 20.0, 65534
_LOG_B = np.log(B)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def registers(keys: np.ndarray, ranges: np.ndarray, m: int) -> np.ndarray:
    """A (sets x m) table of registers; set i has the elements keys[ranges[i]:ranges[i+1]]."""
    sets = len(ranges) - 1
    low = np.full(sets * m, np.inf)
    state = mix(keys ^ np.uint64(0xA0761D6478BD642F))
    owner = np.repeat(np.arange(sets), np.diff(ranges))
    point = np.zeros(len(keys))
    drawn, width = 0, 1
    while len(state):
        steps = (np.arange(drawn + 1, drawn + width + 1, dtype=np.uint64) * _STEP)[None, :]
        bits = mix(state[:, None] + steps)
        gaps = -np.log(((bits >> np.uint64(24)).astype(np.float64) + 0.5) * 2.0**-40) / m
        points = point[:, None] + np.cumsum(gaps, axis=1)
        slot = ((bits & np.uint64(0xFFFFFF)) * np.uint64(m)) >> np.uint64(24)
        at = (owner[:, None] * m + slot.astype(np.int64)).ravel()
        np.minimum.at(low, at, points.ravel())
        point = points[:, -1]
        alive = point < low.reshape(sets, m).max(axis=1)[owner]
        state, owner, point = state[alive], owner[alive], point[alive]
        drawn += width
        width = int(min(64, max(1, 200_000 // max(1, len(state)))))
    with np.errstate(divide="ignore"):
        values = np.floor(1.0 - np.log(low / RATE) / _LOG_B)
    values[~np.isfinite(low)] = 0  # an empty set
    return np.clip(values, 0, Q + 1).astype(np.uint16).reshape(sets, m)


def band_hashes(table: np.ndarray, rows: int) -> np.ndarray:
    """A (sets x bands) table: hash of each run of `rows` registers, with the number of its band."""
    sets, m = table.shape
    bands = m // rows
    cells = table[:, : bands * rows].reshape(sets, bands, rows).astype(np.uint64)
    h = np.broadcast_to(np.arange(bands, dtype=np.uint64), (sets, bands)).copy()
    for k in range(rows):
        h = mix(h * np.uint64(65537) + cells[:, :, k] + np.uint64(1))
    return h


def joint_similarity(left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray) -> np.ndarray:
    """Most likely Jaccard similarity of each pair of rows, given both set sizes.

    The likelihood of the numbers of larger, smaller and equal registers has one maximum in J; its
    derivative is bisected over 0..min/max of the sizes.
    """
    m = left.shape[1]
    more, less = (left > right).sum(axis=1), (left < right).sum(axis=1)
    same = m - more - less
    u, v = n_left / (n_left + n_right), n_right / (n_left + n_right)
    top = np.minimum(u / v, v / u)
    c = (B - 1) / B

    def p(x):
        return -np.log1p(-x * c) / _LOG_B

    def slope(x):
        return c / (1 - x * c) / _LOG_B

    lo, hi = np.zeros(len(u)), top.copy()
    for _ in range(40):
        j = (lo + hi) / 2
        a, b = np.maximum(u - v * j, 1e-12), np.maximum(v - u * j, 1e-12)
        da, db = -v * slope(a), -u * slope(b)
        rest = np.maximum(1 - p(a) - p(b), 1e-12)
        rising = more * da / p(a) + less * db / p(b) + same * (-da - db) / rest > 0
        lo, hi = np.where(rising, j, lo), np.where(rising, hi, j)
    return (lo + hi) / 2
