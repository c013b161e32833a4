"""Sums of absolute inner products without touching every pair.

Rows and columns are put into compact boxes. If all products of a box of rows with a box of columns have one sign, the sum
of their absolute values is the product of a column with the sum of the rows, so only pairs of boxes that a sign change
crosses are multiplied out. The result is exact but for rounding, whatever the data; the work saved depends on how
compact the boxes are.
"""

from __future__ import annotations

import numpy as np

#: Rows and columns of a box, and products that are multiplied out at once.
LEAF, GROUP, AT_ONCE = 128, 64, 1 << 17


def boxes(points: np.ndarray, size: int) -> np.ndarray:
    """``[box, place]``: indexes of the points, halved along the widest side until at most ``size`` are left in a box.

    All boxes have the same length; places without a point hold indexes from ``len(points)`` on.
    """
    n = len(points)
    depth = max(0, int(np.ceil(np.log2(n / size)))) if n else 0
    length = -(-n // (1 << depth))
    index = np.arange(length << depth).reshape(1, -1)
    for _ in range(depth):
        at = points[np.minimum(index, n - 1)]
        side = (at.max(axis=1) - at.min(axis=1)).argmax(axis=1)
        key = np.take_along_axis(at, side[:, None, None], axis=2)[:, :, 0]
        order = np.argpartition(key, key.shape[1] // 2, axis=1)
        index = np.take_along_axis(index, order, axis=1).reshape(2 * len(index), -1)
    return index


def _direct(rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    total = np.zeros(len(columns))
    step = max(1, AT_ONCE // max(1, len(columns)))
    for lo in range(0, len(rows), step):
        part = rows[lo : lo + step] @ columns.T
        total += np.abs(part, out=part).sum(axis=0)
    return total


def absolute_sums(rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """For each column the sum over the rows of |row . column|."""
    n, m = len(rows), len(columns)
    if n <= 4 * LEAF or m <= GROUP:
        return np.concatenate([_direct(rows, columns[lo : lo + GROUP]) for lo in range(0, m, GROUP)]) if m else np.zeros(0)
    # Sides are compared by what they mean for the products; columns go by their direction.
    root = np.sqrt(np.square(rows).mean(axis=0))
    norm = np.sqrt(np.square(columns * root).sum(axis=1))
    units = columns / np.where(norm > 0, norm, 1.0)[:, None]
    leaves = boxes(rows * np.abs(units).mean(axis=0), LEAF)
    padded = np.vstack([rows, np.zeros((1, rows.shape[1]))])
    blocks = padded[np.minimum(leaves, n)]
    sums = blocks.sum(axis=1)
    real = rows[np.minimum(leaves, n - 1)]
    low, high = real.min(axis=1), real.max(axis=1)
    centre, half = (low + high) / 2, (high - low) / 2
    reach = np.abs(centre) + half
    out = np.zeros(m)
    for group in boxes(units * root, GROUP):
        group = group[group < m]
        if not len(group):
            continue
        low, high = units[group].min(axis=0), units[group].max(axis=0)
        middle, spread = (low + high) / 2, (high - low) / 2
        value = centre @ middle
        slack = half @ np.abs(middle) + reach @ spread + 1e-9 * (reach @ (np.abs(middle) + spread))
        clear = np.abs(value) > slack
        mine = columns[group]
        out[group] = mine @ (np.sign(value[clear]) @ sums[clear]) + _direct(blocks[~clear].reshape(-1, rows.shape[1]), mine)
    return out
