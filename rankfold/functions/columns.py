"""Column expressions for small dense coefficient matrices.

Written as SQL text: a sketch of width s needs s^2 terms, and building them one Column call at a
time costs more than the query.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def hashed_unit(*keys: Column | str | int) -> Column:
    """A number in (0, 1) that depends on the keys only: 52 bits of the MD5 sum of the keys, joined by slashes.

    Other engines compute the same from the same text. A null key is left out of the text.
    """
    text = F.concat_ws("/", *[F.lit(k).cast("string") if isinstance(k, int) else F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys])
    bits = F.conv(F.substring(F.md5(F.encode(text, "UTF-8")), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / float(1 << 52)


def names(prefix: str, width: int) -> list[str]:
    return [f"{prefix}{j}" for j in range(width)]


def number(value: float) -> str:
    """A double literal that reads back as exactly this value."""
    value = float(value)
    if not np.isfinite(value):
        raise ValueError("coefficient is not finite")
    return f"({value!r}D)"


def linear(cols: list[str], coef: np.ndarray) -> str:
    """The sum of columns times coefficients."""
    terms = [f"{c} * {number(x)}" for c, x in zip(cols, coef) if x != 0.0]
    return " + ".join(terms) if terms else "0.0D"


def combine(cols: list[str], coef: np.ndarray, prefix: str) -> list[str]:
    """Expressions ``prefix0..`` holding (cols as a row vector) times ``coef``."""
    return [f"{linear(cols, coef[:, j])} AS {prefix}{j}" for j in range(coef.shape[1])]


def shifted(cols: list[str], mean: np.ndarray, prefix: str) -> list[str]:
    """Expressions ``prefix0..`` holding the columns less a constant each."""
    return [f"{c} - {number(m)} AS {prefix}{j}" for j, (c, m) in enumerate(zip(cols, mean))]


def triangle(left: list[str], right: list[str]) -> list[tuple[str, str]]:
    """Index pairs (i <= j) of a symmetric product of two equally wide column sets."""
    return [(left[i], right[j]) for i in range(len(left)) for j in range(i, len(right))]
