"""Fixed matrices used by the checked queries.

They are defined by integer formulas of (j, p) so the Spark side (NumPy)
and the SQL side compute bit-identical doubles.

Fixed values:
  W(j, p)     = ((7 j + 3 p) mod 11 - 5) / 10      j < d, p < 3
  C(j, p)     = ((5 j + 2 p) mod 7 - 3) / 8        j < d, p < 3
  Omega(j, p) = ((3 j + 5 p) mod 13 - 6) / 16      j < d, p < 4
  EM starts: k = 1: c_j = 1 / (j + 1); k = 2: c_jp = 1 / (j + 1 + 2 p); ss = 1;
  trial t (from 0) with k = 1: c_j = 1 / (j + 1 + t)
"""

from __future__ import annotations

import numpy as np

K_FIXED = 3
Q_SKETCH = 4

_FORMULAS = {
    "w": (7, 3, 11, 5, 10, K_FIXED),
    "c": (5, 2, 7, 3, 8, K_FIXED),
    "omega": (3, 5, 13, 6, 16, Q_SKETCH),
}


def fixed_matrix(name: str, d: int) -> np.ndarray:
    a, b, mod, off, div, q = _FORMULAS[name]
    j = np.arange(d)[:, None]
    p = np.arange(q)[None, :]
    return ((a * j + b * p) % mod - off).astype(np.float64) / float(div)


def fixed_sql(name: str, dims: str) -> str:
    """SQL rows (j, p, w) of the named matrix; ``dims`` is a query giving
    the column indices ``j``."""
    a, b, mod, off, div, q = _FORMULAS[name]
    return (f"SELECT j, p, CAST(((({a} * j + {b} * p) % {mod}) - {off}) AS DOUBLE) / {div} AS w "
            f"FROM (SELECT j, CAST(unnest(range({q})) AS INTEGER) AS p FROM ({dims}))")


def first_column_init(d: int, trial: int = 0) -> np.ndarray:
    """Start of the k = 1 EM check: c_j = 1 / (j + 1 + trial)."""
    return (1.0 / (np.arange(d) + 1.0 + trial))[:, None]


def two_column_init(d: int) -> np.ndarray:
    """Start of the k = 2 EM check: c_jp = 1 / (j + 1 + 2 p)."""
    j = np.arange(d)[:, None]
    p = np.arange(2)[None, :]
    return 1.0 / (j + 1.0 + 2.0 * p)
