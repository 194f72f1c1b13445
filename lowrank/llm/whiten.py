"""Whitening of embedding vectors (operator 13).

Passes of plain partial sums give the column sums and the centred scatter of
the fit list; tasks send d x d partials, never rows.  The small matrix is then
factored: pivoted Cholesky brings the scatter to a triangular factor L, and
one-sided Jacobi rotates the columns of L itself until they are orthogonal.
Their squared norms are the eigenvalues and the normalised columns the
components, so the scatter is never squared.  ``whiten`` is a map over the rows.

Vectors are fixed-point numbers ``floor(scale * c) + shift``: sums are exact
whatever the order of tasks, and a vector is centred as the exact integer
``n * x - S`` before anything is multiplied.

Defined cases: rows whose vector is null or holds a null, NaN or infinite
entry are dropped; vectors of different widths are an error; components of
zero variance (rank below the width, a single vector, equal vectors) are not
returned, so fewer than ``k`` may come; a repeated row counts each time; a null id
is kept; an empty fit list gives an empty result; a deviation that does not
fit into a long is an error; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lowrank.llm.common import by_value, read_table

by_value(__name__)

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
MAX_WIDTH = 4096                   # d x d doubles on the driver: 128 MiB
BLOCK_ROWS = 4096
_LONG = 1 << 63


class Whitening(NamedTuple):
    n: int
    sums: list[int]                # exact column sums S
    components: np.ndarray         # k x d, unit rows, by falling eigenvalue
    eigenvalues: np.ndarray        # k
    trace: float


def fixed_point(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, x): usable vectors as longs; column expressions only."""
    v = F.col(vector_col)
    sound = v.isNotNull() & F.forall(v, lambda c: F.coalesce(F.abs(c.cast("double")) < F.lit(float("inf")), F.lit(False)))
    x = F.transform(v, lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double")).cast("long") + F.lit(SHIFT))
    return rows.where(sound).select(F.col(id_col).alias("vec_id"), x.alias("x"))


def _blocks(batches) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for b in batches:
        for at in range(0, b.num_rows, BLOCK_ROWS):
            part = b.slice(at, BLOCK_ROWS)
            x = part.column("x")
            widths = np.unique(np.diff(x.offsets.to_numpy()))
            if len(widths) > 1:
                raise ValueError("vectors of different widths")
            yield part, x.flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, int(widths[0]))


def _column_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n, width = 0, 0, None
    for _, x in _blocks(batches):
        if width not in (None, x.shape[1]):
            raise ValueError("vectors of different widths")
        width = x.shape[1]
        if int(np.abs(x).max(initial=0)) >= _LONG // BLOCK_ROWS:
            raise OverflowError("an entry is too large for exact sums")
        total = total + x.sum(axis=0).astype(object)          # Python integers: no overflow
        n += len(x)
    if n:
        cols = [pa.array(range(-1, width), pa.int32()), pa.array([str(n), *(str(t) for t in total)])]
        yield pa.RecordBatch.from_arrays(cols, names=["i", "s"])


def column_sums(vectors: DataFrame) -> tuple[int, list[int]]:
    """(n, S), exact."""
    part = vectors.select("x").mapInArrow(_column_sums, "i int, s string")
    rows = (part.groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.count("*").alias("tasks"))
            .orderBy("i").collect())
    if len(rows) > MAX_WIDTH + 1:
        raise ValueError(f"vectors are wider than {MAX_WIDTH}")
    if len({r["tasks"] for r in rows}) > 1:
        raise ValueError("vectors of different widths")
    return (int(rows[0]["s"]), [int(r["s"]) for r in rows[1:]]) if rows else (0, [])


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S as exact integers: longs where they fit, else Python integers."""
    far = max((abs(s) for s in sums), default=0)
    if n * max(int(x.max(initial=0)), -int(x.min(initial=0))) + far < _LONG:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _scatter(n: int, sums: list[int], project: np.ndarray | None):
    """Partial sums of y y' and of y per task: y = x - S / n, or its
    projections ``project @ y``; row q holds the plain sums."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = None
        for _, x in _blocks(batches):
            y = centred(x, n, sums).astype(np.float64) / n
            if project is not None:
                y = y @ project.T
            part = np.vstack([y.T @ y, y.sum(axis=0)])
            acc = part if acc is None else acc + part
        if acc is not None:
            q = acc.shape[1]
            i, j = np.divmod(np.arange(acc.size), q)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(acc.ravel())], names=["i", "j", "v"])
    return run


def covariance(vectors: DataFrame, n: int, sums: list[int], project: np.ndarray | None = None) -> np.ndarray:
    """Covariance (divisor n) of the vectors, or of their projections."""
    part = vectors.select("x").mapInArrow(_scatter(n, sums, project), "i int, j int, v double")
    rows = part.groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    q = len(sums) if project is None else len(project)
    m = np.zeros((q + 1, q))
    m[rows["i"], rows["j"]] = rows["v"]
    mean = m[q] / n                # rounding only: rows were centred before
    return m[:q] / n - np.outer(mean, mean)


def pivoted_cholesky(a: np.ndarray, tol: float | None = None) -> np.ndarray:
    """L with ``a`` = L L' for a symmetric positive semidefinite ``a``: rows in
    the order of ``a``, one column per pivot, the largest remaining diagonal
    entry first; columns end at the numerical rank."""
    a = np.array(a, np.float64)
    d = len(a)
    diag = a.diagonal().copy()
    floor = max(diag.max(initial=0.0), 0.0) * (d * np.finfo(float).eps if tol is None else tol)
    low, pivots = np.zeros((d, d)), []
    for r in range(d):
        p = int(np.argmax(diag))
        if not diag[p] > floor:
            break
        col = a[:, p] - low[:, :r] @ low[p, :r]
        col[p] = diag[p]
        col[pivots] = 0.0              # triangular in pivot order
        low[:, r] = col / np.sqrt(diag[p])
        diag -= low[:, r] ** 2
        pivots.append(p)
        diag[pivots] = -np.inf
    return low[:, :len(pivots)]


def jacobi_columns(m: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """``m`` times a rotation that makes its columns orthogonal, by falling
    norm: one-sided Jacobi over round-robin sets of disjoint pairs."""
    m = np.array(m, np.float64)
    q = m.shape[1]
    if q < 2:
        return m
    players = list(range(q)) + ([-1] if q % 2 else [])
    half = len(players) // 2
    for _ in range(sweeps):
        worst = 0.0
        for _ in range(len(players) - 1):
            pairs = [(min(a, b), max(a, b)) for a, b in zip(players[:half], players[:half - 1:-1]) if min(a, b) >= 0]
            i, j = np.array(pairs).T
            x, y = m[:, i], m[:, j]
            a, b, c = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            size = np.sqrt(a * b)
            off = np.divide(np.abs(c), size, out=np.zeros_like(c), where=size > 0)
            worst = max(worst, off.max(initial=0.0))
            turn = off > 1e-16
            zeta = np.divide(b - a, 2 * c, out=np.zeros_like(c), where=turn)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.sqrt(1 + zeta * zeta))
            t = np.where(turn, t, 0.0)
            cos = 1 / np.sqrt(1 + t * t)
            sin = cos * t
            m[:, i], m[:, j] = cos * x - sin * y, sin * x + cos * y
            players = [players[0], players[-1], *players[1:-1]]
        if worst < 1e-15 * q:
            break
    else:
        raise ArithmeticError(f"Jacobi rotations did not converge in {sweeps} sweeps")
    return m[:, np.argsort(-(m * m).sum(axis=0), kind="stable")]


def principal(cov: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(components, eigenvalues) of a covariance matrix: at most ``k``, and
    only those of non-zero variance."""
    turned = jacobi_columns(pivoted_cholesky(cov))
    e = (turned * turned).sum(axis=0)
    keep = np.flatnonzero(e > e.max(initial=0.0) * len(cov) * np.finfo(float).eps)[:k]
    return (turned[:, keep] / np.sqrt(e[keep])).T, e[keep]


def fit_whitening(vectors: DataFrame, k: int = COMPONENTS) -> Whitening:
    n, sums = column_sums(vectors)
    if not n:
        return Whitening(0, [], np.zeros((0, 0)), np.zeros(0), 0.0)
    cov = covariance(vectors, n, sums)
    components, e = principal(cov, k)
    return Whitening(n, sums, components, e, float(np.trace(cov)))


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened covariance minus the identity, from the data."""
    if not len(model.eigenvalues):
        return 0.0
    scaled = model.components / np.sqrt(model.eigenvalues)[:, None]
    return float(np.abs(covariance(vectors, model.n, model.sums, scaled) - np.eye(len(scaled))).max())


def _whiten(model: Whitening, error: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, q = model.n, len(model.eigenvalues)
        scaled = model.components / np.sqrt(model.eigenvalues)[:, None]
        share = model.eigenvalues / model.trace if q else model.eigenvalues
        for part, x in _blocks(batches):
            y = centred(x, n, model.sums)
            if y.dtype != object and int(np.abs(y).max(initial=0)) ** 2 * y.shape[1] < _LONG:
                deviation = (y * y).sum(axis=1)
            else:
                deviation = [sum(int(c) ** 2 for c in row) for row in y]
                if max(deviation, default=0) >= _LONG:
                    raise OverflowError("a deviation does not fit into a long")
            rows = len(x)
            z = (y.astype(np.float64) / n) @ scaled.T
            at = np.repeat(np.arange(rows), q)
            ids = part.column("vec_id").take(pa.array(at))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(np.tile(np.arange(1, q + 1), rows), pa.int32()), pa.array(np.full(rows * q, n)),
                 pa.array(np.asarray(deviation, np.int64)[at]), pa.array(z.ravel()),
                 pa.array(np.tile(share, rows)), pa.array(np.full(rows * q, error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return run


def whiten(vectors: DataFrame, model: Whitening, error: float) -> DataFrame:
    """One row per vector and component."""
    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.mapInArrow(_whiten(model, error), f"vec_id {kind}, component int, n long, deviation long, "
                              "whitened double, explained double, identity_error double")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = fixed_point(read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    model = fit_whitening(vectors)
    return whiten(vectors, model, identity_error(vectors, model))
