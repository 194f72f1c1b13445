"""Row-wise operators (P1-P10): stored rows are never shuffled, partitioning is kept.

Simple element-wise work (centring, sampling) is a Spark expression; matrix
products run as Arrow-batched NumPy in ``mapInArrow`` with the small
right-hand matrix captured in the closure (the broadcast side, d x k).
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import center, hash_uniform
from ..matrix import DENSE, TallMatrix
from ..sources.tables import dense_from_sparse, with_absent_rows
from .blocks import Block, map_rows, wide_products
from .linalg import check_driver_size


# Widest row centred with a literal mean array in the plan; wider rows go
# through the Arrow kernel with the mean in the closure.
MAX_LITERAL_COLS = 4096


def center_rows(m: TallMatrix, mean: np.ndarray) -> TallMatrix:
    """Dense centred rows y - ym (sparse input is densified per row, absent
    rows included)."""
    mu = np.asarray(mean, dtype=np.float64)
    if m.n_cols > MAX_LITERAL_COLS:
        out = map_rows(with_absent_rows(m.whole()), lambda b: b.to_dense() - mu, m.n_cols, "features")
        return TallMatrix(out, n_cols=m.n_cols, n_rows=m.n_rows, kind=DENSE)
    if m.is_sparse:
        m = dense_from_sparse(m)
    out = m.df.select("row_id", center("features", mu).alias("features"))
    return TallMatrix(out, n_cols=m.n_cols, n_rows=m.n_rows, kind=DENSE)


def row_sample(m: TallMatrix, rate: float, salt: str = "") -> TallMatrix:
    """Keep a row with probability ``rate``, decided by a hash of its id,
    so the sample is the same on every run and for any partitioning."""
    if rate >= 1.0:
        return m
    taken = hash_uniform("row_id", salt) < F.lit(float(rate))
    if m.wide is None:
        return m.with_df(m.df.where(taken))
    wide = m.wide.where(taken)
    return replace(m.with_df(m.df.where(taken)), wide=wide, wide_rows=wide.agg(F.count_distinct("row_id")).first()[0])


def default_sample_rate(n_rows: int) -> float:
    """1 up to four digits of N, else 10^-(digits - 4)."""
    digits = len(str(abs(int(n_rows))))
    return 1.0 if digits <= 4 else 10.0 ** -(digits - 4)


def project(m: TallMatrix, w: np.ndarray, mean: np.ndarray | None = None,
            out_col: str = "values") -> DataFrame:
    """``(row_id, values)`` with values = (y - mean) W, or y W
    when ``mean`` is None (the reference's projected matrix is uncentred);
    absent rows of a sparse matrix have a projection too."""
    w = np.asarray(w, dtype=np.float64)
    check_driver_size(*w.shape, "projection matrix")
    shift = None if mean is None else np.asarray(mean, dtype=np.float64) @ w

    def fn(block: Block) -> np.ndarray:
        x = block.matmul(w)
        return x if shift is None else x - shift

    out = map_rows(with_absent_rows(m).narrow(), fn, w.shape[1], out_col)
    if m.wide is None:
        return out
    off = np.zeros(w.shape[1]) if shift is None else shift
    x = wide_products(m, w)
    return out.unionByName(x.select("row_id", F.array(*(F.col(f"x{p}") - float(off[p]) for p in range(w.shape[1]))).alias(out_col)))


def back_project(x: TallMatrix, c: np.ndarray, out_col: str = "values") -> DataFrame:
    """``(row_id, values)`` with values = x C' (k -> d)."""
    c = np.asarray(c, dtype=np.float64)
    check_driver_size(*c.shape, "loading matrix")
    return map_rows(x, lambda b: b.matmul(c.T), c.shape[0], out_col)


def reconstruct(m: TallMatrix, v: np.ndarray, mean: np.ndarray, out_col: str = "values") -> DataFrame:
    """Centred rows projected on span(V): (A V) V' (never d x d)."""
    v = np.asarray(v, dtype=np.float64)
    mu = np.asarray(mean, dtype=np.float64)
    return map_rows(with_absent_rows(m.whole()), lambda b: ((b.to_dense() - mu) @ v) @ v.T, v.shape[0], out_col)


def residual_rows(m: TallMatrix, w: np.ndarray, c: np.ndarray, mean: np.ndarray,
                  out_col: str = "values") -> DataFrame:
    """A - (a W) C' for the centred row a = y - mean.  With W = V
    and C = V this is the residual of the projection on span(V)."""
    w = np.asarray(w, dtype=np.float64)
    c = np.asarray(c, dtype=np.float64)
    mu = np.asarray(mean, dtype=np.float64)

    def fn(block: Block) -> np.ndarray:
        a = block.to_dense() - mu
        return a - (a @ w) @ c.T

    return map_rows(with_absent_rows(m.whole()), fn, m.n_cols, out_col)


def explode_values(df: DataFrame, col: str = "values", index: str = "j", value: str = "value") -> DataFrame:
    """Long form ``(row_id, j, value)`` of an array column."""
    return (df.select("row_id", F.posexplode(col).alias(index, value))
            .select("row_id", F.col(index).cast("int").alias(index), value))


def as_matrix(df: DataFrame, width: int, n_rows: int, col: str = "values") -> TallMatrix:
    """Wrap a ``(row_id, <col>)`` result as a dense matrix for chaining."""
    return TallMatrix(df.select("row_id", F.col(col).alias("features")), n_cols=width,
                      n_rows=n_rows, kind=DENSE)


# Largest d x k matrix shipped as a broadcast table (cells); above it the
# relational forms join by shuffle.
MAX_BROADCAST_CELLS = 1 << 20


def weights_frame(spark, w: np.ndarray) -> DataFrame:
    """A d x k matrix as rows ``(j INT, p INT, w DOUBLE)``, zeros dropped:
    broadcast up to MAX_BROADCAST_CELLS, else a table Spark joins by shuffle."""
    j, p = np.nonzero(w)
    table = pa.table({"j": pa.array(j, pa.int32()), "p": pa.array(p, pa.int32()), "w": w[j, p]})
    frame = spark.createDataFrame(table, "j int, p int, w double")
    return F.broadcast(frame) if w.size <= MAX_BROADCAST_CELLS else frame


def project_entries(m: TallMatrix, w: np.ndarray) -> DataFrame:
    """P5 in relational form (J3): entries joined to the weights on the column
    index, summed per (row, component): ``(row_id, p, x)``.  The grouping combines map-side, so a row with many entries is pre-summed
    in every task before the shuffle."""
    wf = weights_frame(m.spark, np.asarray(w, dtype=np.float64))
    e = m.entries().where(F.col("v") != 0)
    return (e.join(wf, "j")
            .groupBy(F.col("i").alias("row_id"), "p")
            .agg(F.sum(F.col("v") * F.col("w")).alias("x")))


def center_entries(m: TallMatrix, mean: np.ndarray) -> DataFrame:
    """``(i, j, v)`` with v - mean_j at the stored non-zeros only
    (zeros stay implicit; their centred value is -mean_j)."""
    return (m.entries().join(means_side(m.spark, mean), "j")
            .select("i", "j", (F.col("v") - F.col("m")).alias("v")))


def means_side(spark, mean: np.ndarray) -> DataFrame:
    """The column means as a join side ``(j, m)``: broadcast when d is under
    MAX_BROADCAST_CELLS, else a plain table Spark joins by shuffle."""
    means = spark.createDataFrame([(int(j), float(x)) for j, x in enumerate(mean)], "j int, m double")
    return F.broadcast(means) if len(mean) <= MAX_BROADCAST_CELLS else means
