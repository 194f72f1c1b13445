"""Column aggregates of a matrix (A1, A2, A4, A9) as DataFrame jobs.

Dense rows stay rows: each task folds its Arrow batches into one (count, mean,
M2) per column and ships ``n_cols`` rows; the triples of a column are merged by
deviations from their common mean, so the centred norm is right even when
column means are large.
Sparse rows take the moments of their non-zeros and merge the absent zeros in closed form.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..matrix import TallMatrix
from .blocks import BLOCK_WIDTH, arrow_batch_rows, batch_rows, collect_arrow, kernel_input, partial_sums_df, to_block
from .packed import packed_moments


def column_stats(m: TallMatrix) -> DataFrame:
    """``(j INT, total DOUBLE, mean DOUBLE, m2 DOUBLE)`` of every column, those
    of a sparse matrix without entries included; ``m2`` is the centred sum of
    squares over all ``n_rows`` rows.  A null row or element, or a row of
    another width, fails the job; so does a dense element that is not finite."""
    if not m.is_sparse:
        return _dense_stats(m)
    n = float(m.n_rows)
    if m.packed is not None:
        g = packed_moments(m.packed, m.n_cols).withColumn("total", F.col("own") * F.col("stored"))
    else:
        g = m.entries().groupBy("j").agg(F.sum("v").alias("total"), F.avg("v").alias("own"), F.count("v").alias("stored"),
                                         (F.var_pop("v") * F.count("v")).alias("spread"))
        columns = m.spark.range(m.n_cols).select(F.col("id").cast("int").alias("j"))
        g = columns.join(g, "j", "full").na.fill(0, ["total", "own", "stored", "spread"])
    # (count, mean, M2) of the entries merged with that of the implicit zeros: no difference of large sums.
    between = F.col("own") * F.col("own") * F.col("stored") * ((F.lit(n) - F.col("stored")) / n)
    return g.select("j", "total", (F.col("total") / n).alias("mean"), (F.col("spread") + between).alias("m2"),
                    F.lit(int(m.n_rows)).cast("long").alias("n"))


def merge_moments(a: tuple | None, b: tuple) -> tuple:
    """(count, means, M2s) of two sets of rows together."""
    if a is None:
        return b
    n = a[0] + b[0]
    apart = b[1] - a[1]
    return n, a[1] + apart * (b[0] / n), a[2] + b[2] + apart * apart * (a[0] * b[0] / n)


def _dense_stats(m: TallMatrix) -> DataFrame:
    d, step = m.n_cols, batch_rows(m)

    def values(batch: pa.RecordBatch) -> np.ndarray:
        try:
            return to_block(batch, "dense", d).dense
        except ValueError as e:
            raise ValueError(f"{e} (no null row, null element or row of another width than {d} may be in a matrix)") from e

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                y = values(batch.slice(at, step))
                mean = y.mean(axis=0)
                y = y - mean
                # The mean is rounded; what the deviations sum to corrects it and their squares.
                left = y.mean(axis=0)
                state = merge_moments(state, (len(y), mean + left, (y * y).sum(axis=0) - len(y) * left * left))
        if state is not None:
            n, mean, m2 = state
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), pa.array(np.full(d, n, np.int64)), pa.array(mean), pa.array(m2)],
                                             names=["j", "n", "own", "m2"])

    parts = kernel_input(m, 32 * d).mapInArrow(run, "j int, n long, own double, m2 double")
    of = Window.partitionBy("j")
    # A mean of means, weighted and taken about one of them, then squares about it: no difference of large sums.
    near = parts.withColumn("near", F.min("own").over(of))
    mean = near.withColumn("mean", F.col("near") + F.sum(F.col("n") * (F.col("own") - F.col("near"))).over(of) / F.sum("n").over(of))
    apart = F.col("own") - F.col("mean")
    return (mean.groupBy("j").agg(F.first("mean").alias("mean"), F.sum(F.col("m2") + F.col("n") * apart * apart).alias("m2"), F.sum("n").alias("n"))
            .select("j", (F.col("mean") * F.col("n")).alias("total"), "mean", "m2", "n"))


def column_means(m: TallMatrix) -> DataFrame:
    """A1: ``(j, mean)``; sums divide by ``n_rows`` (absent rows count)."""
    return column_stats(m).select("j", "mean")


def frobenius_sq(m: TallMatrix) -> DataFrame:
    """A2: one row ``(norm2)``, squared Frobenius norm of the centred matrix.
    For sparse input the implicit zeros are merged in closed form, right for any N
    at or above the number of stored rows."""
    return column_stats(m).agg(F.sum("m2").alias("norm2"))


def column_summary(m: TallMatrix) -> tuple[np.ndarray, float, int]:
    """Preprocessing pass: column mean (d values), centred norm and row
    count in one job; d rows reach the driver."""
    with arrow_batch_rows(m.spark, batch_rows(m)):
        tbl = collect_arrow(column_stats(m).select("j", "mean", "m2", "n"))
    j = tbl.column("j").to_numpy()
    if j.size and j.max() >= m.n_cols:
        raise ValueError(f"row wider than {m.n_cols} columns")
    mean = np.zeros(m.n_cols)
    mean[j] = tbl.column("mean").to_numpy()
    norm2 = float(np.sum(tbl.column("m2").to_numpy()))
    n = int(tbl.column("n").to_numpy().max()) if j.size else 0
    if m.n_rows is not None:
        n = m.n_rows
    return mean, norm2, n


def mean_and_norm(m: TallMatrix) -> tuple[np.ndarray, float]:
    mean, norm2, _ = column_summary(m)
    return mean, norm2


def column_abs_sums(m: TallMatrix, mean: np.ndarray | None = None) -> DataFrame:
    """A4: ``(j, abs_sum)`` = sum over rows of |y_ij - mean_j| (mean 0 when
    not given).  Absent zeros of a sparse matrix add (N - nnz_j) |mean_j|."""
    if mean is None:
        mean = np.zeros(m.n_cols)
    spark = m.spark
    if not m.is_sparse:
        mu = np.asarray(mean, dtype=np.float64)
        width = min(BLOCK_WIDTH, m.n_cols)
        sums = partial_sums_df(m, lambda b: {"s": np.abs(b.dense - mu).sum(axis=0)}, width)
        cells = sums.select("cb", F.posexplode(F.array(*[f"c{t}" for t in range(width)])).alias("t", "abs_sum"))
        return cells.select((F.col("cb") * width + F.col("t")).alias("j"), "abs_sum").where(F.col("j") < m.n_cols)
    from .rows import means_side
    means = spark.createDataFrame([(j, float(x)) for j, x in enumerate(mean)], "j int, m double")
    e = m.entries().join(means_side(spark, mean), "j")
    present = e.groupBy("j").agg(F.sum(F.abs(F.col("v") - F.col("m"))).alias("s"),
                                 F.count(F.lit(1)).alias("nnz"))
    return (means.join(present, "j", "left")
            .select("j", (F.coalesce("s", F.lit(0.0))
                          + (F.lit(float(m.n_rows)) - F.coalesce("nnz", F.lit(0))) * F.abs("m")).alias("abs_sum")))


def column_abs_norm(m: TallMatrix, mean: np.ndarray | None = None) -> DataFrame:
    """One row ``(abs_norm)``, the largest column absolute sum."""
    return column_abs_sums(m, mean).agg(F.max("abs_sum").alias("abs_norm"))

