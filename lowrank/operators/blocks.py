"""Arrow-batch kernels: the per-partition part of the matrix operators.

Spark partitions the rows and ships each partition to ``mapInArrow`` as
Arrow record batches.  A batch becomes a ``Block`` (NumPy dense matrix or
CSR triple), the kernel multiplies it with small driver-side matrices
captured in the closure (d x k at most), and per-partition partial sums are
emitted as rows ``(stat, r, cb, c0..c{W-1})``.  Spark then merges them with
an ordinary ``groupBy(stat, r, cb).agg(sum)``: map-side partial aggregation
plus a shuffle of model-sized rows, never of data rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..matrix import TallMatrix

# Width of one partial-sum record: wide matrices are cut into column blocks
# of this many doubles so the aggregate stays a fixed, codegen-friendly size.
BLOCK_WIDTH = 32
# Most doubles a kernel densifies at once (32 MiB).
CHUNK_CELLS = 1 << 22
# Target size of one Arrow batch handed to a kernel (doubles).
BATCH_CELLS = 1 << 22


# Most bytes of one Arrow batch of sparse rows, whatever the width of the matrix.
BATCH_BYTES = 32 << 20
# Doubles of ``Keyed`` sums past which a task hands them to Spark and starts anew.
HELD_CELLS = 1 << 21


class Keyed(NamedTuple):
    """Rows of a tall d x q sum that are present: row ``keys[t]`` is
    ``values[t]``, keys rising.  Its size follows the data, not d."""
    keys: np.ndarray
    values: np.ndarray


def _sum_by_key(keys: np.ndarray, values: np.ndarray) -> Keyed:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if keys.size else np.zeros(0, np.int64)
    return Keyed(keys[first], np.add.reduceat(values[order], first, axis=0) if keys.size else values)


class KeyedSum:
    """Running sum of ``Keyed`` parts; parts are merged when they hold twice
    the rows of the sum, so a row is touched a bounded number of times."""

    def __init__(self):
        self.parts: list[Keyed] = []
        self.held = self.merged = 0

    def add(self, part: Keyed) -> None:
        self.parts.append(part)
        self.held += part.keys.size
        if self.held > 2 * self.merged + (1 << 16):
            self.total()

    def cells(self) -> int:
        """Doubles held, keys and the order of a merge included."""
        return self.held * (self.parts[0].values.shape[1] + 2) if self.parts else 0

    def total(self) -> Keyed:
        out = self.parts[0] if len(self.parts) == 1 else _sum_by_key(
            np.concatenate([p.keys for p in self.parts]), np.concatenate([p.values for p in self.parts]))
        self.parts, self.held, self.merged = [out], out.keys.size, out.keys.size
        return out


class Block:
    """Rows of one Arrow batch, dense or CSR."""

    __slots__ = ("n", "d", "dense", "indptr", "indices", "values", "row_of", "_by_column")

    def __init__(self, n: int, d: int, dense=None, indptr=None, indices=None, values=None):
        self.n, self.d = n, d
        self.dense = dense
        self.indptr, self.indices, self.values = indptr, indices, values
        self.row_of = self._by_column = None
        if dense is None:
            self.row_of = np.repeat(np.arange(n), np.diff(indptr))

    @property
    def is_dense(self) -> bool:
        return self.dense is not None

    def matmul(self, w: np.ndarray) -> np.ndarray:
        """Y @ W  (n x k)."""
        if self.is_dense:
            return self.dense @ w
        out = np.zeros((self.n, w.shape[1]))
        filled = np.flatnonzero(np.diff(self.indptr))
        if filled.size:
            out[filled] = np.add.reduceat(self.values[:, None] * w[self.indices], self.indptr[filled], axis=0)
        return out

    def _columns(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(columns present, order of the entries by column, first entry of each)."""
        if self._by_column is None:
            order = np.argsort(self.indices, kind="stable")
            cols = self.indices[order]
            first = np.flatnonzero(np.r_[True, cols[1:] != cols[:-1]]) if cols.size else np.zeros(0, np.int64)
            self._by_column = cols[first], order, first
        return self._by_column

    def by_column(self, per_entry: np.ndarray) -> Keyed:
        """Sums of a (entries x q) array over the entries of each column present (CSR)."""
        cols, order, first = self._columns()
        return Keyed(cols, np.add.reduceat(per_entry[order], first, axis=0) if cols.size else per_entry)

    def t_matmul(self, x: np.ndarray) -> np.ndarray | Keyed:
        """Y^T @ X (d x k); for CSR the rows of the columns present."""
        if self.is_dense:
            return self.dense.T @ x
        return self.by_column(self.values[:, None] * x[self.row_of])

    def col_sum(self) -> np.ndarray:
        if self.is_dense:
            return self.dense.sum(axis=0)
        return np.bincount(self.indices, weights=self.values, minlength=self.d)

    def to_dense(self) -> np.ndarray:
        if self.is_dense:
            return self.dense
        out = np.zeros((self.n, self.d))
        out[self.row_of, self.indices] = self.values
        return out

    def pieces(self, width: int):
        """Row ranges of a CSR block whose entries times ``width`` hold about
        CHUNK_CELLS doubles (a longer row is a range of its own)."""
        if self.is_dense:
            yield self
            return
        step, lo = max(1, CHUNK_CELLS // max(1, width)), 0
        while lo < self.n:
            hi = max(lo + 1, int(np.searchsorted(self.indptr, self.indptr[lo] + step, "right")) - 1)
            yield self.rows(lo, min(hi, self.n))
            lo = hi

    def rows(self, lo: int, hi: int) -> "Block":
        """Rows lo..hi-1 as a block of their own (views, no copy for dense)."""
        if self.is_dense:
            return Block(hi - lo, self.d, dense=self.dense[lo:hi])
        a, b = self.indptr[lo], self.indptr[hi]
        return Block(hi - lo, self.d, indptr=self.indptr[lo:hi + 1] - a,
                     indices=self.indices[a:b], values=self.values[a:b])

    def chunks(self, max_cells: int = CHUNK_CELLS):
        """Split into row ranges whose dense form holds at most ``max_cells``
        doubles, so densifying a wide sparse block stays bounded."""
        step = max(1, max_cells // max(1, self.d))
        for lo in range(0, self.n, step):
            yield self.rows(lo, min(self.n, lo + step))

    def gram(self) -> np.ndarray:
        """Y'Y (d x d), densifying at most CHUNK_CELLS values at a time."""
        if self.is_dense:
            return self.dense.T @ self.dense
        g = np.zeros((self.d, self.d))
        for part in self.chunks():
            y = part.to_dense()
            g += y.T @ y
        return g


def _list_values(arr: pa.Array, width: int, what: str) -> np.ndarray:
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        raise ValueError(f"null {what} row: rows must be complete")
    values = pc.list_flatten(arr)
    if values.null_count:
        raise ValueError(f"null element in {what}: the matrix model has no missing values")
    out = values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    if width is not None:
        lengths = pc.list_value_length(arr).to_numpy(zero_copy_only=False)
        if lengths.size and (lengths.min() != width or lengths.max() != width):
            raise ValueError(f"dense row of width {lengths.min()}..{lengths.max()}, expected {width}")
    return out


def to_block(batch: pa.RecordBatch, kind: str, d: int) -> Block:
    n = batch.num_rows
    if kind == "dense":
        vals = _list_values(batch.column("features"), d, "features")
        dense = vals.reshape(n, d)
        if not np.isfinite(dense).all():
            raise ValueError("NaN or infinite value in the matrix")
        return Block(n, d, dense=dense)
    idx_arr = batch.column("indices")
    lengths = pc.list_value_length(idx_arr).to_numpy(zero_copy_only=False).astype(np.int64)
    indptr = np.zeros(n + 1, dtype=np.int64)
    np.cumsum(lengths, out=indptr[1:])
    indices = pc.list_flatten(idx_arr).to_numpy(zero_copy_only=False).astype(np.int64)
    values = _list_values(batch.column("values"), None, "values")
    if values.size != indices.size:
        raise ValueError("indices and values of a sparse row differ in length")
    if indices.size and (indices.min() < 0 or indices.max() >= d):
        raise ValueError(f"column index outside 0..{d - 1}")
    if not np.isfinite(values).all():
        raise ValueError("NaN or infinite value in the matrix")
    return Block(n, d, indptr=indptr, indices=indices, values=values)


def _input_columns(m: TallMatrix) -> list[str]:
    return ["row_id", "features"] if not m.is_sparse else ["row_id", "indices", "values"]


# Input of one kernel task, and how many times its partial it should be.
KERNEL_TASK_BYTES = 256 << 20
INPUT_PER_PARTIAL = 8
# Up to this many tasks are left as they are.
FREE_TASKS = 1024


def kernel_input(m: TallMatrix, partial_bytes: int = 0) -> DataFrame:
    """The rows a summing kernel reads.  Each task emits one partial (d x q
    sums, or an R factor), so past FREE_TASKS splits are merged without a
    shuffle until a task reads KERNEL_TASK_BYTES, or INPUT_PER_PARTIAL times
    its partial: the shuffled partials stay a fraction of the input, and the
    size of a task does not depend on the slots there happen to be."""
    from ..session import num_partitions, plan_size_bytes
    df = m.df.select(*_input_columns(m))
    n = num_partitions(df)
    if n is None or n <= FREE_TASKS:
        return df
    per_task = max(KERNEL_TASK_BYTES, INPUT_PER_PARTIAL * partial_bytes)
    want = max(FREE_TASKS, -(-plan_size_bytes(df) // per_task))
    return df.coalesce(int(want)) if n > want else df


def partial_schema(width: int = BLOCK_WIDTH) -> T.StructType:
    fields = [T.StructField("stat", T.StringType(), False),
              T.StructField("r", T.IntegerType(), False),
              T.StructField("cb", T.IntegerType(), False)]
    fields += [T.StructField(f"c{t}", T.DoubleType(), False) for t in range(width)]
    return T.StructType(fields)


def _emit(parts: dict[str, np.ndarray], width: int) -> pa.RecordBatch:
    stats, rs, cbs, cols = [], [], [], [[] for _ in range(width)]
    for name, mat in parts.items():
        keys, mat = mat if isinstance(mat, Keyed) else (None, np.atleast_2d(np.asarray(mat, dtype=np.float64)))
        rows, ncol = mat.shape
        keys = np.arange(rows) if keys is None else keys
        nblk = max(1, -(-ncol // width))
        padded = np.zeros((rows, nblk * width))
        padded[:, :ncol] = mat
        for b in range(nblk):
            chunk = padded[:, b * width:(b + 1) * width]
            stats.append(pa.repeat(pa.scalar(name, pa.string()), rows))
            rs.append(keys)
            cbs.append(np.full(rows, b, np.int32))
            for t in range(width):
                cols[t].append(chunk[:, t])
    arrays = [pa.concat_arrays(stats) if stats else pa.array([], pa.string()), pa.array(np.concatenate(rs) if rs else [], pa.int32()),
              pa.array(np.concatenate(cbs) if cbs else [], pa.int32())]
    arrays += [pa.array(np.concatenate(c) if c else np.zeros(0), pa.float64()) for c in cols]
    return pa.RecordBatch.from_arrays(arrays, schema=pa.schema(
        [("stat", pa.string(), False), ("r", pa.int32(), False), ("cb", pa.int32(), False)]
        + [(f"c{t}", pa.float64(), False) for t in range(width)]))


class Partials:
    """Sums of kernel outputs within one task: arrays, and ``Keyed`` rows."""

    def __init__(self):
        self.sums: dict = {}

    def add(self, parts: dict) -> None:
        for name, val in parts.items():
            if isinstance(val, Keyed):
                self.sums.setdefault(name, KeyedSum()).add(val)
                continue
            val = np.asarray(val, dtype=np.float64)
            self.sums[name] = self.sums[name] + val if name in self.sums else val.copy()

    def full(self) -> bool:
        """Whether the ``Keyed`` sums hold more than HELD_CELLS; Spark's
        map-side combining adds up what a task emits in parts."""
        return sum(v.cells() for v in self.sums.values() if isinstance(v, KeyedSum)) > HELD_CELLS

    def emit(self, width: int) -> pa.RecordBatch:
        out = _emit({n: v.total() if isinstance(v, KeyedSum) else v for n, v in self.sums.items()}, width)
        self.sums = {}
        return out


def partial_sums_df(m: TallMatrix, kernel: Callable[[Block], dict[str, np.ndarray]],
                    width: int = BLOCK_WIDTH) -> DataFrame:
    """Lazy DataFrame of the summed kernel outputs, one row per (stat, r, cb);
    of ``Keyed`` outputs only the rows present."""
    kind, d = m.kind, m.n_cols

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = Partials()
        for batch in batches:
            if batch.num_rows:
                acc.add(kernel(to_block(batch, kind, d)))
            if acc.full():
                yield acc.emit(width)
        if acc.sums:
            yield acc.emit(width)

    parts = kernel_input(m).mapInArrow(run, partial_schema(width))
    return (parts.groupBy("stat", "r", "cb")
            .agg(*[F.sum(f"c{t}").alias(f"c{t}") for t in range(width)]))


def wide_products(m: TallMatrix, v: np.ndarray) -> DataFrame:
    """``(row_id, x0..)``: y V of the rows kept in segments; each segment adds its
    part, and Spark sums the parts of a row with map-side combining."""
    d, q = m.n_cols, v.shape[1]
    names = [f"x{p}" for p in range(q)]
    schema = T.StructType([T.StructField("row_id", T.LongType())] + [T.StructField(n, T.DoubleType()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = to_block(batch, "sparse", d).matmul(v)
                yield pa.RecordBatch.from_arrays([batch.column("row_id").cast(pa.int64()), *(pa.array(x[:, p]) for p in range(q))],
                                                 names=["row_id", *names])

    parts = m.wide.select("row_id", "indices", "values").mapInArrow(run, schema)
    return parts.groupBy("row_id").agg(*(F.sum(n).alias(n) for n in names))


# Largest products of segmented rows (cells) that go to every task.
MAX_SHARED_CELLS = 1 << 20


def wide_cross(m: TallMatrix, v: np.ndarray, squares: bool = False) -> tuple[np.ndarray | None, np.ndarray, np.ndarray, np.ndarray]:
    """Of the rows kept in segments, with X = Y V: (X or None, sum X, X'X,
    [Y'X | column sums | sums of squares] with ``squares``).

    The products need the whole row and come first; few enough of them go to
    every task, else they are joined to the segments (AQE splits
    the one row that has many).  A second pass adds, per segment, the columns present."""
    from ..session import release, store
    q, d = v.shape[1], m.n_cols
    x = store(wide_products(m, v))
    names = [f"x{p}" for p in range(q)]
    shared = None
    if m.wide_rows * q <= MAX_SHARED_CELLS:
        t = collect_arrow(x)
        ids = t.column("row_id").to_numpy()
        order = np.argsort(ids)
        shared = ids[order], np.column_stack([t.column(n).to_numpy() for n in names])[order]
        sx, sxx = shared[1].sum(axis=0), shared[1].T @ shared[1]
        segments = m.wide.select("row_id", "indices", "values")
    else:
        arr = TallMatrix(x.select("row_id", F.array(*names).alias("features")), n_cols=q, n_rows=m.wide_rows)
        sums = partial_sums(arr, lambda b: {"sx": b.dense.sum(axis=0), "sxx": b.dense.T @ b.dense}, {"sx": (q,), "sxx": (q, q)})
        sx, sxx = sums["sx"], sums["sxx"]
        segments = m.wide.select("row_id", "indices", "values").join(x, "row_id")
    width = q + 2 * squares

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = Partials()
        for batch in batches:
            if not batch.num_rows:
                continue
            block = to_block(batch, "sparse", d)
            if shared is None:
                xs = np.column_stack([batch.column(n).to_numpy(zero_copy_only=False) for n in names])
            else:
                xs = shared[1][np.searchsorted(shared[0], batch.column("row_id").to_numpy())]
            y = block.values[:, None]
            acc.add({"by": block.by_column(np.hstack([y * xs[block.row_of]] + ([y, y * y] if squares else [])))})
            if acc.full():
                yield acc.emit(min(BLOCK_WIDTH, width))
        if acc.sums:
            yield acc.emit(min(BLOCK_WIDTH, width))

    w = min(BLOCK_WIDTH, width)
    parts = segments.mapInArrow(run, partial_schema(w)).groupBy("stat", "r", "cb").agg(*[F.sum(f"c{t}").alias(f"c{t}") for t in range(w)])
    with arrow_batch_rows(m.spark, batch_rows(m)):
        by = _placed(collect_arrow(parts), {"by": (d, width)}, w)["by"]
    release(x)
    return None if shared is None else shared[1], sx, sxx, by


def batch_rows(m: TallMatrix, default: int = 10000) -> int:
    """Rows per Arrow batch so one batch of dense rows is about BATCH_CELLS;
    batches of sparse rows are bounded by their bytes alone."""
    return default if m.is_sparse else int(max(64, min(default, BATCH_CELLS // max(1, m.n_cols))))


class arrow_batch_rows:
    """Temporarily cap the rows and bytes of Arrow batches for the actions a
    library call runs itself (bounded memory).  ``measured`` False: of rows whose
    size is fixed only the number is capped, since Spark would measure its batch
    again at each row."""

    ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
    BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"

    def __init__(self, spark, rows: int, measured: bool = True):
        self.spark, self.want, self.old = spark, {self.ROWS: rows, self.BYTES: BATCH_BYTES}, {}
        self.measured = measured

    def __enter__(self):
        for key, want in self.want.items():
            self.old[key] = old = self.spark.conf.get(key, None)
            if key == self.BYTES and not self.measured:
                self.spark.conf.set(key, str((1 << 31) - 1))           # Spark's "no limit", which it does not measure
            elif old is None or not old.isdigit() or not 0 < int(old) <= want:
                self.spark.conf.set(key, str(want))
        return self

    def __exit__(self, *exc):
        for key, old in self.old.items():
            if old is None:
                self.spark.conf.unset(key)
            else:
                self.spark.conf.set(key, old)
        return False


def collect_arrow(df: DataFrame) -> pa.Table:
    """Collect a small (model-sized) result as an Arrow table."""
    try:
        return df.toArrow()
    except AttributeError:  # pragma: no cover - older PySpark
        return pa.Table.from_pandas(df.toPandas(), preserve_index=False)


def partial_sums(m: TallMatrix, kernel: Callable[[Block], dict[str, np.ndarray]],
                 shapes: dict[str, tuple[int, ...]], width: int = BLOCK_WIDTH) -> dict[str, np.ndarray]:
    """Run ``kernel`` over every row block and return the summed results.

    ``shapes`` gives the shape of each named result; the collected data is
    the size of those results (model-sized), independent of the row count.
    """
    def as2d(shape):
        return (1, 1) if len(shape) == 0 else (1, shape[0]) if len(shape) == 1 else shape

    out = {name: np.zeros(as2d(shape)) for name, shape in shapes.items()}
    width = min(width, max(mat.shape[1] for mat in out.values()))
    with arrow_batch_rows(m.spark, batch_rows(m)):
        tbl = collect_arrow(partial_sums_df(m.whole(), kernel, width))
    out = _placed(tbl, {name: mat.shape for name, mat in out.items()}, width)
    return {name: (float(out[name][0, 0]) if len(shape) == 0 else out[name].reshape(shape))
            for name, shape in shapes.items()}


def _placed(tbl: pa.Table, shapes: dict[str, tuple[int, int]], width: int) -> dict[str, np.ndarray]:
    """Matrices from collected rows (stat, r, cb, c0..)."""
    out = {name: np.zeros(shape) for name, shape in shapes.items()}
    for batch in tbl.to_batches():
        for name, mat in out.items():
            part = batch.filter(pc.equal(batch.column("stat"), name))
            rows_, base = part.column("r").to_numpy(), part.column("cb").to_numpy() * width
            for t in range(width):
                ok = base + t < mat.shape[1]
                mat[rows_[ok], base[ok] + t] = part.column(f"c{t}").to_numpy()[ok]
    return out


def map_rows(m: TallMatrix, fn: Callable[[Block], np.ndarray], out_width: int,
             out_col: str = "values") -> DataFrame:
    """Row-wise map: ``(row_id, <out_col> ARRAY<DOUBLE>)`` with ``fn(block)``
    giving an (n x out_width) matrix.  No shuffle; partitioning is kept."""
    kind, d = m.kind, m.n_cols
    out_schema = T.StructType([T.StructField("row_id", T.LongType(), False),
                               T.StructField(out_col, T.ArrayType(T.DoubleType(), False), False)])
    arrow_schema = pa.schema([("row_id", pa.int64(), False),
                              (out_col, pa.list_(pa.field("element", pa.float64(), False)), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            block, lo = to_block(batch, kind, d), 0
            # Row ranges bound what a kernel densifies and what it returns.
            for part in block.chunks(CHUNK_CELLS * d // max(d, out_width)):
                res = np.ascontiguousarray(fn(part), dtype=np.float64)
                offsets = np.arange(0, res.size + 1, out_width, dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(res.ravel()),
                                                 type=arrow_schema.field(out_col).type)
                yield pa.RecordBatch.from_arrays([batch.column("row_id").slice(lo, part.n), lists], schema=arrow_schema)
                lo += part.n

    return m.df.select(*_input_columns(m)).mapInArrow(run, out_schema)


# Memory budget of one R-combining task of the TSQR tree (bytes).
TSQR_GROUP_BYTES = 256 << 20


def _r_factor(x: np.ndarray) -> np.ndarray:
    r = np.linalg.qr(x, mode="r")
    return r if r.shape[0] == x.shape[1] else np.vstack([r, np.zeros((x.shape[1] - r.shape[0], x.shape[1]))])


def tsqr(m: TallMatrix, rows_fn: Callable[[Block], np.ndarray], width: int,
         densifies: bool = True) -> np.ndarray:
    """R factor (width x width) of the tall matrix whose block rows are
    ``rows_fn(block)``, by tall-skinny QR.  ``densifies``: rows_fn builds
    dense d-wide rows, so sparse blocks are fed in bounded row chunks.

    Each partition folds its batches into one R (streaming QR).  The R
    factors are combined by a tree of ``applyInPandas`` groups whose fan-in
    keeps one group under TSQR_GROUP_BYTES, until few enough remain to be
    stacked on the driver (also under that bound).  R'R = A'A, but the
    conditioning is that of A, not of A'A.
    """
    from pyspark import TaskContext
    kind, d = m.kind, m.n_cols
    schema = T.StructType([T.StructField("pid", T.LongType(), False),
                           T.StructField("r", T.IntegerType(), False),
                           T.StructField("vals", T.ArrayType(T.DoubleType(), False), False)])
    arrow_schema = pa.schema([("pid", pa.int64(), False), ("r", pa.int32(), False),
                              ("vals", pa.list_(pa.field("element", pa.float64(), False)), False)])

    def r_batch(pid: int, r: np.ndarray) -> pa.RecordBatch:
        offsets = np.arange(0, r.size + 1, width, dtype=np.int32)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(r.shape[0], pid, dtype=np.int64)), pa.array(np.arange(r.shape[0], dtype=np.int32)),
             pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(r).ravel()),
                                      type=arrow_schema.field("vals").type)], schema=arrow_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            blk = to_block(batch, kind, d)
            for part in (blk.chunks() if densifies and not blk.is_dense else (blk,)):
                b = np.asarray(rows_fn(part), dtype=np.float64)
                r = _r_factor(b if r is None else np.vstack([r, b]))
        if r is not None:
            yield r_batch(TaskContext.get().partitionId(), r)

    def combine(pdf):
        import pandas as pd
        stack = np.vstack([np.asarray(v, dtype=np.float64) for v in pdf.sort_values(["pid", "r"])["vals"]])
        r = _r_factor(stack)
        return pd.DataFrame({"pid": np.full(width, int(pdf["gid"].iloc[0]), dtype=np.int64),
                             "r": np.arange(width, dtype=np.int32), "vals": list(r)})

    fan_in = max(2, TSQR_GROUP_BYTES // max(1, width * width * 8))
    from ..session import num_partitions
    source = kernel_input(m.whole(), width * width * 8)
    level = source.mapInArrow(run, schema)
    n = num_partitions(source)
    if n is None:
        n = fan_in + 1          # unknown: one combining level at least
    while n > fan_in:
        level = (level.withColumn("gid", F.floor(F.col("pid") / fan_in))
                 .groupBy("gid").applyInPandas(combine, schema))
        n = -(-n // fan_in)
    with arrow_batch_rows(m.spark, batch_rows(m)):
        rows = level.collect()
    if not rows:
        return np.zeros((width, width))
    rows.sort(key=lambda r: (r["pid"], r["r"]))
    return _r_factor(np.array([r["vals"] for r in rows], dtype=np.float64))


def sums_and_r(m: TallMatrix, kernel: Callable[[Block], dict[str, np.ndarray]],
               shapes: dict[str, tuple[int, ...]], rows_fn: Callable[[Block], np.ndarray],
               width: int) -> tuple[dict[str, np.ndarray], np.ndarray] | None:
    """One pass for both ``partial_sums(kernel)`` and ``tsqr(rows_fn)``.

    Each task emits its partial sums under key -1 and its R factor rows
    under its own task id; one grouped sum merges the former and passes the
    latter through.  Returns None when the task R factors would exceed
    TSQR_GROUP_BYTES on the driver (the caller then runs the two-pass
    form with the combining tree)."""
    from pyspark import TaskContext

    from ..session import num_partitions
    source = kernel_input(m, width * width * 8)
    n_tasks = num_partitions(source)
    if n_tasks is None or n_tasks * width * width * 8 > TSQR_GROUP_BYTES:
        return None
    kind, d = m.kind, m.n_cols
    cols = min(BLOCK_WIDTH, max([width] + [s[-1] if s else 1 for s in shapes.values()]))
    schema = T.StructType([T.StructField("pid", T.LongType(), False)] + partial_schema(cols).fields)

    def keyed(rb: pa.RecordBatch, key: int) -> pa.RecordBatch:
        keys = pa.array(np.full(rb.num_rows, key, dtype=np.int64))
        return pa.RecordBatch.from_arrays([keys] + rb.columns,
                                          schema=pa.schema([("pid", pa.int64(), False)] + list(rb.schema)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc, r = Partials(), None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            blk = to_block(batch, kind, d)
            acc.add(kernel(blk))
            b = np.asarray(rows_fn(blk), dtype=np.float64)
            r = _r_factor(b if r is None else np.vstack([r, b]))
            if acc.full():
                yield keyed(acc.emit(cols), -1)
        if acc.sums:
            yield keyed(acc.emit(cols), -1)
        if r is not None:
            yield keyed(_emit({"__r": r}, cols), TaskContext.get().partitionId())

    merged = (source.mapInArrow(run, schema)
              .groupBy("pid", "stat", "r", "cb")
              .agg(*[F.sum(f"c{t}").alias(f"c{t}") for t in range(cols)]))
    with arrow_batch_rows(m.spark, batch_rows(m)):
        tbl = collect_arrow(merged)
    pid = tbl.column("pid").to_numpy()
    stat = np.asarray(tbl.column("stat").to_pylist(), dtype=object)
    r_idx, cb = tbl.column("r").to_numpy(), tbl.column("cb").to_numpy()
    vals = np.column_stack([tbl.column(f"c{t}").to_numpy() for t in range(cols)]) if len(pid) else None

    def place(sel, rows, ncols):
        mat = np.zeros((rows, ncols))
        rr, base = r_idx[sel], cb[sel] * cols
        for t in range(cols):
            c = base + t
            ok = c < ncols
            mat[rr[ok], c[ok]] = vals[sel, t][ok]
        return mat

    sums = {}
    for name, shape in shapes.items():
        two = (1, 1) if len(shape) == 0 else (1, shape[0]) if len(shape) == 1 else shape
        mat = place((pid == -1) & (stat == name), *two)
        sums[name] = float(mat[0, 0]) if len(shape) == 0 else mat.reshape(shape)
    stacks = [place((pid == p) & (stat == "__r"), width, width) for p in np.unique(pid[pid >= 0])]
    r = _r_factor(np.vstack(stacks)) if stacks else np.zeros((width, width))
    return sums, r


def _merge_state(a, b):
    """Merge two (n, mean, R) states of centred rows: the pooled R factor
    gets one extra row sqrt(na nb / n) (mb - ma) for the between-part
    scatter (the matrix form of the parallel variance update)."""
    na, ma, ra = a
    nb, mb, rb = b
    if na == 0:
        return b
    if nb == 0:
        return a
    n = na + nb
    delta = mb - ma
    mean = ma + delta * (nb / n)
    return n, mean, _r_factor(np.vstack([ra, rb, np.sqrt(na * nb / n) * delta[None, :]]))


def _block_state(y: np.ndarray):
    mean = y.mean(axis=0)
    return y.shape[0], mean, _r_factor(y - mean)


def centred_tsqr(m: TallMatrix) -> tuple[int, np.ndarray, np.ndarray]:
    """One pass: row count, column mean and the R factor of the centred
    matrix (R'R = A'A), with no separate mean job.

    Each task centres its blocks on their own means and merges states
    (n, mean, R) exactly; the states go through the same size-bounded
    ``applyInPandas`` tree as ``tsqr``.  The stored rows only are counted;
    absent rows of a sparse matrix are merged in by the caller."""
    from pyspark import TaskContext

    from ..session import num_partitions
    kind, d = m.kind, m.n_cols
    schema = T.StructType([T.StructField("pid", T.LongType(), False),
                           T.StructField("r", T.IntegerType(), False),
                           T.StructField("vals", T.ArrayType(T.DoubleType(), False), False)])
    list_type = pa.list_(pa.field("element", pa.float64(), False))
    arrow_schema = pa.schema([("pid", pa.int64(), False), ("r", pa.int32(), False), ("vals", list_type, False)])

    def state_rows(pid: int, state) -> pa.RecordBatch:
        n, mean, r = state
        mats = [np.array([float(n)]), mean] + [r[i] for i in range(d)]
        lengths = np.array([m_.size for m_ in mats])
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(mats), pid, dtype=np.int64)),
             pa.array(np.arange(-2, d, dtype=np.int32)),
             pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(mats)), type=list_type)],
            schema=arrow_schema)

    def rows_state(pdf_rows):
        by_r = {int(r): np.asarray(v, dtype=np.float64) for r, v in pdf_rows}
        return int(by_r[-2][0]), by_r[-1], np.vstack([by_r[i] for i in range(d)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = (0, np.zeros(d), np.zeros((d, d)))
        for batch in batches:
            if batch.num_rows == 0:
                continue
            blk = to_block(batch, kind, d)
            for part in (blk.chunks() if not blk.is_dense else (blk,)):
                state = _merge_state(state, _block_state(part.to_dense()))
        if state[0]:
            yield state_rows(TaskContext.get().partitionId(), state)

    def combine(pdf):
        import pandas as pd
        state = (0, np.zeros(d), np.zeros((d, d)))
        for _, g in pdf.groupby("pid"):
            state = _merge_state(state, rows_state(zip(g["r"], g["vals"])))
        out = state_rows(int(pdf["gid"].iloc[0]), state)
        return pd.DataFrame({"pid": out.column(0).to_numpy(), "r": out.column(1).to_numpy(),
                             "vals": out.column(2).to_pylist()})

    fan_in = max(2, TSQR_GROUP_BYTES // max(1, (d * d + d + 1) * 8))
    source = kernel_input(m.whole(), d * d * 8)
    level = source.mapInArrow(run, schema)
    n = num_partitions(source)
    if n is None:
        n = fan_in + 1
    while n > fan_in:
        level = (level.withColumn("gid", F.floor(F.col("pid") / fan_in))
                 .groupBy("gid").applyInPandas(combine, schema))
        n = -(-n // fan_in)
    with arrow_batch_rows(m.spark, batch_rows(m)):
        rows = level.collect()
    state = (0, np.zeros(d), np.zeros((d, d)))
    groups: dict[int, list] = {}
    for row in rows:
        groups.setdefault(row["pid"], []).append((row["r"], row["vals"]))
    for pid in sorted(groups):
        state = _merge_state(state, rows_state(groups[pid]))
    return state
