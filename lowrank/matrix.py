"""The distributed matrix type every operator takes.

A ``TallMatrix`` is a DataFrame with one record per matrix row plus the
shape.  Two physical layouts:

* dense  : ``row_id BIGINT, features ARRAY<DOUBLE>`` (all rows ``n_cols`` wide)
* sparse : ``row_id BIGINT, indices ARRAY<INT>, values ARRAY<DOUBLE>``
  (sorted column indices, non-zeros only, at most ``n_cols`` per row)

A sparse row with very many entries is kept in segments of bounded size instead,
in a table of its own (``wide``), so that no task ever holds the row.

``n_rows`` may exceed the number of records: absent rows of a sparse matrix
are all-zero rows that still count (mean and norm divide by ``n_rows``).
Nothing here is collected; only the shape is held on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DENSE = "dense"
SPARSE = "sparse"


@dataclass(frozen=True)
class TallMatrix:
    df: DataFrame
    n_cols: int
    n_rows: int | None = None     # None: dense, counted by the first pass that needs it
    kind: str = DENSE
    cells: DataFrame | None = None    # sparse: the entries (i, j, v) the rows were grouped from, where known
    wide: DataFrame | None = None     # sparse: (row_id, segment, indices, values) of rows that ``df`` does not hold
    wide_rows: int = 0                # how many rows those are
    packed: DataFrame | None = None   # sparse: the rows of ``df`` and ``wide`` in binary records (operators.packed), where built so

    def __post_init__(self):
        if self.kind not in (DENSE, SPARSE):
            raise ValueError(f"unknown matrix kind {self.kind!r}")
        if self.n_cols < 1:
            raise ValueError("a matrix needs at least one column")
        if self.n_rows is None and self.kind == SPARSE:
            raise ValueError("a sparse matrix needs n_rows (absent rows count)")

    @property
    def is_sparse(self) -> bool:
        return self.kind == SPARSE

    @property
    def spark(self):
        return self.df.sparkSession

    def with_df(self, df: DataFrame) -> "TallMatrix":
        return replace(self, df=df, cells=None, packed=None)

    def narrow(self) -> "TallMatrix":
        """The rows that are held whole, as a matrix of their own."""
        return replace(self, wide=None, wide_rows=0, cells=None, packed=self.packed if self.wide is None else None)

    def whole(self) -> "TallMatrix":
        """The matrix with the segments of each row put together; for work that
        builds dense rows anyway, so a task holds a row of ``n_cols`` values."""
        if self.wide is None:
            return self
        e = F.sort_array(F.collect_list(F.struct("segment", "indices", "values")))
        rows = self.wide.groupBy("row_id").agg(e.alias("e"))
        rows = rows.select("row_id", F.flatten(F.col("e.indices")).alias("indices"), F.flatten(F.col("e.values")).alias("values"))
        return replace(self.narrow(), packed=None, df=self.df.select("row_id", "indices", "values").unionByName(rows))

    def stored_rows(self) -> int:
        """Rows that have a record (one count job)."""
        return self.df.count() + self.wide_rows

    def with_rows(self, n_rows: int) -> "TallMatrix":
        return replace(self, n_rows=int(n_rows))

    def counted(self) -> "TallMatrix":
        """This matrix with ``n_rows`` known (one count job if it was not)."""
        return self if self.n_rows is not None else self.with_rows(self.df.count())

    def entries(self) -> DataFrame:
        """Coordinate form ``(i BIGINT, j INT, v DOUBLE)``; zeros of a dense
        matrix are kept (they are values of the dense layout)."""
        if self.cells is not None:
            return self.cells
        if self.is_sparse:
            rows = self.df.select("row_id", "indices", "values")
            if self.wide is not None:
                rows = rows.unionByName(self.wide.select(*rows.columns))
            return (rows
                    .select(F.col("row_id").alias("i"),
                            F.explode(F.arrays_zip(F.col("indices").alias("j"),
                                                   F.col("values").alias("v"))).alias("e"))
                    .select("i", F.col("e.j").cast("int").alias("j"), F.col("e.v").alias("v")))
        return (self.df
                .select(F.col("row_id").alias("i"), F.posexplode("features").alias("j", "v"))
                .select("i", F.col("j").cast("int").alias("j"), "v"))
