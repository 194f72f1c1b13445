"""Build a ``TallMatrix`` from ordinary table columns (S4) or coordinate
entries (S2, grouping half).  Everything stays lazy except one small
aggregate that learns the shape when it is not given."""

from __future__ import annotations

import warnings
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..matrix import DENSE, SPARSE, TallMatrix
from ..session import hash_joins, release, store


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _row_id(id_col: str | Column | None) -> Column:
    if id_col is None:
        # no key in the table: ids are unique, not consecutive
        return F.monotonically_increasing_id().alias("row_id")
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return col.cast("long").alias("row_id")


def as_double_array(col: str | Column) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.transform(c, lambda x: x.cast("double"))


CUT_MODES = ("error", "cut")


def cut_rows(df: DataFrame, features: Column, n_cols: int, wider: str = "error") -> Column:
    """P1 on the dense layout: the first ``n_cols`` elements of a row.  A wider
    row fails the job, or with ``wider='cut'`` is cut, with a warning that
    gives the number of elements cut (one extra scan)."""
    if wider not in CUT_MODES:
        raise ValueError(f"wider must be one of {CUT_MODES}")
    over = F.size(features) > n_cols
    if wider == "cut":
        lost = df.where(over).agg(F.sum(F.size(features) - n_cols)).first()[0]
        if lost:
            warnings.warn(f"cut {lost} elements beyond column {n_cols - 1}")
        return F.slice(features, 1, n_cols)
    message = F.concat(F.lit("row of width "), F.size(features).cast("string"), F.lit(f", expected {n_cols}"))
    return F.when(over, F.raise_error(message).cast("array<double>")).otherwise(features)


def matrix_from_array(df: DataFrame, array_col: str, id_col: str | Column | None = None,
                      n_cols: int | None = None, n_rows: int | None = None, wider: str = "error") -> TallMatrix:
    """Dense matrix from one ARRAY column (any numeric element type).

    With ``n_cols`` given, wider rows fail or are cut (``cut_rows``);
    otherwise the width is read from the data and must be the same in every
    row.
    """
    feats = as_double_array(array_col)
    if n_cols is not None:
        feats = cut_rows(df, feats, n_cols, wider)
    out = df.select(_row_id(id_col), feats.alias("features"))
    if n_cols is None:
        # width from one row; every kernel checks each row against it
        first = out.select(F.size("features").alias("w")).first()
        if first is None:
            raise ValueError("empty matrix")
        n_cols = int(first["w"])
    return TallMatrix(out, n_cols=n_cols, n_rows=n_rows, kind=DENSE)


def matrix_from_columns(df: DataFrame, cols: list[str], id_col: str | Column | None = None,
                        n_rows: int | None = None) -> TallMatrix:
    """Dense matrix whose row is a list of numeric columns."""
    out = df.select(_row_id(id_col), F.array(*[F.col(c).cast("double") for c in cols]).alias("features"))
    return TallMatrix(out, n_cols=len(cols), n_rows=n_rows, kind=DENSE)


def matrix_from_vectors(df: DataFrame, vector_col: str, id_col: str | Column | None = None,
                        n_cols: int | None = None, n_rows: int | None = None) -> TallMatrix:
    """Dense matrix from a Spark ML ``Vector`` column."""
    from pyspark.ml.functions import vector_to_array
    tmp = df.select(_row_id(id_col), vector_to_array(F.col(vector_col)).alias("__v"))
    return matrix_from_array(tmp, "__v", "row_id", n_cols=n_cols, n_rows=n_rows)


def matrix_from_mllib(spark: SparkSession, rows, n_cols: int | None = None) -> TallMatrix:
    """Dense matrix from the RDD types of ``pyspark.mllib``: a ``RowMatrix`` or an
    RDD of vectors (row ids by position), an ``IndexedRowMatrix`` or an RDD of
    its rows (row ids by index; a missing index is no row)."""
    from pyspark.ml.functions import vector_to_array
    from pyspark.mllib.linalg import VectorUDT

    rdd = getattr(rows, "rows", rows)
    if callable(rdd):
        rdd = rdd()
    first = rdd.take(1)
    if not first:
        raise ValueError("empty matrix")
    if hasattr(first[0], "index") and hasattr(first[0], "vector"):
        pairs = rdd.map(lambda r: (int(r.index), r.vector))
    else:
        pairs = rdd.zipWithIndex().map(lambda x: (x[1], x[0]))
    schema = T.StructType([T.StructField("row_id", T.LongType()), T.StructField("vector", VectorUDT())])
    df = spark.createDataFrame(pairs, schema)
    return matrix_from_array(df.select("row_id", vector_to_array("vector").alias("features")), "features", "row_id", n_cols=n_cols)


def entries_frame(df: DataFrame, i: str = "i", j: str = "j", v: str = "v", base: int = 0) -> DataFrame:
    """Normalise coordinate entries to ``(i BIGINT, j INT, v DOUBLE)``, zero-based."""
    return df.select((F.col(i).cast("long") - base).alias("i"),
                     (F.col(j).cast("int") - base).alias("j"),
                     F.col(v).cast("double").alias("v"))


BAD_ENTRY = "bad matrix entry (empty field, or index outside the matrix): "


def keep_entries(entries: DataFrame, n_cols: int | None, n_rows: int | None = None,
                 outside: str = "error", unsummed: bool = False) -> DataFrame:
    """Keep entries inside the width with a non-zero value.  An entry
    without an index or a value, or with a negative index (a wrong base) or
    one past the shape, fails the job instead of going missing; with
    ``outside='cut'`` entries past the width are left out, with a warning that
    gives their number (one extra scan).  ``unsummed``: the values are parts of
    cells, so those that are null or zero are left to the sum."""
    if outside not in CUT_MODES:
        raise ValueError(f"outside must be one of {CUT_MODES}")
    cond = F.lit(True) if unsummed else F.col("v") != 0
    bad = F.col("i").isNull() | F.col("j").isNull() | (F.col("i") < 0) | (F.col("j") < 0)
    if not unsummed:
        bad = bad | F.col("v").isNull()
    if n_rows is not None:
        bad = bad | (F.col("i") >= n_rows)
    if n_cols is not None and outside == "error":
        bad = bad | (F.col("j") >= n_cols)
    elif n_cols is not None:
        lost = entries.where((F.col("j") >= n_cols) & cond).count()
        if lost:
            warnings.warn(f"cut {lost} entries beyond column {n_cols - 1}")
        cond = cond & (F.col("j") < n_cols)
    message = F.concat(F.lit(BAD_ENTRY), F.to_json(F.struct("i", "j", "v"), {"ignoreNullFields": "false"}))
    return entries.where(F.when(bad, F.raise_error(message).cast("boolean")).otherwise(cond))


def _extent(largest: int | None) -> int:
    """Size of an axis from its largest index; no index, no size."""
    return 0 if largest is None else int(largest) + 1


# Entries of a row past which it is kept in segments, and columns of a segment.
SEGMENT_ENTRIES = 1 << 20


def segmented(entries: DataFrame, n_rows: int, n_cols: int, segment_entries: int = SEGMENT_ENTRIES) -> TallMatrix:
    """Sparse matrix from entries whose values add up by cell: rows of at most
    ``segment_entries`` entries whole, longer ones in segments by column
    range, each at most ``segment_entries`` columns wide.

    The entries are cut into buckets of rows once, in binary, and stored; a
    task then puts a bucket together (``operators.packed``).  Buckets of more
    than LIGHT_ENTRIES entries, as long rows make them, take ``_heavy_rows``, so
    no task ever holds more than that or a whole long row."""
    from ..operators import packed as p
    from ..operators.blocks import arrow_batch_rows
    spark = entries.sparkSession
    with hash_joins(spark), arrow_batch_rows(spark, 10000, measured=False):
        raw = store(p.pack_raw(entries, p.bucket_count(n_rows)), p.GROUP_BYTES)
    with arrow_batch_rows(spark, 10000):
        heavy = [r["bucket"] for r in raw.groupBy("bucket").agg(F.sum("n").alias("n")).where(F.col("n") > p.LIGHT_ENTRIES).collect()]
        in_heavy = F.col("bucket").isin(heavy)
        packed = p.pack_cells(raw.where(~in_heavy) if heavy else raw, segment_entries)
        n_long = 0
        if heavy:
            parts, n_long = _heavy_rows(p.unpack_raw(raw.where(in_heavy)), segment_entries)
            for kind, part in enumerate(parts):
                packed = packed.unionByName(p.pack_rows(part, kind))
        packed = store(packed, p.GROUP_BYTES)
    release(raw)
    n_long += packed.agg(F.sum("long")).first()[0] or 0
    return TallMatrix(p.unpack_rows(packed, 0), n_cols=n_cols, n_rows=n_rows, kind=SPARSE, cells=p.unpack_cells(packed),
                      wide=p.unpack_rows(packed, 1) if n_long else None, wide_rows=n_long, packed=packed)


def _heavy_rows(entries: DataFrame, segment_entries: int) -> tuple[list[DataFrame], int]:
    """([whole rows, segments of long ones], number of long ones) of entries that add up by cell.

    Row lengths are counted with map-side sums; the few long rows are
    told apart by a join on the row id (broadcast when Spark finds them few,
    else split by AQE where skewed), and their entries are grouped by (row,
    column range), so neither step brings a whole long row into one task.
    The cells are stored once, since both groupings read them."""
    message = F.concat(F.lit(BAD_ENTRY), F.to_json(F.struct("i", "j", F.lit(None).cast("double").alias("v")), {"ignoreNullFields": "false"}))
    total = F.when(F.count("v") == 0, F.raise_error(message).cast("double")).otherwise(F.sum("v"))
    cells = store(entries.groupBy("i", "j").agg(total.alias("v")).where(F.col("v") != 0))
    long = store(cells.groupBy("i").count().where(F.col("count") > segment_entries).select("i"))
    n_long = long.count()
    if not n_long:
        return [_grouped(cells, ["i"])], 0
    ranged = cells.join(long, "i").withColumn("segment", F.floor(F.col("j") / segment_entries).cast("int"))
    return [_grouped(cells.join(long, "i", "left_anti"), ["i"]), _grouped(ranged, ["i", "segment"])], n_long


def _grouped(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Entries collected by ``keys`` (row id first) as sorted indices and values."""
    e = cells.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("j", "v"))).alias("e"))
    return e.select(F.col("i").alias("row_id"), *keys[1:], F.transform("e", lambda x: x["j"]).alias("indices"),
                    F.transform("e", lambda x: x["v"]).alias("values"))


def matrix_from_entries(entries: DataFrame, n_rows: int | None = None, n_cols: int | None = None,
                        duplicates: str = "error", outside: str = "error",
                        segment_entries: int = SEGMENT_ENTRIES) -> TallMatrix:
    """Sparse row matrix from zero-based ``(i, j, v)`` entries.

    Duplicated ``(i, j)`` pairs are summed (``duplicates='sum'``) or make the
    job that reads the rows fail (``'error'``, the default); ``'unique'`` skips the cell
    grouping for entries that are already one per cell; ``'total'`` sums as SQL does,
    leaving out null values (a cell with nothing else fails).  The first grouping shuffles on
    ``(i, j)``, so one hot row is spread over many tasks and its entries are
    combined map-side; the second grouping collects at most
    ``segment_entries`` entries: a matrix that is wider keeps longer rows in
    segments (``segmented``), which adds up the parts of a cell itself.
    """
    if duplicates not in ("error", "sum", "unique", "total"):
        raise ValueError("duplicates must be 'error', 'sum', 'unique' or 'total'")
    if duplicates == "total" and n_rows is not None and n_cols is not None and n_cols > segment_entries:
        return segmented(keep_entries(entries, n_cols, n_rows, outside, unsummed=True), n_rows, n_cols, segment_entries)
    if duplicates == "total":
        entries, duplicates = entries.groupBy("i", "j").agg(F.sum("v").alias("v")), "unique"
    if duplicates == "unique":
        # the caller guarantees one entry per cell (e.g. a grouping on (i, j))
        cells = keep_entries(entries, n_cols, n_rows, outside)
    else:
        total = F.sum("v")
        if duplicates == "error":
            message = F.concat(F.lit("duplicate (i, j) entries, pass duplicates='sum' to add them: "),
                               F.to_json(F.struct("i", "j")))
            total = F.when(F.count(F.lit(1)) > 1, F.raise_error(message).cast("double")).otherwise(total)
        cells = keep_entries(entries, n_cols, n_rows, outside).groupBy("i", "j").agg(total.alias("v"))
    if n_rows is None or n_cols is None:
        shape = cells.where(F.col("v") != 0).agg(F.max("i").alias("max_i"), F.max("j").alias("max_j")).first()
        if n_rows is None:
            n_rows = _extent(shape["max_i"])
        if n_cols is None:
            n_cols = _extent(shape["max_j"])
    cells = cells.where(F.col("v") != 0).select("i", "j", "v")
    if n_cols > segment_entries:
        return segmented(cells, n_rows, n_cols, segment_entries)
    # Entry queries read the cells as they are, without grouping them into rows.
    return TallMatrix(_grouped(cells, ["i"]), n_cols=n_cols, n_rows=n_rows, kind=SPARSE, cells=cells)


def with_absent_rows(m: TallMatrix) -> TallMatrix:
    """A sparse matrix with its absent all-zero rows as empty records, so that
    there is one record for each of the ``n_rows`` row ids.  The gaps come from an
    anti-join of ids alone; stored rows stay where they are.  A dense
    matrix has all its rows already."""
    if not m.is_sparse:
        return m
    ids = m.spark.range(m.n_rows).withColumnRenamed("id", "row_id")
    held = m.df.select("row_id") if m.wide is None else m.df.select("row_id").unionByName(m.wide.select("row_id").distinct())
    gaps = ids.join(held, "row_id", "left_anti")
    empty = gaps.select("row_id", F.array().cast("array<int>").alias("indices"), F.array().cast("array<double>").alias("values"))
    return m.with_df(m.df.select("row_id", "indices", "values").unionByName(empty))


def sparse_from_dense(m: TallMatrix) -> TallMatrix:
    """Drop the zeros of a dense matrix (no shuffle)."""
    m = m.counted()
    e = F.filter(F.arrays_zip(F.sequence(F.lit(0), F.size("features") - 1).alias("j"),
                              F.col("features").alias("v")), lambda x: x["v"] != 0)
    out = m.df.select("row_id", F.transform(e, lambda x: x["j"]).alias("indices"),
                      F.transform(e, lambda x: x["v"]).alias("values"))
    return TallMatrix(out, n_cols=m.n_cols, n_rows=m.n_rows, kind=SPARSE)


def dense_from_sparse(m: TallMatrix) -> TallMatrix:
    """Fill the zeros of a sparse matrix back in, absent rows included."""
    from ..operators.blocks import map_rows
    out = map_rows(with_absent_rows(m.whole()), lambda b: b.to_dense(), m.n_cols, "features")
    return TallMatrix(out, n_cols=m.n_cols, n_rows=m.n_rows, kind=DENSE)


def matrix_from_parquet(spark: SparkSession, path: str, n_cols: int | None = None,
                        n_rows: int | None = None) -> TallMatrix:
    """S3: a row table written by this library (dense ``features`` or
    sparse ``indices``/``values``), read back as a matrix."""
    df = spark.read.parquet(path)
    if "features" in df.columns:
        return matrix_from_array(df, "features", "row_id", n_cols=n_cols, n_rows=n_rows)
    rows = df.select(F.col("row_id").cast("long"), F.col("indices").cast("array<int>"),
                     F.col("values").cast("array<double>"), *(["segment"] if "segment" in df.columns else []))
    if n_rows is None or n_cols is None:
        shape = rows.agg(F.max("row_id").alias("i"), F.max(F.array_max("indices")).alias("j")).first()
        n_rows = n_rows if n_rows is not None else _extent(shape["i"])
        n_cols = n_cols if n_cols is not None else _extent(shape["j"])
    if "segment" not in rows.columns:
        return TallMatrix(rows, n_cols=n_cols, n_rows=n_rows, kind=SPARSE)
    wide = rows.where("segment is not null")
    n_wide = wide.agg(F.count_distinct("row_id")).first()[0]
    return TallMatrix(rows.where("segment is null").drop("segment"), n_cols=n_cols, n_rows=n_rows, kind=SPARSE,
                      wide=wide.select("row_id", "segment", "indices", "values") if n_wide else None, wide_rows=n_wide)
