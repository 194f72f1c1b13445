"""Text matrix formats.

Readers
  DENSE : one row per line, whitespace-separated doubles; blank lines are
          skipped; rows are numbered consecutively in file-name then line
          order without funnelling the data through one task.
  COO   : ``row,col,value`` lines, zero- or one-based, grouped into sparse
          rows.
Writers
  DENSE : every value followed by one space
  LIL   : ``{j:v,j:v}`` of the non-zeros, zero-based
  COO   : ``i,j,v`` of the non-zeros, zero-based
Conversions write Parquet row tables (the binary container of this library).
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrays import coo_line, dense_line, lil_line, parse_dense
from ..matrix import DENSE, TallMatrix
from ..session import store
from .tables import CUT_MODES, cut_rows, dense_from_sparse, matrix_from_entries, matrix_from_parquet, sparse_from_dense, with_absent_rows

FORMATS = ("DENSE", "LIL", "COO")


def parse_coo_lines(lines: DataFrame, base: int = 0) -> DataFrame:
    """``value`` text lines ``i,j,v`` -> entries ``(i, j, v)``, zero-based;
    blank lines are skipped, and any other line that is not three numbers
    fails the job."""
    e = lines.where(F.trim(F.col("value")) != "").select("value", *coo_fields(base))
    message = F.concat(F.lit("bad matrix entry in COO line: "), F.col("value"))
    return e.select(F.when(F.col("reason").isNotNull(), F.raise_error(message).cast("long")).otherwise(F.col("i")).alias("i"), "j", "v")


def read_coo_text(spark: SparkSession, path: str, base: int = 0, n_rows: int | None = None,
                  n_cols: int | None = None, duplicates: str = "error", outside: str = "error",
                  bad_lines: str = "error", rejects_to: str | None = None) -> TallMatrix:
    """COO text file or folder -> sparse row matrix.  Both indices are
    shifted by ``base``; rows split across files or unsorted are merged by
    the grouping, so file order does not matter.  A line that is not three
    numbers fails the job, or with ``bad_lines='drop'`` is left out with a warning
    that counts; ``rejects_to`` keeps such lines as a table (``write_rejects``)."""
    if bad_lines not in BAD_MODES:
        raise ValueError(f"bad_lines must be one of {BAD_MODES}")
    if bad_lines == "error":
        entries = parse_coo_lines(spark.read.text(path), base)
    else:
        lines = store(text_lines(spark, path).select("*", *coo_fields(base)).withColumn("pos", F.monotonically_increasing_id()))
        report_rejects(lines, path, rejects_to)
        entries = lines.where("reason is null").select("i", "j", "v")
    return matrix_from_entries(entries, n_rows=n_rows, n_cols=n_cols, duplicates=duplicates, outside=outside)


BAD_MODES = ("error", "drop")


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines that are not blank, with their file and split."""
    return (spark.read.text(path)
            .select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
            .where(F.trim(F.col("value")) != ""))


def coo_fields(base: int) -> list:
    """Columns i, j, v and ``reason`` (null for a good line) of a COO line."""
    parts = F.split(F.trim(F.col("value")), r"\s*,\s*")
    i, j, v = (F.get(parts, F.lit(n)).try_cast(kind) for n, kind in enumerate(("long", "int", "double")))
    reason = (F.when(F.size(parts) != 3, F.concat(F.size(parts).cast("string"), F.lit(" fields, expected 3")))
              .when(i.isNull() | j.isNull() | v.isNull(), "a field is not a number"))
    return [(i - base).alias("i"), (j - base).alias("j"), v.alias("v"), reason.alias("reason")]


def report_rejects(lines: DataFrame, path: str, rejects_to: str | None) -> int:
    """Count the rejected ones of stored lines, warn, and write them to ``rejects_to``."""
    n_bad = lines.where("reason is not null").count()
    if rejects_to is not None:
        write_rejects(lines, rejects_to)
    if n_bad:
        warnings.warn(f"dropped {n_bad} bad lines from {path}" + (f", kept in {rejects_to}" if rejects_to else ""))
    return n_bad


def write_rejects(lines: DataFrame, rejects_to: str) -> None:
    """Parquet table (file, line, reason, value) of rejected lines; ``line``
    counts the lines of a file that are not blank, from 0."""
    bad = with_offsets(lines.select("file", "block", "pos", "reason", "value")).where("reason is not null")
    bad.select("file", "line", "reason", "value").write.mode("overwrite").parquet(rejects_to)


def good_positions(lines: DataFrame) -> DataFrame:
    """``lines`` (with a boolean ``bad``) with ``good_pos``, which counts up by
    one over the good lines of each split."""
    schema = T.StructType([*lines.schema.fields, T.StructField("good_pos", T.LongType())])

    def run(batches):
        at = TaskContext.get().partitionId() << 33
        for b in batches:
            n = np.cumsum(~b.column("bad").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at + n - 1, pa.int64())], names=[*b.schema.names, "good_pos"])
            at += int(n[-1]) if len(n) else 0

    return lines.mapInArrow(run, schema)


def number_lines(lines: DataFrame) -> DataFrame:
    """Lines with ``file`` and ``block`` (the split's byte offset), stored once
    with ``pos``, which counts up by one inside each split."""
    return store(lines.withColumn("pos", F.monotonically_increasing_id()))


def with_offsets(lines: DataFrame) -> DataFrame:
    """``number_lines`` rows with ``line``, counted from 0 inside each file, and
    ``file_start``, the number of lines of the files before by name.

    The offsets are running sums over one row per split (by file) and one row
    per file (no longer than the driver's own listing of the files), stored so that Spark knows their size when it picks the join:
    the lines move only where the offsets are too large to broadcast.
    """
    splits = lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.withColumn("start", F.coalesce(F.sum("n").over(before.partitionBy("file").orderBy("block")), F.lit(0)))
    files = splits.groupBy("file").agg(F.sum("n").alias("m"))
    files = files.select("file", F.coalesce(F.sum("m").over(before.orderBy("file")), F.lit(0)).alias("file_start"))
    offsets = store(starts.join(files, "file").select("file", "block", "start", "first", "file_start"))
    return (lines.join(offsets, ["file", "block"])
            .withColumn("line", F.col("start") + F.col("pos") - F.col("first")).drop("start", "first", "pos"))


def read_dense_text(spark: SparkSession, path: str, n_cols: int | None = None,
                    bad_rows: str = "error", wider: str = "error", rejects_to: str | None = None) -> TallMatrix:
    """DENSE text file or folder -> dense row matrix with consecutive
    ``row_id`` (0-based) in file-name order, then line order.

    Lines are read once, into a stored table with their place inside their
    input split; split offsets are sums over that same table, so row ids do
    not depend on how a later job would split the files.

    A bad row has a token that is not a number or, with ``n_cols`` given,
    another number of values; ``wider='cut'`` accepts longer rows and keeps
    their first ``n_cols`` values, with a warning that counts the rest.
    ``bad_rows='error'`` fails with their count; ``'drop'`` leaves them out
    of the matrix and its numbering and warns with their count.  Good rows and
    bad ones come out of the same pass; ``rejects_to`` keeps the bad ones as a
    table (``write_rejects``).
    """
    if bad_rows not in BAD_MODES:
        raise ValueError(f"bad_rows must be one of {BAD_MODES}")
    if wider not in CUT_MODES:
        raise ValueError(f"wider must be one of {CUT_MODES}")
    parsed = parse_dense("value", strict=False)
    reason = F.when(F.exists(parsed, lambda x: x.isNull()), "a value is not a number")
    if n_cols is not None:
        other = F.size(parsed) < n_cols if wider == "cut" else F.size(parsed) != n_cols
        reason = reason.when(other, F.concat(F.lit("row of width "), F.size(parsed).cast("string"), F.lit(f", expected {n_cols}")))
    raw = text_lines(spark, path).select("file", "block", F.size(parsed).alias("width"), parsed.alias("features"),
                                         reason.alias("reason"), F.when(reason.isNotNull(), F.col("value")).alias("value"))
    lines = store(good_positions(raw.withColumns({"bad": F.col("reason").isNotNull(), "pos": F.monotonically_increasing_id()})))
    good = ~F.col("bad")
    n_rows, lo, hi, n_bad = lines.agg(F.count_if(good), F.min(F.when(good, F.col("width"))), F.max(F.when(good, F.col("width"))),
                                      F.count_if("bad")).first()
    if n_bad and rejects_to is not None:
        write_rejects(lines, rejects_to)
    if n_bad and bad_rows == "error":
        raise ValueError(f"{n_bad} bad DENSE rows in {path}; pass bad_rows='drop' to leave them out")
    if n_bad:
        warnings.warn(f"dropped {n_bad} bad DENSE rows from {path}")
    kept = lines.where(good).select("file", "block", "features", F.col("good_pos").alias("pos"))
    rows = with_offsets(kept).select((F.col("file_start") + F.col("line")).alias("row_id"), "features")
    if n_cols is None:
        lo, hi = lo or 0, hi or 0
        if lo != hi:
            raise ValueError(f"DENSE rows have widths {lo}..{hi}")
        n_cols = hi
    else:
        rows = rows.select("row_id", cut_rows(kept, F.col("features"), n_cols, wider).alias("features"))
    return TallMatrix(rows, n_cols=n_cols, n_rows=n_rows, kind=DENSE)


def matrix_lines(m: TallMatrix, fmt: str = "DENSE") -> DataFrame:
    """K3: one text column ``value`` in the chosen format (COO: one line
    per non-zero; DENSE and LIL: one line for each of the ``n_rows`` rows, the
    absent ones too), plus ``row_id`` so the caller can order or join."""
    fmt = fmt.upper()
    if fmt == "DENSE":
        if m.is_sparse:
            m = dense_from_sparse(m)
        return m.df.select("row_id", dense_line("features").alias("value"))
    sp = m if m.is_sparse else sparse_from_dense(m)
    if fmt == "LIL":
        return with_absent_rows(sp.whole()).df.select("row_id", lil_line("indices", "values").alias("value"))
    if fmt == "COO":
        e = sp.entries()
        return e.select(F.col("i").alias("row_id"), coo_line("i", "j", "v").alias("value"))
    raise ValueError(f"format must be one of {FORMATS}")


def row_table(m: TallMatrix) -> DataFrame:
    """The rows as one table (S3); with ``segment`` where rows are kept in segments."""
    if m.wide is None:
        return m.df
    rows = m.df.select("row_id", F.lit(None).cast("int").alias("segment"), "indices", "values")
    return rows.unionByName(m.wide.select(*rows.columns))


def write_matrix(m: TallMatrix, path: str, fmt: str = "DENSE", mode: str = "overwrite") -> None:
    """K3/K4: write the matrix as text (DENSE, LIL, COO) or Parquet.
    Text lines are written in row order, over all files in the order of their
    names (ranges of the row id, sorted inside)."""
    if fmt.upper() == "PARQUET":
        row_table(m).write.mode(mode).parquet(path)
        return
    lines = matrix_lines(m, fmt).repartitionByRange("row_id").sortWithinPartitions("row_id")
    lines.select("value").write.mode(mode).text(path)


def convert_to_parquet(spark: SparkSession, src: str, dst: str, fmt: str = "DENSE", base: int = 0,
                       n_cols: int | None = None, duplicates: str = "error", bad_rows: str = "error") -> TallMatrix:
    """K1/K2: text matrix folder -> Parquet row table, as one Spark job."""
    if fmt.upper() == "DENSE":
        m = read_dense_text(spark, src, n_cols, bad_rows)
    elif fmt.upper() == "COO":
        m = read_coo_text(spark, src, base=base, n_cols=n_cols, duplicates=duplicates)
    else:
        raise ValueError("input format must be DENSE or COO")
    row_table(m).write.mode("overwrite").parquet(dst)
    return matrix_from_parquet(spark, dst, m.n_cols, m.n_rows)
