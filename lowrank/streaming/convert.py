"""Incremental text -> Parquet conversion (K1/K2 as file streams).

COO lines are independent, so the stream writes entry rows ``(i, j, v)``;
rows split across files are merged when the entries are read back with
``matrix_from_entries``.  DENSE lines get consecutive row ids across micro-batches
from a manifest of line counts per file, kept beside the rows: a batch starts
where the batches before it end, so its ids are those of one full read as
long as later files sort after earlier ones.
"""

from __future__ import annotations

import os

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.arrays import parse_dense
from ..session import ensure_checkpoint_dir
from ..sources.text import number_lines, parse_coo_lines, with_offsets


def _checkpoint(spark: SparkSession, name: str, checkpoint: str | None) -> str:
    if checkpoint:
        return checkpoint
    return os.path.join(ensure_checkpoint_dir(spark), "streams", name)


def coo_folder_to_parquet(spark: SparkSession, src: str, dst: str, base: int = 0,
                          checkpoint: str | None = None, once: bool = True) -> StreamingQuery:
    """Convert COO text files arriving in ``src`` into Parquet entries at
    ``dst`` (zero-based).  ``once``: process what is there and stop
    (``availableNow``); otherwise keep running."""
    lines = spark.readStream.format("text").load(src)
    entries = parse_coo_lines(lines, base).where(F.col("v") != 0)
    writer = (entries.writeStream.format("parquet").option("path", dst)
              .option("checkpointLocation", _checkpoint(spark, "coo-" + os.path.basename(dst.rstrip("/")), checkpoint))
              .outputMode("append"))
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime="30 seconds")
    return writer.start()


def _path_exists(spark: SparkSession, path: str) -> bool:
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hpath)


def manifest(spark: SparkSession, dst: str):
    """(file, lines, batch) of a converted folder, one row per file."""
    return spark.read.schema("file string, lines long, batch long").parquet(os.path.join(dst, MANIFEST))


MANIFEST = "_manifest"


def _convert_batch(batch, batch_id: int, dst: str) -> None:
    """Rows and manifest of one micro-batch.  Both depend only on the batch and the
    manifests of earlier ones and replace what an earlier attempt left."""
    spark = batch.sparkSession
    before = 0
    if _path_exists(spark, os.path.join(dst, MANIFEST)):
        before = manifest(spark, dst).where(F.col("batch") < batch_id).agg(F.sum("lines")).first()[0] or 0
    lines = with_offsets(number_lines(batch.select("file", "block", parse_dense("value").alias("features"))))
    rows = lines.select((F.col("file_start") + F.col("line") + before).alias("row_id"), "file", "line", "features")
    rows.write.mode("overwrite").parquet(os.path.join(dst, f"batch={batch_id}"))
    done = spark.read.schema(rows.schema).parquet(os.path.join(dst, f"batch={batch_id}"))
    (done.groupBy("file").agg(F.count("*").alias("lines"))
     .write.mode("overwrite").parquet(os.path.join(dst, MANIFEST, f"batch={batch_id}")))


def dense_folder_to_parquet(spark: SparkSession, src: str, dst: str, checkpoint: str | None = None,
                            once: bool = True) -> StreamingQuery:
    """Convert DENSE text files arriving in ``src`` into Parquet rows
    ``(row_id, file, line, features)``; blank lines are skipped.  Each micro-batch
    holds whole files and is written to its own folder with overwrite, so a
    retried batch replaces its own output (exactly once) and its row ids stay."""
    lines = (spark.readStream.format("text").load(src)
             .select("value", F.col("_metadata.file_path").alias("file"),
                     F.col("_metadata.file_block_start").alias("block"))
             .where(F.trim(F.col("value")) != ""))

    def write_batch(batch, batch_id):
        _convert_batch(batch, batch_id, dst)

    writer = (lines.writeStream.foreachBatch(write_batch)
              .option("checkpointLocation", _checkpoint(spark, "dense-" + os.path.basename(dst.rstrip("/")), checkpoint)))
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime="30 seconds")
    return writer.start()
