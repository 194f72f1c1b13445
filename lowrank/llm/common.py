"""Helpers shared by the corpus operators: tables in the shared folder and
NumPy hashing of words and word shingles over Arrow string arrays.

Words here are maximal runs of bytes other than space and ``\\x09-\\x0D``;
a shingle is ``k`` consecutive words, or all words of a shorter text, so
only a text without words has no shingle.
"""

from __future__ import annotations

import sys
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lowrank.session import ensure_checkpoint_dir, release

# Worker functions travel with the job: executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_BYTES = 4 << 20      # text bytes that one NumPy block holds (a longer text is one block)
SHINGLE_WORDS = 5
_BASE = 0x9E3779B97F4A7C15         # odd, so invertible modulo 2^64


def by_value(name: str) -> None:
    """Ship the functions of module ``name`` with the jobs that use them."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh place under the cluster's shared folder; removed by that
    folder's retention, since lazy results may still read it."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def save_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: later passes
    are scans and a lost executor never repeats the work behind it."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._lowrank_path = path
    return out


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` is called so."""
    used = {c.lower() for c in df.columns}
    while name.lower() in used:
        name += "_"
    return name


class Numbers(dict):
    """key -> its number in order of first use."""

    def __missing__(self, key) -> int:
        self[key] = n = len(self)
        return n


def drop_table(df: DataFrame) -> None:
    """Delete a table of ``save_table`` that nothing reads any more."""
    release(df)


NUMBERED_ROWS = 1 << 20    # rows that one range of ``numbered_rows`` holds on average, at most


def _running(by: str | None):
    def run(batches):
        part, last, k = TaskContext.get().partitionId(), None, 0
        for b in batches:
            if not b.num_rows:
                continue
            n = np.arange(b.num_rows)
            new = np.zeros(b.num_rows, bool)
            if by is not None:
                coded = b.column(by).dictionary_encode()
                codes = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
                new[1:] = codes[1:] != codes[:-1]
                first = b.column(by)[0].as_py()
                new[0] = first != last
                last = b.column(by)[-1].as_py()
            start = np.maximum.accumulate(np.where(new, n, -1))
            at = np.where(start < 0, n + k, n - start)
            k = int(at[-1]) + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(n), part), pa.int64()), pa.array(at, pa.int64())],
                                             names=[*b.schema.names, "range_no", "range_pos"])
    return run


def numbered_rows(stored: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """The rows of a stored table with ``pos``, their place from 0 within
    ``by`` (at most one column; null is a group) by ``order``.  Rows are
    sorted into ranges by all these columns and their place in the table, so
    neither a frequent group nor equal rows come into one task."""
    spark = stored.sparkSession
    ranges = max(shuffle_partitions(spark), -(-stored.count() // NUMBERED_ROWS))
    keys = [*by, *order, "range_tie"]
    rows = stored.withColumn("range_tie", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).drop("range_tie")
    schema = T.StructType([*rows.schema.fields, T.StructField("range_no", T.LongType()), T.StructField("range_pos", T.LongType())])
    sorted_rows = save_table(rows.mapInArrow(_running(by[0] if by else None), schema), name)
    sizes = sorted_rows.groupBy(*by, "range_no").agg(F.count("*").alias("n"))
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*(F.col(c).alias(f"of_{c}") for c in by), F.col("range_no").alias("of_range"),
                           F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    same = F.col("range_no") == F.col("of_range")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"of_{c}"))
    return sorted_rows.join(offsets, same).select(*stored.columns, (F.col("before") + F.col("range_pos")).alias("pos"))


def text_blocks(batches, column: str, limit: int = BLOCK_BYTES):
    """Slices of Arrow batches holding about ``limit`` bytes of ``column``,
    as (slice, texts) with nulls read as empty."""
    for batch in batches:
        arr = batch.column(column)
        arr = arr.cast(pa.large_string()).fill_null("")
        if isinstance(arr, pa.ChunkedArray):
            arr = arr.combine_chunks()
        offs = _offsets(arr)
        lo = 0
        while lo < len(arr):
            hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
            hi = min(hi, len(arr))
            yield batch.slice(lo, hi - lo), arr.slice(lo, hi - lo)
            lo = hi


def _offsets(arr: pa.LargeStringArray) -> np.ndarray:
    return np.frombuffer(arr.buffers()[1], np.int64)[arr.offset:arr.offset + len(arr) + 1]


def text_bytes(arr: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a large_string array without nulls."""
    offs = _offsets(arr)
    buf = arr.buffers()[2]
    data = np.frombuffer(buf, np.uint8) if buf is not None else np.zeros(0, np.uint8)
    return data[offs[0]:offs[-1]], offs - offs[0]


def mix64(h: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit hashes."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Powers:
    """Powers of the hash base and of its inverse, grown on demand."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            inv = pow(_BASE, -1, 1 << 64)
            size = 1 << max(10, int(n - 1).bit_length())
            self.up = np.concatenate([[np.uint64(1)], np.full(size - 1, _BASE, np.uint64)]).cumprod(dtype=np.uint64)
            self.down = np.concatenate([[np.uint64(1)], np.full(size - 1, inv, np.uint64)]).cumprod(dtype=np.uint64)
        return self.up, self.down


def span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray, powers: Powers) -> np.ndarray:
    """Hash of ``values[start:end]`` per span: position-free differences of
    one prefix sum modulo 2^64, then mixed."""
    up, down = powers.get(len(values) + 1)
    prefix = np.empty(len(values) + 1, np.uint64)
    prefix[0] = 0
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[:len(values)], out=prefix[1:])
    return mix64((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first word of each text): byte spans of all words."""
    n = len(data)
    word = np.zeros(n + 2, bool)
    word[1:-1] = ~_SPACE[data]
    cut = np.zeros(n + 1, bool)
    cut[offs] = True
    start = np.flatnonzero(word[1:-1] & (~word[:-2] | cut[:-1]))
    end = np.flatnonzero(word[1:-1] & (~word[2:] | cut[1:])) + 1
    return start, end, np.searchsorted(start, offs)


def shingle_hashes(arr: pa.LargeStringArray, powers: Powers, k: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): 64-bit hashes of the word shingles of each text,
    repeats kept, in text order."""
    data, offs = text_bytes(arr)
    ws, we, first = word_spans(data, offs)
    words = span_hashes(data, ws, we, powers)
    n = np.diff(first)
    width = np.minimum(n, k)
    count = np.where(n > 0, n - width + 1, 0)
    out = np.concatenate([[0], np.cumsum(count)])
    start = np.arange(out[-1]) + np.repeat(first[:-1] - out[:-1], count)
    return span_hashes(words, start, start + np.repeat(width, count), powers), out
