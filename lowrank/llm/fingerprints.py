"""Document fingerprints by one-permutation MinHash (operator 2).

Each word shingle (five words) is hashed once; its upper bits pick one of
``BINS`` bins, which keeps the smallest of the rest.  Empty bins are filled by
optimal densification: bin ``j`` tries a fixed pseudo-random sequence of bins,
the same for every document, until one is not empty, and copies it.  The
fingerprint is the ``BITS`` low-order bits of each bin, in hex.  Likeness of
two fingerprints is the share of equal bins corrected for chance,
``(m - 2^-b) / (1 - 2^-b)``, held within 0 and 1.

``with_neighbours`` pairs each document with the next by id without a global
sort in one task: documents go to buckets between quantiles of the id, and
the first document of each bucket is also sent, as a peek, to the bucket
before it.  Texts are shuffled once and only the quantiles and first ids (one
of each per bucket) pass through the driver.

Defined cases: null text is empty; a text without words has the fixed
fingerprint of no shingles, alike (1) to itself and unlike (0) any other; a text
of fewer than five words is one shingle; ties of an id are ordered by text; a
null id comes first; one document is its own neighbour; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lowrank.llm.common import Powers, by_value, mix64, read_table, shingle_hashes, shuffle_partitions, text_blocks

by_value(__name__)

BINS, BITS = 256, 8
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
NONE = "-" * (BINS * BITS // 4)         # fingerprint of a text without shingles
_LOWEST = -(1 << 63)


def densify(bins: np.ndarray) -> np.ndarray:
    """Fill the empty bins of each row (a row has at least one full bin)."""
    n, k = bins.shape
    full = bins != _EMPTY
    row, col = np.nonzero(~full)
    out = bins.copy()
    attempt = 0
    while len(row):
        attempt += 1
        if attempt <= 16 * k:
            at = mix64(col.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(attempt)) % np.uint64(k)
        else:                                  # walk on: reaches a full bin within k steps
            at = (col + attempt) % k
        at = at.astype(np.int64)
        hit = full[row, at]
        out[row[hit], col[hit]] = bins[row[hit], at[hit]]
        row, col = row[~hit], col[~hit]
    return out


def sketch(arr: pa.LargeStringArray, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """(low bits of each bin as uint8 rows, has shingles) of each text."""
    h, offs = shingle_hashes(arr, powers)
    n = len(arr)
    doc = np.repeat(np.arange(n), np.diff(offs))
    bins = np.full(n * BINS, _EMPTY)
    np.minimum.at(bins, doc * BINS + (h >> np.uint64(56)).astype(np.int64), h & np.uint64((1 << 56) - 1))
    bins = bins.reshape(n, BINS)
    some = np.diff(offs) > 0
    low = np.zeros((n, BINS), np.uint8)
    if some.any():
        low[some] = (mix64(densify(bins[some])) & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    return low, some


def likeness(a: np.ndarray, a_some: np.ndarray, b: np.ndarray, b_some: np.ndarray) -> np.ndarray:
    chance = 2.0 ** -BITS
    m = np.clip(((a == b).mean(axis=1) - chance) / (1 - chance), 0, 1) if len(a) else np.zeros(0)
    return np.where(a_some & b_some, m, np.where(a_some == b_some, 1.0, 0.0))


def as_hex(low: np.ndarray, some: np.ndarray) -> list[str]:
    return [r.tobytes().hex() if s else NONE for r, s in zip(low, some)]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of every whole text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for rows, texts in text_blocks(batches, "text"):
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(as_hex(*sketch(texts, powers)), pa.string())],
                                             names=["doc_id", "fingerprint"])
    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
            .mapInArrow(run, "doc_id long, fingerprint string"))


def _deal(cuts: np.ndarray, before: dict[int, int]):
    """Rows with their bucket; the first rows of a bucket once more as peeks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc_id").fill_null(_LOWEST)
            x = ids.to_numpy(zero_copy_only=False)
            for peek in (False, True):
                rows = np.flatnonzero(np.isin(x, list(before))) if peek else np.arange(len(x))
                bucket = np.array([before[i] for i in x[rows].tolist()], np.int32) if peek else np.searchsorted(cuts, x, "right").astype(np.int32)
                if len(rows):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(bucket), pa.array(np.full(len(rows), peek)), ids.take(pa.array(rows)),
                         b.column("doc_id").take(pa.array(rows)), b.column("text").take(pa.array(rows))],
                        names=["bucket", "peek", "place", "doc_id", "text"])
    return run


def with_neighbours(docs: DataFrame, work, schema: str, buckets: int | None = None) -> DataFrame:
    """``work(batches)`` over (bucket, peek, place, doc_id, text) rows, each
    bucket in order of id and closed by its peek, the document after its last."""
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    buckets = buckets or 4 * parts
    ids = docs.select(F.coalesce("doc_id", F.lit(_LOWEST)).alias("place"))
    known = docs.where(F.col("doc_id").isNotNull()).select("doc_id")
    cuts = known.approxQuantile("doc_id", [i / buckets for i in range(1, buckets)], 0.25 / buckets)
    cuts = np.unique(np.array(cuts, np.float64)).astype(np.int64)
    bucket = F.pandas_udf(lambda s: s.map(lambda v: int(np.searchsorted(cuts, v, "right"))), "int")
    first = {r["b"]: r["m"] for r in ids.groupBy(bucket("place").alias("b")).agg(F.min("place").alias("m")).collect()}
    order = sorted(first)
    before = {first[b]: order[i - 1] for i, b in enumerate(order)}     # the first of all closes the last bucket
    dealt = docs.select("doc_id", "text").mapInArrow(_deal(cuts, before), "bucket int, peek boolean, place long, doc_id long, text string")
    return (dealt.repartition(parts, "bucket").sortWithinPartitions("bucket", "peek", "place", F.col("text").asc_nulls_first())
            .mapInArrow(work, schema))


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    powers, names = Powers(), ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def finish(rows, nxt, low, some, nlow, nsome):
        edited = [t[:len(t) - len(t) // 4] + n[:len(t) // 4] for (_, t), n in zip(rows, nxt)]
        elow, esome = sketch(pa.array(edited, pa.large_string()), powers)
        return pa.RecordBatch.from_arrays(
            [pa.array([d for d, _ in rows], pa.int64()), pa.array([len(t) for _, t in rows], pa.int64()),
             pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
             pa.array(as_hex(low, some), pa.string()), pa.array(as_hex(elow, esome), pa.string()),
             pa.array(likeness(low, some, elow, esome)), pa.array(likeness(low, some, nlow, nsome))], names=names)

    held = None                                # the last row, whose neighbour is yet to come
    closed = True                              # a peek has closed the current bucket
    for rows, texts in text_blocks(batches, "text"):
        low, some = sketch(texts, powers)
        ids, peek, bucket = (rows.column(c).to_pylist() for c in ("doc_id", "peek", "bucket"))
        rows = list(zip(ids, texts.to_pylist()))
        if held is not None:
            rows, peek, bucket = [held[0], *rows], [False, *peek], [held[3], *bucket]
            low, some = np.concatenate([held[1][None], low]), np.concatenate([[held[2]], some])
        # Ties of a first id arrive as several peeks; the first of them is the neighbour.
        own = [i for i in range(len(rows) - 1) if not peek[i]]
        if any(bucket[i] != bucket[i + 1] for i in own):
            raise ValueError("a bucket was not closed by the document after it")
        if own:
            nxt = [i + 1 for i in own]
            yield finish([rows[i] for i in own], [rows[i][1] for i in nxt], low[own], some[own], low[nxt], some[nxt])
        held = None if peek[-1] else (rows[-1], low[-1], some[-1], bucket[-1])
        closed = peek[-1]
    if not closed:
        raise ValueError("a bucket was not closed by the document after it")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return with_neighbours(docs, _edits, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
                           "edited_fingerprint string, near_edited double, near_next double")
