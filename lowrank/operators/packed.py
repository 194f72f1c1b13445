"""Sparse rows packed in binary records, for matrices that are very wide.

A packed table has one record per bucket of rows, a bucket being a hash of the
row id: ``(kind, long, rows, segments, counts, indices, values)`` with the
row ids, their numbers of entries, the sorted column indices and the values as
bytes.  ``kind`` 0 holds whole rows; ``kind`` 1 rows in segments by column
range, ``long`` of them.  Passes over it neither build JVM arrays nor shuffle a
row per column: a task adds up its column sums and ships them in binary by
column range.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import arrow_batch_rows, collect_arrow

PACKED = "kind int, long int, rows binary, segments binary, counts binary, indices binary, values binary"
RAW = "bucket int, n long, i binary, j binary, v binary, empty binary"
PARTS = "r int, keys binary, vals binary"
# Rows of a bucket, about, and most buckets (they sort as 16-bit numbers).
BUCKET_ROWS = 1024
MAX_BUCKETS = 1 << 14
# Entries a task cuts into buckets at a time.
RAW_ENTRIES = 1 << 19
# Raw entries up to which a bucket is put together in one task.
LIGHT_ENTRIES = 2 << 20
# Row groups of stored records, which a reader holds in one piece.
GROUP_BYTES = 32 << 20
# Columns of one binary part of a column sum, and records per Arrow batch of parts.
RANGE = 8192
PART_ROWS = 16
# Doubles of the column sums that a task of several columns adds up in place.
SUM_CELLS = 16 * 1024 * 1024
# Doubles that a merging task holds, about.
MERGED_CELLS = 1 << 21


def _ints(data, kind=np.int64) -> np.ndarray:
    return np.frombuffer(data, kind)


def _joined(column, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in column])


def bucket_count(n_rows: int) -> int:
    return int(min(MAX_BUCKETS, max(1, n_rows // BUCKET_ROWS)))


def pack_raw(entries: DataFrame, buckets: int) -> DataFrame:
    """Entries ``(i, j, v)`` cut into buckets of rows; ``empty`` marks null values, where there are any."""
    names = ["bucket", "n", "i", "j", "v", "empty"]

    def cut(held: list) -> pa.RecordBatch:
        i, j, v, empty = (np.concatenate(x) for x in zip(*held))
        b = ((i.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(buckets)
        order = np.argsort(b.astype(np.uint16), kind="stable")
        n = np.bincount(b.astype(np.int64), minlength=buckets)
        some, ends = np.flatnonzero(n), np.cumsum(n)
        i, j, v, empty = i[order], j[order], v[order], empty[order]
        cuts = [slice(e - c, e) for e, c in zip(ends[some], n[some])]
        return pa.RecordBatch.from_arrays(
            [pa.array(some, pa.int32()), pa.array(n[some], pa.int64()), *(pa.array([a[s].tobytes() for s in cuts], pa.binary()) for a in (i, j, v)),
             pa.array([empty[s].tobytes() if empty[s].any() else b"" for s in cuts], pa.binary())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch.column("v")
            held.append((batch.column("i").to_numpy(zero_copy_only=False), batch.column("j").to_numpy(zero_copy_only=False),
                         pc.fill_null(v, 0.0).to_numpy(zero_copy_only=False), pc.is_null(v).to_numpy(zero_copy_only=False)))
            n += batch.num_rows
            if n >= RAW_ENTRIES:
                yield cut(held)
                held, n = [], 0
        if held:
            yield cut(held)

    entries = entries.select(F.col("i").cast("long").alias("i"), F.col("j").cast("int").alias("j"), F.col("v").cast("double").alias("v"))
    return entries.mapInArrow(run, RAW)


def unpack_raw(raw: DataFrame) -> DataFrame:
    """The entries ``(i, j, v)`` of raw records."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, v, empty in zip(*(batch.column(c) for c in ("i", "j", "v", "empty"))):
                v = _ints(v.as_buffer(), np.float64)
                null = _ints(empty.as_buffer(), bool)
                yield pa.RecordBatch.from_arrays([pa.array(_ints(i.as_buffer())), pa.array(_ints(j.as_buffer(), np.int32)),
                                                  pa.array(v, mask=null if null.size else None)], names=["i", "j", "v"])

    return raw.select("i", "j", "v", "empty").mapInArrow(run, "i long, j int, v double")


def _record(kind: int, long: int, rows, segments, counts, indices, values) -> list:
    return [kind, long, rows.astype(np.int64).tobytes(), segments.astype(np.int32).tobytes(), counts.astype(np.int32).tobytes(),
            indices.astype(np.int32).tobytes(), values.astype(np.float64).tobytes()]


def _packed_schema() -> pa.Schema:
    return pa.schema([("kind", pa.int32()), ("long", pa.int32())] + [(c, pa.binary()) for c in ("rows", "segments", "counts", "indices", "values")])


def _runs(*keys: np.ndarray) -> np.ndarray:
    """First places of runs of equal keys."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def pack_cells(raw: DataFrame, segment_entries: int) -> DataFrame:
    """Packed rows of raw records: values of one cell are added up (nulls left
    out; a cell with nothing else fails), zeros go, rows of more than
    ``segment_entries`` entries are cut by column range.  A task holds one bucket."""
    def build(t: pa.Table) -> pa.Table:
        i, j, v = _joined(t.column("i"), np.int64), _joined(t.column("j"), np.int32), _joined(t.column("v"), np.float64)
        null = None
        if any(len(x.as_buffer()) for x in t.column("empty")):
            null = np.concatenate([_ints(x.as_buffer(), bool) if len(x.as_buffer()) else np.zeros(n, bool)
                                   for x, n in zip(t.column("empty"), t.column("n").to_pylist())])
        order = np.lexsort((j, i))
        i, j, v = i[order], j[order], v[order]
        first = _runs(i, j)
        if null is not None:
            nothing = first[np.logical_and.reduceat(null[order], first)]
            if nothing.size:
                raise ValueError("bad matrix entry (empty field, or index outside the matrix): "
                                 f'{{"i":{i[nothing[0]]},"j":{j[nothing[0]]},"v":null}}')
        i, j, v = i[first], j[first], np.add.reduceat(v, first)
        kept = v != 0
        i, j, v = i[kept], j[kept], v[kept]
        out = []
        if i.size:
            at = _runs(i)
            n = np.diff(np.r_[at, i.size])
            long = n > segment_entries
            whole = np.repeat(~long, n)
            if whole.any():
                out.append(_record(0, 0, i[at[~long]], i[:0], n[~long], j[whole], v[whole]))
            if long.any():
                i, j, v = i[~whole], j[~whole], v[~whole]
                segment = j // segment_entries
                at = _runs(i, segment)
                out.append(_record(1, int(long.sum()), i[at], segment[at], np.diff(np.r_[at, i.size]), j, v))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * 7, _packed_schema())], schema=_packed_schema())

    return raw.groupBy("bucket").applyInArrow(build, PACKED)


def pack_rows(rows: DataFrame, kind: int) -> DataFrame:
    """Rows or segments held as arrays, packed."""
    names = ["row_id"] + ["segment"] * kind + ["indices", "values"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ids, lists = batch.column("row_id").to_numpy(), batch.column("indices")
                segments = batch.column("segment").to_numpy() if kind else ids[:0]
                one = _record(kind, 0, ids, segments, pc.list_value_length(lists).to_numpy(), pc.list_flatten(lists).to_numpy(),
                              pc.list_flatten(batch.column("values")).to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(one, _packed_schema())], schema=_packed_schema())

    return rows.select(*names).mapInArrow(run, PACKED)


def _records(batches: Iterator[pa.RecordBatch], *columns: tuple[str, type]) -> Iterator[list[np.ndarray]]:
    for batch in batches:
        for parts in zip(*(batch.column(c) for c, _ in columns)):
            yield [np.frombuffer(x.as_buffer(), k) for x, (_, k) in zip(parts, columns)]


ROWS, SEGMENTS, COUNTS, INDICES, VALUES = ("rows", np.int64), ("segments", np.int32), ("counts", np.int32), ("indices", np.int32), ("values", np.float64)


def unpack_rows(packed: DataFrame, kind: int) -> DataFrame:
    """``(row_id, [segment,] indices, values)`` of packed rows of one kind."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, segments, counts, indices, values in _records(batches, ROWS, SEGMENTS, COUNTS, INDICES, VALUES):
            ends = pa.array(np.r_[0, np.cumsum(counts)], pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (indices, values)]
            yield pa.RecordBatch.from_arrays([pa.array(rows)] + [pa.array(segments)] * kind + lists, names=["row_id"] + ["segment"] * kind + ["indices", "values"])

    schema = "row_id long, " + "segment int, " * kind + "indices array<int>, values array<double>"
    return packed.where(F.col("kind") == kind).select("rows", "segments", "counts", "indices", "values").mapInArrow(run, schema)


def unpack_cells(packed: DataFrame) -> DataFrame:
    """The cells ``(i, j, v)`` of packed rows of both kinds."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, counts, indices, values in _records(batches, ROWS, COUNTS, INDICES, VALUES):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(rows, counts)), pa.array(indices), pa.array(values)], names=["i", "j", "v"])

    return packed.select("rows", "counts", "indices", "values").mapInArrow(run, "i long, j int, v double")


# -- column sums in binary parts ------------------------------------------------

def _cut_ranges(sums: np.ndarray, touched: np.ndarray) -> Iterator[tuple[int, bytes, bytes]]:
    """(range, offsets or nothing for all, values) of the ranges of a q x d sum that hold anything."""
    q, d = sums.shape
    for r in range(-(-d // RANGE)):
        part = sums[:, r * RANGE:(r + 1) * RANGE]
        keys = np.flatnonzero(touched[r * RANGE:(r + 1) * RANGE]).astype(np.int32)
        if not keys.size:
            continue
        if keys.size * (4 + 8 * q) < part.size * 8:
            yield r, keys.tobytes(), np.ascontiguousarray(part[:, keys]).tobytes()
        else:
            yield r, b"", np.ascontiguousarray(part).tobytes()


def _part_batches(parts: Iterator[tuple[int, bytes, bytes]]) -> Iterator[pa.RecordBatch]:
    held = []

    def out():
        r, keys, vals = zip(*held)
        return pa.RecordBatch.from_arrays([pa.array(r, pa.int32()), pa.array(keys, pa.binary()), pa.array(vals, pa.binary())], names=["r", "keys", "vals"])

    for part in parts:
        held.append(part)
        if len(held) >= PART_ROWS:
            yield out()
            held = []
    if held:
        yield out()


def _merged_parts(parts: DataFrame, d: int, q: int, merge: Callable, finish: Callable, schema: str) -> DataFrame:
    """Parts of each range merged by ``merge(sum, offsets, values)``; a task holds the
    sums of its ranges, whatever the number of parts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for r, keys, vals in zip(batch.column("r").to_pylist(), batch.column("keys"), batch.column("vals")):
                keys, vals = _ints(keys.as_buffer(), np.int32), _ints(vals.as_buffer(), np.float64).reshape(q, -1)
                if r not in sums:
                    sums[r] = np.zeros((q, vals.shape[1] if r < 0 else min(RANGE, d - r * RANGE)))
                if vals.size:
                    merge(sums[r], keys if keys.size else slice(None), vals)
        yield from finish(sums)

    return parts.repartition(int(max(1, -(-d * q // MERGED_CELLS))), "r").mapInArrow(run, schema)


def _add(sums: np.ndarray, at, vals: np.ndarray) -> None:
    sums[:, at] += vals


def packed_cross(packed: DataFrame, v: np.ndarray, d: int) -> dict[str, np.ndarray]:
    """sum X, X'X and Y'X of the whole rows Y, X = Y V (d x q).

    V goes to the workers once as a broadcast; a task holds it and its own
    d x q sum."""
    spark, q = packed.sparkSession, v.shape[1]
    shipped = spark.sparkContext.broadcast(np.ascontiguousarray(v.T))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, y, own, touched = shipped.value, None, np.zeros((q, 1 + q)), None
        for counts, indices, values in _records(batches, COUNTS, INDICES, VALUES):
            if not np.isfinite(values).all():
                raise ValueError("NaN or infinite value in the matrix")
            if y is None:
                y, touched = np.zeros((q, d)), np.zeros(d, bool)
            at = indices.astype(np.intp)
            touched[at] = True
            starts = np.cumsum(counts) - counts
            x = np.empty((q, counts.size))
            for t in range(q):
                x[t] = np.add.reduceat(values * v[t][at], starts)
                np.add.at(y[t], at, values * np.repeat(x[t], counts))
            own[:, 0] += x.sum(axis=1)
            own[:, 1:] += x @ x.T
        if y is not None:
            yield from _part_batches([(-1, b"", own.tobytes())])
            yield from _part_batches(_cut_ranges(y, touched))

    def finish(sums):
        return _part_batches((r, b"", s.tobytes()) for r, s in sums.items())

    parts = packed.where("kind = 0").select("counts", "indices", "values").mapInArrow(run, PARTS)
    out = {"sx": np.zeros(q), "sxx": np.zeros((q, q)), "syx": np.zeros((q, d)).T}
    try:
        with arrow_batch_rows(spark, PART_ROWS):
            got = collect_arrow(_merged_parts(parts, d, q, _add, finish, PARTS).select("r", "vals"))
    finally:
        shipped.destroy()
    for batch in got.to_batches():
        for r, vals in zip(batch.column("r").to_pylist(), batch.column("vals")):
            vals = _ints(vals.as_buffer(), np.float64).reshape(q, -1)
            if r < 0:
                out["sx"], out["sxx"] = vals[:, 0].copy(), vals[:, 1:].copy()
            else:
                out["syx"][r * RANGE:(r + 1) * RANGE] = vals.T
    return out


def _merge_moments(sums: np.ndarray, at, vals: np.ndarray) -> None:
    """(count, mean, M2) by column, merged into those of ``sums``."""
    n, mean, m2 = sums[:, at]
    more, own, spread = vals
    total = np.maximum(n + more, 1)
    apart = own - mean
    sums[:, at] = n + more, mean + apart * (more / total), m2 + spread + apart * apart * (n * more / total)


def packed_moments(packed: DataFrame, d: int) -> DataFrame:
    """``(j, stored, own, spread)`` of every column: entries, their mean and
    their sum of squares about it."""
    spark: SparkSession = packed.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        for indices, values in _records(batches, INDICES, VALUES):
            sums = np.zeros((3, d)) if sums is None else sums
            order = np.argsort(indices)
            cols, v = indices[order], values[order]
            first = _runs(cols)
            n = np.diff(np.r_[first, cols.size])
            mean = np.add.reduceat(v, first) / n
            v = v - np.repeat(mean, n)
            # The mean is rounded; what the deviations sum to corrects it and their squares.
            left = np.add.reduceat(v, first) / n
            _merge_moments(sums, cols[first], np.vstack([n, mean + left, np.add.reduceat(v * v, first) - n * left * left]))
        if sums is not None:
            yield from _part_batches(_cut_ranges(sums, sums[0] > 0))

    def finish(sums):
        for r, (n, mean, m2) in sums.items():
            j = np.arange(r * RANGE, r * RANGE + n.size, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(j), pa.array(n.astype(np.int64)), pa.array(mean), pa.array(m2)], names=["j", "stored", "own", "spread"])

    ranges = spark.range(-(-d // RANGE)).select(F.col("id").cast("int").alias("r"), F.lit(b"").alias("keys"), F.lit(b"").alias("vals"))
    parts = packed.select("indices", "values").mapInArrow(run, PARTS).unionByName(ranges)
    return _merged_parts(parts, d, 3, _merge_moments, finish, "j int, stored long, own double, spread double")
