"""Column expressions over matrix rows.  All JVM-side (no Python UDF):
they stay inside Spark's generated code next to the scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def array_literal(values: Sequence[float]) -> Column:
    """A constant ARRAY<DOUBLE>.  Catalyst folds it into a single literal."""
    return F.array(*[F.lit(float(v)) for v in values]).cast("array<double>")


def subtract(a: str | Column, b: str | Column) -> Column:
    """Element-wise a - b (P4 with b the mean)."""
    return F.zip_with(_c(a), _c(b), lambda x, y: x - y)


def center(features: str | Column, mean: Sequence[float]) -> Column:
    return subtract(features, array_literal(mean))


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def abs_sum(a: str | Column) -> Column:
    return F.aggregate(_c(a), F.lit(0.0), lambda s, x: s + F.abs(x))


def parse_dense(line: str | Column, strict: bool = True) -> Column:
    """Whitespace-separated doubles -> ARRAY<DOUBLE>; leading blanks ignored.
    ``strict=False`` turns a malformed token into NULL instead of failing."""
    return F.transform(F.split(F.trim(_c(line)), r"\s+"),
                       lambda x: x.cast("double") if strict else x.try_cast("double"))


def dense_line(features: str | Column) -> Column:
    """DENSE text line: every value followed by one space."""
    return F.concat(F.array_join(F.transform(_c(features), lambda x: x.cast("string")), " "), F.lit(" "))


def lil_line(indices: str | Column, values: str | Column) -> Column:
    """LIL text line ``{j:v,j:v}`` of the non-zeros, zero-based."""
    pairs = F.filter(F.arrays_zip(_c(indices).alias("j"), _c(values).alias("v")), lambda e: e["v"] != 0)
    return F.concat(F.lit("{"),
                    F.array_join(F.transform(pairs, lambda e: F.concat(e["j"].cast("string"), F.lit(":"),
                                                                        e["v"].cast("string"))), ","),
                    F.lit("}"))


def coo_line(i: str | Column, j: str | Column, v: str | Column) -> Column:
    return F.concat_ws(",", _c(i).cast("string"), _c(j).cast("string"), _c(v).cast("string"))


def hash_uniform(key: str | Column, salt: str = "") -> Column:
    """Reproducible uniform [0, 1) from the md5 of the key.

    The same expression runs in any engine with md5 and hex parsing, which
    makes a Bernoulli row sample checkable and independent of partitioning.
    """
    text = _c(key).cast("string") if not salt else F.concat(F.lit(salt), _c(key).cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
