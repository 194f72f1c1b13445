"""Rounding used to compare doubles between engines.

``round_sig`` keeps ``s`` significant digits with operations that are exact
or correctly rounded in IEEE arithmetic (multiply or divide by an exact power
of ten, round half away from zero), so two engines that sum in a different
order still print the same value.  ``sig_sql`` is the same rule as SQL text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_sig(col: str | Column, s: int = 9) -> Column:
    x = F.col(col) if isinstance(col, str) else col
    m = F.lit(s - 1) - F.floor(F.log10(F.abs(x)))
    up = F.round(x * F.pow(F.lit(10.0), m), 0) / F.pow(F.lit(10.0), m)
    down = F.round(x / F.pow(F.lit(10.0), -m), 0) * F.pow(F.lit(10.0), -m)
    return F.when(x == 0, F.lit(0.0)).when(m >= 0, up).otherwise(down)


def sig_sql(expr: str, s: int = 9) -> str:
    x = f"({expr})"
    m = f"({s - 1} - floor(log10(abs({x}))))"
    return (f"CASE WHEN {x} = 0 THEN 0.0 WHEN {m} >= 0 "
            f"THEN round({x} * pow(10.0, {m}), 0) / pow(10.0, {m}) "
            f"ELSE round({x} / pow(10.0, -{m}), 0) * pow(10.0, -{m}) END")
