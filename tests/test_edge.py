
import numpy as np
import pytest

from lowrank.operators import ppca, rows
from lowrank.sources.tables import matrix_from_array


def test_clamps():
    assert ppca.clamp_rank(5, 5, 10) == (4, 1)       # k = d -> d - 1, s = d - k
    assert ppca.clamp_rank(2, 64, 10) == (2, 10)
    assert ppca.clamp_rank(60, 64, 10) == (60, 4)
    with pytest.raises(ValueError):
        ppca.clamp_rank(0, 5, 10)


def test_empty_partitions(spark, sample_df):
    m = matrix_from_array(sample_df.repartition(16), "f", "id")
    prep = ppca.prepare(m, need_spectrum=False)
    assert prep.norm2 == pytest.approx(36 / 7)


def test_nan_rejected(spark):
    df = spark.createDataFrame([(0, [1.0, float("nan")]), (1, [0.0, 1.0]), (2, [2.0, 1.0])],
                               "id long, f array<double>")
    m = matrix_from_array(df, "f", "id")
    with pytest.raises(Exception):
        ppca.ppca_fit(m, 1, error_metric="none", init=(np.ones((2, 1)), 1.0))


def test_large_row_count_no_overflow():
    """N * d is computed in floating point."""
    assert rows.default_sample_rate(123456789) == pytest.approx(1e-5)
    assert rows.default_sample_rate(9999) == 1.0


def test_explicit_partition_count(spark, sample_df):
    from conftest import C0, SS0
    m = matrix_from_array(sample_df, "f", "id")
    a = ppca.ppca_fit(m, 3, max_iter=2, init=(np.array(C0), SS0), error_metric="none", partitions=4,
                      strategy="passes")
    b = ppca.ppca_fit(m, 3, max_iter=2, init=(np.array(C0), SS0), error_metric="none", strategy="passes")
    assert a.ss == pytest.approx(b.ss, rel=1e-12)
