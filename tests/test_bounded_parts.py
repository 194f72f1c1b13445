"""What a summing task holds in Python does not grow with the width of the matrix."""

import numpy as np
import pytest

from lowrank.matrix import TallMatrix
from lowrank.operators import blocks, linalg


def test_keyed_sums_of_a_task_leave_in_bounded_parts():
    acc, sent, want = blocks.Partials(), [], np.zeros(2_000_000)
    for t in range(40):
        keys = np.arange(t * 50_000, (t + 2) * 50_000) % len(want)
        want[keys] += t
        acc.add({"s": blocks.Keyed(keys[np.argsort(keys)], np.full((keys.size, 1), float(t)))})
        if acc.full():
            sent.append(acc.emit(1))
    sent.append(acc.emit(1))
    got = np.zeros(len(want))
    for batch in sent:
        np.add.at(got, batch.column("r").to_numpy(), batch.column("c0").to_numpy())
    assert max(b.num_rows for b in sent) <= 1_000_000 and (got == want).all()


def test_products_of_many_columns_in_one_task(spark):
    d, n = 800_000, 1600
    df = spark.range(0, n, 1, 1).selectExpr("id row_id", "transform(sequence(id % 800 * 1000, id % 800 * 1000 + 999), x -> int(x)) indices",
                                            "transform(sequence(1, 1000), x -> double(id + 1)) values")
    v = np.random.default_rng(3).standard_normal((d, 1))
    st = linalg.cross_stats(TallMatrix(df, n_cols=d, n_rows=n, kind="sparse"), v, np.zeros(d))
    sums = v.reshape(800, 1000).sum(axis=1)
    scale = np.arange(1.0, 801)
    assert st.ytx[:, 0] == pytest.approx(np.repeat(sums * (scale ** 2 + (scale + 800) ** 2), 1000), rel=1e-9)
