"""Very wide sparse matrices: rows packed in binary records, built from unsummed
entries, and passes over them that ship a record per column range."""

import numpy as np
import pytest

from lowrank.operators import blocks, linalg, packed, stats
from lowrank.sources import tables

N, D = 60, 300


def entries_of(spark, seed=5):
    """Entries with repeats, nulls beside values, cells that cancel, a long row; and the matrix."""
    rng = np.random.default_rng(seed)
    rows = [(int(i), int(j), float(v)) for i, j, v in zip(rng.integers(0, N - 3, 900), rng.integers(0, D - 20, 900), rng.integers(-3, 4, 900))]
    rows += [(7, j, 1.0 + j) for j in range(0, D, 2)] + [(7, 4, 2.5)]
    rows += [(N - 2, 9, 4.0), (N - 2, 9, -4.0), (N - 1, 5, None), (N - 1, 5, 2.0), (N - 1, 6, 0.0), (N - 1, 6, None)]
    a = np.zeros((N, D))
    for i, j, v in rows:
        a[i, j] += v or 0.0
    order = rng.permutation(len(rows))
    return spark.createDataFrame([rows[t] for t in order], "i long, j int, v double").repartition(3), a


@pytest.fixture(params=["light", "heavy", "mixed"])
def built(request, spark, monkeypatch):
    monkeypatch.setattr(packed, "BUCKET_ROWS", 16)
    monkeypatch.setattr(packed, "RAW_ENTRIES", 200)
    monkeypatch.setattr(packed, "RANGE", 64)
    monkeypatch.setattr(packed, "PART_ROWS", 2)
    monkeypatch.setattr(packed, "MERGED_CELLS", 200)
    monkeypatch.setattr(packed, "LIGHT_ENTRIES", {"light": 1 << 20, "heavy": 0, "mixed": 300}[request.param])
    entries, a = entries_of(spark)
    return tables.matrix_from_entries(entries, N, D, "total", segment_entries=40), a


def test_rows_cells_and_segments_are_those_of_the_entries(built):
    m, a = built
    cells = {(r.i, r.j): r.v for r in m.entries().collect()}
    assert cells == {(i, j): a[i, j] for i, j in zip(*np.nonzero(a))}
    long = np.flatnonzero((a != 0).sum(axis=1) > 40).tolist()
    assert long == [7] and m.wide_rows == 1
    held = {r.row_id: (r.indices, r["values"]) for r in m.df.collect()}
    assert held == {i: (np.flatnonzero(a[i]).tolist(), a[i, a[i] != 0].tolist()) for i in range(N) if a[i].any() and i != 7}
    segments = {r.segment: (r.indices, r["values"]) for r in m.wide.collect()}
    at = np.flatnonzero(a[7])
    assert segments == {s: (at[at // 40 == s].tolist(), a[7, at[at // 40 == s]].tolist()) for s in np.unique(at // 40).tolist()}
    assert sum(len(r["counts"]) for r in m.packed.select("counts").collect()) == 4 * (len(held) + len(segments))


def test_moments_and_products_of_packed_rows(built):
    m, a = built
    got = stats.column_stats(m).toPandas().sort_values("j")
    assert got["j"].tolist() == list(range(D)) and (got["n"] == N).all()
    assert got["total"].to_numpy() == pytest.approx(a.sum(axis=0), rel=1e-9, abs=1e-9)
    assert got["m2"].to_numpy() == pytest.approx(((a - a.mean(axis=0)) ** 2).sum(axis=0), rel=1e-9, abs=1e-9)
    mean, c = a.mean(axis=0), a - a.mean(axis=0)
    for q in (1, 3):
        v = np.random.default_rng(q).standard_normal((D, q))
        st = linalg.cross_stats(m, v, mean)
        assert st.ytx == pytest.approx(c.T @ (c @ v), rel=1e-9, abs=1e-8) and st.xtx == pytest.approx((c @ v).T @ (c @ v), rel=1e-9, abs=1e-8)


def test_several_columns_take_turns_where_their_sums_are_large(spark, monkeypatch):
    entries, a = entries_of(spark)
    m = tables.matrix_from_entries(entries, N, D, "total", segment_entries=200)
    monkeypatch.setattr(linalg, "SUM_CELLS", 2 * D)
    c, v = a - a.mean(axis=0), np.random.default_rng(3).standard_normal((D, 5))
    assert linalg.gram_apply(m, v, a.mean(axis=0)) == pytest.approx(c.T @ (c @ v), rel=1e-9, abs=1e-8)


def test_bad_entries_fail(spark):
    for rows, light in (([(0, 1, 2.0), (0, 2, None)], 1 << 20), ([(0, 1, 2.0), (0, 2, None)], 0), ([(0, 1, 2.0), (None, 2, 1.0)], 1 << 20),
                        ([(0, 1, 2.0), (0, 30, 1.0)], 1 << 20)):
        df = spark.createDataFrame(rows, "i long, j int, v double")
        with pytest.MonkeyPatch.context() as patch, pytest.raises(Exception, match="bad matrix entry"):
            patch.setattr(packed, "LIGHT_ENTRIES", light)
            tables.matrix_from_entries(df, 3, 30, "total", segment_entries=10).entries().collect()
    df = spark.createDataFrame([(0, 1, float("nan"))], "i long, j int, v double")
    m = tables.matrix_from_entries(df, 3, 30, "total", segment_entries=10)
    with pytest.raises(Exception, match="NaN"):
        linalg.gram_apply(m, np.ones((30, 1)), np.zeros(30))


def test_an_empty_wide_matrix(spark):
    m = tables.matrix_from_entries(spark.createDataFrame([], "i long, j int, v double"), 4, 30, "total", segment_entries=10)
    assert m.wide is None and m.df.count() == 0 and stats.mean_and_norm(m)[0].tolist() == [0.0] * 30
    assert linalg.gram_apply(m, np.ones((30, 2)), np.zeros(30)).tolist() == [[0.0, 0.0]] * 30


def test_a_pass_ships_a_record_per_column_range_not_per_column(spark, monkeypatch):
    d = tables.SEGMENT_ENTRIES + 5
    df = spark.range(0, 40_000, 1, 4).selectExpr("id % 2000 i", f"int(id * 7919 % {d}) j", "double(id % 9 + 1) v")
    m = tables.matrix_from_entries(df, 2000, d, "unique")
    e = df.toPandas()
    v = np.random.default_rng(0).standard_normal((d, 2))
    x = np.zeros((2000, 2))
    np.add.at(x, e["i"], e["v"].to_numpy()[:, None] * v[e["j"]])
    want = np.zeros((d, 2))
    np.add.at(want, e["j"], e["v"].to_numpy()[:, None] * x[e["i"]])
    arrived = []
    for module in (blocks, packed):
        monkeypatch.setattr(module, "collect_arrow", lambda df, f=module.collect_arrow: arrived.append(f(df)) or arrived[-1])
    assert linalg.gram_apply(m, v, np.zeros(d)) == pytest.approx(want, rel=1e-9, abs=1e-7)
    assert sum(t.num_rows for t in arrived) <= d // packed.RANGE + 2
