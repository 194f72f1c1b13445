"""Paths that only large inputs take, forced on small ones."""

import numpy as np
import pytest

from conftest import SF001
from lowrank.operators import blocks, linalg, ppca, stats
from lowrank.session import materialize
from lowrank.sources import datasets
from lowrank.sources.tables import matrix_from_array


def test_tsqr_tree_levels_give_the_same_r(spark, monkeypatch):
    m = datasets.embeddings_matrix(spark, SF001)
    m = m.with_df(m.df.repartition(9))
    mean, _ = stats.mean_and_norm(m)
    one_level = linalg.r_factor(m, mean)
    # fan-in 2: nine partition R factors go through four combining levels
    monkeypatch.setattr(blocks, "TSQR_GROUP_BYTES", 2 * 64 * 64 * 8)
    tree = linalg.r_factor(m, mean)
    assert np.allclose(np.abs(np.diag(tree)), np.abs(np.diag(one_level)), rtol=1e-10)
    assert np.allclose(tree.T @ tree, one_level.T @ one_level, rtol=1e-9, atol=1e-12)


def test_wide_sparse_spectral_error_by_subspace_iteration(spark, monkeypatch):
    m = datasets.customer_part_matrix(spark, SF001)
    exact = ppca.ppca_fit(m, 2, max_iter=2, seed=3, target_error=0.0, strategy="passes")
    monkeypatch.setattr(ppca, "MAX_GRAM_COLS", 1)       # treat the matrix as too wide for R
    wide = ppca.ppca_fit(m, 2, max_iter=2, seed=3, target_error=0.0, strategy="passes")
    assert wide.stat.errors == pytest.approx(exact.stat.errors, rel=1e-3, abs=1e-4)
    assert [h["ss"] for h in wide.history] == pytest.approx([h["ss"] for h in exact.history], rel=1e-12)


def test_partial_sums_split_wide_results_into_blocks(spark):
    m = datasets.embeddings_matrix(spark, SF001)
    mean, _ = stats.mean_and_norm(m)
    v = np.random.default_rng(0).standard_normal((64, 40))          # 40 > one 32-wide record
    st = linalg.cross_stats(m, v, mean)
    y = np.stack(m.df.toPandas()["features"].to_numpy())
    a = y - y.mean(axis=0)
    assert np.allclose(st.ytx, a.T @ (a @ v), rtol=1e-9, atol=1e-9)
    assert np.allclose(st.xtx, (a @ v).T @ (a @ v), rtol=1e-9, atol=1e-9)


def test_kernel_input_merges_splits_by_bytes(spark, monkeypatch):
    m = datasets.embeddings_matrix(spark, SF001)
    monkeypatch.setattr(blocks, "FREE_TASKS", 4)
    many = m.with_df(m.df.limit(0))
    for i in range(9):
        many = many.with_df(many.df.union(m.df.where(f"row_id % 9 = {i}")))
    parts = many.df.rdd.getNumPartitions()
    assert parts > 4 and blocks.kernel_input(many).rdd.getNumPartitions() == 4
    monkeypatch.setattr(blocks, "KERNEL_TASK_BYTES", 1)
    assert blocks.kernel_input(many).rdd.getNumPartitions() == parts
    many = m.with_df(m.df.repartition(64))
    mean, _ = stats.mean_and_norm(m)
    v = np.eye(64)[:, :3]
    a, b = linalg.cross_stats(m, v, mean), linalg.cross_stats(many, v, mean)
    assert np.allclose(a.ytx, b.ytx, rtol=1e-10, atol=1e-12)


def test_sparse_sketch_counts_absent_rows(spark, sample_np):
    """One-pass sketch on sparse rows with an absent all-zero row equals the
    sketch of the dense matrix that stores the zero row."""
    from lowrank.sources.tables import matrix_from_array, sparse_from_dense
    y = np.vstack([sample_np, np.zeros((1, 5))])
    dense = matrix_from_array(spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(y)],
                                                    "id long, f array<double>").repartition(3), "f", "id")
    sparse = sparse_from_dense(dense)
    sparse = sparse.with_df(sparse.df.where("size(indices) > 0"))           # row 7 is absent
    assert sparse.df.count() == 7 and sparse.n_rows == 8
    mean_d, _ = stats.mean_and_norm(dense)
    mean_s, _ = stats.mean_and_norm(sparse)
    assert np.allclose(mean_d, mean_s)
    a = linalg.sketch_svd(dense, 5, mean_d, 4)
    b = linalg.sketch_svd(sparse, 5, mean_s, 4)
    exact = np.linalg.svd(y - y.mean(axis=0), compute_uv=False)
    assert np.allclose(a.s[:a.rank], exact[:a.rank], rtol=1e-9)
    assert np.allclose(b.s, a.s, rtol=1e-9, atol=1e-12)


def test_sparse_column_abs_sums_count_absent_rows(spark):
    m = datasets.customer_part_matrix(spark, SF001)
    mean, _ = stats.mean_and_norm(m)
    y = np.zeros((m.n_rows, m.n_cols))
    for r in m.df.toPandas().itertuples():
        y[r.row_id, list(r.indices)] = list(r.values)
    got = {r.j: r.abs_sum for r in stats.column_abs_sums(m, mean).collect()}
    want = np.abs(y - y.mean(axis=0)).sum(axis=0)
    assert np.allclose([got[j] for j in range(m.n_cols)], want, rtol=1e-10)
    assert stats.column_abs_norm(m, mean).first()["abs_norm"] == pytest.approx(want.max(), rel=1e-10)


@pytest.mark.parametrize("parts", [1, 5])
def test_one_pass_centred_summary(spark, parts, monkeypatch):
    """Count, mean, norm and R from one pass equal the two-pass values,
    also through the combining tree and with absent sparse rows."""
    m = datasets.lineitem_matrix(spark, SF001)
    m = m.with_df(m.df.repartition(parts))
    mean, norm2, n = stats.column_summary(m)
    r2 = linalg.r_factor(m, mean)
    monkeypatch.setattr(blocks, "TSQR_GROUP_BYTES", 2 * (16 + 4 + 1) * 8)     # fan-in 2
    n1, mean1, norm1, r1 = linalg.centred_summary(m)
    assert n1 == n
    assert np.allclose(mean1, mean, rtol=1e-13)
    assert norm1 == pytest.approx(norm2, rel=1e-12)
    assert np.allclose(r1.T @ r1, r2.T @ r2, rtol=1e-10)
    sp = datasets.customer_part_matrix(spark, SF001)
    sm, sn, _ = stats.column_summary(sp)
    ns, ms, nrm, _ = linalg.centred_summary(sp)
    assert ns == sp.n_rows and np.allclose(ms, sm, atol=1e-13) and nrm == pytest.approx(sn, rel=1e-10)


@pytest.mark.parametrize("which", ["lineitem", "sparse"])
def test_statistics_and_sketch_in_one_pass(spark, which):
    """The shared pass gives the same count, mean, norm and sketch as the
    separate passes (lineitem: large column means; sparse: absent rows)."""
    m = (datasets.lineitem_matrix(spark, SF001) if which == "lineitem"
         else datasets.customer_part_matrix(spark, SF001))
    m = m.with_df(materialize(m.df))            # as a fit does: one pass needs a known number of tasks
    mean, norm2, n = stats.column_summary(m)
    m = m.with_rows(n)
    width = 4 if which == "lineitem" else 12
    ref = linalg.sketch_svd(m, width, mean, 6)
    n1, mean1, norm1, sk = linalg.summary_and_sketch(m, width, 6)
    assert n1 == n
    assert np.allclose(mean1, mean, rtol=1e-12, atol=1e-12)
    assert norm1 == pytest.approx(norm2, rel=1e-9)
    assert sk.rank == ref.rank
    assert np.allclose(sk.s, ref.s, rtol=1e-7)
    k = min(3, sk.rank)
    assert np.allclose(np.abs(sk.v[:, :k].T @ ref.v[:, :k]), np.eye(k), atol=1e-6)


def test_hot_row_is_combined_before_it_is_collected(spark):
    """One row holds a third of all raw entries (many duplicates): the
    (i, j) grouping sums them map-side, the row record ends up with at most
    d entries, and the statistics match a dense NumPy twin."""
    from pyspark.sql import functions as F
    from lowrank.sources.tables import entries_frame, matrix_from_entries
    d, n = 50, 40
    base = spark.range(0, 6000).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % n).alias("i"),
        (F.col("id") * 7 % d).alias("j"),
        (F.col("id") % 5 + 1).cast("double").alias("v"))
    m = matrix_from_entries(entries_frame(base), n_rows=n, n_cols=d, duplicates="sum")
    rows = {r.row_id: (list(r.indices), list(r.values)) for r in m.df.collect()}
    assert max(len(ix) for ix, _ in rows.values()) <= d
    pdf = base.toPandas()
    y = np.zeros((n, d))
    np.add.at(y, (pdf.i.to_numpy(), pdf.j.to_numpy()), pdf.v.to_numpy())
    mean, norm2, cnt = stats.column_summary(m)
    assert cnt == n
    assert np.allclose(mean, y.mean(axis=0))
    assert norm2 == pytest.approx(((y - y.mean(axis=0)) ** 2).sum(), rel=1e-12)


def test_wide_rows_centre_through_the_kernel(spark, monkeypatch):
    from lowrank.operators import rows as rows_mod
    m = datasets.embeddings_matrix(spark, SF001)
    mean, _ = stats.mean_and_norm(m)
    lit = rows_mod.center_rows(m, mean).df.orderBy("row_id").toPandas()
    a = np.abs(np.stack(lit.features.to_numpy())).sum(axis=0)      # column sums have one form, the kernel
    monkeypatch.setattr(rows_mod, "MAX_LITERAL_COLS", 8)
    ker = rows_mod.center_rows(m, mean).df.orderBy("row_id").toPandas()
    b = {r.j: r.abs_sum for r in stats.column_abs_sums(m, mean).collect()}
    assert np.allclose(np.stack(lit.features.to_numpy()), np.stack(ker.features.to_numpy()), atol=1e-15)
    assert np.allclose([a[j] for j in range(64)], [b[j] for j in range(64)], rtol=1e-12)


def test_dense_moments_without_exploded_cells(spark):
    """Counts, means and M2 of uneven splits with large offsets, empty splits
    and one-row splits; no plan explodes the rows."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(501, 7)) * np.array([1, 1e-3, 1e3, 1, 1, 0, 1]) + np.array([1e8, -1e6, 0, 1e-9, 5, 3, -1e8])
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, f array<double>")
    m = matrix_from_array(df.where("id < 500").repartition(13, "id").union(df.where("id = 500")).union(df.where("id > 900")), "f", "id", n_cols=7)
    got = {r["j"]: r for r in stats.column_stats(m).collect()}
    exact = x.astype(np.longdouble)
    mean = exact.mean(axis=0)
    m2 = ((exact - mean) ** 2).sum(axis=0)
    assert sorted(got) == list(range(7)) and {r["n"] for r in got.values()} == {501}
    for j in range(7):
        assert got[j]["mean"] == pytest.approx(float(mean[j]), rel=1e-13, abs=1e-16 * np.abs(x[:, j]).max() + 1e-12)
        assert got[j]["m2"] == pytest.approx(float(m2[j]), rel=1e-9, abs=1e-12)
    mu = x.mean(axis=0)
    sums = {r["j"]: r["abs_sum"] for r in stats.column_abs_sums(m, mu).collect()}
    assert [sums[j] for j in range(7)] == pytest.approx(np.abs(x - mu).sum(axis=0).tolist(), rel=1e-12)
    plans = [f._jdf.queryExecution().optimizedPlan().toString() for f in (stats.column_stats(m), stats.column_means(m))]
    assert not any("Generate" in p for p in plans)
    assert stats.column_stats(m.with_df(m.df.limit(0))).count() == 0
