"""Wide sparse matrices: Lanczos spectra, sums of present columns, gaps without a
shuffle of values, merged moments, trials in step."""

import tracemalloc

import numpy as np
import pytest
from conftest import SF001, SF01

from lowrank.matrix import TallMatrix
from lowrank.operators import blocks, linalg, ppca, rows, stats, trials
from lowrank.session import store
from lowrank.sources import datasets, tables, text
from lowrank.sources.text import matrix_lines


def dense_of(m):
    a = np.zeros((m.n_rows, m.n_cols))
    e = m.entries().toPandas()
    a[e["i"], e["j"]] = e["v"]
    return a


@pytest.fixture(scope="module")
def cp(spark):
    m = datasets.customer_part_matrix(spark, SF01)
    return m.with_df(m.df.persist())


@pytest.fixture(scope="module")
def exact(cp):
    a = dense_of(cp)
    return a - a.mean(axis=0)


def test_lanczos_values_within_bounds_and_passes(cp, exact):
    mean = stats.mean_and_norm(cp)[0]
    want = np.linalg.svd(exact, compute_uv=False)
    got = linalg.lanczos_runs(cp, mean, [linalg.lanczos(cp.n_cols, 6)])[0]
    assert got.passes <= 30
    assert np.sqrt(got.values) == pytest.approx(want[:6], rel=1e-6)
    assert (np.abs(got.values[:, None] - want[None, :] ** 2).min(axis=1) <= got.bounds + 1e-6).all()


def test_residual_norm_and_warm_start(cp, exact):
    mean = stats.mean_and_norm(cp)[0]
    p = np.linalg.qr(np.random.default_rng(1).standard_normal((cp.n_cols, 3)))[0]
    want = np.linalg.svd(exact - exact @ p @ p.T, compute_uv=False)[0]
    cold, warm = (linalg.lanczos(cp.n_cols, 1, p, start=s) for s in (None, None))
    first = linalg.lanczos_runs(cp, mean, [cold])[0]
    assert np.sqrt(first.values[0]) == pytest.approx(want, rel=1e-6) and first.passes <= 30
    warm = linalg.lanczos(cp.n_cols, 1, p, start=first.block)
    again = linalg.lanczos_runs(cp, mean, [warm])[0]
    assert again.passes <= 3 and again.values == pytest.approx(first.values, rel=1e-6)


def drive(run, matrix):
    block = next(run)
    while True:
        try:
            block = run.send(matrix @ block)
        except StopIteration as done:
            return done.value


def test_lanczos_restarts_and_small_spaces(monkeypatch):
    rng = np.random.default_rng(2)
    q = np.linalg.qr(rng.standard_normal((200, 200)))[0]
    w = 0.97 ** np.arange(200)
    a = (q * w) @ q.T
    monkeypatch.setattr(linalg, "LANCZOS_BLOCKS", 4)                  # restarts after four blocks
    got = drive(linalg.lanczos(200, 5, block=6), a)
    assert got.values == pytest.approx(w[:5], rel=1e-5) and got.passes > 4
    assert drive(linalg.lanczos(7, 5), np.diag([3.0, 3, 3, 1, 0, 0, 0])).values == pytest.approx([3, 3, 3, 1, 0], abs=1e-12)
    assert drive(linalg.lanczos(50, 3), np.zeros((50, 50))).values.tolist() == [0, 0, 0]
    p = np.eye(7)[:, :6]
    assert drive(linalg.lanczos(7, 1, p), np.diag(np.arange(1.0, 8))).values == pytest.approx([7])


def test_default_sparse_fit_has_its_spectral_error(spark, monkeypatch, cp, exact):
    monkeypatch.setattr(ppca, "MAX_GRAM_COLS", 1)                     # no R factor: the wide route
    monkeypatch.setattr(ppca, "SUMMARY_MAX_COLS", 1)
    model = ppca.ppca_fit(cp, 3, max_iter=2, seed=1)
    s = np.linalg.svd(exact, compute_uv=False)
    p = ppca.orthonormal_basis(model.loadings)
    norm = np.linalg.svd(exact - exact @ p @ p.T, compute_uv=False)[0]
    assert model.stat.errors[-1] == pytest.approx((norm - s[3]) / s[3], abs=3e-6)


def random_sparse(spark, d, n=400, per_row=6, seed=0, offset=0.0):
    rng = np.random.default_rng(seed)
    cols = [sorted(rng.choice(d, per_row, replace=False).tolist()) for _ in range(n)]
    vals = (offset + rng.standard_normal((n, per_row))).tolist()
    df = spark.createDataFrame(list(zip(range(n), cols, vals)), "row_id long, indices array<int>, values array<double>")
    return TallMatrix(df.repartition(3), n_cols=d, n_rows=n + 5, kind="sparse"), cols, vals


def test_partials_do_not_grow_with_the_width(spark):
    sizes, means = {}, {}
    for d in (20_000, 1_000_000):
        m, cols, vals = random_sparse(spark, d)
        v = np.random.default_rng(1).standard_normal((d, 4))
        parts = blocks.partial_sums_df(m, lambda b: {"syx": b.t_matmul(b.matmul(v))}, 4).count()
        present = {j for c in cols for j in c}
        assert parts == len(present)                                  # a row per column present
        st = linalg.cross_stats(m, v, np.zeros(d))
        x = np.array([np.array(a) @ v[c] for c, a in zip(cols, vals)])
        want = np.zeros((d, 4))
        for c, a, r in zip(cols, vals, x):
            want[c] += np.outer(a, r)
        assert st.ytx == pytest.approx(want, abs=1e-9) and st.xtx == pytest.approx(x.T @ x, rel=1e-9)
        sizes[d] = parts
    assert abs(sizes[20_000] - sizes[1_000_000]) < 400


def test_batches_follow_bytes_not_width(spark):
    m, _, _ = random_sparse(spark, 1_000_000)
    with blocks.arrow_batch_rows(spark, blocks.batch_rows(m)):
        seen = m.df.mapInArrow(lambda it: (b.select(["row_id"]).slice(0, 1) for b in it), "row_id long").count()
    assert seen <= 3                                                  # one batch a partition, not one per 64 rows
    assert spark.conf.get(blocks.arrow_batch_rows.ROWS) == "10000"


def test_keyed_sums_merge_parts():
    rng = np.random.default_rng(0)
    total, want = blocks.KeyedSum(), np.zeros((5000, 2))
    for _ in range(60):
        keys = np.unique(rng.integers(0, 5000, 3000))
        vals = rng.standard_normal((keys.size, 2))
        want[keys] += vals
        total.add(blocks.Keyed(keys, vals))
    got = total.total()
    assert (np.diff(got.keys) > 0).all() and got.values == pytest.approx(want[got.keys])


def above_scans_of(df, column):
    """Plan lines above each scan that reads ``column``."""
    out, path = [], []
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        depth = len(line) - len(line.lstrip(" :+-"))
        path = [(n, x) for n, x in path if n < depth] + [(depth, line)]
        if "FileScan" in line and column in line.split("ReadSchema")[-1]:
            out.append([x for _, x in path[:-1]])
    return out


def test_absent_rows_move_no_values(spark):
    m, _, _ = random_sparse(spark, 50, n=30)
    m = m.with_df(store(m.df))
    for df in (tables.with_absent_rows(m).df, rows.project(m, np.eye(50)[:, :3]), rows.center_rows(m, np.zeros(50)).df,
               matrix_lines(m, "LIL"), rows.residual_rows(m, np.eye(50)[:, :3], np.eye(50)[:, :3], np.zeros(50))):
        above = above_scans_of(df, "values")
        assert above and not any("Exchange" in line for path in above for line in path)
    got = {r["row_id"]: list(r["values"]) for r in rows.project(m, np.eye(50)[:, :3]).collect()}
    assert sorted(got) == list(range(35)) and got[33] == [0.0, 0.0, 0.0]
    assert matrix_lines(m, "LIL").count() == 35


def test_sparse_norm_without_cancellation(spark):
    m, cols, vals = random_sparse(spark, 3, n=200, per_row=3, offset=1e8)
    a = np.array([[dict(zip(c, v)).get(j, 0.0) for j in range(3)] for c, v in zip(cols, vals)] + [[0.0] * 3] * 5)
    exact = np.longdouble(a) - np.longdouble(a).mean(axis=0)
    assert stats.mean_and_norm(m)[1] == pytest.approx(float((exact ** 2).sum()), rel=1e-10)
    full = m.with_rows(200)                                           # no zeros: the spread is 1e-16 of the squares
    exact = np.longdouble(a[:200]) - np.longdouble(a[:200]).mean(axis=0)
    assert stats.mean_and_norm(full)[1] == pytest.approx(float((exact ** 2).sum()), rel=1e-6)
    fused = linalg.summary_and_sketch(full.with_df(full.df.persist()), 2, 0)
    assert fused[2] == pytest.approx(float((exact ** 2).sum()), rel=1e-6)


class Passes:
    """Counts the passes over the rows."""

    def __init__(self, monkeypatch):
        self.n = 0
        for name in ("partial_sums", "sums_and_r", "tsqr"):
            own = getattr(linalg, name)
            monkeypatch.setattr(linalg, name, lambda *a, own=own, **k: self.count(own, *a, **k))

    def count(self, own, *a, **k):
        self.n += 1
        return own(*a, **k)


def test_trials_share_their_passes(spark, monkeypatch):
    m = datasets.customer_part_matrix(spark, SF001)
    m = m.with_df(m.df.persist())
    alone = [ppca.ppca_fit(m, 2, seed=s, max_iter=4, tol=1e-3, target_error=0.0, strategy="passes", error_metric="none") for s in (1, 2, 3)]
    counts = []
    for n in (1, 3):
        passes = Passes(monkeypatch)
        models, runs, _ = trials.run_trials(m, 2, trials=n, seeds=[1, 2, 3][:n], max_iter=4, tol=1e-3, target_error=0.0,
                                            strategy="passes", error_metric="none")
        counts.append(passes.n)
        monkeypatch.undo()
    assert counts[0] == counts[1]
    for a, b in zip(alone, models):
        # Signs of a sketch are free, and with them C; C C' is not.
        assert a.loadings @ a.loadings.T == pytest.approx(b.loadings @ b.loadings.T, abs=1e-7) and a.stat.n_iter == b.stat.n_iter
    assert runs.count() == 3


def test_trials_share_lanczos_and_stop_alone(spark, monkeypatch):
    m = datasets.customer_part_matrix(spark, SF001)
    m = m.with_df(m.df.persist())
    monkeypatch.setattr(ppca, "MAX_GRAM_COLS", 1)
    rng = np.random.default_rng(0)
    starts = [(rng.random((m.n_cols, 2)), 1.0), "sketch", "random"]
    models, _, _ = trials.run_trials(m, 2, trials=3, seeds=[5, 6, 7], inits=starts, max_iter=3, target_error=0.12, strategy="passes")
    for seed, init, model in zip((5, 6, 7), starts, models):
        one = ppca.ppca_fit(m, 2, seed=seed, init=init, max_iter=3, target_error=0.12, strategy="passes")
        assert model.stat.n_iter == one.stat.n_iter and model.stat.errors == pytest.approx(one.stat.errors, abs=1e-5)


@pytest.fixture(scope="module")
def segmented_pair(spark):
    """One matrix with rows in segments of 8 columns, and the same held whole."""
    rng = np.random.default_rng(4)
    a = np.where(rng.random((60, 50)) < 0.1, rng.integers(1, 9, (60, 50)), 0).astype(float)
    a[7] = rng.integers(1, 9, 50)                      # hot rows
    a[8, ::2] = 3.0
    a[11] = 0.0
    i, j = np.nonzero(a)
    e = spark.createDataFrame([(int(x), int(y), float(a[x, y])) for x, y in zip(i, j)], "i long, j int, v double").repartition(4)
    seg = tables.matrix_from_entries(e, n_rows=63, n_cols=50, segment_entries=8)
    return seg, tables.matrix_from_entries(e, n_rows=63, n_cols=50), np.vstack([a, np.zeros((3, 50))])


def test_no_record_holds_a_hot_row(segmented_pair):
    seg, _, a = segmented_pair
    long = set(np.flatnonzero((a != 0).sum(axis=1) > 8))
    assert seg.wide_rows == len(long) >= 2
    assert {r["row_id"] for r in seg.wide.collect()} == long
    assert max(len(r["indices"]) for r in seg.wide.collect() + seg.df.collect()) <= 8
    assert seg.stored_rows() == (a != 0).any(axis=1).sum()
    assert dense_of(seg.with_df(seg.df)) == pytest.approx(a)
    assert {r["row_id"]: list(r["indices"]) for r in seg.whole().df.collect()}[7] == list(range(50))


@pytest.mark.parametrize("shared", [1 << 22, 0])
def test_segmented_statistics_and_fits(segmented_pair, monkeypatch, shared):
    seg, whole, a = segmented_pair
    monkeypatch.setattr(blocks, "MAX_SHARED_CELLS", shared)
    mean, norm2 = stats.mean_and_norm(seg)
    c = a - a.mean(axis=0)
    assert mean == pytest.approx(a.mean(axis=0)) and norm2 == pytest.approx((c * c).sum())
    v = np.random.default_rng(0).standard_normal((50, 4))
    st = linalg.cross_stats(seg, v, mean)
    assert st.ytx == pytest.approx(c.T @ (c @ v)) and st.xtx == pytest.approx((c @ v).T @ (c @ v))
    r = linalg.r_factor(seg, mean, v)
    assert r.T @ r == pytest.approx((c @ v).T @ (c @ v))
    got = {r["row_id"]: list(r["values"]) for r in rows.project(seg, v, mean).collect()}
    assert sorted(got) == list(range(63)) and np.array([got[i] for i in range(63)]) == pytest.approx(c @ v)
    opts = dict(max_iter=3, seed=2, strategy="passes", target_error=0.0)
    one, two = ppca.ppca_fit(seg, 3, **opts), ppca.ppca_fit(whole, 3, **opts)
    assert [h["ss"] for h in one.history] == pytest.approx([h["ss"] for h in two.history], rel=1e-9)
    assert one.stat.errors == pytest.approx(two.stat.errors, abs=1e-9)
    s = np.linalg.svd(c, compute_uv=False)
    assert linalg.top_singular_values_power(seg, 3, mean) == pytest.approx(s[:3], rel=1e-6)


def test_segmented_formats_and_dense_forms(spark, segmented_pair, tmp_path):
    seg, whole, a = segmented_pair
    for fmt in ("DENSE", "LIL", "COO"):
        one, two = ({tuple(r) for r in matrix_lines(m, fmt).collect()} for m in (seg, whole))
        assert one == two
    text.write_matrix(seg, str(tmp_path / "rows"), "PARQUET")
    back = tables.matrix_from_parquet(spark, str(tmp_path / "rows"), 50, 63)
    assert back.wide_rows == seg.wide_rows and dense_of(back) == pytest.approx(a)
    sample = rows.row_sample(seg, 0.5)
    same = {r["row_id"] for r in rows.row_sample(whole, 0.5).df.collect()}
    assert {r["row_id"] for r in sample.whole().df.collect()} == same and sample.stored_rows() == len(same)
    mean = a.mean(axis=0)
    w = np.random.default_rng(1).standard_normal((50, 2))
    got = {r["row_id"]: np.array(r["values"]) for r in rows.residual_rows(seg, w, w, mean).collect()}
    assert np.array([got[i] for i in range(63)]) == pytest.approx((a - mean) - (a - mean) @ w @ w.T)
    assert ppca.l1_error(seg, mean, w, w) == pytest.approx(ppca.l1_error(whole, mean, w, w))


def test_lanczos_of_a_very_wide_matrix_holds_few_vectors():
    d = 300_000
    w = 1.0 / (1.0 + np.arange(d) % 1000) + (np.arange(d) == 7)       # the largest is 1.125, then many of 1
    p = np.zeros((d, 1))
    p[7] = 1.0
    for side, want in ((None, 1.125), (p, 1.0)):
        run = linalg.lanczos(d, 1, side, tol=1e-9)
        tracemalloc.start()
        block = next(run)
        try:
            while True:
                block = run.send(block * w[:, None])
        except StopIteration as done:
            got = done.value
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert got.values == pytest.approx([want], rel=1e-9) and got.bounds[0] < 1e-3
        assert peak < 16 * 8 * d


def test_lanczos_without_a_basis_agrees(monkeypatch, cp, exact):
    mean = stats.mean_and_norm(cp)[0]
    p = np.linalg.qr(np.random.default_rng(1).standard_normal((cp.n_cols, 3)))[0]
    monkeypatch.setattr(linalg, "LANCZOS_DOUBLES", 1)
    top, rest = linalg.lanczos_runs(cp, mean, [linalg.lanczos(cp.n_cols, 1, tol=1e-9), linalg.lanczos(cp.n_cols, 1, p, tol=1e-9)])
    assert np.sqrt(top.values[0]) == pytest.approx(np.linalg.norm(exact, 2), rel=1e-8)
    assert np.sqrt(rest.values[0]) == pytest.approx(np.linalg.norm(exact - exact @ p @ p.T, 2), rel=1e-8)
