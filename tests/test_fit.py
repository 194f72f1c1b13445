
import numpy as np
import pytest

from conftest import SF001
from lowrank.operators import linalg, ppca, rows, stats, trials
from lowrank.sources import datasets


@pytest.fixture(scope="module")
def emb(spark):
    return datasets.embeddings_matrix(spark, SF001)


def test_sketch_exact_when_width_is_d(spark):
    """k + s = d: the sketch spans everything, so any seed gives the exact
    singular values."""
    m = datasets.lineitem_matrix(spark, SF001)
    mean, _ = stats.mean_and_norm(m)
    exact = linalg.singular_values_from_r(linalg.r_factor(m, mean), rcond=0)
    for seed in (1, 2):
        sk = linalg.sketch_svd(m, 4, mean, seed, rcond=0)
        assert np.allclose(sk.s, exact, rtol=1e-9)
        # the one-pass variant squares cond(B): only the leading values are close
        chol = linalg.sketch_svd(m, 4, mean, seed, method="cholesky").s
        assert np.allclose(chol[:2], exact[:2], rtol=1e-5)


def test_fit_invariants(emb):
    model = ppca.ppca_fit(emb, 3, max_iter=6, target_error=0.0, seed=11)
    p = model.components
    assert p.shape == (64, 3)
    assert np.allclose(p.T @ p, np.eye(3), atol=1e-10)
    ss = [h["ss"] for h in model.history]
    assert all(b <= a * (1 + 1e-12) for a, b in zip(ss, ss[1:]))       # ss falls each round
    assert all(h["error"] >= -1e-9 for h in model.history)
    # ML noise variance is a lower bound the EM approaches from above (B1)
    assert ss[-1] >= 0.0150274057 * (1 - 1e-6)
    assert model.stat.n_iter == len(model.history) == 6
    assert len(model.stat.errors) == 6


def test_fit_converges_to_ml_noise(emb):
    model = ppca.ppca_fit(emb, 3, max_iter=200, target_error=0.0, error_metric="none", seed=5)
    assert model.stat.n_iter < 200                                      # 1e-5 rule stopped it
    assert model.ss == pytest.approx(0.0150274057, rel=2e-3)


def test_default_stop_rule_stops_early(emb):
    """With the 0.05 target and a flat spectrum, one round is enough."""
    model = ppca.ppca_fit(emb, 3, seed=1)
    assert model.stat.n_iter == 1
    assert model.history[0]["error"] <= 0.05


def test_subspace_close_to_exact_pca(spark):
    m = datasets.lineitem_matrix(spark, SF001)
    _, _, exact = ppca.exact_pca(m, 1)
    model = ppca.ppca_fit(m, 1, max_iter=10, seed=3)
    cos = abs(float(exact[:, 0] @ model.components[:, 0]))
    assert cos == pytest.approx(1.0, abs=1e-9)


@pytest.mark.parametrize("init", ["random", "given"])
def test_other_inits(emb, init):
    if init == "given":
        init = (np.full((64, 2), 0.1), 1.0)
    model = ppca.ppca_fit(emb, 2, max_iter=3, init=init, error_metric="l1_sampled", seed=2)
    assert model.stat.n_iter >= 1
    assert all(0 <= e for e in model.stat.errors)


def test_transform_shapes(emb):
    model = ppca.ppca_fit(emb, 3, max_iter=1, error_metric="none", seed=4)
    out = model.transform(emb).toPandas()
    assert len(out) == 500 and all(len(v) == 3 for v in out["values"])
    y = np.stack(emb.df.orderBy("row_id").toPandas()["features"].to_numpy())
    got = np.stack(out.sort_values("row_id")["values"].to_numpy())
    assert np.allclose(got, y @ model.loadings, atol=1e-12)
    cen = np.stack(model.transform(emb, centered=True, orthonormal=True)
                   .toPandas().sort_values("row_id")["values"].to_numpy())
    assert np.allclose(cen, (y - model.mean) @ model.components, atol=1e-12)


def test_sparse_fit_matches_dense_fit(spark):
    """The sparse path (mean folded in closed form, absent rows counted)
    gives the same statistics as the densified matrix."""
    m = datasets.customer_part_matrix(spark, SF001)
    ps = ppca.prepare(m, need_spectrum=False)
    rng = np.random.default_rng(0)
    c = rng.random((m.n_cols, 2))
    a = ppca.em_round(ps, c, 1.0)
    # dense twin over the same N rows: add the absent all-zero rows explicitly
    absent = m.n_rows - m.df.count()
    assert absent >= 0
    dense_rows = np.zeros((m.n_rows, m.n_cols))
    for r in m.df.toPandas().itertuples():
        dense_rows[r.row_id, list(r.indices)] = list(r.values)
    mu = dense_rows.mean(axis=0)
    assert np.allclose(ps.mean, mu, atol=1e-12)
    assert ps.norm2 == pytest.approx(((dense_rows - mu) ** 2).sum(), rel=1e-10)
    sx = np.linalg.inv(c.T @ c + np.eye(2))
    x = (dense_rows - mu) @ (c @ sx.T)
    xtx = x.T @ x + m.n_rows * sx
    assert np.allclose(a["xtx"], xtx, rtol=1e-9)
    assert np.allclose(a["ytx"], (dense_rows - mu).T @ x, rtol=1e-8, atol=1e-8)


def test_power_iteration_matches_gram(emb):
    mean, _ = stats.mean_and_norm(emb)
    g = linalg.gram(emb, mean)
    exact = linalg.singular_values_from_gram(g)[:3]
    r = linalg.r_factor(emb, mean)
    assert np.allclose(linalg.singular_values_from_r(r)[:3], exact, rtol=1e-10)
    approx = linalg.top_singular_values_power(emb, 3, mean, iters=60, tol=1e-7)
    assert np.allclose(approx, exact, rtol=1e-3)
    p = np.linalg.qr(np.random.default_rng(1).standard_normal((64, 2)))[0]
    norm, block = linalg.residual_spectral_norm_power(emb, p, mean, iters=60, tol=1e-7)
    assert norm == pytest.approx(linalg.residual_spectral_norm_gram(g, p), rel=1e-3)
    again, _ = linalg.residual_spectral_norm_power(emb, p, mean, iters=2, start=block)
    assert again == pytest.approx(norm, rel=1e-6)                       # warm start: converged already


def test_trials_and_run_log(emb, tmp_path):
    models, runs, summary = trials.run_trials(emb, 2, trials=2, seeds=[1, 2], dataset="emb",
                                              run_log=str(tmp_path / "log"), max_iter=2)
    assert runs.count() == 2
    row = summary.first()
    assert row["n_runs"] == 2 and row["var_s"] is not None
    _, runs1, summary1 = trials.run_trials(emb, 2, trials=1, seeds=[3], run_log=str(tmp_path / "log"),
                                           max_iter=1)
    assert summary1.first()["var_s"] is None                            # B9: NULL, not NaN
    log = emb.spark.read.json(str(tmp_path / "log"))
    assert log.count() == 3
    assert set(log.columns) >= {"app", "dataset", "n_rows", "n_cols", "seed", "n_iter", "total_s",
                                "preprocess_s", "sketch_s", "avg_iter_s", "iter_s", "errors"}
    avg = trials.mean_iteration_seconds(runs).select("avg_iter_s").toPandas()
    assert (avg["avg_iter_s"] >= 0).all()


def test_row_sample_is_stable(emb):
    a = rows.row_sample(emb, 0.3).df.select("row_id").toPandas()
    b = rows.row_sample(emb.with_df(emb.df.repartition(7)), 0.3).df.select("row_id").toPandas()
    assert sorted(a.row_id) == sorted(b.row_id)
    assert 0.2 < len(a) / 500 < 0.4


@pytest.mark.parametrize("sparse", [False, True])
def test_summary_and_passes_strategies_agree(spark, sample_df, sparse):
    """EM on the R factor (no pass per round) equals EM reading the rows."""
    from conftest import C0, SS0
    from lowrank.sources.tables import matrix_from_array, sparse_from_dense
    m = matrix_from_array(sample_df.repartition(3), "f", "id")
    if sparse:
        m = sparse_from_dense(m)
    a = ppca.ppca_fit(m, 3, max_iter=3, init=(np.array(C0), SS0), error_metric="l1_sampled",
                      target_error=0.0, strategy="summary")
    b = ppca.ppca_fit(m, 3, max_iter=3, init=(np.array(C0), SS0), error_metric="l1_sampled",
                      target_error=0.0, strategy="passes")
    assert [h["ss"] for h in a.history] == pytest.approx([h["ss"] for h in b.history], rel=1e-9)
    assert a.stat.errors == pytest.approx(b.stat.errors, rel=1e-9)
    assert np.allclose(a.loadings, b.loadings, atol=1e-10)


def test_summary_sketch_matches_pass_sketch(emb):
    mean, _ = stats.mean_and_norm(emb)
    r = linalg.r_factor(emb, mean)
    a = linalg.sketch_svd(emb, 13, mean, 5)
    b = linalg.sketch_svd(emb, 13, mean, 5, method="summary", r_summary=r)
    assert np.allclose(a.s, b.s, rtol=1e-9)
    assert np.allclose(np.abs(a.v.T @ b.v), np.eye(13), atol=1e-6)


def test_exact_ss_matches_r_factor_route(spark):
    """lineitem: norm2 ~ 5e12 against ss ~ 7e-4.  The direct residual pass
    agrees with the R-factor route; the one-pass formula loses digits."""
    m = datasets.lineitem_matrix(spark, SF001)
    kw = dict(max_iter=4, init=(np.full((4, 2), 0.5), 1.0), error_metric="none")
    a = ppca.ppca_fit(m, 2, strategy="summary", **kw)
    b = ppca.ppca_fit(m, 2, strategy="passes", exact_ss=True, **kw)
    c = ppca.ppca_fit(m, 2, strategy="passes", exact_ss=False, **kw)
    default = ppca.ppca_fit(m, 2, strategy="passes", **kw)
    sa, sb, sc, sd = ([h["ss"] for h in x.history] for x in (a, b, c, default))
    assert sb == pytest.approx(sa, rel=1e-7)
    assert sd == pytest.approx(sa, rel=1e-7)
    assert abs(sc[-1] - sa[-1]) > abs(sb[-1] - sa[-1])


@pytest.mark.parametrize("strategy", ["summary", "passes"])
def test_rotate_to_data_gives_uncorrelated_ordered_scores(emb, strategy):
    model = ppca.ppca_fit(emb, 3, max_iter=2, seed=4, error_metric="none", strategy=strategy,
                          rotate_to_data=True)
    y = np.stack(emb.df.toPandas()["features"].to_numpy())
    scores = (y - y.mean(axis=0)) @ model.components
    cov = np.cov(scores, rowvar=False)
    assert np.allclose(cov - np.diag(np.diag(cov)), 0, atol=1e-10)
    assert np.allclose(np.diag(cov), model.explained_variance, rtol=1e-8)
    assert list(model.explained_variance) == sorted(model.explained_variance, reverse=True)
    plain = ppca.ppca_fit(emb, 3, max_iter=2, seed=4, error_metric="none", strategy=strategy)
    # same subspace either way
    assert np.allclose(np.linalg.svd(plain.components.T @ model.components, compute_uv=False), 1, atol=1e-9)
