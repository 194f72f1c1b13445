"""Deterministic checks on the 7 x 5 sample matrix (FIXTURES.md F1)."""

import numpy as np
import pytest

from conftest import C0, SS0
from lowrank.operators import linalg, ppca, stats
from lowrank.sources.tables import matrix_from_array, sparse_from_dense

GOLD = [  # round, ss, L1 error, Frobenius norm of C
    (1, 0.1388459822, 0.9477913166, 0.3122219489),
    (2, 0.0857876578, 0.6786573395, 0.4833952864),
    (3, 0.0417261807, 0.4302756760, 0.5863378794),
]


def _matrix(sample_df, parts, sparse):
    m = matrix_from_array(sample_df.repartition(parts), "f", "id")
    return sparse_from_dense(m) if sparse else m


@pytest.mark.parametrize("parts,sparse", [(1, False), (3, False), (8, True), (2, True)])
def test_em_rounds_match_golden(sample_df, parts, sparse):
    prep = ppca.prepare(_matrix(sample_df, parts, sparse), need_spectrum=False)
    c, ss = np.array(C0), SS0
    for rnd, g_ss, g_err, g_norm in GOLD:
        step = ppca.em_round(prep, c, ss)
        err = ppca.l1_error(prep.matrix, prep.mean, step["w"], step["c"], rate=1.0)
        c, ss = step["c"], step["ss"]
        assert ss == pytest.approx(g_ss, abs=1e-10)
        assert err == pytest.approx(g_err, abs=1e-10)
        assert np.linalg.norm(c) == pytest.approx(g_norm, abs=1e-10)


def test_mean_norm_and_spectrum(sample_df):
    m = _matrix(sample_df, 2, False)
    mean, norm2 = stats.mean_and_norm(m)
    assert np.allclose(mean, [3 / 7, 4 / 7, 3 / 7, 1, 0], atol=1e-15)
    assert norm2 == pytest.approx(36 / 7, abs=1e-12)
    s = linalg.singular_values_from_r(linalg.r_factor(m, mean))
    assert np.allclose(s, [1.87590929, 1.27429254], atol=1e-8)       # rank 2 after rcond
    g = linalg.singular_values_from_gram(linalg.gram(m, mean))
    assert np.allclose(g, s, atol=1e-8)
    _, sv, u = ppca.exact_pca(m, 1)
    assert np.allclose(np.abs(u[:, 0]), [0.21847879, 0.69002428, 0.69002428, 0, 0], atol=1e-8)


def test_fused_cross_term_equals_two_pass(sample_df):
    for sparse in (False, True):
        prep = ppca.prepare(_matrix(sample_df, 3, sparse), need_spectrum=False)
        step = ppca.em_round(prep, np.array(C0), SS0)
        two_pass = ppca.cross_term(prep.matrix, step["w"], step["c"], prep.mean)
        assert step["cross"] == pytest.approx(two_pass, rel=1e-12)


def test_rank_revealing_sketch(sample_df):
    """The centred sample matrix has rank 2; the sketch finds it and
    returns the exact singular values (k + s = d)."""
    m = _matrix(sample_df, 3, False)
    mean, _ = stats.mean_and_norm(m)
    for seed in (0, 1, 2):
        sk = linalg.sketch_svd(m, 5, mean, seed)
        assert sk.rank == 2
        assert np.allclose(sk.s[:2], [1.87590929, 1.27429254], atol=1e-7)
        assert np.allclose(sk.s[2:], 0)


def test_rank_deficient_spectral_error_is_null(sample_df):
    """sigma_{k+1} does not exist when rank <= k; only the other stop
    rules apply and the error is NULL."""
    model = ppca.ppca_fit(_matrix(sample_df, 2, False), 3, max_iter=2, seed=3)
    assert model.stat.n_iter == 2
    assert all(h["error"] is None for h in model.history)
