"""Distributed linear algebra on a ``TallMatrix``.

One kernel does most of the work: for a small d x q matrix V it forms
X = A V block by block and sums X, X'X and A'X over all rows, where A is
the centred matrix.  Dense blocks are centred in place; sparse blocks are
never densified, and the mean is folded back in closed form on the driver
(Yc'Xc = Y'X - ym (sum X)' and the like), so absent all-zero rows count.
The driver only holds d x q results.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..matrix import TallMatrix
from .blocks import (BLOCK_WIDTH, Block, _merge_state, centred_tsqr, partial_sums, partial_sums_df, sums_and_r, tsqr,
                     wide_cross, wide_products)
from .packed import SUM_CELLS, packed_cross
from .stats import mean_and_norm

# Exact-spectrum route (d x d R factor or Gram) when d is at most this;
# otherwise Lanczos.
MAX_GRAM_COLS = 4096
# Passes after which a Lanczos run that has not converged fails.
MAX_PASSES = 200
# Share of a sum of squares under which its difference with the squared sums
# has lost too many digits.
CANCELLED = 1e-6
# Largest d x q model the driver is asked to hold (doubles).
MAX_DRIVER_DOUBLES = 64 * 1024 * 1024


def check_driver_size(rows: int, cols: int, what: str) -> None:
    if rows * cols > MAX_DRIVER_DOUBLES:
        raise ValueError(f"{what} would be {rows} x {cols} doubles on the driver; too large")


@dataclass
class CrossStats:
    """Centred sufficient statistics for X = A V over all N rows."""
    n: int
    sum_x: np.ndarray      # q      : sum of X (uncentred X for sparse input)
    xtx: np.ndarray        # q x q  : (X - xm)'(X - xm)
    ytx: np.ndarray        # d x q  : A'(X - xm)


def _offset(m: TallMatrix, mean: np.ndarray) -> np.ndarray:
    """Mean still to subtract after the kernel: 0 for dense (centred in block)."""
    return mean if m.is_sparse else np.zeros_like(mean)


def cross_stats(m: TallMatrix, v: np.ndarray, mean: np.ndarray) -> CrossStats:
    """A6 (and L1 + A8 with V = Omega): one pass over the rows."""
    d, q = v.shape
    check_driver_size(d, q, "A'X")
    mu = np.asarray(mean, dtype=np.float64)

    def centred(block: Block):
        a = block.dense - mu
        x = a @ v
        return {"sx": x.sum(axis=0), "sxx": x.T @ x, "syx": a.T @ x}

    def stored(block: Block):                          # its closure has V, not the mean
        x = block.matmul(v)
        return {"sx": x.sum(axis=0), "sxx": x.T @ x, "syx": block.t_matmul(x)}      # columns present only

    if m.packed is not None and (q == 1 or d * q <= SUM_CELLS):
        r = packed_cross(m.packed, v, d)
    else:
        r = partial_sums(m.narrow(), stored if m.is_sparse else centred, {"sx": (q,), "sxx": (q, q), "syx": (d, q)})
    if m.wide is not None:
        _, sx, sxx, syx = wide_cross(m, v)
        r = {"sx": r["sx"] + sx, "sxx": r["sxx"] + sxx, "syx": r["syx"] + syx}
    n = m.n_rows if m.is_sparse else 0     # dense blocks are centred already
    off = _offset(m, mu)
    xm = off @ v
    sx = r["sx"]
    xtx = r["sxx"] - np.outer(sx, xm) - np.outer(xm, sx) + n * np.outer(xm, xm)
    ytx = r["syx"]
    for column, total in zip(ytx.T, sx):               # in place: d x q may be large
        column -= off * total
    return CrossStats(n=n, sum_x=sx, xtx=xtx, ytx=ytx)


def cross_stats_from_r(r: np.ndarray, v: np.ndarray) -> CrossStats:
    """The same statistics from the R factor of A (R'R = A'A), no data
    pass: X'X = (R V)'(R V), A'X = R'(R V), sum X = 0."""
    rv = r @ v
    return CrossStats(n=0, sum_x=np.zeros(v.shape[1]), xtx=rv.T @ rv, ytx=r.T @ rv)


def gram_df(m: TallMatrix, mean: np.ndarray) -> DataFrame:
    """Lazy ``(r, c, g)`` Gram matrix A'A of the centred rows (dense input),
    summed by Spark; nothing is collected."""
    d = m.n_cols
    check_driver_size(d, d, "Gram")
    mu = np.asarray(mean, dtype=np.float64)
    if m.is_sparse:
        raise ValueError("gram_df takes dense input; use gram() for sparse")

    def kernel(block: Block):
        a = block.dense - mu
        return {"g": a.T @ a}

    parts = partial_sums_df(m, kernel)
    cols = F.array(*[F.col(f"c{t}") for t in range(BLOCK_WIDTH)])
    return (parts.select("r", "cb", F.posexplode(cols).alias("t", "g"))
            .select("r", (F.col("cb") * BLOCK_WIDTH + F.col("t")).cast("int").alias("c"), "g")
            .where(F.col("c") < d))


def gram(m: TallMatrix, mean: np.ndarray) -> np.ndarray:
    """A'A, d x d, on the driver (d bounded by MAX_GRAM_COLS)."""
    d = m.n_cols
    if d > MAX_GRAM_COLS:
        raise ValueError(f"Gram of {d} columns exceeds {MAX_GRAM_COLS}; use Lanczos")
    mu = np.asarray(mean, dtype=np.float64)
    dense = not m.is_sparse

    def kernel(block: Block):
        if dense:
            a = block.dense - mu
            return {"g": a.T @ a}
        return {"g": block.gram(), "s": block.col_sum()}

    if dense:
        return partial_sums(m, kernel, {"g": (d, d)})["g"]
    r = partial_sums(m, kernel, {"g": (d, d), "s": (d,)})
    n = m.n_rows
    # Y'Y - s ym' - ym s' + N ym ym'
    return r["g"] - np.outer(r["s"], mu) - np.outer(mu, r["s"]) + n * np.outer(mu, mu)


def gram_apply(m: TallMatrix, v: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """A'A V in one pass without forming A'A (for wide matrices).
    With X = A V, A'(X - xm) = A'X because the columns of A sum to zero."""
    d, q = v.shape
    check_driver_size(d, q, "A'A V")
    step = max(1, SUM_CELLS // d)
    if m.packed is None or q <= step:
        return cross_stats(m, v, mean).ytx
    return np.hstack([cross_stats(m, v[:, at:at + step], mean).ytx for at in range(0, q, step)])


def singular_values_from_gram(g: np.ndarray, rcond: float = 1e-5) -> np.ndarray:
    """Singular values of A from A'A, dropping those below rcond * s_max
    (as an rcond-truncated SVD would)."""
    w = np.sort(np.clip(np.linalg.eigvalsh((g + g.T) / 2), 0.0, None))[::-1]
    s = np.sqrt(w)
    if s.size == 0 or s[0] == 0:
        return s[:0]
    return s[s > rcond * s[0]]


def orthonormal_basis(c: np.ndarray) -> np.ndarray:
    """Left singular vectors of C (d x k), ordered by singular value."""
    u, _, _ = np.linalg.svd(c, full_matrices=False)
    return u


def canonical_signs(u: np.ndarray) -> np.ndarray:
    """Flip each column so its largest-magnitude entry is positive."""
    u = np.array(u, dtype=np.float64, copy=True)
    for p in range(u.shape[1]):
        i = int(np.argmax(np.abs(u[:, p])))
        if u[i, p] < 0:
            u[:, p] = -u[:, p]
    return u


def residual_spectral_norm_gram(g: np.ndarray, p: np.ndarray) -> float:
    """L5 by deflation: ||A (I - P P')||_2 from the Gram matrix, no data pass."""
    proj = np.eye(g.shape[0]) - p @ p.T
    e = proj @ g @ proj
    w = np.linalg.eigvalsh((e + e.T) / 2)
    return float(np.sqrt(max(w[-1], 0.0)))


# Columns of a Lanczos block, at least, and blocks held before a restart, at most.
LANCZOS_BLOCK = 32
LANCZOS_BLOCKS = 30
# Doubles of a run's basis and its images on the driver.
LANCZOS_DOUBLES = 16 * 1024 * 1024


@dataclass
class LanczosResult:
    values: np.ndarray     # q largest eigenvalues of E'E, falling
    bounds: np.ndarray     # |value - an eigenvalue| is at most this (residual norms)
    block: np.ndarray      # Ritz vectors to start the next run with (without a basis: the run's start)
    passes: int


def _orthonormal(x: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Orthonormal columns of the part of ``x`` outside span(basis); those at
    rounding level are left out."""
    size = np.linalg.norm(x, axis=0).max(initial=0.0)
    for _ in range(2):
        x = x - basis @ (basis.T @ x)
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    u = u[:, s > 1e-10 * size] if size > 0 else u[:, :0]
    u = u - basis @ (basis.T @ u)
    return np.linalg.qr(u)[0]


def _recurrence(d: int, deflate, tol: float, seed: int, start: np.ndarray | None, max_passes: int):
    """Lanczos by its three-term recurrence, for the largest eigenvalue alone:
    the driver holds the last two vectors, whatever the number of passes.
    Without reorthogonalisation the tridiagonal matrix repeats eigenvalues it
    has found, which leaves the largest and the residual norms as they are."""
    def first() -> np.ndarray:
        v = np.random.default_rng(seed).standard_normal((d, 1))
        if start is not None and start.shape[0] == d:
            v *= 1e-3 / np.linalg.norm(v)                          # the start may lack the vector looked for
            v += start[:, :1]
        v = deflate(v)
        return v / np.linalg.norm(v)

    v, before, diagonal, side = first(), None, [], []
    for passes in range(1, max_passes + 1):
        z = deflate((yield v)).copy()
        diagonal.append(float(v[:, 0] @ z[:, 0]))
        z -= diagonal[-1] * v
        if side:
            before *= side[-1]
            z -= before
        z -= float(v[:, 0] @ z[:, 0]) * v
        beta = float(np.linalg.norm(z))
        if passes <= 100 or passes % 10 == 0 or beta == 0.0:
            w, y = np.linalg.eigh(np.diag(diagonal) + np.diag(side, 1) + np.diag(side, -1))
            w, size = w[::-1], beta * np.abs(y[-1, ::-1])
            value = max(w[0], 0.0)
            squares = [float(size[:t] @ size[:t]) / (w[t - 1] - w[t]) for t in range(1, min(9, len(w))) if w[t - 1] > w[t]]
            if len(w) >= d or min([size[0], *squares]) <= 2 * tol * value + np.finfo(float).eps * value:
                return LanczosResult(np.array([value]), size[:1], first(), passes)
        side.append(beta)
        z /= beta
        before, v = v, z
    raise RuntimeError(f"singular values not converged to {tol} in {max_passes} passes; raise max_passes or tol")


def lanczos(d: int, q: int, p: np.ndarray | None = None, tol: float = 1e-6, seed: int = 0,
            start: np.ndarray | None = None, max_passes: int = MAX_PASSES, block: int = LANCZOS_BLOCK):
    """L3 / L5 for wide matrices: the ``q`` largest eigenvalues of E'E, E =
    A (I - P P') (P = None: E = A), by block Golub-Kahan-Lanczos in its
    one-sided form with full reorthogonalisation and thick restart.

    A coroutine: it yields a d x b block V and is sent A'A V, so one
    distributed pass may serve several runs (``lanczos_runs``).  The whole
    Krylov basis and its images stay on the driver (2 d x LANCZOS_BLOCKS b
    doubles, fewer and narrower blocks where LANCZOS_DOUBLES asks for it); when
    it is full, the leading Ritz vectors and the current residual block carry
    on.  For one value of a matrix so wide that under four blocks have room, it
    keeps no basis (``_recurrence``).  It stops when each value's error bound, the residual norm or the
    square of the residual over the gap to the next Ritz value, is
    below 2 ``tol`` relatively (``tol`` for singular values), and fails after
    ``max_passes`` blocks of full width, or as many columns in narrower ones."""
    free = d - (0 if p is None else p.shape[1])
    b = full = min(free, max(block, q + 8))
    room = LANCZOS_DOUBLES // (2 * d)
    if q == 1 and room < 4 * b:
        return (yield from _recurrence(d, lambda x: x if p is None else x - p @ (p.T @ x), tol, seed, start,
                                       max_passes * b))
    while b > q + 2 and 3 * b > room:
        b -= 1
    max_passes = max_passes * full // max(1, b)
    most = min(LANCZOS_BLOCKS * b, max(room, 3 * b))
    check_driver_size(d, 2 * min(most, d), "Krylov basis")

    def deflate(x):
        return x if p is None else x - p @ (p.T @ x)

    rng = np.random.default_rng(seed)
    first = rng.standard_normal((d, b))
    if start is not None and start.shape[0] == d:
        first[:, :min(b, start.shape[1])] = start[:, :b]
    v = _orthonormal(deflate(first), np.zeros((d, 0)))
    basis, image, h = np.zeros((d, 0)), np.zeros((d, 0)), np.zeros((0, 0))
    for passes in range(1, max_passes + 1):
        z = deflate((yield v))
        basis, image = np.hstack([basis, v]), np.hstack([image, z])
        side = basis.T @ z
        h = np.block([[h, side[:len(h)]], [side[:len(h)].T, side[len(h):]]])
        w, y = np.linalg.eigh((h + h.T) / 2)
        w, y = w[::-1], y[:, ::-1]
        top = min(len(w), q + 8)
        residual = image @ y[:, :top] - (basis @ y[:, :top]) * w[:top]
        size = np.linalg.norm(residual, axis=0)
        floor = np.finfo(float).eps * d * max(w[0], 0.0)           # a value at rounding level has converged
        if len(w) >= min(q, free):
            values = np.clip(w[:q], 0.0, None)
            squares = [np.linalg.norm(residual[:, :t], 2) ** 2 / (w[t - 1] - w[t])
                       for t in range(q, min(top + 1, len(w))) if w[t - 1] > w[t]]
            errors = np.minimum(size[:len(values)], min(squares, default=np.inf))
            if len(basis.T) >= free or (errors <= 2 * tol * values + floor).all():
                ritz = basis @ y[:, :b]
                return LanczosResult(np.r_[values, np.zeros(q - len(values))], size[:len(values)], ritz, passes)
        v = _orthonormal(z, basis)
        if v.shape[1] == 0:                                        # an invariant subspace: look outside it
            v = _orthonormal(deflate(rng.standard_normal((d, b))), basis)
        v = _orthonormal(deflate(v), basis)[:, :max(1, free - basis.shape[1])]
        if basis.shape[1] + v.shape[1] > most:
            keep = min(len(w), most - b, q + 2 * b)
            basis, image, h = basis @ y[:, :keep], image @ y[:, :keep], np.diag(w[:keep])
    raise RuntimeError(f"singular values not converged to {tol} in {max_passes} passes; raise max_passes or tol")


def lanczos_runs(m: TallMatrix, mean: np.ndarray, runs: list) -> list[LanczosResult]:
    """Drive several ``lanczos`` runs in step: each distributed pass multiplies
    the blocks of all of them side by side."""
    out: list = [None] * len(runs)
    asked = {i: next(r) for i, r in enumerate(runs)}
    while asked:
        at = list(asked)
        widths = np.cumsum([0] + [asked[i].shape[1] for i in at])
        z = gram_apply(m, np.vstack([asked[i].T for i in at]).T, mean)         # columns in one piece each
        for i, a, e in zip(at, widths[:-1], widths[1:]):
            try:
                asked[i] = runs[i].send(z[:, a:e])
            except StopIteration as done:
                out[i] = done.value
                del asked[i]
    return out


def residual_spectral_norm_power(m: TallMatrix, p: np.ndarray, mean: np.ndarray,
                                 iters: int = MAX_PASSES, tol: float = 1e-6, seed: int = 0,
                                 start: np.ndarray | None = None) -> tuple[float, np.ndarray]:
    """L5 for wide matrices: ||A (I - P P')||_2 by Lanczos; returns the norm
    and the block to warm-start the next round with."""
    got = lanczos_runs(m, mean, [lanczos(m.n_cols, 1, p, tol, seed, start, iters)])[0]
    return float(np.sqrt(got.values[0])), got.block


def top_singular_values_power(m: TallMatrix, q: int, mean: np.ndarray, iters: int = MAX_PASSES,
                              tol: float = 1e-6, seed: int = 0) -> np.ndarray:
    """Largest ``q`` singular values of A by Lanczos on A'A (wide d), one pass per step."""
    return np.sqrt(lanczos_runs(m, mean, [lanczos(m.n_cols, q, None, tol, seed, None, iters)])[0].values)


def r_factor(m: TallMatrix, mean: np.ndarray, v: np.ndarray | None = None) -> np.ndarray:
    """R of the centred matrix A (or of A V) by TSQR: R'R = A'A with the
    conditioning of A.  Absent all-zero rows of a sparse matrix are one
    extra row sqrt(#absent) * (-ym) (R'R only sees the sum of outer
    products)."""
    mu = np.asarray(mean, dtype=np.float64)
    width = m.n_cols if v is None else v.shape[1]
    check_driver_size(width, width, "R factor")
    shift = mu if v is None else mu @ v

    def rows_fn(block: Block) -> np.ndarray:
        if v is None:
            return block.to_dense() - mu
        return block.matmul(v) - shift

    r = tsqr(m if v is None else m.narrow(), rows_fn, width, densifies=v is None)
    if v is not None and m.wide is not None:
        x = wide_products(m, v).select("row_id", F.array(*(f"x{p}" for p in range(width))).alias("features"))
        x = TallMatrix(x, n_cols=width, n_rows=m.wide_rows)
        r = np.linalg.qr(np.vstack([r, tsqr(x, lambda b: b.dense - shift, width, densifies=False)]), mode="r")
    if m.is_sparse:
        absent = m.n_rows - m.stored_rows()
        if absent > 0:
            extra = -np.sqrt(float(absent)) * shift
            r = np.linalg.qr(np.vstack([r, extra[None, :]]), mode="r")
    return r


def centred_summary(m: TallMatrix) -> tuple[int, np.ndarray, float, np.ndarray]:
    """One pass: (N, column mean, centred norm, R factor of the centred
    matrix), absent all-zero rows of a sparse matrix included."""
    d = m.n_cols
    check_driver_size(d, d, "R factor")
    n, mean, r = centred_tsqr(m)
    if m.is_sparse and m.n_rows > n:
        n, mean, r = _merge_state((n, mean, r), (m.n_rows - n, np.zeros(d), np.zeros((d, d))))
    return n, mean, float(np.sum(r * r)), r


def singular_values_from_r(r: np.ndarray, rcond: float = 1e-5) -> np.ndarray:
    """Singular values of A from its R factor, those below rcond * s_max
    dropped (as an rcond-truncated SVD would)."""
    s = np.linalg.svd(r, compute_uv=False)
    if s.size == 0 or s[0] == 0:
        return s[:0]
    return s[s > rcond * s[0]]


def residual_spectral_norm_r(r: np.ndarray, p: np.ndarray) -> float:
    """L5 without a data pass: ||A (I - P P')||_2 = ||R (I - P P')||_2."""
    e = r - (r @ p) @ p.T
    return float(np.linalg.svd(e, compute_uv=False)[0])


@dataclass
class SketchResult:
    s: np.ndarray          # k + s singular values of Q'A (0 for missing directions)
    v: np.ndarray          # d x (k + s) right singular vectors
    rank: int


def _sketch_pass(m: TallMatrix, omega: np.ndarray, mean: np.ndarray):
    """L1 + L2 + A8 in one pass: R of B = A Omega and B'A together."""
    d, q = omega.shape
    mu = np.asarray(mean, dtype=np.float64)
    shift = mu @ omega
    dense = not m.is_sparse

    def kernel(block: Block):
        if dense:
            a = block.dense - mu
            x = a @ omega
            return {"sx": x.sum(axis=0), "syx": a.T @ x}
        x = block.matmul(omega)
        return {"sx": x.sum(axis=0), "syx": block.t_matmul(x)}

    def rows_fn(block: Block):
        return (block.dense - mu) @ omega if dense else block.matmul(omega) - shift

    out = sums_and_r(m.narrow(), kernel, {"sx": (q,), "syx": (d, q)}, rows_fn, q)
    if out is None:
        return None
    sums, r = out
    if m.wide is not None:
        x, sx, _, syx = wide_cross(m, omega)
        if x is None:
            return None
        sums = {"sx": sums["sx"] + sx, "syx": sums["syx"] + syx}
        r = np.linalg.qr(np.vstack([r, x - shift]), mode="r")
    off = mu if m.is_sparse else np.zeros_like(mu)
    ytx = sums["syx"] - np.outer(off, sums["sx"])      # A'(B - 1 bm'), as in cross_stats
    if m.is_sparse:
        absent = m.n_rows - m.stored_rows()
        if absent > 0:
            r = np.linalg.qr(np.vstack([r, -np.sqrt(float(absent)) * shift[None, :]]), mode="r")
    return r, ytx.T


def sketch_matrix(d: int, width: int, seed: int) -> np.ndarray:
    """The seeded N(0, 1) sketch matrix Omega (d x width); the seed in
    the run log regenerates it (K6)."""
    return np.random.default_rng(seed).standard_normal((d, width))


def sketch_svd(m: TallMatrix, width: int, mean: np.ndarray, seed: int,
               rcond: float = 1e-5, method: str = "tsqr", r_summary: np.ndarray | None = None,
               omega: np.ndarray | None = None) -> SketchResult:
    """Randomised SVD of the centred matrix A.

    B = A Omega (L1, Omega seeded N(0,1), d x width, unless given).  ``tsqr`` (default):
    pass 1 is a tall-skinny QR of B (L2); on the driver R = U S V', keep
    S > rcond * S_max (rank-revealing, B7) and T = V S^-1, so Q = B T has
    orthonormal columns; pass 2 sums B'A (A8) and Q'A = T' B'A.
    ``cholesky`` takes R from B'B in the same single pass as B'A (half the
    passes, but the conditioning of B is squared).  The TSQR pass and the
    B'A pass are one job when the task R factors fit the driver bound.  ``summary`` uses the R
    factor of A (``r_summary``) and needs no pass: B = Q_A (R Omega), so
    with R Omega = Q2 R2 the sketch basis is Q_A Q2 and Q'A = Q2' R.  The
    SVD of the small Q'A gives the approximate right singular vectors (L4).
    """
    d = m.n_cols
    omega = sketch_matrix(d, width, seed) if omega is None else np.asarray(omega, dtype=np.float64)      # S5
    if method == "summary":
        return sketch_from_omega(r_summary, omega, rcond)
    if method == "tsqr":
        return sketch_svds(m, [omega], mean, rcond)[0]
    if method != "cholesky":
        raise ValueError("method must be 'tsqr' or 'cholesky'")
    st = cross_stats(m, omega, mean)
    btb, bta = st.xtx, st.ytx.T
    w, vv = np.linalg.eigh((btb + btb.T) / 2)
    return _finish_sketch(np.sqrt(np.clip(w, 0.0, None)), vv, bta, rcond)


def sketch_svds(m: TallMatrix, omegas: list[np.ndarray], mean: np.ndarray, rcond: float = 1e-5) -> list[SketchResult]:
    """L7 for several sketch matrices in one pass: B'A and the R factor of all
    B = A Omega side by side; columns of that R factor are those of each B."""
    stacked = np.hstack(omegas)
    fused = _sketch_pass(m, stacked, mean)
    if fused is None:                                  # many task R factors: two passes + tree
        r = r_factor(m, mean, stacked)
        bta = cross_stats(m, stacked, mean).ytx.T
    else:
        r, bta = fused
    out, at = [], 0
    for omega in omegas:
        mine = slice(at, at + omega.shape[1])
        at = mine.stop
        _, sb, vt = np.linalg.svd(np.linalg.qr(r[:, mine], mode="r"))
        out.append(_finish_sketch(sb, vt.T, bta[mine], rcond))
    return out


def _finish_sketch(sb: np.ndarray, vv: np.ndarray, bta: np.ndarray, rcond: float) -> SketchResult:
    """From the singular values and right vectors of B and B'A: Q = B V S^-1
    on the directions kept, and the SVD of Q'A."""
    width, d = bta.shape
    keep = sb > rcond * (sb.max() if sb.size and sb.max() > 0 else 1.0)
    t = vv[:, keep] / sb[keep]
    qta = t.T @ bta                                    # rank x d
    _, s, vt2 = np.linalg.svd(qta, full_matrices=False)
    rank = int(keep.sum())
    s_full = np.zeros(width)
    s_full[:rank] = s
    v_full = np.zeros((d, width))
    v_full[:, :rank] = vt2.T
    return SketchResult(s=s_full, v=v_full, rank=rank)


def sketch_from_omega(r: np.ndarray, omega: np.ndarray, rcond: float = 1e-5) -> SketchResult:
    """L7 on the R factor of A: rank-revealing QR of R Omega, then Q'A."""
    d, width = omega.shape
    b = r @ omega
    u, sb, vt = np.linalg.svd(b, full_matrices=False)
    keep = sb > rcond * (sb.max() if sb.size and sb.max() > 0 else 1.0)
    q2 = u[:, keep]                                    # orthonormal basis of span(R Omega)
    qta = q2.T @ r
    _, s, vt2 = np.linalg.svd(qta, full_matrices=False)
    rank = int(keep.sum())
    s_full = np.zeros(width)
    s_full[:rank] = s
    v_full = np.zeros((d, width))
    v_full[:, :rank] = vt2.T
    return SketchResult(s=s_full, v=v_full, rank=rank)


def summary_and_sketch(m: TallMatrix, width: int, seed: int, rcond: float = 1e-5):
    """Mean, norm, row count and the sketch (L1, L2, A8) in ONE pass.

    Rows are shifted by a fixed vector s (one stored row for dense input,
    0 for sparse, so sparsity is kept); every statistic is then a plain sum
    Spark merges map-side: sum(y - s), sum((y - s)^2), sum(b' (y - s)) and
    sum(b) with b = (y - s) Omega, and the R factor of [1, B] by TSQR, whose
    trailing block is the R factor of the centred B.  The shifted sums lose
    digits only in proportion to |mean - s|, as the shifted-data variance
    algorithm does.  Returns (n, mean, norm2, SketchResult), or None when
    the task R factors exceed the driver bound (the caller then runs the
    separate passes)."""
    d = m.n_cols
    omega = sketch_matrix(d, width, seed)
    if m.is_sparse:
        shift = np.zeros(d)
    else:
        first = m.df.select("features").first()
        shift = np.asarray(first["features"], dtype=np.float64) if first else np.zeros(d)
    dense = not m.is_sparse

    def kernel(block: Block):
        if dense:
            ys = block.dense - shift
            b = ys @ omega
            return {"n": np.array([block.n]), "sy": ys.sum(axis=0), "syy": (ys * ys).sum(axis=0),
                    "sb": b.sum(axis=0), "sby": b.T @ ys}
        b = block.matmul(omega)
        y = block.values[:, None]
        return {"n": np.array([block.n]), "sb": b.sum(axis=0),
                "by": block.by_column(np.hstack([y * b[block.row_of], y, y * y]))}

    def rows_fn(block: Block):
        b = (block.dense - shift) @ omega if dense else block.matmul(omega)
        return np.hstack([np.ones((block.n, 1)), b])

    shapes = {"n": (1,), "sb": (width,)} | ({"sy": (d,), "syy": (d,), "sby": (width, d)} if dense else {"by": (d, width + 2)})
    out = sums_and_r(m.narrow(), kernel, shapes, rows_fn, width + 1)
    if out is None:
        return None
    sums, r1 = out
    if m.wide is not None:
        x, sx, _, by = wide_cross(m, omega, squares=True)
        if x is None:
            return None
        sums = {"n": sums["n"] + len(x), "sb": sums["sb"] + sx, "by": sums["by"] + by}
        r1 = np.linalg.qr(np.vstack([r1, np.hstack([np.ones((len(x), 1)), x])]), mode="r")
    if not dense:
        by = sums["by"]
        sums |= {"sby": by[:, :width].T, "sy": by[:, width], "syy": by[:, width + 1]}
    stored = int(round(sums["n"][0]))
    n = m.n_rows if (m.is_sparse and m.n_rows is not None) else stored
    if n > stored:                                     # absent all-zero rows: shifted value -s = 0
        r1 = np.linalg.qr(np.vstack([r1, np.r_[np.sqrt(float(n - stored)), np.zeros(width)][None, :]]),
                          mode="r")
    sy = sums["sy"]
    mean = shift + sy / n
    norm2 = float(np.sum(sums["syy"] - sy * sy / n))
    if norm2 <= CANCELLED * float(np.sum(sums["syy"])):
        norm2 = mean_and_norm(m.with_rows(n))[1]       # the difference lost its digits: merged moments
    r_b = r1[1:, 1:]                                   # R of the centred sketch B
    bta = sums["sby"] - np.outer(sums["sb"], sy) / n   # centred B'A
    _, sb, vt = np.linalg.svd(r_b)
    return n, mean, norm2, _finish_sketch(sb, vt.T, bta, rcond)
