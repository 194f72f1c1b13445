"""Probabilistic PCA by expectation-maximisation.

Per round the driver holds only k x k and d x k matrices.  The rows are
read once per round: one ``mapInArrow`` pass yields the E-step sufficient
statistics (sum X, X'X, Y'X, summed by a Spark ``groupBy``), and the cross
term of the variance update is taken from Y'X (trace(C' Yc'Xc)), so the
second pass of a naive implementation is not needed (``cross_term`` keeps
the two-pass form for checking).  The spectral error uses one Gram pass at
the start for moderate d, or block Lanczos for wide d.

Fits that share their rows (trials) run in step: the loadings of all of them
stand side by side, so a round, a sketch or a Lanczos step is one pass over the
rows however many trials there are.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import hash_uniform
from ..matrix import TallMatrix
from ..session import has_exchange, materialize, release
from .blocks import Block, partial_sums
from .linalg import (MAX_GRAM_COLS, canonical_signs, centred_summary, cross_stats, cross_stats_from_r,
                     CANCELLED, CrossStats, MAX_DRIVER_DOUBLES, lanczos, lanczos_runs, orthonormal_basis, r_factor,
                     residual_spectral_norm_r, singular_values_from_r, sketch_matrix, sketch_svd, sketch_svds,
                     summary_and_sketch)
from .rows import project, row_sample
from .stats import column_summary

# Fixed defaults of the fit (values of the original job's options).
DEFAULT_MAX_ITER = 3
DEFAULT_OVERSAMPLE = 10
DEFAULT_TOL = 1e-5            # stop when the relative change of ss is at most this
DEFAULT_TARGET_ERROR = 0.05   # stop when the spectral error is at most this
DEFAULT_L1_TARGET_ERROR = 0.02
DEFAULT_RCOND = 1e-5          # singular values below rcond * s_max count as zero


@dataclass
class Prepared:
    """Data-dependent inputs shared by all trials of a fit."""
    matrix: TallMatrix
    mean: np.ndarray
    norm2: float
    preprocess_s: float
    r: np.ndarray | None = None       # R factor of the centred matrix (d <= MAX_GRAM_COLS)
    sigma_next: float | None = None   # sigma_{k+1} of the centred matrix
    summary: bool = False             # EM rounds from R (no pass per round)
    ritz_block: np.ndarray | None = None    # leading right singular vectors, as far as known
    power_blocks: dict = field(default_factory=dict)   # trial -> warm start of the wide-matrix spectral norm
    sketch: tuple | None = None       # (width, seed, SketchResult) computed with the statistics

    def close(self) -> None:
        """Let go of the pinned rows."""
        for df in (self.matrix.df, self.matrix.wide):
            if df is not None:
                release(df)


@dataclass
class RunStat:
    app: str
    dataset: str
    n_rows: int
    n_cols: int
    seed: int
    n_iter: int = 0
    total_s: float = 0.0
    preprocess_s: float = 0.0
    sketch_s: float = 0.0
    avg_iter_s: float = 0.0
    iter_s: list = field(default_factory=list)
    errors: list = field(default_factory=list)

    def as_row(self) -> dict:
        return dict(self.__dict__)


@dataclass
class PpcaModel:
    loadings: np.ndarray        # C, d x k
    components: np.ndarray      # orthonormal basis of span(C), canonical signs
    mean: np.ndarray
    ss: float
    n_rows: int
    history: list
    stat: RunStat
    explained_variance: np.ndarray | None = None   # per component, with rotate_to_data

    @property
    def k(self) -> int:
        return self.loadings.shape[1]

    def transform(self, m: TallMatrix, centered: bool = False, orthonormal: bool = False) -> DataFrame:
        """P10: ``(row_id, values)`` projected rows.  Defaults follow the
        original job: uncentred rows times C."""
        w = self.components if orthonormal else self.loadings
        return project(m, w, self.mean if centered else None)

    def components_df(self, spark: SparkSession) -> DataFrame:
        """M6 as a table ``(j INT, p INT, w DOUBLE)``."""
        d, k = self.components.shape
        table = pa.table({"j": pa.array(np.repeat(np.arange(d), k), pa.int32()), "p": pa.array(np.tile(np.arange(k), d), pa.int32()),
                          "w": np.ascontiguousarray(self.components, dtype=np.float64).ravel()})
        return spark.createDataFrame(table, "j int, p int, w double")

    def components_matrix(self, spark: SparkSession) -> TallMatrix:
        """M6 as a d x k dense matrix (row j = loadings of column j)."""
        rows = [(j, [float(x) for x in self.components[j]]) for j in range(self.components.shape[0])]
        df = spark.createDataFrame(rows, "row_id long, features array<double>")
        return TallMatrix(df, n_cols=self.k, n_rows=len(rows))

    def write_components(self, spark: SparkSession, path: str, fmt: str = "DENSE") -> None:
        """Write the components in the chosen format."""
        from ..sources.text import write_matrix
        write_matrix(self.components_matrix(spark), path, fmt)

    def write_projection(self, m: TallMatrix, path: str, fmt: str = "PARQUET", centered: bool = False,
                         orthonormal: bool = False) -> None:
        """K4: save the projected rows (Parquet or a text format)."""
        from ..sources.text import write_matrix
        from .rows import as_matrix
        write_matrix(as_matrix(self.transform(m, centered, orthonormal), self.k, m.n_rows), path, fmt)

    def history_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            [(h["round"], float(h["ss"]), float(h["rel_change"]),
              None if h["error"] is None else float(h["error"]), float(h["seconds"])) for h in self.history],
            "round int, ss double, rel_change double, error double, seconds double")


def clamp_rank(k: int, d: int, oversample: int) -> tuple[int, int]:
    """1 <= k < d and 1 <= oversample, with k + s at most d."""
    if d < 2:
        raise ValueError("PCA needs at least two columns")
    if k >= d:
        k = d - 1
    if k < 1:
        raise ValueError("k must be at least 1")
    if k + oversample >= d:
        oversample = d - k
    return k, max(1, oversample)


# 'auto' takes the R-factor route up to this width even without a spectral
# error: its one TSQR pass costs about 2 N d^2 flops, a few EM rounds' worth.
SUMMARY_MAX_COLS = 512


def use_summary(strategy: str, d: int, spectral: bool = False) -> bool:
    """'auto': R-factor route when d is small, or when the spectral error
    needs the R factor anyway (d <= MAX_GRAM_COLS); else a pass per round."""
    if strategy not in ("auto", "summary", "passes"):
        raise ValueError("strategy must be 'auto', 'summary' or 'passes'")
    if strategy == "summary" and d > MAX_GRAM_COLS:
        raise ValueError(f"the summary strategy holds d x d; d = {d} exceeds {MAX_GRAM_COLS}")
    if strategy != "auto":
        return strategy == "summary"
    return d <= SUMMARY_MAX_COLS or (spectral and d <= MAX_GRAM_COLS)


def prepare(m: TallMatrix, need_spectrum: bool = True, k: int | None = None,
            rcond: float = DEFAULT_RCOND, cut_lineage: bool | None = None,
            strategy: str = "passes", partitions: int | None = None,
            sketch: tuple[int, int] | None = None) -> Prepared:
    """One job for mean, norm and row count (A1 + A2).

    ``summary`` (d <= MAX_GRAM_COLS): the R factor of the centred matrix
    by TSQR, and every later step (sketch, EM rounds, spectral error) works
    on R on the driver.  A plain scan is read exactly once: count, mean,
    norm and R come out of one pass (``centred_summary``); rows produced by
    shuffles are pinned first, then summarised and factored.  ``passes``: the rows are pinned
    (persisted, or checkpointed when shuffles precede them) and read once
    per EM round; with ``need_spectrum`` the R factor (d <= MAX_GRAM_COLS)
    or power iteration gives sigma_{k+1}, outside the preprocessing time
    (B18)."""
    t0 = time.time()
    summary = use_summary(strategy, m.n_cols, need_spectrum)
    if summary and not partitions and not has_exchange(m.df) and cut_lineage is None:
        # one pass over a plain scan: count, mean, norm and R together
        n, mean, norm2, r = centred_summary(m)
        m = m.with_rows(n)
        prep = Prepared(matrix=m, mean=mean, norm2=norm2, preprocess_s=time.time() - t0,
                        summary=True, r=r)
    else:
        m = m.with_df(materialize(m.df, cut_lineage, partitions))
        if m.wide is not None:
            m = replace(m, wide=materialize(m.wide, cut_lineage))
        fused = None
        if sketch is not None and not summary:
            # per-round route: statistics and the sketch share one pass
            fused = summary_and_sketch(m, sketch[0], sketch[1], rcond)
        if fused is not None:
            n, mean, norm2, sk = fused
            m = m.with_rows(n)
            prep = Prepared(matrix=m, mean=mean, norm2=norm2, preprocess_s=0.0, summary=False,
                            sketch=(sketch[0], sketch[1], sk))
        else:
            mean, norm2, n = column_summary(m)
            m = m.with_rows(n)
            prep = Prepared(matrix=m, mean=mean, norm2=norm2, preprocess_s=0.0, summary=summary)
            if summary:
                prep.r = r_factor(m, mean)
        prep.preprocess_s = time.time() - t0
    if need_spectrum:
        if prep.r is None and m.n_cols <= MAX_GRAM_COLS:
            prep.r = r_factor(m, mean)
        if k is not None:
            prep.sigma_next = sigma_at(prep, k, rcond)
    return prep


def sigma_at(prep: Prepared, k: int, rcond: float = DEFAULT_RCOND) -> float:
    """sigma_{k+1} (zero-based index k) of the centred matrix; 0 when the
    rank is at most k (B6)."""
    if prep.r is not None:
        s = singular_values_from_r(prep.r, rcond)
    else:
        got = lanczos_runs(prep.matrix, prep.mean, [lanczos(prep.matrix.n_cols, k + 1)])[0]
        prep.ritz_block = got.block
        s = np.sqrt(got.values)
        s = s[s > rcond * (s[0] if s.size else 0)]
    return float(s[k]) if s.size > k else 0.0


def spectral_errors(prep: Prepared, cs: dict[int, np.ndarray], sigma_next: float) -> dict[int, float | None]:
    """M5 per trial: (||A - A P P'||_2 - sigma_{k+1}) / sigma_{k+1}, P = L6(C).
    Wide matrices: Lanczos runs of all trials in step, each warm-started from
    its last round (the first from the vectors that gave sigma_{k+1})."""
    if sigma_next <= 0:
        return dict.fromkeys(cs)
    bases = {t: orthonormal_basis(c) for t, c in cs.items()}
    if prep.r is not None:
        norms = {t: residual_spectral_norm_r(prep.r, p) for t, p in bases.items()}
    else:
        d = prep.matrix.n_cols
        got = lanczos_runs(prep.matrix, prep.mean, [lanczos(d, 1, p, start=prep.power_blocks.get(t, prep.ritz_block)) for t, p in bases.items()])
        prep.power_blocks.update(zip(bases, (g.block for g in got)))
        norms = {t: float(np.sqrt(g.values[0])) for t, g in zip(bases, got)}
    return {t: (norm - sigma_next) / sigma_next for t, norm in norms.items()}


def spectral_error(prep: Prepared, c: np.ndarray, sigma_next: float) -> float | None:
    """M5 of one fit."""
    return spectral_errors(prep, {0: c}, sigma_next)[0]


def l1_errors(m: TallMatrix, mean: np.ndarray, fits: list[tuple[np.ndarray, np.ndarray]], rate: float = 1.0,
              salt: str = "l1") -> list[float | None]:
    """M8 of several (W, C) in one pass: max column abs-sum of the residual x C' - a
    (x = a W) over the max column abs-sum of the centred rows a, on a
    hashed row sample (P2)."""
    mu = np.asarray(mean, dtype=np.float64)
    d = m.n_cols

    def sums(a):
        return np.vstack([np.abs(a).sum(axis=0), *(np.abs((a @ w) @ c.T - a).sum(axis=0) for w, c in fits)])

    def kernel(block: Block):
        out = np.zeros((len(fits) + 1, d))
        for part in block.chunks():
            out += sums(part.to_dense() - mu)
        return {"s": out}

    sample = row_sample(m, rate, salt)
    out = partial_sums(sample, kernel, {"s": (len(fits) + 1, d)})["s"]
    if m.is_sparse and m.n_rows > 0:
        # absent all-zero rows in the sample: a = -mean, residual = -(mean W) C' + mean
        absent = _absent_rows(m) if rate >= 1.0 else _sampled_ids(m, rate, salt) - sample.stored_rows()
        out = out + absent * sums(-mu[None, :]) if absent else out
    base = out[0].max()
    return [None if base == 0 else float(r.max() / base) for r in out[1:]]


def l1_error(m: TallMatrix, mean: np.ndarray, w: np.ndarray, c: np.ndarray, rate: float = 1.0,
             salt: str = "l1") -> float | None:
    """M8 of one fit."""
    return l1_errors(m, mean, [(w, c)], rate, salt)[0]


def _sampled_ids(m: TallMatrix, rate: float, salt: str) -> int:
    """How many of the row ids 0 .. n_rows - 1 the hashed sample takes."""
    ids = m.spark.range(m.n_rows).withColumnRenamed("id", "row_id")
    return ids.where(hash_uniform("row_id", salt) < F.lit(float(rate))).count()


def _absent_rows(m: TallMatrix) -> int:
    return max(0, m.n_rows - m.stored_rows())


def _inv(a: np.ndarray) -> np.ndarray:
    """k x k inverse; pseudo-inverse when a is singular (rank-deficient data
    with ss = 0 gives a zero column in C)."""
    if np.linalg.cond(a) < 1e12:
        return np.linalg.inv(a)
    return np.linalg.pinv(a)


def residual_sqs(m: TallMatrix, fits: list[tuple[np.ndarray, np.ndarray]], mean: np.ndarray) -> list[float]:
    """sum over all N rows of ||a - (a W) C'||^2, a = y - mean, of several
    (W, C) in one pass, summed directly (no cancellation); sparse rows are
    densified in bounded chunks and absent rows added in closed form."""
    mu = np.asarray(mean, dtype=np.float64)

    def sums(a):
        residuals = (a - (a @ w) @ c.T for w, c in fits)
        return np.array([float(np.einsum("ij,ij->", e, e)) for e in residuals])

    def kernel(block: Block):
        return {"t": sum(sums(part.to_dense() - mu) for part in block.chunks())}

    out = partial_sums(m, kernel, {"t": (len(fits),)})["t"]
    if m.is_sparse:
        out = out + _absent_rows(m) * sums(-mu[None, :])
    return [float(x) for x in out]


def residual_sq(m: TallMatrix, w: np.ndarray, c: np.ndarray, mean: np.ndarray) -> float:
    """The residual sum of squares of one fit."""
    return residual_sqs(m, [(w, c)], mean)[0]


def _e_steps(prep: Prepared, ws: list[np.ndarray]) -> list[CrossStats]:
    """A6 of several loadings: one pass with all of them side by side (none
    on the R-factor route)."""
    if prep.summary:
        return [cross_stats_from_r(prep.r, w) for w in ws]
    st = cross_stats(prep.matrix, np.hstack(ws), prep.mean)
    cut = np.cumsum([0] + [w.shape[1] for w in ws])
    return [CrossStats(st.n, st.sum_x[a:b], st.xtx[a:b, a:b], st.ytx[:, a:b]) for a, b in zip(cut[:-1], cut[1:])]


def em_rounds(prep: Prepared, states: list[tuple[np.ndarray, float]], exact_ss: bool | None = None) -> list[dict]:
    """M3: one EM round of each (C, ss), one distributed pass in all (none on
    the R-factor route); returns new C, ss and the E-step pieces.  A second
    pass sums the residuals directly for ss where the measured cancellation is
    large (None), always (True) or never (False)."""
    n, d = prep.matrix.n_rows, prep.matrix.n_cols
    sxs = [_inv(c.T @ c + ss * np.eye(c.shape[1])) for c, ss in states]     # Sx = (C'C + ss I)^-1
    ws = [c @ sx.T for (c, _), sx in zip(states, sxs)]                      # Y2X
    steps, again = [], []
    for (_, ss), sx, w, st in zip(states, sxs, ws, _e_steps(prep, ws)):
        xtx = st.xtx + n * ss * sx                        # B1: keep N
        c_new = st.ytx @ _inv(xtx)
        ctc = c_new.T @ c_new
        ss2 = float(np.trace(xtx @ ctc))
        cross = float(np.sum(c_new * st.ytx))             # A7 fused: trace(C' Yc'Xc)
        noise = n * ss * float(np.trace(sx @ ctc))
        if prep.summary:
            # norm2 - 2 cross + tr(X'X C'C) = ||A (I - W C')||^2 = ||R (I - W C')||^2:
            # the same value without the cancellation of three large terms
            resid = prep.r - (prep.r @ w) @ c_new.T
            total = float(np.sum(resid * resid)) + noise
        else:
            total = prep.norm2 + ss2 - 2.0 * cross
            if exact_ss or (exact_ss is None and total <= CANCELLED * prep.norm2):
                again.append((len(steps), noise))
        steps.append({"c": c_new, "ss": total / (float(n) * float(d)),      # B4: float
                      "w": w, "xtx": xtx, "ytx": st.ytx, "cross": cross})
    if again:
        sums = residual_sqs(prep.matrix, [(steps[i]["w"], steps[i]["c"]) for i, _ in again], prep.mean)
        for (i, noise), total in zip(again, sums):
            steps[i]["ss"] = (total + noise) / (float(n) * float(d))
    return steps


def em_round(prep: Prepared, c: np.ndarray, ss: float, exact_ss: bool | None = None) -> dict:
    """M3 of one fit."""
    return em_rounds(prep, [(c, ss)], exact_ss)[0]


def cross_term(m: TallMatrix, w: np.ndarray, c: np.ndarray, mean: np.ndarray) -> float:
    """A7 as its own pass: sum over rows of x . (y C - ym C), x = y W - ym W."""
    mu = np.asarray(mean, dtype=np.float64)
    xm, cm = mu @ w, mu @ c

    def kernel(block: Block):
        x = block.matmul(w) - xm
        yc = block.matmul(c) - cm
        return {"t": np.array([float(np.einsum("ij,ij->", x, yc))])}

    s = partial_sums(m, kernel, {"t": (1,)})["t"][0]
    absent = _absent_rows(m) if m.is_sparse else 0
    return float(s + absent * float((-xm) @ (-cm)))


def initial_states(prep: Prepared, k: int, oversample: int, inits: list, seeds: list[int],
                   rcond: float) -> list[tuple[np.ndarray, float]]:
    """M1 + M2 (sketch), M7 (random) or M7b (given) per trial; the sketches of
    all trials are one pass."""
    d, n = prep.matrix.n_cols, prep.matrix.n_rows
    width = k + oversample
    sketches: dict[int, object] = {}
    if prep.sketch is not None and prep.sketch[0] == width:
        sketches[prep.sketch[1]] = prep.sketch[2]         # taken with the statistics pass
    missing = [s for s in dict.fromkeys(s for s, i in zip(seeds, inits) if isinstance(i, str) and i == "sketch") if s not in sketches]
    if prep.summary:
        sketches |= {s: sketch_svd(prep.matrix, width, prep.mean, s, rcond, method="summary", r_summary=prep.r) for s in missing}
    elif missing:
        sketches |= dict(zip(missing, sketch_svds(prep.matrix, [sketch_matrix(d, width, s) for s in missing], prep.mean, rcond)))
    out = []
    for init, seed in zip(inits, seeds):
        rng = np.random.default_rng(seed + 1)
        if isinstance(init, tuple):
            c0 = np.asarray(init[0], dtype=np.float64)
            if c0.shape != (d, k):
                raise ValueError(f"initial C must be {d} x {k}")
            out.append((c0.copy(), float(init[1])))
        elif init == "random":
            out.append((rng.random((d, k)), float(rng.random())))
        elif init == "sketch":
            sk = sketches[seed]
            latent = sk.s ** 2 / max(n - 1, 1)
            ss = float(latent[k:width].mean())
            c = sk.v[:, :k] * np.sqrt(np.clip(latent[:k] - ss, 0.0, None))
            rot, _, _ = np.linalg.svd(rng.random((k, k)))   # random orthogonal k x k
            out.append((c @ rot, ss))
        else:
            raise ValueError("init must be 'sketch', 'random' or a (C, ss) pair")
    return out


def initial_state(prep: Prepared, k: int, oversample: int, init, seed: int,
                  rcond: float) -> tuple[np.ndarray, float]:
    """M1 + M2, M7 or M7b of one fit."""
    return initial_states(prep, k, oversample, [init], [seed], rcond)[0]


@dataclass
class _Trial:
    """State of one fit of a group that runs in step."""
    c: np.ndarray
    ss: float
    stat: RunStat
    history: list = field(default_factory=list)
    prev_ss: float = float("inf")
    rel_change: float = float("inf")
    error: float = float("inf")

    def going(self, max_iter: int, tol: float, target_error: float) -> bool:
        return len(self.history) < max_iter and self.rel_change > tol and self.error > target_error

    def take(self, c: np.ndarray, ss: float, secs: float) -> None:
        self.c, self.ss = c, ss
        if not np.isfinite(self.prev_ss):
            self.rel_change = float("inf")
        elif self.prev_ss == 0.0:
            self.rel_change = 0.0 if ss == 0.0 else float("inf")     # exact fit (rank <= k)
        else:
            self.rel_change = abs(1.0 - ss / self.prev_ss)
        self.prev_ss = ss
        self.stat.iter_s.append(secs)


def fit_trials(prep: Prepared, k: int, seeds: list[int], inits: list, max_iter: int = DEFAULT_MAX_ITER,
               oversample: int = DEFAULT_OVERSAMPLE, error_metric: str = "spectral",
               tol: float = DEFAULT_TOL, target_error: float | None = None,
               rcond: float = DEFAULT_RCOND, sample_rate: float | None = None,
               dataset: str = "Untitled", exact_ss: bool | None = None, rotate: bool = False) -> list[PpcaModel]:
    """M4 / M9: the EM loops of several starts on prepared data, in step.  Each
    round is one Spark job for all trials that still run; a trial stops by its
    own rules.  A trial's seconds are its share of the joint passes."""
    m = prep.matrix
    d, n = m.n_cols, m.n_rows
    k, oversample = clamp_rank(k, d, oversample)
    if error_metric not in ("spectral", "l1_sampled", "none"):
        raise ValueError("error_metric must be 'spectral', 'l1_sampled' or 'none'")
    if target_error is None:
        target_error = DEFAULT_L1_TARGET_ERROR if error_metric == "l1_sampled" else DEFAULT_TARGET_ERROR
    sigma_next = None
    if error_metric == "spectral":
        sigma_next = prep.sigma_next if prep.sigma_next is not None else sigma_at(prep, k, rcond)
    rate = 1.0 if sample_rate is None else sample_rate      # all rows unless the caller asks for a sample

    t0 = time.time()
    states = initial_states(prep, k, oversample, inits, seeds, rcond)
    sketch_s = (time.time() - t0) / max(1, len(seeds))
    prep.power_blocks = {}
    trials = [_Trial(c, ss, RunStat(app="ppca_em", dataset=dataset, n_rows=n, n_cols=d, seed=seed,
                                    preprocess_s=prep.preprocess_s, sketch_s=sketch_s))
              for seed, (c, ss) in zip(seeds, states)]
    while going := {i: t for i, t in enumerate(trials) if t.going(max_iter, tol, target_error)}:
        t0 = time.time()
        steps = em_rounds(prep, [(t.c, t.ss) for t in going.values()], exact_ss)
        secs = (time.time() - t0) / len(going)
        for t, step in zip(going.values(), steps):
            t.take(step["c"], step["ss"], secs)
        errors: dict = dict.fromkeys(going)
        if error_metric == "spectral":
            errors = spectral_errors(prep, {i: t.c for i, t in going.items()}, sigma_next)
        elif error_metric == "l1_sampled":
            errors = dict(zip(going, l1_errors(m, prep.mean, [(s["w"], s["c"]) for s in steps], rate)))
        for i, t in going.items():
            if errors[i] is not None:
                t.stat.errors.append(errors[i])
                t.error = errors[i]
            t.history.append({"round": len(t.history) + 1, "ss": t.ss, "rel_change": t.rel_change,
                              "error": errors[i], "seconds": secs})
    models = []
    for t in trials:
        stat = t.stat
        stat.n_iter = len(t.history)
        stat.avg_iter_s = float(np.mean(stat.iter_s)) if stat.iter_s else 0.0
        stat.total_s = stat.preprocess_s + stat.sketch_s + float(np.sum(stat.iter_s))
        comps = canonical_signs(orthonormal_basis(t.c))
        explained = None
        if rotate:
            comps, explained = rotate_to_data(prep, comps)
        models.append(PpcaModel(loadings=t.c, components=comps, mean=prep.mean, ss=t.ss, n_rows=n,
                                history=t.history, stat=stat, explained_variance=explained))
    return models


def trials_at_once(d: int, k: int, oversample: int) -> int:
    """How many trials fit side by side into the driver bound."""
    return max(1, MAX_DRIVER_DOUBLES // (d * (k + oversample) * 2))


def fit_prepared(prep: Prepared, k: int, max_iter: int = DEFAULT_MAX_ITER,
                 oversample: int = DEFAULT_OVERSAMPLE, init="sketch", error_metric: str = "spectral",
                 seed: int = 0, tol: float = DEFAULT_TOL, target_error: float | None = None,
                 rcond: float = DEFAULT_RCOND, sample_rate: float | None = None,
                 dataset: str = "Untitled", exact_ss: bool | None = None, rotate: bool = False) -> PpcaModel:
    """M4: the EM loop of one start on prepared data; each round is one Spark job."""
    return fit_trials(prep, k, [seed], [init], max_iter, oversample, error_metric, tol, target_error, rcond,
                      sample_rate, dataset, exact_ss, rotate)[0]


def ppca_fit(m: TallMatrix, k: int, max_iter: int = DEFAULT_MAX_ITER,
             oversample: int = DEFAULT_OVERSAMPLE, init="sketch", error_metric: str = "spectral",
             seed: int = 0, tol: float = DEFAULT_TOL, target_error: float | None = None,
             rcond: float = DEFAULT_RCOND, sample_rate: float | None = None,
             dataset: str = "Untitled", cut_lineage: bool | None = None,
             strategy: str = "auto", partitions: int | None = None,
             exact_ss: bool | None = None, save_sketch_to: str | None = None,
             rotate_to_data: bool = False) -> PpcaModel:
    """Fit probabilistic PCA with k components to the rows of ``m``.

    ``strategy='summary'`` works on the R factor (two passes in all),
    ``'passes'`` reads the pinned rows once per round, ``'auto'`` picks
    (see ``use_summary``).  ``exact_ss`` (passes route): whether a second pass
    per round sums the residual directly; by default it does where the
    one-pass noise variance would lose digits (data with large norms).
    ``rotate_to_data`` orders the components by the variance of their
    scores (B21) and fills ``explained_variance``."""
    k, s = clamp_rank(k, m.n_cols, oversample)
    if save_sketch_to and init == "sketch":
        save_sketch_matrix(m.spark, save_sketch_to, m.n_cols, k + s, seed)
    prep = prepare(m, need_spectrum=(error_metric == "spectral"), k=k, rcond=rcond,
                   cut_lineage=cut_lineage, strategy=strategy, partitions=partitions,
                   sketch=(k + s, seed) if init == "sketch" else None)
    try:
        return fit_prepared(prep, k, max_iter, oversample, init, error_metric, seed, tol,
                            target_error, rcond, sample_rate, dataset, exact_ss, rotate_to_data)
    finally:
        prep.close()


def rotate_to_data(prep: Prepared, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rotate an orthonormal basis P of span(C) by the eigenvectors of
    the k x k score covariance P'A'AP / (N - 1), so the components are
    uncorrelated and ordered by the variance they explain (the basis from C
    alone is ordered by the singular values of C).  From R when held, else
    one pass."""
    if prep.r is not None:
        rp = prep.r @ p
        s = rp.T @ rp
    else:
        s = cross_stats(prep.matrix, p, prep.mean).xtx
    w, u = np.linalg.eigh((s + s.T) / 2)
    order = np.argsort(w)[::-1]
    var = np.clip(w[order], 0.0, None) / max(prep.matrix.n_rows - 1, 1)
    return canonical_signs(p @ u[:, order]), var


def save_sketch_matrix(spark: SparkSession, path: str, d: int, width: int, seed: int,
                       fmt: str = "DENSE") -> None:
    """K6: write the random sketch matrix of a fit (d x width) for
    reproduction, in a matrix text format."""
    from ..sources.text import write_matrix
    omega = sketch_matrix(d, width, seed)
    df = spark.createDataFrame([(j, [float(x) for x in omega[j]]) for j in range(d)],
                               "row_id long, features array<double>")
    write_matrix(TallMatrix(df, n_cols=width, n_rows=d), path, fmt)


def exact_pca(m: TallMatrix, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """L3: exact top-k components from the centred R factor, one pass
    (d <= MAX_GRAM_COLS): returns (mean, singular values, components with
    canonical signs)."""
    _, mean, _, r = centred_summary(m)
    _, s, vt = np.linalg.svd(r)
    return mean, s[:k], canonical_signs(vt[:k].T)

