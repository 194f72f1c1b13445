"""Registered plans: one per operator, each over the given tables.

Every function takes ``(spark, sf_dir)`` and returns a DataFrame whose
column names match the SQL twin in ``oracle.py``.  Doubles are rounded
(then ``+ 0.0`` so a negative zero prints as zero) to compare across
engines that add in a different order.
"""

from __future__ import annotations

import uuid
import warnings
from dataclasses import replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import coo_line, dense_line, parse_dense
from ..functions.rounding import round_sig
from ..matrix import TallMatrix
from ..operators import linalg, ppca, rows, stats
from ..sources import datasets
from ..sources.tables import keep_entries, load_table, matrix_from_entries, matrix_from_mllib, matrix_from_parquet
from ..sources.text import convert_to_parquet, matrix_lines, parse_coo_lines, read_coo_text, read_dense_text, write_matrix
from ..session import ensure_checkpoint_dir, materialize, release
from . import fixed

SAMPLE_RATE = 0.3


def rnd(col: str | Column, digits: int = 8) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c, digits) + F.lit(0.0)


def sig(col: str | Column, digits: int = 10) -> Column:
    return round_sig(col, digits) + F.lit(0.0)


def _long(df: DataFrame, value: str, digits: int = 8, index: str = "j", col: str = "values") -> DataFrame:
    return (rows.explode_values(df, col, index, "value")
            .select("row_id", index, rnd("value", digits).alias(value)))


def _mean(m: TallMatrix) -> np.ndarray:
    return stats.mean_and_norm(m)[0]


# -- A1, A2 -----------------------------------------------------------------

def col_mean_dense(spark: SparkSession, sf: str) -> DataFrame:
    m = datasets.embeddings_matrix(spark, sf)
    return stats.column_means(m).select("j", rnd("mean", 10).alias("mean"))


def col_mean_sparse(spark: SparkSession, sf: str) -> DataFrame:
    m = datasets.customer_part_matrix(spark, sf)
    return stats.column_means(m).select("j", rnd("mean", 10).alias("mean"))


def frob2_dense(spark: SparkSession, sf: str) -> DataFrame:
    return stats.frobenius_sq(datasets.embeddings_matrix(spark, sf)).select(rnd("norm2", 8).alias("norm2"))


def frob2_sparse(spark: SparkSession, sf: str) -> DataFrame:
    return stats.frobenius_sq(datasets.customer_part_matrix(spark, sf)).select(sig("norm2").alias("norm2"))


# -- P1, P4 -----------------------------------------------------------------

def center_rows(spark: SparkSession, sf: str) -> DataFrame:
    m = datasets.embeddings_matrix(spark, sf)
    c = rows.center_rows(m, _mean(m))
    return (c.df.select("row_id", F.posexplode("features").alias("j", "v"))
            .select("row_id", F.col("j").cast("int").alias("j"), rnd("v").alias("value")))


def nonzero_filter(spark: SparkSession, sf: str) -> DataFrame:
    m = datasets.lineitem_matrix(spark, sf)
    kept = keep_entries(m.entries(), m.n_cols)
    return (kept.groupBy("j").agg(F.count(F.lit(1)).alias("nnz"), sig(F.sum("v")).alias("total")))


# -- S2, K3 -----------------------------------------------------------------

def coo_build(spark: SparkSession, sf: str) -> DataFrame:
    return datasets.customer_part_entries(spark, sf).select("i", "j", rnd("v", 6).alias("v"))


def coo_to_rows(spark: SparkSession, sf: str) -> DataFrame:
    m = datasets.customer_part_matrix(spark, sf)
    return m.df.select(F.col("row_id").alias("i"), F.size("indices").alias("nnz"),
                       F.col("indices")[0].alias("min_j"), F.element_at("indices", -1).alias("max_j"),
                       rnd(F.aggregate("values", F.lit(0.0), lambda s, x: s + x), 6).alias("row_sum"))


def rows_to_coo(spark: SparkSession, sf: str) -> DataFrame:
    m = datasets.customer_part_matrix(spark, sf)
    return m.entries().select(coo_line("i", "j", "v").alias("line"))


def coo_text_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    lines = rows_to_coo(spark, sf).select(F.col("line").alias("value"))
    return parse_coo_lines(lines).select("i", "j", rnd("v", 6).alias("v"))


def lil_text(spark: SparkSession, sf: str) -> DataFrame:
    m = datasets.customer_part_matrix(spark, sf)
    return matrix_lines(m, "LIL").select(F.col("row_id").alias("i"), F.col("value").alias("line"))


def dense_text(spark: SparkSession, sf: str) -> DataFrame:
    m = datasets.lineitem_matrix(spark, sf)
    return m.df.select(dense_line("features").alias("line"))


def dense_text_parse(spark: SparkSession, sf: str) -> DataFrame:
    lines = dense_text(spark, sf)
    back = lines.select(F.posexplode(parse_dense("line")).alias("j", "v"))
    return back.groupBy(F.col("j").cast("int").alias("j")).agg(sig(F.sum("v")).alias("total"))


# -- P5, P7, P9 ---------------------------------------------------------------

def project_fixed(spark: SparkSession, sf: str) -> DataFrame:
    m = datasets.embeddings_matrix(spark, sf)
    w = fixed.fixed_matrix("w", m.n_cols)
    return _long(rows.project(m, w), "x", index="p")


def back_project(spark: SparkSession, sf: str) -> DataFrame:
    m = datasets.embeddings_matrix(spark, sf)
    w = fixed.fixed_matrix("w", m.n_cols)
    c = fixed.fixed_matrix("c", m.n_cols)
    x = rows.as_matrix(rows.project(m, w), w.shape[1], m.n_rows)
    return _long(rows.back_project(x, c), "value")


def residual_rows(spark: SparkSession, sf: str) -> DataFrame:
    m = datasets.embeddings_matrix(spark, sf)
    w = fixed.fixed_matrix("w", m.n_cols)
    c = fixed.fixed_matrix("c", m.n_cols)
    return _long(rows.residual_rows(m, w, c, _mean(m)), "value")


def reconstruct_fixed(spark: SparkSession, sf: str) -> DataFrame:
    m = datasets.embeddings_matrix(spark, sf)
    w = fixed.fixed_matrix("w", m.n_cols)
    return _long(rows.reconstruct(m, w, _mean(m)), "value")


def project_relational(spark: SparkSession, sf: str) -> DataFrame:
    m = datasets.embeddings_matrix(spark, sf)
    w = fixed.fixed_matrix("w", m.n_cols)
    return rows.project_entries(m, w).select("row_id", "p", rnd("x").alias("x"))


def center_entries_sparse(spark: SparkSession, sf: str) -> DataFrame:
    m = datasets.customer_part_matrix(spark, sf)
    return rows.center_entries(m, _mean(m)).select("i", "j", rnd("v").alias("value"))


# -- A6, A7, A8, A4, A9, M8 ---------------------------------------------------

def _stats_long(name: str, mat: np.ndarray, spark: SparkSession) -> DataFrame:
    data = [(name, int(r), int(c), float(mat[r, c])) for r in range(mat.shape[0]) for c in range(mat.shape[1])]
    return spark.createDataFrame(data, "stat string, r int, c int, value double")


def em_stats_fixed(spark: SparkSession, sf: str) -> DataFrame:
    m = datasets.embeddings_matrix(spark, sf)
    w = fixed.fixed_matrix("w", m.n_cols)
    st = linalg.cross_stats(m, w, _mean(m))
    out = _stats_long("xtx", st.xtx, spark).unionByName(_stats_long("ytx", st.ytx, spark))
    return out.select("stat", "r", "c", rnd("value").alias("value"))


def cross_term_fixed(spark: SparkSession, sf: str) -> DataFrame:
    m = datasets.embeddings_matrix(spark, sf)
    w = fixed.fixed_matrix("w", m.n_cols)
    c = fixed.fixed_matrix("c", m.n_cols)
    t = ppca.cross_term(m, w, c, _mean(m))
    return spark.createDataFrame([(t,)], "cross_term double").select(sig("cross_term").alias("cross_term"))


def qta_fixed(spark: SparkSession, sf: str) -> DataFrame:
    m = datasets.embeddings_matrix(spark, sf)
    om = fixed.fixed_matrix("omega", m.n_cols)
    st = linalg.cross_stats(m, om, _mean(m))
    bta = st.ytx.T
    data = [(int(p), int(j), float(bta[p, j])) for p in range(bta.shape[0]) for j in range(bta.shape[1])]
    return spark.createDataFrame(data, "p int, j int, value double").select("p", "j", rnd("value").alias("value"))


def col_abs_norm(spark: SparkSession, sf: str) -> DataFrame:
    m = datasets.embeddings_matrix(spark, sf)
    return stats.column_abs_sums(m, _mean(m)).select(F.col("j").cast("int").alias("j"),
                                                     rnd("abs_sum").alias("abs_sum"))


def col_abs_max(spark: SparkSession, sf: str) -> DataFrame:
    m = datasets.embeddings_matrix(spark, sf)
    return stats.column_abs_norm(m, _mean(m)).select(rnd("abs_norm").alias("abs_norm"))


def l1_error_fixed(spark: SparkSession, sf: str) -> DataFrame:
    m = datasets.embeddings_matrix(spark, sf)
    w = fixed.fixed_matrix("w", m.n_cols)
    c = fixed.fixed_matrix("c", m.n_cols)
    e = ppca.l1_error(m, _mean(m), w, c, rate=1.0)
    return spark.createDataFrame([(e,)], "l1_error double").select(rnd("l1_error", 10).alias("l1_error"))


# -- P2 -----------------------------------------------------------------------

def row_sample(spark: SparkSession, sf: str) -> DataFrame:
    m = datasets.embeddings_matrix(spark, sf)
    s = rows.row_sample(m, SAMPLE_RATE)
    return s.df.select("row_id", rnd(F.aggregate("features", F.lit(0.0), lambda a, x: a + x)).alias("row_sum"))


# -- L3 -----------------------------------------------------------------------

def gram_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    m = datasets.embeddings_matrix(spark, sf)
    return linalg.gram_df(m, _mean(m)).select("r", "c", rnd("g").alias("g"))


def gram_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    # 9 digits: the columns hold 2-decimal values, so exact Gram entries are
    # short decimals that can sit on a rounding tie at 10 digits
    m = datasets.lineitem_matrix(spark, sf)
    return linalg.gram_df(m, _mean(m)).select("r", "c", sig("g", 9).alias("g"))


def pca_top1(spark: SparkSession, sf: str) -> DataFrame:
    m = datasets.lineitem_matrix(spark, sf)
    _, s, u = ppca.exact_pca(m, 1)
    data = [(j, float(u[j, 0]), float(s[0])) for j in range(m.n_cols)]
    return spark.createDataFrame(data, "j int, pc double, sigma1 double").select(
        "j", rnd("pc").alias("pc"), sig("sigma1", 9).alias("sigma1"))


# -- M3 -----------------------------------------------------------------------

def em_k1_3rounds(spark: SparkSession, sf: str) -> DataFrame:
    m = datasets.embeddings_matrix(spark, sf)
    prep = ppca.prepare(m, need_spectrum=False)
    c, ss = fixed.first_column_init(m.n_cols), 1.0
    out = []
    for r in range(3):
        step = ppca.em_round(prep, c, ss)
        c, ss = step["c"], step["ss"]
        out.append((r + 1, float(ss), float(np.linalg.norm(c))))
    release(prep.matrix.df)
    return spark.createDataFrame(out, "round int, ss double, c_norm double").select(
        "round", rnd("ss", 10).alias("ss"), rnd("c_norm", 10).alias("c_norm"))


def em_k2_3rounds(spark: SparkSession, sf: str) -> DataFrame:
    m = datasets.embeddings_matrix(spark, sf)
    prep = ppca.prepare(m, need_spectrum=False)
    c, ss = fixed.two_column_init(m.n_cols), 1.0
    out = []
    for r in range(3):
        step = ppca.em_round(prep, c, ss)
        c, ss = step["c"], step["ss"]
        out.append((r + 1, float(ss), float(np.linalg.norm(c))))
    release(prep.matrix.df)
    return spark.createDataFrame(out, "round int, ss double, c_norm double").select(
        "round", rnd("ss", 10).alias("ss"), rnd("c_norm", 10).alias("c_norm"))


# -- A10, A11 -----------------------------------------------------------------

def trial_summary(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.trials import summarize_runs
    ev = load_table(spark, sf, "events")
    runs = ev.select(F.col("user_id").alias("experiment"), F.col("value").alias("total_s"))
    # var_s at 4 decimals: values have 2 decimals, so exact sample variances
    # are short decimals, and at sf0.1 eight of them sit on an 8-decimal tie
    return summarize_runs(runs, "experiment").select(
        F.col("experiment").alias("user_id"), "n_runs",
        rnd("avg_s").alias("avg_s"), rnd("var_s", 4).alias("var_s"))


# -- L7, M3-M6, M9, P10: fits from fixed starts --------------------------------

FIT_ROUNDS = 3
SKETCH_WIDTH = 2
TRIALS = 2


def _fixed_fit(m: TallMatrix, k: int, rounds: int = FIT_ROUNDS, **options) -> ppca.PpcaModel:
    """A fit of exactly ``rounds`` rounds from the fixed start."""
    start = fixed.first_column_init(m.n_cols) if k == 1 else fixed.two_column_init(m.n_cols)
    return ppca.ppca_fit(m, k, max_iter=rounds, init=(start, 1.0), tol=-1.0, target_error=-2.0, **options)


def sketch_svd(spark: SparkSession, sf: str) -> DataFrame:
    m = datasets.embeddings_matrix(spark, sf)
    omega = fixed.fixed_matrix("omega", m.n_cols)[:, :SKETCH_WIDTH]
    sk = linalg.sketch_svd(m, SKETCH_WIDTH, _mean(m), seed=0, omega=omega)
    return spark.createDataFrame([(p, float(s)) for p, s in enumerate(sk.s)], "p int, s double").select("p", rnd("s").alias("s"))


def ppca_fit(spark: SparkSession, sf: str) -> DataFrame:
    """The projector P P' on the fitted components, which no rotation changes."""
    m = datasets.embeddings_matrix(spark, sf)
    p = _fixed_fit(m, 2, error_metric="none").components
    return _stats_long("projector", p @ p.T, spark).select("r", "c", rnd("value").alias("value"))


def ppca_project(spark: SparkSession, sf: str) -> DataFrame:
    m = datasets.embeddings_matrix(spark, sf)
    model = _fixed_fit(m, 2, error_metric="none")
    return _long(model.transform(m), "value", index="p")


def spectral_error(spark: SparkSession, sf: str) -> DataFrame:
    history = _fixed_fit(datasets.lineitem_matrix(spark, sf), 1, rounds=2).history_df(spark)
    return history.select("round", sig("ss", 8).alias("ss"), rnd("error", 6).alias("error"))


def sparse_ppca_fit(spark: SparkSession, sf: str) -> DataFrame:
    model = _fixed_fit(datasets.customer_part_matrix(spark, sf), 1, error_metric="none")
    return model.components_df(spark).select("j", rnd("w").alias("w"))


def ppca_trials(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.trials import run_trials
    m = datasets.embeddings_matrix(spark, sf)
    models, runs, _ = run_trials(m, 1, trials=TRIALS, seeds=list(range(TRIALS)), dataset="embeddings", max_iter=FIT_ROUNDS,
                                 inits=[(fixed.first_column_init(m.n_cols, t), 1.0) for t in range(TRIALS)],
                                 tol=-1.0, error_metric="none")
    ss = spark.createDataFrame([(model.stat.seed, float(model.ss)) for model in models], "seed long, ss double")
    return (runs.select("dataset", F.col("n_rows").cast("long").alias("n_rows"), F.col("n_cols").cast("long").alias("n_cols"),
                        F.col("seed").cast("long").alias("seed"), F.col("n_iter").cast("long").alias("n_iter"))
            .join(ss, "seed").select("dataset", "n_rows", "n_cols", "seed", "n_iter", rnd("ss", 10).alias("ss")))


# -- wide and segmented sparse matrices ----------------------------------------

SEGMENT = 32


def _segmented(spark: SparkSession, sf: str) -> TallMatrix:
    n, d = datasets.customer_part_shape(spark, sf)
    return matrix_from_entries(datasets.customer_part_entries(spark, sf), n, d, "unique", segment_entries=SEGMENT)


def segmented_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of more than SEGMENT entries in segments by column range (segment -1: whole)."""
    m = _segmented(spark, sf)
    rows_ = m.df.select("row_id", F.lit(-1).alias("segment"), "indices", "values")
    rows_ = rows_ if m.wide is None else rows_.unionByName(m.wide)
    return rows_.select(F.col("row_id").alias("i"), F.col("segment").cast("int").alias("segment"), F.size("indices").alias("nnz"),
                        F.col("indices")[0].alias("min_j"), F.element_at("indices", -1).alias("max_j"),
                        rnd(F.aggregate("values", F.lit(0.0), lambda s, x: s + x), 6).alias("row_sum"))


def segmented_fit(spark: SparkSession, sf: str) -> DataFrame:
    """M3 on segmented rows: the fit of ``sparse_ppca_fit`` without a whole hot row."""
    model = _fixed_fit(_segmented(spark, sf), 1, error_metric="none", strategy="passes")
    return model.components_df(spark).select("j", rnd("w").alias("w"))


def wide_spectrum(spark: SparkSession, sf: str) -> DataFrame:
    """L3 / L5 by Lanczos, both in the same passes: sigma_1 and the norm of the
    rows without their part along (1, -1, 1, ...)."""
    m = datasets.customer_part_matrix(spark, sf)
    mean = _mean(m)
    m = replace(m, df=materialize(m.df), wide=None if m.wide is None else materialize(m.wide), cells=None)
    p = (1.0 - 2.0 * (np.arange(m.n_cols) % 2))[:, None] / np.sqrt(m.n_cols)
    top, rest = linalg.lanczos_runs(m, mean, [linalg.lanczos(m.n_cols, 1, tol=1e-9), linalg.lanczos(m.n_cols, 1, p, tol=1e-9)])
    for df in (m.df, m.wide, m.packed):
        if df is not None:
            release(df)
    data = [(float(np.sqrt(top.values[0])), float(np.sqrt(rest.values[0])))]
    return spark.createDataFrame(data, "sigma1 double, residual double").select(sig("sigma1", 8).alias("sigma1"), sig("residual", 8).alias("residual"))


def em_until_converged(spark: SparkSession, sf: str) -> DataFrame:
    """M4: rounds until the noise variance changes by at most 1e-5."""
    m = datasets.embeddings_matrix(spark, sf)
    model = ppca.ppca_fit(m, 1, max_iter=300, init=(fixed.first_column_init(m.n_cols), 1.0), error_metric="none")
    last = model.history[-1]
    return spark.createDataFrame([(last["round"], float(last["ss"]), float(last["rel_change"]) <= 1e-5)],
                                 "rounds int, ss double, converged boolean").select("rounds", rnd("ss", 10).alias("ss"), "converged")


# -- S1-S4, K1-K5: files -------------------------------------------------------

def _folder(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/plans/{name}-{uuid.uuid4().hex}"


def _row_sums(m: TallMatrix, digits: int = 8) -> DataFrame:
    return m.df.select("row_id", F.size("features").alias("width"),
                       rnd(F.aggregate("features", F.lit(0.0), lambda s, x: s + x), digits).alias("row_sum"))


def dense_file_read(spark: SparkSession, sf: str) -> DataFrame:
    """K3a then S1: embeddings written as DENSE text in row order and read back."""
    path = _folder(spark, "dense")
    write_matrix(datasets.embeddings_matrix(spark, sf), path)
    return _row_sums(read_dense_text(spark, path, 64))


def dense_file_convert(spark: SparkSession, sf: str) -> DataFrame:
    """K1 then S3: DENSE text converted to Parquet rows and read as a matrix."""
    path = _folder(spark, "dense")
    write_matrix(datasets.embeddings_matrix(spark, sf), path)
    convert_to_parquet(spark, path, path + "-rows")
    return _row_sums(matrix_from_parquet(spark, path + "-rows"))


def coo_file_read(spark: SparkSession, sf: str) -> DataFrame:
    """K3c then S2: cells written one-based as COO text, read back as rows."""
    path = _folder(spark, "coo")
    e = datasets.customer_part_matrix(spark, sf).entries().select(F.col("i") + 1, F.col("j") + 1, "v").toDF("i", "j", "v")
    e.select(coo_line("i", "j", "v")).write.text(path)
    return read_coo_text(spark, path, base=1).entries().select("i", "j", rnd("v", 6).alias("v"))


def coo_file_convert(spark: SparkSession, sf: str) -> DataFrame:
    """K2 then S3: COO text converted to Parquet rows and read as a matrix."""
    path = _folder(spark, "coo")
    write_matrix(datasets.customer_part_matrix(spark, sf), path, "COO")
    convert_to_parquet(spark, path, path + "-rows", "COO")
    return matrix_from_parquet(spark, path + "-rows").entries().select("i", "j", rnd("v", 6).alias("v"))


def rejected_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that are no rows or entries, kept with their reason.  Every
    lineitem is a DENSE line of four values, returned ones with a flag
    instead of the last, open ones without it; and a COO line likewise."""
    li = load_table(spark, sf, "lineitem")
    last = F.when(F.col("l_returnflag") == "R", "R").when(F.col("l_linestatus") != "O", F.col("l_tax").cast("string"))
    out = []
    for name, sep, cols in (("dense", " ", datasets.LINEITEM_COLS[:3]), ("coo", ",", ["l_orderkey", "l_linenumber"])):
        path = _folder(spark, "rejects-" + name)
        li.select(F.concat_ws(sep, *cols, last).alias("value")).write.text(path)
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            if name == "dense":
                read_dense_text(spark, path, 4, bad_rows="drop", rejects_to=path + "-bad")
            else:
                read_coo_text(spark, path, n_rows=1, n_cols=1, duplicates="sum", bad_lines="drop", rejects_to=path + "-bad")
        out.append(spark.read.parquet(path + "-bad").groupBy("reason").agg(F.count("*").alias("n_lines"))
                   .select(F.lit(name).alias("format"), "reason", "n_lines"))
    return out[0].unionByName(out[1])


def saved_projection(spark: SparkSession, sf: str) -> DataFrame:
    """P10 then K4: the projection of ``ppca_project`` saved and read back."""
    m = datasets.embeddings_matrix(spark, sf)
    path = _folder(spark, "projection")
    _fixed_fit(m, 2, error_metric="none").write_projection(m, path)
    return _long(matrix_from_parquet(spark, path, 2).df, "value", index="p", col="features")


def run_log(spark: SparkSession, sf: str) -> DataFrame:
    """K5 then A11: one run a user, whose rounds took the values of its events; the
    log is written twice under one id, as a retry does, and read back."""
    from ..operators.trials import append_run_log, mean_iteration_seconds, read_run_log
    ev = load_table(spark, sf, "events").groupBy("user_id").agg(F.collect_list("value").alias("iter_s"))
    runs = ev.select(F.lit("ppca_em").alias("app"), F.lit("events").alias("dataset"), F.lit(1).cast("long").alias("n_rows"),
                     F.lit(1).alias("n_cols"), F.col("user_id").alias("seed"), F.size("iter_s").alias("n_iter"), F.lit(0.0).alias("total_s"),
                     F.lit(0.0).alias("preprocess_s"), F.lit(0.0).alias("sketch_s"), F.lit(0.0).alias("avg_iter_s"), "iter_s",
                     F.array().cast("array<double>").alias("errors"))
    path = _folder(spark, "run-log")
    for _ in range(2):
        append_run_log(runs, path, "one")
    back = mean_iteration_seconds(read_run_log(spark, path))
    return back.select(F.col("seed").alias("user_id"), F.col("n_iter").cast("long").alias("n_iter"), rnd("avg_iter_s", 6).alias("avg_iter_s"))


def mllib_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows handed over as an ``IndexedRowMatrix``."""
    from pyspark.mllib.linalg.distributed import IndexedRow, IndexedRowMatrix
    df = load_table(spark, sf, "embeddings").select("vec_id", "embedding")
    rdd = df.rdd.map(lambda r: IndexedRow(r["vec_id"], [float(x) for x in r["embedding"]]))
    return _row_sums(matrix_from_mllib(spark, IndexedRowMatrix(rdd)))


def spread_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows pinned after an explicit repartition; the partitions and what they hold."""
    m = datasets.embeddings_matrix(spark, sf)
    pinned = materialize(m.df, cut_lineage=True, partitions=3)
    out = pinned.agg(F.count("*").alias("n_rows"), rnd(F.sum(F.aggregate("features", F.lit(0.0), lambda s, x: s + x)), 6).alias("total"),
                     F.count_distinct(F.col("_metadata.file_path")).alias("partitions"))
    return out


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Sketch-initialised probabilistic PCA (k = 3): the components table."""
    return ppca.ppca_fit(datasets.embeddings_matrix(spark, sf), 3, seed=7, dataset="embeddings").components_df(spark)


QUERIES = {
    "col_mean_dense": col_mean_dense,
    "col_mean_sparse": col_mean_sparse,
    "frob2_dense": frob2_dense,
    "frob2_sparse": frob2_sparse,
    "center_rows": center_rows,
    "nonzero_filter": nonzero_filter,
    "coo_build": coo_build,
    "coo_to_rows": coo_to_rows,
    "rows_to_coo": rows_to_coo,
    "coo_text_roundtrip": coo_text_roundtrip,
    "lil_text": lil_text,
    "dense_text": dense_text,
    "dense_text_parse": dense_text_parse,
    "project_fixed": project_fixed,
    "back_project": back_project,
    "residual_rows": residual_rows,
    "reconstruct_fixed": reconstruct_fixed,
    "project_relational": project_relational,
    "center_entries_sparse": center_entries_sparse,
    "col_abs_max": col_abs_max,
    "em_stats_fixed": em_stats_fixed,
    "cross_term_fixed": cross_term_fixed,
    "qta_fixed": qta_fixed,
    "col_abs_norm": col_abs_norm,
    "l1_error_fixed": l1_error_fixed,
    "row_sample": row_sample,
    "gram_embeddings": gram_embeddings,
    "gram_lineitem": gram_lineitem,
    "pca_top1": pca_top1,
    "em_k1_3rounds": em_k1_3rounds,
    "em_k2_3rounds": em_k2_3rounds,
    "trial_summary": trial_summary,
    "sketch_svd": sketch_svd,
    "ppca_fit": ppca_fit,
    "ppca_project": ppca_project,
    "spectral_error": spectral_error,
    "sparse_ppca_fit": sparse_ppca_fit,
    "ppca_trials": ppca_trials,
    "segmented_rows": segmented_rows,
    "segmented_fit": segmented_fit,
    "wide_spectrum": wide_spectrum,
    "em_until_converged": em_until_converged,
    "dense_file_read": dense_file_read,
    "dense_file_convert": dense_file_convert,
    "coo_file_read": coo_file_read,
    "coo_file_convert": coo_file_convert,
    "rejected_lines": rejected_lines,
    "saved_projection": saved_projection,
    "run_log": run_log,
    "mllib_rows": mllib_rows,
    "spread_rows": spread_rows,
}
