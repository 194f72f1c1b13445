"""Repeated fits and their run log."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..matrix import TallMatrix
from .ppca import DEFAULT_OVERSAMPLE, RunStat, clamp_rank, fit_trials, prepare, trials_at_once

RUN_LOG_SCHEMA = ("app string, dataset string, n_rows long, n_cols int, seed long, n_iter int, "
                  "total_s double, preprocess_s double, sketch_s double, avg_iter_s double, "
                  "iter_s array<double>, errors array<double>")


def runs_frame(spark: SparkSession, stats: list[RunStat]) -> DataFrame:
    """One row per run (the fields of the original run record plus seed)."""
    rows = [(s.app, s.dataset, int(s.n_rows), int(s.n_cols), int(s.seed), int(s.n_iter),
             float(s.total_s), float(s.preprocess_s), float(s.sketch_s), float(s.avg_iter_s),
             [float(x) for x in s.iter_s], [float(x) for x in s.errors]) for s in stats]
    return spark.createDataFrame(rows, RUN_LOG_SCHEMA)


def summarize_runs(runs: DataFrame, *keys: str) -> DataFrame:
    """A10: per key, run count, mean and sample variance (divisor n - 1) of
    run time, and of rounds when the log has them.  One run gives a NULL
    variance."""
    aggs = [F.count(F.lit(1)).alias("n_runs"), F.avg("total_s").alias("avg_s"),
            F.var_samp("total_s").alias("var_s")]
    if "n_iter" in runs.columns:
        aggs += [F.avg("n_iter").alias("avg_iter"), F.var_samp("n_iter").alias("var_iter")]
    return runs.groupBy(*keys).agg(*aggs)


def mean_iteration_seconds(runs: DataFrame) -> DataFrame:
    """Mean seconds per round of each run."""
    return runs.withColumn(
        "avg_iter_s",
        F.when(F.size("iter_s") > 0,
               F.aggregate("iter_s", F.lit(0.0), lambda a, x: a + x) / F.size("iter_s")).otherwise(F.lit(0.0)))


def run_trials(m: TallMatrix, k: int, trials: int = 1, seeds: list[int] | None = None,
               dataset: str = "Untitled", run_log: str | None = None, inits: list | None = None, **fit_options):
    """M9: fit ``trials`` times on the same pinned rows (preprocessing and
    sigma_{k+1} once), log every run, and return (models, runs, summary).
    The trials run in step, so the passes over the rows do not grow with their
    number (in groups, where their loadings together pass the driver bound).
    ``inits`` gives the start of each trial, in place of one ``init``."""
    spark = m.spark
    seeds = list(seeds) if seeds is not None else list(range(trials))
    if len(seeds) != trials:
        raise ValueError("one seed per trial")
    inits = [fit_options.pop("init", "sketch")] * trials if inits is None else list(inits)
    if len(inits) != trials:
        raise ValueError("one start per trial")
    error_metric = fit_options.get("error_metric", "spectral")
    strategy = fit_options.pop("strategy", "auto")
    partitions = fit_options.pop("partitions", None)
    prep = prepare(m, need_spectrum=(error_metric == "spectral"), k=k, strategy=strategy,
                   partitions=partitions)
    models = []
    try:
        step = trials_at_once(m.n_cols, *clamp_rank(k, m.n_cols, fit_options.get("oversample", DEFAULT_OVERSAMPLE)))
        for at in range(0, trials, step):
            models += fit_trials(prep, k, seeds[at:at + step], inits[at:at + step], dataset=dataset, **fit_options)
    finally:
        prep.close()
    runs = runs_frame(spark, [mdl.stat for mdl in models])
    if run_log:
        append_run_log(runs, run_log)
    summary = summarize_runs(runs, "app", "dataset")
    return models, runs, summary


def append_run_log(runs: DataFrame, path: str, run_id: str | None = None) -> str:
    """K5: append run records to a JSON-lines log (created when missing).  The
    records of one ``run_id`` (new unless given) are a folder of their own that a
    second attempt replaces, so a rerun doubles nothing.  Returns the id."""
    run_id = run_id or uuid.uuid4().hex
    runs.coalesce(1).write.mode("overwrite").json(f"{path.rstrip('/')}/run_id={run_id}")
    return run_id


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    """The records of a run log with their ``run_id``."""
    return spark.read.schema(RUN_LOG_SCHEMA + ", run_id string").json(path)
