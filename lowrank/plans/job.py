"""

Read a matrix folder, fit with seeded trials on the same pinned rows, then
write the components in the chosen text format, append the run records to
the run log, and optionally save the projected rows once after the last
trial (one output path per call, B10).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from ..matrix import TallMatrix
from ..operators.ppca import PpcaModel
from ..operators.trials import append_run_log, run_trials
from ..sources.tables import matrix_from_parquet
from ..sources.text import read_coo_text, read_dense_text


def load_matrix(spark: SparkSession, path: str, fmt: str = "PARQUET", n_rows: int | None = None,
                n_cols: int | None = None, base: int = 0, duplicates: str = "error",
                bad_rows: str = "error") -> TallMatrix:
    fmt = fmt.upper()
    if fmt == "PARQUET":
        return matrix_from_parquet(spark, path, n_cols=n_cols, n_rows=n_rows)
    if fmt == "DENSE":
        return read_dense_text(spark, path, n_cols=n_cols, bad_rows=bad_rows)
    if fmt == "COO":
        return read_coo_text(spark, path, base=base, n_rows=n_rows, n_cols=n_cols, duplicates=duplicates)
    raise ValueError("input format must be PARQUET, DENSE or COO")


def run_job(spark: SparkSession, input_path: str, output_dir: str, k: int, input_format: str = "PARQUET",
            output_format: str = "DENSE", trials: int = 1, seeds: list[int] | None = None,
            dataset: str = "Untitled", compute_projected: bool = False, n_rows: int | None = None,
            n_cols: int | None = None, base: int = 0, duplicates: str = "error", bad_rows: str = "error",
            projected_format: str = "PARQUET", **fit_options) -> tuple[list[PpcaModel], DataFrame]:
    """Fit ``trials`` times and write ``components/``, ``runs/`` (appended)
    and, when asked, ``projected/`` (Parquet or a text format) under
    ``output_dir``, from the trial with the least noise variance.  Returns the
    models and the trial summary (mean and sample variance of time and
    rounds)."""
    m = load_matrix(spark, input_path, input_format, n_rows, n_cols, base, duplicates, bad_rows)
    models, runs, summary = run_trials(m, k, trials=trials, seeds=seeds, dataset=dataset, **fit_options)
    best = min(models, key=lambda model: model.ss)
    best.write_components(spark, os.path.join(output_dir, "components"), output_format)
    append_run_log(runs, os.path.join(output_dir, "runs"))
    if compute_projected:
        best.write_projection(m, os.path.join(output_dir, "projected"), projected_format)
    return models, summary
