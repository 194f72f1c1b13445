"""Failed tasks are retried and give the same result: kernels depend only
on their input split, never on attempt or timing.  Runs in a fresh process
with task retries allowed (local[2, 4]); the first attempt of every kernel
task fails on purpose."""

import os
import subprocess
import sys
import textwrap

from conftest import ROOT

SCRIPT = textwrap.dedent(f"""
    import sys
    sys.path.insert(0, {ROOT!r})
    import numpy as np
    import lowrank.operators.blocks as blocks
    from lowrank import local_session
    from lowrank.operators import ppca
    from lowrank.sources import datasets

    spark = local_session("2,4", app="retry")
    sf = "/root/testdata/sf0.001"

    def fit():
        m = datasets.embeddings_matrix(spark, sf)
        m = m.with_df(m.df.repartition(3))
        a = ppca.ppca_fit(m, 2, max_iter=3, seed=5, strategy="passes", error_metric="l1_sampled",
                          target_error=0.0)
        b = ppca.ppca_fit(m, 2, max_iter=3, seed=5, strategy="summary", target_error=0.0)
        return [h["ss"] for h in a.history] + [h["ss"] for h in b.history], a.loadings

    clean_ss, clean_c = fit()
    original = blocks.to_block

    def flaky(batch, kind, d):
        from pyspark import TaskContext
        if TaskContext.get().attemptNumber() == 0:
            raise RuntimeError("injected task failure")
        return original(batch, kind, d)

    blocks.to_block = flaky
    flaky_ss, flaky_c = fit()
    assert flaky_ss == clean_ss, (flaky_ss, clean_ss)
    assert np.array_equal(flaky_c, clean_c)
    print("RETRY-OK")
""")


def test_retried_tasks_give_identical_fits(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=str(tmp_path), env=env,
                         capture_output=True, text=True, timeout=900)
    assert "RETRY-OK" in out.stdout, out.stderr[-3000:]
