"""Every worker-side function must run where ``lowrank`` is not importable
(the package is shipped by value).  Runs the kernels in a fresh process
whose working directory is outside the repository."""

import os
import subprocess
import sys
import textwrap

from conftest import ROOT

SCRIPT = textwrap.dedent(f"""
    import sys
    sys.path.insert(0, {ROOT!r})
    import numpy as np
    from pyspark.ml.linalg import Vectors
    import lowrank.operators.blocks as blocks
    from lowrank import local_session, ppca_fit
    from lowrank.estimator import ProbabilisticPCA
    from lowrank.operators import linalg, stats
    from lowrank.sources import datasets
    spark = local_session(2, app="no-package")
    sf = "/root/testdata/sf0.001"
    emb = datasets.embeddings_matrix(spark, sf)
    ppca_fit(emb, 2, max_iter=2, seed=1)                                  # one-pass summary route
    cp = datasets.customer_part_matrix(spark, sf)
    ppca_fit(cp, 2, max_iter=2, seed=1, strategy="passes", error_metric="l1_sampled")
    blocks.TSQR_GROUP_BYTES = 2 * 64 * 64 * 8                            # force the combining tree
    m = emb.with_df(emb.df.repartition(5))
    mean, _ = stats.mean_and_norm(m)
    linalg.r_factor(m, mean); linalg.centred_summary(m)
    model = ppca_fit(emb, 2, max_iter=1, seed=2, error_metric="none")
    model.transform(emb).count()
    df = spark.createDataFrame([(i, Vectors.dense([float(i), float(i % 3), 1.0 + i % 5])) for i in range(30)],
                               ["id", "v"])
    ProbabilisticPCA(k=1, inputCol="v", seed=1, max_iter=1).fit(df).transform(df).count()
    print("WORKERS-OK")
""")


def test_kernels_run_without_package_on_workers(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=str(tmp_path), env=env,
                         capture_output=True, text=True, timeout=900)
    assert "WORKERS-OK" in out.stdout, out.stderr[-3000:]
