"""pyspark.ml-style wrapper."""

import numpy as np

from conftest import SF001
from lowrank.estimator import ProbabilisticPCA
from lowrank.sources.tables import load_table


def test_fit_transform_keeps_columns(spark):
    df = load_table(spark, SF001, "embeddings")
    model = ProbabilisticPCA(k=3, inputCol="embedding", seed=2, max_iter=2).fit(df)
    out = model.transform(df)
    assert out.columns == df.columns + ["pca"]
    pdf = out.toPandas()
    y = np.stack([np.asarray(v, dtype=np.float64) for v in pdf.embedding])
    assert np.allclose(np.stack(pdf.pca.to_numpy()), y @ model.model.loadings, atol=1e-12)
    assert set(pdf.label) == set(df.toPandas().label)


def test_numeric_columns_input(spark):
    df = load_table(spark, SF001, "lineitem")
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    est = ProbabilisticPCA(k=1, inputCols=cols, outputCol="pc", seed=1, max_iter=2)
    model = est.fit(df)
    model.orthonormal, model.centered = True, True
    out = model.transform(df.select("l_orderkey", *cols)).toPandas()
    y = out[cols].to_numpy()
    want = (y - model.model.mean) @ model.components
    assert np.allclose(np.stack(out.pc.to_numpy()), want, atol=1e-6)
