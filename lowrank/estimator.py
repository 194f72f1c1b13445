"""``pyspark.ml``-style entry points over the fit.

    model = ProbabilisticPCA(k=3, inputCol="embedding").fit(df)
    scored = model.transform(df)          # df plus an ARRAY<DOUBLE> column

``inputCol`` is one numeric ARRAY or ML ``Vector`` column, or
``inputCols`` a list of numeric columns.  ``transform`` keeps every input
column and appends the projection, computed per Arrow batch with the d x k
loadings in the closure (no shuffle, partitioning kept).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .matrix import TallMatrix
from .operators.blocks import to_block
from .operators.ppca import PpcaModel, ppca_fit
from .sources.tables import as_double_array, matrix_from_array, matrix_from_columns


class ProbabilisticPCA:
    def __init__(self, k: int, inputCol: str | None = None, inputCols: list[str] | None = None,
                 outputCol: str = "pca", **fit_options):
        if (inputCol is None) == (inputCols is None):
            raise ValueError("give exactly one of inputCol or inputCols")
        self.k, self.input_col, self.input_cols = k, inputCol, inputCols
        self.output_col, self.fit_options = outputCol, fit_options

    def _features(self, df: DataFrame):
        if self.input_cols is not None:
            return F.array(*[F.col(c).cast("double") for c in self.input_cols])
        field = df.schema[self.input_col]
        if isinstance(field.dataType, T.ArrayType):
            return as_double_array(self.input_col)
        from pyspark.ml.functions import vector_to_array
        return vector_to_array(F.col(self.input_col))

    def _matrix(self, df: DataFrame) -> TallMatrix:
        if self.input_cols is not None:
            return matrix_from_columns(df, self.input_cols)
        return matrix_from_array(df.select(self._features(df).alias("__f")), "__f")

    def fit(self, df: DataFrame) -> "ProbabilisticPCAModel":
        model = ppca_fit(self._matrix(df), self.k, **self.fit_options)
        return ProbabilisticPCAModel(model, self)


class ProbabilisticPCAModel:
    def __init__(self, model: PpcaModel, spec: ProbabilisticPCA, centered: bool = False,
                 orthonormal: bool = False):
        self.model, self.spec = model, spec
        self.centered, self.orthonormal = centered, orthonormal

    @property
    def components(self) -> np.ndarray:
        return self.model.components

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``outputCol`` = y C (or the centred / orthonormal
        variants chosen on the model)."""
        w = self.model.components if self.orthonormal else self.model.loadings
        shift = self.model.mean @ w if self.centered else np.zeros(w.shape[1])
        d, k = w.shape
        tmp = "__lowrank_features"
        staged = df.withColumn(tmp, self.spec._features(df))
        out_field = T.StructField(self.spec.output_col, T.ArrayType(T.DoubleType(), False), False)
        schema = T.StructType([f for f in df.schema.fields] + [out_field])
        list_type = pa.list_(pa.field("element", pa.float64(), False))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                feats = pa.RecordBatch.from_arrays([batch.column(tmp)], names=["features"])
                x = to_block(feats, "dense", d).matmul(w) - shift if batch.num_rows else np.zeros((0, k))
                offsets = pa.array(np.arange(0, x.size + 1, k, dtype=np.int32))
                col = pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(x).ravel()), type=list_type)
                keep = [batch.column(i) for i, name in enumerate(batch.schema.names) if name != tmp]
                names = [n for n in batch.schema.names if n != tmp] + [out_field.name]
                yield pa.RecordBatch.from_arrays(keep + [col], names=names)

        return staged.mapInArrow(run, schema)
