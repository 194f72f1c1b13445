"""Text matrix formats: readers, writers and round trips."""

import os

import numpy as np
import pytest

from lowrank.sources import text
from lowrank.sources.tables import entries_frame, matrix_from_array, matrix_from_entries, sparse_from_dense


def _write(path, name, body):
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, name), "w") as f:
        f.write(body)


def test_dense_reader_orders_rows_across_files(spark, tmp_path):
    d = str(tmp_path / "dense")
    _write(d, "b.txt", "7 8 9\n\n10 11 12\n")
    _write(d, "a.txt", "  1 2 3\n4\t5 6 \n")
    m = text.read_dense_text(spark, d)
    got = m.df.orderBy("row_id").toPandas()
    assert m.n_rows == 4 and m.n_cols == 3
    assert list(got.row_id) == [0, 1, 2, 3]
    assert [list(v) for v in got.features] == [[1, 2, 3], [4, 5, 6], [7, 8, 9], [10, 11, 12]]


def test_dense_reader_rejects_ragged_rows(spark, tmp_path):
    d = str(tmp_path / "ragged")
    _write(d, "a.txt", "1 2 3\n4 5\n")
    with pytest.raises(ValueError):
        text.read_dense_text(spark, d)


def test_coo_reader_bases_duplicates_and_absent_rows(spark, tmp_path):
    d = str(tmp_path / "coo")
    _write(d, "part1.txt", "3,2,5.0\n1,1,1.5\n")
    _write(d, "part2.txt", "1,3,2.0\n\n3,1,-1.0\n")       # row 1 split over files, unsorted
    m = text.read_coo_text(spark, d, base=1, n_rows=4, n_cols=3)
    got = {r.row_id: (list(r.indices), list(r.values)) for r in m.df.collect()}
    assert got == {0: ([0, 2], [1.5, 2.0]), 2: ([0, 1], [-1.0, 5.0])}
    assert m.n_rows == 4                                     # absent rows 1 and 3 still count
    _write(d, "part3.txt", "1,1,4.0\n")
    with pytest.raises(Exception, match="duplicate"):
        text.read_coo_text(spark, d, base=1).df.collect()
    summed = text.read_coo_text(spark, d, base=1, duplicates="sum")
    assert {r.row_id: list(r.values) for r in summed.df.collect()}[0] == [5.5, 2.0]


def test_width_filter_drops_columns_beyond_d(spark):
    e = spark.createDataFrame([(0, 0, 1.0), (0, 5, 2.0), (1, 1, 0.0), (1, 2, 3.0)], "i long, j int, v double")
    with pytest.warns(UserWarning, match="cut 1 entries"):
        m = matrix_from_entries(entries_frame(e), n_cols=3, outside="cut")
    got = {r.row_id: (list(r.indices), list(r.values)) for r in m.df.collect()}
    assert got == {0: ([0], [1.0]), 1: ([2], [3.0])}


def test_writers_formats(spark, sample_df):
    m = matrix_from_array(sample_df, "f", "id")
    dense = text.matrix_lines(m, "DENSE").orderBy("row_id").toPandas()
    assert dense.value[0] == "0.0 1.0 0.0 1.0 0.0 "
    lil = text.matrix_lines(m, "LIL").orderBy("row_id").toPandas()
    assert lil.value[1] == "{0:1.0,1:1.0,3:1.0}"
    coo = text.matrix_lines(m, "COO").toPandas()
    assert len(coo) == int(np.count_nonzero(np.array([[0, 1, 0, 1, 0], [1, 1, 0, 1, 0], [0, 0, 1, 1, 0],
                                                        [1, 0, 1, 1, 0], [0, 1, 0, 1, 0], [1, 1, 0, 1, 0],
                                                        [0, 0, 1, 1, 0]])))
    assert "0,1,1.0" in set(coo.value)


@pytest.mark.parametrize("fmt", ["DENSE", "COO", "PARQUET"])
def test_round_trip(spark, sample_df, tmp_path, fmt):
    m = matrix_from_array(sample_df.repartition(3), "f", "id")
    out = str(tmp_path / fmt)
    text.write_matrix(m, out, fmt)
    if fmt == "DENSE":
        back = text.read_dense_text(spark, out)
        # one output file per partition: rows come back grouped by file
        got = sorted(tuple(v) for v in back.df.toPandas().features)
    elif fmt == "COO":
        back = text.read_coo_text(spark, out, n_rows=7, n_cols=5)
        got = sorted(tuple(v) for v in text.matrix_lines(back, "DENSE").toPandas().value.map(
            lambda s: tuple(float(x) for x in s.split())))
    else:
        got = sorted(tuple(v) for v in spark.read.parquet(out).toPandas().features)
    want = sorted(tuple(v) for v in m.df.toPandas().features)
    assert got == want


def test_convert_to_parquet(spark, tmp_path):
    d = str(tmp_path / "in")
    _write(d, "x.txt", "1 0 2\n0 3 0\n")
    m = text.convert_to_parquet(spark, d, str(tmp_path / "out"), "DENSE")
    assert m.n_rows == 2 and m.df.count() == 2
    sp = sparse_from_dense(m)
    assert sorted(len(r.indices) for r in sp.df.collect()) == [1, 2]


def test_components_written_and_read_back(spark, tmp_path):
    from lowrank.operators import ppca
    from lowrank.sources.tables import matrix_from_parquet
    from conftest import SF001
    from lowrank.sources import datasets
    m = datasets.embeddings_matrix(spark, SF001)
    model = ppca.ppca_fit(m, 2, max_iter=1, error_metric="none", seed=1)
    model.write_components(spark, str(tmp_path / "pcs"), "DENSE")
    back = text.read_dense_text(spark, str(tmp_path / "pcs"))
    got = np.array(sorted(tuple(v) for v in back.df.toPandas().features))
    assert np.allclose(got, np.array(sorted(tuple(r) for r in model.components)), atol=0)
    model.write_projection(m, str(tmp_path / "proj"))
    pm = matrix_from_parquet(spark, str(tmp_path / "proj"))
    assert pm.n_cols == 2 and pm.df.count() == 500
    sp = sparse_from_dense(m)
    sp.df.write.parquet(str(tmp_path / "sp"))
    rs = matrix_from_parquet(spark, str(tmp_path / "sp"))
    assert rs.is_sparse and rs.n_rows == 500 and rs.n_cols == 64


def test_path_level_job(spark, tmp_path):
    from lowrank.plans.job import run_job
    src = str(tmp_path / "mat")
    _write(src, "m.txt", "0 1 0 1 0\n1 1 0 1 0\n0 0 1 1 0\n1 0 1 1 0\n0 1 0 1 0\n1 1 0 1 0\n0 0 1 1 0\n")
    out = str(tmp_path / "job")
    models, summary = run_job(spark, src, out, k=2, input_format="DENSE", output_format="LIL", trials=2,
                              seeds=[1, 2], compute_projected=True, max_iter=2)
    assert len(models) == 2
    row = summary.first()
    assert row["n_runs"] == 2
    pcs = spark.read.text(os.path.join(out, "components")).collect()
    assert len(pcs) == 5 and all(r.value.startswith("{") for r in pcs)
    assert spark.read.json(os.path.join(out, "runs")).count() == 2
    assert spark.read.parquet(os.path.join(out, "projected")).count() == 7


def test_ml_vector_input(spark):
    from pyspark.ml.linalg import Vectors
    from lowrank.sources.tables import matrix_from_vectors
    df = spark.createDataFrame([(0, Vectors.dense([1.0, 2.0])), (1, Vectors.sparse(2, [1], [3.0]))], ["id", "v"])
    m = matrix_from_vectors(df, "v", "id")
    assert m.n_cols == 2
    assert sorted(tuple(r.features) for r in m.df.collect()) == [(0.0, 3.0), (1.0, 2.0)]


def test_dense_reader_numbers_lines_across_splits_of_one_file(spark, tmp_path):
    """A file cut into several input splits (as large files are) still gets
    consecutive ids in line order."""
    d = str(tmp_path / "split")
    lines = "".join(f"{i} {i * 2}\n" + ("\n" if i % 7 == 0 else "") for i in range(200))
    _write(d, "big.txt", lines)
    _write(d, "a_small.txt", "-1 -2\n")
    key = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(key)
    spark.conf.set(key, "256")
    try:
        m = text.read_dense_text(spark, d)
        assert m.df.rdd.getNumPartitions() > 3
        got = m.df.orderBy("row_id").toPandas()
    finally:
        spark.conf.set(key, old)
    assert m.n_rows == 201
    assert list(got.row_id) == list(range(201))
    assert [list(v) for v in got.features] == [[-1.0, -2.0]] + [[float(i), float(2 * i)] for i in range(200)]


def test_sketch_matrix_saved_for_reproduction(spark, sample_df, tmp_path):
    from lowrank.operators import linalg, ppca
    m = matrix_from_array(sample_df, "f", "id")
    ppca.ppca_fit(m, 2, max_iter=1, seed=9, error_metric="none", save_sketch_to=str(tmp_path / "omega"))
    back = text.read_dense_text(spark, str(tmp_path / "omega"))
    got = np.array(sorted(tuple(v) for v in back.df.toPandas().features))
    want = np.array(sorted(tuple(r) for r in linalg.sketch_matrix(5, 5, 9)))
    assert np.array_equal(got, want)                        # text round trip is exact


def test_dense_reader_counts_and_drops_bad_rows(spark, tmp_path):
    d = str(tmp_path / "bad")
    _write(d, "a.txt", "1 2 3\n4 x 6\n7 8\n9 10 11 12\n")
    with pytest.raises(ValueError, match="3 bad DENSE rows"):
        text.read_dense_text(spark, d, n_cols=3)
    with pytest.raises(ValueError, match="2 bad DENSE rows"):
        text.read_dense_text(spark, d, n_cols=3, wider="cut")
    with pytest.warns(UserWarning) as said:
        m = text.read_dense_text(spark, d, n_cols=3, bad_rows="drop", wider="cut")
    assert [str(w.message)[:9] for w in said if w.category is UserWarning] == ["dropped 2", "cut 1 ele"]
    got = m.df.orderBy("row_id").toPandas()
    assert m.n_rows == 2 and list(got.row_id) == [0, 1]
    assert [list(v) for v in got.features] == [[1.0, 2.0, 3.0], [9.0, 10.0, 11.0]]
