"""Rejected lines, stream row ids, run log under retries, mllib inputs."""

import os

import numpy as np
import pytest

from lowrank.operators import trials
from lowrank.sources import tables, text
from lowrank.sources.tables import matrix_from_mllib
from lowrank.streaming import convert, dense_folder_to_parquet


def put(path, name, body):
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, name), "w") as f:
        f.write(body)


def ids(df):
    return {r["row_id"]: list(r["features"]) for r in df.collect()}


def test_stream_ids_equal_one_full_read(spark, tmp_path):
    src, dst, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    put(src, "a.txt", "1 2\n\n3 4\n")
    put(src, "b.txt", "5 6\n")
    dense_folder_to_parquet(spark, src, dst, checkpoint=ck).awaitTermination(120)
    put(src, "c.txt", "7 8\n9 10\n")
    dense_folder_to_parquet(spark, src, dst, checkpoint=ck).awaitTermination(120)
    want = ids(text.read_dense_text(spark, src).df)
    assert ids(spark.read.parquet(dst)) == want and sorted(want) == [0, 1, 2, 3, 4]
    assert {(os.path.basename(r["file"]), r["lines"], r["batch"]) for r in convert.manifest(spark, dst).collect()} == {
        ("a.txt", 2, 0), ("b.txt", 1, 0), ("c.txt", 2, 1)}
    m = tables.matrix_from_parquet(spark, dst)
    assert m.counted().n_rows == 5 and m.n_cols == 2


def test_a_retried_batch_keeps_its_ids(spark, tmp_path):
    dst = str(tmp_path / "out")
    batches = [spark.createDataFrame([(v, f, 0) for v, f in rows], "value string, file string, block long").coalesce(1)
               for rows in ([("1 2", "a"), ("3 4", "a")], [("5 6", "b")], [("7 8", "c")])]
    for n, b in ((0, batches[0]), (1, batches[1]), (1, batches[1]), (0, batches[0]), (2, batches[2])):
        convert._convert_batch(b, n, dst)
    assert ids(spark.read.parquet(dst)) == {0: [1.0, 2.0], 1: [3.0, 4.0], 2: [5.0, 6.0], 3: [7.0, 8.0]}


def test_dense_rejects_are_kept_with_their_place(spark, tmp_path):
    src, bad = str(tmp_path / "in"), str(tmp_path / "bad")
    put(src, "a.txt", "1 2\nx 2\n3 4\n")
    put(src, "b.txt", "1 2 3\n\n5 6\n")
    with pytest.warns(UserWarning, match="dropped 2 bad"):
        m = text.read_dense_text(spark, src, 2, bad_rows="drop", rejects_to=bad)
    assert ids(m.df) == {0: [1.0, 2.0], 1: [3.0, 4.0], 2: [5.0, 6.0]} and m.n_rows == 3
    got = {(os.path.basename(r["file"]), r["line"], r["reason"], r["value"]) for r in spark.read.parquet(bad).collect()}
    assert got == {("a.txt", 1, "a value is not a number", "x 2"), ("b.txt", 0, "row of width 3, expected 2", "1 2 3")}
    with pytest.raises(ValueError, match="2 bad DENSE rows"):
        text.read_dense_text(spark, src, 2, rejects_to=bad + "2")
    assert spark.read.parquet(bad + "2").count() == 2


def test_coo_rejects_are_kept_with_their_reason(spark, tmp_path):
    src, bad = str(tmp_path / "in"), str(tmp_path / "bad")
    put(src, "a.txt", "0,0,1\n0,1\n1,b,2\n1,1,3\n")
    with pytest.warns(UserWarning, match="dropped 2 bad"):
        m = text.read_coo_text(spark, src, bad_lines="drop", rejects_to=bad)
    assert {(r["i"], r["j"], r["v"]) for r in m.entries().collect()} == {(0, 0, 1.0), (1, 1, 3.0)}
    assert {(r["line"], r["reason"]) for r in spark.read.parquet(bad).collect()} == {(1, "2 fields, expected 3"), (2, "a field is not a number")}
    with pytest.raises(Exception, match="bad matrix entry"):
        text.read_coo_text(spark, src, n_rows=2, n_cols=2).entries().collect()


def test_rejects_of_a_clean_folder(spark, tmp_path):
    put(str(tmp_path / "in"), "a.txt", "1 2\n")
    assert text.read_dense_text(spark, str(tmp_path / "in"), bad_rows="drop", rejects_to=str(tmp_path / "bad")).n_rows == 1
    assert not os.path.exists(tmp_path / "bad")


def test_run_log_survives_a_retry(spark, tmp_path):
    stat = trials.RunStat(app="a", dataset="d", n_rows=3, n_cols=2, seed=1, n_iter=2, iter_s=[1.0, 3.0])
    runs = trials.runs_frame(spark, [stat, stat])
    path = str(tmp_path / "log")
    for run_id in ("x", "x", "y"):
        trials.append_run_log(runs, path, run_id)
    log = trials.read_run_log(spark, path)
    assert {r["run_id"]: r["count"] for r in log.groupBy("run_id").count().collect()} == {"x": 2, "y": 2}
    assert {r["avg_iter_s"] for r in trials.mean_iteration_seconds(log).collect()} == {2.0}


def test_mllib_types_are_matrices(spark):
    from pyspark.mllib.linalg import Vectors
    from pyspark.mllib.linalg.distributed import IndexedRow, IndexedRowMatrix, RowMatrix
    a = np.arange(12.0).reshape(4, 3)
    vectors = spark.sparkContext.parallelize([Vectors.dense(r) if i % 2 else Vectors.sparse(3, range(3), r) for i, r in enumerate(a)], 2)
    indexed = IndexedRowMatrix(spark.sparkContext.parallelize([IndexedRow(i, r) for i, r in enumerate(a)], 2))
    for rows in (vectors, RowMatrix(vectors), indexed):
        m = matrix_from_mllib(spark, rows)
        assert ids(m.df) == {i: list(r) for i, r in enumerate(a)} and m.n_cols == 3
    with pytest.raises(ValueError, match="empty"):
        matrix_from_mllib(spark, spark.sparkContext.emptyRDD())
