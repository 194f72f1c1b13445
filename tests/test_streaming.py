"""Incremental conversion of text matrices (K1/K2 as file streams)."""

import os

from lowrank.sources.tables import entries_frame, matrix_from_entries
from lowrank.streaming import coo_folder_to_parquet, dense_folder_to_parquet


def _write(path, name, body):
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, name), "w") as f:
        f.write(body)


def test_coo_stream_converts_new_files_once(spark, tmp_path):
    src, dst, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    _write(src, "a.txt", "0,0,1.0\n0,2,2.0\n")
    q = coo_folder_to_parquet(spark, src, dst, checkpoint=ck)
    q.awaitTermination(120)
    assert spark.read.parquet(dst).count() == 2
    _write(src, "b.txt", "1,1,3.0\n0,1,0.0\n2,0,4.0\n")
    q = coo_folder_to_parquet(spark, src, dst, checkpoint=ck)      # a rerun picks up only b.txt
    q.awaitTermination(120)
    e = spark.read.parquet(dst)
    assert e.count() == 4
    m = matrix_from_entries(entries_frame(e), n_rows=3, n_cols=3)
    got = {r.row_id: (list(r.indices), list(r.values)) for r in m.df.collect()}
    assert got == {0: ([0, 2], [1.0, 2.0]), 1: ([1], [3.0]), 2: ([0], [4.0])}


def test_dense_stream_skips_blank_lines(spark, tmp_path):
    src, dst, ck = str(tmp_path / "din"), str(tmp_path / "dout"), str(tmp_path / "dck")
    _write(src, "a.txt", "1 2\n\n 3 4 \n")
    _write(src, "b.txt", "5 6\n")
    q = dense_folder_to_parquet(spark, src, dst, checkpoint=ck)
    q.awaitTermination(120)
    rows = spark.read.parquet(dst).toPandas()
    got = sorted((os.path.basename(f), int(n), list(v)) for f, n, v in zip(rows.file, rows.line, rows.features))
    assert got == [("a.txt", 0, [1.0, 2.0]), ("a.txt", 1, [3.0, 4.0]), ("b.txt", 0, [5.0, 6.0])]
