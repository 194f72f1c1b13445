"""Nothing goes missing without an error."""

import numpy as np
import pytest

from lowrank.operators import blocks, linalg, rows, stats
from lowrank.operators.ppca import ppca_fit
from lowrank.session import materialize, num_partitions, release, spread
from lowrank.sources.tables import entries_frame, matrix_from_array, matrix_from_entries
from lowrank.sources.text import matrix_lines, read_coo_text, read_dense_text, write_matrix


def test_one_row_and_one_column(spark):
    m = matrix_from_entries(spark.createDataFrame([(0, 0, 1.0), (0, 3, 2.0)], "i long, j int, v double"))
    assert (m.n_rows, m.n_cols) == (1, 4)
    m = matrix_from_entries(spark.createDataFrame([(0, 0, 1.0)], "i long, j int, v double"))
    assert (m.n_rows, m.n_cols) == (1, 1)


@pytest.mark.parametrize("row", [(1, 0, 1.0), (0, 1, 1.0), (None, 1, 5.0), (1, 2, None)])
def test_bad_entries_fail(spark, row):
    df = entries_frame(spark.createDataFrame([(2, 2, 1.0), row], "i long, j int, v double"), base=1)
    with pytest.raises(Exception, match="bad matrix entry"):
        matrix_from_entries(df)


def test_dense_rows_survive_other_splits(spark, tmp_path):
    """Row ids and rows stay when the splits change between reading and use."""
    for part in range(2):
        (tmp_path / f"part-{part}.txt").write_text("".join(f"{part * 1000 + i} {i % 7}\n\n" for i in range(1000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
        m = read_dense_text(spark, str(tmp_path))
        spark.conf.set("spark.sql.files.maxPartitionBytes", "7k")
        rows = {r["row_id"]: r["features"] for r in m.df.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert m.n_rows == 2000
    assert rows == {i: [float(i), float(i % 1000 % 7)] for i in range(2000)}


def test_a_cached_input_stays_cached(spark):
    df = spark.createDataFrame([(i, [float(i % 5), float(i % 3), 1.0 * i]) for i in range(60)], "id long, f array<double>").persist()
    df.count()
    ppca_fit(matrix_from_array(df, "f", "id"), k=1, seed=1)
    assert df.storageLevel.useMemory
    df.unpersist()


@pytest.mark.parametrize("line", [",1,5.0", "1,2,", "1,2", "1,2,3,4", "a,1,2"])
def test_bad_coo_lines_fail(spark, tmp_path, line):
    (tmp_path / "m.txt").write_text(f"0,0,1\n\n{line}\n")
    with pytest.raises(Exception, match="bad matrix entry"):
        read_coo_text(spark, str(tmp_path)).df.collect()


def test_indices_past_the_shape_fail(spark):
    e = entries_frame(spark.createDataFrame([(0, 0, 1.0), (4, 5, 2.0)], "i long, j int, v double"))
    for shape in ({"n_rows": 9, "n_cols": 5}, {"n_rows": 4, "n_cols": 9}):
        with pytest.raises(Exception, match="index outside the matrix"):
            matrix_from_entries(e, **shape).df.collect()


def test_wider_rows_fail_or_are_counted(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0, 5.0])], "id long, f array<double>")
    with pytest.raises(Exception, match="row of width 3, expected 2"):
        matrix_from_array(df, "f", "id", n_cols=2).df.collect()
    with pytest.warns(UserWarning, match="cut 1 elements"):
        m = matrix_from_array(df, "f", "id", n_cols=2, wider="cut")
    assert sorted(r["features"] for r in m.df.collect()) == [[1.0, 2.0], [3.0, 4.0]]


@pytest.mark.parametrize("bad", [[1.0, None], [5.0], None])
def test_statistics_reject_incomplete_rows(spark, bad):
    df = spark.createDataFrame([(0, [3.0, 4.0]), (1, bad)], "id long, f array<double>")
    with pytest.raises(Exception, match="null row, null element or row of another width"):
        stats.column_means(matrix_from_array(df.orderBy("id"), "f", "id")).collect()


def test_absent_rows_and_columns_are_there(spark):
    m = matrix_from_entries(spark.createDataFrame([(2, 1, 4.0), (0, 0, 2.0)], "i long, j int, v double"), n_rows=3, n_cols=3)
    lines = lambda fmt: [r["value"] for r in matrix_lines(m, fmt).orderBy("row_id").collect()]
    assert lines("DENSE") == ["2.0 0.0 0.0 ", "0.0 0.0 0.0 ", "0.0 4.0 0.0 "]
    assert lines("LIL") == ["{0:2.0}", "{}", "{1:4.0}"]
    means = {r["j"]: r["mean"] for r in stats.column_means(m).collect()}
    assert means == {0: pytest.approx(2 / 3), 1: pytest.approx(4 / 3), 2: 0.0}
    mu = np.array([2 / 3, 4 / 3, 0.0])
    y = np.array([[2.0, 0, 0], [0, 0, 0], [0, 4.0, 0]])
    w = np.arange(6.0).reshape(3, 2)
    values = lambda df, col: np.array([r[col] for r in df.orderBy("row_id").collect()])
    assert np.allclose(values(rows.center_rows(m, mu).df, "features"), y - mu)
    assert np.allclose(values(rows.project(m, w, mu), "values"), (y - mu) @ w)
    assert np.allclose(values(rows.residual_rows(m, w, w, mu), "values"), (y - mu) - (y - mu) @ w @ w.T)


def test_text_keeps_the_row_order(spark, tmp_path):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(40)], "id long, f array<double>").repartition(5, "f")
    write_matrix(matrix_from_array(df, "f", "id"), str(tmp_path / "m"))
    got = {r["row_id"]: r["features"][0] for r in read_dense_text(spark, str(tmp_path / "m")).df.collect()}
    assert got == {i: float(i) for i in range(40)}


def test_unfinished_power_iteration_raises(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(i, rng.standard_normal(300).tolist()) for i in range(400)], "id long, f array<double>")
    with pytest.raises(RuntimeError, match="not converged"):
        linalg.top_singular_values_power(matrix_from_array(df, "f", "id"), 2, np.zeros(300), iters=2)


def test_planning_runs_no_job(spark):
    df = spark.range(1000).selectExpr("id % 7 AS row_id", "double(id) AS v")
    df = df.groupBy("row_id").agg({"v": "sum"}).selectExpr("row_id", "array(`sum(v)`) AS features")
    sc = spark.sparkContext
    sc.setJobGroup("planning", "planning")
    try:
        m = matrix_from_array(df, "features", "row_id", n_cols=1)
        spread(m.df), num_partitions(m.df), blocks.kernel_input(m)
        assert list(sc.statusTracker().getJobIdsForGroup("planning")) == []
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    stored = materialize(m.df)                  # shuffles behind it: written, whatever its partitions
    assert stored._lowrank_path and stored.count() == 7
    release(stored)


def test_noise_variance_agrees_on_both_routes(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((200, 1)) * 1e6
    data = base @ np.array([[1.0, 2.0, 3.0]]) + rng.standard_normal((200, 3)) * 1e-2
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(data)], "id long, f array<double>")
    m = matrix_from_array(df, "f", "id")
    fits = [ppca_fit(m, 1, seed=1, max_iter=3, error_metric="none", strategy=s).ss for s in ("summary", "passes")]
    assert fits[1] == pytest.approx(fits[0], rel=1e-6)
