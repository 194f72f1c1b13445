import os
import sys

import duckdb
import numpy as np
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from lowrank.session import local_session  # noqa: E402

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"

# The 7 x 5 sample matrix and the constant start (C, ss) of the
# golden EM check (FIXTURES.md F1).
SAMPLE = [[0, 1, 0, 1, 0],
          [1, 1, 0, 1, 0],
          [0, 0, 1, 1, 0],
          [1, 0, 1, 1, 0],
          [0, 1, 0, 1, 0],
          [1, 1, 0, 1, 0],
          [0, 0, 1, 1, 0]]
C0 = [[0.730967787376657, 0.24053641567148587, 0.6374174253501083],
      [0.5504370051176339, 0.5975452777972018, 0.3332183994766498],
      [0.3851891847407185, 0.984841540199809, 0.8791825178724801],
      [0.9412491794821144, 0.27495396603548483, 0.12889715087377673],
      [0.14660165764651822, 0.023238122483889456, 0.5467397571984656]]
SS0 = 0.9644868606768501


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, shuffle_partitions=8, app="lowrank-tests")
    yield s


@pytest.fixture(scope="session")
def sample_df(spark):
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(SAMPLE)],
                                 "id long, f array<double>")


@pytest.fixture(scope="session")
def sample_np():
    return np.array(SAMPLE, dtype=float)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in ("customer", "part", "orders", "lineitem", "embeddings", "events", "documents", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return con
