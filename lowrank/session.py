"""Spark session and lineage helpers.

Library code never creates a session of its own; it takes the caller's.
``local_session`` is for tests, benches and the entry point only.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "lowrank") -> SparkSession:
    """A local session configured the way the tests and the bench expect."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("LOWRANK_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    On a cluster ``spark.checkpoint.dir`` points at shared storage and is
    used as is; a cluster without it is an error.  Only a local session
    with the setting unset (tests) gets a scratch folder.
    """
    conf = spark.conf.get(CHECKPOINT_CONF, None)
    if not conf:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder every executor can reach")
        conf = tempfile.mkdtemp(prefix="lowrank-ckpt-")
        spark.conf.set(CHECKPOINT_CONF, conf)
    spark.sparkContext.setCheckpointDir(conf)
    return conf


def _plan(df: DataFrame) -> str:
    """The physical plan as text, without what lies under a cached relation."""
    try:
        lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    except Exception:  # pragma: no cover - sessions without a JVM handle
        return "Exchange (unknown plan)"
    kept, cached = [], None
    for line in lines:
        depth = len(line) - len(line.lstrip(" :+-"))
        if cached is not None and depth > cached:
            continue
        cached = depth if "InMemoryRelation" in line else None
        kept.append(line)
    return "\n".join(kept)


def num_partitions(df: DataFrame) -> int | None:
    """Partitions of a plan without shuffles (no job); None when the plan has
    an exchange, which adaptive execution would run to answer, or when the
    session does not expose RDDs."""
    if has_exchange(df):
        return None
    try:
        return df.rdd.getNumPartitions()
    except Exception:  # pragma: no cover
        return None


def has_exchange(df: DataFrame) -> bool:
    """True when the physical plan of ``df`` contains a shuffle."""
    return "Exchange" in _plan(df)


def plan_size_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan (from file sizes; no job)."""
    try:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except Exception:  # pragma: no cover
        return 0


# Spread an input over the cores only when it has more than this per core.
MIN_BYTES_PER_TASK = 4 << 20


def spread(df: DataFrame) -> DataFrame:
    """An input with fewer partitions than task slots (a few large
    files) is spread round-robin once before an iterative job reads it many
    times.  With as many partitions as slots, as on a large cluster reading
    many files, nothing changes and no shuffle is added."""
    try:
        slots = df.sparkSession.sparkContext.defaultParallelism
    except Exception:  # pragma: no cover
        return df
    parts = num_partitions(df)
    if parts is None or parts >= slots:
        return df
    want = min(slots, max(1, plan_size_bytes(df) // MIN_BYTES_PER_TASK))
    return df.repartition(int(want)) if want > parts else df


class hash_joins:
    """Let adaptive execution hash the smaller side of a shuffle join in place
    of sorting both, where every partition it measured has at most ``SIZE``
    bytes; a hashed side cannot spill, so tasks of that size keep it small."""

    SIZE = "16m"
    KEYS = ("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "spark.sql.adaptive.advisoryPartitionSizeInBytes")

    def __init__(self, spark):
        self.spark, self.old = spark, {}

    def __enter__(self):
        for key in self.KEYS:
            self.old[key] = self.spark.conf.get(key, None)
            self.spark.conf.set(key, self.SIZE)
        return self

    def __exit__(self, *exc):
        for key, old in self.old.items():
            if old is None:
                self.spark.conf.unset(key)
            else:
                self.spark.conf.set(key, old)
        return False


def store(df: DataFrame, group_bytes: int | None = None) -> DataFrame:
    """Write ``df`` once under the shared ``spark.checkpoint.dir`` and read it back;
    ``group_bytes``: of a Parquet row group."""
    path = os.path.join(ensure_checkpoint_dir(df.sparkSession), "tables", uuid.uuid4().hex)
    (df.write if group_bytes is None else df.write.option("parquet.block.size", group_bytes)).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._lowrank_path = path
    return out


def materialize(df: DataFrame, cut_lineage: bool | None = None, partitions: int | None = None) -> DataFrame:
    """Pin a DataFrame that an iterative job reads many times.

    A plan that is a plain scan (plus row-local expressions) is persisted
    with MEMORY_AND_DISK: losing an executor only re-reads its splits.
    A plan with shuffles upstream (joins, grouping) is written once as a
    Parquet table under the shared ``spark.checkpoint.dir`` and read back,
    so a lost executor never forces the shuffles to be redone and every
    later pass is a columnar scan.  ``localCheckpoint`` is never used.
    ``partitions`` repartitions round-robin first (P3's explicit count);
    by default only an input with too few partitions is spread.
    """
    if cut_lineage is None:
        cut_lineage = has_exchange(df)          # of the input, before anything is spread
    if cut_lineage:
        # Spark splits the stored files over the slots when it reads them.
        return store(df.repartition(int(partitions)) if partitions else df)
    df = df.repartition(int(partitions)) if partitions else spread(df)
    if df.storageLevel != StorageLevel.NONE:
        return df                               # pinned by the caller, who unpersists it
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    df._lowrank_pinned = True
    return df


def release(df: DataFrame) -> None:
    """Undo ``materialize``: unpersist what it pinned, or delete the table it
    wrote; a DataFrame that the caller pinned stays as it is."""
    path = getattr(df, "_lowrank_path", None)
    if path is None:
        if getattr(df, "_lowrank_pinned", False):
            df.unpersist()
            df._lowrank_pinned = False
        return
    try:
        jvm = df.sparkSession._jvm
        hpath = jvm.org.apache.hadoop.fs.Path(path)
        hpath.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(hpath, True)
    except Exception:  # pragma: no cover - leave it to the folder's retention
        pass
