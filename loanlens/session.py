"""Session helpers: a local session for tests/bench, checkpoint-dir policy,
and lineage cutting that survives executor loss."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app: str = "loanlens") -> SparkSession:
    """Local session with the settings the library expects (AQE on, UI off,
    UTC, Arrow). On a cluster, create the session with spark-submit instead
    and only call :func:`ensure_checkpoint_dir`."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    shuffle_partitions = shuffle_partitions or int(cpus)
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the shared folder the cluster names in ``spark.checkpoint.dir``.

    Only when that setting is absent *and* the master is local (tests) is a
    private scratch folder created; on a cluster a missing setting is an error,
    because a machine-local folder would not survive executor loss.
    """
    folder = _checkpoint_dir(spark)
    if folder not in _LEAVING:
        # Spark gives every application a folder of its own below the named
        # one; nothing in it is of use to a later application.
        _LEAVING.add(folder)
        path, fs = file_system(spark, folder)
        fs.deleteOnExit(path)
    return folder


#: Folders that the JVM removes when it ends.
_LEAVING: set[str] = set()


def file_system(spark: SparkSession, path: str):
    """(Hadoop path, its file system)."""
    sc = spark.sparkContext
    hadoop_path = sc._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path, hadoop_path.getFileSystem(sc._jsc.hadoopConfiguration())


def _checkpoint_dir(spark: SparkSession) -> str:
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir() or conf_dir
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared (HDFS/S3) folder")
    scratch = tempfile.mkdtemp(prefix="loanlens-ckpt-")
    sc.setCheckpointDir(scratch)
    return scratch


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared checkpoint folder.

    Used where two passes must see the *same* partition contents (the range
    partitioned frames of the cumulative-sum recipe), and to bound plan growth
    in iterative jobs. Never a local checkpoint: those die with the executor.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows up to which a result of an aggregation may be read and sent to all tasks.
SMALL_ROWS = 10_000


def small_table(df: DataFrame, limit: int = SMALL_ROWS) -> DataFrame | None:
    """``df`` as a local table that joins by broadcast, or None if it has more
    than ``limit`` rows. For tables whose size the data decide (one row a group):
    the size is checked, not assumed."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        return None
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def same_session(a: SparkSession, b: SparkSession) -> bool:
    if a is b:
        return True
    try:
        return a._jsparkSession.equals(b._jsparkSession) and not a.sparkContext._jsc.sc().isStopped()
    except Exception:  # the old session's context is gone
        return False


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"
