"""Session-level helpers: tables, shared folder, partition spread."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a folder of our own only in local mode where the session names none (tests).

    On a cluster a folder of one machine would hold a part of each table only, so there a session without one is an error.
    """
    named = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY, None)
    if not named:
        set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if set_dir.isDefined():
            return set_dir.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="spangrid-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        named = "file://" + own
        spark.sparkContext.setCheckpointDir(named)
    return named


def new_folder(spark: SparkSession, name: str = "table") -> str:
    """A path of its own in the shared folder. What is written there is deleted when the program ends, or by `release`."""
    path = f"{shared_dir(spark).rstrip('/')}/spangrid-{name}-{uuid.uuid4().hex}"
    if not _folders:
        atexit.register(_release_at_exit)
    _folders[path] = spark
    return path


_folders: dict[str, SparkSession] = {}


def release() -> int:
    """Delete all tables written so far; frames that read them are of no use afterwards. Returns their number."""
    n = 0
    for path, spark in list(_folders.items()):
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        del _folders[path]
        n += 1
    return n


def _release_at_exit() -> None:
    # a session that is gone has taken its connection along; then the folder's owner has to clear it
    with contextlib.suppress(Exception):
        release()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def materialise(df: DataFrame) -> DataFrame:
    """Write to a Parquet table in the shared folder and read it back.

    Unlike a checkpoint the columns stay prunable, so later readers of two columns don't read the rest.
    """
    spark = df.sparkSession
    path = new_folder(spark)
    df.write.parquet(path)
    # the JVM deletes it too, should the session be stopped before the program ends
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.parquet(path)


def parallelism(spark: SparkSession) -> int:
    """Tasks that can run at once."""
    return max(1, spark.sparkContext.defaultParallelism)


def spread(df: DataFrame) -> DataFrame:
    """Re-deal a scan that has fewer splits than the cluster has cores.

    Only small inputs are shuffled by this: at scale a scan has many more splits than cores and is left as it is.
    """
    n = parallelism(df.sparkSession)
    return df if df.rdd.getNumPartitions() >= min(n, 4) else df.repartition(n)
