"""Session helpers: shared folder, lineage cuts, table access."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Only a single-JVM local session may fall back to a temporary folder; on a cluster an unset
    folder is an error, since a machine-local path would lose data with its executor.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="vitrine-checkpoint-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder; the result survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def keep(df: DataFrame) -> DataFrame:
    """Like ``cut``, but as a compressed table of columns: what reads it reads only the columns it needs.

    The table is removed by ``discard``, or else when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)

    def drop() -> None:
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session has ended before the driver
            pass

    atexit.register(drop)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._drop = drop
    return kept


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``keep`` made and that nothing reads again."""
    for t in tables:
        t._drop()
        atexit.unregister(t._drop)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files that nothing refers to any more, say those of a result that was kept.

    Spark removes them when the driver's JVM collects garbage, which with a large heap may be after the disk is full.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
