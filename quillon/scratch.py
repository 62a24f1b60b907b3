"""Intermediate tables in the shared folder, so that lost executors cost a re-read and not a recompute."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where that is unset and the master is local."""
    sc = spark.sparkContext
    shared = sc.getConf().get("spark.checkpoint.dir")
    if shared:
        return f"{shared.rstrip('/')}/quillon-{sc.applicationId}"
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if sc.applicationId not in _OWN:
        _OWN[sc.applicationId] = tempfile.mkdtemp(prefix="quillon-")
    return "file://" + _OWN[sc.applicationId]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: one evaluation, a short lineage and true sizes for the planner.

    files: at most so many tasks write, for tables known to be small. Without Hadoop's native library every file costs
    its executor several processes (chmod), and for a moment each counts with the whole memory of the JVM that starts it."""
    path = new_path(df.sparkSession, name)
    (df if files is None else df.coalesce(files)).write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._quillon_path = path
    return back


def drop(df: DataFrame) -> None:
    """Delete the files behind a frame that cut() made and that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._quillon_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
