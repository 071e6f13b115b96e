"""Where intermediate results may be written."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the cluster.

    ``spark.checkpoint.dir`` or an already set folder is taken; a session with neither
    gets a folder in its warehouse, which executors share as well.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return configured or current.get()
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    folder = configured or f"{warehouse}/burstlens-scratch"
    sc.setCheckpointDir(folder)
    return folder


def scratch_dir(spark: SparkSession, kind: str) -> str:
    """A new folder name in the shared space, deleted by ``release_scratch`` or at exit."""
    path = f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(release_scratch, spark)
    _made.append(path)
    return path


def stored(df: DataFrame, kind: str) -> DataFrame:
    """The rows of ``df``, computed once, from a table in the shared space.

    For small results that several parts of a plan read. It cuts their lineage as
    well: a lost executor doesn't cause them to be computed again.
    """
    path = scratch_dir(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release_scratch(spark: SparkSession) -> None:
    """Delete the folders named so far; results that still read them are then lost."""
    jvm = getattr(spark.sparkContext, "_jvm", None)
    while _made:
        path = _made.pop()
        if jvm is None:
            continue
        try:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(where, True)
        except Exception:  # at exit the JVM may be gone; nothing else depends on this
            return
