"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only where none is set and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def free_shuffles(spark: SparkSession) -> None:
    """From now on a query's shuffle files go when the query ends.  By default they stay until the driver happens to collect its
    garbage, so those of many steps lie on disk at once.  A choice of the user stays, and a Spark that knows no such setting is left as it is."""
    if _CLEANUP not in spark.conf.getAll and spark.conf.isModifiable(_CLEANUP):
        spark.conf.set(_CLEANUP, True)


_scopes: list[list[DataFrame]] = []


@contextmanager
def scratch():
    """Delete at its end all tables that ``materialise`` writes within it, but those given to ``keep``.

    A result is lazy, so whoever asks for it opens the scope, consumes the result inside, and is left with no intermediate table.
    """
    written: list[DataFrame] = []
    _scopes.append(written)
    kept: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df.written_to)
        return df

    try:
        yield keep
    finally:
        _scopes.remove(written)
        for df in written:
            if df.written_to not in kept:
                discard(df)
            elif _scopes:
                _scopes[-1].append(df)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts the
    lineage, and a lost executor costs no recomputation of what came before.  What was shuffled for it goes at once, and within a
    ``scratch`` the table at its end."""
    spark = df.sparkSession
    free_shuffles(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    if _scopes:
        _scopes[-1].append(out)
    return out


def settled(build: Callable[[], DataFrame], name: str) -> DataFrame:
    """What ``build`` gives as a table; the tables written on the way to it go at once."""
    with scratch() as keep:
        return keep(materialise(build(), name))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder.  A session without a JVM of its own (Spark Connect) leaves an empty table there."""
    jvm = getattr(spark, "_jvm", None)
    if jvm is None:
        spark.createDataFrame([], "gone int").write.mode("overwrite").parquet(path)
        return
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def discard(df: DataFrame | None) -> None:
    """Delete a table that ``materialise`` wrote and nothing reads any more."""
    if path := getattr(df, "written_to", None):
        remove(df.sparkSession, path)
