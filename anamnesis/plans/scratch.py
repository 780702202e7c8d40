"""Places for intermediate tables, and ways of cutting lineage that survive the loss of an executor."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: str | None = None
_made: list[tuple[SparkSession, str]] = []


def base_dir(spark: SparkSession) -> str:
    """The shared folder that the session names in ``spark.checkpoint.dir``.

    Where the setting is absent, a session of one machine (master local or local[n]) gets a temporary folder that is
    removed at exit. Any other session is refused: its executors share no such folder.
    """
    global _own
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if _own is None:
        _own = tempfile.mkdtemp(prefix="anamnesis-")
        atexit.register(shutil.rmtree, _own, ignore_errors=True)
    return f"file://{_own}"


def new_dir(spark: SparkSession, name: str) -> str:
    path = f"{base_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder or file of the session's file system, if it is there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def cleared(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the intermediate tables made inside it; results must have been written or read by then."""
    before = len(_made)
    try:
        yield
    finally:
        for owner, path in _made[before:]:
            if owner is spark:
                remove(spark, path)
        del _made[before:]


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is written or collected inside it gives its shuffle files back at once, not when the driver next collects garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes a table into the shared folder and reads it back: lineage is cut, and any executor may be lost."""
    spark = df.sparkSession
    path = new_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cores(spark: SparkSession) -> int:
    return max(1, spark.sparkContext.defaultParallelism)


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores where a table has fewer splits than that (a few small files); larger tables stay as they are.

    Only for plans without an exchange: asking a plan for its partitions would run the stages before one.
    """
    n = cores(df.sparkSession)
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)
