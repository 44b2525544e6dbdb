"""Folders that every executor can reach."""

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession, what: str) -> str:
    """A fresh path for an intermediate table below the session's checkpoint folder.

    That is `spark.checkpoint.dir`, else the one given to `setCheckpointDir`.
    Where neither is set a temporary folder serves a local master (tests); on a
    cluster it would be another folder on each machine, so that is an error.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if sc.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="permway-")
        sc.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"
    _made.setdefault(sc.applicationId, []).append(path)
    return path


def staged(df: DataFrame, what: str) -> DataFrame:
    """`df` written once below the shared folder and read back, so that several uses compute it once and a lost executor loses none of it."""
    spark = df.sparkSession
    path = shared_dir(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables that are made inside are deleted at its end, so a long application doesn't gather them."""
    before = set(_made.get(spark.sparkContext.applicationId, []))
    try:
        yield
    finally:
        release(spark, before)


def release(spark: SparkSession, keep: set[str] = frozenset()) -> None:
    """Delete the intermediate tables of this application but those of `keep`. Frames that read them can't be used afterwards."""
    sc = spark.sparkContext
    made = _made.pop(sc.applicationId, [])
    _made[sc.applicationId] = [p for p in made if p in keep]
    for path in (p for p in made if p not in keep):
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _release_at_exit() -> None:
    spark = SparkSession.getActiveSession() if any(_made.values()) else None
    if spark is not None and spark.sparkContext._jsc is not None:
        try:
            release(spark)
        except Exception as e:  # the JVM may be gone; then the cluster's own clean-up of the folder remains
            print(f"intermediate tables were not deleted: {type(e).__name__}")
