"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no shared folder (tests, a laptop).
LOCAL_FALLBACK = "/tmp/checkpoints"


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors see, from spark.checkpoint.dir."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = LOCAL_FALLBACK
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


_made: dict[str, list[str]] = {}


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the application's own in the shared root; release() removes it."""
    app = spark.sparkContext.applicationId
    if app not in _made:
        _made[app] = []
        atexit.register(_ended, spark)
    path = f"{shared_root(spark)}/{app}/{name}-{uuid.uuid4().hex}"
    _made[app].append(path)
    return path


def release(spark: SparkSession, keep: tuple[str, ...] = ()) -> None:
    """Remove the folders made so far, but for those whose names begin with one of keep; their DataFrames can no longer be read.

    Callers who are done with a result call it; what is left goes when the driver's Python ends.
    """
    made = _made.get(spark.sparkContext.applicationId, [])
    remove(spark, *[p for p in made if not (keep and p.rpartition("/")[2].startswith(keep))])


def remove(spark: SparkSession, *paths: str) -> None:
    """Remove folders of fresh_dir before the others: tables that nothing reads any more."""
    made = _made.get(spark.sparkContext.applicationId, [])
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        if path in made:
            made.remove(path)
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def _ended(spark: SparkSession) -> None:
    try:
        release(spark)
    except (AttributeError, Py4JError):  # the session has stopped before; the shared folder's owner clears it
        pass


#: Spark's setting to remove an execution's shuffle files when it ends.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(df: DataFrame, name: str, tidy: bool = False, path: str | None = None, files: int | None = None) -> DataFrame:
    """Cut lineage: write df to the shared folder and read it back, so that lost executors cost one re-read.

    With tidy, the shuffle files of the write go when it ends, not when the driver's memory is next cleared. path, from
    fresh_dir, is for callers who remove the table themselves. With files, the last step runs in so many tasks at most, each
    of which writes one file.
    """
    spark = df.sparkSession
    path = path or fresh_dir(spark, name)
    df = df.coalesce(files) if files else df
    before = spark.conf.get(TIDY, None)
    if tidy:
        spark.conf.set(TIDY, "true")
    try:
        df.write.parquet(path)
    finally:
        if tidy and before is not None:
            spark.conf.set(TIDY, before)
        elif tidy:
            spark.conf.unset(TIDY)
    return spark.read.schema(df.schema).parquet(path)
