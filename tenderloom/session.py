"""Session helpers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", app: str = "tenderloom", partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "12g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it.

    Only where none is set and the master is local (tests) is one chosen here.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return _local_folder()


@cache
def _local_folder() -> str:
    folder = tempfile.mkdtemp(prefix="tenderloom-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


_recorders: list[list[str]] = []


@contextmanager
def recorded_tables():
    """The paths of the tables that `cut_lineage` writes meanwhile."""
    paths: list[str] = []
    _recorders.append(paths)
    try:
        yield paths
    finally:
        _recorders.remove(paths)


def remove_tables(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables that `cut_lineage` wrote and nothing reads any more."""
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame, by: str | None = None) -> DataFrame:
    """The rows as a written table in the shared folder.

    Computed once, survives lost executors, prunes columns when read, and leaves later
    plans with a single scan instead of everything that led here. With ``by`` rows of a key lie
    in one bucket, so that grouping by it moves nothing.
    """
    spark = df.sparkSession
    name = uuid.uuid4().hex
    path = f"{shared_folder(spark)}/tenderloom/{name}"
    if by:
        buckets = parallelism(spark)
        df.repartition(buckets, by).write.format("parquet").bucketBy(buckets, by).option("path", path).saveAsTable(f"tenderloom_{name}")
    else:
        df.write.parquet(path)
    for paths in _recorders:
        paths.append(path)
    return spark.table(f"tenderloom_{name}") if by else spark.read.schema(df.schema).parquet(path)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
