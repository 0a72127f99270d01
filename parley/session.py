"""Session settings and staged tables."""

from __future__ import annotations

import os
import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
_STAGED: list[str] = []
_SCOPE = threading.local()


def local_session(cores: str = "8", partitions: int = 8, app: str = "parley") -> SparkSession:
    """Single-machine session for tests and the bench."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("PARLEY_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def stage_root(spark: SparkSession) -> str:
    """Shared folder for staged tables, as the cluster names it; a temporary one only in local mode."""
    context = spark.sparkContext
    root = spark.conf.get(CHECKPOINT_DIR, None) or context.getCheckpointDir()
    if not root:
        if not re.match(r"local(\[|$)", context.master):
            raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="parley-"))
        root = context.getCheckpointDir()
    return root.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back.

    Cuts lineage, survives the loss of executors, and gives later plans true sizes and cheap counts.
    """
    spark = df.sparkSession
    path = f"{stage_root(spark)}/parley/{name}-{uuid.uuid4().hex}"
    getattr(_SCOPE, "paths", _STAGED).append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_counted(df: DataFrame, name: str, count: Column) -> tuple[DataFrame, int]:
    """Stage df and take one count while it is written."""
    seen = Observation()
    staged = stage(df.observe(seen, count.alias("n")), name)
    return staged, seen.get["n"]


def path_exists(spark: SparkSession, folder: str) -> bool:
    """Is there a file below a folder?"""
    try:
        return not spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path").isEmpty()
    except AnalysisException:
        return False


def delete_folder(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_staged(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        delete_folder(df.sparkSession, folder)
        for paths in (_STAGED, getattr(_SCOPE, "paths", [])):
            paths[:] = [p for p in paths if p.rsplit("/", 1)[1] != folder.rsplit("/", 1)[1]]


@contextmanager
def staged_scope(spark: SparkSession) -> Iterator[None]:
    """Delete what this thread stages inside the block when it ends, also on failure."""
    outer = getattr(_SCOPE, "paths", None)
    _SCOPE.paths = paths = []
    try:
        yield
    finally:
        if outer is None:
            del _SCOPE.paths
        else:
            _SCOPE.paths = outer
        for path in paths:
            delete_folder(spark, path)


def release_stages(spark: SparkSession) -> None:
    """Delete every table this program staged. Call it when all results are written."""
    while _STAGED:
        delete_folder(spark, _STAGED.pop())


def tasks(spark: SparkSession) -> int:
    """Tasks for a step whose work is not in proportion to its input size."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame) -> DataFrame:
    """Spread an input that arrives in fewer splits than there are cores; larger inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
