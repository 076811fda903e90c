"""Tables of intermediate rows in the folder that driver and executors share, and bounded Arrow batches."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

ARROW_BYTES = 16 << 20
_made: list[str] = []
_open: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset a local session takes a temporary one; a cluster must name it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(folder)
        return folder.rstrip("/")
    folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="fairway-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_table(spark: SparkSession, name: str) -> str:
    """Path for a table of intermediate rows in the shared folder. It goes with its ``scratch``, else when the driver ends."""
    path = f"{shared_dir(spark)}/fairway-{name}-{uuid.uuid4().hex}"
    (_open[-1] if _open else _made).append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage by a table in the shared folder. Shuffle files of the write go when it has ended."""
    path = new_table(df.sparkSession, name)
    write(df, path)
    return df.sparkSession.read.parquet(path)


def write(df: DataFrame, path: str) -> None:
    spark = df.sparkSession
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a table in the shared folder."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables made inside are removed at its end; what is to stay must have been written by then."""
    made: list[str] = []
    _open.append(made)
    try:
        yield
    finally:
        _open.remove(made)
        for path in made:
            delete(spark, path)


@atexit.register
def _tidy() -> None:
    """Remove the tables that lazily built results still needed."""
    gateway = SparkContext._gateway
    if gateway is None or not _made:
        return
    with contextlib.suppress(Exception):  # the driver ends; whatever a dead JVM leaves is for the folder's owner
        conf = gateway.jvm.org.apache.hadoop.conf.Configuration()
        for path in _made:
            p = gateway.jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)


def bounded_batches(spark: SparkSession, limit: int = ARROW_BYTES) -> None:
    """Arrow batches end at ``limit`` bytes (16 MB) as well as at their number of rows, for very long texts."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if now is None or not str(now).isdigit() or int(now) > limit or int(now) <= 0:
        spark.conf.set(key, str(limit))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(names: list[str], wanted: str) -> str:
    """A column name like ``wanted`` that none of the names is, in any case."""
    taken = {n.lower() for n in names}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted
