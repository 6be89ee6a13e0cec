"""Reading tables and cutting lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own_folders: dict[str, str | None] = {}
#: Bytes up to which a table in a few files is spread over the cores.
SMALL = 256 * 2**20


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` over all cores, if it is small and in fewer files than there are cores: else a parquet file with one row group,
    however long its texts take, is one task. Larger tables, and tables in many files, stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores, key) if size <= SMALL and len(df.inputFiles()) < cores else df


def texts(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    return spread(table(spark, sf_dir, name), key)


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``); a local one of our own only where a local session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        application = spark.sparkContext.applicationId
        found = _own_folders.setdefault(application, None) or tempfile.mkdtemp(prefix="corpusloom-")
        _own_folders[application] = found
    return found


def _own(spark: SparkSession) -> str:
    return f"{scratch_dir(spark).rstrip('/')}/corpusloom-{spark.sparkContext.applicationId}"


_scope: ContextVar[str] = ContextVar("scope", default="shared")


@contextmanager
def scope(name: str) -> Iterator[str]:
    """Tables stored inside belong to one result and can be released with it: gives the name for ``release``."""
    token = _scope.set(f"{name}-{uuid.uuid4().hex}")
    try:
        yield _scope.get()
    finally:
        _scope.reset(token)


def release(spark: SparkSession, of: str | None = None) -> None:
    """Delete the tables stored in one scope, or all of this application. Results that still read them must have been consumed or written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{_own(spark)}/{of}" if of else _own(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    What reads the result survives the loss of executors, starts from a stored table instead of the whole lineage, and is
    planned with the table's real size, so that joins broadcast a side only if it is below
    ``spark.sql.autoBroadcastJoinThreshold``.
    """
    spark = df.sparkSession
    path = f"{_own(spark)}/{_scope.get()}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
