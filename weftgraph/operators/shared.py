"""Tables in the folder that all executors share: states of iterations and whatever is read more than once."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []
_open: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset a local folder serves a local session (tests); on a cluster it is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir is not set: intermediate tables need a folder that all executors share")
    if not _local:
        _local.append("file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return _local[0]


def _write(df: DataFrame, name: str, owner: list[list[str]]) -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for paths in owner:
        paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df written to a new table and read back: later plans start there, nothing is computed twice, and a lost executor
    loses nothing."""
    return _write(df, name, _open[-1:])


def settled(df: DataFrame) -> DataFrame:
    """:func:`written` for the state of a round."""
    return written(df, "round")


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """All tables written inside are removed at the end. What comes is a function like :func:`written` for the tables that stay; these are
    left to the block around this one, if there is one."""
    _open.append([])
    try:
        yield lambda df, name: _write(df, name, _open[-2:-1])
    finally:
        for path in _open.pop():
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
