"""Tables written once in the folder that the driver and every executor share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` where the session names one; only a session that names
    none (tests, one machine) gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="loomdag-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/loomdag-{spark.sparkContext.applicationId}"


#: Where the tables go that are written inside ``recording``.
_recorded: list[list[str]] = []


@contextlib.contextmanager
def recording() -> Iterator[list[str]]:
    """The paths of all tables that are written inside the block."""
    paths: list[str] = []
    _recorded.append(paths)
    try:
        yield paths
    finally:
        _recorded.remove(paths)


def drop_tables(spark: SparkSession, paths: list[str]) -> None:
    """Delete written tables that nothing reads any more."""
    for p in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet and read it back: a lost executor costs a re-read."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    for paths in _recorded:
        paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete every table that this session has written."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
