"""Tables in the folder that driver and executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, one in /tmp if all of Spark runs in this process; on a cluster that is refused."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file:///tmp/checkpoints/sortweave"


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def keep(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it again: cuts lineage, survives lost executors, and fixes
    whatever a second evaluation might deal out otherwise (partition ids, ranges)."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The paths that are made inside, for ``release`` once nothing reads them any more."""
    before, paths = len(_made), []
    try:
        yield paths
    finally:
        paths += _made[before:]


def release(spark: SparkSession, paths: Sequence[str] | None = None) -> None:
    """Deletes these tables, or all that operators have kept in this process; call it once results that read them are written."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for name in list(_made if paths is None else paths):
        if name in _made:
            _made.remove(name)
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(conf).delete(path, True)
