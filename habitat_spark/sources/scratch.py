"""Tables between the stages of a run: written to the shared folder and read back, so that plans and lineage stay short."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset, a temporary one in local mode only."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    base = tempfile.mkdtemp(prefix="habitat-")
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def stored(df: DataFrame, name: str = "stage") -> DataFrame:
    """df written and read back; it outlives executors."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.scratch_path = path
    for found in _collecting:
        found.append(table)
    return table


_collecting: list[list[DataFrame]] = []


@contextlib.contextmanager
def collected() -> Iterator[list[DataFrame]]:
    """All tables stored inside, so that they can be discarded when nothing reads them any more."""
    found: list[DataFrame] = []
    _collecting.append(found)
    try:
        yield found
    finally:
        _collecting[:] = [x for x in _collecting if x is not found]


def discard(*tables: DataFrame) -> None:
    """Remove stored tables that nothing will read again; ones that are gone already don't matter."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.scratch_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file on whatever file system the path is of, by Hadoop's own client."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
