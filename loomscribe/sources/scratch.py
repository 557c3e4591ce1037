"""Tables between the steps of a job, in the shared folder that the session names.

A written table cuts the lineage and survives lost executors, unlike a local checkpoint.
``spark.checkpoint.dir`` names the folder; only a local session without one gets a temporary
folder, as on a cluster no executor would see another's files.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a local session without one gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Bytes of a stored table or of a shuffle that a task takes at most.
PART_BYTES = 16 << 20


def small_parts(spark: SparkSession) -> None:
    """Bound the rows that a task holds: paths and names repeat so much that a stored megabyte is some 35 of rows."""
    for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes"):
        if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) > PART_BYTES:
            spark.conf.set(key, str(PART_BYTES))


@contextmanager
def measured_joins(spark: SparkSession) -> Iterator[None]:
    """What is computed inside broadcasts a side of a join only by the bytes that its rows took in a shuffle.

    Spark else goes by the size of stored tables, and plans and paths repeat so much that 10 MB of them may be
    gigabytes of rows in the driver.
    """
    planned, measured = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    before = {key: spark.conf.get(key, None) for key in (planned, measured)}
    spark.conf.set(measured, before[measured] or spark.conf.get(planned))
    spark.conf.set(planned, "-1")
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def _file_system(spark: SparkSession, path: str):
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(context._jsc.hadoopConfiguration()), at


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, if it is there."""
    files, at = _file_system(spark, path)
    files.delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    files, at = _file_system(spark, path)
    return files.exists(at)


def move(spark: SparkSession, source: str, target: str) -> bool:
    """Rename a folder; False if the target is there already."""
    files, at = _file_system(spark, source)
    to = _file_system(spark, target)[1]
    return not files.exists(to) and files.rename(at, to)


class Workspace:
    """The tables of one job's steps, in a folder of their own.

    Tables that a lazy result still reads must stay; ``drop`` deletes those that nothing needs.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.paths: dict[str, str] = {}

    def save(self, df: DataFrame, step: str, **measures: Column) -> tuple[DataFrame, dict] | DataFrame:
        """Write ``df`` and read it back; with ``measures``, also their values over its rows."""
        path = self.paths[step] = f"{self.folder}/{step}-{uuid.uuid4().hex[:8]}"
        seen = Observation() if measures else None
        if seen is not None:
            df = df.observe(seen, *(c.alias(n) for n, c in measures.items()))
        df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        return table if seen is None else (table, seen.get)

    def drop(self, *steps: str) -> None:
        """Delete the tables that the steps have written last."""
        for step in steps:
            delete(self.spark, self.paths.pop(step))
