"""Cutting lineage where a plan must not be evaluated twice.

A durable table is written as Parquet below the folder that the cluster names in ``spark.checkpoint.dir``, so
it outlives lost executors, its columns are pruned like any table's, and its files can be deleted as soon as nothing
reads them: at once with ``release``, or all that were made inside ``with scratch():`` at its end. Tables
made outside stay, like Spark's own checkpoints.
"""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_OPEN: list[list[tuple[SparkSession, str]]] = []


def folder(spark: SparkSession) -> str:
    """The shared folder; only a local session that names none gets a temporary one."""
    named = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return spark.sparkContext.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own beside the checkpoints, on storage that all executors share."""
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    if _OPEN:
        _OPEN[-1].append((spark, path))
    return path


#: While a table is written small shuffle partitions are joined up to Spark's advisory size, not spread over all cores: fewer tasks and files.
_JOINED_UP = "spark.sql.adaptive.coalescePartitions.parallelismFirst"
#: That size, compressed, is bounded: 64 MB of panes and keys are some ten million rows, and gigabytes in the task that groups them.
_ADVISED, _AT_MOST = "spark.sql.adaptive.advisoryPartitionSizeInBytes", 8 << 20


def _bytes(spark: SparkSession, size: str) -> int:
    return spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(size)


def durable(df: DataFrame) -> DataFrame:
    """``df`` written and read again; no rows are computed twice."""
    path, conf = new_folder(df.sparkSession, "table"), df.sparkSession.conf
    before = {k: conf.get(k) for k in (_JOINED_UP, _ADVISED)}
    conf.set(_JOINED_UP, "false")
    conf.set(_ADVISED, min(_AT_MOST, _bytes(df.sparkSession, before[_ADVISED])))
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            conf.set(k, v)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._durable_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes the files of durable tables that nothing will read any more."""
    for df in tables:
        remove(df.sparkSession, df._durable_path)


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """Folders made inside are deleted at the end; what is read from them must be written elsewhere before."""
    _OPEN.append([])
    try:
        yield
    finally:
        for spark, path in _OPEN.pop():
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder on any storage that Spark reaches; one that isn't there is no error."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
