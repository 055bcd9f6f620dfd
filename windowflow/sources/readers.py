"""Bounded and unbounded inputs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


MALFORMED = "_malformed"


def text_lines(spark: SparkSession, path: str, schema: str, sep: str = " ") -> DataFrame:
    """Every line of separated text with a declared schema: its columns, and the line itself in MALFORMED where it doesn't fit."""
    parsed = F.from_csv("value", f"{schema}, {MALFORMED} string", {"sep": sep, "columnNameOfCorruptRecord": MALFORMED})
    return spark.read.text(path).select(parsed.alias("v")).select("v.*")


def text_file(spark: SparkSession, path: str, schema: str, sep: str = " ") -> DataFrame:
    """The well-formed rows of separated text; ``malformed_lines`` has the others, so that none goes unseen."""
    return text_lines(spark, path, schema, sep).filter(F.col(MALFORMED).isNull()).drop(MALFORMED)


def malformed_lines(spark: SparkSession, path: str, schema: str, sep: str = " ") -> DataFrame:
    return text_lines(spark, path, schema, sep).filter(F.col(MALFORMED).isNotNull()).select(MALFORMED)


def shifted(df: DataFrame, time: str, copies: int, span: int) -> DataFrame:
    """The same rows over and over, each copy ``span`` later than the one before, from one scan."""
    again = df.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    return again.withColumn(time, (F.col(time) + F.col("_copy") * span).cast(df.schema[time].dataType)).drop("_copy")


def file_stream(spark: SparkSession, path: str, schema: StructType, kind: str = "parquet", files_per_trigger: int | None = 1) -> DataFrame:
    """A replayable stream of files in order of their modification; the rate is files per trigger."""
    reader = spark.readStream.format(kind).schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).load(path)


def table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A stream of one Parquet table, which may be a file of the folder or a folder of files."""
    table = spark.read.parquet(f"{folder}/{name}")
    reader = spark.readStream.schema(table.schema)
    if any(f.rstrip("/").endswith(f"/{name}") for f in table.inputFiles()):
        return reader.option("pathGlobFilter", name).parquet(folder)  # a file source takes folders alone
    return reader.parquet(f"{folder}/{name}")


def socket_stream(spark: SparkSession, host: str, port: int, schema: str, sep: str = ",") -> DataFrame:
    """Lines of a TCP socket; for tests, as a socket can't be replayed."""
    lines = spark.readStream.format("socket").option("host", host).option("port", port).load()
    return lines.select(F.from_csv("value", schema, {"sep": sep}).alias("v")).select("v.*")


def csv_blocks(df: DataFrame, sep: str = ",") -> Iterator[str]:
    """The rows as separated lines, some thousands in a string, one partition at a time."""

    def join(batches):
        for x in batches:
            if x.num_rows:
                yield pa.RecordBatch.from_pydict({"block": ["\n".join(x.column(0).to_pylist())]})

    lines = df.select(F.to_csv(F.struct("*"), {"sep": sep}).alias("line"))
    return (r.block for r in lines.mapInArrow(join, "block string").toLocalIterator())


def rate_stream(spark: SparkSession, rows_per_second: int) -> DataFrame:
    """(time in seconds, value) at a steady rate."""
    return spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load().select(F.unix_seconds("timestamp").alias("timestamp"), "value")
