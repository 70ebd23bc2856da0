"""Running error counts over a stream of files, and a sink that keeps the violations of each batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def events(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def counts(stream: DataFrame, key: str) -> DataFrame:
    """Counts by key so far; the state is a number for each key."""
    return stream.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def write_violations(stream: DataFrame, condition: Column, path: str, checkpoint: str) -> StreamingQuery:
    """Appends the rows that violate a rule to path, each batch once."""
    return stream.filter(condition).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
