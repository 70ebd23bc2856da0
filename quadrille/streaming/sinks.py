"""Errors of a run as they come: a sink that keeps each batch once, statistics that grow with it, and the readers.

A folder has `errors/batch=<n>/run_id=<r>/spatial=<true|false>` (Parquet) and `statistics/batch=<n>`, counts by code,
severity and table of that batch alone. A batch writes its errors first and its counts last, over whatever an earlier
attempt left, so one that runs twice counts once; a batch without counts is not there yet. Totals are sums of the counts,
a row for each batch and key, however many errors there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from quadrille.sources.store import Files

c = F.col
TEXTS = ("run_id", "code", "severity", "table_id", "table_name", "feature_id", "message", "geometry")
#: An error as it is written: the place is x and y, or the first point of its geometry.
ERRORS = StructType([*(StructField(n, StringType()) for n in TEXTS), StructField("x", DoubleType()), StructField("y", DoubleType())])
_COUNTS = "run_id string, code string, severity string, table_name string, n long, errors long, warnings long"


def spatial() -> Column:
    """The error has a place: coordinates other than 0, 0, or a geometry."""
    return ((F.coalesce(c("x"), F.lit(0.0)) != 0) | (F.coalesce(c("y"), F.lit(0.0)) != 0) | (F.trim(F.coalesce("geometry", F.lit(""))) != "")).alias("spatial")


def counts(errors: DataFrame) -> DataFrame:
    """Errors by run, code, severity and table, with what counts as errors and as warnings."""
    warned = F.coalesce(c("severity") == "Warning", F.lit(False))
    return errors.groupBy("run_id", "code", "severity", "table_name").agg(F.count(F.lit(1)).alias("n"), F.count_if(~warned).alias("errors"), F.count_if(warned).alias("warnings"))


def write_batch(errors: DataFrame, batch: int, path: str) -> None:
    """One batch of errors; writing it again replaces it."""
    kept = errors.select(*ERRORS.names, spatial()).persist()
    try:
        kept.write.mode("overwrite").partitionBy("run_id", "spatial").parquet(f"{path}/errors/batch={batch}")
        counts(kept).coalesce(1).write.mode("overwrite").parquet(f"{path}/statistics/batch={batch}")
    finally:
        kept.unpersist()


def write_errors(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """A stream of errors to a folder, batch by batch. Null run ids are a run of their own."""
    return stream.writeStream.foreachBatch(lambda df, n: write_batch(df, n, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _batches(spark: SparkSession, path: str) -> list[str]:
    """Batches whose counts are there."""
    files = Files(spark, path)
    return [n for n in files.names(f"{path}/statistics") if n.startswith("batch=") and "_SUCCESS" in files.names(f"{path}/statistics/{n}")]


def read_errors(spark: SparkSession, path: str, run_id: str | None = None, placed: bool | None = None) -> DataFrame:
    """The errors of whole batches; of one run, and of those with a place or without, only that part of the files is read."""
    folders = [f"{path}/errors/{b}" for b in _batches(spark, path)]
    folders = [f for f in folders if any(n.startswith("run_id=") for n in Files(spark, path).names(f))]
    schema = StructType([*(f for f in ERRORS if f.name != "run_id"), StructField("run_id", StringType())])
    if not folders:
        return spark.createDataFrame([], ERRORS).withColumn("spatial", F.lit(False))
    out = spark.read.schema(schema.add("spatial", "boolean").add("batch", "long")).option("basePath", f"{path}/errors").parquet(*folders)
    if run_id is not None:
        out = out.filter(c("run_id") == run_id)
    if placed is not None:
        out = out.filter(c("spatial") == placed)
    return out.select(*ERRORS.names, "spatial")


def statistics(spark: SparkSession, path: str) -> DataFrame:
    """Totals so far by run, code, severity and table."""
    folders = [f"{path}/statistics/{b}" for b in _batches(spark, path)]
    every = spark.read.schema(_COUNTS).parquet(*folders) if folders else spark.createDataFrame([], _COUNTS)
    return every.groupBy("run_id", "code", "severity", "table_name").agg(*[F.sum(k).alias(k) for k in ("n", "errors", "warnings")])


def write_json(errors: DataFrame, path: str) -> None:
    """One JSON object a line; nulls are left out."""
    errors.select(F.to_json(F.struct(*errors.columns)).alias("value")).write.text(path)


def read_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Errors from lines of JSON whose property names may be in any case, and the lines that are none (value). Blank
    lines are passed over, unknown properties left out, missing ones null."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    told = lines.select("value", F.from_json("value", "map<string,string>", {"mode": "PERMISSIVE"}).alias("m"))
    named = told.withColumn("m", F.map_from_entries(F.transform(F.array_distinct(F.transform(F.map_keys("m"), lambda k: F.lower(k))), lambda k: F.struct(k.alias("key"), F.element_at(F.filter(F.map_entries("m"), lambda e: F.lower(e["key"]) == k), -1)["value"].alias("value")))))
    good = named.filter("m IS NOT NULL").select(*[c("m")[f.name].try_cast(f.dataType).alias(f.name) for f in ERRORS])
    return good, told.filter("m IS NULL").select("value")
