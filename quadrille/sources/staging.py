"""What is worked out once and read again: checkpoints in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a folder of our own for a local master; on a cluster ValueError."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="quadrille-")
        spark.conf.set("spark.checkpoint.dir", found)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def staged(df: DataFrame) -> DataFrame:
    """df written once as a table and read from there: what is made from it has a small plan, and reads only its columns."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def kept(df: DataFrame, **totals: Column) -> tuple[DataFrame, dict]:
    """df cut off from its lineage, and totals that the same job finds."""
    shared_dir(df.sparkSession)
    if not totals:
        return df.checkpoint(), {}
    seen = Observation()
    df = df.observe(seen, *(c.alias(k) for k, c in totals.items())).checkpoint()
    return df, seen.get
