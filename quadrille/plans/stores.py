"""Queries over tables in versions and over folders of errors."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from quadrille.operators import stages
from quadrille.plans.registry import query
from quadrille.sources import layers as L
from quadrille.sources import store
from quadrille.sources.staging import shared_dir
from quadrille.streaming import sinks

_ERRORS = StructType([StructField("error_id", LongType()), StructField("kind", StringType()), StructField("status", StringType())])


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("SELECT event_id AS error_id, CASE WHEN event_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') THEN 'moved' ELSE event_type END AS kind, CASE WHEN event_id IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) THEN 'fixed' ELSE 'open' END AS status FROM events UNION ALL SELECT -1 - s_suppkey, 'new', 'open' FROM supplier")
def store_upsert(spark, sf_dir):
    """A table of errors that takes new and changed rows by key, and the status of those that a list of ids names."""
    t = store.Store.create(spark, _folder(spark, "errors"), _ERRORS, ["error_id"], buckets=8)
    events = L.read(spark, sf_dir, "events").select(F.col("event_id").alias("error_id"), F.col("event_type").alias("kind"), F.lit("open").alias("status"))
    t.upsert(events, "all")
    moved = L.read(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("error_id")).join(events, "error_id").withColumn("kind", F.lit("moved"))
    new = L.read(spark, sf_dir, "supplier").select((-1 - F.col("s_suppkey")).alias("error_id"), F.lit("new").alias("kind"), F.lit("open").alias("status"))
    t.upsert(moved.select("error_id", "kind", "status").unionByName(new), "moved and new")
    fixed = L.read(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("error_id"))
    for _ in range(2):  # the second time changes nothing
        t.update(fixed, "fixed", status=F.lit("fixed"))
    return t.read()


@query("SELECT 'r1' AS run_id, 'Completed' AS status, count(*) FILTER (WHERE NOT value > 50) AS total_errors, count(*) FILTER (WHERE value > 50) AS total_warnings FROM events UNION ALL SELECT 'r2', 'Running', 0, 0")
def run_open_close(spark, sf_dir):
    """Two runs are opened; one is closed with the counts of its errors."""
    runs = store.Store.create(spark, _folder(spark, "runs"), store.RUNS, ["run_id"], buckets=2)
    at = datetime.datetime(2024, 1, 1)
    errors = L.read(spark, sf_dir, "events").select(F.lit("r1").alias("run_id"), F.when(F.col("value") > 50, "Warning").otherwise("Error").alias("severity"))
    store.open_run(runs, "r1", at)
    store.open_run(runs, "r2", at)
    store.close_run(runs, "r1", at, errors)
    return runs.read().select("run_id", "status", "total_errors", "total_warnings")


_SUNK = "(SELECT CASE WHEN event_id % 3 = 0 THEN 'r1' ELSE 'r2' END AS run_id, event_type AS code, CASE WHEN value > 50 THEN 'Warning' ELSE 'Error' END AS severity, 't' AS table_name, event_id % 5 = 0 AS unplaced FROM events)"


def _sunk(spark, sf_dir) -> str:
    k = F.col("event_id")
    made = {"run_id": F.when(k % 3 == 0, "r1").otherwise("r2"), "code": F.col("event_type"), "severity": F.when(F.col("value") > 50, "Warning").otherwise("Error"), "table_name": F.lit("t"), "feature_id": k.cast("string"), "x": F.when(k % 5 != 0, 1.0), "batch": k % 3}
    events = L.read(spark, sf_dir, "events").select(*[v.alias(n) for n, v in made.items()])
    errors = events.select(*[F.col(f.name) if f.name in events.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in sinks.ERRORS], "batch")
    path = _folder(spark, "sink")
    for batch in (0, 1, 1, 2):  # one batch is written twice
        sinks.write_batch(errors.filter(F.col("batch") == batch), batch, path)
    return path


@query(f"SELECT run_id, code, severity, table_name, count(*) AS n, count(*) FILTER (WHERE severity <> 'Warning') AS errors, count(*) FILTER (WHERE severity = 'Warning') AS warnings FROM {_SUNK} GROUP BY ALL")
def sink_statistics(spark, sf_dir):
    """Counts that batches of errors leave, one of which came twice."""
    return sinks.statistics(spark, _sunk(spark, sf_dir))


@query(f"SELECT code, severity, count(*) AS n FROM {_SUNK} WHERE run_id = 'r1' AND unplaced GROUP BY ALL")
def sink_read_back(spark, sf_dir):
    """One run's errors without a place, read back from the sink."""
    return sinks.read_errors(spark, _sunk(spark, sf_dir), "r1", placed=False).groupBy("code", "severity").agg(F.count(F.lit(1)).alias("n"))


_STAGE = """d AS (SELECT DISTINCT c_mktsegment AS table_id, 'EPSG:5186' AS crs, 'POLYGON' AS geometry_type FROM customer),
    a AS (SELECT DISTINCT c_nationkey AS dataset, lower(c_mktsegment) AS name, CASE WHEN c_nationkey % 4 = 1 AND c_mktsegment < 'C' THEN 'EPSG:4326' ELSE 'EPSG:5186' END AS actual_crs,
        CASE WHEN c_nationkey % 4 IN (1, 2) AND c_mktsegment > 'F' THEN NULL ELSE 'POLYGON' END AS actual_type FROM customer WHERE c_nationkey % 4 <> 3 OR c_mktsegment <> 'BUILDING'),
    n AS (SELECT dataset, (SELECT count(*) FROM d) - count(*) AS missing, count(*) FILTER (WHERE actual_crs IS DISTINCT FROM crs) AS crs, count(*) FILTER (WHERE actual_type IS DISTINCT FROM geometry_type) AS types FROM a JOIN d ON name = lower(table_id) GROUP BY dataset)"""


@query(f"""WITH {_STAGE} SELECT dataset, 1 AS nth, 'table_list' AS "check", CASE WHEN missing > 0 THEN 'failed' ELSE 'passed' END AS status, missing AS errors FROM n
    UNION ALL SELECT dataset, 2, 'coordinate_system', CASE WHEN missing > 0 THEN 'skipped' WHEN crs > 0 THEN 'failed' ELSE 'passed' END, CASE WHEN missing = 0 THEN crs END FROM n
    UNION ALL SELECT dataset, 3, 'geometry_type', CASE WHEN missing > 0 OR crs > 0 THEN 'skipped' WHEN types > 0 THEN 'failed' ELSE 'passed' END, CASE WHEN missing = 0 AND crs = 0 THEN types END FROM n""")
def table_stage(spark, sf_dir):
    """Checks of tables by dataset, in their order, each dataset up to its first failure."""
    customers = L.read(spark, sf_dir, "customer")
    k, segment = F.col("c_nationkey"), F.col("c_mktsegment")
    declared = customers.select(segment.alias("table_id"), segment.alias("table_name"), F.lit("EPSG:5186").alias("crs"), F.lit("POLYGON").alias("geometry_type")).distinct()
    actual = customers.filter((k % 4 != 3) | (segment != "BUILDING")).select(
        k.alias("dataset"), F.lower(segment).alias("name"), F.when((k % 4 == 1) & (segment < "C"), "EPSG:4326").otherwise("EPSG:5186").alias("actual_crs"), F.when(~(k % 4).isin(1, 2) | (segment <= "F"), "POLYGON").alias("actual_type")
    )
    return stages.table_stage(declared, actual.distinct())
