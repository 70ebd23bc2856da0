"""Stages of checks in an order: a stage that fails stops those behind it.

`run` takes stages one after the other, for checks that are work: each is run once, and none behind the one that stops.
`table_stage` judges many datasets at once in one plan, since its checks are counts of metadata.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.operators import schema
from quadrille.sources.staging import kept

c = F.col


@dataclass
class Stage:
    """A name, what gives its errors (given those of the stages before, by name), and whether errors stop what follows."""

    name: str
    check: Callable[[dict[str, DataFrame]], DataFrame]
    stops: bool = True


def run(spark: SparkSession, stages: list[Stage]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """nth, stage, status (passed, failed, skipped, error), errors and message of each stage, and the errors themselves. A check
    that raises has status error and stops what follows; errors are kept once and counted by the same job."""
    rows, found, stopped = [], {}, False
    for nth, stage in enumerate(stages, 1):
        if stopped:
            rows.append((nth, stage.name, "skipped", None, None))
            continue
        try:
            errors, told = kept(stage.check(dict(found)), n=F.count(F.lit(1)))
        except Exception as e:
            rows.append((nth, stage.name, "error", None, f"{type(e).__name__}: {e}"[:1000]))
            stopped = True
            continue
        found[stage.name] = errors
        rows.append((nth, stage.name, "failed" if told["n"] else "passed", told["n"], None))
        stopped = bool(told["n"]) and stage.stops
    return spark.createDataFrame(rows, "nth int, stage string, status string, errors long, message string"), found


def table_stage(declared: DataFrame, actual: DataFrame) -> DataFrame:
    """dataset, nth, check, status, errors: the three checks of each dataset's tables in their order: the list of tables (all
    declared ones are there), their coordinate systems, their geometry types. The first that fails stops the dataset.

    declared: table_id, table_name, crs, geometry_type; actual: dataset, name, actual_crs, actual_type. Names are compared
    in any case; a null system or type counts as different. Datasets without tables are unknown here.
    """
    datasets = actual.select("dataset").distinct()
    # a declared table is there under its id or its name
    names = declared.select("table_id", F.explode(F.array_distinct(F.array(F.lower("table_id"), F.lower("table_name")))).alias("_name"))
    there = actual.select(c("dataset").alias("_dataset"), F.lower("name").alias("_have")).join(names, c("_have") == c("_name")).select("_dataset", c("table_id").alias("_id")).distinct().groupBy("_dataset").agg(F.count(F.lit(1)).alias("have"))
    total = declared.select("table_id").distinct().agg(F.count(F.lit(1)).alias("all"))
    met = schema.matched(declared, actual).groupBy(c("dataset").alias("_dataset")).agg(F.count_if(~c("crs").eqNullSafe(c("actual_crs"))).alias("crs"), F.count_if(~c("geometry_type").eqNullSafe(c("actual_type"))).alias("types"))
    same = lambda df: datasets.dataset == df._dataset
    counted = datasets.join(there, same(there), "left").drop("_dataset").join(met, same(met), "left").drop("_dataset").join(F.broadcast(total))  # one row
    zero = F.lit(0).cast("long")
    checks = [("table_list", c("all") - F.coalesce("have", zero)), ("coordinate_system", F.coalesce("crs", zero)), ("geometry_type", F.coalesce("types", zero))]
    rows, failed = [], F.lit(False)
    for nth, (name, n) in enumerate(checks, 1):
        status = F.when(failed, "skipped").when(n > 0, "failed").otherwise("passed")
        rows.append(F.struct(F.lit(nth).alias("nth"), F.lit(name).alias("check"), status.alias("status"), F.when(~failed, n).alias("errors")))
        failed = failed | (n > 0)
    return counted.select("dataset", F.explode(F.array(*rows)).alias("r")).select("dataset", "r.*")
