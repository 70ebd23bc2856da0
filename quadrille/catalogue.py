"""The registered queries of the library, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.operators import attribute
from quadrille.plans import analytics, attributes, errors, lines, overlays, places, polygons, relations, shapes, stores  # noqa: F401  (they register their queries)
from quadrille.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
from quadrille.sources import layers


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules over a layer to errors, and the errors counted by rule."""
    rules = [("A1", "tn_buld", "height", "Range", (20, 200)), ("A2", "tn_buld", "code", "CodeList", (["BDK001", "BDK002"],)), ("A3", "*", "name", "NotNull", ())]
    found = attribute.run_rules({"tn_buld": layers.buildings(spark, sf_dir)}, rules)
    return found.groupBy("rule_id", "table_id").agg(F.count(F.lit(1)).alias("n"))
