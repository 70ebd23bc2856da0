"""A sorted order cut into runs of equal length, without a window over the whole of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrille.sources.staging import kept

c = F.col


def placed(rows: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """rows with place, their number in the order from 0, and how many rows there are.

    Rows are sorted within range partitions, so a place is the row's number there and what the partitions before it hold: a
    table with a row for each partition. Rows that are equal in the order are put in any order, and may lie in several
    partitions; nulls come first.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    ranged = tied.repartitionByRange(parts, *order, "_tie").sortWithinPartitions(*order, "_tie").drop("_tie")
    ranged, told = kept(ranged.withColumn("_at", F.monotonically_increasing_id()), n=F.count(F.lit(1)))
    part = F.shiftright("_at", 33)
    before = F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = ranged.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("_first")).select("_part", "_first", F.coalesce(before, F.lit(0)).alias("_before"))
    out = ranged.join(F.broadcast(starts), part == c("_part"))  # a row for each partition
    return out.withColumn("place", c("_at") - c("_first") + c("_before")).drop("_at", "_part", "_first", "_before"), told["n"]


def equal_runs(rows: DataFrame, order: list[str], runs: int) -> DataFrame:
    """rows with place and run, from 0: contiguous runs of the order whose lengths differ by one at most; with fewer rows
    than runs some runs are empty."""
    out, n = placed(rows, order)
    # the first n % runs runs have one row more
    less, more = n // runs, n % runs
    edge = more * (less + 1)
    run = F.when(c("place") < edge, F.expr(f"place div {less + 1}")).otherwise(F.expr(f"{more} + (place - {edge}) div {max(1, less)}"))
    return out.withColumn("run", run.cast("int"))
