"""Connected components of a table of links, by rounds of stars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from quadrille.llm.common import join_counted, shared_dir


#: Links that one task of a round holds at least; small tables are not spread over hundreds of files.
TASK_LINKS = 20_000


def fitted(df: DataFrame, rows: int | None) -> DataFrame:
    """df in as many parts as so many rows fill, and the session's shuffle partitions at most; as it is without rows."""
    if rows is None:
        return df
    return df.coalesce(max(1, min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), max(4, rows // TASK_LINKS))))


def kept(df: DataFrame, rows: int | None = None, *more: Column) -> tuple[DataFrame, tuple]:
    """df cut off from its lineage, and what the same job finds: sum and greatest of `_n`, then more. With rows, in as
    many parts as these fill."""
    seen = Observation()
    totals = (F.sum("_n"), F.max("_n"), *more)
    df = fitted(df.observe(seen, *(t.alias(f"_{k}") for k, t in enumerate(totals))), rows).checkpoint()
    return df, tuple(seen.get[f"_{k}"] or 0 for k in range(len(totals)))


def _least(seen: DataFrame, rows: int, *more: Column) -> tuple[DataFrame, tuple]:
    return kept(seen.groupBy(F.col("u").alias("of")).agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count(F.lit(1)).alias("_n")), rows, *more)


def components(links: DataFrame, rows: int | None = None) -> DataFrame:
    """node, root for each node of links (a, b): root is the smallest node that it reaches.

    A round is a large star (each node's larger neighbours move to its smallest one) and a small star (so do its smaller
    neighbours and itself). Rounds go on until links are stars: until no node has a smaller neighbour beside another
    one. Each step is cut off by a checkpoint, and hubs are aggregated before they are joined. rows: about how many links
    there are, where that is known; the first step and the maps of each round then are in as many parts as links fill.
    """
    spark, narrow = links.sparkSession, rows is not None
    shared_dir(spark)
    links, (rows, _) = kept(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().withColumn("_n", F.lit(1)), rows)
    while True:
        seen = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least, (total, top, between) = _least(seen, rows, F.count_if((F.col("m") < F.col("of")) & (F.col("_n") > 1)))
        if not between:
            break
        seen = join_counted(seen, least, "u", totals=(total, top)).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        seen, _ = kept(seen.withColumn("_n", F.lit(1)), rows)  # as many links as before, equal ones among them
        seen = seen.select("u", "v")
        least, totals = _least(seen, rows)
        moved = join_counted(seen, least, "u", totals=totals).filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        moved = moved.unionByName(least.select(F.col("of").alias("a"), F.col("m").alias("b")))
        moved = fitted(moved, rows) if narrow else moved
        links, (rows, _) = kept(moved.distinct().withColumn("_n", F.lit(1)), rows)
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
