"""Greedy clusters of places, as a scan in order gives them, found in parallel rounds.

The scan takes each place that is not taken yet as a seed, and with it all that lie within reach of it. So a place is a
seed when no earlier seed is within reach, and any other place belongs to the first seed within its reach. Rounds find
the seeds: places stand in cells in which any two are within reach, so only the first open place of a cell can be a
seed, and it is one when no earlier open place of the cells around is within reach. What a new seed reaches is closed.
A round costs each open place some two dozen comparisons, however many lie in one cell or at one spot.
"""

from __future__ import annotations

import logging
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.sources.staging import kept

c = F.col
_AROUND = 2  # cells on each side that a reach meets, at 1/sqrt(2) of it an edge

#: From the least to the highest; others come below.
SEVERITIES = ("INFO", "MINOR", "MAJOR", "CRIT")


def _cell(reach: float) -> dict[str, Column]:
    edge = reach / math.sqrt(2) * (1 - 1e-9)
    return {"cx": F.floor(c("x") / edge), "cy": F.floor(c("y") / edge)}


def _around(df: DataFrame) -> DataFrame:
    """df (nth, x, y, cx, cy) as rows of the cells that its reach meets: _nth, _x, _y and the cell."""
    steps = F.array(*[F.lit(k) for k in range(-_AROUND - 1, _AROUND + 2)])
    wide = df.withColumn("_dx", F.explode(steps)).withColumn("_dy", F.explode(steps))
    return wide.select(c("nth").alias("_nth"), c("x").alias("_x"), c("y").alias("_y"), (c("cx") + c("_dx")).alias("cx"), (c("cy") + c("_dy")).alias("cy"))


def _near(reach: float) -> Column:
    return F.sqrt((c("x") - c("_x")) * (c("x") - c("_x")) + (c("y") - c("_y")) * (c("y") - c("_y"))) <= reach


def seeds(places: DataFrame, reach: float) -> DataFrame:
    """The seeds among places (nth: their order, each once; x, y at distinct spots): nth, x, y, cx, cy."""
    log = logging.getLogger(__name__)
    open_, told = kept(places.select("nth", "x", "y").withColumns(_cell(reach)), n=F.count(F.lit(1)))
    found, rounds = None, 0
    while told["n"]:
        rounds += 1
        first = open_.groupBy("cx", "cy").agg(F.min(F.struct("nth", "x", "y")).alias("m")).select("cx", "cy", "m.*")
        # places within reach of an earlier open one: of the firsts of cells only those matter
        blocked = _around(first).join(open_, ["cx", "cy"]).filter((c("nth") < c("_nth")) & _near(reach)).select(c("_nth").alias("nth")).distinct()
        new, _ = kept(first.join(blocked, "nth", "left_anti"))
        closed = _around(new).join(open_, ["cx", "cy"]).filter(_near(reach)).select("nth").distinct()
        open_, told = kept(open_.join(closed, "nth", "left_anti"), n=F.count(F.lit(1)))
        found = new if found is None else found.unionByName(new)
        log.info("round %d leaves %d places", rounds, told["n"])
    return found if found is not None else open_


def cluster_greedy(errors: DataFrame, reach: float = 100.0) -> DataFrame:
    """cluster, size, x, y, type, severity: the clusters of errors (nth, x, y, type, severity) that a scan in the order of
    nth forms: the nth of its seed, how many it has, their mean place, the most frequent type (of equally frequent ones
    the first to come) and the highest severity.

    Errors at one spot are one place for the search, so a spot that many share costs one. Rows that repeat an nth are
    errors each. Rows without nth, x or y have no place and are left out; an empty table has no cluster. The number of rounds
    follows from how far decisions depend on earlier ones: some for places in no special order, and up to half of all
    places where each lies just within reach of the one before.
    """
    rows, _ = kept(errors.filter("nth IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL").select("nth", c("x").cast("double").alias("x"), c("y").cast("double").alias("y"), "type", "severity"))
    places, _ = kept(rows.groupBy("x", "y").agg(F.min("nth").alias("nth")))
    # spots may share an order, but each must have its own: by x and y
    doubles = places.groupBy("nth").count().filter("count > 1")
    if not doubles.isEmpty():
        raise ValueError("rows of one nth lie at several places: the order of a scan must tell places apart")
    met = _around(seeds(places, reach)).join(places.withColumns(_cell(reach)), ["cx", "cy"]).filter(_near(reach))
    home, _ = kept(met.groupBy(c("x").alias("hx"), c("y").alias("hy")).agg(F.min("_nth").alias("cluster")))
    own = rows.join(home, (c("x") == c("hx")) & (c("y") == c("hy")))
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, SEVERITIES)), c("severity")), F.lit(0))
    whole = own.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.avg("x").alias("x"), F.avg("y").alias("y"), F.max_by("severity", F.struct(rank, -c("nth"))).alias("severity"))
    kinds = own.groupBy("cluster", "type").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(c("nth") != c("cluster"), "nth")).alias("first"))
    most = kinds.groupBy("cluster").agg(F.min_by("type", F.struct(-c("n"), "first")).alias("type")).withColumnRenamed("cluster", "_cluster")
    return whole.join(most, c("cluster") == c("_cluster")).select("cluster", "size", "x", "y", "type", "severity")
