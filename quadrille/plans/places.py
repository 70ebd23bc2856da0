"""Queries of coordinate systems and clusters of places."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from quadrille.functions import crs
from quadrille.operators import cluster
from quadrille.plans.registry import query
from quadrille.sources import layers as L


def _series(x: str, y: str, table, sign: str, system: crs.Crs, of: str) -> str:
    """The published series."""
    n = 1 / (2 * system.inverse_flattening - 1)
    terms = [sum(c * n**k for k, c in enumerate(row, 1)) for row in table]
    wave = {"xi": "sin({0} * {1}) * cosh({0} * {2})", "eta": "cos({0} * {1}) * sinh({0} * {2})"}[of]
    return f"{x if of == 'xi' else y} {sign} (" + " + ".join(f"{c!r} * " + wave.format(2 * j, x, y) for j, c in enumerate(terms, 1)) + ")"


def _to_degrees(system: crs.Crs) -> str:
    """From m (fid, x, y) to g (fid, lon, lat): the latitude closes in on the one that has the conformal latitude."""
    k, e = system.k0 * system.radius, math.sqrt(system.e2)
    closer = lambda n: f"p{n} AS (SELECT fid, lon, chi, 2 * atan(tan(pi() / 4 + chi / 2) * pow((1 + {e!r} * sin(phi)) / (1 - {e!r} * sin(phi)), {e / 2!r})) - pi() / 2 AS phi FROM p{n - 1})"
    return f""", m1 AS (SELECT fid, (y - {system.north}) / {k!r} + {system.rise!r} AS xi, (x - {system.east}) / {k!r} AS eta FROM m),
    m2 AS (SELECT fid, {_series('xi', 'eta', crs.BACKWARD, '-', system, 'xi')} AS xi, {_series('xi', 'eta', crs.BACKWARD, '-', system, 'eta')} AS eta FROM m1),
    p0 AS (SELECT fid, atan2(sinh(eta), cos(xi)) AS lon, asin(sin(xi) / cosh(eta)) AS chi, asin(sin(xi) / cosh(eta)) AS phi FROM m2), {', '.join(closer(n) for n in range(1, 9))},
    g AS (SELECT fid, {system.lon0} + degrees(lon) AS lon, degrees(phi) AS lat FROM p8)"""


def _from_degrees(system: crs.Crs) -> str:
    """From g to t (fid, x, y)."""
    k, e = system.k0 * system.radius, math.sqrt(system.e2)
    return f""", t1 AS (SELECT fid, radians(lon - {system.lon0}) AS lam, sinh(atanh(sin(radians(lat))) - {e!r} * atanh({e!r} * sin(radians(lat)))) AS tau FROM g),
    t2 AS (SELECT fid, atan2(tau, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + tau * tau)) AS eta FROM t1),
    t AS (SELECT fid, {system.east} + {k!r} * ({_series('xi', 'eta', crs.FORWARD, '+', system, 'eta')}) AS x, {system.north} + {k!r} * ({_series('xi', 'eta', crs.FORWARD, '+', system, 'xi')} - {system.rise!r}) AS y FROM t2)"""


@query(L.with_layers("pts") + ", m AS (SELECT fid, 150000 + x * 97.5 AS x, 400000 + y * 931.25 AS y FROM pts)" + _to_degrees(crs.SYSTEMS[5186]) + _from_degrees(crs.SYSTEMS[5179]) + " SELECT fid, round(lon, 8) AS lon, round(lat, 8) AS lat, round(x, 2) AS x, round(y, 2) AS y FROM g JOIN t USING (fid)")
def crs_transform(spark, sf_dir):
    """Points of the central belt in degrees and in the unified system."""
    points = L.pts(spark, sf_dir).select("fid", (150_000 + F.col("x") * 97.5).alias("x"), (400_000 + F.col("y") * 931.25).alias("y"))
    wide = crs.transform_layer(points, 5186, 5179).select("fid", F.round("x", 2).alias("x"), F.round("y", 2).alias("y"))
    degrees = crs.transform_layer(points, 5186, 4737).select(F.col("fid").alias("_fid"), F.round("x", 8).alias("lon"), F.round("y", 8).alias("lat"))
    return wide.join(degrees, F.col("fid") == F.col("_fid")).select("fid", "lon", "lat", "x", "y")


@query(
    L.with_layers("pts").replace("WITH ", "WITH RECURSIVE ", 1)
    + """, e AS (SELECT fid AS nth, x::DOUBLE AS x, y::DOUBLE AS y, kind AS type, CASE fid % 7 WHEN 0 THEN 'CRIT' WHEN 1 THEN 'MAJOR' WHEN 2 THEN 'odd' WHEN 3 THEN 'MINOR' ELSE 'INFO' END AS severity FROM pts),
    scan AS (
        SELECT min(nth) AS nth, [{nth: min(nth), x: arg_min(x, nth), y: arg_min(y, nth)}] AS seeds FROM e
        UNION ALL
        SELECT n.nth, list_append(seeds, {nth: n.nth, x: n.x, y: n.y}) FROM scan, LATERAL (SELECT min(e.nth) AS nth, arg_min(e.x, e.nth) AS x, arg_min(e.y, e.nth) AS y FROM e WHERE e.nth > scan.nth AND len(list_filter(seeds, lambda s: sqrt((s.x - e.x) ** 2 + (s.y - e.y) ** 2) <= 60)) = 0) AS n
        WHERE n.nth IS NOT NULL),
    seeds AS (SELECT unnest(seeds, recursive := true) FROM (SELECT seeds FROM scan ORDER BY len(seeds) DESC LIMIT 1)),
    told AS (SELECT e.*, (SELECT min(s.nth) FROM seeds s WHERE sqrt((s.x - e.x) ** 2 + (s.y - e.y) ** 2) <= 60) AS cluster FROM e),
    kinds AS (SELECT cluster, type, count(*) AS n, min(nth) AS first FROM told GROUP BY ALL)
    SELECT cluster, count(*) AS size, round(avg(x), 6) AS x, round(avg(y), 6) AS y, (SELECT type FROM kinds k WHERE k.cluster = told.cluster ORDER BY n DESC, first LIMIT 1) AS type,
        arg_max(severity, (coalesce(list_position(['INFO', 'MINOR', 'MAJOR', 'CRIT'], severity), 0), -nth)) AS severity FROM told GROUP BY cluster"""
)
def cluster_greedy(spark, sf_dir):
    """Clusters of errors within 60 units of seeds in the order of their number."""
    k = F.col("fid")
    severity = F.when(k % 7 == 0, "CRIT").when(k % 7 == 1, "MAJOR").when(k % 7 == 2, "odd").when(k % 7 == 3, "MINOR").otherwise("INFO")
    errors = L.pts(spark, sf_dir).select(k.alias("nth"), "x", "y", F.col("kind").alias("type"), severity.alias("severity"))
    return cluster.cluster_greedy(errors, 60).withColumns({"x": F.round("x", 6), "y": F.round("y", 6)})
