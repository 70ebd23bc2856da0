"""Layers: tables with an id and a geometry or attributes, and the fixtures that the queries use.

Fixtures are derived from the driver's tables with whole numbers, so that results are exact. LAYER_SQL has the same
layers in SQL, as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions.geometry import point, segment_path

LAYER_SQL = {
    "boxes_a": "boxes_a AS (SELECT p_partkey AS fid, (p_partkey % 100) * 10 AS x1, (p_partkey // 100) * 10 AS y1, (p_partkey % 100) * 10 + 4 + p_size % 9 AS x2, (p_partkey // 100) * 10 + 4 + p_partkey * 7 % 9 AS y2, p_brand AS brand, p_size AS size FROM part)",
    "boxes_b": "boxes_b AS (SELECT s_suppkey AS fid, s_suppkey * 37 % 1000 AS x1, s_suppkey * 53 % 200 AS y1, s_suppkey * 37 % 1000 + 5 + s_suppkey % 17 AS x2, s_suppkey * 53 % 200 + 5 + s_suppkey % 13 AS y2 FROM supplier)",
    "pts": "pts AS (SELECT event_id AS fid, event_id * 13 % 1003 AS x, event_id * 29 % 211 AS y, event_type AS kind FROM events)",
    "ends": "lines AS (SELECT o_orderkey AS fid, o_orderkey * 17 % 997 AS xa, o_orderkey * 31 % 499 AS ya, o_orderkey * 17 % 997 + o_orderkey % 7 - 3 AS xb, o_orderkey * 31 % 499 + o_orderkey % 5 + 1 AS yb, o_orderstatus AS status, o_totalprice AS price FROM orders), ends AS (SELECT fid, 'start' AS side, xa AS x, ya AS y, status, price FROM lines UNION ALL SELECT fid, 'end', xb, yb, status, price FROM lines)",
    "hlines": "hlines AS (SELECT o_orderkey AS fid, o_orderkey * 17 % 297 AS x1, o_orderkey * 31 % 199 AS y1, o_orderkey * 17 % 297 + o_orderkey % 9 + 1 AS x2, o_orderkey * 31 % 199 AS y2, o_orderstatus AS status FROM orders)",
    "bld": "bld AS (SELECT p_partkey AS fid, CASE WHEN p_partkey % 11 = 0 THEN 'OFJ008' WHEN p_partkey % 13 = 0 THEN NULL ELSE 'OFJ001' END AS change, CASE p_size % 4 WHEN 0 THEN 'BDK001' WHEN 1 THEN 'bdk002' WHEN 2 THEN '' ELSE NULL END AS code, CASE p_partkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'abc' ELSE CAST(p_partkey % 60 * 5 AS VARCHAR) END AS height, CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '  ' WHEN 2 THEN 'ㅋㅋ동' WHEN 3 THEN '이름?' ELSE p_name END AS name, CASE WHEN p_partkey % 3 = 0 THEN 'OBF001' ELSE 'OBF002' END AS kind, CAST(p_partkey % 40 - 5 AS DOUBLE) AS lowest, CAST(p_partkey % 37 AS DOUBLE) AS base, CAST(p_partkey % 31 AS DOUBLE) AS highest, CAST(p_partkey % 29 AS DOUBLE) AS facility FROM part)",
}


#: Outlines of the shapes' kinds, the shell first: a triangle, an arrow head, a diamond with a hole, a quadrangle that
#: runs clockwise, a fork.
KINDS = (
    [[(0, 0), (13, 3), (4, 12)]],
    [[(0, 0), (12, 2), (5, 5), (3, 13)]],
    [[(7, 0), (14, 7), (7, 14), (0, 7)], [(7, 4), (10, 7), (7, 10), (4, 7)]],
    [[(0, 2), (2, 13), (11, 11), (13, 0)]],
    [[(0, 0), (12, 0), (12, 12), (8, 12), (8, 3), (4, 3), (4, 12), (0, 12)]],
)
_VERTICES = ", ".join(f"({k}, {n}, {i}, {x}, {y})" for k, rings in enumerate(KINDS) for n, ring in enumerate(rings) for i, (x, y) in enumerate([*ring, ring[0]]))


def _shape_sql(n: str, table: str, key: str, x: str, y: str) -> str:
    """The vertices (v), sides (e) and boxes (b) of a layer of shapes."""
    return f"""v{n} AS (SELECT {key} AS fid, ring, nth, {x} + dx AS x, {y} + dy AS y FROM {table} JOIN kinds ON kind = {key} % {len(KINDS)}),
        e{n} AS (SELECT fid, ring, x AS px, y AS py, lead(x) OVER w AS qx, lead(y) OVER w AS qy FROM v{n} WINDOW w AS (PARTITION BY fid, ring ORDER BY nth) QUALIFY qx IS NOT NULL),
        b{n} AS (SELECT fid, min(x) AS x1, min(y) AS y1, max(x) AS x2, max(y) AS y2 FROM v{n} GROUP BY fid)"""


LAYER_SQL["kinds"] = f"kinds(kind, ring, nth, dx, dy) AS (VALUES {_VERTICES})"
LAYER_SQL["shapes_a"] = _shape_sql("a", "part", "p_partkey", "p_partkey % 100 * 10", "p_partkey // 100 * 10")
#: Outlines as sets of sides, whichever way they run: of shapes_a and of copies of every third.
LAYER_SQL["twins"] = "twins AS (SELECT fid, list_sort(list((least((px, py), (qx, qy)), greatest((px, py), (qx, qy))))) AS outline FROM (SELECT fid, px, py, qx, qy FROM ea UNION ALL SELECT fid + 1000000, qx, qy, px, py FROM ea WHERE fid % 3 = 0) GROUP BY fid)"
LAYER_SQL["forks"] = "forks AS (SELECT p_partkey AS fid, p_partkey % 100 * 10 AS x, p_partkey // 100 * 10 AS y FROM part), prongs AS (SELECT dx, dy FROM generate_series(0, 11) AS a(dx), generate_series(0, 11) AS b(dy) WHERE dy < 3 OR dx < 4 OR dx >= 8)"
LAYER_SQL["shapes_b"] = _shape_sql("b", "supplier", "s_suppkey", "s_suppkey * 37 % 1000", "s_suppkey * 53 % 200")


def with_layers(*names: str) -> str:
    return "WITH " + ", ".join(LAYER_SQL[n] for n in names) + " "


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def boxes_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    x, y = k % 100 * 10, F.floor(k / 100) * 10
    return read(spark, sf_dir, "part").select(k.alias("fid"), x.alias("x1"), y.alias("y1"), (x + 4 + F.col("p_size") % 9).alias("x2"), (y + 4 + k * 7 % 9).alias("y2"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"))


def boxes_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    x, y = k * 37 % 1000, k * 53 % 200
    return read(spark, sf_dir, "supplier").select(k.alias("fid"), x.alias("x1"), y.alias("y1"), (x + 5 + k % 17).alias("x2"), (y + 5 + k % 13).alias("y2"))


def pts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    return read(spark, sf_dir, "events").select(k.alias("fid"), (k * 13 % 1003).alias("x"), (k * 29 % 211).alias("y"), F.col("event_type").alias("kind"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    x, y = k * 17 % 997, k * 31 % 499
    return read(spark, sf_dir, "orders").select(k.alias("fid"), x.alias("xa"), y.alias("ya"), (x + k % 7 - 3).alias("xb"), (y + k % 5 + 1).alias("yb"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))


def hlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level lines, as boxes without height."""
    k = F.col("o_orderkey")
    x, y = k * 17 % 297, k * 31 % 199
    return read(spark, sf_dir, "orders").select(k.alias("fid"), x.alias("x1"), y.alias("y1"), (x + k % 9 + 1).alias("x2"), y.alias("y2"), F.col("o_orderstatus").alias("status"))


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with a vertex array of three points."""
    k = F.col("fid")
    mid = point(F.col("xa") + k % 4, F.col("ya") + k % 3)
    return lines(spark, sf_dir).withColumn("path", segment_path(point(F.col("xa"), F.col("ya")), mid, point(F.col("xb"), F.col("yb"))))


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A winding line of 20 to 60 vertices from each line's start, with bends under and over one unit."""
    k = F.col("fid")
    at = lambda i: point(F.col("xa") + i, F.col("ya") + (i * i * 7919 + i * k * 31 + k) % 1009 / 512)
    dealt = lines(spark, sf_dir).select("fid", "xa", "ya").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "fid")  # a small row for many vertices
    return dealt.select("fid", F.transform(F.sequence(F.lit(0).cast("long"), 19 + k % 41), at).alias("path"))


def rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes as closed rings, every seventh left open and every eleventh a sliver."""
    b = boxes_a(spark, sf_dir)
    thin = F.col("fid") % 11 == 0
    x1, y1 = F.col("x1").cast("double"), F.col("y1").cast("double")
    x2 = F.when(thin, x1 + 100).otherwise(F.col("x2").cast("double"))
    y2 = F.when(thin, y1 + 0.0078125).otherwise(F.col("y2").cast("double"))
    corners = [point(x1, y1), point(x2, y1), point(x2, y2), point(x1, y2)]
    return b.select("fid", F.when(F.col("fid") % 7 == 0, F.array(*corners)).otherwise(F.array(*corners, corners[0])).alias("ring"))


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings with holes by fid % 6: a bow-tie, a square with a hole, one with a hole outside, an open square, one with
    a hole in a hole, a triangle; every 35th has no geometry."""
    k = F.col("p_partkey")
    x, y = (k % 100 * 10).cast("double"), (F.floor(k / 100) * 10).cast("double")
    ring = lambda *at: F.array(*[point(x + a, y + b) for a, b in at])
    square = lambda a, b: ring((a, a), (b, a), (b, b), (a, b), (a, a))
    kinds = [F.array(ring((0, 0), (4, 4), (4, 0), (0, 4), (0, 0))), F.array(square(0, 4), square(1, 3)), F.array(square(0, 4), square(6, 7)), F.array(ring((0, 0), (4, 0), (4, 4), (0, 4))), F.array(square(0, 8), square(1, 7), square(2, 4)), F.array(ring((0, 0), (4, 0), (0, 4), (0, 0)))]
    shape = F.when(k % 35 == 0, None)
    for n, kind in enumerate(kinds):
        shape = shape.when(k % 6 == n, kind)
    return read(spark, sf_dir, "part").select(k.alias("fid"), shape.alias("rings"))


def _shapes(table: DataFrame, key: str, x, y, *more, kinds=KINDS) -> DataFrame:
    ring = lambda at: F.array(*[point(x + a, y + b) for a, b in [*at, at[0]]])
    rings, kind = None, F.col(key) % len(kinds)
    for n, outline in enumerate(kinds):
        own = F.array(*map(ring, outline))
        rings = F.when(kind == n, own) if rings is None else rings.when(kind == n, own)
    return table.select(F.col(key).alias("fid"), rings.alias("rings"), *more)


def shapes_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slanted, hollow and holed polygons that overlap their neighbours."""
    k = F.col("p_partkey")
    return _shapes(read(spark, sf_dir, "part"), "p_partkey", k % 100 * 10, F.floor(k / 100) * 10, F.col("p_brand").alias("brand"))


def forks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fork of two prongs for each part, over its neighbours; `prongs` has its unit squares."""
    k = F.col("p_partkey")
    at = [point(k % 100 * 10 + x, F.floor(k / 100) * 10 + y) for x, y in [*KINDS[4][0], KINDS[4][0][0]]]
    return read(spark, sf_dir, "part").select(k.alias("fid"), F.array(F.array(*at)).alias("rings"))


#: Squares whose holes touch the shell and each other, by fid % 4.
LINKED = (
    [[(0, 0), (8, 0), (8, 8), (0, 8)], [(0, 4), (4, 2), (8, 4), (4, 6)]],
    [[(0, 0), (8, 0), (8, 8), (0, 8)], [(1, 4), (2, 2), (4, 4), (2, 6)], [(4, 4), (6, 2), (7, 4), (6, 6)]],
    [[(0, 0), (8, 0), (8, 8), (0, 8)], [(0, 4), (2, 2), (4, 4), (2, 6)], [(4, 4), (6, 2), (8, 4), (6, 6)]],
    [[(0, 0), (8, 0), (8, 8), (0, 8)], [(2, 2), (3, 5), (5, 3)]],
)
_LINKED = ", ".join(f"({k}, {n}, {i}, {x}, {y})" for k, rings in enumerate(LINKED) for n, ring in enumerate(rings) for i, (x, y) in enumerate([*ring, ring[0]]))
LAYER_SQL["linked"] = f"""lkinds(kind, ring, nth, dx, dy) AS (VALUES {_LINKED}), v AS (SELECT p_partkey AS fid, ring, nth, p_partkey % 100 * 10 + dx AS x, p_partkey // 100 * 10 + dy AS y FROM part JOIN lkinds ON kind = p_partkey % 4),
    e AS (SELECT fid, ring, x AS px, y AS py, lead(x) OVER w AS qx, lead(y) OVER w AS qy FROM v WINDOW w AS (PARTITION BY fid, ring ORDER BY nth) QUALIFY qx IS NOT NULL)"""


def linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squares with holes that touch."""
    k = F.col("p_partkey")
    return _shapes(read(spark, sf_dir, "part"), "p_partkey", k % 100 * 10, F.floor(k / 100) * 10, kinds=LINKED)


def shapes_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return _shapes(read(spark, sf_dir, "supplier"), "s_suppkey", k * 37 % 1000, k * 53 % 200)


def twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """shapes_a, and of every third a copy that runs the other way from another vertex on."""
    a = shapes_a(spark, sf_dir)
    moved = lambda ring: F.concat(F.slice(F.reverse(ring), 2, F.size(ring) - 1), F.slice(F.reverse(ring), 2, 1))
    copies = a.filter("fid % 3 = 0").select((F.col("fid") + 1_000_000).alias("fid"), F.transform("rings", moved).alias("rings"))
    return a.select("fid", "rings").unionByName(copies)


def plugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes as large as the holes of shapes_a: every other one in its place, the rest beside it."""
    k = F.col("p_partkey")
    beside = (k % 2).cast("double")
    holed = read(spark, sf_dir, "part").filter(k % len(KINDS) == 2)
    ring = [point(k % 100 * 10 + beside + x, F.floor(k / 100) * 10 + y) for x, y in [*KINDS[2][1][2:], *KINDS[2][1][:3]]]
    return holed.select(k.alias("fid"), F.array(F.array(*ring)).alias("rings"))


def with_ring(boxes: DataFrame) -> DataFrame:
    """Boxes with their outline as a closed ring."""
    at = lambda a, b: point(F.col(a), F.col(b))
    return boxes.withColumn("ring", F.array(at("x1", "y1"), at("x2", "y1"), at("x2", "y2"), at("x1", "y2"), at("x1", "y1")))


def buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return read(spark, sf_dir, "part").select(
        k.alias("fid"),
        F.when(k % 11 == 0, "OFJ008").when(k % 13 != 0, "OFJ001").alias("change"),
        F.when(F.col("p_size") % 4 == 0, "BDK001").when(F.col("p_size") % 4 == 1, "bdk002").when(F.col("p_size") % 4 == 2, "").alias("code"),
        F.when(k % 6 == 1, "abc").when(k % 6 != 0, (k % 60 * 5).cast("string")).alias("height"),
        F.when(k % 5 == 1, "  ").when(k % 5 == 2, "ㅋㅋ동").when(k % 5 == 3, "이름?").when(k % 5 == 4, F.col("p_name")).alias("name"),
        F.when(k % 3 == 0, "OBF001").otherwise("OBF002").alias("kind"),
        *[(k % n - d).cast("double").alias(c) for c, n, d in (("lowest", 40, 5), ("base", 37, 0), ("highest", 31, 0), ("facility", 29, 0))],
    )


def rules(spark: SparkSession, path: str) -> DataFrame:
    """A rule table from CSV: rows whose first column starts with # or that are not enabled are left out."""
    df = spark.read.csv(path, header=True)
    first = df.columns[0]
    df = df.withColumnRenamed(first, first.lstrip("﻿")).filter(~F.col(f"`{first.lstrip(chr(0xFEFF))}`").startswith("#"))
    return df.filter(F.upper("Enabled") == "Y") if "Enabled" in df.columns else df


def active(table: DataFrame) -> DataFrame:
    """The rows of a rule table (rule_id, enabled) that are enabled and no comments."""
    return table.filter((F.upper("enabled") == "Y") & ~F.startswith("rule_id", F.lit("#")))


def table_exists(layers: dict[str, DataFrame], name: str) -> bool:
    return name.lower() in map(str.lower, layers)


def field_exists(layers: dict[str, DataFrame], name: str, field: str) -> bool:
    return any(n.lower() == name.lower() and field.lower() in map(str.lower, df.columns) for n, df in layers.items())
