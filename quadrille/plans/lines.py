"""Queries of lines and polygons, layer profiles and searches for like objects."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadrille.operators import relation as r
from quadrille.plans.registry import query
from quadrille.plans.relations import AREA
from quadrille.sources import layers as L

HA, H, AB, A, P = L.with_layers("hlines", "boxes_a"), L.with_layers("hlines"), L.with_layers("boxes_a", "boxes_b"), L.with_layers("boxes_a"), L.with_layers("pts")
MEETS = "a.x1 <= b.x2 AND b.x1 <= a.x2 AND a.y1 <= b.y2 AND b.y1 <= a.y2"
HELD = "a.x1 >= b.x1 AND a.x2 <= b.x2 AND a.y1 >= b.y1 AND a.y2 <= b.y2"
pair = lambda df: df.select(F.col("a.fid").alias("fid"), F.col("b.fid").alias("related_fid"))


@query(HA + f"SELECT a.fid, b.fid AS related_fid FROM boxes_a a JOIN hlines b ON {MEETS}")
def rel_polygon_not_intersect_line(spark, sf_dir):
    return pair(r.box_join(L.boxes_a(spark, sf_dir), L.hlines(spark, sf_dir)))


@query(HA + f"SELECT fid FROM boxes_a a WHERE brand <> 'Brand#11' AND NOT EXISTS (SELECT 1 FROM hlines b WHERE {MEETS})")
def rel_polygon_missing_line(spark, sf_dir):
    a = L.boxes_a(spark, sf_dir).filter("brand <> 'Brand#11'")
    met = pair(r.box_join(a, L.hlines(spark, sf_dir))).select(F.col("fid").alias("_met"))
    return a.join(met, F.col("fid") == F.col("_met"), "left_anti").select("fid")


@query(HA + f"SELECT fid FROM hlines a WHERE status = 'F' AND NOT EXISTS (SELECT 1 FROM boxes_a b WHERE {HELD})")
def rel_line_within_polygon(spark, sf_dir):
    lines = L.hlines(spark, sf_dir).filter("status = 'F'")
    held = r.box_join(lines, L.boxes_a(spark, sf_dir), condition=F.expr(HELD)).select(F.col("a.fid").alias("_held"))
    return lines.join(held, F.col("fid") == F.col("_held"), "left_anti").select("fid")


@query(HA + f"SELECT a.fid, b.fid AS related_fid, CASE WHEN {HELD} THEN 'Within' WHEN a.y1 = b.y1 OR a.y1 = b.y2 OR a.x2 = b.x1 OR a.x1 = b.x2 THEN 'Touches' ELSE 'Crosses' END AS kind, least(a.x2, b.x2) - greatest(a.x1, b.x1) AS measure FROM hlines a JOIN boxes_a b ON {MEETS}")
def srel_line_polygon(spark, sf_dir):
    kind = F.when(F.expr(HELD), "Within").when(F.expr("a.y1 = b.y1 OR a.y1 = b.y2 OR a.x2 = b.x1 OR a.x1 = b.x2"), "Touches").otherwise("Crosses")
    return r.box_join(L.hlines(spark, sf_dir), L.boxes_a(spark, sf_dir)).select(F.col("a.fid").alias("fid"), F.col("b.fid").alias("related_fid"), kind.alias("kind"), F.expr("least(a.x2, b.x2) - greatest(a.x1, b.x1)").alias("measure"))


SHARED = "least(a.x2, b.x2) - greatest(a.x1, b.x1)"


@query(H + f"SELECT a.fid, b.fid AS related_fid, {SHARED} AS measure FROM hlines a JOIN hlines b ON a.fid < b.fid AND a.y1 = b.y1 AND {SHARED} > 0")
def rel_contour_intersection(spark, sf_dir):
    """Shared stretches; crossings in a point are not reported."""
    return _shared(L.hlines(spark, sf_dir), ())


@query(H + f"SELECT a.fid, b.fid AS related_fid, {SHARED} AS measure FROM hlines a JOIN hlines b ON a.fid < b.fid AND a.status = b.status AND a.y1 = b.y1 AND {SHARED} > 0")
def rel_line_intersection_attr(spark, sf_dir):
    return _shared(L.hlines(spark, sf_dir), ("status",))


def _shared(lines, keys):
    keys = (*keys, "y1")
    groups = r.together(lines, ("x1", "x2"), keys).withColumn("y2", F.col("y1"))
    shared = lambda a, b: F.least(F.col(f"{a}.x2"), F.col(f"{b}.x2")) - F.greatest(F.col(f"{a}.x1"), F.col(f"{b}.x1"))
    return r.pairs_apart(groups, ("x1", "x2"), shared, keys)


NEAR_LINE = "a.fid <> b.fid AND pow(greatest(b.x1 - a.x, 0, a.x - b.x2), 2) + pow(a.y - b.y1, 2) <= 1"
NEAR_END = "a.fid <> b.fid AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 1"
HE = H + ", he AS (SELECT fid, 'start' AS side, x1 AS x, y1 AS y, status FROM hlines UNION ALL SELECT fid, 'end', x2, y1, status FROM hlines) "


def _ends(lines):
    return r.ends(lines.select("fid", F.col("x1").alias("xa"), F.col("y1").alias("ya"), F.col("x2").alias("xb"), F.col("y1").alias("yb")))


def _geometries(lines):
    """Each geometry of the layer once, with the least and the greatest fid that has it."""
    return lines.groupBy("x1", "y1", "x2", "y2").agg(F.min("fid").alias("lo"), F.max("fid").alias("hi"))


OTHER = "(b.lo <> a.fid OR b.hi <> a.fid)"


def _at(ends, places):
    """Ends at places of their own."""
    same = [F.col(k) == F.col(f"_{k}") for k in ("fid", "x", "y")]
    return ends.join(places.select(*[F.col(k).alias(f"_{k}") for k in ("fid", "x", "y")]), same, "left_semi")


def _connectivity(lines):
    ends = _ends(lines)
    near = r.box_join(r.as_boxes(r.lone_places(ends, 1)), _geometries(lines), grow=1, condition=F.expr(NEAR_LINE.replace("a.fid <> b.fid", OTHER)))
    return _at(ends, near.select("a.fid", "a.x", "a.y")).select("fid", "side")


@query(HE + f"SELECT fid, side FROM he a WHERE EXISTS (SELECT 1 FROM hlines b WHERE {NEAR_LINE}) AND NOT EXISTS (SELECT 1 FROM he b WHERE {NEAR_END})")
def rel_line_connectivity(spark, sf_dir):
    """Ends near another line that no other end joins."""
    return _connectivity(L.hlines(spark, sf_dir))


_F = "SELECT * FROM hlines WHERE status = 'F'"


@query(H + f", f AS ({_F}), he AS (SELECT fid, 'start' AS side, x1 AS x, y1 AS y FROM f UNION ALL SELECT fid, 'end', x2, y1 FROM f) SELECT fid, side FROM he a WHERE EXISTS (SELECT 1 FROM f b WHERE {NEAR_LINE}) AND NOT EXISTS (SELECT 1 FROM he b WHERE {NEAR_END})")
def rel_line_connectivity_filter(spark, sf_dir):
    return _connectivity(L.hlines(spark, sf_dir).filter("status = 'F'"))


D2 = "pow(greatest(b.x1 - a.x, 0, a.x - b.x2), 2) + pow(a.y - b.y1, 2)"


def _shoots(name, which):
    """Ends whose nearest other line is within 2 but not joined; over: its nearest point is one of its ends."""
    sql = HE + f", d AS (SELECT a.fid, a.side, {D2} AS d2, a.x <= b.x1 OR a.x >= b.x2 AS at_end, b.fid AS other FROM he a JOIN hlines b ON a.fid <> b.fid AND {D2} <= 4), n AS (SELECT fid, side, min(d2) AS d2, arg_min(at_end, (d2, other)) AS at_end FROM d GROUP BY fid, side) SELECT fid, side, round(sqrt(d2), 6) AS measure FROM n WHERE d2 > 0 AND {'' if which else 'NOT '}at_end"

    def run(spark, sf_dir):
        """An end that shares its place with another line's is joined; one that lies on several lines is, too. So the rest is
        told by the nearest geometry that the end does not lie on, and of equal ones by the least fid."""
        lines = L.hlines(spark, sf_dir)
        ends = _ends(lines)
        lone = r.places(ends).filter("lo = hi").select("x", "y", F.col("lo").alias("fid"))
        near = r.box_join(r.as_boxes(lone), _geometries(lines), grow=2, condition=F.expr(f"{OTHER} AND {D2} <= 4"))
        rows = near.select("a.fid", "a.x", "a.y", F.struct(F.expr(D2).alias("d2"), F.col("b.lo").alias("other"), F.expr("a.x <= b.x1 OR a.x >= b.x2").alias("at_end")).alias("n"))
        least = rows.groupBy("fid", "x", "y").agg(F.min("n").alias("n")).filter(F.col("n.d2") > 0)
        found = least.filter(F.col("n.at_end") if which else ~F.col("n.at_end"))
        told = ends.join(found.select(*[F.col(k).alias(f"_{k}") for k in ("fid", "x", "y")], "n"), [F.col(k) == F.col(f"_{k}") for k in ("fid", "x", "y")])
        return told.groupBy("fid", "side").agg(F.round(F.sqrt(F.min("n.d2")), 6).alias("measure"))

    query(sql, name)(run)


_shoots("geom_overshoot", True)
_shoots("geom_undershoot", False)


@query(AB + f"SELECT a.fid, b.fid AS related_fid FROM boxes_a a JOIN boxes_b b ON {AREA} > 0 WHERE a.brand = 'Brand#11' AND b.fid % 3 = 0")
def rel_attr_spatial_mismatch(spark, sf_dir):
    roads, sites = L.boxes_a(spark, sf_dir).filter("brand = 'Brand#11'"), L.boxes_b(spark, sf_dir).filter("fid % 3 = 0")
    return r.overlaps(roads, sites).select("fid", "related_fid")


GAP2 = "pow(greatest(b.x1 - a.x2, 0, a.x1 - b.x2), 2) + pow(greatest(b.y1 - a.y2, 0, a.y1 - b.y2), 2)"


#: Names of bridges and rivers, some blank.
_NAMES = "n AS (SELECT fid, CASE WHEN fid % 7 = 0 THEN '  ' ELSE upper(brand) END AS name FROM boxes_a), m AS (SELECT s_suppkey AS fid, CASE WHEN s_suppkey % 5 = 0 THEN NULL WHEN s_suppkey % 5 = 1 THEN '' ELSE 'brand#1' || (s_suppkey % 3 + 1) END AS name FROM supplier)"


@query(AB + f", {_NAMES}, f AS (SELECT a.fid, arg_min(m.name, b.fid) AS river_name, min(b.fid) AS related_fid FROM boxes_a a JOIN boxes_b b ON {GAP2} <= 4 JOIN m ON m.fid = b.fid AND trim(coalesce(m.name, '')) <> '' GROUP BY a.fid) SELECT f.fid, related_fid, n.name AS bridge_name, river_name FROM f JOIN n ON n.fid = f.fid WHERE trim(n.name) <> '' AND lower(trim(n.name)) <> lower(trim(river_name))")
def rel_bridge_river_name(spark, sf_dir):
    """The first river by id that has a name and is within reach has another name than the bridge; blank names are passed over."""
    k = F.col("fid")
    bridges = L.boxes_a(spark, sf_dir).withColumn("name", F.when(k % 7 == 0, "  ").otherwise(F.upper("brand")))
    rivers = L.boxes_b(spark, sf_dir).withColumn("name", F.when(k % 5 == 0, None).when(k % 5 == 1, "").otherwise(F.concat(F.lit("brand#1"), (k % 3 + 1).cast("string"))))
    return r.name_mismatches(bridges, rivers, 2)


@query(A + "SELECT count(*) AS n, min(x1) AS x1, max(x2) AS x2, count(*) * (50 + 16 * 5) + 200 AS bytes, least(30, greatest(1, ceil((count(*) * (50 + 16 * 5) + 200) / 10000.0))) AS splits FROM boxes_a")
def agg_layer_profile(spark, sf_dir):
    size = F.count(F.lit(1)) * (50 + 16 * 5) + 200
    return L.boxes_a(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.min("x1").alias("x1"), F.max("x2").alias("x2"), size.alias("bytes"), F.least(F.lit(30), F.greatest(F.lit(1), F.ceil(size / 10000.0))).alias("splits"))


@query(A + "SELECT round(avg((x2 - x1) * (y2 - y1)), 6) AS mean_area, round(var_pop((x2 - x1) * (y2 - y1)), 6) AS var_area, CASE WHEN count(*) < 1000 THEN 'grid' WHEN var_pop((x2 - x1) * (y2 - y1)) > 10 * avg((x2 - x1) * (y2 - y1)) THEN 'rtree' ELSE 'quadtree' END AS advice FROM boxes_a")
def index_recommend(spark, sf_dir):
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    advice = F.when(F.count(F.lit(1)) < 1000, "grid").when(F.var_pop(area) > 10 * F.avg(area), "rtree").otherwise("quadtree")
    return L.boxes_a(spark, sf_dir).agg(F.round(F.avg(area), 6).alias("mean_area"), F.round(F.var_pop(area), 6).alias("var_area"), advice.alias("advice"))


@query("SELECT count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_orderstatus = 'O') AS running, round(avg(CASE o_orderstatus WHEN 'F' THEN 100 WHEN 'O' THEN 50 ELSE 0 END), 6) AS mean_percent FROM orders")
def agg_progress(spark, sf_dir):
    c = lambda v: F.count(F.when(F.col("o_orderstatus") == v, 1))
    part = F.when(F.col("o_orderstatus") == "F", 100).when(F.col("o_orderstatus") == "O", 50).otherwise(0)
    return L.read(spark, sf_dir, "orders").agg(c("F").alias("done"), c("O").alias("running"), F.round(F.avg(part), 6).alias("mean_percent"))


@query(P + "SELECT x // 100 AS cx, y // 100 AS cy, count(*) AS n, round(avg(x), 6) AS x, round(avg(y), 6) AS y FROM pts GROUP BY 1, 2")
def cluster_grid(spark, sf_dir):
    """Clusters by grid cell: the order-free counterpart of greedy clustering."""
    p = L.pts(spark, sf_dir)
    return p.groupBy(F.floor(F.col("x") / 100).alias("cx"), F.floor(F.col("y") / 100).alias("cy")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("x"), 6).alias("x"), F.round(F.avg("y"), 6).alias("y"))
