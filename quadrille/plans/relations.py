"""Queries of geometry checks and of relations between layers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quadrille.functions import geometry as g
from quadrille.operators import relation as r
from quadrille.operators import runs
from quadrille.plans.registry import query
from quadrille.sources import layers as L

A, B, P, E = (L.with_layers(x) for x in ("boxes_a", "boxes_b", "pts", "ends"))
AREA = "greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1))"
INSIDE = "p.x > b.x1 AND p.x < b.x2 AND p.y > b.y1 AND p.y < b.y2"
CORNERS = "CASE WHEN fid % 11 = 0 THEN x1 + 100 ELSE x2 END - x1"
RINGS = A + ", q AS (SELECT fid, CASE WHEN fid % 11 = 0 THEN 100.0 ELSE x2 - x1 END AS w, CASE WHEN fid % 11 = 0 THEN 0.0078125 ELSE y2 - y1 END AS h, fid % 7 <> 0 AS closed FROM boxes_a) "


@query(A + f"SELECT a.fid, b.fid AS related_fid, {AREA} AS measure FROM boxes_a a JOIN boxes_a b ON a.fid < b.fid WHERE {AREA} > 0")
def geom_overlap(spark, sf_dir):
    a = L.boxes_a(spark, sf_dir)
    return r.overlaps(a, a, same=True)


@query(RINGS + "SELECT fid, round(CASE WHEN closed THEN w * h ELSE 0 END, 6) AS area FROM q WHERE closed")
def geom_area(spark, sf_dir):
    return L.rings(spark, sf_dir).filter(g.closed(F.col("ring"))).select("fid", F.round(g.area(F.col("ring")), 6).alias("area"))


@query(RINGS + "SELECT fid, round(w * h, 6) AS measure FROM q WHERE closed AND w * h < 2 AND 4 * pi() * w * h / pow(2 * (w + h), 2) < 0.2 AND pow(2 * (w + h), 2) / (4 * pi() * w * h) > 10")
def geom_sliver(spark, sf_dir):
    ring = F.col("ring")
    found = L.rings(spark, sf_dir).filter(g.closed(ring)).filter((g.area(ring) < 2) & (g.shape_index(ring) < 0.2) & (F.try_divide(F.lit(1.0), g.shape_index(ring)) > 10))
    return found.select("fid", F.round(g.area(ring), 6).alias("measure"))


@query(RINGS + "SELECT fid, round(w * h, 6) AS measure FROM q WHERE closed AND w * h > 0 AND w * h < 30")
def geom_small_area(spark, sf_dir):
    ring = F.col("ring")
    return L.rings(spark, sf_dir).filter(g.closed(ring) & (g.area(ring) > 0) & (g.area(ring) < 30)).select("fid", F.round(g.area(ring), 6).alias("measure"))


@query(RINGS + "SELECT fid, closed, 4 AS vertices FROM q WHERE NOT closed")
def geom_min_points(spark, sf_dir):
    ring = F.col("ring")
    rows = L.rings(spark, sf_dir).select("fid", g.closed(ring).alias("closed"), g.unique_vertices(ring).alias("vertices"))
    return rows.filter(~F.col("closed") | (F.col("vertices") < 3))


LINES = E + ", v AS (SELECT fid, status, xa, ya, xa + fid % 4 AS xm, ya + fid % 3 AS ym, xb, yb FROM lines) "
LENGTH = "sqrt(pow(xm - xa, 2) + pow(ym - ya, 2)) + sqrt(pow(xb - xm, 2) + pow(yb - ym, 2))"


@query(LINES + f"SELECT fid, round({LENGTH}, 6) AS measure FROM v WHERE {LENGTH} > 0 AND {LENGTH} < 3")
def geom_short_line(spark, sf_dir):
    return L.paths(spark, sf_dir).withColumn("n", g.length(F.col("path"))).filter("n > 0 AND n < 3").select("fid", F.round("n", 6).alias("measure"))


TURN = "degrees(acos(greatest(-1, least(1, ((xm - xa) * (xb - xm) + (ym - ya) * (yb - ym)) / nullif(sqrt((pow(xm - xa, 2) + pow(ym - ya, 2)) * (pow(xb - xm, 2) + pow(yb - ym, 2))), 0)))))"


def _turn(spark, sf_dir):
    a, b, c = (F.col("path")[k] for k in range(3))
    return L.paths(spark, sf_dir).withColumn("turn", g.turn_degrees(b["x"] - a["x"], b["y"] - a["y"], c["x"] - b["x"], c["y"] - b["y"]))


@query(LINES + f"SELECT fid, round({TURN}, 4) AS measure FROM v WHERE {TURN} < 30.5")
def rel_road_sharp_bend(spark, sf_dir):
    """As in the reference, an angle of 0 is a straight line, and gentle vertices are reported."""
    return _turn(spark, sf_dir).filter("turn < 30.5").select("fid", F.round("turn", 4).alias("measure"))


query(LINES + f"SELECT fid, round({TURN}, 4) AS measure FROM v WHERE {TURN} < 12.5", "rel_contour_sharp_bend")(lambda spark, sf_dir: _turn(spark, sf_dir).filter("turn < 12.5").select("fid", F.round("turn", 4).alias("measure")))


@query(LINES + f"SELECT fid, round(180 - {TURN}, 4) AS measure FROM v WHERE 180 - {TURN} < 60.5")
def geom_spike(spark, sf_dir):
    """The interior angle at the middle vertex is sharp."""
    return _turn(spark, sf_dir).filter("180 - turn < 60.5").select("fid", F.round(180 - F.col("turn"), 4).alias("measure"))


@query(LINES + "SELECT fid, nth, x, y, lag(x) OVER w AS before_x, lead(x) OVER w AS after_x FROM (SELECT fid, 0 AS nth, xa AS x, ya AS y FROM v UNION ALL SELECT fid, 1, xm, ym FROM v UNION ALL SELECT fid, 2, xb, yb FROM v) WINDOW w AS (PARTITION BY fid ORDER BY nth)")
def win_vertex_triplets(spark, sf_dir):
    w = Window.partitionBy("fid").orderBy("nth")
    v = L.paths(spark, sf_dir).select("fid", F.posexplode("path").alias("nth", "p")).select("fid", "nth", F.col("p.x").cast("long").alias("x"), F.col("p.y").cast("long").alias("y"))
    return v.withColumns({"before_x": F.lag("x").over(w), "after_x": F.lead("x").over(w)})


PB = L.with_layers("pts", "boxes_a")
BOTH = PB + f", i AS (SELECT p.fid AS point, b.fid AS polygon FROM pts p JOIN boxes_a b ON {INSIDE}) SELECT 'polygon' AS side, fid FROM boxes_a WHERE fid NOT IN (SELECT polygon FROM i) UNION ALL SELECT 'point', fid FROM pts WHERE fid NOT IN (SELECT point FROM i)"


@query(BOTH)
def rel_point_inside_polygon(spark, sf_dir):
    return r.point_polygon_both(L.pts(spark, sf_dir), L.boxes_a(spark, sf_dir))


query(BOTH, "rel_building_center")(rel_point_inside_polygon)


@query(PB + f"SELECT b.fid, p.fid AS related_fid FROM pts p JOIN boxes_a b ON {INSIDE} WHERE p.kind = 'error'")
def rel_polygon_not_contain_point(spark, sf_dir):
    points = r.as_boxes(L.pts(spark, sf_dir).filter("kind = 'error'"))
    return r.box_join(points, L.boxes_a(spark, sf_dir), condition=r.strictly_inside()).select(F.col("b.fid").alias("fid"), F.col("a.fid").alias("related_fid"))


@query(PB + f"SELECT fid FROM pts p WHERE NOT EXISTS (SELECT 1 FROM boxes_a b WHERE {INSIDE})")
def srel_point_in_polygon(spark, sf_dir):
    return r.point_polygon_both(L.pts(spark, sf_dir), L.boxes_a(spark, sf_dir)).filter("side = 'point'").select("fid")


AB = L.with_layers("boxes_a", "boxes_b")


@query(AB + f"SELECT a.fid, b.fid AS related_fid, {AREA} AS measure FROM boxes_a a JOIN boxes_b b ON {AREA} > 4")
def rel_polygon_not_overlap(spark, sf_dir):
    return r.overlaps(L.boxes_a(spark, sf_dir), L.boxes_b(spark, sf_dir), 4)


query(AB + f"SELECT a.fid, b.fid AS related_fid, {AREA} AS measure FROM boxes_a a JOIN boxes_b b ON {AREA} > 1 AND NOT (a.x1 >= b.x1 AND a.x2 <= b.x2 AND a.y1 >= b.y1 AND a.y2 <= b.y2) AND NOT (b.x1 >= a.x1 AND b.x2 <= a.x2 AND b.y1 >= a.y1 AND b.y2 <= a.y2)", "topo_must_not_overlap")(
    lambda spark, sf_dir: r.box_join(L.boxes_a(spark, sf_dir), L.boxes_b(spark, sf_dir), condition=(g.overlap_area("a", "b") > 1) & ~F.expr("a.x1 >= b.x1 AND a.x2 <= b.x2 AND a.y1 >= b.y1 AND a.y2 <= b.y2") & ~F.expr("b.x1 >= a.x1 AND b.x2 <= a.x2 AND b.y1 >= a.y1 AND b.y2 <= a.y2")).select(F.col("a.fid").alias("fid"), F.col("b.fid").alias("related_fid"), g.overlap_area("a", "b").alias("measure"))
)


@query(AB + f"SELECT a.fid, b.fid AS related_fid, {AREA} AS measure FROM boxes_a a JOIN boxes_b b ON {AREA} > 0")
def topo_must_not_intersect(spark, sf_dir):
    return r.overlaps(L.boxes_a(spark, sf_dir), L.boxes_b(spark, sf_dir))


@query(AB + f"SELECT a.fid, b.fid AS related_fid FROM boxes_a a JOIN boxes_b b ON a.x1 <= b.x2 AND b.x1 <= a.x2 AND a.y1 <= b.y2 AND b.y1 <= a.y2 WHERE {AREA} = 0")
def topo_touches(spark, sf_dir):
    found = r.box_join(L.boxes_a(spark, sf_dir), L.boxes_b(spark, sf_dir), condition=g.overlap_area("a", "b") == 0)
    return found.select(F.col("a.fid").alias("fid"), F.col("b.fid").alias("related_fid"))


@query(A + f"SELECT a.fid, b.fid AS related_fid, {AREA} AS measure FROM boxes_a a JOIN boxes_a b ON a.fid < b.fid AND a.brand = b.brand WHERE {AREA} > 1")
def rel_polygon_intersection_attr(spark, sf_dir):
    a = L.boxes_a(spark, sf_dir)
    return r.overlaps(a, a, 1, same=True, keys=("brand",))


_IN = "b.x1 >= a.x1 AND b.x2 <= a.x2 AND b.y1 >= a.y1 AND b.y2 <= a.y2"


@query(AB + f"SELECT b.fid, a.fid AS related_fid, CASE WHEN {_IN} THEN 'inside' ELSE 'overlap' END AS label FROM boxes_b a JOIN boxes_a b ON {AREA} > 0")
def rel_polygon_contains_objects(spark, sf_dir):
    found = r.box_join(L.boxes_b(spark, sf_dir), L.boxes_a(spark, sf_dir), condition=g.overlap_area("a", "b") > 0)
    return found.select(F.col("b.fid").alias("fid"), F.col("a.fid").alias("related_fid"), F.when(F.expr(_IN), "inside").otherwise("overlap").alias("label"))


@query(AB + f"SELECT fid FROM boxes_a b WHERE NOT EXISTS (SELECT 1 FROM boxes_b a WHERE {_IN})")
def rel_polygon_within_polygon(spark, sf_dir):
    a = L.boxes_a(spark, sf_dir)
    held = r.box_join(L.boxes_b(spark, sf_dir), a, condition=F.expr(_IN)).select(F.col("b.fid").alias("_held"))
    return a.join(held, F.col("fid") == F.col("_held"), "left_anti").select("fid")


@query(AB + f"SELECT a.fid, (a.x2 - a.x1) * (a.y2 - a.y1) - coalesce(max(CASE WHEN b.fid IS NOT NULL THEN {AREA} END), 0) AS measure FROM boxes_a a LEFT JOIN boxes_b b ON {AREA} > 0 GROUP BY a.fid, a.x1, a.x2, a.y1, a.y2 HAVING measure > 1")
def topo_must_be_covered_by(spark, sf_dir):
    """What the one target that covers most leaves uncovered."""
    a = L.boxes_a(spark, sf_dir)
    best = r.overlaps(a, L.boxes_b(spark, sf_dir)).groupBy(F.col("fid").alias("_fid")).agg(F.max("measure").alias("most"))
    left = a.join(best, F.col("fid") == F.col("_fid"), "left").select("fid", ((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")) - F.coalesce("most", F.lit(0))).alias("measure"))
    return left.filter("measure > 1")


@query(P + "SELECT a.fid, b.fid AS related_fid, round(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), 6) AS measure FROM pts a JOIN pts b ON a.fid < b.fid AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) > 0 AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) < CASE WHEN a.kind = 'error' AND b.kind = 'error' THEN 4 WHEN a.kind = 'error' OR b.kind = 'error' THEN 2.5 ELSE 1.5 END")
def rel_point_spacing(spark, sf_dir):
    both, one = F.expr("a.kind = 'error' AND b.kind = 'error'"), F.expr("a.kind = 'error' OR b.kind = 'error'")
    return r.spacing(L.pts(spark, sf_dir), F.when(both, 4.0).when(one, 2.5).otherwise(1.5), 4)


@query(P + "SELECT a.fid, min(b.fid) AS related_fid FROM pts a JOIN pts b ON b.fid < a.fid AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) < 16 GROUP BY a.fid")
def geom_near_duplicate(spark, sf_dir):
    return r.first_near(L.pts(spark, sf_dir), 4)


NEAR = "a.fid <> b.fid AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 4"


@query(E + f"SELECT fid FROM ends a WHERE NOT EXISTS (SELECT 1 FROM ends b WHERE {NEAR}) GROUP BY fid HAVING count(*) = 2")
def rel_line_disconnection(spark, sf_dir):
    free = r.unconnected(r.ends(L.lines(spark, sf_dir)), 2)
    return free.groupBy("fid").agg(F.count(F.lit(1)).alias("n")).filter("n = 2").select("fid")


@query(E + f"SELECT fid FROM ends a WHERE NOT EXISTS (SELECT 1 FROM ends b WHERE a.status = b.status AND {NEAR}) GROUP BY fid HAVING count(*) = 2")
def rel_line_disconnection_attr(spark, sf_dir):
    free = r.unconnected(r.ends(L.lines(spark, sf_dir)), 2, ("status",))
    return free.groupBy("fid").agg(F.count(F.lit(1)).alias("n")).filter("n = 2").select("fid")


EA = L.with_layers("ends", "boxes_a")


@query(EA + f"SELECT fid, side FROM ends a WHERE NOT EXISTS (SELECT 1 FROM ends b WHERE {NEAR}) AND NOT EXISTS (SELECT 1 FROM boxes_a b WHERE a.x >= b.x1 - 1 AND a.x <= b.x2 + 1 AND a.y >= b.y1 - 1 AND a.y <= b.y2 + 1)")
def rel_defective_connection(spark, sf_dir):
    free = r.unconnected(r.ends(L.lines(spark, sf_dir)), 2)
    return _away(free, L.boxes_a(spark, sf_dir), 1).select("fid", "side")


def _away(points, boxes, reach):
    near = r.box_join(r.as_boxes(points), boxes, grow=reach).select(F.col("a.fid").alias("_fid"), F.col("a.side").alias("_side")).distinct()
    return points.join(near, (F.col("fid") == F.col("_fid")) & (F.col("side") == F.col("_side")), "left_anti")


@query(EA + "SELECT fid, side FROM ends a WHERE NOT EXISTS (SELECT 1 FROM boxes_a b WHERE a.x >= b.x1 - 1 AND a.x <= b.x2 + 1 AND a.y >= b.y1 - 1 AND a.y <= b.y2 + 1)")
def rel_line_endpoint_within(spark, sf_dir):
    return _away(r.ends(L.lines(spark, sf_dir)), L.boxes_a(spark, sf_dir), 1).select("fid", "side")


@query(EA + "SELECT DISTINCT fid FROM ends a WHERE NOT EXISTS (SELECT 1 FROM boxes_a b WHERE a.x >= b.x1 - 2 AND a.x <= b.x2 + 2 AND a.y >= b.y1 - 2 AND a.y <= b.y2 + 2)")
def rel_polygon_contains_line(spark, sf_dir):
    """Lines with a vertex that no polygon is near."""
    return _away(r.ends(L.lines(spark, sf_dir)), L.boxes_a(spark, sf_dir), 2).select("fid").distinct()


@query(E + f"SELECT DISTINCT least(a.fid, b.fid) AS fid, greatest(a.fid, b.fid) AS related_fid, round(abs(a.price - b.price), 2) AS measure FROM ends a JOIN ends b ON {NEAR} WHERE abs(a.price - b.price) > 0.01")
def rel_connected_same_attr(spark, sf_dir):
    pairs = r.near_ends(r.ends(L.lines(spark, sf_dir)), 2, condition=F.expr("a.fid < b.fid AND abs(a.price - b.price) > 0.01"))
    return pairs.select(F.col("a.fid").alias("fid"), F.col("b.fid").alias("related_fid"), F.round(F.abs(F.col("a.price") - F.col("b.price")), 2).alias("measure")).distinct()


@query(E + f", n AS (SELECT a.fid, a.side, a.status, b.fid AS other, b.status AS other_status, count(*) OVER (PARTITION BY a.fid, a.side) AS degree FROM ends a JOIN ends b ON {NEAR}) SELECT DISTINCT fid, side, other AS related_fid FROM n WHERE degree < 3 AND status <> other_status")
def rel_centerline_attr_mismatch(spark, sf_dir):
    """Ends with three or more others near are intersections and left out."""
    near = r.near_ends(r.ends(L.lines(spark, sf_dir)), 2)
    rows = near.select(F.col("a.fid").alias("fid"), F.col("a.side").alias("side"), F.col("a.status").alias("s"), F.col("b.fid").alias("related_fid"), F.col("b.status").alias("t"))
    degree = F.count(F.lit(1)).over(Window.partitionBy("fid", "side"))
    return rows.withColumn("degree", degree).filter("degree < 3 AND s <> t").select("fid", "side", "related_fid").distinct()


@query(A + "SELECT min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM boxes_a")
def agg_envelope(spark, sf_dir):
    return L.boxes_a(spark, sf_dir).agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))


query(A + "SELECT fid FROM boxes_a WHERE x2 >= 40 AND x1 <= 75 AND y2 >= 20 AND y1 <= 61", "index_range_query")(lambda spark, sf_dir: L.boxes_a(spark, sf_dir).filter("x2 >= 40 AND x1 <= 75 AND y2 >= 20 AND y1 <= 61").select("fid"))


@query(AB + "SELECT a.fid, b.fid AS related_fid FROM boxes_a a JOIN boxes_b b ON a.x1 <= b.x2 AND b.x1 <= a.x2 AND a.y1 <= b.y2 AND b.y1 <= a.y2")
def index_join(spark, sf_dir):
    return r.box_join(L.boxes_a(spark, sf_dir), L.boxes_b(spark, sf_dir)).select(F.col("a.fid").alias("fid"), F.col("b.fid").alias("related_fid"))


@query(P + "SELECT fid, round(sqrt(pow(x - 500, 2) + pow(y - 100, 2)), 6) AS distance FROM pts WHERE pow(x - 500, 2) + pow(y - 100, 2) <= 2500")
def search_near(spark, sf_dir):
    d = F.sqrt(F.pow(F.col("x") - 500, 2) + F.pow(F.col("y") - 100, 2))
    return L.pts(spark, sf_dir).filter("x BETWEEN 450 AND 550 AND y BETWEEN 50 AND 150").withColumn("distance", F.round(d, 6)).filter(d <= 50).select("fid", "distance").orderBy("distance", "fid")


_U = {k: f"least(65535, greatest(0, floor(({k} - min({k}) OVER ()) * 65535.0 / nullif(max({k}) OVER () - min({k}) OVER (), 0))))::BIGINT" for k in "xy"}


@query(P + f"SELECT fid, {' + '.join(f'((u >> {k}) & 1) * {4**k} + ((v >> {k}) & 1) * {2 * 4**k}' for k in range(16))} AS code FROM (SELECT fid, {_U['x']} AS u, {_U['y']} AS v FROM pts)")
def sort_by_zorder(spark, sf_dir):
    """Points in the order of a curve through the layer's box: places from 0 to 65535 each way, their bits interleaved."""
    p = L.pts(spark, sf_dir)
    box = p.agg(*[f(k).alias(f"{k}_{f.__name__}") for k in "xy" for f in (F.min, F.max)]).first()  # one row
    at = lambda k: F.floor((F.col(k) - box[f"{k}_min"]) * 65535.0 / max(1, box[f"{k}_max"] - box[f"{k}_min"]))
    return p.select("fid", g.morton(at("x"), at("y"), 16).alias("code")).orderBy("code", "fid")


_CODE = " + ".join(f"((u >> {k}) & 1) * {4**k} + ((v >> {k}) & 1) * {2 * 4**k}" for k in range(16))


@query(P + f"SELECT fid, code, row_number() OVER w - 1 AS place, ntile(16) OVER w - 1 AS run FROM (SELECT fid, {_CODE} AS code FROM (SELECT fid, {_U['x']} AS u, {_U['y']} AS v FROM pts)) WINDOW w AS (ORDER BY code, fid)")
def sort_by_zorder_runs(spark, sf_dir):
    """That order cut into 16 runs of equal length, each point with its place."""
    return runs.equal_runs(sort_by_zorder(spark, sf_dir), ["code", "fid"], 16)
