"""Queries of relations between general polygons and lines. Their SQL works from vertices by other ways: areas by slabs
between neighbouring vertices and crossings, points by rays, unions of boxes by unit squares."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadrille.operators import dissolve
from quadrille.operators import relation as r
from quadrille.operators import shapes as s
from quadrille.plans.registry import query
from quadrille.sources import layers as L

MEET = "{0}.x1 <= {1}.x2 AND {1}.x1 <= {0}.x2 AND {0}.y1 <= {1}.y2 AND {1}.y1 <= {0}.y2"


def _cross(p: str, q: str) -> str:
    return f"(({p}.qx - {p}.px) * ({q}.qy - {q}.py) - ({p}.qy - {p}.py) * ({q}.qx - {q}.px))"


def _along(p: str, q: str) -> str:
    """Where on p, from 0 to 1, the line of q crosses it."""
    return f"(({q}.px - {p}.px) * ({q}.qy - {q}.py) - ({q}.py - {p}.py) * ({q}.qx - {q}.px)) / {_cross(p, q)}::DOUBLE"


def slabs(a: str, b: str, extra: str = "") -> str:
    """Common table expressions that end in m: a, b and the area that each pair of shapes shares."""
    inner = lambda n, of: f"""y{of} AS (SELECT s.a, s.b, s.l, s.h, (e.py + (e.qy - e.py) * ((s.l + s.h) / 2 - e.px) / (e.qx - e.px)::DOUBLE) AS y FROM sl s JOIN e{n} e ON e.fid = s.{of} AND least(e.px, e.qx) < (s.l + s.h) / 2 AND greatest(e.px, e.qx) > (s.l + s.h) / 2),
        i{of} AS (SELECT a, b, l, h, y AS lo, lead(y) OVER w AS hi, row_number() OVER w AS n FROM y{of} WINDOW w AS (PARTITION BY a, b, l ORDER BY y) QUALIFY n % 2 = 1)"""  # noqa: E731
    return f""", pr AS (SELECT a.fid AS a, b.fid AS b FROM b{a} a JOIN b{b} b ON {MEET.format('a', 'b')} {extra}),
        xs AS (SELECT a, b, x::DOUBLE AS x FROM pr JOIN v{a} ON fid = a UNION SELECT a, b, x FROM pr JOIN v{b} ON fid = b
            UNION SELECT a, b, p.px + (p.qx - p.px) * {_along('p', 'q')} FROM pr JOIN e{a} p ON p.fid = a JOIN e{b} q ON q.fid = b WHERE {_cross('p', 'q')} <> 0 AND {_along('p', 'q')} BETWEEN 0 AND 1 AND {_along('q', 'p')} BETWEEN 0 AND 1),
        sl AS (SELECT a, b, x AS l, lead(x) OVER (PARTITION BY a, b ORDER BY x) AS h FROM xs QUALIFY h - l > 1e-9),
        {inner(a, 'a')}, {inner(b, 'b')},
        m AS (SELECT a.a, a.b, sum((a.h - a.l) * greatest(0, least(a.hi, b.hi) - greatest(a.lo, b.lo))) AS measure FROM ia a JOIN ib b ON a.a = b.a AND a.b = b.b AND a.l = b.l GROUP BY ALL) """


def _measured(rows):
    return rows.withColumn("measure", F.round("measure", 6))


SA, SB, SAB = (L.with_layers("kinds", *x) for x in (("shapes_a",), ("shapes_b",), ("shapes_a", "shapes_b")))
AREAS = ", w{0} AS (SELECT fid, sum(CASE WHEN ring = 0 THEN 1 ELSE -1 END * area) AS area FROM (SELECT fid, ring, abs(sum(px * qy - qx * py)) / 2 AS area FROM e{0} GROUP BY fid, ring) GROUP BY fid)"


@query(SA + slabs("a", "a", "AND a.fid < b.fid") + "SELECT a AS fid, b AS related_fid, round(measure, 6) AS measure FROM m WHERE measure > 1e-6")
def geom_overlap_shapes(spark, sf_dir):
    a = L.shapes_a(spark, sf_dir)
    return _measured(s.overlaps(a, a, 1e-6, same=True))


@query(SAB + slabs("a", "b") + "SELECT a AS fid, b AS related_fid, round(measure, 6) AS measure FROM m WHERE measure > 4")
def rel_polygon_not_overlap_shapes(spark, sf_dir):
    return _measured(s.overlaps(L.shapes_a(spark, sf_dir), L.shapes_b(spark, sf_dir), 4))


@query(SA + slabs("a", "a", "AND a.fid < b.fid") + "SELECT m.a AS fid, m.b AS related_fid, round(measure, 6) AS measure FROM m JOIN part p ON p.p_partkey = m.a JOIN part q ON q.p_partkey = m.b AND p.p_brand = q.p_brand WHERE measure > 1")
def rel_polygon_intersection_attr_shapes(spark, sf_dir):
    a = L.shapes_a(spark, sf_dir)
    return _measured(s.overlaps(a, a, 1, same=True, keys=("brand",)))


@query(SAB + AREAS.format("a") + AREAS.format("b") + slabs("a", "b") + "SELECT a AS fid, b AS related_fid, round(measure, 6) AS measure FROM m JOIN wa ON wa.fid = a JOIN wb ON wb.fid = b WHERE measure > 1 AND measure < least(wa.area, wb.area) - 1e-6")
def topo_must_not_overlap_shapes(spark, sf_dir):
    return _measured(s.partly_overlaps(L.shapes_a(spark, sf_dir), L.shapes_b(spark, sf_dir), 1))


@query(SAB + AREAS.format("b") + slabs("a", "b") + "SELECT a AS fid, b AS related_fid, CASE WHEN measure > wb.area - 1e-6 THEN 'inside' ELSE 'overlap' END AS label FROM m JOIN wb ON wb.fid = b WHERE measure > 1e-6")
def rel_polygon_contains_objects_shapes(spark, sf_dir):
    return s.contained(L.shapes_b(spark, sf_dir), L.shapes_a(spark, sf_dir))


def _odd(edges: str, fid: str, x: str, y: str) -> str:
    return f"(SELECT count(*) % 2 = 1 FROM {edges} t WHERE t.fid = {fid} AND (t.py > {y}) <> (t.qy > {y}) AND {x} < t.px + (t.qx - t.px) * ({y} - t.py) / (t.qy - t.py)::DOUBLE)"


def _on(edges: str, fid: str, x: str, y: str) -> str:
    return f"EXISTS (SELECT 1 FROM {edges} t WHERE t.fid = {fid} AND abs((t.qx - t.px) * ({y} - t.py) - (t.qy - t.py) * ({x} - t.px)) < 1e-7 AND {x} BETWEEN least(t.px, t.qx) - 1e-9 AND greatest(t.px, t.qx) + 1e-9 AND {y} BETWEEN least(t.py, t.qy) - 1e-9 AND greatest(t.py, t.qy) + 1e-9)"


#: Sides that cross or touch: the ends of each lie on both sides of the other.
_SIDES_MEET = " AND ".join(
    f"sign(({s}.qx - {s}.px) * ({t}.py - {s}.py) - ({s}.qy - {s}.py) * ({t}.px - {s}.px)) * sign(({s}.qx - {s}.px) * ({t}.qy - {s}.py) - ({s}.qy - {s}.py) * ({t}.qx - {s}.px)) <= 0" for s, t in (("p", "q"), ("q", "p"))
) + " AND least(p.px, p.qx) <= greatest(q.px, q.qx) AND least(q.px, q.qx) <= greatest(p.px, p.qx) AND least(p.py, p.qy) <= greatest(q.py, q.qy) AND least(q.py, q.qy) <= greatest(p.py, p.qy)"


@query(SAB + slabs("a", "b") + f", t AS (SELECT DISTINCT a, b FROM pr JOIN ea p ON p.fid = a JOIN eb q ON q.fid = b WHERE {_SIDES_MEET}) SELECT a AS fid, b AS related_fid FROM t WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.a = t.a AND m.b = t.b AND measure > 1e-6)")
def topo_touches_shapes(spark, sf_dir):
    return s.touches(L.shapes_a(spark, sf_dir), L.shapes_b(spark, sf_dir))


PTS_A = L.with_layers("kinds", "shapes_a", "pts")


@query(PTS_A + f", c AS (SELECT p.fid AS point, b.fid AS polygon FROM pts p JOIN ba b ON p.x BETWEEN b.x1 AND b.x2 AND p.y BETWEEN b.y1 AND b.y2 WHERE {_odd('ea', 'b.fid', 'p.x', 'p.y')} AND NOT {_on('ea', 'b.fid', 'p.x', 'p.y')}) SELECT 'polygon' AS side, fid FROM ba WHERE fid NOT IN (SELECT polygon FROM c) UNION ALL SELECT 'point', fid FROM pts WHERE fid NOT IN (SELECT point FROM c)")
def rel_point_inside_polygon_shapes(spark, sf_dir):
    return s.points_and_polygons(L.pts(spark, sf_dir), L.shapes_a(spark, sf_dir))


CENTRES = f""", z AS (SELECT fid, ring, sum(px * qy - qx * py) AS t, sum((px + qx) * (px * qy - qx * py)) AS tx, sum((py + qy) * (px * qy - qx * py)) AS ty FROM eb GROUP BY fid, ring),
    p AS (SELECT fid, sum(sg * tx) / (3 * sum(sg * t)) AS x, sum(sg * ty) / (3 * sum(sg * t)) AS y FROM (SELECT *, sign(t) * CASE WHEN ring = 0 THEN 1 ELSE -1 END AS sg FROM z) GROUP BY fid),
    c AS (SELECT p.fid AS point, b.fid AS polygon FROM p JOIN ba b ON p.x BETWEEN b.x1 AND b.x2 AND p.y BETWEEN b.y1 AND b.y2 WHERE {_odd('ea', 'b.fid', 'p.x', 'p.y')} AND NOT {_on('ea', 'b.fid', 'p.x', 'p.y')})
    SELECT 'polygon' AS side, fid FROM ba WHERE fid NOT IN (SELECT polygon FROM c) UNION ALL SELECT 'point', fid FROM p WHERE fid NOT IN (SELECT point FROM c)"""


@query(SAB + CENTRES)
def rel_building_center_shapes(spark, sf_dir):
    """Polygons that hold no building's centre, and centres in no polygon."""
    return s.points_and_polygons(s.centre_points(L.shapes_b(spark, sf_dir)), L.shapes_a(spark, sf_dir))


#: Lines of three vertices: their sides (le), boxes (bl) and first vertices.
PATHS = ", w AS (SELECT fid, xa, ya, xa + fid % 4 AS xm, ya + fid % 3 AS ym, xb, yb, status FROM lines), le AS (SELECT fid, 0 AS nth, xa AS px, ya AS py, xm AS qx, ym AS qy FROM w UNION ALL SELECT fid, 1, xm, ym, xb, yb FROM w), bl AS (SELECT fid, least(xa, xm, xb) AS x1, least(ya, ym, yb) AS y1, greatest(xa, xm, xb) AS x2, greatest(ya, ym, yb) AS y2, xa, ya FROM w)"
LINES_A = L.with_layers("kinds", "shapes_a", "ends") + PATHS
LINE_MEETS = f", lm AS (SELECT l.fid AS l, b.fid AS b FROM bl l JOIN ba b ON {MEET.format('l', 'b')} WHERE {_odd('ea', 'b.fid', 'l.xa', 'l.ya')} OR EXISTS (SELECT 1 FROM le p JOIN ea q ON q.fid = b.fid WHERE p.fid = l.fid AND {_SIDES_MEET}))"


@query(LINES_A + LINE_MEETS + "SELECT b AS fid, l AS related_fid FROM lm")
def rel_polygon_not_intersect_line_shapes(spark, sf_dir):
    return s.lines_meet(L.shapes_a(spark, sf_dir), L.paths(spark, sf_dir))


@query(LINES_A + LINE_MEETS + "SELECT fid FROM ba WHERE fid NOT IN (SELECT b FROM lm)")
def rel_polygon_missing_line_shapes(spark, sf_dir):
    a = L.shapes_a(spark, sf_dir)
    met = s.lines_meet(a, L.paths(spark, sf_dir)).select(F.col("fid").alias("_met"))
    return a.join(met, F.col("fid") == F.col("_met"), "left_anti").select("fid")


#: Each side of a line is cut where a polygon's sides cross or end on it; the middle of each piece tells where it lies.
CUTS = f""", ct AS (SELECT l, b, nth, 0.0::DOUBLE AS t FROM lm JOIN le ON fid = l UNION SELECT l, b, nth, 1.0 FROM lm JOIN le ON fid = l
        UNION SELECT l, b, p.nth, {_along('p', 'q')} FROM lm JOIN le p ON p.fid = l JOIN ea q ON q.fid = b WHERE {_cross('p', 'q')} <> 0 AND {_along('p', 'q')} BETWEEN 0 AND 1 AND {_along('q', 'p')} BETWEEN 0 AND 1
        UNION SELECT l, b, p.nth, ((q.px - p.px) * (p.qx - p.px) + (q.py - p.py) * (p.qy - p.py)) / nullif((p.qx - p.px) ** 2 + (p.qy - p.py) ** 2, 0)::DOUBLE AS t FROM lm JOIN le p ON p.fid = l JOIN ea q ON q.fid = b WHERE {_cross('p', 'q')} = 0 AND t BETWEEN 0 AND 1),
    pc AS (SELECT l, b, nth, t, lead(t) OVER (PARTITION BY l, b, nth ORDER BY t) AS u FROM ct QUALIFY u - t > 1e-12),
    md AS (SELECT l, b, (u - t) * sqrt((e.qx - e.px) ** 2 + (e.qy - e.py) ** 2) AS len, e.px + (e.qx - e.px) * (t + u) / 2 AS x, e.py + (e.qy - e.py) * (t + u) / 2 AS y FROM pc JOIN le e ON e.fid = l AND e.nth = pc.nth),
    ln AS (SELECT l, b, sum(CASE WHEN {_odd('ea', 'b', 'md.x', 'md.y')} OR {_on('ea', 'b', 'md.x', 'md.y')} THEN len ELSE 0 END) AS inside, sum(len) AS len FROM md GROUP BY l, b) """


@query(LINES_A + LINE_MEETS + CUTS + "SELECT l AS fid, b AS related_fid, CASE WHEN inside >= len - 1e-6 THEN 'Within' WHEN inside > 1e-6 THEN 'Crosses' ELSE 'Touches' END AS kind, round(inside, 6) AS measure FROM ln")
def srel_line_polygon_shapes(spark, sf_dir):
    return _measured(s.line_in_polygon(L.paths(spark, sf_dir).filter("xa <> xb OR ya <> yb"), L.shapes_a(spark, sf_dir)))


@query()
def rel_line_within_polygon_shapes(spark, sf_dir):
    """Lines of which more than a half unit lies outside the union of polygons; tests hold it against a plain version."""
    return _measured(s.lines_within(L.paths(spark, sf_dir), L.shapes_a(spark, sf_dir), 0.5))


#: Unit squares of boxes with whole corners: those of a that no box of b holds.
UNIT = "q AS (SELECT a.fid, x1 + i AS x, y1 + j AS y FROM {0} a, generate_series(0, a.x2 - a.x1 - 1) AS s(i), generate_series(0, a.y2 - a.y1 - 1) AS t(j)), n AS (SELECT fid, count(*) AS measure FROM q WHERE NOT EXISTS (SELECT 1 FROM {1} b WHERE b.x1 <= q.x AND q.x < b.x2 AND b.y1 <= q.y AND q.y < b.y2) GROUP BY fid)"
BOXES = L.with_layers("boxes_a", "boxes_b")


def _boxes(spark, sf_dir):
    return s.boxes(L.boxes_a(spark, sf_dir)), s.boxes(L.boxes_b(spark, sf_dir))


@query(BOXES + ", " + UNIT.format("boxes_b", "boxes_a") + " SELECT fid, CAST(measure AS DOUBLE) AS measure FROM n WHERE measure > 1")
def topo_must_cover(spark, sf_dir):
    """Targets of which the union of this layer leaves more than 1 uncovered."""
    a, b = _boxes(spark, sf_dir)
    return _measured(s.must_be_covered(b, a, 1))


@query(BOXES + ", " + UNIT.format("boxes_a", "boxes_b") + " SELECT fid, CAST(measure AS DOUBLE) AS measure FROM n WHERE measure > 1")
def topo_must_be_covered_by_union(spark, sf_dir):
    """What the union of targets leaves uncovered; two targets may cover jointly."""
    return _measured(s.must_be_covered(*_boxes(spark, sf_dir), 1))


@query(BOXES + ", " + UNIT.format("boxes_b", "boxes_a") + " SELECT n.fid, CAST(measure AS DOUBLE) AS measure FROM n JOIN boxes_b b ON b.fid = n.fid WHERE measure > 4 AND measure >= 0.01 * (x2 - x1) * (y2 - y1)")
def rel_polygon_within_polygon_union(spark, sf_dir):
    a, b = _boxes(spark, sf_dir)
    return _measured(s.polygons_within(b, a, 2))


@query(BOXES + ", " + UNIT.format("boxes_a", "boxes_b") + " SELECT CAST((max(a.x2) - min(a.x1)) * (max(a.y2) - min(a.y1)) - (SELECT count(*) FROM (SELECT DISTINCT x, y FROM q)) AS DOUBLE) AS measure FROM boxes_a a")
def topo_must_not_have_gaps(spark, sf_dir):
    return _measured(dissolve.gaps(s.boxes(L.boxes_a(spark, sf_dir))))


@query(BOXES + ", " + UNIT.format("boxes_b", "boxes_a") + " SELECT CAST(count(*) AS DOUBLE) AS area FROM (SELECT DISTINCT x, y FROM q)")
def agg_union_geometry(spark, sf_dir):
    """The area of the union of a layer, dissolved cell by cell into strips (shapes.union_pieces)."""
    return s.union_area(s.boxes(L.boxes_b(spark, sf_dir))).select(F.round("area", 6).alias("area"))


@query()
def agg_union_geometry_shapes(spark, sf_dir):
    """The strips themselves, for slanted and holed polygons; tests hold their area against a plain version."""
    return s.union_pieces(L.shapes_b(spark, sf_dir)).select(*[F.round(k, 6).alias(k) for k in ("x1", "x2", "low1", "high1", "low2", "high2")])


_STRETCH = "least(a.x2, b.x2) - greatest(a.x1, b.x1)"


@query(L.with_layers("hlines") + f"SELECT a.fid, b.fid AS related_fid, round(({_STRETCH}) * sqrt(2), 6) AS measure FROM hlines a JOIN hlines b ON a.fid < b.fid AND a.y1 = b.y1 AND {_STRETCH} > 0")
def rel_contour_intersection_paths(spark, sf_dir):
    """Stretches that slanted lines share; crossings in a point are left out."""
    at = lambda k: F.struct(F.col(k).cast("double").alias("x"), (F.col("y1") + F.col(k)).cast("double").alias("y"))
    slanted = L.hlines(spark, sf_dir).select("fid", F.when(F.col("fid") % 2 == 0, F.array(at("x1"), at("x2"))).otherwise(F.array(at("x2"), at("x1"))).alias("path"))
    return _measured(s.lines_share(slanted))


def grid_tier(span, tolerance: float):
    """The cell's edge by the layer's extent: a hundredth over 100,000 units, a 500th over 10,000, else some tolerances,
    but no less than a 2,000th of the extent and one unit."""
    safe = span * 0.05 / 100
    tier = F.when(span > 100_000, span / 100).when(span > 10_000, span / 500).when(span > 1_000, F.greatest(F.lit(tolerance * 100), safe)).otherwise(F.greatest(F.lit(tolerance * 10), safe))
    return F.greatest(tier, F.lit(1.0))


@query(BOXES + "SELECT k AS scale, greatest(1.0, CASE WHEN w > 100000 THEN w / 100 WHEN w > 10000 THEN w / 500 WHEN w > 1000 THEN greatest(2.0, w * 0.0005) ELSE greatest(0.2, w * 0.0005) END) AS size FROM (SELECT k, k * greatest(max(x2) - min(x1), max(y2) - min(y1))::DOUBLE AS w FROM boxes_a, (VALUES (1), (2), (50), (1000)) AS s(k) GROUP BY k)")
def agg_grid_size(spark, sf_dir):
    """For the layer as it is and drawn out 2, 50 and 1000 times."""
    span = F.greatest(F.max("x2") - F.min("x1"), F.max("y2") - F.min("y1")).cast("double")
    wide = L.boxes_a(spark, sf_dir).agg(span.alias("w")).select("w", F.explode(F.array(*map(F.lit, (1, 2, 50, 1000)))).alias("scale"))
    return wide.select("scale", grid_tier(F.col("w") * F.col("scale"), 0.02).alias("size"))


def _apart(x: str, y: str, t: str) -> str:
    """How far (x, y) is from side t."""
    d2 = f"(({t}.qx - {t}.px) ** 2 + ({t}.qy - {t}.py) ** 2)"
    at = f"greatest(0, least(1, coalesce((({x} - {t}.px) * ({t}.qx - {t}.px) + ({y} - {t}.py) * ({t}.qy - {t}.py)) / nullif({d2}, 0)::DOUBLE, 0)))"
    return f"sqrt(({x} - {t}.px - {at} * ({t}.qx - {t}.px)) ** 2 + ({y} - {t}.py - {at} * ({t}.qy - {t}.py)) ** 2)"


def _away_sql(points: str, key: str, reach: float) -> str:
    box = f"p.x BETWEEN b.x1 - {reach} AND b.x2 + {reach} AND p.y BETWEEN b.y1 - {reach} AND b.y2 + {reach}"
    return f"SELECT {key} FROM {points} p WHERE NOT EXISTS (SELECT 1 FROM ba b WHERE {box} AND ({_odd('ea', 'b.fid', 'p.x', 'p.y')} OR (SELECT min({_apart('p.x', 'p.y', 't')}) FROM ea t WHERE t.fid = b.fid) <= {reach}))"


ENDS_OF = ", en AS (SELECT fid, 'start' AS side, xa AS x, ya AS y FROM w UNION ALL SELECT fid, 'end', xb, yb FROM w), vx AS (SELECT fid, unnest([0, 1, 2]) AS nth, unnest([xa, xm, xb]) AS x, unnest([ya, ym, yb]) AS y FROM w) "


@query(LINES_A + ENDS_OF + _away_sql("en", "fid, side", 1))
def rel_line_endpoint_within_shapes(spark, sf_dir):
    return s.points_away(s.ends(L.paths(spark, sf_dir)), L.shapes_a(spark, sf_dir), 1, ("fid", "side")).select("fid", "side")


@query(LINES_A + ENDS_OF + _away_sql("vx", "DISTINCT fid", 2))
def rel_polygon_contains_line_shapes(spark, sf_dir):
    """Lines with a vertex that no polygon is near."""
    return s.points_away(s.vertices(L.paths(spark, sf_dir)), L.shapes_a(spark, sf_dir), 2, ("fid", "nth")).select("fid").distinct()


@query(LINES_A + ENDS_OF + ", z AS (" + _away_sql("en", "fid, side, x, y", 1) + ") SELECT fid, side FROM z a WHERE NOT EXISTS (SELECT 1 FROM en b WHERE a.fid <> b.fid AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 4)")
def rel_defective_connection_shapes(spark, sf_dir):
    """Ends that neither another line's end nor a polygon is near."""
    free = r.unconnected(s.ends(L.paths(spark, sf_dir)), 2)
    return s.points_away(free, L.shapes_a(spark, sf_dir), 1, ("fid", "side")).select("fid", "side")


@query(PTS_A + f"SELECT b.fid, p.fid AS related_fid FROM pts p JOIN ba b ON p.x BETWEEN b.x1 AND b.x2 AND p.y BETWEEN b.y1 AND b.y2 WHERE p.kind = 'error' AND {_odd('ea', 'b.fid', 'p.x', 'p.y')} AND NOT {_on('ea', 'b.fid', 'p.x', 'p.y')}")
def rel_polygon_not_contain_point_shapes(spark, sf_dir):
    found = s.points_in(L.pts(spark, sf_dir).filter("kind = 'error'"), L.shapes_a(spark, sf_dir))
    return found.select(F.col("polygon").alias("fid"), F.col("point").alias("related_fid"))


def _nearest(x: str, y: str, t: str) -> str:
    """The distance of (x, y) from side t and the point of t that has it."""
    at = f"greatest(0, least(1, coalesce((({x} - {t}.px) * ({t}.qx - {t}.px) + ({y} - {t}.py) * ({t}.qy - {t}.py)) / nullif(({t}.qx - {t}.px) ** 2 + ({t}.qy - {t}.py) ** 2, 0)::DOUBLE, 0)))"
    return f"{{{{d: round({_apart(x, y, t)}, 9), x: {t}.px + {at} * ({t}.qx - {t}.px), y: {t}.py + {at} * ({t}.qy - {t}.py)}}}}"


LOOSE = L.with_layers("ends") + PATHS + ENDS_OF + f""", d AS (SELECT a.fid, a.side, b.fid AS other, b.xa, b.ya, b.xb, b.yb, (SELECT min({_nearest('a.x', 'a.y', 't')}) FROM le t WHERE t.fid = b.fid) AS n
        FROM en a JOIN (SELECT bl.*, w.xa, w.ya, w.xb, w.yb FROM bl JOIN w ON w.fid = bl.fid) b ON a.fid <> b.fid AND a.x BETWEEN b.x1 - 2 AND b.x2 + 2 AND a.y BETWEEN b.y1 - 2 AND b.y2 + 2),
    s AS (SELECT fid, side, n.d AS measure, least(sqrt((n.x - xa) ** 2 + (n.y - ya) ** 2), sqrt((n.x - xb) ** 2 + (n.y - yb) ** 2)) < 0.001 AS at_end FROM d QUALIFY row_number() OVER (PARTITION BY fid, side ORDER BY n.d, other) = 1),
    f AS (SELECT * FROM s WHERE measure >= 0.001 AND measure < 2 QUALIFY row_number() OVER (PARTITION BY fid ORDER BY side DESC) = 1) SELECT fid, side, round(measure, 6) AS measure FROM f WHERE {{}}at_end"""


@query(LOOSE.format(""))
def geom_overshoot_paths(spark, sf_dir):
    """Ends that join no other line, beside one whose nearest point is one of its ends."""
    return _measured(s.loose_ends(L.paths(spark, sf_dir), 2).filter("at_end").drop("at_end"))


@query(LOOSE.format("NOT "))
def geom_undershoot_paths(spark, sf_dir):
    return _measured(s.loose_ends(L.paths(spark, sf_dir), 2).filter("NOT at_end").drop("at_end"))


_TURN = "degrees(acos(greatest(-1, least(1, ((x - ux) * (wx - x) + (y - uy) * (wy - y)) / nullif(sqrt(((x - ux) ** 2 + (y - uy) ** 2) * ((wx - x) ** 2 + (wy - y) ** 2)), 0)))))"
_TRACKS = "v AS (SELECT fid, i AS nth, xa + i AS x, ya + (i * i * 7919 + i * fid * 31 + fid) % 1009 / 512 AS y FROM lines, generate_series(0, 19 + fid % 41) AS s(i))"


@query(L.with_layers("ends") + f", {_TRACKS}, t AS (SELECT *, lag(x) OVER w AS ux, lag(y) OVER w AS uy, lead(x) OVER w AS wx, lead(y) OVER w AS wy FROM v WINDOW w AS (PARTITION BY fid ORDER BY nth)), u AS (SELECT fid, nth, {_TURN} AS turn FROM t WHERE ux IS NOT NULL AND wx IS NOT NULL) SELECT fid, min(nth) AS nth, round(arg_min(turn, nth), 4) AS measure FROM u WHERE turn < 30.5 GROUP BY fid")
def rel_road_sharp_bend_tracks(spark, sf_dir):
    """Lines of 20 to 60 vertices: the first vertex whose turn is under the limit."""
    return s.sharp_bends(L.tracks(spark, sf_dir), 30.5).select("fid", F.col("nth").cast("long").alias("nth"), F.round("measure", 4).alias("measure"))


@query(SA + f", t AS (SELECT fid, ring, nth, x, y, coalesce(lag(x) OVER w, last_value(x) OVER f) AS ux, coalesce(lag(y) OVER w, last_value(y) OVER f) AS uy, coalesce(lead(x) OVER w, first_value(x) OVER f) AS wx, coalesce(lead(y) OVER w, first_value(y) OVER f) AS wy FROM (SELECT * FROM va QUALIFY nth < max(nth) OVER (PARTITION BY fid, ring)) WINDOW w AS (PARTITION BY fid, ring ORDER BY nth), f AS (PARTITION BY fid, ring ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) SELECT fid, ring, nth, round(180 - {_TURN}, 4) AS measure FROM t WHERE 180 - {_TURN} < 60.5")
def geom_spike_rings(spark, sf_dir):
    """Sharp vertices of rings, the first one and those of holes too."""
    return s.spikes(L.shapes_a(spark, sf_dir), 60.5).select("fid", "ring", "nth", F.round("measure", 4).alias("measure"))
