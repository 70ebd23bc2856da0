"""Queries of the error relation: rule tables that drive checks, equal shapes, labels of errors, codecs, expressions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quadrille.functions import codec
from quadrille.functions import overlay as o
from quadrille.operators import errors as e
from quadrille.operators import expression
from quadrille.operators import shapes as s
from quadrille.plans.registry import query
from quadrille.plans.shapes import AREAS, LINE_MEETS, LINES_A, SAB, slabs
from quadrille.sources import layers as L
from quadrille.sources import rules
from quadrille.sources.staging import shared_dir

c = F.col

TWINS = L.with_layers("kinds", "shapes_a", "twins")


@query(TWINS + "SELECT fid, first AS related_fid FROM (SELECT fid, min(fid) OVER (PARTITION BY outline) AS first FROM twins) WHERE fid <> first")
def geom_duplicate(spark, sf_dir):
    return e.duplicates(L.twins(spark, sf_dir))


HOLES = TWINS + """, h AS (SELECT fid, list_sort(list((least((px, py), (qx, qy)), greatest((px, py), (qx, qy))))) AS outline FROM ea WHERE ring = 1 GROUP BY fid),
    g AS (SELECT fid, list_sort(list((least((px, py), (qx, qy)), greatest((px, py), (qx, qy))))) AS outline FROM (SELECT fid, px + fid % 2 AS px, py, qx + fid % 2 AS qx, qy FROM ea WHERE ring = 1) GROUP BY fid)"""


@query(HOLES + " SELECT g.fid, min(h.fid) AS related_fid FROM g JOIN h ON g.outline = h.outline GROUP BY g.fid")
def rel_hole_duplicate(spark, sf_dir):
    return e.hole_duplicates(L.plugs(spark, sf_dir), L.shapes_a(spark, sf_dir))


_RULES = [("R1", "PolygonNotOverlap", "a", "b", 4.0, "Y"), ("R2", "PolygonMissingLine", "a", "lines", None, "y"), ("R3", "polygonNotOverlap", "b", "a", 60.0, "Y"), ("#R4", "PolygonNotOverlap", "a", "b", 0.0, "Y"), ("R5", "PolygonNotOverlap", "a", "b", 0.0, "N"), ("R6", "NoSuchCase", "a", "b", 0.0, "Y"), ("R7", "PolygonNotOverlap", "a", "gone", 0.0, "Y")]


def _rules(spark):
    return spark.createDataFrame(_RULES, e.RULE)


def _found(spark, sf_dir):
    layers = {"a": L.shapes_a(spark, sf_dir), "b": L.shapes_b(spark, sf_dir), "LINES": L.paths(spark, sf_dir)}
    return e.run_relations(layers, _rules(spark))


#: Centres of the shapes' areas.
_CENTRE = """z{0} AS (SELECT fid, sum(sg * tx) / (3 * sum(sg * t)) AS x, sum(sg * ty) / (3 * sum(sg * t)) AS y FROM (SELECT *, sign(t) * CASE WHEN ring = 0 THEN 1 ELSE -1 END AS sg FROM (SELECT fid, ring, sum(px * qy - qx * py) AS t, sum((px + qx) * (px * qy - qx * py)) AS tx, sum((py + qy) * (px * qy - qx * py)) AS ty FROM e{0} GROUP BY fid, ring)) GROUP BY fid)"""
RELATED = L.with_layers("kinds", "shapes_a", "shapes_b", "ends") + LINES_A[LINES_A.index(", w AS") :] + LINE_MEETS + slabs("a", "b") + f""", {_CENTRE.format('a')}, {_CENTRE.format('b')},
    r AS (SELECT 'R1' AS rule_id, 'PolygonNotOverlap' AS case_type, 'a' AS table_id, a AS feature_id, 'b' AS related_table_id, b AS related_feature_id, measure, x, y FROM m JOIN za ON za.fid = a WHERE measure > 4
        UNION ALL SELECT 'R2', 'PolygonMissingLine', 'a', ba.fid, 'lines', NULL, NULL, x, y FROM ba JOIN za ON za.fid = ba.fid WHERE ba.fid NOT IN (SELECT b FROM lm)
        UNION ALL SELECT 'R3', 'polygonNotOverlap', 'b', b, 'a', a, measure, x, y FROM m JOIN zb ON zb.fid = b WHERE measure > 60) """


@query(RELATED + "SELECT rule_id, case_type, table_id, feature_id, related_table_id, related_feature_id, CAST(NULL AS VARCHAR) AS field_name, CAST(NULL AS VARCHAR) AS actual_value, CAST(NULL AS VARCHAR) AS expected_value, round(measure, 6) AS measure, round(x, 6) AS x, round(y, 6) AS y, case_type AS message FROM r")
def rules_to_relation_errors(spark, sf_dir):
    """A rule table drives relation checks by their case type; each error has all columns of the error relation."""
    rows = _found(spark, sf_dir)
    return rows.select(*[F.round(k, 6).alias(k) if k in ("measure", "x", "y") else c(k) for k in rows.columns])


@query(RELATED + "SELECT rule_id, case_type, table_id, count(*) AS n, count(DISTINCT feature_id) AS features, round(sum(measure), 4) AS measure FROM r GROUP BY ALL")
def rules_csv_to_errors(spark, sf_dir):
    """The rule table as a CSV file with a comment and rules that are off, read, validated and run; errors by rule."""
    path = f"{shared_dir(spark).rstrip('/')}/rules-{uuid.uuid4().hex}"
    lacking = {n: F.lit(None).cast("string") for n in ("main_name", "related_name", "field_filter", "note")}
    rules.write(_rules(spark).withColumns(lacking), path, "relation")
    table = rules.read(spark, path, "relation")
    wrong = rules.problems(table, "relation", tuple(e.CASES)).select("rule")
    layers = {"a": L.shapes_a(spark, sf_dir), "b": L.shapes_b(spark, sf_dir), "LINES": L.paths(spark, sf_dir)}
    found = e.run_relations(layers, rules.active(table).join(wrong, c("rule_id") == c("rule"), "left_anti"))
    return found.groupBy("rule_id", "case_type", "table_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("feature_id").alias("features"), F.round(F.sum("measure"), 4).alias("measure"))


@query(RELATED + "SELECT rule_id, table_id, count(*) AS n, count(DISTINCT feature_id) AS features, round(min(x), 6) AS min_x, round(min(y), 6) AS min_y, round(max(x), 6) AS max_x, round(max(y), 6) AS max_y FROM r GROUP BY rule_id, table_id")
def agg_error_relation(spark, sf_dir):
    found = e.counts(_found(spark, sf_dir), "rule_id", "table_id")
    return found.select("rule_id", "table_id", "n", "features", *[F.round(f"{f}_{k}", 6).alias(f"{f}_{k}") for k in "xy" for f in ("min", "max")])


@query("SELECT rule_id, case_type, main_table, related_table, tolerance FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{m}', '{t}', {'NULL' if x is None else x}, '{y}')" for a, b, m, t, x, y in _RULES) + ") AS t(rule_id, case_type, main_table, related_table, tolerance, enabled) WHERE upper(enabled) = 'Y' AND rule_id NOT LIKE '#%'")
def load_rules(spark, sf_dir):
    return L.active(_rules(spark)).select("rule_id", "case_type", "main_table", "related_table", "tolerance")


_BASES = ("Info", "Warning", "Error", "Critical")
_TYPES = ("POINT_IN_POLYGON_VIOLATION", "LINE_POLYGON_INTERSECTION_VIOLATION", "OVERLAP")
_RELATIONS = ("Within", "Contains", "Crosses", "Intersects", "Touches", "Overlaps", "Disjoint", "Unknown")
_LISTED = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"
LABELLED = f"""WITH v AS (SELECT event_id, {_LISTED(_BASES)}[event_id % 4 + 1] AS base, {_LISTED(_TYPES)}[event_id % 3 + 1] AS error_type, {_LISTED(_RELATIONS)}[event_id % 8 + 1] AS relation, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'MultiPolygon (((0 0, 1 1, 1 0, 0 0)))' ELSE 'LINESTRING (0 0' || repeat(', 1 1', CAST(event_id % 17 AS INTEGER)) || ')' END AS wkt FROM events),
    u AS (SELECT *, list_position({_LISTED(_BASES)}, base) + CASE WHEN error_type <> 'OVERLAP' AND relation IN ('Within', 'Contains', 'Crosses') THEN 1 ELSE 0 END AS one, coalesce(upper(wkt) LIKE '%MULTI%' OR len(string_split(wkt, ',')) > 10, false) AS many FROM v) """


def _labelled(spark, sf_dir):
    k = c("event_id")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))
    wkt = F.when(k % 5 == 0, None).when(k % 5 == 1, "MultiPolygon (((0 0, 1 1, 1 0, 0 0)))").otherwise(F.concat(F.lit("LINESTRING (0 0"), F.repeat(F.lit(", 1 1"), (k % 17).cast("int")), F.lit(")")))
    return L.read(spark, sf_dir, "events").select(k, pick(_BASES).alias("base"), pick(_TYPES).alias("error_type"), pick(_RELATIONS).alias("relation"), wkt.alias("wkt"))


_LEVEL = f"{_LISTED(_BASES)}[least(4, one + CASE WHEN many THEN 1 ELSE 0 END)]"


@query(LABELLED + f"SELECT event_id, {_LEVEL} AS severity FROM u")
def severity_classify(spark, sf_dir):
    return _labelled(spark, sf_dir).select("event_id", e.severity(c("base"), c("error_type"), c("relation"), c("wkt")).alias("severity"))


@query(LABELLED + f"SELECT event_id, CASE relation {' '.join(f'''WHEN '{k}' THEN '{v}' ''' for k, v in e.CATEGORY.items())} ELSE '일반공간관계오류' END AS category, CASE WHEN many THEN '복잡지오메트리' ELSE '일반' END AS context, CASE {_LEVEL} {' '.join(f'''WHEN '{k}' THEN '{v}' ''' for k, v in e.ACTION.items())} END AS action FROM u")
def error_category(spark, sf_dir):
    rows = _labelled(spark, sf_dir)
    level = e.severity(c("base"), c("error_type"), c("relation"), c("wkt"))
    return rows.select("event_id", e.category(c("relation")).alias("category"), e.context(c("wkt")).alias("context"), e.action(level).alias("action"))


_OWN_AREA = SAB + AREAS.format("a") + "SELECT fid, CAST(area AS DOUBLE) AS area FROM wa"


@query(_OWN_AREA)
def codec_wkt(spark, sf_dir):
    """Shapes written as text and read back."""
    text = L.shapes_a(spark, sf_dir).select("fid", codec.rings_wkt(c("rings")).alias("wkt"))
    return text.select("fid", o.rings_area(F.get(codec.from_wkt(c("wkt")), F.lit(0))).alias("area"))


@query(_OWN_AREA)
def codec_wkb(spark, sf_dir):
    """Shapes written as bytes and read back."""
    raw = L.shapes_a(spark, sf_dir).select("fid", codec.rings_wkb(c("rings")).alias("wkb"))
    return raw.select("fid", o.rings_area(F.get(codec.from_wkb(c("wkb")), F.lit(0))).alias("area"))


_PROBED = [("part", "p_name"), ("PART", "P_BRAND"), ("part", "gone"), ("nowhere", "p_name")]


@query("SELECT t, f, t IN (SELECT table_name FROM duckdb_columns()) AS table_exists, (t, f) IN (SELECT (table_name, column_name) FROM duckdb_columns()) AS field_exists FROM (VALUES " + ", ".join(f"('{t.lower()}', '{f.lower()}')" for t, f in _PROBED) + ") AS p(t, f)")
def table_field_exists(spark, sf_dir):
    """Whether tables and fields are there, whatever the case of their names."""
    layers = {n: L.read(spark, sf_dir, n) for n in ("part", "supplier")}
    return spark.createDataFrame([(t.lower(), f.lower(), L.table_exists(layers, t), L.field_exists(layers, t, f)) for t, f in _PROBED], "t string, f string, table_exists boolean, field_exists boolean")


_EXPRESSIONS = [("height > 20 AND kind = 'OBF001'", "height,kind", "Boolean"), ("lowest + base * 2", "base,lowest", "Numeric"), ("upper(name)", "name", "String"), ("current_date()", "", "Date"), ("b.height", "height", "Mixed")]


@query("SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in row) + ")" for row in _EXPRESSIONS) + ") AS t(expression, fields, kind)")
def expr_fields_type(spark, sf_dir):
    return spark.createDataFrame([(x, ",".join(expression.fields(x)), expression.kind(x)) for x, _, _ in _EXPRESSIONS], "expression string, fields string, kind string")


COND = [("C1", 1, "fid % 3 = 0", "lowest > 0", []), ("C2", 2, "true", "base >= 0", ["C1"]), ("C3", 3, "fid % 2 = 0", "highest > 5", ["C9"])]


@query("WITH b AS (SELECT p_partkey AS fid, p_partkey % 40 - 5 AS lowest, p_partkey % 37 AS base FROM part) SELECT 'C1' AS rule_id, true AS ran, count(*) FILTER (fid % 3 = 0) AS met, count(*) FILTER (fid % 3 = 0 AND NOT lowest > 0) AS violations FROM b UNION ALL SELECT 'C2', true, count(*), count(*) FILTER (NOT base >= 0) FROM b UNION ALL SELECT 'C3', false, NULL, NULL")
def cond_stats(spark, sf_dir):
    """What each conditional rule met and found; a rule whose needs did not run has no counts."""
    return expression.statistics(L.buildings(spark, sf_dir), COND)
