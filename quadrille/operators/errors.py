"""The error relation that every check can fill, what is said of its rows, and counts over it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions import filters
from quadrille.functions import overlay as o
from quadrille.operators import attribute, relation, shapes, topology
from quadrille.sources.staging import staged

c = F.col
SCHEMA = "rule_id string, case_type string, table_id string, feature_id long, related_table_id string, related_feature_id long, field_name string, actual_value string, expected_value string, measure double, x double, y double, message string"
COLUMNS = [x.split()[0] for x in SCHEMA.split(", ")]


def errors(found: DataFrame, **values) -> DataFrame:
    """Rows of the error relation: its columns from those of found, from values, or null."""
    kinds = dict(x.split() for x in SCHEMA.split(", "))
    own = {k: c(k) if k in found.columns else v if isinstance(v := values.get(k), Column) else F.lit(v) for k in COLUMNS}
    return found.select(*[own[k].cast(kinds[k]).alias(k) for k in COLUMNS])


def place(kind: str, geometry: Column) -> Column:
    """Where an error is shown: a polygon's centre of area, else the centre of its box; a line's middle vertex; a point."""
    if kind == "point":
        return geometry
    if kind == "line":
        return F.get(geometry, F.floor(F.size(geometry) / 2).cast("int"))
    box = o.box_of(F.get(geometry, F.lit(0)))
    middle = F.struct(((box["x1"] + box["x2"]) / 2).alias("x"), ((box["y1"] + box["y2"]) / 2).alias("y"))
    return F.coalesce(o.centroid(geometry), middle)


def located(found: DataFrame, layer: DataFrame, kind: str, geometry: str) -> DataFrame:
    """found (fid, ...) with x and y of its features."""
    at = layer.select(c("fid").alias("_fid"), place(kind, c(geometry)).alias("_at"))
    return found.join(at, c("fid") == c("_fid"), "left").withColumns({"x": c("_at.x"), "y": c("_at.y")}).drop("_fid", "_at")


# --- relation checks by case type -----------------------------------------------------------------------------

CASES: dict[str, Callable[..., DataFrame]] = {}


@dataclass
class Rule:
    """What a check may need of its rule: a distance, area or angle, and the fields and options of its field text."""

    tolerance: float = 0.0
    fields: tuple[str, ...] = ()
    options: dict[str, list[str]] = field(default_factory=dict)


def case_type(name: str, kind: str = "polygon", geometry: str | None = "rings"):
    """Registers a check of (main layer, related layer, rule) that gives fid and maybe related_fid and measure; without a
    geometry it gives x and y too."""

    def add(f):
        CASES[name.lower()] = lambda main, related, rule: f(main, related, rule) if geometry is None else located(f(main, related, rule), main, kind, geometry)
        return f

    return add


@case_type("PolygonNotOverlap")
def _not_overlap(main, related, rule):
    return shapes.overlaps(main, related, rule.tolerance)


@case_type("PolygonNotIntersectLine")
def _not_intersect_line(main, related, rule):
    return shapes.lines_meet(main, related)


@case_type("PolygonMissingLine")
def _missing_line(main, related, rule):
    met = shapes.met_by_lines(main, related).select(c("fid").alias("_met"))
    return main.join(met, c("fid") == c("_met"), "left_anti").select("fid")


@case_type("PolygonWithinPolygon")
def _within(main, related, rule):
    return shapes.polygons_within(main, related, rule.tolerance)


@case_type("PolygonNotContainPoint")
def _not_contain_point(main, related, rule):
    return shapes.points_in(related, main).select(c("polygon").alias("fid"), c("point").alias("related_fid"))


@case_type("LineWithinPolygon", "line", "path")
def _line_within(main, related, rule):
    return shapes.lines_within(main, related, rule.tolerance)


@case_type("ContourIntersection", "line", "path")
def _contour(main, related, rule):
    return shapes.lines_share(main)


@case_type("PointInsidePolygon")
def _point_inside(main, related, rule):
    """Polygons without a point."""
    return shapes.points_and_polygons(related, main).filter("side = 'polygon'").select("fid")


@case_type("BuildingCenterPoints")
def _centre(main, related, rule):
    """Polygons that hold no centre of the other layer's."""
    return shapes.points_and_polygons(shapes.centre_points(related), main).filter("side = 'polygon'").select("fid")


@case_type("PolygonNotWithinPolygon")
def _not_within(main, related, rule):
    """Polygons that lie in one of the others, or over its outline."""
    return shapes.contained(main, related).select(c("related_fid").alias("fid"), c("fid").alias("related_fid"))


@case_type("PolygonContainsObjects")
def _contains(main, related, rule):
    return shapes.contained(related, main).select("fid", "related_fid")


@case_type("PolygonIntersectionWithAttribute")
def _same_attribute(main, related, rule):
    return shapes.overlaps(main, related, rule.tolerance, keys=rule.fields)


@case_type("HoleDuplicateCheck", geometry=None)
def _holes(main, related, rule):
    return located(hole_duplicates(related, main), related, "polygon", "rings")


@case_type("PolygonContainsLine", "line", "path")
def _vertices_within(main, related, rule):
    """Lines with a vertex that no polygon is near."""
    return shapes.points_away(shapes.vertices(main), related, rule.tolerance, ("fid", "nth")).select("fid").distinct()


@case_type("LineIntersectionWithAttribute", "line", "path")
def _lines_same_attribute(main, related, rule):
    return shapes.lines_share(main, keys=rule.fields)


@case_type("RoadSharpBend", geometry=None)
@case_type("ContourSharpBend", geometry=None)
def _bends(main, related, rule):
    """The first inner vertex of a line whose turn is below the limit, at its place."""
    found = shapes.sharp_bends(main, rule.tolerance)
    at = main.select(c("fid").alias("_fid"), "path")
    return found.join(at, c("fid") == c("_fid")).select("fid", "measure", F.get("path", c("nth"))["x"].alias("x"), F.get("path", c("nth"))["y"].alias("y"))


def _ends(layer: DataFrame, fields: tuple[str, ...] = ()) -> DataFrame:
    own = layer.select(c("fid").alias("_fid"), *fields)
    return shapes.ends(layer).join(own, c("fid") == c("_fid")).drop("_fid") if fields else shapes.ends(layer)


@case_type("LineEndpointWithinPolygon", geometry=None)
def _ends_within(main, related, rule):
    return shapes.points_away(shapes.ends(main), related, rule.tolerance, ("fid", "side")).select("fid", "x", "y")


@case_type("LineDisconnection", geometry=None)
def _disconnected(main, related, rule):
    return relation.unconnected(_ends(main), rule.tolerance).select("fid", "x", "y")


@case_type("LineDisconnectionWithAttribute", geometry=None)
def _disconnected_attribute(main, related, rule):
    """Ends without an end of another line of the same values near."""
    return relation.unconnected(_ends(main, rule.fields), rule.tolerance, keys=rule.fields).select("fid", "x", "y")


@case_type("DefectiveConnection", geometry=None)
def _defective(main, related, rule):
    """Ends that neither another line's end nor a polygon is near."""
    free = relation.unconnected(_ends(main), rule.tolerance)
    return shapes.points_away(free, related, rule.tolerance, ("fid", "side")).select("fid", "x", "y")


@case_type("ConnectedLinesSameAttribute", geometry=None)
def _connected_same(main, related, rule):
    """Ends near each other whose lines have different values: numbers by more than a hundredth, else as text."""
    number = lambda v: v.try_cast("double")
    differ = F.lit(False)
    for f in rule.fields:
        a, b = c(f"a.{f}"), c(f"b.{f}")
        differ |= F.coalesce(F.abs(number(a.cast("string")) - number(b.cast("string"))) > 0.01, ~a.cast("string").eqNullSafe(b.cast("string")))
    pairs = relation.near_ends(_ends(main, rule.fields), rule.tolerance, condition=(c("a.fid") < c("b.fid")) & differ)
    return pairs.groupBy(c("a.fid").alias("fid"), c("b.fid").alias("related_fid")).agg(F.min(F.struct("a.x", "a.y")).alias("at")).select("fid", "related_fid", "at.x", "at.y")


@case_type("PointSpacingCheck", geometry=None)
def _spacing(main, related, rule):
    found = relation.spacing(main, F.lit(rule.tolerance), rule.tolerance)
    at = main.select(c("fid").alias("_fid"), "x", "y")
    return found.join(at, c("fid") == c("_fid")).select("fid", "related_fid", "measure", "x", "y")


@case_type("PolygonBoundaryMatch", "line", "path")
def _boundary(main, related, rule):
    """Lines that have no polygon about them, or a vertex that no vertex of an outline is near."""
    outlines = related.select("fid", F.get("rings", F.lit(0)).alias("ring"))
    boxed = lambda df, of: df.withColumns(o.box_of(c(of)))
    found = topology.boundary_mismatch(boxed(main.select("fid", "path"), "path"), boxed(outlines, "ring"), rule.tolerance)
    return found.select("fid", c("first_vertex").cast("double").alias("measure"))


RULE = "rule_id string, case_type string, main_table string, related_table string, tolerance double, enabled string"


def _narrowed(layers: list[DataFrame], text: str | None) -> tuple[list[DataFrame], Rule]:
    """Layers that a field text filters, or the fields and options that it names."""
    try:
        return [df.filter(filters.parsed(df, text)) if text else df for df in layers], Rule()
    except ValueError:
        fields, given = filters.options(text)
        return layers, Rule(fields=tuple(fields), options=given)


def run_relations(layers: dict[str, DataFrame], rules: DataFrame) -> DataFrame:
    """The errors of a rule table (RULE, and maybe field_filter) over layers. Rules that are not enabled, whose id begins
    with #, of an unknown case type or a layer that is not there are passed over. A field text that is a filter narrows
    both layers; one that names fields and options goes to the check. Layers that rules name are written once and read
    by each rule from there, so the plan of many rules stays small. A rule table is configuration: some dozens of
    rows."""
    known, written, out = {k.lower(): v for k, v in layers.items()}, {}, None
    for rule in rules.filter("upper(enabled) = 'Y' AND NOT startswith(rule_id, '#')").orderBy("rule_id").collect():
        check, main, related = CASES.get(rule["case_type"].lower()), known.get(rule["main_table"].lower()), known.get((rule["related_table"] or "").lower())
        if check is None or main is None or related is None:
            continue
        for name in (rule["main_table"].lower(), rule["related_table"].lower()):
            written[name] = written[name] if name in written else staged(known[name])
        main, related = written[rule["main_table"].lower()], written[rule["related_table"].lower()]
        (main, related), own = _narrowed([main, related], rule["field_filter"] if "field_filter" in rules.columns else None)
        own.tolerance = rule["tolerance"] or 0.0
        found = check(main, related, own).withColumnRenamed("fid", "feature_id")
        found = found.withColumnRenamed("related_fid", "related_feature_id")
        rows = errors(found, rule_id=rule["rule_id"], case_type=rule["case_type"], table_id=rule["main_table"], related_table_id=rule["related_table"], message=rule["case_type"])
        out = rows if out is None else out.unionByName(rows)
    return out if out is not None else rules.sparkSession.createDataFrame([], SCHEMA)


def attribute_errors(layers: dict[str, DataFrame], rules: list[tuple]) -> DataFrame:
    """attribute.run_rules as rows of the error relation."""
    return errors(attribute.run_rules(layers, rules), case_type="Attribute")


# --- what is said of errors -----------------------------------------------------------------------------------

#: Severities from the least on.
SEVERITIES = ("Info", "Warning", "Error", "Critical")
#: Labels of relation types and actions by severity.
CATEGORY = {"Contains": "포함관계오류", "Within": "포함관계오류", "Intersects": "교차관계오류", "Crosses": "교차관계오류", "Touches": "접촉관계오류", "Overlaps": "겹침관계오류", "Disjoint": "분리관계오류"}
ACTION = {"Critical": "즉시수정필요", "Error": "수정권장", "Warning": "검토필요", "Info": "참고사항"}


def complex_geometry(wkt: Column) -> Column:
    return F.coalesce(F.upper(wkt).contains("MULTI") | (F.length(wkt) - F.length(F.replace(wkt, F.lit(","))) >= 10), F.lit(False))


def severity(base: Column, error_type: Column, relation: Column, wkt: Column) -> Column:
    """The rule's severity, one step up where a point or line breaks a containing or crossing rule, and one more for
    complex geometry; Critical is the highest. An unknown base is unknown."""
    level = F.array_position(F.array(*map(F.lit, SEVERITIES)), base)
    critical = F.coalesce(error_type.isin("POINT_IN_POLYGON_VIOLATION", "LINE_POLYGON_INTERSECTION_VIOLATION") & relation.isin("Within", "Contains", "Crosses"), F.lit(False))
    level = F.least(F.lit(4), level + critical.cast("int") + complex_geometry(wkt).cast("int"))
    return F.when(F.array_contains(F.array(*map(F.lit, SEVERITIES)), base), F.element_at(F.array(*map(F.lit, SEVERITIES)), level.cast("int")))


def _label(values: dict[str, str], key: Column, other: str) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key), F.lit(other))


def category(relation: Column) -> Column:
    return _label(CATEGORY, relation, "일반공간관계오류")


def context(wkt: Column) -> Column:
    return F.when(complex_geometry(wkt), "복잡지오메트리").otherwise("일반")


def action(level: Column) -> Column:
    return _label(ACTION, level, "검토필요")


# --- counts over the relation ---------------------------------------------------------------------------------


def counts(found: DataFrame, *by: str) -> DataFrame:
    """n, features and the extent of the errors of each group."""
    return found.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("feature_id").alias("features"), *[f(k).alias(f"{f.__name__}_{k}") for f in (F.min, F.max) for k in "xy"])


def same_shape(rings: Column) -> Column:
    """Rings in a form that equal polygons share: counter-clockwise, from the least vertex on, holes in order."""

    def normal(ring):
        open_ring = F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0)))
        twice = F.aggregate(F.zip_with(ring, F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), lambda p, q: F.coalesce(p["x"] * q["y"] - q["x"] * p["y"], F.lit(0.0))), F.lit(0.0), lambda t, v: t + v)
        turned = F.when(twice < 0, F.reverse(open_ring)).otherwise(open_ring)
        return o.bound(turned, lambda v: o.bound(F.array_position(v, F.array_min(v)), lambda at: F.concat(F.slice(v, at.cast("int"), F.size(v)), F.slice(v, 1, at.cast("int") - 1))))

    shell = F.transform(F.slice(rings, 1, 1), normal)
    return F.concat(shell, F.array_sort(F.transform(F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0))), normal)))


def _shape_key(rings: Column) -> Column:
    return F.sha2(F.to_json(F.struct(same_shape(rings).alias("r"))), 256)


def duplicates(layer: DataFrame) -> DataFrame:
    """fid, related_fid: polygons that equal one of a smaller fid, and the smallest such. Vertices may begin anywhere and
    run either way. Groups are counted before they are joined; null and empty geometry has no equal."""
    keyed = layer.filter(F.size("rings") > 0).select("fid", _shape_key(c("rings")).alias("key"))
    firsts = keyed.groupBy(c("key").alias("of")).agg(F.min("fid").alias("related_fid"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return keyed.join(firsts, c("key") == c("of")).filter("fid <> related_fid").select("fid", "related_fid")


def hole_duplicates(features: DataFrame, layer: DataFrame) -> DataFrame:
    """fid, related_fid: features (rings) that equal a hole of a polygon of layer, and the first such polygon by fid."""
    holes = layer.select(c("fid").alias("related_fid"), F.explode(F.slice("rings", 2, F.greatest(F.size("rings") - 1, F.lit(0)))).alias("hole"))
    keyed = holes.groupBy(_shape_key(F.array("hole")).alias("of")).agg(F.min("related_fid").alias("related_fid"))
    own = features.filter(F.size("rings") > 0).select("fid", _shape_key(c("rings")).alias("key"))
    return own.join(keyed, c("key") == c("of")).select("fid", "related_fid")
