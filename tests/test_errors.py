"""Codecs, labels of errors, expressions and the error relation by hand cases."""

import struct

import pytest
from pyspark.sql import functions as F

from quadrille.functions import codec
from quadrille.operators import errors as e
from quadrille.operators import expression
from quadrille.sources import layers as L

RINGS = "array<array<struct<x:double,y:double>>>"


def at(parts):
    return None if parts is None else [[[(v["x"], v["y"]) for v in ring] for ring in part] for part in parts]


def test_wkt(spark):
    texts = {
        1: "POLYGON ((0 0, 4 0, 4 4, 0 0), (1 1, 2 1, 2 2, 1 1))", 2: " linestring (0 0 , -1.5 2e1 7)", 3: "Point(3 4)", 4: "POLYGON EMPTY", 5: None, 6: "circle (1 2)",
        7: "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5), (5.1 5.1, 5.2 5.1, 5.2 5.2, 5.1 5.1)))", 8: "", 9: "POINT (a b)",
    }
    rows = spark.createDataFrame(list(texts.items()), "k long, t string").select("k", codec.from_wkt(F.col("t")).alias("p"), codec.wkt_kind(F.col("t")).alias("kind")).collect()
    got = {r["k"]: at(r["p"]) for r in rows}
    assert got[1] == [[[(0, 0), (4, 0), (4, 4), (0, 0)], [(1, 1), (2, 1), (2, 2), (1, 1)]]]
    assert got[2] == [[[(0, 0), (-1.5, 20)]]] and got[3] == [[[(3, 4)]]] and got[4] == [] and got[5] is got[6] is got[8] is None
    assert [len(p) for p in got[7]] == [1, 2] and got[7][1][0][2] == (6, 6) and got[9] == [[[(None, None)]]]
    assert {r["k"]: r["kind"] for r in rows}[7] == "MULTIPOLYGON"


def test_wkb(spark):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 0.0)]
    flat = [v for p in ring for v in p]
    little = struct.pack("<BIII8d", 1, 3, 1, 4, *flat)
    big = struct.pack(">BIII8d", 0, 3, 1, 4, *flat)
    with_z = struct.pack("<BIII12d", 1, 1003, 1, 4, *[v for p in ring for v in (*p, 9.0)])
    with_srid = struct.pack("<BIIII8d", 1, 3 | 0x20000000, 4326, 1, 4, *flat)
    multi = struct.pack("<BII", 1, 6, 2) + little + big
    point = struct.pack("<BI2d", 1, 1, 3, 4)
    raws = {1: little, 2: big, 3: with_z, 4: with_srid, 5: multi, 6: point, 7: None, 8: b"", 9: little[:-3], 10: b"\x01\xff\xff\xff\xff"}
    rows = spark.createDataFrame([(k, None if v is None else bytearray(v)) for k, v in raws.items()], "k long, b binary")
    got = {r["k"]: at(r["p"]) for r in rows.select("k", codec.from_wkb(F.col("b")).alias("p")).collect()}
    assert got[1] == got[2] == got[3] == got[4] == [[ring]] and got[5] == [[ring], [ring]] and got[6] == [[[(3, 4)]]]
    assert got[7] is got[8] is got[9] is got[10] is None
    back = spark.createDataFrame([(1, [[{"x": x, "y": y} for x, y in ring]]), (2, None), (3, [])], f"k long, r {RINGS}").select("k", codec.rings_wkb(F.col("r")).alias("b"), codec.rings_wkt(F.col("r")).alias("t")).collect()
    assert bytes(back[0]["b"]) == little and back[1]["b"] is None and back[0]["t"] == "POLYGON ((0 0, 4 0, 4 4, 0 0))" and back[1]["t"] is None and back[2]["t"] == "POLYGON EMPTY"


def test_severity(spark):
    cases = [("Info", "OVERLAP", "Within", None, "Info"), ("Warning", "POINT_IN_POLYGON_VIOLATION", "Within", None, "Error"), ("Error", "POINT_IN_POLYGON_VIOLATION", "Crosses", "MULTIPOINT (0 0)", "Critical"), ("Warning", "X", None, "LINESTRING (" + "0 0, " * 10 + "1 1)", "Error"), ("Warning", "X", "Touches", "LINESTRING (" + "0 0, " * 9 + "1 1)", "Warning"), (None, "X", "Within", None, None), ("?", "X", "Within", None, None)]
    rows = spark.createDataFrame(cases, "base string, t string, r string, w string, expected string")
    assert rows.filter(~e.severity(F.col("base"), F.col("t"), F.col("r"), F.col("w")).eqNullSafe(F.col("expected"))).isEmpty()


def test_expressions(spark):
    assert expression.fields("a.x > 1 AND name LIKE 'y z' OR coalesce(h, 0) = 2") == ["h", "name", "x"]
    with pytest.raises(ValueError):
        expression.fields("x > 1 AND gone = 2", ["x"])
    for text in ("x > 1;", "(x", "x)", "DROP TABLE t", "'open"):
        with pytest.raises(ValueError):
            expression.fields(text)
    assert [expression.kind(t) for t in ("x = 1", "x * 2", "trim(x)", "to_date(x)", "x")] == ["Boolean", "Numeric", "String", "Date", "Mixed"]


def test_error_relation(spark):
    layer = spark.createDataFrame([(1, [[{"x": 0.0, "y": 0.0}, {"x": 4.0, "y": 0.0}, {"x": 4.0, "y": 4.0}, {"x": 0.0, "y": 4.0}, {"x": 0.0, "y": 0.0}]]), (2, None)], f"fid long, rings {RINGS}")
    rows = e.errors(e.located(layer.select("fid"), layer, "polygon", "rings").withColumnRenamed("fid", "feature_id"), rule_id="R")
    assert rows.columns == e.COLUMNS and {(r["feature_id"], r["x"], r["y"]) for r in rows.collect()} == {(1, 2.0, 2.0), (2, None, None)}
    rules = spark.createDataFrame([("R1", "PolygonNotOverlap", "a", "a", 1.0, "N"), ("#R2", "PolygonNotOverlap", "a", "a", 1.0, "Y")], e.RULE)
    assert e.run_relations({"a": layer}, rules).isEmpty() and L.active(rules).isEmpty()
    found = e.run_relations({"A": layer}, spark.createDataFrame([("R1", "polygonnotoverlap", "a", "A", 1.0, "y")], e.RULE)).collect()
    assert [(r["feature_id"], r["related_feature_id"], r["measure"], r["x"]) for r in found] == [(1, 1, 16.0, 2.0)]
    places = spark.createDataFrame([([{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 5.0}, {"x": 2.0, "y": 0.0}],)], "p array<struct<x:double,y:double>>")
    assert places.select(e.place("line", F.col("p")).alias("v")).first()["v"]["y"] == 5.0


def test_equal_shapes(spark):
    ring = lambda *v: [{"x": float(x), "y": float(y)} for x, y in v]
    a = [ring((0, 0), (4, 0), (4, 4), (0, 0)), ring((1, 1), (2, 1), (2, 2), (1, 1)), ring((3, 2), (3, 1), (2.5, 1), (3, 2))]
    b = [ring((4, 4), (4, 0), (0, 0), (4, 4)), ring((3, 1), (3, 2), (2.5, 1), (3, 1)), ring((2, 2), (2, 1), (1, 1), (2, 2))]
    moved = [ring((1, 0), (5, 0), (5, 4), (1, 0))]
    rows = spark.createDataFrame([(5, a), (3, b), (9, moved), (2, None), (1, []), (7, [a[0]])], f"fid long, rings {RINGS}")
    assert {tuple(r) for r in e.duplicates(rows).collect()} == {(5, 3)}
    holes = spark.createDataFrame([(11, [ring((2, 1), (1, 1), (2, 2), (2, 1))]), (12, [a[0]])], f"fid long, rings {RINGS}")
    assert {tuple(r) for r in e.hole_duplicates(holes, rows).collect()} == {(11, 3)}
