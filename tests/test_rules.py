"""Rule tables from CSV to errors."""

import pytest
from pyspark.sql import functions as F

from quadrille.operators import attribute, errors
from quadrille.sources import rules

RELATIONS = """﻿RuleId,Enabled,CaseType,MainTableId,MainTableName,RelatedTableId,RelatedTableName,FieldFilter,Tolerance,Note
#OLD,Y,PolygonNotOverlap,a,A,b,B,,0,a comment
R1,Y,PolygonNotOverlap,a,A,b,B,"kind NOT IN ('x','y')",0.5,"with, a comma"
R2,,LineDisconnection,l,L,l,L,,0.3,
R3,N,PolygonNotOverlap,a,A,b,B,,0,off
R4,Y,NoSuchCase,a,A,b,B,,-1,
R4,Y,ConnectedLinesSameAttribute,l,L,l,L,height;exclude=z,abc,
R5,Y,LineDisconnectionWithAttribute,l,L,l,L,height,0.3,
R6,Y,RoadSharpBend,l,L,l,L,,100,
R7,Y,PointInsidePolygon,a,A,p,P,,,
R8,Y,PolygonContainsLine,l,L,a,A,,0.5,
R9,Y,LineEndpointWithinPolygon,l,L,a,A,,0.5,
"""
SQUARE = lambda x, y, n: [[{"x": float(a), "y": float(b)} for a, b in ((x, y), (x + n, y), (x + n, y + n), (x, y + n), (x, y))]]
PATH = lambda *v: [{"x": float(x), "y": float(y)} for x, y in v]


@pytest.fixture(scope="module")
def layers(spark):
    poly = "fid long, kind string, rings array<array<struct<x:double,y:double>>>"
    line = "fid long, height string, path array<struct<x:double,y:double>>"
    return {
        "A": spark.createDataFrame([(1, "k", SQUARE(0, 0, 4)), (2, "x", SQUARE(1, 1, 4)), (3, None, SQUARE(50, 50, 2))], poly),
        "b": spark.createDataFrame([(7, "k", SQUARE(3, 3, 4)), (8, "y", SQUARE(0, 0, 2))], poly),
        "l": spark.createDataFrame([(1, "10", PATH((0, 0), (2, 2), (4, 2))), (2, "10.0", PATH((4, 2.1), (9, 2))), (3, "20", PATH((9, 2), (9, 9), (8, 0)))], line),
        "p": spark.createDataFrame([(1, 2.0, 2.0)], "fid long, x double, y double"),
    }


def test_relations_from_csv(spark, layers, tmp_path):
    path = tmp_path / "relation.csv"
    path.write_text(RELATIONS, encoding="utf-8")
    table = rules.read(spark, str(path), "relation")
    assert rules.missing_headers(spark, str(path), "relation") == []
    assert {tuple(r) for r in rules.problems(table, "relation", tuple(errors.CASES)).collect()} == {
        ("R4", "case_type is unknown"), ("R4", "tolerance is negative"), ("R4", "tolerance is no number"), ("R4", "rule_id comes more than once"),
    }
    assert [r["note"] for r in table.filter("rule_id = 'R1'").collect()] == ["with, a comma"]
    active = rules.active(table)
    assert sorted(r["rule_id"] for r in active.collect()) == ["R1", "R2", "R4", "R4", "R5", "R6", "R7", "R8", "R9"]
    found = errors.run_relations(layers, active.filter("rule_id <> 'R4'"))
    got = sorted((r["rule_id"], r["feature_id"], r["related_feature_id"], r["measure"] and round(r["measure"], 6), r["x"], r["y"]) for r in found.collect())
    assert got == [
        ("R1", 1, 7, 1.0, 2.0, 2.0),
        ("R2", 1, None, None, 0.0, 0.0), ("R2", 3, None, None, 8.0, 0.0),
        ("R5", 1, None, None, 0.0, 0.0), ("R5", 1, None, None, 4.0, 2.0), ("R5", 2, None, None, 4.0, 2.1), ("R5", 2, None, None, 9.0, 2.0), ("R5", 3, None, None, 8.0, 0.0), ("R5", 3, None, None, 9.0, 2.0),
        ("R6", 1, None, 45.0, 2.0, 2.0),
        ("R7", 3, None, None, 51.0, 51.0),
        ("R8", 2, None, None, 9.0, 2.0), ("R8", 3, None, None, 9.0, 9.0),
        ("R9", 2, None, None, 9.0, 2.0), ("R9", 3, None, None, 8.0, 0.0), ("R9", 3, None, None, 9.0, 2.0),
    ]
    same = active.filter("case_type = 'ConnectedLinesSameAttribute'").withColumn("tolerance", F.lit(0.3))
    assert [(r["feature_id"], r["related_feature_id"], r["x"]) for r in errors.run_relations(layers, same).collect()] == [(2, 3, 9.0)]


def test_files_both_ways(spark, tmp_path):
    path = tmp_path / "relation.csv"
    path.write_text(RELATIONS, encoding="utf-8")
    table = rules.read(spark, str(path), "relation").filter("tolerance IS NOT NULL")
    rules.write(table, str(tmp_path / "out"), "relation")
    again = rules.read(spark, str(tmp_path / "out"), "relation")
    assert sorted(map(str, again.collect())) == sorted(map(str, table.collect()))


def test_other_tables(spark, tmp_path):
    (tmp_path / "t.csv").write_text("TableId,TableName,GeometryType,CRS\nt1,Roads,POLYGON,EPSG:5179\nt2,,Blob,5179\n#t3,x,y,z\n", encoding="utf-8")
    assert {tuple(r) for r in rules.problems(rules.read(spark, str(tmp_path / "t.csv"), "table"), "table").collect()} == {("t2", "table_name is missing"), ("t2", "geometry_type is unknown"), ("t2", "crs is no EPSG:number")}
    heads = list(rules.GEOMETRY_CHECKS)
    (tmp_path / "g.csv").write_text("﻿TableId,TableName,GeometryType," + ",".join(heads[:4]) + "\nt1,Roads,POLYGON,Y,n,y,N\n#t2,x,POINT,Y,Y,Y,Y\n", encoding="utf-8")
    assert [(r["table_id"], r["check"]) for r in rules.read_geometry(spark, str(tmp_path / "g.csv")).collect()] == [("t1", "duplicate"), ("t1", "self_intersection")]
    assert rules.missing_headers(spark, str(tmp_path / "g.csv"), "geometry") == heads[4:]
    (tmp_path / "c.csv").write_text("항목명,값,단위,설명\n스파이크각도임계값,5.0,도,x\n최소선길이,none,m,\n없는값,1,,\n", encoding="utf-8")
    found = rules.read_criteria(spark, str(tmp_path / "c.csv"))
    assert (found["spike_angle"], found["min_line_length"], len(found)) == (5.0, 0.01, len(rules.CRITERIA)) and rules.read_criteria(spark, None)["spike_angle"] == 10.0
    (tmp_path / "a.csv").write_text("RuleId,Enabled,TableId,TableName,FieldName,CheckType,Parameters,Note\nA1,Y,t1,T,f,CodeList,a|b,\nA2,?,t1,T,,Nothing,,\n", encoding="utf-8")
    assert {tuple(r) for r in rules.problems(rules.read(spark, str(tmp_path / "a.csv"), "attribute"), "attribute", tuple(attribute.CHECKS)).collect()} == {("A2", "field is missing"), ("A2", "check_type is unknown"), ("A2", "enabled is neither Y nor N")}
