"""Stages in their order."""

from quadrille.operators import stages


def test_run(spark):
    calls = []

    def gives(name, n):
        def check(before):
            calls.append((name, sorted(before)))
            if n is None:
                raise KeyError("no layer")
            return spark.range(n).selectExpr("id AS fid")

        return check

    def told(*of):
        results, errors = stages.run(spark, [stages.Stage(name, gives(name, n), stops) for name, n, stops in of])
        return [tuple(r)[1:4] for r in results.orderBy("nth").collect()], {k: v.count() for k, v in errors.items()}

    assert told(("a", 0, True), ("b", 3, False), ("c", 2, True), ("d", 0, True)) == ([("a", "passed", 0), ("b", "failed", 3), ("c", "failed", 2), ("d", "skipped", None)], {"a": 0, "b": 3, "c": 2})
    assert calls == [("a", []), ("b", ["a"]), ("c", ["a", "b"])]
    assert told(("a", None, True), ("b", 1, True)) == ([("a", "error", None), ("b", "skipped", None)], {})
    assert told() == ([], {})


def test_table_stage_of_odd_rows(spark):
    declared = spark.createDataFrame([("T1", "Roads", "EPSG:1", "POINT"), ("T2", "Rivers", None, "LINE")], "table_id string, table_name string, crs string, geometry_type string")
    actual = spark.createDataFrame([("a", "t1", "EPSG:1", "POINT"), ("a", "RIVERS", "EPSG:9", "LINE"), ("b", "t1", None, "POINT"), ("b", "t2", None, None), ("c", "x", None, None)], "dataset string, name string, actual_crs string, actual_type string")
    found = {(r["dataset"], r["check"]): (r["status"], r["errors"]) for r in stages.table_stage(declared, actual).collect()}
    assert found == {
        ("a", "table_list"): ("passed", 0), ("a", "coordinate_system"): ("passed", 0), ("a", "geometry_type"): ("passed", 0),
        ("b", "table_list"): ("passed", 0), ("b", "coordinate_system"): ("failed", 1), ("b", "geometry_type"): ("skipped", None),
        ("c", "table_list"): ("failed", 2), ("c", "coordinate_system"): ("skipped", None), ("c", "geometry_type"): ("skipped", None),
    }
