"""Very many features in one place: results that don't grow with pairs must not cost pairs."""

import threading

import duckdb
import numpy as np
import pytest

from quadrille import catalogue
from quadrille.functions import clip
from quadrille.operators import dissolve

SAME = 297 * 199  #: orders whose keys differ by this are lines in one place


def line(k):
    x = k * 17 % 297
    return x, k * 31 % 199, x + k % 9 + 1


def within(spark, seconds, f):
    """f(), whose jobs are ended after so many seconds."""
    timer = threading.Timer(seconds, spark.sparkContext.cancelAllJobs)
    timer.start()
    try:
        return f()
    finally:
        timer.cancel()


def orders(spark, tmp_path, name, keys):
    duckdb.sql(f"COPY (SELECT k AS o_orderkey, 'F' AS o_orderstatus, 1.0 AS o_totalprice FROM ({keys}) AS t(k)) TO '{tmp_path}/orders-{name}.parquet'")
    (tmp_path / name).mkdir()
    (tmp_path / f"orders-{name}.parquet").rename(tmp_path / name / "orders.parquet")
    return str(tmp_path / name)


def near(base, dx, dy):
    """Keys of lines that begin so far from where the line of base ends."""
    x1, y1, x2 = line(base)
    return [k for k in range(SAME) if line(k)[0] == x2 + dx and line(k)[1] == y1 + dy]


def rows(query, spark, folder):
    return sorted(map(tuple, catalogue.QUERIES[query](spark, folder).collect()))


@pytest.mark.parametrize("query,dx,dy", [("geom_overshoot", 1, 0), ("geom_undershoot", -2, 1), ("rel_line_connectivity", -2, 1), ("rel_line_connectivity_filter", -2, 1)])
def test_a_line_beside_very_many_in_one_place(spark, tmp_path, query, dx, dy):
    base = next(k for k in range(SAME) if k % 9 == 8)
    lone = near(base, dx, dy)[0]
    few = orders(spark, tmp_path, "few", f"SELECT {base} + range * {SAME} FROM range(3) UNION ALL SELECT {lone}")
    many = orders(spark, tmp_path, "many", f"SELECT {base} + range * {SAME} FROM range(60000) UNION ALL SELECT {lone}")
    with duckdb.connect() as con:
        con.sql(f"CREATE VIEW orders AS SELECT * FROM '{few}/orders.parquet'")
        expected = sorted(con.sql(catalogue.ORACLE_SQL[query]).fetchall())
    assert expected and {r[0] for r in expected} == {lone}
    assert within(spark, 60, lambda: rows(query, spark, many)) == expected


def test_very_many_points_in_one_place(spark, tmp_path):
    duckdb.sql(f"COPY (SELECT range * 1003 * 211 AS event_id, 'error' AS event_type FROM range(60000) UNION ALL SELECT 1003 * 211 * 5 + 1, 'error') TO '{tmp_path}/events.parquet'")
    got = dict(within(spark, 60, lambda: rows("geom_near_duplicate", spark, str(tmp_path))))
    assert len(got) == 59_999 and set(got.values()) == {0}


def copies(tmp_path, table, columns, n, first, apart):
    duckdb.sql(f"COPY (SELECT {first} + range * {apart} AS {columns} FROM range({n})) TO '{tmp_path}/{table}.parquet'")


@pytest.mark.parametrize("query", ["geom_overshoot_paths", "geom_undershoot_paths"])
def test_slanted_lines_in_one_place(spark, tmp_path, query):
    copies(tmp_path, "orders", "o_orderkey, 'F' AS o_orderstatus, 1.0 AS o_totalprice", 30_000, 5, 997 * 499 * 420)
    assert within(spark, 60, lambda: rows(query, spark, str(tmp_path))) == []


@pytest.mark.parametrize("query", ["rel_contour_intersection_paths", "rel_contour_intersection", "rel_line_intersection_attr"])
def test_pairs_of_lines_in_one_place(spark, tmp_path, query):
    n = 15_000
    copies(tmp_path, "orders", "o_orderkey, 'F' AS o_orderstatus, 1.0 AS o_totalprice", n, 8, 2 * SAME)
    df = catalogue.QUERIES[query](spark, str(tmp_path))
    got = within(spark, 120, lambda: df.selectExpr("count(*) AS n", "count_if(fid < related_fid) AS right", "min(measure) AS m").first())
    assert got["n"] == got["right"] == n * (n - 1) // 2 and got["m"] > 0


def test_boxes_in_one_place_are_clipped_once(spark, tmp_path):
    copies(tmp_path, "supplier", "s_suppkey", 100_000, 1, 221_000)
    copies(tmp_path, "part", "p_partkey", 2000, 0, 1)
    df = catalogue.QUERIES["rel_polygon_not_overlap_parts"](spark, str(tmp_path))
    got = within(spark, 60, lambda: df.selectExpr("count(*) AS n", "count(DISTINCT related_fid) AS m").first())
    assert got["m"] == 100_000 and got["n"] % 100_000 == 0


def test_lines_in_one_place_are_clipped_once(spark, tmp_path):
    copies(tmp_path, "orders", "o_orderkey, 'F' AS o_orderstatus, 1.0 AS o_totalprice", 300_000, 8, SAME)
    copies(tmp_path, "part", "p_partkey", 2000, 0, 1)
    df = catalogue.QUERIES["rel_polygon_not_intersect_line_parts"](spark, str(tmp_path))
    got = within(spark, 60, lambda: df.selectExpr("count(*) AS n", "count(DISTINCT related_fid) AS m").first())
    assert got["m"] == 300_000 and got["n"] % 300_000 == 0


def test_a_hundred_thousand_tracks(spark, tmp_path):
    copies(tmp_path, "orders", "o_orderkey, 'F' AS o_orderstatus, 1.0 AS o_totalprice", 100_000, 0, 1)
    assert within(spark, 60, lambda: catalogue.QUERIES["topo_simplify_tracks"](spark, str(tmp_path)).selectExpr("count(vertices)").first()[0]) == 100_000


def test_the_union_of_copies_is_that_of_one(spark, tmp_path):
    found = []
    for n in (1, 2000):
        (tmp_path / str(n)).mkdir()
        copies(tmp_path / str(n), "supplier", "s_suppkey", n, 3, 1000)
        found.append(within(spark, 60, lambda n=n: rows("agg_union_geometry_shapes", spark, str(tmp_path / str(n)))))
    assert found[0] and found[0] == found[1]


def test_the_plan_of_a_rule_table_stays_small(spark):
    df = catalogue.QUERIES["agg_error_relation"](spark, "/root/testdata/sf0.001")
    assert len(df._jdf.queryExecution().optimizedPlan().toString()) < 150_000


def test_spans_of_shapes_together_are_those_of_each():
    shapes = [clip.sides_of([[(x, 0), (x + 13, 3), (x + 4, 12), (x, 0)]]) for x in (0, 5, 40)]
    each = [np.hstack([dissolve.spans(v, 4)[:, :3], np.full((len(dissolve.spans(v, 4)), 1), n)]) for n, v in enumerate(shapes)]
    got = dissolve.spans(np.concatenate(shapes), 4, np.repeat(np.arange(3), [len(v) for v in shapes]))
    assert np.array_equal(got, np.concatenate(each))
