"""Filter texts and rule options by hand cases."""

import pytest

from quadrille.functions import filters as f


def test_clauses_and_items():
    assert f.clauses("a = 'x AND y' and b IN (c|d)") == ["a = 'x AND y'", "b IN (c|d)"]
    assert f.items("'a, b', c|d , 'e'") == ["a, b", "c", "d", "e"] and f.items("") == []


def test_normalised():
    assert f.normalised("kind in (A|B) AND h >= 2.5 and name = Seoul") == "kind IN ('A', 'B') AND h >= 2.5 AND name = 'Seoul'"
    assert f.normalised("kind not  in ('A', 'B')") == "kind NOT IN ('A', 'B')"
    with pytest.raises(ValueError):
        f.normalised("kind like A")


def test_options():
    assert f.options("a|b ; angle=30;exclude_road_types=R1, R2;;bad") == (["a", "b"], {"angle": ["30"], "exclude_road_types": ["R1", "R2"]})
    assert f.options("") == f.options(None) == ([], {})


def test_parsed(spark):
    rows = spark.createDataFrame([("A", " 1,200 ", "x AND y"), ("b", "900", "z"), (None, "none", None)], "kind string, `height m` string, name string").withColumnRenamed("height m", "height")
    left = lambda text: [r["kind"] for r in rows.filter(f.parsed(rows, text)).collect()]
    assert left("height > 1,000") == ["A"] and left("NAME = 'x AND y'") == ["A"] and left("kind IN (a|B)") == ["A", "b"]
    assert left("kind NOT IN ('a')") == ["b", None] and left("gone = 1 AND kind = 'A'") == ["A", "b", None] and left("name <> 'z'") == ["A"]
    with pytest.raises(ValueError):
        f.parsed(rows, "height > tall")
