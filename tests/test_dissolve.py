"""Dissolved layers against one arrangement of all their sides."""

import random
import time

import numpy as np
import pytest

from quadrille.functions import clip
from quadrille.operators import clipping, dissolve
from quadrille.operators import shapes as s
from quadrille.sources import layers as L
from tests.test_clipping import simple, square, star

SF = "/root/testdata/sf0.001"
KIND = f"fid long, rings {clipping.RINGS}"


def layer(spark, shapes):
    return spark.createDataFrame([(k, [[{"x": float(x), "y": float(y)} for x, y in ring] for ring in rings]) for k, rings in enumerate(shapes)], KIND)


def whole(shapes):
    """The union in one go."""
    pieces, left, right = clip.arranged([clip.sides_of(x) for x in shapes])
    return clip.assembled(clip.boundary(pieces, left.any(axis=1), right.any(axis=1)))


def turned(ring):
    v = [tuple(round(float(k), 6) + 0.0 for k in p) for p in ring[:-1]]
    k = v.index(min(v))
    return tuple(v[k:] + v[:k])


def as_set(polygons):
    return sorted((turned(p[0]), sorted(map(turned, p[1:]))) for p in polygons)


def found(df):
    return [[[(v["x"], v["y"]) for v in ring] for ring in r["rings"]] for r in df.collect()]


@pytest.mark.parametrize("seed,size", [(1, 4.0), (2, 16.0), (3, 64.0), (4, None)])
def test_dissolved(spark, seed, size):
    rng = random.Random(seed)
    shapes = [star(rng) for _ in range(12)] + [square(rng.randrange(60), rng.randrange(60), rng.randrange(1, 12)) for _ in range(25)]
    shapes += [square(90, 90, 4), square(94, 90, 4), square(94, 94, 4), square(90, 94, 4), square(102, 102, 2), square(104, 104, 2)]
    df = dissolve.dissolved(layer(spark, shapes), size)
    assert as_set(found(df)) == as_set(whole(shapes))
    for p in found(df):
        for ring in p:
            simple(np.array(ring))
    totals = dissolve.outline_totals(layer(spark, shapes), size).first()
    assert totals["area"] == pytest.approx(sum(clip.area_of(p) for p in whole(shapes)), abs=1e-6)


def test_area_of_slanted_layers(spark):
    for df in (L.shapes_a(spark, SF), L.shapes_b(spark, SF)):
        assert dissolve.outline_totals(df).first()["area"] == pytest.approx(s.union_area(df).first()["area"], abs=1e-6)


def test_crowded_cells_are_quartered():
    rng = random.Random(9)
    shapes = [np.array(clip.sides_of(square(rng.randrange(50), rng.randrange(50), rng.randrange(1, 9)))) for _ in range(120)]
    known = [bool(clip._odd_beyond(np.array([[dissolve.RX * 64, dissolve.RY * 64]]), x, 1)[0]) for x in shapes]
    once, often = (dissolve.outline((0.0, 0.0, 64.0), shapes, known, most) for most in (10_000, 40))
    assert sum(clip.signed_area(x) for x in clip.loops(once)) == pytest.approx(sum(clip.signed_area(x) for x in clip.loops(often)), abs=1e-6)


def test_one_huge_shape_and_a_dense_cell(spark):
    """A box of a million units beside many small ones costs rows for its outline alone; 2,000 shapes in one cell end."""
    small = [square(k % 200 * 5_000 + 7, k // 200 * 5_000 + 7, 20) for k in range(4_000)]
    huge = [[(-1_000_000, -2), (-2, -2), (-2, 999_998), (-1_000_000, 999_998), (-1_000_000, -2)]]
    df = layer(spark, [huge, *small])
    size = dissolve.r.grid(s.polygons(df), s.polygons(df))[0]
    pieces = df.selectExpr("fid AS nth", "rings").mapInArrow(dissolve._rows(size, "pieces"), "cx long, cy long, nth long, px double, py double, qx double, qy double").count()
    assert pieces < 4 * 1_000_000 / size + 40_000
    began = time.time()
    totals = dissolve.outline_totals(df).first()
    assert totals["area"] == pytest.approx(4_000 * 400 + 999_998 * 1_000_000)
    rng = random.Random(1)
    dense = [square(rng.randrange(100), rng.randrange(100), rng.randrange(1, 5)) for _ in range(2_000)]
    squares = {(x, y) for (q,) in dense for x in range(q[0][0], q[2][0]) for y in range(q[0][1], q[2][1])}
    assert dissolve.outline_totals(layer(spark, dense), 128.0).first()["area"] == pytest.approx(len(squares))
    assert time.time() - began < 120


def test_odd_layers(spark):
    none = spark.createDataFrame([(1, None), (2, [])], KIND)
    assert dissolve.dissolved(none, 4.0).count() == 0 and tuple(dissolve.outline_totals(none, 4.0).first()) == (0.0, 0.0)
    twice = layer(spark, [square(0, 0, 3), square(0, 0, 3)])
    assert [r["area"] for r in dissolve.dissolved(twice, 2.0).collect()] == [9.0]
