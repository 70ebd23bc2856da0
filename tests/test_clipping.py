"""Overlays of polygons: parts against shared areas, for holes, touching vertices and common sides."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.functions import clip
from quadrille.operators import clipping
from quadrille.operators import shapes as s
from quadrille.sources import layers as L

SF = "/root/testdata/sf0.001"


def star(rng, n=9, span=12):
    """A slanted ring without crossings around a centre, often with a hole."""
    at, size = (rng.randrange(20), rng.randrange(20)), [rng.randrange(3, span) for _ in range(n)]
    turn = [2 * np.pi * k / n for k in range(n)]
    ring = [(round(at[0] + r * np.cos(t), 3), round(at[1] + r * np.sin(t), 3)) for r, t in zip(size, turn)]
    hole = [(at[0] + x, at[1] + y) for x, y in ((-0.5, -0.5), (-0.5, 0.5), (0.5, 0.5), (0.5, -0.5), (-0.5, -0.5))]
    ring = ring[:: rng.choice([1, -1])]
    return [ring + ring[:1]] + ([hole] if rng.random() < 0.5 else [])


def square(x, y, n):
    return [[(x, y), (x + n, y), (x + n, y + n), (x, y + n), (x, y)]]


def total(parts):
    return sum(clip.area_of(p) for p in parts)


def simple(ring):
    inner = [tuple(v) for v in ring[:-1].tolist()]
    assert tuple(ring[0]) == tuple(ring[-1]) and len(set(inner)) == len(inner) > 2


@pytest.mark.parametrize("seed", range(40))
def test_areas_add_up(seed):
    rng = random.Random(seed)
    make = (lambda: star(rng)) if seed % 2 else (lambda: square(rng.randrange(6), rng.randrange(6), rng.randrange(1, 6)))
    a, b = make(), make()
    own = [total(clip.overlay(x, x, "intersection")) for x in (a, b)]
    both, whole, first, last, either = (total(clip.overlay(x, y, how)) for x, y, how in ((a, b, "intersection"), (a, b, "union"), (a, b, "difference"), (b, a, "difference"), (a, b, "either")))
    assert own[0] + own[1] == pytest.approx(both + whole, abs=1e-6)
    assert (first, last, either) == pytest.approx((own[0] - both, own[1] - both, whole - both), abs=1e-6)
    for how in ("intersection", "union", "difference", "either"):
        for p in clip.overlay(a, b, how):
            assert clip.signed_area(p[0]) > 0 and all(clip.signed_area(h) < 0 for h in p[1:])
            for ring in p:
                simple(ring)


@pytest.mark.parametrize(
    "a,b,how,expected",
    [
        (square(0, 0, 4), square(4, 0, 4), "intersection", []),  # a common side
        (square(0, 0, 4), square(4, 4, 4), "union", [(16, 1), (16, 1)]),  # a common vertex
        (square(0, 0, 4), square(4, 0, 4), "union", [(32, 1)]),
        (square(0, 0, 4), square(0, 0, 4), "difference", []),
        (square(0, 0, 9), square(3, 3, 3), "difference", [(72, 2)]),  # a hole
        (square(0, 0, 9), [[(0, 0), (3, 1), (1, 3), (0, 0)]], "difference", [(77, 2)]),  # a hole that touches the shell
        (square(0, 0, 9) + square(2, 2, 5), square(3, 3, 3), "union", [(56, 2), (9, 1)]),  # an island in a hole
        (square(0, 0, 2), [], "union", [(4, 1)]),
    ],
)
def test_hand_made(a, b, how, expected):
    assert [(round(clip.area_of(p), 9), len(p)) for p in clip.overlay(a, b, how)] == expected


def test_parts_of_layers(spark):
    """Parts of slanted, hollow and holed shapes add up to what strips say that the pair shares."""
    a, b = L.shapes_a(spark, SF), L.shapes_b(spark, SF)
    parts = clipping.shared_parts(a, b).groupBy("fid", "related_fid").agg(F.sum("measure").alias("measure"), F.count("part").alias("n"), F.max("parts").alias("parts"))
    found = {(r["fid"], r["related_fid"]): r for r in parts.collect()}
    expected = {(r["fid"], r["related_fid"]): r["measure"] for r in s.overlaps(a, b, 1e-9).collect()}
    assert found.keys() == expected.keys() and all(r["n"] == r["parts"] for r in found.values())
    assert [r["measure"] for _, r in sorted(found.items())] == pytest.approx([v for _, v in sorted(expected.items())], abs=1e-6)
    cut = clipping.shared_parts(a, b, "difference").groupBy().agg(F.sum("measure")).first()[0]
    assert cut > 0


def test_odd_layers(spark):
    kind = f"fid long, rings {clipping.RINGS}"
    none = spark.createDataFrame([(1, None), (2, [])], kind)
    one = spark.createDataFrame([(3, [[{"x": float(x), "y": float(y)} for x, y in square(0, 0, 3)[0]]])], kind)
    assert clipping.shared_parts(none, one).count() == clipping.shared_parts(one.limit(0), one).count() == 0
    assert [tuple(r)[:7] for r in clipping.shared_parts(one, one).collect()] == [(3, 3, 1, 1, 9.0, 1.5, 1.5)]
    assert clipping.shared_parts(one, one, same=True).count() == 0


def test_line_parts():
    fork = [[(0, 0), (12, 0), (12, 12), (8, 12), (8, 3), (4, 3), (4, 12), (0, 12), (0, 0)]]
    lines = lambda path: [x.tolist() for x in clip.line_parts(path, fork)]
    assert lines([(-1, 6), (20, 6)]) == [[[0, 6], [4, 6]], [[8, 6], [12, 6]]]
    assert lines([(2, 2), (6, 2), (6, 9)]) == [[[2, 2], [6, 2], [6, 3]]]
    assert lines([(12, -5), (12, 20)]) == [[[12, 0], [12, 12]]]  # along the outline
    assert lines([(-3, 3), (3, -3)]) == [] and lines([(5, 5), (7, 9)]) == []
