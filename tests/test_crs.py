"""Coordinate reference systems: published control points, round trips, layers."""

import math

import pytest
from pyspark.sql import functions as F

from quadrille.functions import crs

def vertex():
    return F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))


def through(spark, points, source, target):
    df = spark.createDataFrame([(float(x), float(y)) for x, y in points], "x double, y double")
    return [tuple(r["t"]) for r in df.select(crs.transformed(vertex(), source, target).alias("t")).collect()]


def test_control_points(spark):
    airy = crs.Crs(a=6377563.396, inverse_flattening=299.32496)
    # the worked example of the guidance on transverse Mercator: 50°30' N, 0°30' E
    grid = crs.Crs("tm", 6377563.396, 299.32496, 49, -2, 0.9996012717, 400_000, -100_000)
    assert through(spark, [(0.5, 50.5)], airy, grid)[0] == pytest.approx((577274.99, 69740.50), abs=0.01)
    back = through(spark, [(577274.99, 69740.50)], grid, airy)[0]
    assert back == pytest.approx((0.5, 50.5), abs=1e-7)
    # the worked example of the guidance on seven parameters, by position vector
    moved = spark.range(1).select(crs.shifted(F.struct(F.lit(3657660.66).alias("x"), F.lit(255768.55).alias("y"), F.lit(5201382.11).alias("z")), (0, 0, 4.5, 0, 0, 0.554, 0.219)).alias("t")).first()["t"]
    assert tuple(moved) == pytest.approx((3657660.78, 255778.43, 5201387.75), abs=0.01)
    # the origin of a zone, and a quarter of a meridian
    assert through(spark, [(127, 38)], crs.system(4737), crs.system(5186))[0] == pytest.approx((200_000, 600_000), abs=1e-6)
    assert through(spark, [(3, 90 - 1e-12)], crs.system(4326), crs.Crs("tm", inverse_flattening=298.257223563, lon0=3))[0][1] == pytest.approx(10_001_965.7293, abs=1e-3)
    assert through(spark, [(180, 0)], crs.system(4326), crs.system(3857))[0] == pytest.approx((math.pi * 6378137, 0), abs=1e-6)


@pytest.mark.parametrize("number", [5174, 5178, 5179, 5185, 5186, 5187, 5188, 32652, 32751, 3857, 27700])
def test_round_trips(spark, number):
    points = [(124.5 + 0.37 * k, 33 + 0.61 * k) for k in range(10)]
    own = crs.system(number)
    if number == 27700:
        points = [(x - 128, y + 17) for x, y in points]
    metres = through(spark, points, crs.system(4326), own)
    again = through(spark, metres, own, crs.system(4326))
    assert [c for p in again for c in p] == pytest.approx([c for p in points for c in p], abs=5e-9)  # half a millimetre
    twice = through(spark, again, crs.system(4326), own)
    assert [c for p in twice for c in p] == pytest.approx([c for p in metres for c in p], abs=1e-3)


def test_layers(spark):
    kind = "fid long, x double, y double, path array<struct<x:double,y:double>>, rings array<array<struct<x:double,y:double>>>, name string"
    at = {"x": 200_100.0, "y": 600_200.0}
    rows = [(1, 200_100.0, 600_200.0, [at, at], [[at, at]], "a"), (2, None, 1.0, None, None, None), (3, None, None, [], [], "c")]
    found = {r["fid"]: r for r in crs.transform_layer(spark.createDataFrame(rows, kind), 5186, 5179).collect()}
    one = found[1]
    assert tuple(one["path"][0]) == tuple(one["path"][1]) == tuple(one["rings"][0][1]) == (one["x"], one["y"]) and one["name"] == "a" and one["crs"] == 5179
    assert (found[2]["x"], found[2]["path"], found[2]["rings"], found[3]["path"], found[3]["rings"]) == (None, None, None, [], [])
    assert crs.transform_layer(spark.createDataFrame(rows, kind), 5186, 5186).filter("fid = 1").first()["x"] == 200_100.0
    with pytest.raises(ValueError):
        crs.transform_layer(spark.createDataFrame(rows, kind), 5186, 1)
