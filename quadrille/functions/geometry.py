"""Planar measures as column expressions over vertex arrays; nothing leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def point(x, y) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def segment_path(*points: Column) -> Column:
    return F.array(*points)


def _pairs(path: Column, f) -> Column:
    """f of each two neighbouring vertices, added up; 0 for fewer than two."""
    return F.aggregate(F.zip_with(F.slice(path, 1, F.greatest(F.size(path) - 1, F.lit(0))), F.slice(path, 2, F.greatest(F.size(path), F.lit(1))), lambda a, b: f(a, b)), F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0)))


def sides(path: Column) -> Column:
    """An array of structs p, q: each vertex with the next one."""
    n = F.greatest(F.size(path) - 1, F.lit(0))
    return F.zip_with(F.slice(path, 1, n), F.slice(path, 2, n), lambda p, q: F.struct(p.alias("p"), q.alias("q")))


def on_boundary(ring: Column, v: Column) -> Column:
    """v lies on a side of the ring."""

    def on(s):
        p, q = s["p"], s["q"]
        level = (q["x"] - p["x"]) * (v["y"] - p["y"]) == (q["y"] - p["y"]) * (v["x"] - p["x"])
        return level & v["x"].between(F.least(p["x"], q["x"]), F.greatest(p["x"], q["x"])) & v["y"].between(F.least(p["y"], q["y"]), F.greatest(p["y"], q["y"]))

    return F.exists(sides(ring), on)


def covers(ring: Column, v: Column) -> Column:
    """v lies inside the closed ring or on it: a ray to the right meets an odd number of sides."""

    def met(s):
        p, q = s["p"], s["q"]
        return ((p["y"] > v["y"]) != (q["y"] > v["y"])) & (v["x"] < p["x"] + F.try_divide((q["x"] - p["x"]) * (v["y"] - p["y"]), q["y"] - p["y"]))

    return (F.size(F.filter(sides(ring), met)) % 2 == 1) | on_boundary(ring, v)


def length(path: Column) -> Column:
    return _pairs(path, lambda a, b: F.sqrt(F.pow(b["x"] - a["x"], 2) + F.pow(b["y"] - a["y"], 2)))


def area(ring: Column) -> Column:
    """Of a closed ring, by the shoelace formula."""
    return F.abs(_pairs(ring, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])) / 2


def closed(ring: Column, tolerance: float = 1e-8) -> Column:
    a, b = ring[0], F.element_at(ring, -1)
    return (F.abs(a["x"] - b["x"]) <= tolerance) & (F.abs(a["y"] - b["y"]) <= tolerance)


def unique_vertices(ring: Column, tolerance: float = 1e-8) -> Column:
    return F.size(F.array_distinct(F.transform(ring, lambda v: F.struct(F.rint(v["x"] / tolerance), F.rint(v["y"] / tolerance)))))


def shape_index(ring: Column) -> Column:
    return 4 * F.lit(3.141592653589793) * area(ring) / F.pow(length(ring), 2)


def turn_degrees(ax, ay, bx, by) -> Column:
    """The angle between two directions; null where one has no length."""
    dot = ax * bx + ay * by
    norm = F.sqrt((ax * ax + ay * ay) * (bx * bx + by * by))
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(dot, norm)))))


def overlap_area(a: str, b: str) -> Column:
    """Of two boxes x1, y1, x2, y2 under the names a and b."""
    c = F.col
    return F.greatest(F.lit(0), F.least(c(f"{a}.x2"), c(f"{b}.x2")) - F.greatest(c(f"{a}.x1"), c(f"{b}.x1"))) * F.greatest(F.lit(0), F.least(c(f"{a}.y2"), c(f"{b}.y2")) - F.greatest(c(f"{a}.y1"), c(f"{b}.y1")))


def morton(x: Column, y: Column, bits: int = 16) -> Column:
    """The bits of x and y interleaved, x lowest."""
    code = F.lit(0).cast("long")
    for k in range(bits):
        code = code.bitwiseOR(F.shiftleft(F.shiftright(x.cast("long"), k).bitwiseAND(F.lit(1)), 2 * k)).bitwiseOR(F.shiftleft(F.shiftright(y.cast("long"), k).bitwiseAND(F.lit(1)), 2 * k + 1))
    return code
