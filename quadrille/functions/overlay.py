"""Areas, lengths and predicates of polygons with holes and of lines, as column expressions; nothing leaves the JVM.

A polygon is rings: an array of closed vertex arrays, the shell first; a line is path: a vertex array. A polygon is
read as a sum of signed strips, one under each of its sides (`strips`): a point is inside where the strips that hold it
add up to 1. What two polygons share, and what of a line lies in one, are then sums over pairs of sides, each in
closed form; neither convexity nor the order of vertices matters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadrille.functions import geometry as g

ZERO = 1e-9


def bound(value: Column, f) -> Column:
    """f of a value that is worked out once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _turned(v: Column, swap: bool) -> Column:
    return F.struct(v["y"].alias("x"), v["x"].alias("y")) if swap else v


def strips(rings: Column, swap: bool = False) -> Column:
    """The sides of a polygon that are not upright, from left to right, as x1, y1, x2, y2 and a sign: 1 where the
    polygon lies below the side, -1 where above. Null and empty rings have none. swap: with x and y exchanged."""

    def of_ring(ring, nth):
        twice = F.aggregate(g.sides(ring), F.lit(0.0), lambda t, s: t + (s["p"]["x"] * s["q"]["y"] - s["q"]["x"] * s["p"]["y"]))
        turn = F.signum(twice) * F.when(nth == 0, 1.0).otherwise(-1.0) * (-1.0 if swap else 1.0)

        def side(s, t):
            p, q = _turned(s["p"], swap), _turned(s["q"], swap)
            made = lambda a, b, sign: F.struct(a["x"].cast("double").alias("x1"), a["y"].cast("double").alias("y1"), b["x"].cast("double").alias("x2"), b["y"].cast("double").alias("y2"), sign.alias("s"))
            return F.when(p["x"] < q["x"], made(p, q, -t)).otherwise(made(q, p, t))

        upright = lambda s: s["p"]["y"] == s["q"]["y"] if swap else s["p"]["x"] == s["q"]["x"]
        return bound(turn, lambda t: F.transform(F.filter(g.sides(ring), lambda s: ~upright(s)), lambda s: side(s, t)))

    return F.flatten(F.transform(F.coalesce(rings, F.expr("array()").cast("array<array<struct<x:double,y:double>>>")), of_ring))


def _at(s: Column, x: Column) -> Column:
    return s["y1"] + (s["y2"] - s["y1"]) * ((x - s["x1"]) / (s["x2"] - s["x1"]))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda t, v: t + v)


def rings_area(rings: Column) -> Column:
    """The shell's area without its holes."""
    own = F.transform(rings, lambda ring, nth: g.area(ring) * F.when(nth == 0, 1.0).otherwise(-1.0))
    return F.coalesce(_sum(own), F.lit(0.0))


def shared_area(a: Column, b: Column) -> Column:
    """The area that two polygons share, from their strips."""
    base = F.coalesce(F.get(a, F.lit(0))["y1"], F.lit(0.0))

    def with_side(p):
        met = F.filter(b, lambda q: (q["x1"] < p["x2"]) & (p["x1"] < q["x2"]))

        def ends(q):
            at = lambda e: F.struct((_at(p, e) - base).alias("p"), (_at(q, e) - base).alias("q"))
            lo, hi = F.greatest(p["x1"], q["x1"]), F.least(p["x2"], q["x2"])
            return bound(F.struct(lo.alias("lo"), hi.alias("hi")), lambda e: F.struct((e["hi"] - e["lo"]).alias("w"), at(e["lo"]).alias("l"), at(e["hi"]).alias("h"), (p["s"] * q["s"]).alias("s")))

        def lower(e):
            """The area under the lower of the two sides."""
            low = lambda v: F.least(v["p"], v["q"])
            d0, d1 = e["l"]["p"] - e["l"]["q"], e["h"]["p"] - e["h"]["q"]
            cut = bound(d0 / (d0 - d1), lambda t: (t * low(e["l"]) + (1 - t) * low(e["h"]) + e["l"]["p"] + t * (e["h"]["p"] - e["l"]["p"])) / 2)
            return e["s"] * e["w"] * F.when(d0 * d1 >= 0, (low(e["l"]) + low(e["h"])) / 2).otherwise(cut)

        return _sum(F.transform(F.transform(met, ends), lower))

    return F.greatest(F.lit(0.0), _sum(F.transform(a, with_side)))


def inside_length(path: Column, flat: Column, steep: Column) -> Column:
    """How much of a line lies in a polygon, its outline included. flat, steep: the polygon's strips, and those with x
    and y exchanged, for the line's steep parts."""

    def of_part(s):
        dx, dy = s["q"]["x"] - s["p"]["x"], s["q"]["y"] - s["p"]["y"]
        size = F.sqrt(dx * dx + dy * dy)
        swap = F.abs(dy) > F.abs(dx)
        u = lambda v: F.when(swap, v["y"]).otherwise(v["x"])
        w = lambda v: F.when(swap, v["x"]).otherwise(v["y"])
        ahead = u(s["p"]) < u(s["q"])
        pick = lambda f, a, b: F.when(ahead, f(a)).otherwise(f(b))
        own = F.struct(pick(u, s["p"], s["q"]).alias("x1"), pick(w, s["p"], s["q"]).alias("y1"), pick(u, s["q"], s["p"]).alias("x2"), pick(w, s["q"], s["p"]).alias("y2"))
        return F.struct(own.alias("own"), F.when(swap, steep).otherwise(flat).alias("sides"), size.alias("size"))

    def below(part):
        own = part["own"]
        met = F.filter(part["sides"], lambda q: (q["x1"] < own["x2"]) & (own["x1"] < q["x2"]))

        def ends(q):
            lo, hi = F.greatest(own["x1"], q["x1"]), F.least(own["x2"], q["x2"])
            d = lambda x: _at(own, x) - _at(q, x)
            exact = lambda v: F.when(F.abs(v) < ZERO, 0.0).otherwise(v)
            return F.struct((hi - lo).alias("w"), exact(d(lo)).alias("d0"), exact(d(hi)).alias("d1"), q["s"].alias("s"))

        def share(e):
            """The width over which the line lies below the side, or on one that has the polygon below it."""
            both = F.when((e["d0"] == 0) & (e["d1"] == 0), F.when(e["s"] > 0, 1.0).otherwise(0.0))
            part_of = both.when((e["d0"] <= 0) & (e["d1"] <= 0), 1.0).when((e["d0"] >= 0) & (e["d1"] >= 0), 0.0)
            crossing = F.when(e["d0"] < 0, e["d0"] / (e["d0"] - e["d1"])).otherwise(e["d1"] / (e["d1"] - e["d0"]))
            return e["s"] * e["w"] * part_of.otherwise(crossing)

        return F.when(part["size"] > 0, _sum(F.transform(F.transform(met, ends), share)) * part["size"] / (own["x2"] - own["x1"])).otherwise(0.0)

    return _sum(F.transform(F.transform(g.sides(path), of_part), below))


def holds(rings: Column, v: Column) -> Column:
    """v lies in the polygon or on its outline."""
    in_hole = F.exists(F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0))), lambda hole: g.covers(hole, v) & ~g.on_boundary(hole, v))
    return F.coalesce((F.size(rings) > 0) & g.covers(F.get(rings, F.lit(0)), v) & ~in_hole, F.lit(False))


def holds_inside(rings: Column, v: Column) -> Column:
    """v lies in the polygon, but not on its outline."""
    return holds(rings, v) & ~F.exists(rings, lambda ring: g.on_boundary(ring, v))


def _side_of(s: Column, v: Column) -> Column:
    return F.signum((s["q"]["x"] - s["p"]["x"]) * (v["y"] - s["p"]["y"]) - (s["q"]["y"] - s["p"]["y"]) * (v["x"] - s["p"]["x"]))


def _boxes_meet(s: Column, t: Column) -> Column:
    axis = lambda k: (F.least(s["p"][k], s["q"][k]) <= F.greatest(t["p"][k], t["q"][k])) & (F.least(t["p"][k], t["q"][k]) <= F.greatest(s["p"][k], s["q"][k]))
    return axis("x") & axis("y")


def sides_meet(s: Column, t: Column) -> Column:
    """Two sides p, q cross or touch."""
    return _boxes_meet(s, t) & (_side_of(s, t["p"]) * _side_of(s, t["q"]) <= 0) & (_side_of(t, s["p"]) * _side_of(t, s["q"]) <= 0)


def sides_share(s: Column, t: Column) -> Column:
    """The length of the stretch that two sides have in common; 0 where they do not lie on one line."""
    dx, dy = s["q"]["x"] - s["p"]["x"], s["q"]["y"] - s["p"]["y"]
    size = F.sqrt(dx * dx + dy * dy)
    at = lambda v: ((v["x"] - s["p"]["x"]) * dx + (v["y"] - s["p"]["y"]) * dy) / size
    common = F.least(size, F.greatest(at(t["p"]), at(t["q"]))) - F.greatest(F.lit(0.0), F.least(at(t["p"]), at(t["q"])))
    return F.when((size > 0) & (_side_of(s, t["p"]) == 0) & (_side_of(s, t["q"]) == 0) & (common > ZERO), common).otherwise(0.0)


def path_meets(path: Column, rings: Column) -> Column:
    """A line has a point in a polygon or on its outline."""
    touched = F.exists(g.sides(path), lambda s: F.exists(rings, lambda ring: F.exists(g.sides(ring), lambda t: sides_meet(s, t))))
    return F.coalesce(touched, F.lit(False)) | F.coalesce(holds(rings, F.get(path, F.lit(0))), F.lit(False))


def rings_meet(a: Column, b: Column) -> Column:
    """Two polygons have a point in common."""
    touched = F.exists(a, lambda ring: F.exists(g.sides(ring), lambda s: F.exists(b, lambda other: F.exists(g.sides(other), lambda t: sides_meet(s, t)))))
    first = lambda rings: F.get(F.get(rings, F.lit(0)), F.lit(0))
    return F.coalesce(touched, F.lit(False)) | holds(a, first(b)) | holds(b, first(a))


def paths_share(a: Column, b: Column) -> Column:
    """The length of the stretches that two lines have in common."""
    several = _sum(F.flatten(F.transform(g.sides(a), lambda s: F.transform(g.sides(b), lambda t: sides_share(s, t)))))
    one = lambda path: {"p": F.get(path, F.lit(0)), "q": F.get(path, F.lit(1))}
    return F.when((F.size(a) == 2) & (F.size(b) == 2), sides_share(one(a), one(b))).otherwise(several)


def centroid(rings: Column) -> Column:
    """The centre of a polygon's area, holes left out; null where it has none."""

    def moments(ring, nth):
        cross = lambda s: s["p"]["x"] * s["q"]["y"] - s["q"]["x"] * s["p"]["y"]
        of = lambda f: _sum(F.transform(g.sides(ring), lambda s: f(s) * cross(s))).cast("double")
        sums = F.struct(of(lambda s: F.lit(1.0)).alias("a"), of(lambda s: s["p"]["x"] + s["q"]["x"]).alias("x"), of(lambda s: s["p"]["y"] + s["q"]["y"]).alias("y"))
        way = lambda m: F.signum(m["a"]) * F.when(nth == 0, 1.0).otherwise(-1.0)
        return bound(sums, lambda m: F.struct((way(m) * m["a"]).alias("a"), (way(m) * m["x"]).alias("x"), (way(m) * m["y"]).alias("y")))

    zero = F.struct(*[F.lit(0.0).alias(k) for k in "axy"])
    total = F.aggregate(F.transform(rings, moments), zero, lambda t, m: F.struct(*[(t[k] + m[k]).alias(k) for k in "axy"]))
    return bound(total, lambda t: F.when(t["a"] > 0, F.struct((t["x"] / (3 * t["a"])).alias("x"), (t["y"] / (3 * t["a"])).alias("y"))))


def box_of(vertices: Column) -> dict[str, Column]:
    """x1, y1, x2, y2 of an array of vertices."""
    return {f"{k}{n}": f(F.transform(vertices, lambda v: v[k])) for k in "xy" for n, f in ((1, F.array_min), (2, F.array_max))}  # noqa: B023


def side_distance(v: Column, s: Column) -> Column:
    """How far a point lies from a side p, q."""
    dx, dy = s["q"]["x"] - s["p"]["x"], s["q"]["y"] - s["p"]["y"]
    along = F.coalesce(F.try_divide((v["x"] - s["p"]["x"]) * dx + (v["y"] - s["p"]["y"]) * dy, dx * dx + dy * dy), F.lit(0.0))
    return bound(F.greatest(F.lit(0.0), F.least(F.lit(1.0), along)), lambda t: F.sqrt(F.pow(v["x"] - s["p"]["x"] - t * dx, 2) + F.pow(v["y"] - s["p"]["y"] - t * dy, 2)))


def path_distance(v: Column, path: Column) -> Column:
    """How far a point lies from a line or ring; null for one without sides."""
    return F.array_min(F.transform(g.sides(path), lambda s: side_distance(v, s)))


def path_nearest(v: Column, path: Column) -> Column:
    """d, x, y: how far a point lies from a line or ring, to nine digits, and the nearest point of it (of several the
    first by x and y); null for one without sides."""

    def of(s):
        dx, dy = s["q"]["x"] - s["p"]["x"], s["q"]["y"] - s["p"]["y"]
        along = F.coalesce(F.try_divide((v["x"] - s["p"]["x"]) * dx + (v["y"] - s["p"]["y"]) * dy, dx * dx + dy * dy), F.lit(0.0))
        at = bound(F.greatest(F.lit(0.0), F.least(F.lit(1.0), along)), lambda t: F.struct((s["p"]["x"] + t * dx).alias("x"), (s["p"]["y"] + t * dy).alias("y")))
        return bound(at, lambda n: F.struct(F.round(F.sqrt(F.pow(v["x"] - n["x"], 2) + F.pow(v["y"] - n["y"], 2)), 9).alias("d"), n["x"].alias("x"), n["y"].alias("y")))

    return F.array_min(F.transform(g.sides(path), of))


def rings_distance(v: Column, rings: Column) -> Column:
    """How far a point lies from a polygon; 0 in it."""
    return F.when(holds(rings, v), 0.0).otherwise(F.array_min(F.transform(rings, lambda ring: path_distance(v, ring))))


def turns(path: Column, closed: bool = False) -> Column:
    """nth and turn, in degrees from 0 (straight on), of each inner vertex of a line; closed: of each vertex of a ring."""
    nothing = F.expr("cast(array() as array<struct<nth:int,turn:double>>)")

    def of(own):
        n = F.size(own)
        at = lambda k: F.get(own, k)
        first, last = (F.lit(0), n - 2) if closed else (F.lit(1), n - 2)

        def turn(k):
            p, q, s = at(F.when(k == 0, n - 2).otherwise(k - 1)), at(k), at(k + 1)
            return F.struct(k.alias("nth"), g.turn_degrees(q["x"] - p["x"], q["y"] - p["y"], s["x"] - q["x"], s["y"] - q["y"]).alias("turn"))

        return F.when(last >= first, F.transform(F.sequence(first, F.greatest(first, last)), turn)).otherwise(nothing)

    return bound(path, of)
