"""Relations of general polygons and lines against plain versions in fractions, and the grid join of very unlike boxes."""

import random
from fractions import Fraction as Q

import pytest
from pyspark.sql import functions as F

from quadrille.functions import overlay as o
from quadrille.operators import dissolve
from quadrille.operators import relation as r
from quadrille.operators import shapes as s

RINGS = "array<array<struct<x:double,y:double>>>"


def ring(*at):
    return [{"x": float(x), "y": float(y)} for x, y in [*at, at[0]]]


def made(rng, n=9):
    """Star-shaped rings about a point, some hollow, some with a hole or run the other way round."""
    out = []
    for fid in range(n):
        x, y = rng.randrange(0, 16), rng.randrange(0, 16)
        at = [(0, 1), (3, 3), (1, 0), (2, -2), (0, -1), (-3, -2), (-1, 0), (-2, 2)]
        outer = [(x + dx * rng.randrange(2, 4), y + dy * rng.randrange(2, 4)) for dx, dy in at]
        hole = [(x + dx, y + dy) for dx, dy in ((0, 1), (1, 0), (0, -1), (-1, 0))]
        rings = [ring(*(outer if rng.random() < 0.5 else outer[::-1]))] + ([ring(*hole)] if rng.random() < 0.4 else [])
        out.append((fid, rings))
    return out


def sides(rings):
    return [tuple(Q(int(v)) for v in (p["x"], p["y"], q["x"], q["y"])) for one in rings for p, q in zip(one, one[1:])]


def crossing(a, b):
    """Where on a, from 0 to 1, side b crosses or ends; none for parallel ones."""
    d = (a[2] - a[0]) * (b[3] - b[1]) - (a[3] - a[1]) * (b[2] - b[0])
    if not d:
        return None
    t = ((b[0] - a[0]) * (b[3] - b[1]) - (b[1] - a[1]) * (b[2] - b[0])) / d
    u = ((b[0] - a[0]) * (a[3] - a[1]) - (b[1] - a[1]) * (a[2] - a[0])) / d
    return t if 0 <= t <= 1 and 0 <= u <= 1 else None


def spans(edges, x):
    y = sorted(e[1] + (e[3] - e[1]) * (x - e[0]) / (e[2] - e[0]) for e in edges if min(e[0], e[2]) < x < max(e[0], e[2]))
    return list(zip(y[::2], y[1::2]))


def slab_area(shapes, measure):
    """Sums, over slabs without a vertex or crossing inside, what `measure` finds of each shape's spans at the middle."""
    edges = [e for shape in shapes for e in shape]
    xs = {e[0] for e in edges} | {e[0] + (e[2] - e[0]) * t for e in edges for f in edges if e[0] != e[2] and f[0] != f[2] and (t := crossing(e, f)) is not None}
    xs = sorted(xs)
    return sum((b - a) * measure([spans(shape, (a + b) / 2) for shape in shapes]) for a, b in zip(xs, xs[1:]))


def both(found):
    return sum(max(Q(0), min(b, d) - max(a, c)) for a, b in found[0] for c, d in found[1])


def union(found):
    total, end = Q(0), None
    for a, b in sorted(x for one in found for x in one):
        total += max(Q(0), b - (a if end is None else max(a, end)))
        end = b if end is None else max(end, b)
    return total


def inside(shape, x, y):
    """In a shape or on its outline."""
    for e in shape:
        if (e[2] - e[0]) * (y - e[1]) == (e[3] - e[1]) * (x - e[0]) and min(e[0], e[2]) <= x <= max(e[0], e[2]) and min(e[1], e[3]) <= y <= max(e[1], e[3]):
            return True
    return sum((e[1] > y) != (e[3] > y) and x < e[0] + (e[2] - e[0]) * (y - e[1]) / (e[3] - e[1]) for e in shape) % 2 == 1


def length_in(path, shapes):
    """How much of a line lies in the union of shapes."""
    total = 0.0
    for p, q in zip(path, path[1:]):
        a = (*map(Q, p), *map(Q, q))
        if p == q:
            continue
        ts = {Q(0), Q(1)} | {t for shape in shapes for e in shape if (t := crossing(a, e)) is not None}
        n = (a[2] - a[0]) ** 2 + (a[3] - a[1]) ** 2
        ts |= {t for shape in shapes for e in shape for x, y in (e[:2], e[2:]) if (t := ((x - a[0]) * (a[2] - a[0]) + (y - a[1]) * (a[3] - a[1])) / n) and 0 <= t <= 1}
        ts = sorted(ts)
        for t, u in zip(ts, ts[1:]):
            m = (t + u) / 2
            if any(inside(shape, a[0] + (a[2] - a[0]) * m, a[1] + (a[3] - a[1]) * m) for shape in shapes):
                total += float(u - t) * float(n) ** 0.5
    return total


@pytest.fixture(scope="module")
def drawn(spark):
    rng = random.Random(7)
    a, b = made(rng, 14), made(rng, 10)
    b += [(10, [ring((2, 2), (6, 2), (6, 6), (2, 6))]), (11, [ring((6, 2), (10, 2), (10, 6), (6, 6))])]  # neighbours of one side
    paths = [(k, [(rng.randrange(0, 18), rng.randrange(0, 18)) for _ in range(rng.randrange(2, 5))]) for k in range(20)]
    paths += [(20, [(2, 2), (10, 2)]), (21, [(6, 0), (6, 8)]), (22, [(40, 40), (41, 41)]), (23, [(3, 3), (9, 5)])]
    frame = lambda rows: spark.createDataFrame(rows, f"fid long, rings {RINGS}")
    lines = spark.createDataFrame([(k, [{"x": float(x), "y": float(y)} for x, y in p]) for k, p in paths], "fid long, path array<struct<x:double,y:double>>")
    return a, b, paths, frame(a), frame(b), lines


def close(got, expected):
    assert got.keys() == expected.keys()
    assert all(abs(got[k] - float(v)) < 1e-6 for k, v in expected.items()), [(k, got[k], float(v)) for k, v in expected.items() if abs(got[k] - float(v)) >= 1e-6][:3]


def test_areas(drawn):
    a, b, _, da, db, _ = drawn
    close({(x["fid"], x["related_fid"]): x["measure"] for x in s.overlaps(da, db, 1e-6).collect()}, {(i, j): v for i, x in a for j, y in b if (v := slab_area([sides(x), sides(y)], both)) > 1e-6})
    own = {x["fid"]: x["a"] for x in da.select("fid", o.rings_area(F.col("rings")).alias("a")).collect()}
    close(own, {i: slab_area([sides(x)], lambda f: union(f)) for i, x in a})


def test_unions(drawn):
    a, b, _, da, db, _ = drawn
    others = [sides(y) for _, y in b]

    def uncovered(x):
        return slab_area([sides(x), *others], lambda f: union(f[:1]) - sum(max(Q(0), min(d, h) - max(c, g)) for c, d in f[0] for g, h in merged(f[1:])))

    def merged(found):
        out = []
        for lo, hi in sorted(x for one in found for x in one):
            if out and lo <= out[-1][1]:
                out[-1] = (out[-1][0], max(out[-1][1], hi))
            else:
                out.append((lo, hi))
        return out

    left = {i: uncovered(x) for i, x in a}
    close({x["fid"]: x["measure"] for x in s.uncovered(da, db).collect()}, left)
    close({x["fid"]: x["measure"] for x in s.must_be_covered(da, db, 2).collect()}, {k: v for k, v in left.items() if v > 2})
    assert abs(s.union_area(db).first()["area"] - float(slab_area(others, union))) < 1e-6
    every = [(int(v["x"]), int(v["y"])) for _, x in b for v in x[0]]
    box = (max(x for x, _ in every) - min(x for x, _ in every)) * (max(y for _, y in every) - min(y for _, y in every))
    assert abs(dissolve.gaps(db).first()["measure"] - (box - float(slab_area(others, union)))) < 1e-6
    assert dissolve.gaps(db.filter("fid = 10")).isEmpty() and dissolve.gaps(db.filter("fid in (10, 11)")).isEmpty()
    # two neighbours cover jointly what neither does alone
    probe = db.sparkSession.createDataFrame([(1, [ring((4, 3), (8, 3), (8, 5), (4, 5))])], f"fid long, rings {RINGS}")
    assert s.polygons_within(probe, db.filter("fid in (10, 11)")).isEmpty() and not s.polygons_within(probe, db.filter("fid = 10")).isEmpty()


def test_lines(drawn):
    a, b, paths, _, db, lines = drawn
    shapes = {k: sides(x) for k, x in b}
    got = {(x["fid"], x["related_fid"]): x for x in s.line_in_polygon(lines, db).collect()}
    close({k: x["measure"] for k, x in got.items() if x["measure"] > 1e-9}, {(k, j): v for k, p in paths for j, y in shapes.items() if (v := length_in(p, [y])) > 1e-9})
    assert got[(20, 10)]["kind"] == got[(21, 10)]["kind"] == "Crosses" and got[(23, 10)]["kind"] == "Crosses"
    whole = {k: sum(((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2) ** 0.5 for p, q in zip(path, path[1:])) for k, path in paths}
    left = {k: max(0.0, whole[k] - length_in(p, list(shapes.values()))) for k, p in paths}
    close({x["fid"]: x["measure"] for x in s.uncovered(lines, db, of_line=True).collect()}, left)
    assert {x["fid"] for x in s.lines_within(lines, db, 1.0).collect()} == {k for k, v in left.items() if v > 1 or v >= whole[k] > 0}
    pair = db.filter("fid in (10, 11)")
    assert {x["fid"] for x in s.lines_within(lines, pair).collect()}.isdisjoint({20, 23}) and 22 in {x["fid"] for x in s.lines_within(lines, pair).collect()}


def test_points_and_touching(spark, drawn):
    a, b, _, da, db, _ = drawn
    points = [(k, float(k % 19), float(k // 19)) for k in range(19 * 19)]
    got = {(x["point"], x["polygon"]) for x in s.points_in(spark.createDataFrame(points, "fid long, x double, y double"), da).collect()}
    strict = lambda shape, x, y: inside(shape, x, y) and not any((e[2] - e[0]) * (y - e[1]) == (e[3] - e[1]) * (x - e[0]) and min(e[0], e[2]) <= x <= max(e[0], e[2]) and min(e[1], e[3]) <= y <= max(e[1], e[3]) for e in shape)
    assert got == {(k, i) for i, x in a for k, px, py in points if strict(sides(x), Q(int(px)), Q(int(py)))}
    assert {(x["fid"], x["related_fid"]) for x in s.touches(db.filter("fid = 10"), db.filter("fid = 11")).collect()} == {(10, 11)}


def test_null_and_empty_shapes(spark):
    rows = spark.createDataFrame([(1, None), (2, []), (3, [[]]), (4, [ring((0, 0), (4, 0), (4, 4))])], f"fid long, rings {RINGS}")
    assert [tuple(x) for x in s.overlaps(rows, rows).collect()] == [(4, 4, 8.0)]
    assert s.overlaps(rows.filter("fid < 4"), rows).isEmpty() and dissolve.gaps(rows.limit(0)).isEmpty()
    assert {x["fid"]: x["measure"] for x in s.uncovered(rows, rows.limit(0)).collect()}[4] == 8.0


def test_grid_join_of_unlike_boxes(spark):
    """A box of a million units, one of one and 100,000 small ones: few rows of cells, and no pair lost."""
    small = spark.range(100_000).select(F.col("id").alias("fid"), (F.col("id") % 1000 * 1000).alias("x1"), (F.floor(F.col("id") / 1000) * 1000).alias("y1"))
    small = small.select("fid", "x1", "y1", (F.col("x1") + F.col("fid") % 7 + 1).alias("x2"), (F.col("y1") + F.col("fid") % 5 + 1).alias("y2"))
    big = spark.createDataFrame([(-1, 0, 0, 1_000_000, 1_000_000), (-2, 500, 500, 501, 501), (-3, 3000, 2000, 90_000, 2000)], "fid long, x1 long, y1 long, x2 long, y2 long")
    size, of_a, of_b = r.grid(small, big)
    rows = r.cells(small.unionByName(big), size, 0, sorted({*of_a, *of_b})).count()
    assert rows <= 4 * 100_003 * len({*of_a, *of_b})
    size, of_a, of_b = r.grid(small, big, size=8)
    assert r.cells(big, 8, 0, of_a).count() <= 4 * 3 * 20
    got = {(x["a"]["fid"], x["b"]["fid"]) for x in r.box_join(small, big, size=8).filter("b.fid < -1").collect()}
    expected = {(x["fid"], -3) for x in small.filter("x1 <= 90000 AND x2 >= 3000 AND y1 <= 2000 AND y2 >= 2000").collect()}
    assert got == expected and r.box_join(small, big, size=8).filter("b.fid = -1").count() == 100_000


def test_loose_ends(spark):
    at = lambda *v: [{"x": float(x), "y": float(y)} for x, y in v]
    rows = [
        (1, at((0, 0), (10, 0))), (2, at((5, 0), (5, 5))),  # a T-junction: joined
        (3, at((100, 0), (110, 0))), (4, at((105, 0.5), (105, 9))),  # half a unit short of a line's middle
        (5, at((200, 0), (210, 0))), (6, at((210.4, 0.3), (220, 0))),  # beside a line's end
        (7, at((300, 0), (310, 0))), (8, at((310, 0), (320, 0))),  # end to end
        (9, at((400, 0), (401.5, 0))), (10, at((399, 0), (395, 0))), (11, at((402, 0), (406, 0))),  # both ends loose: the start counts
    ]
    found = s.loose_ends(spark.createDataFrame(rows, "fid long, path array<struct<x:double,y:double>>"), 2)
    got = {r["fid"]: (r["side"], round(r["measure"], 6), r["at_end"]) for r in found.collect()}
    assert got == {4: ("start", 0.5, False), 5: ("end", 0.5, True), 6: ("start", 0.5, True), 9: ("start", 1.0, True), 10: ("start", 1.0, True), 11: ("start", 0.5, True)}
