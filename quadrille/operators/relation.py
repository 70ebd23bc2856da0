"""Spatial joins as equi-joins of grid cells, and the relations between layers that are built on them."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrille.functions.geometry import overlap_area


def _edge(grow: float = 0) -> Column:
    """The longer edge of a box, grown."""
    return F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) + 2 * grow


def _doublings(edge: Column) -> Column:
    """The least power of two that is no less than an edge."""
    return F.ceil(F.log2(F.greatest(edge.cast("double"), F.lit(1e-9)))).cast("int")


def grid(a: DataFrame, b: DataFrame, grow: float = 0, size: float | None = None) -> tuple[float, list[int], list[int]]:
    """The edge of a grid cell for a join of two layers of boxes, and the levels that each layer's boxes are on.

    Unless given, the edge is the larger of the layers' mean edges and of twice the reach; of layers of points without
    reach that which holds about one of them. It is rounded up to a power of two. One pass over the boxes alone; what
    comes back is a row a layer with some dozens of levels at most, whatever the data.
    """
    facts = lambda df, by, nth: df.agg(F.lit(nth).alias("nth"), F.avg(_edge()).alias("edge"), F.count(F.lit(1)).alias("n"), ((F.max("x2") - F.min("x1")) * (F.max("y2") - F.min("y1"))).cast("double").alias("area"), F.collect_set(_doublings(_edge(by))).alias("powers"))
    rows = sorted(facts(a, grow, 0).unionByName(facts(b, 0, 1)).collect(), key=lambda r: r["nth"])
    wanted = size or max([2.0 * grow] + [float(r["edge"] or 0) for r in rows]) or max(float(r["area"] or 0) / max(1, r["n"]) for r in rows) ** 0.5 or 1.0
    power = math.ceil(math.log2(wanted))
    return 2.0**power, *(sorted({max(0, p - power) for p in r["powers"]}) for r in rows)


def level(size: float, grow: float = 0) -> Column:
    """How often a cell's edge, a power of two, must be doubled until a box, grown, meets at most two cells each way."""
    return F.greatest(F.lit(0), _doublings(_edge(grow)) - int(math.log2(size)))


def cells(df: DataFrame, size: float, grow: float = 0, levels: list[int] = ()) -> DataFrame:
    """A row for each cell that a box x1, y1, x2, y2, grown by `grow`, meets on the grid of its own level (home) and on
    those of `levels` that are coarser: at most four cells on each grid, however large the box."""
    own = level(size, grow)
    df = df.withColumn("home", own).withColumn("lv", F.explode(F.array_union(F.array(F.col("home")), F.filter(F.array(*map(F.lit, levels)).cast("array<int>"), lambda k: k > F.col("home")))))
    edge = F.lit(float(size)) * F.pow(F.lit(2.0), F.col("lv"))
    span = lambda a, b: F.sequence(F.floor((F.col(a) - grow) / edge), F.floor((F.col(b) + grow) / edge))
    return df.withColumn("home", F.col("home") == F.col("lv")).withColumn("cx", F.explode(span("x1", "x2"))).withColumn("cy", F.explode(span("y1", "y2")))


def as_boxes(points: DataFrame) -> DataFrame:
    return points.withColumns({"x1": F.col("x"), "y1": F.col("y"), "x2": F.col("x"), "y2": F.col("y")})


def box_join(a: DataFrame, b: DataFrame, size: float | None = None, grow: float = 0, condition: Column | None = None, keys: tuple[str, ...] = (), points: bool = False) -> DataFrame:
    """Pairs of rows, as structs a and b, whose boxes meet when a's is grown; each pair once, from the cell that has
    the lower left corner of what the boxes share. keys: columns that must be equal too.

    A pair meets on the grid of the coarser of its two levels. Which levels occur (some dozens at most, whatever the
    data) and, unless given, the cell's edge are found in a pass over the boxes alone; points: both layers are points and the
    size is at least twice the reach, so that none is needed. Cells with very many rows are left to AQE, which splits them.
    """
    size, of_a, of_b = (2.0 ** math.ceil(math.log2(max(size, 2 * grow))), [0], [0]) if points else grid(a, b, grow, size)
    own = ("home", "lv", "cx", "cy")
    pack = lambda df, name: df.select("lv", "cx", "cy", *[F.col(k).alias(f"{name}_{k}") for k in keys], F.col("home").alias(f"{name}_home"), F.struct(*[c for c in df.columns if c not in own]).alias(name))
    left, right = pack(cells(a, size, grow, of_b), "a"), pack(cells(b, size, 0, of_a), "b")
    for k in keys:
        left, right = left.withColumnRenamed(f"a_{k}", k), right.withColumnRenamed(f"b_{k}", k)
    c = F.col
    meets = (c("a.x1") - grow <= c("b.x2")) & (c("b.x1") <= c("a.x2") + grow) & (c("a.y1") - grow <= c("b.y2")) & (c("b.y1") <= c("a.y2") + grow)
    edge = F.lit(float(size)) * F.pow(F.lit(2.0), c("lv"))
    corner = (c("cx") == F.floor(F.greatest(c("a.x1") - grow, c("b.x1")) / edge)) & (c("cy") == F.floor(F.greatest(c("a.y1") - grow, c("b.y1")) / edge))
    pairs = left.join(right, ["lv", "cx", "cy", *keys]).filter((c("a_home") | c("b_home")) & meets & corner)
    return (pairs.filter(condition) if condition is not None else pairs).select("a", "b")


def box_met(a: DataFrame, b: DataFrame, condition: Column) -> DataFrame:
    """fid: rows of a that the condition, on structs a and b, holds for with any row of b whose box meets theirs. Looking
    ends with the first such row, so no pairs are formed."""
    size, of_a, of_b = grid(a, b)
    pack = lambda df, levels, name: cells(df, size, 0, levels).select("lv", "cx", "cy", F.col("home").alias(f"{name}_home"), F.struct(*df.columns).alias(name))
    left, right = pack(a, of_b, "a"), pack(b, of_a, "b").withColumnsRenamed({k: f"_{k}" for k in ("lv", "cx", "cy")})
    c = F.col
    meets = (c("a.x1") <= c("b.x2")) & (c("b.x1") <= c("a.x2")) & (c("a.y1") <= c("b.y2")) & (c("b.y1") <= c("a.y2"))
    same = [c(k) == c(f"_{k}") for k in ("lv", "cx", "cy")]
    return left.join(right, [*same, (c("a_home") | c("b_home")) & meets & condition], "left_semi").select("a.fid").distinct()


TOGETHER = 1000  # rows of one geometry that are kept in one list


def together(layer: DataFrame, geometry: tuple[str, ...], keys: tuple[str, ...] = (), nulls: bool = False) -> DataFrame:
    """Rows of one geometry (and equal keys) as one row: keys, geometry, run, fids in their order, lead (the first). A list
    has at most TOGETHER of them; more of one geometry make more runs. Rows without a fid go, or with nulls are kept, and
    fids is then an array of structs."""
    same = Window.partitionBy(*keys, *geometry).orderBy("fid")
    rows = layer.select("fid", *keys, *geometry)
    rows = (rows if nulls else rows.filter("fid IS NOT NULL")).withColumn("run", F.floor((F.row_number().over(same) - 1) / TOGETHER))
    return rows.groupBy(*keys, *geometry, "run").agg(F.collect_list(F.struct("fid") if nulls else "fid").alias("fids"), F.min("fid").alias("lead"))


def pairs_apart(groups: DataFrame, geometry: tuple[str, ...], measure: Callable[[str, str], Column], keys: tuple[str, ...] = (), costly: bool = False) -> DataFrame:
    """fid, related_fid, measure: pairs of rows of one layer, the smaller fid first, whose measure is above 0. groups are
    `together` with boxes. Each two geometries are measured once (from either side, for the order of fids decides which is
    the first), and their rows are written out as pairs after that. costly: a measure that is to stay out of the join's
    condition, where it would be worked out again."""
    c = F.col
    place = lambda n: F.struct(*[c(f"{n}.{k}") for k in ("lead", "run", *geometry)])
    tied = c("a.lead") == c("b.lead")
    met = box_join(groups, groups, condition=(c("a.lead") < c("b.lead")) | (tied & (place("a") <= place("b"))), keys=keys)
    both = [measure("a", "b").alias("ahead"), measure("b", "a").alias("back")]
    own = (tied & (place("a") == place("b"))).alias("own")
    rows = met.select(own, c("a.fids").alias("left"), c("b.fids").alias("right"), *([F.inline(F.array(F.struct(*both)))] if costly else both)).filter("ahead > 0 OR back > 0")
    rows = rows.select("own", "ahead", "back", "right", F.explode("left").alias("p")).select("own", "ahead", "back", "p", F.explode("right").alias("q"))
    found = rows.filter("p < q OR (p > q AND NOT own)").select(F.least("p", "q").alias("fid"), F.greatest("p", "q").alias("related_fid"), F.when(c("p") < c("q"), c("ahead")).otherwise(c("back")).alias("measure"))
    return found.filter("measure > 0")


def strictly_inside() -> Column:
    """Point a lies within box b; points on its edge are outside."""
    c = F.col
    return (c("a.x") > c("b.x1")) & (c("a.x") < c("b.x2")) & (c("a.y") > c("b.y1")) & (c("a.y") < c("b.y2"))


def overlaps(a: DataFrame, b: DataFrame, tolerance: float = 0, same: bool = False, keys: tuple[str, ...] = ()) -> DataFrame:
    """fid, related_fid, measure: pairs that share an area above the tolerance; same: of one layer, each pair once."""
    shared = overlap_area("a", "b")
    condition = shared > tolerance
    if same:
        condition &= F.col("a.fid") < F.col("b.fid")
    return box_join(a, b, condition=condition, keys=keys).select(F.col("a.fid").alias("fid"), F.col("b.fid").alias("related_fid"), shared.alias("measure"))


def point_polygon_both(points: DataFrame, polygons: DataFrame) -> DataFrame:
    """Polygons without a point inside, and points in no polygon."""
    inside = box_join(as_boxes(points), polygons, condition=strictly_inside()).select(F.col("a.fid").alias("point"), F.col("b.fid").alias("polygon"))
    none = polygons.join(inside, F.col("fid") == F.col("polygon"), "left_anti").select(F.lit("polygon").alias("side"), "fid")
    return none.unionByName(points.join(inside, F.col("fid") == F.col("point"), "left_anti").select(F.lit("point").alias("side"), "fid"))


def ends(lines: DataFrame) -> DataFrame:
    """A row for each end of a line: fid, side, x, y and the line's other columns."""
    sides = F.array(F.struct(F.lit("start").alias("side"), F.col("xa").alias("x"), F.col("ya").alias("y")), F.struct(F.lit("end").alias("side"), F.col("xb").alias("x"), F.col("yb").alias("y")))
    return lines.withColumn("e", F.explode(sides)).select(*[c for c in lines.columns if c not in ("xa", "ya", "xb", "yb")], "e.side", "e.x", "e.y")


def near_ends(all_ends: DataFrame, reach: float, keys: tuple[str, ...] = (), condition: Column | None = None) -> DataFrame:
    """Pairs of ends of different lines within reach, as structs a and b, both ways round."""
    c = F.col
    apart = F.pow(c("a.x") - c("b.x"), 2) + F.pow(c("a.y") - c("b.y"), 2)
    own = (c("a.fid") != c("b.fid")) & (apart <= reach * reach)
    return box_join(as_boxes(all_ends), as_boxes(all_ends), size=max(8, 2 * reach), grow=reach, condition=own if condition is None else own & condition, keys=keys, points=True)


def unconnected(all_ends: DataFrame, reach: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """Ends that no end of another line is near. Pairs are not formed: an end is in at most four cells, and stays there
    where one other end is near. Ends have no extent, so the grid needs no pass over them."""
    size = 2.0 ** math.ceil(math.log2(max(8, 2 * reach)))
    own = ("fid", "side")
    mine = cells(as_boxes(all_ends), size, reach).select("cx", "cy", "x", "y", *own, *keys)
    others = cells(as_boxes(all_ends), size).select(*[F.col(k).alias(f"_{k}") for k in ("cx", "cy", "x", "y", "fid", *keys)])
    meet = [F.col(k) == F.col(f"_{k}") for k in ("cx", "cy", *keys)]
    near = (F.col("fid") != F.col("_fid")) & (F.pow(F.col("x") - F.col("_x"), 2) + F.pow(F.col("y") - F.col("_y"), 2) <= reach * reach)
    joined = mine.join(others, [*meet, near], "left_semi").select(*[F.col(k).alias(f"_{k}") for k in own]).distinct()
    return all_ends.join(joined, [F.col(k) == F.col(f"_{k}") for k in own], "left_anti")


def places(points: DataFrame) -> DataFrame:
    """x, y, lo, hi: each place where points (fid, x, y) are, with the least and the greatest fid there. A place is looked
    at once, however many share it; points of two fids are there where lo and hi differ."""
    return points.groupBy("x", "y").agg(F.min("fid").alias("lo"), F.max("fid").alias("hi"))


def lone_places(points: DataFrame, reach: float) -> DataFrame:
    """x, y, fid: places of points of one fid alone that no point of another fid is within reach of."""
    every = places(points)
    lone = every.filter("lo = hi").select("x", "y", F.col("lo").alias("fid"))
    c = F.col
    other = (c("b.lo") != c("a.fid")) | (c("b.hi") != c("a.fid"))
    near = box_join(as_boxes(lone), as_boxes(every), size=max(4, 2 * reach), grow=reach, condition=other & (F.pow(c("a.x") - c("b.x"), 2) + F.pow(c("a.y") - c("b.y"), 2) <= reach * reach), points=True)
    return lone.join(near.select(c("a.fid").alias("_fid"), c("a.x").alias("_x"), c("a.y").alias("_y")), (c("fid") == c("_fid")) & (c("x") == c("_x")) & (c("y") == c("_y")), "left_anti")


def first_near(points: DataFrame, reach: float) -> DataFrame:
    """fid, related_fid: points nearer than reach to one of a smaller fid, and the smallest such. The smallest fid near a
    place is found once for all points there."""
    c = F.col
    every = as_boxes(places(points))
    near = box_join(every, every, size=2 * reach, grow=reach, condition=F.pow(c("a.x") - c("b.x"), 2) + F.pow(c("a.y") - c("b.y"), 2) < reach * reach, points=True)
    least = near.groupBy(c("a.x").alias("_x"), c("a.y").alias("_y")).agg(F.min("b.lo").alias("related_fid"))
    found = points.select("fid", "x", "y").join(least, (c("x") == c("_x")) & (c("y") == c("_y"))).filter("related_fid < fid")
    return found.groupBy("fid").agg(F.min("related_fid").alias("related_fid"))


def spacing(points: DataFrame, required: Column, reach: float) -> DataFrame:
    """Pairs of points nearer than required (an expression on structs a and b of at most reach), but not in one place."""
    c = F.col
    d = F.sqrt(F.pow(c("a.x") - c("b.x"), 2) + F.pow(c("a.y") - c("b.y"), 2))
    found = box_join(as_boxes(points), as_boxes(points), size=2 * reach, grow=reach, condition=(c("a.fid") < c("b.fid")) & (d > 0) & (d < required), points=True)
    return found.select(F.col("a.fid").alias("fid"), F.col("b.fid").alias("related_fid"), F.round(d, 6).alias("measure"))


def name_mismatches(bridges: DataFrame, rivers: DataFrame, reach: float) -> DataFrame:
    """fid, related_fid, bridge_name, river_name: boxes with a name of which the first box of rivers (by fid) that has a
    name and lies within reach has another; case and outer blanks do not matter."""
    c = F.col
    named = lambda df: df.filter(F.trim("name") != "")
    gap = lambda k: F.greatest(c(f"b.{k}1") - c(f"a.{k}2"), c(f"a.{k}1") - c(f"b.{k}2"), F.lit(0))
    near = box_join(named(bridges), named(rivers), grow=reach, condition=F.pow(gap("x"), 2) + F.pow(gap("y"), 2) <= reach * reach)
    first = near.groupBy(c("a.fid").alias("fid"), c("a.name").alias("bridge_name")).agg(F.min(F.struct(c("b.fid").alias("fid"), c("b.name").alias("name"))).alias("river"))
    return first.select("fid", c("river.fid").alias("related_fid"), "bridge_name", c("river.name").alias("river_name")).filter(F.lower(F.trim("bridge_name")) != F.lower(F.trim("river_name")))
