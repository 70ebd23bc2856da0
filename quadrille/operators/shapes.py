"""Relations of general polygons (fid, rings: closed vertex arrays, the shell first) and lines (fid, path).

Candidates come from the grid join of their boxes; what two shapes share is a column expression on the pair. What a
union of shapes covers is added up over grid cells: the shapes that meet a probe within a cell are cut into strips
there, so no group grows beyond what one cell holds, and no layer is ever dissolved as a whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions import overlay as o
from quadrille.functions.geometry import length
from quadrille.operators import relation as r
from quadrille.sources.staging import kept

c = F.col
BOX = ("x1", "y1", "x2", "y2")
FEW = 20_000  # so many ends or less are sent to every task instead of shuffling the layer of lines


def polygons(layer: DataFrame, steep: bool = False) -> DataFrame:
    """layer with the box and the strips of its rings (steep: also those for lines); null and empty geometry goes."""
    known = layer.filter(F.size(F.coalesce(F.get("rings", F.lit(0)), F.expr("array()"))) > 2).withColumns(o.box_of(F.get("rings", F.lit(0))))
    known = known.withColumns({"flat": o.strips(c("rings")), "area": o.rings_area(c("rings"))})
    return known.withColumn("steep", o.strips(c("rings"), swap=True)) if steep else known


def lines(layer: DataFrame) -> DataFrame:
    return layer.filter(F.size("path") > 1).withColumns(o.box_of(c("path")))


def boxes(layer: DataFrame) -> DataFrame:
    """A layer of boxes as polygons."""
    at = lambda a, b: F.struct(c(a).cast("double").alias("x"), c(b).cast("double").alias("y"))
    ring = F.array(at("x1", "y1"), at("x2", "y1"), at("x2", "y2"), at("x1", "y2"), at("x1", "y1"))
    return layer.withColumn("rings", F.array(ring)).drop(*BOX)


def _pair(*more: Column) -> list[Column]:
    return [c("a.fid").alias("fid"), c("b.fid").alias("related_fid"), *more]


def _where(value: Column, keep, name: str = "measure") -> Column:
    """A row for a pair whose value is one to keep; worked out once, which a filter behind a projection is not."""
    return F.explode(F.filter(F.array(value), keep)).alias(name)


def overlaps(a: DataFrame, b: DataFrame, tolerance: float = 0, same: bool = False, keys: tuple[str, ...] = ()) -> DataFrame:
    """fid, related_fid, measure: pairs of polygons that share an area above the tolerance; same: of one layer, each pair once."""
    pairs = r.box_join(polygons(a), polygons(b), condition=c("a.fid") < c("b.fid") if same else None, keys=keys)
    return pairs.select(*_pair(_where(o.shared_area(c("a.flat"), c("b.flat")), lambda v: v > tolerance)))


def partly_overlaps(a: DataFrame, b: DataFrame, tolerance: float = 0, whole: float = 1e-9) -> DataFrame:
    """As overlaps, but pairs of which one holds the other are left out."""
    pairs = r.box_join(polygons(a), polygons(b))
    rows = pairs.select(*_pair(_where(o.shared_area(c("a.flat"), c("b.flat")), lambda v: v > tolerance), F.least(c("a.area"), c("b.area")).alias("least")))
    return rows.filter(c("measure") < c("least") * (1 - whole)).drop("least")


def touches(a: DataFrame, b: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """fid, related_fid: pairs that meet, but share no area."""
    pairs = r.box_join(polygons(a), polygons(b), condition=o.rings_meet(c("a.rings"), c("b.rings")))
    return pairs.filter(o.shared_area(c("a.flat"), c("b.flat")) <= tolerance).select(*_pair())


def contained(objects: DataFrame, holders: DataFrame, whole: float = 1e-9) -> DataFrame:
    """fid (holder), related_fid, label: objects that a holder has inside, or that overlap it."""
    pairs = r.box_join(polygons(objects), polygons(holders))
    rows = pairs.select(c("b.fid").alias("fid"), c("a.fid").alias("related_fid"), _where(o.shared_area(c("a.flat"), c("b.flat")), lambda v: v > whole, "shared"), c("a.area").alias("own"))
    return rows.select("fid", "related_fid", F.when(c("shared") >= c("own") * (1 - whole), "inside").otherwise("overlap").alias("label"))


def points_in(points: DataFrame, holders: DataFrame) -> DataFrame:
    """point, polygon: points (fid, x, y) strictly inside polygons."""
    v = F.struct(c("a.x").cast("double").alias("x"), c("a.y").cast("double").alias("y"))
    pairs = r.box_join(r.as_boxes(points), polygons(holders), condition=o.holds_inside(c("b.rings"), v))
    return pairs.select(c("a.fid").alias("point"), c("b.fid").alias("polygon"))


def points_and_polygons(points: DataFrame, holders: DataFrame) -> DataFrame:
    """side, fid: polygons without a point inside, and points in no polygon."""
    inside = points_in(points, holders)
    none = holders.join(inside, c("fid") == c("polygon"), "left_anti").select(F.lit("polygon").alias("side"), "fid")
    return none.unionByName(points.join(inside, c("fid") == c("point"), "left_anti").select(F.lit("point").alias("side"), "fid"))


def centre_points(layer: DataFrame) -> DataFrame:
    """fid, x, y: the centroid of each polygon that has an area."""
    return layer.select("fid", o.centroid(c("rings")).alias("at")).filter("at IS NOT NULL").select("fid", "at.x", "at.y")


def lines_meet(a: DataFrame, b: DataFrame) -> DataFrame:
    """fid (polygon), related_fid (line): pairs that have a point in common."""
    return r.box_join(polygons(a), lines(b), condition=o.path_meets(c("b.path"), c("a.rings"))).select(*_pair())


def met_by_lines(a: DataFrame, b: DataFrame) -> DataFrame:
    """fid: polygons that have a point in common with any line."""
    return r.box_met(polygons(a).select("fid", "rings", *BOX), lines(b).select("path", *BOX), o.path_meets(c("b.path"), c("a.rings")))


def line_in_polygon(paths: DataFrame, holders: DataFrame) -> DataFrame:
    """fid, related_fid, kind, measure: lines and polygons that meet, as Within, Crosses or Touches, with the length inside."""
    pairs = r.box_join(lines(paths), polygons(holders, steep=True), condition=o.path_meets(c("a.path"), c("b.rings")))
    rows = pairs.select(*_pair(o.inside_length(c("a.path"), c("b.flat"), c("b.steep")).alias("inside"), length(c("a.path")).alias("whole")))
    kind = F.when(c("inside") >= c("whole") - 1e-9, "Within").when(c("inside") > 1e-9, "Crosses").otherwise("Touches")
    return rows.select("fid", "related_fid", kind.alias("kind"), c("inside").alias("measure"))


def lines_share(paths: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """fid, related_fid, measure: pairs of lines that have a stretch in common; crossings in a point are left out."""
    groups = lines(r.together(paths, ("path",), keys))
    return r.pairs_apart(groups, ("path",), lambda a, b: o.paths_share(c(f"{a}.path"), c(f"{b}.path")), keys, costly=True)


# --- unions ---------------------------------------------------------------------------------------------------


def _crossings(s: np.ndarray) -> np.ndarray:
    """The x of every crossing of two sides (x1, y1, x2, y2), none upright."""
    slope = (s[:, 3] - s[:, 1]) / (s[:, 2] - s[:, 0])
    base = s[:, 1] - slope * s[:, 0]
    i, j = np.triu_indices(len(s), 1)
    lo, hi = np.maximum(s[i, 0], s[j, 0]), np.minimum(s[i, 2], s[j, 2])
    ok = (hi > lo) & (slope[i] != slope[j])
    i, j, lo, hi = i[ok], j[ok], lo[ok], hi[ok]
    x = (base[j] - base[i]) / (slope[i] - slope[j])
    return x[(x > lo) & (x < hi)]


def union_strips(probe: np.ndarray | None, others: list[np.ndarray], window: tuple[float, float, float, float]) -> list[tuple[float, ...]]:
    """Strips (left, right, lower and upper y at left, at right) that make up what the union of others has of the probe
    (None: of everything) within the window. Polygons are sides x1, y1, x2, y2, none upright."""
    wx1, wy1, wx2, wy2 = window
    lid = np.array([[wx1, y, wx2, y] for y in (wy1, wy2)])
    every = [x for x in ([] if probe is None else [probe]) + others]
    sides = np.concatenate([x[(x[:, 0] < wx2) & (x[:, 2] > wx1)] for x in every] + [lid])
    xs = np.concatenate([sides[:, 0], sides[:, 2], _crossings(sides), [wx1, wx2]])
    xs = np.unique(xs[(xs >= wx1) & (xs <= wx2)])
    at = lambda s, x: s[:, 1] + (s[:, 3] - s[:, 1]) * ((x - s[:, 0]) / (s[:, 2] - s[:, 0]))
    out = []
    for left, right in zip(xs[:-1].tolist(), xs[1:].tolist()):
        mid = (left + right) / 2

        def spans(x):
            own = x[(x[:, 0] < mid) & (x[:, 2] > mid)]
            own = own[np.argsort(at(own, mid), kind="stable")]
            y = np.stack([at(own, v) for v in (mid, left, right)], axis=1)
            return [(y[k], y[k + 1]) for k in range(0, len(y) - 1, 2)]

        edges = [np.full(3, wy1), np.full(3, wy2)]
        bounds = [tuple(edges)] if probe is None else [(max(a, edges[0], key=lambda v: v[0]), min(b, edges[1], key=lambda v: v[0])) for a, b in spans(probe)]
        merged: list[list] = []
        for a, b in sorted((s for x in others for s in spans(x)), key=lambda s: s[0][0]):
            if merged and a[0] <= merged[-1][1][0]:
                merged[-1][1] = max(merged[-1][1], b, key=lambda v: v[0])
            else:
                merged.append([a, b])
        for low, high in bounds:
            for a, b in merged:
                a, b = max(a, low, key=lambda v: v[0]), min(b, high, key=lambda v: v[0])
                if b[0] > a[0]:
                    out.append((left, right, a[1], b[1], a[2], b[2]))
    return out


def strips_area(strips: list[tuple[float, ...]]) -> float:
    return sum((right - left) * ((b0 - a0) + (b1 - a1)) / 2 for left, right, a0, b0, a1, b1 in strips)


def covered_length(path: np.ndarray, others: list[np.ndarray], window: tuple[float, float, float, float]) -> float:
    """How much of a line (vertices x, y) within the window lies in the union of polygons, their outlines included."""
    wx1, wy1, wx2, wy2 = window
    total = 0.0
    sides = np.concatenate([*others, np.zeros((0, 4))])
    for (px, py), (qx, qy) in zip(path[:-1].tolist(), path[1:].tolist()):
        dx, dy = qx - px, qy - py
        ts = [0.0, 1.0]
        if dx:
            ts += [(wx1 - px) / dx, (wx2 - px) / dx]
        if dy:
            ts += [(wy1 - py) / dy, (wy2 - py) / dy]
        ex, ey = sides[:, 2] - sides[:, 0], sides[:, 3] - sides[:, 1]
        cross = dx * ey - dy * ex
        with np.errstate(divide="ignore", invalid="ignore"):
            ts += [t for t in (((sides[:, 0] - px) * ey - (sides[:, 1] - py) * ex) / cross)[cross != 0].tolist()]
        size = dx * dx + dy * dy
        if not size:
            continue
        if dx:  # ends of sides that lie along the part, and upright outlines, which are not among the sides
            ts += [t for k in (0, 2) for t in ((sides[:, k] - px) / dx).tolist()]
        ts = sorted({t for t in ts if 0 <= t <= 1})
        for a, b in zip(ts, ts[1:]):
            x, y = px + dx * (a + b) / 2, py + dy * (a + b) / 2
            if b - a > 1e-12 and wx1 <= x < wx2 and wy1 <= y < wy2 and any(_holds(s, x, y, dx == 0) for s in others):
                total += (b - a) * size**0.5
    return total


def _holds(s: np.ndarray, x: float, y: float, upright: bool) -> bool:
    """(x, y) lies in a polygon or on its outline; on an upright part of a line both sides of x count."""
    for here in ((x,) if not upright else (x - 1e-9, x + 1e-9)):
        own = s[(s[:, 0] <= here) & (s[:, 2] > here)]
        level = own[:, 1] + (own[:, 3] - own[:, 1]) * ((here - own[:, 0]) / (own[:, 2] - own[:, 0]))
        if (level > y).sum() % 2 or (np.abs(level - y) < 1e-9).any():
            return True
    return False


_SIDE = "array<array<double>>"


def _sides(strips: str) -> Column:
    return F.transform(c(strips), lambda s: F.array(s["x1"], s["y1"], s["x2"], s["y2"]))


def _by_cell(size: float, of_line: bool):
    def run(batches):
        for batch in batches:
            out = []
            for cx, cy, own, other in zip(*(batch.column(k).to_pylist() for k in ("cx", "cy", "own", "other"))):
                mine, others = np.array(own, float).reshape(-1, 2 if of_line else 4), [np.array(x, float).reshape(-1, 4) for x in other]
                window = (cx * size, cy * size, (cx + 1) * size, (cy + 1) * size)
                out.append(float(covered_length(mine, others, window) if of_line else strips_area(union_strips(mine, others, window))))
            yield pa.RecordBatch.from_arrays([batch.column("fid"), pa.array(out, pa.float64())], names=["fid", "part"])

    return run


def covered(probes: DataFrame, others: DataFrame, of_line: bool = False) -> DataFrame:
    """fid, covered: how much of each probe (area of polygons, length of lines) the union of others covers; probes that
    meet none have no row. Each cell of the grid that a probe and another share is reckoned by itself."""
    a, b = lines(probes) if of_line else polygons(probes), polygons(others)
    own = F.transform("path", lambda v: F.array(v["x"], v["y"])) if of_line else _sides("flat")
    a, b = a.select("fid", *BOX, own.alias("own")), b.select("fid", *BOX, _sides("flat").alias("other"))
    size = 2 * r.grid(a, b)[0]
    both = lambda k, f, n: F.floor(f(c(f"a.{k}{n}"), c(f"b.{k}{n}")) / size)
    span = lambda k: F.sequence(both(k, F.greatest, 1), both(k, F.least, 2))
    pairs = r.box_join(a, b).withColumn("cx", F.explode(span("x"))).withColumn("cy", F.explode(span("y")))
    rows = pairs.select(c("a.fid").alias("fid"), "cx", "cy", c("a.own").alias("own"), c("b.other").alias("other"))
    # a list holds what meets one probe in one cell
    met = rows.groupBy("fid", "cx", "cy").agg(F.first("own").alias("own"), F.collect_list("other").alias("other"))
    parts = met.mapInArrow(_by_cell(size, of_line), f"{_type(probes)}, part double")
    return parts.groupBy("fid").agg(F.sum("part").alias("covered"))


def _type(layer: DataFrame) -> str:
    return f"fid {layer.schema['fid'].dataType.simpleString()}"


def uncovered(probes: DataFrame, others: DataFrame, of_line: bool = False) -> DataFrame:
    """fid, size, measure: each probe's area (length) and what of it the union of others leaves out."""
    whole = probes.select("fid", (length(c("path")) if of_line else o.rings_area(c("rings"))).alias("size"))
    got = covered(probes, others, of_line).withColumnRenamed("fid", "_fid")
    left = whole.join(got, c("fid") == c("_fid"), "left")
    return left.select("fid", "size", F.greatest(F.lit(0.0), c("size") - F.coalesce("covered", F.lit(0.0))).alias("measure"))


def must_be_covered(probes: DataFrame, others: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """fid, measure: polygons of which the union of others leaves more than the tolerance uncovered."""
    return uncovered(probes, others).filter(c("measure") > tolerance).select("fid", "measure")


def polygons_within(probes: DataFrame, others: DataFrame, tolerance: float = 0) -> DataFrame:
    """fid, measure: polygons that do not lie in the union of others; with a tolerance, an area outside of at most its
    square, or of under a hundredth, will do."""
    left = uncovered(probes, others).filter(c("measure") > 1e-9)
    if tolerance > 0:
        left = left.filter((c("measure") > tolerance * tolerance) & (c("measure") >= 0.01 * c("size")))
    return left.select("fid", "measure")


def lines_within(paths: DataFrame, others: DataFrame, tolerance: float = 0) -> DataFrame:
    """fid, measure: lines of which more than the tolerance lies outside the union of polygons. A line that meets no
    polygon lies outside whole, however short."""
    left = uncovered(paths, others, of_line=True)
    return left.filter((c("measure") > F.greatest(F.lit(float(tolerance)), F.lit(1e-9))) | ((c("measure") >= c("size")) & (c("size") > 0))).select("fid", "measure")


def _union_of_cell(size: float):
    def run(group: pa.Table) -> pa.Table:
        cx, cy = (group.column(k)[0].as_py() for k in ("cx", "cy"))
        strips = union_strips(None, [np.array(x, float).reshape(-1, 4) for x in group.column("other").to_pylist()], (cx * size, cy * size, (cx + 1) * size, (cy + 1) * size))
        return pa.table([pa.array(x, pa.float64()) for x in (zip(*strips) if strips else [[]] * 6)], names=["x1", "x2", "low1", "high1", "low2", "high2"])

    return run


def union_pieces(layer: DataFrame) -> DataFrame:
    """The union of a layer as strips that share no area: x1, x2, and the lower and upper y at either. Each cell of the
    grid is dissolved by itself; cells are as large as polygons mostly are."""
    shapes = polygons(layer.dropDuplicates(["rings"])).select("fid", *BOX, _sides("flat").alias("other"))
    size = 2 * r.grid(shapes, shapes)[0]
    span = lambda k: F.sequence(F.floor(c(f"{k}1") / size), F.floor(c(f"{k}2") / size))
    rows = shapes.withColumn("cx", F.explode(span("x"))).withColumn("cy", F.explode(span("y"))).select("cx", "cy", "other")
    return rows.groupBy("cx", "cy").applyInArrow(_union_of_cell(size), "x1 double, x2 double, low1 double, high1 double, low2 double, high2 double")


def union_area(layer: DataFrame) -> DataFrame:
    """pieces, area: of the union of a layer."""
    area = (c("x2") - c("x1")) * (c("high1") - c("low1") + c("high2") - c("low2")) / 2
    return union_pieces(layer).agg(F.count(F.lit(1)).alias("pieces"), F.coalesce(F.sum(area), F.lit(0.0)).alias("area"))


# --- nearness and turns -----------------------------------------------------------------------------------------


def _vertex(name: str) -> Column:
    return F.struct(c(f"{name}.x").cast("double").alias("x"), c(f"{name}.y").cast("double").alias("y"))


def points_away(points: DataFrame, holders: DataFrame, reach: float, key: tuple[str, ...] = ("fid",)) -> DataFrame:
    """Points (x, y and a key) that no polygon is within reach of."""
    pairs = r.box_join(r.as_boxes(points), polygons(holders), grow=reach, condition=o.rings_distance(_vertex("a"), c("b.rings")) <= reach)
    near = pairs.select(*[c(f"a.{k}").alias(f"_{k}") for k in key]).distinct()
    same = [c(k) == c(f"_{k}") for k in key]
    return points.join(near, [x for x in same], "left_anti")


def vertices(paths: DataFrame) -> DataFrame:
    """A row for each vertex of a line: fid, nth, x, y."""
    return paths.select("fid", F.posexplode("path").alias("nth", "v")).select("fid", "nth", "v.x", "v.y")


def ends(paths: DataFrame) -> DataFrame:
    """A row for each end of a line: fid, side, x, y."""
    each = F.array(F.struct(F.lit("start").alias("side"), F.get("path", F.lit(0)).alias("v")), F.struct(F.lit("end").alias("side"), F.element_at("path", -1).alias("v")))
    return paths.filter(F.size("path") > 1).select("fid", F.explode(each).alias("e")).select("fid", "e.side", "e.v.x", "e.v.y")


def loose_ends(paths: DataFrame, reach: float, joined: float = 0.001) -> DataFrame:
    """fid, side, measure, at_end: of each line the first end (start before end) that lies nearer than reach to another
    line, but joins none: its distance from the nearest line (of equally near ones the first), and whether the nearest
    point of that is one of its ends (an overshoot; else an undershoot). What is nearer than `joined` is joined, at an
    end or anywhere else on a line."""
    every = ends(paths)
    if joined > 0:  # an end at a vertex of another line is joined; only those of one line's vertices alone are looked at
        sound = paths.filter(F.forall("path", lambda v: v["x"].isNotNull() & v["y"].isNotNull()) & (F.size("path") > 1))
        shared = r.places(vertices(sound)).filter("lo <> hi").select(c("x").alias("_x"), c("y").alias("_y"))
        every = every.join(shared, (c("x") == c("_x")) & (c("y") == c("_y")), "left_anti")
    every, told = kept(every, n=F.count(F.lit(1)))
    boxed = r.as_boxes(every)
    near = r.box_join(F.broadcast(boxed) if told["n"] <= FEW else boxed, lines(paths).select("fid", "path", *BOX), grow=reach, condition=c("a.fid") != c("b.fid"))
    gap = lambda v, w: F.sqrt(F.pow(v["x"] - w["x"], 2) + F.pow(v["y"] - w["y"], 2))
    found = near.select(c("a.fid").alias("fid"), c("a.side").alias("side"), c("b.fid").alias("other"), c("b.path").alias("path"), _where(o.path_nearest(_vertex("a"), c("b.path")), lambda n: n["d"] < reach, "n"))
    at_end = F.least(gap(c("n"), F.get("path", F.lit(0))), gap(c("n"), F.element_at("path", -1))) < joined
    least = found.groupBy("fid", "side").agg(F.min(F.struct(c("n.d").alias("d"), "other", at_end.alias("at_end"))).alias("n"))
    first = least.filter(c("n.d") >= joined).groupBy("fid").agg(F.max_by(F.struct("side", "n"), "side").alias("e"))  # 'start' comes after 'end' by letters
    return first.select("fid", "e.side", c("e.n.d").alias("measure"), c("e.n.at_end").alias("at_end"))


def sharp_bends(paths: DataFrame, below: float) -> DataFrame:
    """fid, nth, measure: the first inner vertex of each line whose turn is below so many degrees."""
    found = F.filter(o.turns(c("path")), lambda t: t["turn"] < below)
    return paths.select("fid", F.get(found, F.lit(0)).alias("t")).filter("t IS NOT NULL").select("fid", "t.nth", c("t.turn").alias("measure"))


def spikes(layer: DataFrame, below: float) -> DataFrame:
    """fid, ring, nth, measure: vertices of rings, the first one too, at which the angle is below so many degrees."""
    each = layer.select("fid", F.posexplode("rings").alias("ring", "path")).select("fid", "ring", F.explode(o.turns(c("path"), closed=True)).alias("t"))
    return each.select("fid", "ring", "t.nth", (180 - c("t.turn")).alias("measure")).filter(c("measure") < below)
