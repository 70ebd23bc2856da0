"""The union of a layer as rings, without any place where the whole layer meets.

Sides are cut at the lines of a grid. Each cell that sides run through finds, by itself, which pieces of them have the
union on one side only: it knows of every shape that has sides there whether one place of the cell lies in it (from
the shape's spans along a line through the column), and a cell that some shape fills has no outline at all. So a
shape costs as many rows as cells that its outline meets, however large it is. Within a cell pieces are strung into
chains; rings that cross cells are found by pointer jumping over the chains, in rounds that grow with the logarithm of the
number of chains in the longest ring.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.functions import clip
from quadrille.operators import relation as r
from quadrille.operators import shapes as s
from quadrille.operators.clipping import RINGS, as_rings, ring_lists
from quadrille.sources.staging import kept

c = F.col
RX, RY = 0.31415926535, 0.27182818284  # where in a cell its known place is, so that no vertex is likely to lie level with it
SHAPES = 500  # so many shapes of a batch are cut at the grid together
CELL_SIDES = 1500  # a cell with more is quartered within its task


def cut_at_grid(sides: np.ndarray, size: float) -> tuple[np.ndarray, np.ndarray]:
    """Sides cut at the lines of the grid, and the side that each is of. A cut follows from the side and the line alone."""
    cuts = [np.zeros((0, 4))]  # side, how far along, x, y
    n = len(sides)
    for k in (0, 1):
        a, b = sides[:, k], sides[:, 2 + k]
        lo, hi = np.floor(np.minimum(a, b) / size) + 1, np.ceil(np.maximum(a, b) / size) - 1
        times = np.maximum(0, hi - lo + 1).astype(np.int64)
        own = np.repeat(np.arange(n), times)
        line = (lo[own] + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)) * size
        t = (line - a[own]) / (b[own] - a[own])
        other = sides[own, 1 - k] + (sides[own, 3 - k] - sides[own, 1 - k]) * t
        cuts.append(np.stack([own, t, *((line, other) if k == 0 else (other, line))], axis=1))
    ends = np.arange(n)
    cuts += [np.stack([ends, np.zeros(n), sides[:, 0], sides[:, 1]], axis=1), np.stack([ends, np.ones(n), sides[:, 2], sides[:, 3]], axis=1)]
    every = np.concatenate(cuts)
    every = every[np.lexsort((every[:, 1], every[:, 0]))]
    places = np.round(every[:, 2:], clip.DIGITS) + 0.0
    same = (every[1:, 0] == every[:-1, 0]) & (places[1:] != places[:-1]).any(axis=1)
    return np.hstack([places[:-1][same], places[1:][same]]), every[1:, 0][same].astype(np.int64)


def spans(sides: np.ndarray, size: float, shape: np.ndarray | None = None) -> np.ndarray:
    """Where the lines through columns lie in the shape: column, lower and upper y, and the shape's number where sides are
    of several (shape has one for each side)."""
    lo, hi = np.minimum(sides[:, 0], sides[:, 2]), np.maximum(sides[:, 0], sides[:, 2])
    first, last = np.ceil(lo / size - RX), np.ceil(hi / size - RX) - 1
    times = np.maximum(0, last - first + 1).astype(np.int64)
    own = np.repeat(np.arange(len(sides)), times)
    column = first[own] + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    x = (column + RX) * size
    y = sides[own, 1] + (sides[own, 3] - sides[own, 1]) * ((x - sides[own, 0]) / (sides[own, 2] - sides[own, 0]))
    of = np.zeros(len(own), np.int64) if shape is None else shape[own]
    order = np.lexsort((y, column, of))
    column, y, of = column[order], y[order], of[order]
    return np.stack([column[::2], y[::2], y[1::2], of[::2]], axis=1)


def _rows(size: float, of: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = batch.column("nth").to_numpy()
            for begin in range(0, batch.num_rows, SHAPES):
                every = [clip.sides_of(rings) for rings in ring_lists(batch.column("rings").slice(begin, SHAPES))]
                sides, shape = np.concatenate(every), np.repeat(number[begin : begin + SHAPES], [len(x) for x in every])
                if of == "pieces":
                    p, own = cut_at_grid(sides, size)
                    at = np.floor((p[:, :2] + p[:, 2:]) / 2 / size).astype(np.int64)
                    columns = [at[:, 0], at[:, 1], shape[own], *p.T]
                    names = ["cx", "cy", "nth", "px", "py", "qx", "qy"]
                else:
                    v = spans(sides, size, np.repeat(np.arange(len(every)), [len(x) for x in every]))
                    x = (v[:, 0] + RX) * size
                    columns, names = [v[:, 0].astype(np.int64), number[begin + v[:, 3].astype(np.int64)], x, v[:, 1], x, v[:, 2]], ["column", "nth", "x1", "y1", "x2", "y2"]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=names)

    return run


def _inside_from(place: tuple[float, float], known: bool, m: np.ndarray, s_: np.ndarray) -> np.ndarray:
    """Whether a shape holds what lies just above the points m (right of those on upright pieces): known is whether it
    holds the place, and sides that the way from there, level and then upright, crosses turn that about."""
    out = np.full(len(m), known)
    if not len(s_):
        return out
    x0, y0 = place
    lo_y, hi_y = np.minimum(s_[:, 1], s_[:, 3]), np.maximum(s_[:, 1], s_[:, 3])
    across = (lo_y <= y0) & (y0 < hi_y)
    level = s_[across]
    at = level[:, 0] + (level[:, 2] - level[:, 0]) * ((y0 - level[:, 1]) / (level[:, 3] - level[:, 1]))
    right = m[:, 0] >= x0
    way = np.where(right[:, None], (at[None] > x0) & (at[None] <= m[:, :1]), (at[None] > m[:, :1]) & (at[None] <= x0))
    out ^= way.sum(axis=1) % 2 == 1
    slanted = s_[s_[:, 0] != s_[:, 2]]
    lo_x, hi_x = np.minimum(slanted[:, 0], slanted[:, 2]), np.maximum(slanted[:, 0], slanted[:, 2])
    slope = (slanted[:, 3] - slanted[:, 1]) / (slanted[:, 2] - slanted[:, 0])
    y = slanted[None, :, 1] + slope[None] * (m[:, :1] - slanted[None, :, 0])
    near = clip.ON * (1 + np.abs(slope[None]))
    over = (lo_x[None] <= m[:, :1]) & (m[:, :1] < hi_x[None])
    up = over & (((y > y0) & (y <= m[:, 1:] + near)) | ((y > m[:, 1:] + near) & (y <= y0)))
    return out ^ (up.sum(axis=1) % 2 == 1)


def outline(window: tuple[float, float, float], sides: list[np.ndarray], known: list[bool], most: int = CELL_SIDES, depth: int = 0) -> np.ndarray:
    """The pieces of a cell (x, y and edge) that have the union of shapes on their left and not on their right, so turned.
    sides: of each shape, cut to the cell; known: whether it holds the cell's place."""
    x, y, edge = window
    place = (x + RX * edge, y + RY * edge)
    if sum(map(len, sides)) > most and depth < 6:
        half, out = edge / 2, []
        every, number = cut_at_grid(np.concatenate(sides) - [x, y, x, y], half)
        owner = np.repeat(np.arange(len(sides)), [len(p) for p in sides])[number]
        at = np.minimum(1, np.floor((every[:, :2] + every[:, 2:]) / 2 / half)).astype(np.int64)
        every += [x, y, x, y]
        for dx in (0, 1):
            for dy in (0, 1):
                there, here = (x + dx * half, y + dy * half, half), (at[:, 0] == dx) & (at[:, 1] == dy)
                goal = np.array([[there[0] + RX * half, there[1] + RY * half]])
                told = [bool(_inside_from(place, k, goal, one)[0]) for one, k in zip(sides, known)]
                met = np.unique(owner[here])
                if not np.delete(told, met).any():  # else a shape fills it
                    out.append(outline(there, [every[here & (owner == k)] for k in met], [told[k] for k in met], most, depth + 1))
        return np.concatenate(out) if out else np.zeros((0, 4))
    if not any(map(len, sides)):
        return np.zeros((0, 4))
    cut, number = clip.pieces_of(np.concatenate(sides))
    pieces, at = np.unique(cut, axis=0, return_inverse=True)
    owner = np.repeat(np.arange(len(sides)), [len(x) for x in sides])[number]
    mid = (pieces[:, :2] + pieces[:, 2:]) / 2
    upright = pieces[:, 0] == pieces[:, 2]
    here, there = np.zeros(len(pieces), bool), np.zeros(len(pieces), bool)
    for k, (one, inside) in enumerate(zip(sides, known)):
        own = _inside_from(place, inside, mid, one)
        odd = np.bincount(at.reshape(-1)[owner == k], minlength=len(pieces)) % 2 == 1
        here |= own
        there |= own ^ odd
    return clip.boundary(pieces, np.where(upright, there, here), np.where(upright, here, there))


def chained(edges: np.ndarray, window: tuple[float, float, float]) -> list[np.ndarray]:
    """Edges strung together, from border to border of the cell or all around."""
    x, y, edge = window
    lines_x, lines_y = np.round([x, x + edge], clip.DIGITS), np.round([y, y + edge], clip.DIGITS)
    begin, end = [tuple(v) for v in edges[:, :2].tolist()], [tuple(v) for v in edges[:, 2:].tolist()]
    angle = np.arctan2(edges[:, 3] - edges[:, 1], edges[:, 2] - edges[:, 0])
    on_border = lambda v: v[0] in lines_x or v[1] in lines_y
    leaving: dict[tuple, list[int]] = {}
    for k, p in enumerate(begin):
        leaving.setdefault(p, []).append(k)
    free, out = [True] * len(edges), []
    for first in sorted(range(len(edges)), key=lambda k: not on_border(begin[k])):
        if not free[first]:
            continue
        places, k = [begin[first]], first
        while k is not None:
            free[k] = False
            places.append(end[k])
            if on_border(end[k]):
                break
            back = angle[k] + np.pi
            ways = [(-((angle[n] - back) % (2 * np.pi)), n) for n in leaving.get(end[k], ()) if free[n]]
            k = min(ways)[1] if ways else None
        out.append(np.array(places))
    return out


_CHAIN = f"closed boolean, sx double, sy double, ex double, ey double, leaving double, coming double, path {RINGS[6:-1]}"


def _edges(key: tuple, group: pa.Table, size: float) -> tuple[np.ndarray, tuple[float, float, float]]:
    """The outline's edges in a cell, and the cell."""
    cx, cy = (k.as_py() for k in key)
    nth = group.column("nth").to_numpy()
    v = np.stack([group.column(k).to_numpy() for k in ("px", "py", "qx", "qy")], axis=1)
    covers = np.isnan(v[:, 0])
    held = set(nth[covers].tolist())
    shapes = np.unique(nth[~covers])
    window = (cx * size, cy * size, size)
    if held - set(shapes.tolist()):  # a shape without sides here fills the cell
        return np.zeros((0, 4)), window
    return outline(window, [v[~covers & (nth == k)] for k in shapes], [k in held for k in shapes.tolist()]), window


def _of_cell(size: float):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        edges, window = _edges(key, group, size)
        chains = chained(edges, window) if len(edges) else []
        way = lambda a, b: float(np.arctan2(b[1] - a[1], b[0] - a[0]))
        first, last = [x[0] for x in chains], [x[-1] for x in chains]
        columns = [[bool((a == b).all()) for a, b in zip(first, last)], *([float(x[k]) for x in e] for e in (first, last) for k in (0, 1)), [way(x[0], x[1]) for x in chains], [way(x[-1], x[-2]) for x in chains]]
        paths = as_rings([[x] for x in chains]).flatten() if chains else pa.array([], pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
        return pa.table([pa.array(columns[0], pa.bool_()), *(pa.array(x, pa.float64()) for x in columns[1:]), paths], names=["closed", "sx", "sy", "ex", "ey", "leaving", "coming", "path"])

    return run


def _totals_of_cell(size: float):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        v, _ = _edges(key, group, size)
        area, length = (v[:, 0] * v[:, 3] - v[:, 2] * v[:, 1]).sum() / 2, np.hypot(v[:, 2] - v[:, 0], v[:, 3] - v[:, 1]).sum()
        return pa.table({"area": pa.array([float(area)]), "length": pa.array([float(length)])})

    return run


def _by_cell(layer: DataFrame, size: float | None, coarser: int = 1):
    """The sides of a layer by the cells that they run through, with the shapes that hold a cell's place, and the cell's edge."""
    shapes = s.polygons(layer.select("rings", F.monotonically_increasing_id().alias("fid"))).select(c("fid").alias("nth"), c("rings").cast(RINGS).alias("rings"), *s.BOX)
    size = size or coarser * r.grid(shapes, shapes)[0]
    own = shapes.select("nth", "rings")
    pieces, _ = kept(own.mapInArrow(_rows(size, "pieces"), "cx long, cy long, nth long, px double, py double, qx double, qy double"))
    cells = pieces.select(c("cx").alias("kx"), c("cy").alias("ky")).distinct().withColumns({"x": (c("kx") + RX) * size, "y": (c("ky") + RY) * size})
    along = own.mapInArrow(_rows(size, "spans"), "column long, nth long, x1 double, y1 double, x2 double, y2 double")
    covers = r.box_join(r.as_boxes(cells), along, size=size, condition=c("a.kx") == c("b.column")).select(c("a.kx").alias("cx"), c("a.ky").alias("cy"), c("b.nth").alias("nth"), *[F.lit(float("nan")).alias(k) for k in ("px", "py", "qx", "qy")])
    tasks = int(layer.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # cells are small for the time that each takes
    return pieces.unionByName(covers).repartition(tasks, "cx", "cy").groupBy("cx", "cy"), size


def chains(layer: DataFrame, size: float | None = None) -> DataFrame:
    """The outline of the union of a layer of polygons (rings) in pieces, each within one cell: closed (a ring by itself),
    its ends, the directions in which it leaves and is come to, and path. The union lies on the left."""
    rows, size = _by_cell(layer, size)
    return rows.applyInArrow(_of_cell(size), _CHAIN)


def cycles(links: DataFrame) -> DataFrame:
    """id, ring, place: for links (id, next) that are cycles, the smallest id of each and a number that grows from it
    along the cycle; by pointer jumping. Links that lead to nothing have no row."""
    state, told = kept(links.select("id", c("next").alias("to"), F.least("id", "next").alias("ring")), n=F.count(F.lit(1)))
    moved = told["n"]
    while moved:
        on = state.select(c("id").alias("_id"), c("to").alias("_to"), c("ring").alias("_ring"))
        state = state.join(on, c("to") == c("_id")).select("id", c("_to").alias("to"), F.least("ring", "_ring").alias("ring"), (c("_ring") < c("ring")).alias("moved"))
        state, told = kept(state, moved=F.count_if("moved"))
        state, moved = state.drop("moved"), told["moved"]
    left = links.join(state.select(c("id").alias("_id"), "ring"), c("id") == c("_id")).select("id", "ring", F.when(c("next") != c("ring"), c("next")).alias("to"), F.lit(1).cast("long").alias("steps"))
    left, told = kept(left, open=F.count("to"))
    while told["open"]:
        on = left.select(c("id").alias("_id"), c("to").alias("_to"), c("steps").alias("_steps"))
        left = left.join(on, c("to") == c("_id"), "left").select("id", "ring", c("_to").alias("to"), (c("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"))
        left, told = kept(left, open=F.count("to"))
    return left.select("id", "ring", (-c("steps")).alias("place"))


def outline_chains(layer: DataFrame, size: float | None = None) -> DataFrame:
    """ring, place, path: the outline's chains, each with the ring that it belongs to and its order there."""
    every, _ = kept(chains(layer, size).withColumn("id", F.monotonically_increasing_id()))
    whole = every.filter("closed").select(c("id").alias("ring"), F.lit(0).cast("long").alias("place"), "path")
    open_ = every.filter("NOT closed")
    after = open_.select(c("id").alias("next"), c("sx").alias("_x"), c("sy").alias("_y"), "leaving")
    turn = F.pmod(c("leaving") - c("coming"), F.lit(2 * np.pi))
    links = open_.select("id", "ex", "ey", "coming").join(after, (c("ex") == c("_x")) & (c("ey") == c("_y"))).groupBy("id").agg(F.max_by("next", turn).alias("next"))
    links, _ = kept(links)
    found = cycles(links).withColumnRenamed("id", "_id")
    return whole.unionByName(open_.join(found, c("id") == c("_id")).select("ring", "place", "path"))


_RING = f"nth int, area double, x1 double, y1 double, x2 double, y2 double, path {RINGS[6:-1]}"


def _simple(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rings that may touch themselves to simple ones."""
    for batch in batches:
        rows = [x for ring in ring_lists(batch.column("paths")) for x in enumerate(map(clip.straightened, clip.loops(np.concatenate([np.hstack([p[:-1], p[1:]]) for p in ring]))))]
        boxes = [(*v.min(axis=0).tolist(), *v.max(axis=0).tolist()) for _, v in rows]
        columns = [pa.array([n for n, _ in rows], pa.int32()), pa.array([clip.signed_area(v) for _, v in rows], pa.float64()), *(pa.array([b[k] for b in boxes], pa.float64()) for k in range(4)), as_rings([[v] for _, v in rows]).flatten()]
        yield pa.RecordBatch.from_arrays(columns, names=["nth", "area", "x1", "y1", "x2", "y2", "path"])


def rings(layer: DataFrame, size: float | None = None) -> DataFrame:
    """id, area, x1, y1, x2, y2, path: the simple closed rings of a layer's union; shells run against the clock and have a
    positive area, holes a negative one. A ring is one row, however many cells it crosses.

    layer has rings (closed vertex arrays, even-odd). Null and empty geometry is left out, shapes that share only a side
    become one, shapes that touch in a point stay apart; an empty layer has no ring. Places are rounded to nine digits.
    """
    found = outline_chains(layer, size).groupBy("ring").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "path"))), lambda x: x["path"]).alias("paths"))
    made, _ = kept(found.select("paths").mapInArrow(_simple, _RING).select(F.monotonically_increasing_id().alias("id"), "area", *s.BOX, "path"))
    return made


def _holding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hole, shell = (ring_lists(batch.column(k)) for k in ("hole", "shell"))
        ok = pa.array([clip._within(h[0], x[0]) for h, x in zip(hole, shell)], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("id").filter(ok), batch.column("home").filter(ok), batch.column("area").filter(ok)], names=["id", "home", "area"])


def dissolved(layer: DataFrame, size: float | None = None) -> DataFrame:
    """fid, area, rings: the polygons of a layer's union, each shell with its holes; fid is a number of no meaning."""
    every = rings(layer, size)
    shells, holes = every.filter("area > 0"), every.filter("area < 0")
    pairs = r.box_join(holes, shells, condition=c("b.area") >= -c("a.area") - 1e-9)
    held = pairs.select(c("a.id").alias("id"), c("b.id").alias("home"), c("b.area").alias("area"), F.array("a.path").alias("hole"), F.array("b.path").alias("shell")).mapInArrow(_holding, "id long, home long, area double")
    home = held.groupBy("id").agg(F.min_by("home", F.struct("area", "home")).alias("home"))
    own = holes.join(home.withColumnRenamed("id", "_id"), c("id") == c("_id")).groupBy("home").agg(F.sum("area").alias("less"), F.array_sort(F.collect_list("path")).alias("holes"))
    joined = shells.join(own, c("id") == c("home"), "left")
    return joined.select(c("id").alias("fid"), (c("area") + F.coalesce("less", F.lit(0.0))).alias("area"), F.concat(F.array("path"), F.coalesce("holes", F.expr(f"cast(array() as {RINGS})"))).alias("rings"))


def outline_totals(layer: DataFrame, size: float | None = None) -> DataFrame:
    """area, length: of the union of a layer, from the outline's edges in each cell; none are put together."""
    rows, size = _by_cell(layer, size, 2)
    parts = rows.applyInArrow(_totals_of_cell(size), "area double, length double")
    return parts.agg(*[F.coalesce(F.sum(k), F.lit(0.0)).alias(k) for k in ("area", "length")])


def gaps(layer: DataFrame, tolerance: float = 0) -> DataFrame:
    """measure: one row where the box of all polygons (two at least) has more than the tolerance that none covers."""
    box = s.polygons(layer).agg(F.count(F.lit(1)).alias("n"), *[f(k).alias(k) for k, f in zip(s.BOX, (F.min, F.min, F.max, F.max))])
    both = box.unionByName(outline_totals(layer).select("area"), allowMissingColumns=True)
    both = both.agg(*[F.max(k).alias(k) for k in ("n", *s.BOX, "area")])
    return both.filter("n > 1").select(((c("x2") - c("x1")) * (c("y2") - c("y1")) - c("area")).alias("measure")).filter(c("measure") > tolerance)
