"""Geometry as text (WKT) and as bytes (WKB), to and from vertex arrays.

Text is read and written by column expressions. Bytes are read by a small Arrow helper, since Spark has no function that
reads a double from binary.
"""

from __future__ import annotations

import struct

from pyspark.sql import Column
from pyspark.sql import functions as F

VERTEX = "struct<x:double,y:double>"
PARTS = f"array<array<array<{VERTEX}>>>"


def wkt_kind(text: Column) -> Column:
    """POINT, LINESTRING, POLYGON or a MULTI kind of them; null for anything else."""
    kind = F.regexp_extract(F.upper(F.trim(text)), r"^(MULTI)?(POINT|LINESTRING|POLYGON)\b", 0)
    return F.when(kind != "", kind)


def _vertices(text: Column) -> Column:
    """The vertices of 'x y, x y, ...'; ordinates beyond x and y are left out."""

    def vertex(pair):
        own = F.split(F.trim(pair), r"\s+")
        return F.struct(F.get(own, F.lit(0)).try_cast("double").alias("x"), F.get(own, F.lit(1)).try_cast("double").alias("y"))

    return F.transform(F.split(text, ","), vertex)


def from_wkt(text: Column) -> Column:
    """parts of rings of vertices: a polygon is one part, a line or point one part of one ring. EMPTY has no part; text
    of another kind and null are null."""
    ring = r"\(\s*[^()]*\)"
    nested = F.upper(F.trim(text)).startswith("MULTIPOLYGON")
    whole = F.when(nested, F.regexp_extract_all(text, F.lit(rf"\(\s*({ring}(?:\s*,\s*{ring})*)\s*\)"), F.lit(1))).otherwise(F.array(text))
    rings = lambda part: F.transform(F.regexp_extract_all(part, F.lit(r"\(([^()]*)\)"), F.lit(1)), _vertices)
    parts = F.filter(F.transform(whole, rings), lambda part: F.size(part) > 0)
    return F.when(wkt_kind(text).isNotNull(), parts)


def rings_wkt(rings: Column) -> Column:
    """A polygon's rings as WKT; POLYGON EMPTY without one."""
    number = lambda v: F.regexp_replace(v.cast("string"), r"\.0$", "")
    vertex = lambda v: F.concat_ws(" ", number(v["x"]), number(v["y"]))
    ring = lambda own: F.concat(F.lit("("), F.array_join(F.transform(own, vertex), ", "), F.lit(")"))
    return F.when(F.size(rings) > 0, F.concat(F.lit("POLYGON ("), F.array_join(F.transform(rings, ring), ", "), F.lit(")"))).when(rings.isNotNull(), "POLYGON EMPTY")


def _read(raw: bytes, at: int = 0):
    """parts of one WKB geometry (of either byte order, with or without Z, M and SRID) and where it ends."""
    order = "<" if raw[at] == 1 else ">"
    (kind,) = struct.unpack_from(order + "I", raw, at + 1)
    at += 5 + (4 if kind & 0x20000000 else 0)
    size = 2 + bool(kind & 0x80000000) + bool(kind & 0x40000000) + {0: 0, 1: 1, 2: 1, 3: 2}[(kind & 0xFFFF) // 1000]
    kind = (kind & 0xFFFF) % 1000

    def vertices(at, n):
        flat = struct.unpack_from(f"{order}{n * size}d", raw, at)
        return [{"x": flat[k], "y": flat[k + 1]} for k in range(0, n * size, size)], at + 8 * n * size

    def counted(at):
        return struct.unpack_from(order + "I", raw, at)[0], at + 4

    if kind == 1:
        own, at = vertices(at, 1)
        return [[own]], at
    n, at = counted(at)
    if kind == 2:
        own, at = vertices(at, n)
        return ([[own]] if own else []), at
    if kind == 3:
        rings = []
        for _ in range(n):
            m, at = counted(at)
            own, at = vertices(at, m)
            rings.append(own)
        return ([rings] if rings else []), at
    if kind in (4, 5, 6):
        parts = []
        for _ in range(n):
            own, at = _read(raw, at)
            parts += own
        return parts, at
    raise ValueError(f"a geometry of kind {kind}")


def from_wkb(raw: Column) -> Column:
    """As from_wkt, from bytes; null and what cannot be read is null."""

    def parts(own: bytes | None):
        try:
            return None if own is None else _read(bytes(own))[0]
        except (struct.error, IndexError, KeyError, ValueError):
            return None

    return F.udf(parts, PARTS, useArrow=True)(raw)


def rings_wkb(rings: Column) -> Column:
    """A polygon's rings as WKB, little-endian."""

    def raw(own):
        if own is None:
            return None
        out = [struct.pack("<BII", 1, 3, len(own))]
        for ring in own:
            out.append(struct.pack(f"<I{2 * len(ring)}d", len(ring), *(v[k] for v in ring for k in "xy")))
        return b"".join(out)

    return F.udf(raw, "binary", useArrow=True)(rings)
