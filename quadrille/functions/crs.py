"""Coordinate reference systems: transverse Mercator both ways, web Mercator and shifts of datum, as column expressions.

A system is degrees on an ellipsoid, or metres projected from it. Between two systems coordinates go to degrees, where
the datums differ over geocentric coordinates (seven parameters, position vector), and from degrees. Transverse
Mercator is the series of Krueger to the sixth power of the third flattening: a few nanometres within some degrees of
the axis, and under a millimetre further out than any zone.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions.overlay import bound

# fixed values: coefficients of the series by power of the third flattening, as published (Karney 2011)
FORWARD = (
    (1 / 2, -2 / 3, 5 / 16, 41 / 180, -127 / 288, 7891 / 37800),
    (0, 13 / 48, -3 / 5, 557 / 1440, 281 / 630, -1983433 / 1935360),
    (0, 0, 61 / 240, -103 / 140, 15061 / 26880, 167603 / 181440),
    (0, 0, 0, 49561 / 161280, -179 / 168, 6601661 / 7257600),
    (0, 0, 0, 0, 34729 / 80640, -3418889 / 1995840),
    (0, 0, 0, 0, 0, 212378941 / 319334400),
)
BACKWARD = (
    (1 / 2, -2 / 3, 37 / 96, -1 / 360, -81 / 512, 96199 / 604800),
    (0, 1 / 48, 1 / 15, -437 / 1440, 46 / 105, -1118711 / 3870720),
    (0, 0, 17 / 480, -37 / 840, -209 / 4480, 5569 / 90720),
    (0, 0, 0, 4397 / 161280, -11 / 504, -830251 / 7257600),
    (0, 0, 0, 0, 4583 / 161280, -108847 / 3991680),
    (0, 0, 0, 0, 0, 20648693 / 638668800),
)


@dataclass(frozen=True)
class Crs:
    """kind: 'degrees', 'tm' or 'web'. shift: to the common datum, metres, arc seconds and parts of a million."""

    kind: str = "degrees"
    a: float = 6378137.0
    inverse_flattening: float = 298.257222101
    lat0: float = 0.0
    lon0: float = 0.0
    k0: float = 1.0
    east: float = 0.0
    north: float = 0.0
    shift: tuple[float, ...] = (0.0,) * 7

    @property
    def f(self) -> float:
        return 1 / self.inverse_flattening

    @property
    def e2(self) -> float:
        return self.f * (2 - self.f)

    def series(self, table: tuple) -> list[float]:
        n = self.f / (2 - self.f)
        return [sum(c * n**k for k, c in enumerate(row, 1)) for row in table]

    @property
    def radius(self) -> float:
        """Of the circle whose arc is as long as the meridian's."""
        n = self.f / (2 - self.f)
        return self.a / (1 + n) * (1 + n**2 / 4 + n**4 / 64 + n**6 / 256)

    @property
    def rise(self) -> float:
        """The arc up to lat0, on that circle."""
        e, tau = math.sqrt(self.e2), math.tan(math.radians(self.lat0))
        sigma = math.sinh(e * math.atanh(e * tau / math.hypot(1, tau)))
        xi = math.atan(tau * math.hypot(1, sigma) - sigma * math.hypot(1, tau))
        return xi + sum(c * math.sin(2 * j * xi) for j, c in enumerate(self.series(FORWARD), 1))


_BESSEL = {"a": 6377397.155, "inverse_flattening": 299.1528128, "shift": (-115.80, 474.99, 674.11, 1.16, -2.31, -1.63, 6.43)}
# fixed values: parameters of systems by their public number
SYSTEMS = {
    4326: Crs(inverse_flattening=298.257223563),
    4737: Crs(),
    3857: Crs("web", inverse_flattening=298.257223563),
    5179: Crs("tm", lat0=38, lon0=127.5, k0=0.9996, east=1_000_000, north=2_000_000),
    5185: Crs("tm", lat0=38, lon0=125, east=200_000, north=600_000),
    5186: Crs("tm", lat0=38, lon0=127, east=200_000, north=600_000),
    5187: Crs("tm", lat0=38, lon0=129, east=200_000, north=600_000),
    5188: Crs("tm", lat0=38, lon0=131, east=200_000, north=600_000),
    5174: Crs("tm", lat0=38, lon0=127.0028902777778, east=200_000, north=500_000, **_BESSEL),
    5178: Crs("tm", lat0=38, lon0=127.5, k0=0.9996, east=1_000_000, north=2_000_000, **_BESSEL),
    27700: Crs("tm", 6377563.396, 299.3249646, 49, -2, 0.9996012717, 400_000, -100_000, (446.448, -125.157, 542.060, 0.1502, 0.2470, 0.8421, -20.4894)),
    **{32600 + z: Crs("tm", inverse_flattening=298.257223563, lon0=6 * z - 183, k0=0.9996, east=500_000) for z in range(1, 61)},
    **{32700 + z: Crs("tm", inverse_flattening=298.257223563, lon0=6 * z - 183, k0=0.9996, east=500_000, north=10_000_000) for z in range(1, 61)},
}


def _struct(**columns: Column) -> Column:
    return F.struct(*[v.alias(k) for k, v in columns.items()])


def _root(x: Column) -> Column:
    return F.sqrt(1 + x * x)


def _conformal(tau: Column, e: float) -> Column:
    """The tangent of the conformal latitude."""
    return bound(F.sinh(e * F.atanh(e * tau / _root(tau))), lambda s: tau * _root(s) - s * _root(tau))


def _waves(v: Column, coefficients: list[float], sign: int) -> Column:
    xi, eta = v["xi"], v["eta"]
    for j, k in enumerate(coefficients, 1):
        xi = xi + sign * k * F.sin(2 * j * v["xi"]) * F.cosh(2 * j * v["eta"])
        eta = eta + sign * k * F.cos(2 * j * v["xi"]) * F.sinh(2 * j * v["eta"])
    return _struct(xi=xi, eta=eta)


def _tm_forward(v: Column, crs: Crs) -> Column:
    """Radians x, y from the axis to metres."""
    e = math.sqrt(crs.e2)

    def placed(t):
        start = _struct(xi=F.atan2(t["t"], F.cos(t["l"])), eta=F.asinh(F.sin(t["l"]) / F.sqrt(t["t"] * t["t"] + F.cos(t["l"]) * F.cos(t["l"]))))
        ended = bound(start, lambda s: _waves(s, crs.series(FORWARD), 1))
        return bound(ended, lambda w: _struct(x=crs.east + crs.k0 * crs.radius * w["eta"], y=crs.north + crs.k0 * crs.radius * (w["xi"] - crs.rise)))

    known = bound(F.tan(v["y"]), lambda tau: _struct(t=_conformal(tau, e), l=v["x"] - math.radians(crs.lon0)))
    return bound(known, placed)


def _tm_backward(v: Column, crs: Crs) -> Column:
    e = math.sqrt(crs.e2)

    def placed(w):
        goal = F.sin(w["xi"]) / F.sqrt(F.sinh(w["eta"]) * F.sinh(w["eta"]) + F.cos(w["xi"]) * F.cos(w["xi"]))

        def closer(tau, goal):
            step = lambda t: (goal - t) / _root(t) * (1 + (1 - crs.e2) * tau * tau) / ((1 - crs.e2) * _root(tau))
            return tau + bound(_conformal(tau, e), step)

        def latitude(goal):
            tau = goal / (1 - crs.e2)
            for _ in range(4):  # doubles its digits each time
                tau = bound(tau, lambda t: closer(t, goal))
            return F.atan(tau)

        return _struct(x=math.radians(crs.lon0) + F.atan2(F.sinh(w["eta"]), F.cos(w["xi"])), y=bound(goal, latitude))

    start = _struct(xi=(v["y"] - crs.north) / (crs.k0 * crs.radius) + crs.rise, eta=(v["x"] - crs.east) / (crs.k0 * crs.radius))
    return bound(bound(start, lambda s: _waves(s, crs.series(BACKWARD), -1)), placed)


def to_degrees(v: Column, crs: Crs) -> Column:
    """x (longitude) and y (latitude) in degrees on the system's own ellipsoid, of a struct x, y."""
    turned = lambda r: _struct(x=F.degrees(r["x"]), y=F.degrees(r["y"]))
    if crs.kind == "tm":
        return bound(_tm_backward(v, crs), turned)
    if crs.kind == "web":
        return turned(_struct(x=v["x"] / crs.a, y=F.atan(F.sinh(v["y"] / crs.a))))
    return _struct(x=v["x"].cast("double"), y=v["y"].cast("double"))


def from_degrees(v: Column, crs: Crs) -> Column:
    radians = _struct(x=F.radians(v["x"]), y=F.radians(v["y"]))
    if crs.kind == "tm":
        return bound(radians, lambda r: _tm_forward(r, crs))
    if crs.kind == "web":
        return bound(radians, lambda r: _struct(x=crs.a * r["x"], y=crs.a * F.asinh(F.tan(r["y"]))))
    return _struct(x=v["x"], y=v["y"])


def geocentric(v: Column, crs: Crs) -> Column:
    """X, Y, Z of degrees on the ellipsoid, at height 0."""

    def of(r):
        across = crs.a / F.sqrt(1 - crs.e2 * F.sin(r["y"]) * F.sin(r["y"]))
        return bound(across, lambda n: _struct(x=n * F.cos(r["y"]) * F.cos(r["x"]), y=n * F.cos(r["y"]) * F.sin(r["x"]), z=n * (1 - crs.e2) * F.sin(r["y"])))

    return bound(_struct(x=F.radians(v["x"]), y=F.radians(v["y"])), of)


def geodetic(v: Column, crs: Crs) -> Column:
    """Degrees of X, Y, Z; the height is left out."""
    b = crs.a * (1 - crs.f)
    second = crs.e2 / (1 - crs.e2)

    def of(p):
        # the reduced latitude, made closer twice
        beta = F.atan2(v["z"] * (1 + second * b / F.sqrt(p * p + v["z"] * v["z"])), p * (1 - crs.f))
        lat = lambda beta: F.atan2(v["z"] + second * b * F.pow(F.sin(beta), 3), p - crs.e2 * crs.a * F.pow(F.cos(beta), 3))
        for _ in range(2):
            beta = bound(beta, lambda t: bound(lat(t), lambda y: F.atan2((1 - crs.f) * F.sin(y), F.cos(y))))
        return _struct(x=F.degrees(F.atan2(v["y"], v["x"])), y=F.degrees(bound(beta, lat)))

    return bound(F.sqrt(v["x"] * v["x"] + v["y"] * v["y"]), of)


def shifted(v: Column, by: tuple[float, ...]) -> Column:
    """X, Y, Z moved, turned and scaled by seven parameters."""
    (rx, ry, rz), scale = (k * math.pi / 648_000 for k in by[3:6]), 1 + by[6] * 1e-6
    rows = ((1, -rz, ry), (rz, 1, -rx), (-ry, rx, 1))
    return _struct(**{k: sum((scale * c * v[n] for c, n in zip(row, "xyz")), F.lit(float(m))) for k, row, m in zip("xyz", rows, by)})


_COMMON = Crs(inverse_flattening=298.257223563)


def _to_common(v: Column, crs: Crs) -> Column:
    """Degrees on a system's datum as degrees on the common one."""
    return v if not any(crs.shift) else bound(bound(geocentric(v, crs), lambda g: shifted(g, crs.shift)), lambda g: geodetic(g, _COMMON))


def _from_common(v: Column, crs: Crs) -> Column:
    """The degrees whose _to_common is v. Heights are left out either way, so the way back is found by closing in."""
    if not any(crs.shift):
        return v
    found = v
    for _ in range(3):  # each is some 10,000 times closer
        found = bound(found, lambda d: bound(_to_common(d, crs), lambda t: _struct(x=d["x"] + v["x"] - t["x"], y=d["y"] + v["y"] - t["y"])))
    return found


def transformed(v: Column, source: Crs, target: Crs) -> Column:
    """A vertex (struct x, y) of one system in another; null stays null."""
    if source == target:
        return _struct(x=v["x"].cast("double"), y=v["y"].cast("double"))
    at = to_degrees(v, source)
    if source.shift != target.shift:
        at = bound(bound(at, lambda d: _to_common(d, source)), lambda d: _from_common(d, target))
    return F.when(v["x"].isNotNull() & v["y"].isNotNull(), bound(at, lambda d: from_degrees(d, target)))


def system(number: int) -> Crs:
    """A system by its public number; ValueError for one that is not known."""
    if number not in SYSTEMS:
        raise ValueError(f"no coordinate reference system {number}")
    return SYSTEMS[number]


def transform_layer(layer: DataFrame, source: int, target: int) -> DataFrame:
    """layer with its geometry (x and y, path, rings: whichever it has) in another system, and the target's number as crs.
    Null geometry and null coordinates stay null; other columns stay as they are."""
    a, b = system(source), system(target)
    to = lambda v: transformed(v, a, b)
    out = {}
    if {"x", "y"} <= set(layer.columns):
        layer = layer.withColumn("_at", to(F.struct("x", "y")))
        out = {"x": F.col("_at.x"), "y": F.col("_at.y")}
    if "path" in layer.columns:
        out["path"] = F.transform("path", to)
    if "rings" in layer.columns:
        out["rings"] = F.transform("rings", lambda ring: F.transform(ring, to))
    return layer.withColumns(out | {"crs": F.lit(target)}).drop("_at")
