"""Projected coordinate systems by parameters: transverse Mercator, Lambert conic, Lambert equal-area, and shifts of datum.

A system is an ellipsoid, a projection with its parameters, and the seven
parameters that carry its datum to WGS84.  The steps of a way work on columns
and on numpy arrays alike; between steps, columns are the fields of a struct
that each step names anew, so an expression does not hold its parts twice.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Equatorial radius and inverse flattening of ellipsoids.
ELLIPSOIDS = {"wgs84": (6_378_137.0, 298.257223563), "grs80": (6_378_137.0, 298.257222101), "airy": (6_377_563.396, 299.3249646), "bessel": (6_377_397.155, 299.1528128)}
#: Metres, seconds of arc and parts per million of shifts to WGS84, by position vectors.
SHIFTS = {"osgb36": (446.448, -125.157, 542.06, 0.1502, 0.247, 0.8421, -20.4894), "dhdn": (598.1, 73.7, 418.2, 0.202, 0.045, -2.455, 6.7)}


@dataclass(frozen=True)
class System:
    ellipsoid: str
    projection: str
    lat: float
    lon: float
    east: float
    north: float
    scale: float = 1.0
    parallels: tuple[float, float] = (0.0, 0.0)
    shift: str | None = None


#: Projected systems by EPSG code; the zones of UTM follow from a rule.
NAMED = {
    27700: System("airy", "tm", 49, -2, 400_000, -100_000, 0.9996012717, shift="osgb36"),
    2154: System("grs80", "conic", 46.5, 3, 700_000, 6_600_000, parallels=(49, 44)),
    3035: System("grs80", "equal-area", 52, 10, 4_321_000, 3_210_000),
    31466: System("bessel", "tm", 0, 6, 2_500_000, 0, shift="dhdn"),
    31467: System("bessel", "tm", 0, 9, 3_500_000, 0, shift="dhdn"),
    31468: System("bessel", "tm", 0, 12, 4_500_000, 0, shift="dhdn"),
}
#: Longitude and latitude on GRS80, which differs from WGS84 by less than a metre.
GEOGRAPHIC = (4258,)


def system(code: int) -> System | None:
    """The projected system of an EPSG code: a named one, or a zone of UTM on WGS84 or ETRS89."""
    if code in NAMED:
        return NAMED[code]
    for first, zones, ellipsoid, north in ((32_600, range(1, 61), "wgs84", 0), (32_700, range(1, 61), "wgs84", 10_000_000), (25_800, range(28, 39), "grs80", 0)):
        if code - first in zones:
            return System(ellipsoid, "tm", 0, 6 * (code - first) - 183, 500_000, north, 0.9996)
    return None


class _Arrays:
    sin, cos, tan, sinh, cosh, tanh = np.sin, np.cos, np.tan, np.sinh, np.cosh, np.tanh
    asin, atan2, asinh, atanh = np.arcsin, np.arctan2, np.arcsinh, np.arctanh
    exp, log, sqrt, most = np.exp, np.log, np.sqrt, np.maximum


class _Columns:
    sin, cos, tan, sinh, cosh, tanh = F.sin, F.cos, F.tan, F.sinh, F.cosh, F.tanh
    asin, atan2, asinh, atanh = F.asin, F.atan2, F.asinh, F.atanh
    exp, log, sqrt = F.exp, F.log, F.sqrt

    @staticmethod
    def most(a: Column, b: float) -> Column:
        return F.greatest(a, F.lit(b))


Step = Callable[[type, dict], dict]


def _isometric(lat: float, e: float) -> float:
    return math.asinh(math.tan(lat)) - e * math.atanh(e * math.sin(lat))


def _shape(s: System) -> tuple[float, float, float]:
    """Equatorial radius, eccentricity and third flattening."""
    a, inverse = ELLIPSOIDS[s.ellipsoid]
    f = 1 / inverse
    return a, math.sqrt(f * (2 - f)), f / (2 - f)


def _latitude(e: float) -> list[Step]:
    """From an isometric latitude ``psi`` to ``lat``, by fixed-point steps that gain two digits each."""

    def begin(m, v):
        return v | {"s": m.tanh(v["psi"])}

    def go(m, v):
        return v | {"s": m.tanh(v["psi"] + e * m.atanh(e * v["s"]))}

    def end(m, v):
        return {"lon": v["lon"], "lat": m.asin(v["s"])}

    return [begin, *[go] * 7, end]


def _isometrically(e: float) -> Step:
    return lambda m, v: {"lon": v["lon"], "psi": m.asinh(m.tan(v["lat"])) - e * m.atanh(e * m.sin(v["lat"]))}


def _transverse(s: System) -> tuple[list[Step], list[Step]]:
    a, e, n = _shape(s)
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64) * s.scale
    there = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280)
    back = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280)
    begin = math.atan(math.sinh(_isometric(math.radians(s.lat), e)))
    first = begin + sum(c * math.sin(2 * k * begin) for k, c in enumerate(there, 1))
    lon0 = math.radians(s.lon)

    def sphere(m, v):
        t = m.sinh(v["psi"])
        return {"u": m.atan2(t, m.cos(v["lon"] - lon0)), "w": m.atanh(m.sin(v["lon"] - lon0) / m.cosh(v["psi"]))}

    def series(m, v, terms, sign):
        u = sum((c * m.sin(v["u"] * (2 * k)) * m.cosh(v["w"] * (2 * k)) for k, c in enumerate(terms, 1)), v["u"] * 0)
        w = sum((c * m.cos(v["u"] * (2 * k)) * m.sinh(v["w"] * (2 * k)) for k, c in enumerate(terms, 1)), v["w"] * 0)
        return {"u": v["u"] + u * sign, "w": v["w"] + w * sign}

    def plane(m, v):
        return {"x": v["w"] * radius + s.east, "y": (v["u"] - first) * radius + s.north}

    def unplane(m, v):
        return {"u": (v["y"] - s.north) / radius + first, "w": (v["x"] - s.east) / radius}

    def unsphere(m, v):
        wide = m.sinh(v["w"])
        return {"lon": m.atan2(wide, m.cos(v["u"])) + lon0, "psi": m.asinh(m.sin(v["u"]) / m.sqrt(wide * wide + m.cos(v["u"]) * m.cos(v["u"])))}

    to = [_isometrically(e), sphere, lambda m, v: series(m, v, there, 1), plane]
    return to, [unplane, lambda m, v: series(m, v, back, -1), unsphere, *_latitude(e)]


def _conic(s: System) -> tuple[list[Step], list[Step]]:
    a, e, _ = _shape(s)
    wide = lambda lat: math.cos(lat) / math.sqrt(1 - (e * math.sin(lat)) ** 2)
    one, two = (math.radians(p) for p in s.parallels)
    cone = (math.log(wide(one)) - math.log(wide(two))) / (_isometric(two, e) - _isometric(one, e))
    size = a * wide(one) / cone * math.exp(cone * _isometric(one, e))
    origin, lon0 = size * math.exp(-cone * _isometric(math.radians(s.lat), e)), math.radians(s.lon)

    def turned(m, v):
        return {"r": m.exp(v["psi"] * -cone) * size, "t": (v["lon"] - lon0) * cone}

    def plane(m, v):
        return {"x": v["r"] * m.sin(v["t"]) + s.east, "y": v["r"] * m.cos(v["t"]) * -1 + (s.north + origin)}

    def unplane(m, v):
        return {"dx": v["x"] - s.east, "dy": v["y"] * -1 + (s.north + origin)}

    def unturned(m, v):
        return {"lon": m.atan2(v["dx"], v["dy"]) / cone + lon0, "psi": m.log(m.sqrt(v["dx"] * v["dx"] + v["dy"] * v["dy"]) / size) / -cone}

    return [_isometrically(e), turned, plane], [unplane, unturned, *_latitude(e)]


def _equal_area(s: System) -> tuple[list[Step], list[Step]]:
    a, e, _ = _shape(s)
    lat0, lon0 = math.radians(s.lat), math.radians(s.lon)
    area = lambda sine: (1 - e * e) * (sine / (1 - (e * sine) ** 2) + math.atanh(e * sine) / e)
    pole = area(1.0)
    begin, radius = math.asin(area(math.sin(lat0)) / pole), a * math.sqrt(pole / 2)
    ratio = a * math.cos(lat0) / math.sqrt(1 - (e * math.sin(lat0)) ** 2) / (radius * math.cos(begin))
    sin0, cos0 = math.sin(begin), math.cos(begin)

    def authalic(m, v):
        sine = m.sin(v["lat"])
        return {"b": m.asin((sine / (sine * sine * (-e * e) + 1) + m.atanh(sine * e) / e) * ((1 - e * e) / pole)), "l": v["lon"] - lon0}

    def away(m, v):
        return v | {"d": m.sqrt((m.sin(v["b"]) * sin0 + m.cos(v["b"]) * m.cos(v["l"]) * cos0 + 1) / 2)}

    def plane(m, v):
        x = m.cos(v["b"]) * m.sin(v["l"]) / v["d"] * (radius * ratio) + s.east
        return {"x": x, "y": (m.sin(v["b"]) * cos0 - m.cos(v["b"]) * m.cos(v["l"]) * sin0) / v["d"] * (radius / ratio) + s.north}

    def unplane(m, v):
        return {"dx": (v["x"] - s.east) / ratio, "dy": (v["y"] - s.north) * ratio}

    def unaway(m, v):
        r = m.most(m.sqrt(v["dx"] * v["dx"] + v["dy"] * v["dy"]), 1e-9)
        return v | {"r": r, "c": m.asin(r / (2 * radius)) * 2}

    def sphere(m, v):
        b = m.asin(m.cos(v["c"]) * sin0 + v["dy"] * m.sin(v["c"]) * cos0 / v["r"])
        return {"b": b, "lon": m.atan2(v["dx"] * m.sin(v["c"]), v["r"] * m.cos(v["c"]) * cos0 - v["dy"] * m.sin(v["c"]) * sin0) + lon0}

    def geodetic(m, v):
        q, b = e * e, v["b"]
        return {"lon": v["lon"], "lat": b + m.sin(b * 2) * (q / 3 + 31 * q**2 / 180 + 517 * q**3 / 5040) + m.sin(b * 4) * (23 * q**2 / 360 + 251 * q**3 / 3780) + m.sin(b * 6) * (761 * q**3 / 45360)}

    return [authalic, away, plane], [unplane, unaway, sphere, geodetic]


def _shifted(shift: tuple[float, ...], source: str, target: str) -> list[Step]:
    """Latitude and longitude of a point on an ellipsoid, on another one by a shift of the axes."""
    tx, ty, tz, rx, ry, rz = (*shift[:3], *(math.radians(x / 3600) for x in shift[3:6]))
    grown = 1 + shift[6] / 1e6
    (a, inverse), (a2, inverse2) = ELLIPSOIDS[source], ELLIPSOIDS[target]
    q, q2 = (1 / i * (2 - 1 / i) for i in (inverse, inverse2))
    b2 = a2 * (1 - 1 / inverse2)

    def normal(m, v):
        sine = m.sin(v["lat"])
        return v | {"n": a / m.sqrt(sine * sine * -q + 1)}

    def axes(m, v):
        flat = v["n"] * m.cos(v["lat"])
        return {"X": flat * m.cos(v["lon"]), "Y": flat * m.sin(v["lon"]), "Z": v["n"] * m.sin(v["lat"]) * (1 - q)}

    def moved(m, v):
        return {"X": (v["X"] - v["Y"] * rz + v["Z"] * ry) * grown + tx, "Y": (v["X"] * rz + v["Y"] - v["Z"] * rx) * grown + ty, "Z": (v["Y"] * rx - v["X"] * ry + v["Z"]) * grown + tz}

    def flat(m, v):
        p = m.sqrt(v["X"] * v["X"] + v["Y"] * v["Y"])
        return {"lon": m.atan2(v["Y"], v["X"]), "Z": v["Z"], "p": p, "t": m.atan2(v["Z"] * a2, p * b2)}

    def geodetic(m, v):
        sine, cosine = m.sin(v["t"]), m.cos(v["t"])
        return {"lon": v["lon"], "lat": m.atan2(v["Z"] + sine * sine * sine * (q2 / (1 - q2) * b2), v["p"] - cosine * cosine * cosine * (q2 * a2))}

    return [normal, axes, moved, flat, geodetic]


_KINDS = {"tm": _transverse, "conic": _conic, "equal-area": _equal_area}


def _degrees(m, v: dict) -> dict:
    return {"x": v["lon"] * (180 / math.pi), "y": v["lat"] * (180 / math.pi)}


def _radians(m, v: dict) -> dict:
    return {"lon": v["x"] * (math.pi / 180), "lat": v["y"] * (math.pi / 180)}


@lru_cache(maxsize=256)
def ways(s: System) -> tuple[tuple[Step, ...], tuple[Step, ...]]:
    """The steps from WGS84 degrees to a system's metres, and back."""
    to, back = _KINDS[s.projection](s)
    there, here = [], []
    if s.shift:
        shift = SHIFTS[s.shift]
        here = _shifted(shift, s.ellipsoid, "wgs84")
        there = _shifted(tuple(-x for x in shift), "wgs84", s.ellipsoid)
    return (_radians, *there, *to), (*back, *here, _degrees)


def run(steps: tuple[Step, ...], x, y):
    """Coordinates after all steps: columns or arrays, as they came."""
    if not isinstance(x, Column):
        v = {"x": np.asarray(x, float), "y": np.asarray(y, float)}
        for step in steps:
            v = step(_Arrays, v)
        return v["x"], v["y"]
    held, names = F.array(F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))), ["x", "y"]
    for step in steps:
        made: dict = {}
        held = F.transform(held, _field_by_field(step, names, made))
        names = list(made)
    return held[0]["x"], held[0]["y"]


def _field_by_field(step: Step, names: list[str], made: dict) -> Callable[[Column], Column]:
    """A step as a function of a struct; ``made`` gets the names of its fields."""

    def one(s: Column) -> Column:
        made.update(step(_Columns, {k: s[k] for k in names}))
        return F.struct(*(c.alias(k) for k, c in made.items()))

    return one
