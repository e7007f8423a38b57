"""Column expressions on the sphere and in map projections; angles in degrees unless a name says otherwise."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS = 6371229.0


def unit_vector(lon: Column, lat: Column) -> tuple[Column, Column, Column]:
    """PRJ-XYZ."""
    a, b = F.radians(lon), F.radians(lat)
    return F.cos(b) * F.cos(a), F.cos(b) * F.sin(a), F.sin(b)


def dot(a, b) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a, b) -> tuple[Column, Column, Column]:
    """PRJ-CROSS."""
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def bounded(x: Column, low: float = -1.0, high: float = 1.0) -> Column:
    """Within low and high; null stays null, which greatest and least alone would skip."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def angle(a, b) -> Column:
    """PRJ-ANGLE: great-circle angle in radians; the scalar product is held within [-1, 1], so rounding gives no NaN."""
    return F.acos(bounded(dot(a, b)))


def wrapped(lon: Column) -> Column:
    """Degrees in (-180, 180]."""
    return F.lit(180.0) - F.pmod(F.lit(180.0) - lon, F.lit(360.0))


def bump(x: Column, y: Column, x0: float, x1: float, y0: float, y1: float) -> Column:
    """SRC-SYN-BUMP: a squared polynomial that vanishes at the border."""
    p = (x - x0) * (x1 - x) * (y - y0) * (y1 - y)
    return p * p / ((x1 - x0) * (y1 - y0)) ** 4


def elliptical_mountain(lon: Column, lat: Column, lon0: float, lat0: float, a: float, b: float, height: float) -> Column:
    """SRC-SYN-ELL: height over the root of 1 and the squared distances, in half axes a (east) and b (north, both in km), of the point from the centre.

    The distance's direction comes from the local east and north of the centre."""
    p = unit_vector(lon, lat)
    lo, la = math.radians(lon0), math.radians(lat0)
    c = tuple(F.lit(v) for v in (math.cos(la) * math.cos(lo), math.cos(la) * math.sin(lo), math.sin(la)))
    east = tuple(F.lit(v) for v in (-math.sin(lo), math.cos(lo), 0.0))
    north = tuple(F.lit(v) for v in (-math.sin(la) * math.cos(lo), -math.sin(la) * math.sin(lo), math.cos(la)))
    away = angle(p, c) * (EARTH_RADIUS / 1000)
    bearing = F.atan2(dot(p, east), dot(p, north))
    u, v = away * F.sin(bearing), away * F.cos(bearing)
    return height / F.sqrt(1 + (u / a) ** 2 + (v / b) ** 2)


class Lambert:
    """Lambert conformal conic on the sphere (Snyder 1987, p. 106): degrees to metres and back."""

    def __init__(self, lat0: float, lon0: float, lat1: float, lat2: float, radius: float = EARTH_RADIUS):
        self.lon0, self.radius = lon0, radius
        t = lambda lat: math.tan(math.pi / 4 + math.radians(lat) / 2)
        c1, c2 = math.cos(math.radians(lat1)), math.cos(math.radians(lat2))
        self.n = math.sin(math.radians(lat1)) if abs(lat1 - lat2) < 1e-10 else math.log(c1 / c2) / math.log(t(lat2) / t(lat1))
        self.f = c1 * t(lat1) ** self.n / self.n
        self.rho0 = radius * self.f / t(lat0) ** self.n

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        rho = self.radius * self.f / F.pow(F.tan(math.pi / 4 + F.radians(lat) / 2), F.lit(self.n))
        theta = F.radians(wrapped(lon - self.lon0)) * self.n
        return rho * F.sin(theta), self.rho0 - rho * F.cos(theta)

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        s = math.copysign(1.0, self.n)
        down = self.rho0 - y
        rho = s * F.sqrt(x * x + down * down)
        theta = F.atan2(s * x, s * down)
        lat = 2 * F.atan(F.pow(self.radius * self.f / rho, F.lit(1 / self.n))) - math.pi / 2
        return wrapped(F.degrees(theta) / self.n + self.lon0), F.degrees(lat)

    def scale(self, lat: Column) -> Column:
        """Metres on the map for a metre on the sphere."""
        rho = self.radius * self.f / F.pow(F.tan(math.pi / 4 + F.radians(lat) / 2), F.lit(self.n))
        return rho * self.n / (self.radius * F.cos(F.radians(lat)))


class Schmidt:
    """Rotation of the pole and stretching by a factor (Courtier and Geleyn 1988): geographic degrees to those of the grid and back."""

    def __init__(self, factor: float, pole_lon: float, pole_lat: float):
        self.c, self.lon, self.lat = factor, math.radians(pole_lon), math.radians(pole_lat)

    def _rows(self) -> tuple[tuple[float, ...], ...]:
        """Axes of the rotated frame: the stretching pole is its north."""
        co, so, ca, sa = math.cos(self.lon), math.sin(self.lon), math.cos(self.lat), math.sin(self.lat)
        return (sa * co, sa * so, -ca), (-so, co, 0.0), (ca * co, ca * so, sa)

    def _stretched(self, s: Column, c: float) -> Column:
        """The sine of latitude after stretching by c."""
        a, b = c * c + 1, c * c - 1
        return bounded((b + a * s) / (a + b * s))

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        """To the grid's frame: rotated, then drawn away from the pole."""
        p = unit_vector(lon, lat)
        x, y, z = (p[0] * r[0] + p[1] * r[1] + p[2] * r[2] for r in self._rows())
        return F.degrees(F.atan2(y, x)), F.degrees(F.asin(self._stretched(bounded(z), 1 / self.c)))

    def inverse(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        s = self._stretched(F.sin(F.radians(lat)), self.c)
        r, a = F.sqrt(bounded(1 - s * s, 0.0)), F.radians(lon)
        p, rows = (r * F.cos(a), r * F.sin(a), s), self._rows()
        x, y, z = (p[0] * rows[0][i] + p[1] * rows[1][i] + p[2] * rows[2][i] for i in range(3))
        return F.degrees(F.atan2(y, x)), F.degrees(F.asin(bounded(z)))
