"""Grids: a small geometry object on the driver that gives a table of rows and a table of points.

A grid has ny rows; row j has y, nx points, the first at xmin with spacing dx. A point's key is iglo = row_off + i. Rows of
at most some ten thousand are built on the driver; points are built from range(), so their number is no matter.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import Lambert, Schmidt

ROWS = "j int, y double, nx int, xmin double, dx double, row_off long"


def gaussian_latitudes(n: int) -> np.ndarray:
    """Latitudes in degrees, north first: roots of the Legendre polynomial of degree n by Newton's iteration, for n in the thousands too."""
    k = np.arange(1, n // 2 + n % 2 + 1)
    x = np.cos(math.pi * (4 * k - 1) / (4 * n + 2))
    for _ in range(50):
        before, now = np.ones_like(x), x.copy()
        for m in range(2, n + 1):
            before, now = now, ((2 * m - 1) * x * now - (m - 1) * before) / m
        slope = n * (x * now - before) / (x * x - 1)
        step = now / slope
        x = x - step
        if np.max(np.abs(step)) < 1e-15:
            break
    if n % 2:
        x[-1] = 0.0
    half = np.degrees(np.arcsin(x))
    return np.concatenate([half, -half[: n // 2][::-1]])


@dataclass(frozen=True)
class Grid:
    """y, nx, xmin and dx of each row; whether rows wrap around in x; the projection that gives x and y of lon and lat."""

    y: tuple[float, ...]
    nx: tuple[int, ...]
    xmin: tuple[float, ...]
    dx: tuple[float, ...]
    is_global: bool
    #: lonlat, lambert or schmidt.
    projection: str = "lonlat"
    map: object = None

    @property
    def ny(self) -> int:
        return len(self.y)

    @property
    def size(self) -> int:
        return sum(self.nx)

    @property
    def linear(self) -> tuple[float, float] | None:
        """First y and spacing where y is linear and all rows are alike, else None."""
        if self.ny < 2 or len({*self.nx}) > 1 or len({*self.xmin}) > 1 or len({*self.dx}) > 1:
            return None
        step = (self.y[-1] - self.y[0]) / (self.ny - 1)
        far = max(abs(v - (self.y[0] + j * step)) for j, v in enumerate(self.y))
        return (self.y[0], step) if far < 1e-9 * max(1.0, abs(self.y[0])) else None

    def rows(self, spark: SparkSession) -> DataFrame:
        off = np.concatenate([[0], np.cumsum(self.nx)[:-1]])
        return spark.createDataFrame([(j, float(self.y[j]), int(self.nx[j]), float(self.xmin[j]), float(self.dx[j]), int(off[j])) for j in range(self.ny)], ROWS)

    def points(self, spark: SparkSession, partitions: int | None = None) -> DataFrame:
        """iglo, j, i, x, y, lon, lat: from range(), no shuffle for uniform rows; a row table of bounded size is broadcast otherwise."""
        if (line := self.linear) is not None:
            nx = self.nx[0]
            keys = spark.range(0, self.size, 1, partitions) if partitions else spark.range(self.size)
            df = keys.select(F.col("id").alias("iglo"), F.expr(f"int(id div {nx})").alias("j"), F.expr(f"int(id % {nx})").alias("i"))
            df = df.withColumn("x", self.xmin[0] + F.col("i") * self.dx[0]).withColumn("y", line[0] + F.col("j") * line[1])
        else:
            df = F.broadcast(self.rows(spark)).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("nx") - 1)))
            df = df.select((F.col("row_off") + F.col("i")).alias("iglo"), "j", "i", (F.col("xmin") + F.col("i") * F.col("dx")).alias("x"), "y")
            df = df.repartitionByRange(partitions, "iglo") if partitions else df
        lon, lat = self.lonlat(F.col("x"), F.col("y"))
        return df.withColumn("lon", lon).withColumn("lat", lat)

    def xy(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        return (lon, lat) if self.map is None else self.map.forward(lon, lat)

    def lonlat(self, x: Column, y: Column) -> tuple[Column, Column]:
        return (x, y) if self.map is None else self.map.inverse(x, y)

    def box(self, spark: SparkSession) -> tuple[float, float, float, float] | None:
        """SRC-BBOX: west, east, south and north of a regional grid's points; None for a global one, which needs all of a source."""
        if self.is_global:
            return None
        return tuple(self.points(spark).agg(F.min("lon"), F.max("lon"), F.min("lat"), F.max("lat")).first())

    def like(self, other: Grid) -> bool:
        """PRED-GEOM: same rows and sizes, and first, middle and last points within 1e-5 of the extent of a row."""
        if (self.ny, self.nx, self.projection) != (other.ny, other.nx, other.projection):
            return False
        near = 1e-5 * max(abs(d * n) for d, n in zip(self.dx, self.nx))
        for j in range(self.ny):
            for i in (0, self.nx[j] // 2, self.nx[j] - 1):
                if abs(self.xmin[j] + i * self.dx[j] - other.xmin[j] - i * other.dx[j]) > near or abs(self.y[j] - other.y[j]) > near:
                    return False
        return True


def uniform(nx: int, ny: int, xmin: float, dx: float, y0: float, dy: float, is_global: bool, projection: str = "lonlat", map: object = None) -> Grid:
    return Grid(tuple(y0 + j * dy for j in range(ny)), (nx,) * ny, (xmin,) * ny, (dx,) * ny, is_global, projection, map)


def global_lonlat(nx: int, ny: int, west: float = 0.0) -> Grid:
    """Rows from 90 north to 90 south, poles included."""
    return uniform(nx, ny, west, 360 / nx, 90.0, -180 / (ny - 1), True)


def shifted_lonlat(nx: int, ny: int, west: float = 0.0) -> Grid:
    """Points at cell centres, half a cell from west and poles."""
    return uniform(nx, ny, west + 180 / nx, 360 / nx, 90 - 90 / ny, -180 / ny, True)


def regional_lonlat(nx: int, ny: int, north: float, west: float, south: float, east: float) -> Grid:
    """Points on the borders; all around the globe if another step beyond east is west again."""
    dx = (east - west) / (nx - 1)
    return uniform(nx, ny, west, dx, north, (south - north) / (ny - 1), abs(math.fmod(east + dx - west - 360, 360)) < 1e-6)


def lambert(nx: int, ny: int, dx: float, dy: float, nux: int, nuy: int, lat0: float, lat1: float, lat2: float, lon0: float) -> Grid:
    """Metres; the origin is at the middle of the inner nux times nuy points, counted in whole points."""
    return uniform(nx, ny, -(nux // 2) * dx, dx, -(nuy // 2) * dy, dy, False, "lambert", Lambert(lat0, lon0, lat1, lat2))


def reduced_gaussian(nloen: list[int], stretch: tuple[float, float, float] | None = None) -> Grid:
    """nloen points on each Gaussian row; stretch: factor and the pole's longitude and latitude."""
    y = gaussian_latitudes(len(nloen))
    grid = Grid(tuple(map(float, y)), tuple(map(int, nloen)), (0.0,) * len(nloen), tuple(360.0 / n for n in nloen), True)
    return grid if stretch is None else replace(grid, projection="schmidt", map=Schmidt(*stretch))


def named(name: str) -> Grid:
    """L80x40 global with poles, S80x40 at cell centres, X80x40 from -180, N16 regular rows on 32 Gaussian latitudes."""
    if m := re.fullmatch(r"([LSX])(\d+)x(\d+)", name):
        nx, ny = int(m[2]), int(m[3])
        return {"L": global_lonlat, "S": shifted_lonlat, "X": lambda a, b: global_lonlat(a, b, -180.0)}[m[1]](nx, ny)
    if m := re.fullmatch(r"N(\d+)", name):
        return reduced_gaussian([4 * int(m[1])] * (2 * int(m[1])))
    raise ValueError(f"unknown grid name {name!r}")


def from_frame(frame: dict) -> Grid:
    """SRC-FA-GRID: the grid of a file's frame, of three families.

    kind lonlat: nx, ny and the corners west, south, east, north in radians, rounded to 1e-10 degrees; kind
    lambert: nx, ny, dx, dy (metres), nux, nuy, lon0 and lat0 (radians); kind gaussian: ny (even), nloen (points of each row,
    those of the north suffice), stretch, and the pole as sine of latitude and sine and cosine of longitude."""
    kind = frame["kind"]
    if kind == "lonlat":
        west, south, east, north = (round(math.degrees(frame[c]), 10) for c in ("west", "south", "east", "north"))
        nx, ny = frame["nx"], frame["ny"]
        step = round((east - west) % 360.0 / (nx - 1), 10)
        if east < west:
            west -= 360.0
        if abs(math.fmod(east + step - west - 360.0, 360.0)) < 1e-6:
            return uniform(nx, ny, west, 360.0 / nx, north, (south - north) / (ny - 1), True)
        return regional_lonlat(nx, ny, north, west, south, east)
    if kind == "lambert":
        lat = math.degrees(frame["lat0"])
        return lambert(frame["nx"], frame["ny"], frame["dx"], frame["dy"], frame["nux"], frame["nuy"], lat, lat, lat, math.degrees(frame["lon0"]))
    if frame["ny"] % 2:
        raise ValueError("an odd number of Gaussian latitudes")
    half = [int(n) for n in frame["nloen"][: frame["ny"] // 2]]
    pole = math.degrees(math.atan2(frame["sin_lon"], frame["cos_lon"])), math.degrees(math.asin(frame["sin_lat"]))
    turned = frame["stretch"] != 1.0 or pole != (0.0, 90.0)
    return reduced_gaussian(half + half[::-1], (frame["stretch"], *pole) if turned else None)


def from_namelist(text: str) -> Grid:
    """SRC-NML: the grid of a namelist; the group's header may be missing and unknown keys are ignored."""
    found: dict[str, list[str]] = {}
    body = "\n".join(line.split("!")[0] for line in text.splitlines())
    for m in re.finditer(r"(\w+)\s*(?:\(\s*(\d+)[^)]*\))?\s*=\s*([^=]*?)(?=(?:,?\s*\w+\s*(?:\([^)]*\))?\s*=)|/|&|\Z)", body):
        found.setdefault(m[1].upper(), []).extend(x for x in re.split(r"[,\s]+", m[3].strip()) if x)

    def number(key, default):
        return float(found[key][0].lower().replace("d", "e")) if found.get(key) else default

    def flag(key):
        return bool(found.get(key)) and found[key][0].strip(".").upper().startswith("T")

    nloen: list[int] = []
    for x in found.get("NLOEN", []):
        times, star, value = x.partition("*")
        nloen += [int(value)] * int(times) if star else [int(x)]
    ny, nx = int(number("NDGLG", len(nloen))), int(number("NDLON", max(nloen, default=0)))
    if flag("LATLON"):
        west, east, south, north = number("ZLONW", 0.0), number("ZLONE", 360.0), number("ZLATS", -90.0), number("ZLATN", 90.0)
        if math.fmod(east - west, 360.0) == 0:
            return shifted_lonlat(nx, ny, west)
        return regional_lonlat(nx, ny, north, west, south, east)
    if flag("LELAM"):
        lat0 = number("LADINDEGREES", 46.2)
        return lambert(nx, ny, number("DXINMETRES", 10000.0), number("DYINMETRES", 10000.0), int(number("NUX", nx)), int(number("NUY", ny)), lat0, number("LATIN1INDEGREES", 46.2), number("LATIN2INDEGREES", 46.2), number("LOVINDEGREES", 2.0))
    if not nloen:
        return shifted_lonlat(nx, ny)
    stretch = (number("RSTRETCH", 1.0), number("RLONCENT", 0.0), number("RLATCENT", 90.0)) if flag("LSTRETCH") or flag("LROTATED") else None
    return reduced_gaussian(nloen[:ny] if ny else nloen, stretch)
