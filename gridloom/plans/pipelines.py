"""Whole programs over the operators: surface description, initial state, field-to-field regridding, conversions."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fields as fx
from ..functions.geometry import elliptical_mountain
from ..operators import physio
from ..operators.mapping import mapping4, resolution
from ..operators.regrid import OPTIONS, filled_with_means, interpolate4, matching_masks, regrid
from .grids import Grid
from .scratch import settled


def surface(source: DataFrame, grid: Grid | dict[str, Grid], target: Grid, class_table: DataFrame, ellipse: tuple[float, ...] | None = None, sea_class: int = 1) -> DataFrame:
    """PG-PGD: iglo and the surface fields of each target point.

    source: iglo, j, i, x, y, lon, lat, zs, clay, sand, cover on the grid. Covers are counted before the sea is masked out of
    the height; the envelope adds the deviation to the mean height. grid: that of all inputs, or of each by name, which must be the
    same. The source is read twice: for all means and shares of the cells, and for what stands above them."""
    grid = same_geometry(grid) if isinstance(grid, dict) else grid
    if ellipse:
        source = source.withColumns({"zs": elliptical_mountain(F.col("lon"), F.col("lat"), *ellipse), "clay": F.lit(0.0), "sand": F.lit(0.0), "cover": F.lit(2)})
    land = source.withColumn("zs", fx.masked(F.col("zs"), F.col("cover") == sea_class))
    cells = physio.to_cells(physio.with_slopes(land, grid, target), target)
    found = physio.cell_summary(cells, ["zs", "clay", "sand", *physio.PRODUCTS], ["zs"], class_table, ["sea", "nature", "water", "town"])
    found = found.withColumnsRenamed({"iglo2": "iglo", "zs": "zs_avg"}).withColumns(physio.shape("zs_avg")).drop(*physio.PRODUCTS)
    found = settled(found, "cells")
    out = target.points(source.sparkSession).join(found, "iglo", "left")
    high = physio.obstacles(land, grid, out.select("iglo", F.col("zs_avg").alias("avg")), target)
    out = out.join(high.withColumnRenamed("iglo2", "iglo"), "iglo", "left")
    dummy = fx.dummies(F.col("sea"), F.col("nature"))
    out = out.withColumns({"zs": fx.envelope(F.col("zs_avg"), F.col("stdev")), "sil": F.col("zs_avg"), **dummy})
    zero = ["zs", "zs_avg", "zs_min", "zs_max", "sil", "dir", "slope", "anis", "stdev", "clay", "sand", *[c for c in high.columns if c != "iglo2"]]
    return out.withColumns({c: fx.or_zero(F.col(c)) for c in zero})


def initial_state(state: DataFrame, source: Grid | dict[str, Grid], target: Grid, fields: list[str], fractions: list[str], target_fractions: DataFrame) -> DataFrame:
    """PG-PREP: iglo and the fields on the target: cell means, else 4-point values, else the mean over the field's mask.

    Which fraction a field is defined on is settled by its support on the source: a matrix of counts, a row for each field. source:
    the grid of state and fractions, or of each by name, which must be the same."""
    source = same_geometry(source) if isinstance(source, dict) else source
    points = target.points(state.sparkSession)
    cells = regrid(physio.to_cells(state, target), dict.fromkeys(fields, "avg")).withColumnRenamed("iglo2", "iglo")
    mapping = mapping4(points, source, resolution(target, F.col("j"), F.col("i")))
    four = interpolate4(mapping, state, fields).withColumnRenamed("iglo2", "iglo").withColumnsRenamed({f: f"{f}_4" for f in fields})
    out = points.select("iglo").join(cells, "iglo", "left").join(four, "iglo", "left").join(target_fractions, "iglo", "left")
    out = out.withColumns({f: fx.mixed(F.col(f), F.col(f"{f}_4")) for f in fields})
    masks = {r["field"]: r["mask"] for r in matching_masks(state, fields, fractions).collect()}  # a row for each field
    out = out.withColumns({f: F.when(F.col(m) > 0, F.col(f)) for f, m in masks.items() if m})
    return filled_with_means(out, masks).select("iglo", *fields)


def field_to_field(source_field: DataFrame, source: Grid, target: Grid, fields: list[str]) -> DataFrame:
    """PG-INT: 4-point values of named fields on the target."""
    mapping = mapping4(target.points(source_field.sparkSession), source, resolution(target, F.col("j"), F.col("i")))
    return interpolate4(mapping, source_field, fields).withColumnRenamed("iglo2", "iglo")


#: The lags of deep temperature and of deep moisture behind the surface's, for the year's first harmonic.
TEMPERATURE_LAG, MOISTURE_LAG = math.sqrt(1 + 2 * math.pi) / (2 * math.sqrt(365)), 0.1969
MONTHS = 12


def lag_weights(lag: float) -> list[float]:
    """What the month d months before adds to a lagged month: the k-th harmonic of the year is damped by exp(-lag * sqrt k) and shifted by lag * sqrt k, as a wave is that goes into a uniform ground."""
    out = []
    for d in range(MONTHS):
        total = 1.0
        for k in range(1, MONTHS // 2 + 1):
            depth = lag * math.sqrt(k)
            twice = 1 if 2 * k == MONTHS else 2  # the shortest wave has one phase only
            angle = math.cos(depth) * math.cos(math.pi * d) if twice == 1 else math.cos(2 * math.pi * k * d / MONTHS - depth)
            total += twice * math.exp(-depth) * angle
        out.append(total / MONTHS)
    return out


def lagged_cycle(monthly: DataFrame, field: str, lag: float, key: str = "iglo") -> DataFrame:
    """PRJ-LAG: df with field_lagged, the annual cycle as it arrives at a depth. A stand-in: the body of the original is not known, its two lags are.

    The year's harmonics are damped and shifted by the lag, all at once as weights of the twelve months, so the mean stays
    and a lag of 0 changes nothing. A key without all twelve months has none."""
    whole = Window.partitionBy(key)
    months = F.collect_list(F.when(F.col(field).isNotNull(), F.struct("month", F.col(field).alias("v")))).over(whole)  # twelve at most
    weights = F.array(*[F.lit(w) for w in lag_weights(lag)])
    total = F.aggregate("_year", F.lit(0.0), lambda t, x: t + F.get(weights, F.pmod(F.col("month") - x["month"], F.lit(MONTHS)).cast("int")) * x["v"])
    return monthly.withColumn("_year", F.array_sort(months)).withColumn(f"{field}_lagged", F.when(F.size("_year") == MONTHS, total)).drop("_year")


def name_key(name: str) -> tuple[str, str, int]:
    """SO-FLD: prefix, suffix and level of a field name: a letter and digits are a level type and its number, else the prefix is four letters without level."""
    if m := re.match(r"([SHP])(\d{3,5})(.+)", name):
        return m[1], m[3].strip(), int(m[2])
    return name[:4], name[4:].strip(), 0


def recoded(df: DataFrame, include: list[str] | None = None, skip: list[str] | None = None, mask: Column | None = None, digits: int | None = None, prefix: str = "") -> DataFrame:
    """TL-CONV: fields chosen by name (FLT-NAME), sorted by prefix, suffix and level (SO-FLD), masked, rounded and renamed (PRJ-RENAME)."""
    names = sorted((c for c in df.columns if c != "iglo" and (include is None or c in include) and c not in (skip or ())), key=name_key)
    out = []
    for c in names:
        v = F.when(mask, F.col(f"`{c}`")) if mask is not None else F.col(f"`{c}`")
        out.append((F.round(v, digits) if digits is not None else v).alias(prefix + c))
    return df.select("iglo", *out)


def point_cells(source: DataFrame, points: DataFrame, dx: float, dy: float, fields: dict[str, str]) -> DataFrame:
    """PG-PTS: point and the aggregates of the source points in a box of dx by dy degrees around each point, for any number of points.

    A box touches at most two buckets of its own size in x and y, so the search is an equi-join on buckets. points: point, lon, lat."""
    width = 360 / max(1, math.floor(360 / dx))  # a whole number of buckets around the globe
    bucket = lambda lon, lat: (F.floor(F.pmod(lon, F.lit(360.0)) / width).alias("bx"), F.floor((lat + 90) / dy).alias("by"))
    around = points.select("point", F.col("lon").alias("lon0"), F.col("lat").alias("lat0"))
    for axis, half in (("lon0", dx / 2), ("lat0", dy / 2)):
        around = around.withColumn(f"_{axis}", F.explode(F.array(F.col(axis) - half, F.col(axis) + half)))
    asked = around.select("point", "lon0", "lat0", *bucket(F.col("_lon0"), F.col("_lat0"))).distinct()
    own = source.select("lon", "lat", *fields, *bucket(F.col("lon"), F.col("lat")))
    away = F.pmod(F.col("lon") - F.col("lon0") + dx / 2, F.lit(360.0))
    inside = (away >= 0) & (away < dx) & (F.col("lat") > F.col("lat0") - dy / 2) & (F.col("lat") <= F.col("lat0") + dy / 2)
    met = own.join(asked, ["bx", "by"]).where(inside)
    return met.groupBy("point").agg(*[OPTIONS[o](F.col(f)).alias(f) for f, o in fields.items()], F.count("*").alias("n"))


def same_geometry(grids: dict[str, Grid]) -> Grid:
    """PRED-GEOM: the one grid of several sources; an error that names those that differ from the first."""
    names = list(grids)
    off = [n for n in names[1:] if not grids[names[0]].like(grids[n])]
    if off:
        raise ValueError(f"geometry mismatch: {', '.join(off)} against {names[0]}")
    return grids[names[0]]
