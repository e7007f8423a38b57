"""Mappings between points and grid cells as column arithmetic and equi-joins, never as band joins.

Rows with linear y need no table at all. Other rows (Gaussian latitudes) are dealt into buckets of y, so that the search
for a row is a broadcast hash join on a bucket; a row table has some thousand rows, one for each latitude.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import angle, bounded, unit_vector
from ..plans.grids import Grid

CORNERS = ("sw", "se", "nw", "ne")
#: Around the cell: the corner after each and the corner before it, in the order of CORNERS.
NEXT, PREV = (1, 3, 0, 2), (2, 0, 3, 1)


def half_away(x: Column) -> Column:
    """C's round(): halves go away from zero."""
    return F.when(x >= 0, F.floor(x + 0.5)).otherwise(F.ceil(x - 0.5))


def _row_table(df: DataFrame, grid: Grid, bounds: list[tuple[float, float, int]]) -> DataFrame:
    """One row for each stretch (low, high, number) of y and each bucket that it touches."""
    spark = df.sparkSession
    height = max(1e-9, min(hi - lo for lo, hi, _ in bounds if math.isfinite(hi - lo)))
    ends = [v for lo, hi, _ in bounds for v in (lo, hi) if math.isfinite(v)]
    first, last = math.floor(min(ends) / height) - 1, math.floor(max(ends) / height) + 1
    out = []
    for lo, hi, number in bounds:
        a = first if lo == -math.inf else math.floor(lo / height)
        b = last if hi == math.inf else math.floor(hi / height)
        out += [(bucket, float(lo), float(hi), number) for bucket in range(a, b + 1)]
    table = spark.createDataFrame(out, "_bucket long, _lo double, _hi double, _row int")
    bucket = bounded(F.floor(F.col("_y") / height), first, last)
    return df.withColumn("_bucket", bucket).join(F.broadcast(table), "_bucket", "left")


def _geometry(df: DataFrame, grid: Grid, j: str, prefix: str) -> DataFrame:
    """nx, xmin, dx and row_off of row j; constants for uniform rows, else by a broadcast join."""
    if grid.linear is not None:
        nx = grid.nx[0]
        return df.withColumns({f"{prefix}nx": F.lit(nx), f"{prefix}xmin": F.lit(grid.xmin[0]), f"{prefix}dx": F.lit(grid.dx[0]), f"{prefix}off": F.col(j).cast("long") * nx})
    rows = grid.rows(df.sparkSession).select(F.col("j").alias(j), *[F.col(c).alias(prefix + n) for c, n in (("nx", "nx"), ("xmin", "xmin"), ("dx", "dx"), ("row_off", "off"))])
    return df.join(F.broadcast(rows), j, "left")


def cell_of(df: DataFrame, grid: Grid, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """JN-CELL: df with iglo2, j2, i2 of the nearest cell of the grid; null where a regional grid has none (see in_domain) or a coordinate is null.

    Rows: the nearest, ties to the higher number; first and last reach half a cell out, or to the pole if the grid is global.
    Columns: the nearest, around the globe if the grid is global."""
    x, y = grid.xy(F.col(lon), F.col(lat))
    df = df.withColumns({"_x": x, "_y": y})
    if (line := grid.linear) is not None:
        at = F.floor((F.col("_y") - line[0]) / line[1] + 0.5)
        j = bounded(at, 0, grid.ny - 1) if grid.is_global else F.when(at.between(0, grid.ny - 1), at)
        df = df.withColumn("j2", j.cast("int"))
        keep = []
    else:
        down = grid.y[0] > grid.y[-1]
        mids = [(a + b) / 2 for a, b in zip(grid.y, grid.y[1:])]
        reach = math.inf if grid.is_global else None
        edge = lambda j, other: reach if reach else abs(grid.y[j] - grid.y[other]) / 2
        sign = -1 if down else 1
        bounds = []
        for j in range(grid.ny):
            before = mids[j - 1] if j else grid.y[0] - sign * edge(0, 1)
            after = mids[j] if j + 1 < grid.ny else grid.y[-1] + sign * edge(-1, -2)
            bounds.append((min(before, after), max(before, after), j))
        df = _row_table(df, grid, bounds)
        inside = (F.col("_y") >= F.col("_lo")) & (F.col("_y") < F.col("_hi")) if not down else (F.col("_y") > F.col("_lo")) & (F.col("_y") <= F.col("_hi"))
        # A tie belongs to the row with the higher number: the lower end going up, the upper end going down.
        df = df.where(F.col("_lo").isNull() | inside).withColumn("j2", F.col("_row"))
        keep = ["_bucket", "_lo", "_hi", "_row"]
    df = _geometry(df, grid, "j2", "_g")
    i = half_away((F.col("_x") - F.col("_gxmin")) / F.col("_gdx"))
    i = F.pmod(i, F.col("_gnx")) if grid.is_global else F.when(i.between(0, F.col("_gnx") - 1), i)
    df = df.withColumn("i2", i.cast("int")).withColumn("iglo2", F.col("_goff") + F.col("i2"))
    return df.drop("_x", "_y", "_gnx", "_gxmin", "_gdx", "_goff", *keep)


def in_domain(df: DataFrame) -> DataFrame:
    """FLT-DOMAIN: source points without a target go before any shuffle."""
    return df.where(F.col("iglo2").isNotNull())


def brackets(df: DataFrame, grid: Grid, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """JN-CORNER: df with _x, _y and _top, the number of the northern row of two around the point, -1 before the first row."""
    x, y = grid.xy(F.col(lon), F.col(lat))
    df = df.withColumns({"_x": x, "_y": y})
    if (line := grid.linear) is not None:
        at = F.floor((F.col("_y") - line[0]) / line[1])
        return df.withColumn("_top", bounded(at, -1, grid.ny - 1).cast("int"))
    sign = -1 if grid.y[0] > grid.y[-1] else 1
    edges = [-sign * math.inf, *grid.y, sign * math.inf]
    bounds = [(min(a, b), max(a, b), k - 1) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
    df = _row_table(df, grid, bounds)
    inside = (F.col("_y") >= F.col("_lo")) & (F.col("_y") < F.col("_hi")) if sign > 0 else (F.col("_y") > F.col("_lo")) & (F.col("_y") <= F.col("_hi"))
    return df.where(inside | F.col("_lo").isNull()).withColumn("_top", F.col("_row")).drop("_bucket", "_lo", "_hi", "_row")


def corners(df: DataFrame, grid: Grid, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """df with corners, an array of structs (iglo, j, i, x, y, lon, lat) in the order of CORNERS; nulls where there is no point."""
    df = brackets(df, grid, lon, lat)
    down = grid.y[0] > grid.y[-1]
    names = {"n": F.col("_top") if down else F.col("_top") + 1, "s": F.col("_top") + 1 if down else F.col("_top")}
    for name, row in names.items():
        j = f"_j{name}"
        df = df.withColumn(j, F.when(row.between(0, grid.ny - 1), row).cast("int"))
        df = _geometry(df, grid, j, f"_{name}")
        if (line := grid.linear) is not None:
            df = df.withColumn(f"_{name}y", line[0] + F.col(j) * line[1])
        else:
            ys = grid.rows(df.sparkSession).select(F.col("j").alias(j), F.col("y").alias(f"_{name}y"))
            df = df.join(F.broadcast(ys), j, "left")
    out = []
    for corner in CORNERS:
        n = corner[0]
        nx, xmin, dx, off, j = (F.col(f"_{n}{c}") for c in ("nx", "xmin", "dx", "off", "y"))
        at = F.floor((F.col("_x") - xmin) / dx) + (1 if corner[1] == "e" else 0)
        i = F.pmod(at, nx) if grid.is_global else F.when(at.between(0, nx - 1), at)
        x, y = xmin + i * dx, F.when(F.col(f"_j{n}").isNotNull(), j)
        lo, la = grid.lonlat(x, y)
        out.append(F.when(F.col(f"_j{n}").isNotNull() & i.isNotNull(), F.struct((off + i).alias("iglo"), F.col(f"_j{n}").alias("j"), i.cast("int").alias("i"), lo.alias("lon"), la.alias("lat"))))
    drop = [c for c in df.columns if c.startswith("_")]
    return df.withColumn("corners", F.array(*out)).drop(*drop)


def weighted(df: DataFrame, resolution: Column, lon: str = "lon", lat: str = "lat", edge: str = "first") -> DataFrame:
    """ST-WGT: df with weights, an array in the order of corners that adds up to 1, or null without any corner.

    A corner's weight is the inverse product of two detours, by the corner before and by the one after it; a point within
    resolution / 1000 of an edge is interpolated on that edge alone. resolution: the angle between neighbouring targets.
    edge: where corners are missing, "first" takes the first present corner whose next is missing (as a detour over nothing
    is no detour), "blend" weighs the present ones; "distance" weighs by inverse distance everywhere."""
    p = unit_vector(F.col(lon), F.col(lat))
    c = [F.get("corners", k) for k in range(4)]
    v = [unit_vector(x["lon"], x["lat"]) for x in c]
    near_by = {f"_d{k}": angle(p, v[k]) for k in range(4)} | {f"_e{k}": angle(v[k], v[NEXT[k]]) for k in range(4)}
    df = df.withColumns(near_by).withColumn("_r", resolution / 1000)
    d, e = [F.col(f"_d{k}") for k in range(4)], [F.col(f"_e{k}") for k in range(4)]
    there = [x.isNotNull() for x in c]
    if edge == "distance":
        plain = [F.when(there[k], 1.0 / F.greatest(F.lit(1e-10), d[k])).otherwise(0.0) for k in range(4)]
        chosen = F.array(*plain)
    else:
        after = [d[k] + d[NEXT[k]] - e[k] for k in range(4)]  # null where a corner is missing
        plain = []
        for k in range(4):
            w = F.coalesce(after[k], F.lit(1.0)) * F.coalesce(after[PREV[k]], F.lit(1.0))
            plain.append(F.when(there[k], 1.0 / F.greatest(F.lit(1e-30), w)).otherwise(0.0))
        chosen = None
        for k in range(4):
            a = F.when(e[k] > 0, d[k] / F.when(e[k] > 0, e[k])).otherwise(0.0)
            on_edge = F.array(*[1.0 - a if m == k else a if m == NEXT[k] else F.lit(0.0) for m in range(4)])
            near = there[k] & (after[k] < F.col("_r"))
            chosen = F.when(near, on_edge) if chosen is None else chosen.when(near, on_edge)
            if edge == "first":
                alone = F.array(*[F.lit(1.0 if m == k else 0.0) for m in range(4)])
                chosen = chosen.when(there[k] & ~there[NEXT[k]], alone)
        chosen = chosen.otherwise(F.array(*plain))
    total = F.aggregate("_w", F.lit(0.0), lambda s, x: s + x)
    df = df.withColumn("_w", chosen).withColumn("weights", F.when(total > 0, F.transform("_w", lambda x: x / total)))
    return df.drop("_w", "_r", *near_by)


def resolution(grid: Grid, j: Column, i: Column) -> Column:
    """Angle between a point of any grid and its neighbour before it on the row, after it for the first."""

    def of(values: tuple[float, ...]) -> Column:
        return F.lit(values[0]) if len({*values}) == 1 else F.get(F.expr(f"array({', '.join(f'{float(v)!r}D' for v in values)})"), j)

    xmin, dx, line = of(grid.xmin), of(grid.dx), grid.linear
    y = line[0] + j * line[1] if line else of(grid.y)
    other = F.when(i > 0, i - 1).otherwise(i + 1)
    return angle(unit_vector(*grid.lonlat(xmin + i * dx, y)), unit_vector(*grid.lonlat(xmin + other * dx, y)))


def mapping4(targets: DataFrame, source: Grid, resolution: Column, edge: str = "first") -> DataFrame:
    """iglo2, corner, iglo1, w: the reusable 4-point mapping, a row for each present corner."""
    df = weighted(corners(targets.withColumnRenamed("iglo", "iglo2"), source), resolution, edge=edge)
    both = F.arrays_zip(F.col("corners"), F.col("weights"))
    each = df.select("iglo2", F.posexplode(both).alias("corner", "c"))
    return each.where(F.col("c.corners").isNotNull()).select("iglo2", "corner", F.col("c.corners.iglo").alias("iglo1"), F.col("c.weights").alias("w"))
