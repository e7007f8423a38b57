"""Neighbour operators on grids: gradients, half differences, high-order derivatives, rotation of vectors.

On uniform grids rows and columns are windows: a point's neighbours come by two shuffles of a row for each point. On reduced
and Gaussian grids bands of rows with a halo are partitions, and neighbours are positions in them: one shuffle (see bands).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import wrapped
from ..plans.grids import Grid
from . import bands

#: ST-HIGH: fixed coefficients of the central derivative of order 2k.
HIGH = {1: (1 / 2,), 2: (2 / 3, -1 / 12), 3: (3 / 4, -3 / 20, 1 / 60), 4: (4 / 5, -1 / 5, 4 / 105, -1 / 280)}


def shifted(df: DataFrame, column: str, by: int, along: str, n: int, periodic: bool) -> Column:
    """The value `by` points further along i or j, around the end if periodic, else null."""
    other = "j" if along == "i" else "i"
    w = Window.partitionBy(other).orderBy(along)
    plain = F.lead(column, by).over(w) if by > 0 else F.lag(column, -by).over(w)
    if not periodic:
        return plain
    around = F.lag(column, n - by).over(w) if by > 0 else F.lead(column, n + by).over(w)
    return F.when(F.col(along).between(-min(by, 0), n - 1 - max(by, 0)), plain).otherwise(around)


def high_gradient(df: DataFrame, field: str, nx: int, ny: int, order: int = 4, periodic: bool = False) -> DataFrame:
    """ST-HIGH: df with field_di and field_dj, differences in index space (not divided by the spacing); rows must be complete."""
    for along, n in (("i", nx), ("j", ny)):
        terms = [c * (shifted(df, field, k, along, n, periodic) - shifted(df, field, -k, along, n, periodic)) for k, c in enumerate(HIGH[order], 1)]
        total = terms[0]
        for t in terms[1:]:
            total = total + t
        df = df.withColumn(f"{field}_d{along}", total)
    return df


def windowed_neighbours(df: DataFrame, grid: Grid, fields: list[str]) -> DataFrame:
    """neighbours() of a uniform grid, where nw is the point straight above and ne has its values too. Rows may have gaps: a neighbour counts if its number is the next one."""
    row, column = Window.partitionBy("j").orderBy("i"), Window.partitionBy("i").orderBy("j")
    whole = row.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    n, dx, dy = grid.nx[0], grid.dx[0], grid.linear[1]
    seen = {}
    for side, number, window, find in (("w", "i", row, F.lag), ("e", "i", row, F.lead), ("n", "j", column, F.lag), ("s", "j", column, F.lead)):
        seen |= {f"_{side}_{c}": find(c).over(window) for c in (number, *fields)}
    if grid.is_global:
        seen |= {f"_first_{c}": F.first(c).over(whole) for c in ("i", *fields)} | {f"_last_{c}": F.last(c).over(whole) for c in ("i", *fields)}
    out = df.withColumns(seen)
    there = {"w": F.col("_w_i") == F.col("i") - 1, "e": F.col("_e_i") == F.col("i") + 1, "n": F.col("_n_j") == F.col("j") - 1, "s": F.col("_s_j") == F.col("j") + 1}
    value = lambda side, c: F.when(there[side], F.col(f"_{side}_{c}"))
    around = {"w": (F.col("i") == 0, "_last_", n - 1), "e": (F.col("i") == n - 1, "_first_", 0)}
    found = {}
    for side, by in (("w", -dx), ("e", dx)):
        first, other, number = around[side]
        ends = grid.is_global
        found |= {f"{c}_{side}": F.when(first, F.when(F.col(f"{other}i") == number, F.col(other + c))).otherwise(value(side, c)) if ends else value(side, c) for c in fields}
        exists = F.when(first, F.col(f"{other}i") == number).otherwise(there[side]) if ends else there[side]
        found[f"x{side}"] = F.when(exists, F.col("x") + by)
    for r, by in (("n", -dy), ("s", dy)):
        found |= {f"{c}_{r}{side}": value(r, c) for side in "we" for c in fields}
        found |= {f"y{r}": F.when(there[r], F.col("y") + by), f"x{r}w": F.when(there[r], F.col("x")), f"x{r}e": F.when(there[r], F.col("x") + dx)}
    return out.withColumns(found).drop(*seen)


def neighbours(df: DataFrame, grid: Grid, fields: list[str]) -> DataFrame:
    """df with, for each field, its values at w, e, nw, ne, sw and se, and with xw, xe, xnw and so on, yn and ys.

    n is the row before and s the row after; nw and ne are the points of that row on either side of x. A neighbour outside
    the grid is null. On uniform grids they are windows, else bands of rows."""
    return windowed_neighbours(df, grid, fields) if grid.linear is not None else bands.neighbours(df, grid, fields)


def _around(x: Column, x0: Column, grid: Grid) -> Column:
    """x brought within half a turn of x0 on a global grid."""
    return x0 + (F.lit(180.0) - F.pmod(F.lit(180.0) - (x - x0), F.lit(360.0))) if grid.is_global else x


def _arms(df: DataFrame, grid: Grid, f: str) -> tuple[dict[str, Column], dict[str, Column]]:
    """Values and positions of the four arms; those to north and south are interpolated between two points."""
    x0, y0 = F.col("x"), F.col("y")
    if grid.linear is not None:
        value = {"e": F.col(f"{f}_e"), "w": F.col(f"{f}_w"), "n": F.col(f"{f}_nw"), "s": F.col(f"{f}_sw")}
        place = {"e": F.when(F.col("xe").isNotNull(), x0 + grid.dx[0]), "w": F.when(F.col("xw").isNotNull(), x0 - grid.dx[0]), "n": F.col("yn"), "s": F.col("ys")}
        return _beyond_poles(value, place, grid, f)
    value, place = {"e": F.col(f"{f}_e"), "w": F.col(f"{f}_w")}, {"e": _around(F.col("xe"), x0, grid), "w": _around(F.col("xw"), x0, grid)}
    for r in ("n", "s"):
        a, b = _around(F.col(f"x{r}w"), x0, grid), _around(F.col(f"x{r}e"), x0, grid)
        share = F.when(b != a, (b - x0) / F.when(b != a, b - a)).otherwise(1.0)
        both = share * F.col(f"{f}_{r}w") + (1 - share) * F.col(f"{f}_{r}e")
        value[r] = F.when(share == 1, F.col(f"{f}_{r}w")).when(share == 0, F.col(f"{f}_{r}e")).otherwise(both)
        place[r] = F.col(f"y{r}")
    return _beyond_poles(value, place, grid, f)


def _beyond_poles(value: dict[str, Column], place: dict[str, Column], grid: Grid, f: str) -> tuple[dict[str, Column], dict[str, Column]]:
    """The arms with those over the poles of a global grid: the point's own value, mirrored."""
    y0 = F.col("y")
    if grid.is_global:
        place["n"] = F.coalesce(place["n"], F.when(F.col("j") == 0, 180.0 - y0))
        place["s"] = F.coalesce(place["s"], F.when(F.col("j") == grid.ny - 1, -180.0 - y0))
        for r, edge in (("n", 0), ("s", grid.ny - 1)):
            value[r] = F.coalesce(value[r], F.when(F.col("j") == edge, F.col(f"{f}_0")))
    return value, place


def _scale(grid: Grid) -> tuple[Column, Column]:
    """Radians of arc for a unit of x and of y."""
    if grid.projection == "lambert":
        per = 1 / (grid.map.scale(F.col("lat")) * grid.map.radius)
        return per, per
    if grid.projection == "schmidt":  # the map is conformal: its scale is that of latitude
        c = grid.map.c
        s = F.sin(F.radians(F.col("y")))
        stretch = 2 * c / ((c * c + 1) + (c * c - 1) * s)
        return F.cos(F.radians(F.col("y"))) * stretch * math.radians(1), stretch * math.radians(1)
    return F.cos(F.radians(F.col("lat"))) * math.radians(1), F.lit(math.radians(1))


def gradient(df: DataFrame, grid: Grid, fields: list[str]) -> DataFrame:
    """ST-GRAD: df with field_dx and field_dy, per radian of arc.

    Centred; one-sided where an arm is missing, 0 where both are and the point has a value, null where it has none and an arm is missing."""
    near = neighbours(df, grid, fields).withColumns({f"{f}_0": F.col(f) for f in fields})
    bx, by = _scale(grid)
    for f in fields:
        value, place = _arms(near, grid, f)
        # As columns, since each is used several times.
        near = near.withColumns({f"_v{s}": c for s, c in value.items()} | {f"_p{s}": c for s, c in place.items()})
        value, place = ({s: F.col(f"_{k}{s}") for s in "ewns"} for k in "vp")
        x0, y0, v0 = F.col("x"), F.col("y"), F.col(f)

        def side(a, b, origin, scale, value=value, place=place, v0=v0):
            va, vb = value[a], value[b]
            pa, pb = F.when(va.isNull(), origin).otherwise(place[a]), F.when(vb.isNull(), origin).otherwise(place[b])
            va, vb = F.coalesce(va, v0), F.coalesce(vb, v0)
            apart = scale * (pa - pb)
            slope = F.when(apart != 0, (va - vb) / F.when(apart != 0, apart))
            return F.when(v0.isNotNull(), F.coalesce(slope, F.lit(0.0))).otherwise(slope)

        near = near.withColumns({f"{f}_dx": side("e", "w", x0, bx), f"{f}_dy": side("n", "s", y0, by)}).drop(*[f"_{k}{s}" for k in "vp" for s in "ewns"])
    return near.select(*df.columns, *[f"{f}_d{a}" for f in fields for a in "xy"])


def half_differences(df: DataFrame, grid: Grid, fields: list[str]) -> DataFrame:
    """ST-HALF: df with field_xp, field_xm, field_yp, field_ym, differences to east, west, north and south, and the distances dxp, dxm, dyp, dym.

    A missing neighbour gives 0, a missing point null."""
    near = neighbours(df, grid, fields).withColumns({f"{f}_0": F.col(f) for f in fields})
    bx, by = _scale(grid)
    out: dict[str, Column] = {}
    for f in fields:
        value, place = _arms(near, grid, f)
        for name, side in (("xp", "e"), ("xm", "w"), ("yp", "n"), ("ym", "s")):
            out[f"{f}_{name}"] = F.when(F.col(f).isNotNull(), F.coalesce(value[side] - F.col(f), F.lit(0.0)))
            origin, scale = (F.col("x"), bx) if name[0] == "x" else (F.col("y"), by)
            out[f"d{name}"] = scale * (F.coalesce(place[side], origin) - origin)
    return near.withColumns(out).select(*df.columns, *out)


def jacobian(grid: Grid) -> tuple[Column, Column, Column, Column]:
    """Unit vectors of the grid's x and y axes in local east and north: (east of x, north of x, east of y, north of y).

    Both maps are conformal, so the axes are turned by one angle: on a cone by its share of the longitude from its centre, on
    a rotated sphere by the bearing of its pole."""
    if grid.projection == "lonlat":
        return F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)
    if grid.projection == "lambert":
        turn = F.radians(wrapped(F.col("lon") - grid.map.lon0)) * grid.map.n
        return F.cos(turn), -F.sin(turn), F.sin(turn), F.cos(turn)
    lon, lat, lon0, lat0 = F.radians("lon"), F.radians("lat"), grid.map.lon, grid.map.lat
    turn = F.atan2(math.cos(lat0) * F.sin(lon0 - lon), F.cos(lat) * math.sin(lat0) - F.sin(lat) * math.cos(lat0) * F.cos(lon0 - lon))
    return F.cos(turn), -F.sin(turn), F.sin(turn), F.cos(turn)


def rotate(df: DataFrame, pairs: list[tuple[str, str]], source: Grid | None = None, target: Grid | None = None) -> DataFrame:
    """ST-ROT: vector fields turned from the axes of the source grid to east and north, and from there to the axes of the target grid."""
    out: dict[str, Column] = {}
    one = (F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))
    a, b = (jacobian(g) if g else one for g in (source, target))
    for u, v in pairs:
        east, north = a[0] * F.col(u) + a[2] * F.col(v), a[1] * F.col(u) + a[3] * F.col(v)
        out |= {u: b[0] * east + b[1] * north, v: b[2] * east + b[3] * north}
    return df.withColumns(out)
