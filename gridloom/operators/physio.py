"""Surface description: terrain tensors, obstacle slopes, fractions, and filling of initial states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fields as fx
from ..functions.geometry import EARTH_RADIUS
from ..plans.grids import Grid
from . import covers
from .mapping import cell_of, corners, in_domain, resolution, weighted
from .regrid import regrid
from .stencil import gradient, half_differences, rotate


def to_cells(source: DataFrame, target: Grid) -> DataFrame:
    """Source points with their target cell iglo2, and iglo1 for their own key."""
    return in_domain(cell_of(source.withColumnRenamed("iglo", "iglo1"), target))


def with_slopes(source: DataFrame, grid: Grid, target: Grid, height: str = "zs", turned: bool = False) -> DataFrame:
    """source with PRODUCTS, of the slopes in metres per metre and of the height. turned: slopes along the target's axes instead of the source's."""
    slopes = gradient(source, grid, [height])
    if turned:
        slopes = rotate(slopes, [(f"{height}_dx", f"{height}_dy")], grid, target)
    dx, dy, h = F.col(f"{height}_dx") / EARTH_RADIUS, F.col(f"{height}_dy") / EARTH_RADIUS, F.col(height)
    return slopes.withColumns({"dxdx": dx * dx, "dydy": dy * dy, "dxdy": dx * dy, "square": h * h}).drop(f"{height}_dx", f"{height}_dy")


PRODUCTS = ("dxdx", "dydy", "dxdy", "square")


def shape(avg: str) -> dict[str, Column]:
    """dir, slope, anis and stdev of cells with the means of PRODUCTS and of the height."""
    known = F.col(avg).isNotNull()
    found = {n: F.when(known, c) for n, c in fx.tensor(F.col("dxdx"), F.col("dydy"), F.col("dxdy")).items()}
    return found | {"stdev": fx.deviation(F.col(avg), F.col("square"))}


def terrain_tensor(source: DataFrame, grid: Grid, target: Grid, height: str = "zs", turned: bool = False) -> DataFrame:
    """Subgrid relief of each target cell: iglo2, dir, slope, anis, stdev, avg, from slopes of the source's heights in metres per metre.

    turned: slopes along the target's axes instead of the source's."""
    products = to_cells(with_slopes(source, grid, target, height, turned), target).withColumn("avg", F.col(height))
    means = regrid(products, dict.fromkeys((*PRODUCTS, "avg"), "avg"))
    return means.select("iglo2", *[c.alias(n) for n, c in shape("avg").items()], "avg")


def cell_summary(cells: DataFrame, averages: list[str], extremes: list[str], table: DataFrame, names: list[str], sea_class: int | None = None, key: str = "iglo2") -> DataFrame:
    """All that a target cell needs of its source points, in one pass: the means of fields, the least and largest of some, the mean class parameters and the share of one class.

    Points are summed by cell and class first, so what meets for a cell is a row for each of its classes. Columns: key, the averages
    under their names, field_min and field_max, names, and _sea."""
    sums = [c for f in averages for c in (F.sum(f).alias(f"s_{f}"), F.count(f).alias(f"n_{f}"))]
    ends = [c for f in extremes for c in (F.min(f).alias(f"{f}_min"), F.max(f).alias(f"{f}_max"))]
    per = cells.groupBy(key, covers.checked(F.col("cover")).alias("cover")).agg(F.count("*").alias("n"), *sums, *ends)
    known = per.join(F.broadcast(table.select("cover", *names, F.lit(True).alias("_known"))), "cover", "left")  # some hundred classes
    share = F.when(F.col("_known"), F.col("n"))
    whole = F.when(F.col("cover").isNotNull(), F.col("n"))
    out = [F.try_divide(F.sum(f"s_{f}"), F.sum(f"n_{f}")).alias(f) for f in averages]
    out += [g(f"{f}_{e}").alias(f"{f}_{e}") for f in extremes for e, g in (("min", F.min), ("max", F.max))]
    out += [F.try_divide(F.sum(share * F.col(p)), F.sum(share)).alias(p) for p in names]
    if sea_class is not None:
        out.append(F.try_divide(F.sum(F.when(F.col("cover") == sea_class, F.col("n"))), F.sum(whole)).alias("_sea"))
    return known.groupBy(key).agg(*out)


def above_means(source: DataFrame, grid: Grid, means: DataFrame, target: Grid, height: str) -> DataFrame:
    """Source points with diff, their height above the target's means as interpolated to them; the source is read once.

    Each point goes to its corners with all that is needed of it, and comes back together with them."""
    keep = ["iglo", "j", "i", "x", "y", "lon", "lat", height]
    placed = weighted(corners(source.select(*keep), target), resolution(grid, F.col("j"), F.col("i")))
    each = placed.select(*keep, F.explode_outer(F.arrays_zip("corners", "weights")).alias("c"))
    each = each.select(*keep, F.col("c.corners.iglo").alias("iglo1"), F.col("c.weights").alias("w"))
    met = each.join(means.select(F.col("iglo").alias("iglo1"), F.col("avg").alias("mean")), "iglo1", "left")
    top = F.sum(F.when(F.col("w") != 0, F.col("w") * F.col("mean")))
    below = F.sum(F.when(F.col("mean").isNotNull(), F.col("w")))
    back = met.groupBy("iglo").agg(*[F.first(c).alias(c) for c in keep[1:]], F.when(below > 0, top / below).alias("smooth"))
    return back.withColumn("diff", fx.difference(F.col(height), F.col("smooth")))


def obstacles(source: DataFrame, grid: Grid, means: DataFrame, target: Grid, height: str = "zs") -> DataFrame:
    """Slopes and half heights of obstacles above each cell's interpolated mean: iglo2, aos_ and ho2_ with ip, im, jp, jm.

    Half heights are half the rise to the east and north, and half the fall to the west and south.

    means: iglo and avg of the target. Differences of the source from the mean surface, then their half differences, are
    averaged over the cells."""
    above = above_means(source, grid, means, target, height)
    half = half_differences(above, grid, ["diff"])
    out = []
    for name, side in (("ip", "xp"), ("im", "xm"), ("jp", "yp"), ("jm", "ym")):
        rise, away = F.col(f"diff_{side}"), F.col(f"d{side}") * EARTH_RADIUS
        out += [fx.positive_slope(rise, away).alias(f"aos_{name}"), fx.half_height(rise, falls=name in ("im", "jm")).alias(f"ho2_{name}")]
    cells = to_cells(half.select("iglo", "lon", "lat", *out), target)
    return regrid(cells, dict.fromkeys([f"{k}_{n}" for k in ("aos", "ho2") for n in ("ip", "im", "jp", "jm")], "avg"))
