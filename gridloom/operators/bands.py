"""Neighbours of points on reduced and Gaussian grids, by bands of rows.

Consecutive rows make a band of some BAND points. A band is a partition of its own and holds, besides its rows, a copy of the
row before and of the row after: the halo. So each point travels once, those of a band's outer rows twice, and every neighbour
is found in place, as a computed position within the band. Nothing is grouped or joined back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..plans.grids import Grid

#: Points of a band, about; a row is never cut, so a band has a row at least.
BAND = 200_000
SIDES = ("w", "e", "nw", "ne", "sw", "se")


def band_of_rows(grid: Grid, points: int = BAND) -> np.ndarray:
    """The number of each row's band, from 0 without gaps."""
    starts = np.concatenate([[0], np.cumsum(grid.nx)[:-1]])
    return np.unique(starts // points, return_inverse=True)[1]


def dealt(df: DataFrame, grid: Grid, points: int = BAND) -> DataFrame:
    """df with _band and _own: a row for each point in its band, and one in each band that has it as halo; a partition for each band."""
    band = band_of_rows(grid, points)
    table = [(j, int(band[j]), sorted({int(b) for b in band[max(0, j - 1) : j + 2]})) for j in range(grid.ny)]
    rows = df.sparkSession.createDataFrame(table, "j int, _at int, _bands array<int>")  # a row for each latitude
    each = df.join(F.broadcast(rows), "j").select(*df.columns, "_at", F.explode("_bands").alias("_band"))
    return each.withColumn("_own", F.col("_band") == F.col("_at")).drop("_at").repartitionById(int(band[-1]) + 1, F.col("_band"))


def neighbours(df: DataFrame, grid: Grid, fields: list[str], points: int = BAND) -> DataFrame:
    """df with, for each field, its values at w, e, nw, ne, sw and se, and with xw, xe, xnw and so on, yn and ys.

    df has a row for each point at most, with iglo, j, i, x and y; a neighbour that is outside the grid or has no row is null."""
    nx, xmin, dx = np.array(grid.nx), np.array(grid.xmin), np.array(grid.dx)
    off = np.concatenate([[0], np.cumsum(nx)])
    ny, around, columns = grid.ny, grid.is_global, df.columns

    def key(j: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Numbers of the points at these places of rows, -1 where there is none."""
        there = (j >= 0) & (j < ny)
        j = np.where(there, j, 0)
        if around:
            return np.where(there, off[j] + np.mod(at, nx[j]), -1)
        return np.where(there & (at >= 0) & (at < nx[j]), off[j] + at, -1)

    def stencil(band: pa.Table) -> pa.RecordBatch:
        iglo = band.column("iglo").to_numpy()
        low = int(iglo.min())
        slot = np.full(int(iglo.max()) - low + 1, -1)
        slot[iglo - low] = np.arange(len(iglo))
        own = np.flatnonzero(band.column("_own").to_numpy(zero_copy_only=False))
        j, i, x = (band.column(c).to_numpy()[own] for c in ("j", "i", "x"))
        keys = {"w": key(j, i - 1), "e": key(j, i + 1)}
        for r, row in (("n", j - 1), ("s", j + 1)):
            safe = np.clip(row, 0, ny - 1)
            west = np.floor((x - xmin[safe]) / dx[safe]).astype(np.int64)
            keys |= {f"{r}w": key(row, west), f"{r}e": key(row, west + 1)}
        places = {}
        for side, k in keys.items():
            inside = (k >= low) & (k - low < len(slot))
            found = np.where(inside, slot[np.where(inside, k - low, 0)], -1)
            places[side] = pa.array(found, mask=found < 0)
        out = {c: band.column(c).take(pa.array(own)) for c in columns}
        for s in SIDES:
            out |= {f"{c}_{s}": band.column(c).take(places[s]) for c in fields}
            out[f"x{s}"] = band.column("x").take(places[s])
        for r in ("n", "s"):
            out[f"y{r}"] = pc.coalesce(*[band.column("y").take(places[r + side]) for side in "we"])
        return pa.Table.from_pydict(out).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]  # a band with its halo, whose size is bounded
        if held:
            yield from stencil(pa.Table.from_batches(held).combine_chunks())

    named = [f for s in SIDES for f in [*[StructField(f"{c}_{s}", df.schema[c].dataType) for c in fields], StructField(f"x{s}", DoubleType())]]
    schema = StructType([*df.schema.fields, *named, StructField("yn", DoubleType()), StructField("ys", DoubleType())])
    return dealt(df, grid, points).mapInArrow(run, schema)
