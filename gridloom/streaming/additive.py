"""Regridding of arriving source tiles (an extension): sums, counts, least and largest values of each cell can be added up.

Each micro-batch is reduced to its cells by partial aggregates; Spark keeps one row of state for each cell.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.mapping import cell_of, in_domain
from ..plans.grids import Grid


def cells(tiles: DataFrame, grid: Grid, field: str) -> DataFrame:
    """A streaming or plain table of tiles (lon, lat and the field) as iglo2, n, total, lo, hi, avg so far."""
    mapped = in_domain(cell_of(tiles, grid))
    v = F.col(field)
    return mapped.groupBy("iglo2").agg(F.count(v).alias("n"), F.sum(v).alias("total"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.avg(v).alias("avg"))


def merged(state: DataFrame | None, batch: DataFrame) -> DataFrame:
    """Two tables of iglo2, n, total, lo, hi as one, for states kept by the caller in foreachBatch."""
    both = batch if state is None else state.unionByName(batch)
    out = both.groupBy("iglo2").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return out


def start(tiles: DataFrame, grid: Grid, field: str, name: str, checkpoint: str) -> StreamingQuery:
    """The running table of cells under a name in memory, complete after each batch."""
    return cells(tiles, grid, field).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).start()
