"""Readers of the file formats that hold source fields, as distributed scans; sentinels become nulls at the scan."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..plans.grids import Grid, uniform
from .records import PUSHDOWN, Limits, PushedReader, clipped, climate_blocks, located, soil_and_vegetation

__all__ = ["climate_blocks", "soil_and_vegetation"]


@dataclass(frozen=True)
class Header:
    nodata: float
    north: float
    south: float
    west: float
    east: float
    rows: int
    cols: int
    bits: int

    def grid(self) -> Grid:
        """Points at cell centres, the first row in the north."""
        dx, dy = (self.east - self.west) / self.cols, (self.north - self.south) / self.rows
        return uniform(self.cols, self.rows, self.west + dx / 2, dx, self.north - dy / 2, -dy, abs(self.east - self.west - 360) < 1e-6)

    def clip(self, west: float, east: float, south: float, north: float, margin: float = 1.0) -> tuple[int, int, int, int]:
        """SRC-CLIP: first row, rows, first column and columns that touch the box and a margin, even in number where there is room."""
        dx, dy = (self.east - self.west) / self.cols, (self.north - self.south) / self.rows
        out = []
        for low, high, first, step, n in ((self.north - north - margin, self.north - south + margin, 0.0, dy, self.rows), (west - margin - self.west, east + margin - self.west, 0.0, dx, self.cols)):
            a = max(0, int(np.floor(low / step)))
            b = min(n, int(np.ceil(high / step)))
            if (b - a) % 2:
                a, b = (a, b + 1) if b < n else (max(0, a - 1), b)
            out += [a, max(0, b - a)]
        return tuple(out)


def header(text: str) -> Header:
    """SRC-HDR: keys and values after a comment line; a negative sentinel of 8-bit data counts from 256."""
    found = {m[1].lower(): m[2] for m in re.finditer(r"^\s*(\w+)\s*:\s*(.*?)\s*$", text, re.M)}
    bits = int(re.search(r"(\d+)\s*bit", found["recordtype"])[1])
    nodata = float(found.get("nodata", -9999))
    return Header(nodata + 256 if bits == 8 and nodata < 0 else nodata, *(float(found[k]) for k in ("north", "south", "west", "east")), int(found["rows"]), int(found["cols"]), bits)


def read_header(spark: SparkSession, path: str) -> Header:
    """Of a .hdr file that any of Spark's file systems holds; a few lines."""
    return header("\n".join(r[0] for r in spark.read.text(path).collect()))


class RowBands(DataSource):
    """SRC-DH: big-endian rasters of 8 or 16 bits, read in bands of rows by seeking; format name gridloom_raster.

    Options: path, rows, cols, bits, nodata, scale, bandpoints. Conditions on j and i limit the bands and the bytes that are read."""

    @classmethod
    def name(cls) -> str:
        return "gridloom_raster"

    def schema(self) -> str:
        return "j int, i int, value double"

    def reader(self, schema) -> DataSourceReader:
        return _BandReader(self.options, Limits(("j", "i")))


@dataclass
class _Band(InputPartition):
    first: int
    rows: int


class _BandReader(PushedReader):
    def number(self, key: str, default: float) -> float:
        return float(self.o.get(key, default))

    def partitions(self):
        cols = int(self.number("cols", 0))
        top, end = self.limits.span("j", 0, int(self.number("rows", 0)))
        each = max(1, int(self.number("bandpoints", 4_000_000)) // max(1, cols))
        return [_Band(j, min(each, end - j)) for j in range(top, end, each)]

    def read(self, band):
        if band is None:  # Spark makes one task where a plan has no partition
            return
        cols, size = int(self.number("cols", 0)), int(self.number("bits", 16)) // 8
        left, right = self.limits.span("i", 0, cols)
        nodata, scale = self.number("nodata", float("nan")), self.number("scale", 1.0)
        system, place = located(self.o["path"])
        with system.open_input_file(place) as file:
            for j in range(band.first, band.first + band.rows):
                if right == left or not self.limits.allows("j", j):
                    continue
                file.seek((j * cols + left) * size)
                raw = np.frombuffer(file.read((right - left) * size), "u1" if size == 1 else ">i2").astype(float)
                i = np.arange(left, left + len(raw), dtype=np.int32)
                if self.limits.among["i"] is not None:
                    keep = np.isin(i, [*self.limits.among["i"]])
                    raw, i = raw[keep], i[keep]
                value = pa.array(raw * scale, mask=raw == nodata)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(raw), j, np.int32)), pa.array(i), value], ["j", "i", "value"])


def raster(spark: SparkSession, path: str, head: Header, scale: float = 1.0, box: tuple[float, float, float, float] | None = None, band: int = 4_000_000) -> DataFrame:
    """j, i, value of a .dir file; scale applies to what is not missing. box: west, east, south and north of what is wanted, as conditions that the source takes."""
    spark.dataSource.register(RowBands)
    spark.conf.set(PUSHDOWN, "true")
    options = {"path": path, "rows": head.rows, "cols": head.cols, "bits": head.bits, "nodata": head.nodata, "scale": scale, "bandpoints": band}
    df = spark.read.format("gridloom_raster").options(**{k: str(v) for k, v in options.items()}).load()
    return clipped(df, *head.clip(*box)) if box else df


def ozone(spark: SparkSession, path: str, month: int | None = None) -> DataFrame:
    """SRC-OZONE: lon, lat, a, b, c and month, from text rows; the month is the file name's .mNN unless given."""
    df = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    part = F.split(F.trim("value"), r"\s+")
    found = F.regexp_extract(F.col("_metadata.file_name"), r"\.m(\d\d)", 1)
    number = F.lit(month) if month is not None else F.when(found != "", found.cast("int"))
    return df.select(*[F.get(part, k).cast("double").alias(n) for k, n in enumerate(("lon", "lat", "a", "b", "c"))], number.cast("int").alias("month"))


AEROSOLS = ("sea", "land", "soot", "desert")


def aerosols(spark: SparkSession, path: str, nx: int = 72, ny: int = 45, skip: int = 24) -> DataFrame:
    """SRC-AERO: j, i and four fields; after the header lines all values of one field stand before the next's, by columns. A file is a few thousand numbers."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for text in batch["value"]:
                numbers = np.array(" ".join(text.splitlines()[skip:]).replace("D", "e").split(), float)[: nx * ny * 4].reshape(4, nx * ny)
                at = np.arange(nx * ny)
                yield pd.DataFrame({"j": at // nx, "i": at % nx, **dict(zip(AEROSOLS, numbers))})

    return spark.read.text(path, wholetext=True).mapInPandas(decode, "j int, i int, " + ", ".join(f"{n} double" for n in AEROSOLS))


def unit_sphere(points: DataFrame) -> DataFrame:
    """SRC-SYN-XYZ: unit-sphere coordinates with their exact derivatives by degree of longitude and latitude."""
    a, b, r = F.radians("lon"), F.radians("lat"), float(np.pi / 180)
    ca, sa, cb, sb = F.cos(a), F.sin(a), F.cos(b), F.sin(b)
    return points.withColumns({
        "fx": cb * ca, "fy": cb * sa, "fz": sb,
        "fx_dlon": -cb * sa * r, "fy_dlon": cb * ca * r, "fz_dlon": F.lit(0.0),
        "fx_dlat": -sb * ca * r, "fy_dlat": -sb * sa * r, "fz_dlat": cb * r,
    })
