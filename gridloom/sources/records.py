"""Files of sequential records as a data source that seeks, with a partition for each record and band of rows.

The planner walks the record markers, four bytes at a time, and so knows where each field and month stands. Conditions on
field, month, row and column are pushed into the source: records that they exclude are not opened, rows outside are not read, and of a
row only the columns asked for. Nothing holds more than a band of rows, so the size of a file does not matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

#: Points of a partition, about.
BAND = 1_000_000
#: Without it Spark refuses sources that take filters.
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def located(path: str):
    """The file system of a path or URI, and the place in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if ":" in path else "file://" + path)


class Limits:
    """What pushed filters leave: a range of each whole-number column, a set of values of the others."""

    def __init__(self, numbers: tuple[str, ...], names: tuple[str, ...] = ()):
        self.range = {c: [-math.inf, math.inf] for c in numbers}
        self.among: dict[str, set | None] = {c: None for c in (*numbers, *names)}

    def take(self, one: ds.Filter) -> bool:
        """Whether a filter is understood; then it is kept."""
        name = one.attribute[0] if len(getattr(one, "attribute", ())) == 1 else None
        if isinstance(one, ds.IsNotNull):
            return name in self.among
        if name not in self.among:
            return False
        if isinstance(one, (ds.EqualTo, ds.In)):
            values = {one.value} if isinstance(one, ds.EqualTo) else {*one.value}
            before = self.among[name]
            self.among[name] = values if before is None else before & values
            return True
        if name in self.range:
            low, high = self.range[name]
            if isinstance(one, ds.GreaterThanOrEqual):
                self.range[name] = [max(low, one.value), high]
            elif isinstance(one, ds.GreaterThan):
                self.range[name] = [max(low, one.value + 1), high]
            elif isinstance(one, ds.LessThanOrEqual):
                self.range[name] = [low, min(high, one.value)]
            elif isinstance(one, ds.LessThan):
                self.range[name] = [low, min(high, one.value - 1)]
            else:
                return False
            return True
        return False

    def allows(self, name: str, value) -> bool:
        low, high = self.range.get(name, (None, None))
        return (self.among[name] is None or value in self.among[name]) and (low is None or low <= value <= high)

    def span(self, name: str, first: int, n: int) -> tuple[int, int]:
        """First and end of the part of first to first + n - 1 that is asked for; values in between may be excluded singly."""
        low, high = self.range[name]
        among = self.among[name]
        if among is not None:
            good = [v for v in among if low <= v <= high and first <= v < first + n]
            return (min(good), max(good) + 1) if good else (first, first)
        a, b = max(first, low), min(first + n, high + 1)
        return (int(a), int(b)) if a < b else (first, first)


class PushedReader(ds.DataSourceReader):
    """A reader that takes filters on its limits."""

    def __init__(self, options: dict, limits: Limits):
        self.o = {k.lower(): v for k, v in options.items()}
        self.limits = limits

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        for one in filters:
            if not self.limits.take(one):
                yield one


@dataclass
class Part(ds.InputPartition):
    """Rows first to end - 1 of a record whose values start at a byte of a file."""

    path: str
    field: str
    month: int
    start: int
    nx: int
    first: int
    end: int


def records_of(path: str) -> Iterator[tuple[int, int]]:
    """Where the values of each record start and how many bytes they are; the lengths before and after must agree."""
    system, place = located(path)
    size = system.get_file_info(place).size
    with system.open_input_file(place) as file:
        at = 0
        while at < size:
            file.seek(at)
            n = int.from_bytes(file.read(4), "big")
            file.seek(min(size, at + 4 + n))
            if int.from_bytes(file.read(4), "big") != n or at + 8 + n > size:
                raise ValueError(f"record markers differ at byte {at}")
            yield at + 4, n
            at += 8 + n


def files_of(path: str) -> list[str]:
    """The file itself, or the files of a folder."""
    from pyarrow import fs

    system, place = located(path)
    if system.get_file_info(place).type == fs.FileType.Directory:
        found = system.get_file_info(fs.FileSelector(place))
        scheme = path.split(":")[0] + "://" if ":" in path else ""
        return [scheme + f.path for f in sorted(found, key=lambda f: f.path) if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))]
    return [path]


def climate_names(k: int) -> tuple[str, int]:
    """SRC-N108: field and month of the record with number k."""
    return (("LFrac", "OrogG", "IFrac")[k], 0) if k < 3 else (("Temp_g", "Temp_d", "Temp_s")[(k - 3) % 3], (k - 3) // 3 + 1)


class Records(ds.DataSource):
    """SRC-N108, SRC-SOILVEG: records of big-endian doubles; format name gridloom_records.

    Options: path; layout, climate (a record for each block; nx and ny) or single (one record of nx * nx / 2 values, named as its
    file); nodata; bandpoints."""

    @classmethod
    def name(cls) -> str:
        return "gridloom_records"

    def schema(self) -> str:
        return "field string, month int, j int, i int, value double"

    def reader(self, schema) -> ds.DataSourceReader:
        return RecordReader(self.options, Limits(("month", "j", "i"), ("field",)))


class RecordReader(PushedReader):
    def partitions(self) -> list[Part]:
        out = []
        each = int(self.o.get("bandpoints", BAND))
        for path in files_of(self.o["path"]):
            for k, (start, size) in enumerate(records_of(path)):
                if self.o["layout"] == "climate":
                    (field, month), nx, ny = climate_names(k), int(self.o["nx"]), int(self.o["ny"])
                    if size != 8 * nx * ny:
                        raise ValueError(f"record {k} holds {size} bytes, not {ny} rows of {nx} doubles")
                else:
                    field, month, nx = path.rpartition("/")[2], 0, math.isqrt(size // 4)
                    ny = size // 8 // nx if nx else 0
                if self.limits.allows("field", field) and self.limits.allows("month", month):
                    a, b = self.limits.span("j", 0, ny)
                    rows = max(1, each // max(1, nx))
                    out += [Part(path, field, month, start, nx, j, min(j + rows, b)) for j in range(a, b, rows)]
                if self.o["layout"] != "climate":
                    break
        return out

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        if part is None:  # Spark makes one task where a plan has no partition
            return
        left, right = self.limits.span("i", 0, part.nx)
        nodata = float(self.o.get("nodata", "nan"))
        system, place = located(part.path)
        with system.open_input_file(place) as file:
            for j in range(part.first, part.end):
                if right == left or not self.limits.allows("j", j):
                    continue
                file.seek(part.start + 8 * (j * part.nx + left))
                raw = np.frombuffer(file.read(8 * (right - left)), ">f8").astype(float)
                i = np.arange(left, right, dtype=np.int32)
                keep = np.array([self.limits.allows("i", int(x)) for x in i]) if self.limits.among["i"] is not None else slice(None)
                raw, i = raw[keep], i[keep]
                n = len(raw)
                yield pa.RecordBatch.from_arrays([pa.array([part.field] * n), pa.array(np.full(n, part.month, np.int32)), pa.array(np.full(n, j, np.int32)), pa.array(i), pa.array(raw, mask=raw == nodata)], ["field", "month", "j", "i", "value"])


def _load(spark: SparkSession, **options) -> DataFrame:
    spark.dataSource.register(Records)
    spark.conf.set(PUSHDOWN, "true")
    return spark.read.format("gridloom_records").options(**{k: str(v) for k, v in options.items()}).load()


def climate_blocks(spark: SparkSession, path: str, nx: int = 432, ny: int = 216, band: int = BAND) -> DataFrame:
    """SRC-N108: field, month, j, i, value of records of one block each: LFrac, OrogG, IFrac (month 0), then Temp_g, Temp_d, Temp_s for each month.

    Conditions on field, month, j and i limit what is read."""
    return _load(spark, path=path, layout="climate", nx=nx, ny=ny, bandpoints=band)


def soil_and_vegetation(spark: SparkSession, path: str, nodata: float = -9999.0, band: int = BAND) -> DataFrame:
    """SRC-SOILVEG: field (the file's name), j, i, value from one record of 2 n^2 big-endian doubles in a file or in each file of a folder; the sentinel is missing."""
    return _load(spark, path=path, layout="single", nodata=nodata, bandpoints=band).drop("month")


def clipped(df: DataFrame, top: int, height: int, left: int, width: int) -> DataFrame:
    """SRC-CLIP as conditions on rows and columns, which the source takes."""
    return df.where(F.col("j").between(top, top + height - 1) & F.col("i").between(left, left + width - 1))
