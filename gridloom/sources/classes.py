"""SRC-COVERS: the land-cover class table, a file of direct-access records of 20 big-endian doubles.

A class takes a varying number of records, which its own values tell: its number; its four shares; natural parts (shares of
the vegetation types, soil albedos, and for each type with a share its depths, leaf area and albedos by ten days, tree height
and irrigation) where it has nature, or a garden; eighteen records of town parameters where it has a town. Two layouts are
known: layout 1 holds one year of leaf area, layout 2 five. Some hundred classes, decoded on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

RECORD = 160
#: Vegetation types, ten-day spells of a year, years of layout 2, the type of rock, values of bare types.
TYPES, SPELLS, YEARS, ROCK, BARE_NIR, BARE_VIS = 19, 36, 5, 2, 0.3, 0.1
TOWN = ("z0_town", "bld_height", "wall_o_hor", "bld", "garden")
SURFACES = ("roof", "road", "wall")
TRAFFIC = ("h_traffic", "le_traffic", "h_industry", "le_industry")
TYPE = ("root_depth", "ground_depth", "dice")
SCHEMA = ", ".join([
    "cover int, town double, nature double, water double, sea double",
    *[f"{n} double" for n in TOWN],
    *[f"{k}_{s} double" for k in ("alb", "emis") for s in SURFACES],
    *[f"{k}_{s} array<double>" for k in ("hc", "tc", "d") for s in SURFACES],
    *[f"{n} double" for n in TRAFFIC],
    "alb_soil_nir array<double>, alb_soil_vis array<double>",
    "types array<struct<type:int,share:double,root_depth:double,ground_depth:double,dice:double,lai:array<double>,h_tree:double,alb_veg_nir:array<double>,alb_veg_vis:array<double>,seed_month:int,seed_day:int,reap_month:int,reap_day:int,watsup:double,irrig:double>>",
])


def has_trees(kind: int) -> bool:
    """Types with a tree height."""
    return kind < 7 or 12 < kind != 18


class Reader:
    """The file's records in order."""

    def __init__(self, data: bytes, layout: int):
        self.data, self.at, self.layout = data, 0, layout

    def raw(self) -> bytes:
        self.at += RECORD
        if self.at > len(self.data):
            raise ValueError(f"the class table ends in record {self.at // RECORD}")
        return self.data[self.at - RECORD : self.at]

    def doubles(self, n: int) -> list[float]:
        return np.frombuffer(self.raw()[: 8 * n], ">f8").tolist()

    def spells(self, years: int = 1) -> list[float]:
        return [v for _ in range(3 * years) for v in self.doubles(12)]

    def vegetation_type(self, kind: int, share: float, albedos: bool) -> dict:
        out = dict(zip(TYPE, self.doubles(3))) | {"type": kind, "share": share}
        years = 1 if self.layout == 1 else YEARS
        if kind > 3:
            out["lai"] = self.spells(years)
            if has_trees(kind):
                out["h_tree"] = self.doubles(1)[0]
            if albedos:
                out["alb_veg_nir"], out["alb_veg_vis"] = self.spells(), self.spells()
        else:
            out |= {"lai": [0.0] * SPELLS * years, "alb_veg_nir": [BARE_NIR] * SPELLS, "alb_veg_vis": [BARE_VIS] * SPELLS}
        if kind == (8 if self.layout == 1 else 9):
            dates = self.raw()
            out |= dict(zip(("seed_month", "seed_day", "reap_month", "reap_day"), np.frombuffer(dates[:16], ">i4").tolist()))
            out |= dict(zip(("watsup", "irrig"), np.frombuffer(dates[16:32], ">f8").tolist()))
        return out

    def natural(self, nature: float) -> dict:
        shares, out = self.doubles(TYPES), {}
        if nature != 0:
            out["alb_soil_nir"], out["alb_soil_vis"] = self.spells(), self.spells()
        return out | {"types": [self.vegetation_type(k, s, nature != 0) for k, s in enumerate(shares, 1) if s != 0]}

    def town(self) -> dict:
        out = dict(zip(TOWN, self.doubles(5)))
        for kind in ("alb", "emis"):
            out |= dict(zip((f"{kind}_{s}" for s in SURFACES), self.doubles(3)))
        for kind in ("hc", "tc", "d"):
            out |= {f"{kind}_{s}": self.doubles(3) for s in SURFACES}
        return out | dict(zip(TRAFFIC, self.doubles(4)))

    def classes(self, n: int) -> Iterator[dict]:
        for _ in range(n):
            out = {"cover": int.from_bytes(self.raw()[:4], "big")}
            out |= dict(zip(("town", "nature", "water", "sea"), self.doubles(4)))
            if out["nature"] != 0:
                out |= self.natural(out["nature"])
            if out["town"] != 0:
                out |= self.town()
                if out["garden"] != 0 and out["nature"] == 0:
                    out |= self.natural(0.0)
            yield out


def class_parameters(spark: SparkSession, data: bytes, n: int, layout: int = 1) -> DataFrame:
    """A row of SCHEMA for each of the file's n classes; what a class does not have is null."""
    return spark.createDataFrame(list(Reader(data, layout).classes(n)), SCHEMA)
