import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.plans import grids
from gridloom.sources import rasters, sinks
from gridloom.streaming import additive

HDR = "a comment\nnodata: -9\nnorth: 90\nsouth: -90\nwest: -180\neast: 180\nrows: 18\ncols: 36\nrecordtype: integer 16 bits\n"


def record(data: bytes) -> bytes:
    return struct.pack(">i", len(data)) + data + struct.pack(">i", len(data))


def test_header():
    h = rasters.header(HDR)
    assert (h.rows, h.cols, h.bits, h.nodata) == (18, 36, 16, -9.0) and h.grid().is_global
    assert rasters.header(HDR.replace("16 bits", "8 bits")).nodata == 247
    top, height, left, width = h.clip(0, 10, 40, 50)
    assert height % 2 == 0 and width % 2 == 0 and top <= 3 and top + height >= 6


def test_raster(spark, tmp_path):
    h = rasters.header(HDR)
    v = np.arange(18 * 36).reshape(18, 36)
    v[3, 4] = -9
    (tmp_path / "a.dir").write_bytes(v.astype(">i2").tobytes())
    (tmp_path / "a.hdr").write_text(HDR)
    assert rasters.read_header(spark, str(tmp_path / "a.hdr")) == h
    got = {(r["j"], r["i"]): r["value"] for r in rasters.raster(spark, str(tmp_path / "a.dir"), h, 0.01).collect()}
    assert len(got) == 648 and got[3, 4] is None and got[17, 35] == pytest.approx(6.47)
    part = rasters.raster(spark, str(tmp_path / "a.dir"), h, box=(0, 10, 40, 50))
    assert 0 < part.count() < 100 and part.where("j = 4 and i = 18").first()["value"] == 162


def test_text_sources(spark, tmp_path):
    (tmp_path / "abc_coef.m03").write_text(" 0.0 10.0 1 2 3\n\n 5.0 10.0 4 5 6\n")
    assert [tuple(r) for r in rasters.ozone(spark, str(tmp_path / "abc_coef.m03")).collect()] == [(0.0, 10.0, 1.0, 2.0, 3.0, 3), (5.0, 10.0, 4.0, 5.0, 6.0, 3)]
    (tmp_path / "aero").write_text("h\n" * 2 + "\n".join(str(k) for k in range(24)))
    got = rasters.aerosols(spark, str(tmp_path / "aero"), nx=3, ny=2, skip=2).orderBy("j", "i").collect()
    assert tuple(got[4]) == (1, 1, 4.0, 10.0, 16.0, 22.0)


def test_binary_sources(spark, tmp_path):
    blocks = [np.full(6, float(k)) for k in range(9)]
    (tmp_path / "n").write_bytes(b"".join(record(b.astype(">f8").tobytes()) for b in blocks))
    got = {(r["field"], r["month"]) for r in rasters.climate_blocks(spark, str(tmp_path / "n"), 3, 2).where("j = 0 and i = 0").collect()}
    assert got == {("LFrac", 0), ("OrogG", 0), ("IFrac", 0), ("Temp_g", 1), ("Temp_d", 1), ("Temp_s", 1), ("Temp_g", 2), ("Temp_d", 2), ("Temp_s", 2)}
    v = np.arange(8, dtype=float)
    v[5] = -9999
    (tmp_path / "wpl_GL").write_bytes(record(v.astype(">f8").tobytes()))
    got = rasters.soil_and_vegetation(spark, str(tmp_path / "wpl_GL")).orderBy("j", "i").collect()
    assert got[5]["value"] is None and got[7]["value"] == 7.0 and got[0]["field"] == "wpl_GL" and got[4]["j"] == 1


def test_sinks(spark, tmp_path):
    p = grids.named("S6x3").points(spark).withColumns({"a": F.lit(1.0), "b": F.lit(None).cast("double"), "month": F.col("j") + 1})
    assert len(sinks.write_batches(p, str(tmp_path / "w"), ["a", "b"], each=1, writers=1)) == 2
    sinks.write_months(p, str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).where("month = 2").count() == 6
    assert sinks.with_sentinel(p, ["b"], 9e9).where("b = 9e9").count() == 18
    held = sinks.keep_point(None, p, 3, 0)
    held = sinks.keep_point(held, p, 4, 1)
    assert sorted(r["iglo"] for r in held.collect()) == [0, 1]
    assert sinks.flipped(p, 3).where("iglo = 0").first()["j"] == 2
    sinks.discard(p)


def test_streaming(spark, tmp_path):
    rows = spark.range(200).select((F.col("id") % 36 * 10.0).alias("lon"), (F.col("id") % 17 * 10.0 - 80).alias("lat"), F.col("id").cast("double").alias("v"))
    rows.where("v < 100").write.parquet(str(tmp_path / "in/a"))
    rows.where("v >= 100").write.parquet(str(tmp_path / "in/b"))
    grid = grids.named("S12x6")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    run = additive.start(stream, grid, "v", "tiles", str(tmp_path / "ck"))
    run.processAllAvailable()
    run.stop()
    whole = sorted(tuple(r) for r in additive.cells(rows, grid, "v").collect())
    assert sorted(tuple(r) for r in spark.table("tiles").collect()) == whole
    two = additive.merged(additive.cells(rows.where("v < 90"), grid, "v").drop("avg"), additive.cells(rows.where("v >= 90"), grid, "v").drop("avg"))
    assert sorted(tuple(r) for r in two.select("iglo2", "n", "total", "lo", "hi").collect()) == [r[:5] for r in whole]
