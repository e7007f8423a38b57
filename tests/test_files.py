"""Record sources with pushed filters, writers with commit and abort, and streams of bits."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.plans import grids
from gridloom.sources import bits, packing, rasters, records, sinks, writers


def record(data: bytes) -> bytes:
    return struct.pack(">i", len(data)) + data + struct.pack(">i", len(data))


def doubles(v) -> bytes:
    return record(np.asarray(v).astype(">f8").tobytes())


def test_one_month_opens_one_record(spark, tmp_path):
    """Conditions reach the source: one partition for the band asked for, and values outside are never read."""
    nx, ny = 6, 8
    path = tmp_path / "n108"
    path.write_bytes(b"".join(doubles(np.arange(nx * ny) + 100 * k) for k in range(9)))
    every = rasters.climate_blocks(spark, str(path), nx, ny, band=12)
    assert every.rdd.getNumPartitions() == 9 * 4 and every.count() == 9 * nx * ny
    one = every.where("field = 'Temp_d' and month = 2 and j >= 3 and j < 5 and i between 1 and 3")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan.replace("PushedFilters", "")
    assert one.rdd.getNumPartitions() == 1
    assert sorted((r["j"], r["i"], r["value"]) for r in one.collect()) == [(j, i, 700.0 + j * nx + i) for j in (3, 4) for i in (1, 2, 3)]
    assert every.where("field = 'Temp_d' and month in (1, 2) and i in (0, 5) and j = 7 and value > 745").count() == 1
    assert every.where("month = 13").count() == 0 and every.where("j > 100").count() == 0
    # Where the source is told so, the damaged part of a file is not touched.
    data = bytearray(path.read_bytes())
    broken = tmp_path / "short"
    broken.write_bytes(bytes(data[:-20]))
    with pytest.raises(Exception, match="record markers differ"):
        rasters.climate_blocks(spark, str(broken), nx, ny).count()
    with pytest.raises(Exception, match="not 9 rows of 6"):
        rasters.climate_blocks(spark, str(path), nx, 9).count()


def test_a_box_is_pushed_into_rasters(spark, tmp_path):
    v = np.arange(18 * 36, dtype=">i2").reshape(18, 36)
    path = tmp_path / "a.dir"
    path.write_bytes(v.tobytes()[: 2 * 36 * 9])  # the southern half is missing
    head = rasters.header("x\nnodata: -9999\nnorth: 90\nsouth: -90\nwest: 0\neast: 360\nrows: 18\ncols: 36\nrecordtype: integer 16 bits\n")
    part = rasters.raster(spark, str(path), head, box=(0, 10, 40, 50), band=72)
    assert part.rdd.getNumPartitions() < 9 and part.where("j = 4 and i = 1").first()["value"] == 145
    assert part.count() == part.select("j").distinct().count() * part.select("i").distinct().count()


def test_single_records_of_a_folder(spark, tmp_path):
    for name, n in (("vgx_GL", 8), ("dpr_GL", 32)):
        v = np.arange(n, dtype=float)
        v[3] = -9999
        (tmp_path / name).write_bytes(doubles(v))
    rows = rasters.soil_and_vegetation(spark, str(tmp_path), band=4)
    assert rows.groupBy("field").count().orderBy("field").collect() == [("dpr_GL", 32), ("vgx_GL", 8)]
    assert rows.where("value is null").count() == 2 and rows.where("field = 'dpr_GL'").rdd.getNumPartitions() == 4


def test_batches_are_written_in_one_pass(spark, tmp_path):
    """The input is computed once for three batches; each folder has its fields; nothing temporary stays."""
    seen = spark.sparkContext.accumulator(0)

    def count(rows):
        for r in rows:
            seen.add(r.num_rows)
            yield r

    p = grids.named("S6x3").points(spark).select("iglo", *[(F.col("iglo") * k * 1.0).alias(f"f{k}") for k in range(5)], F.lit(None).cast("double").alias("none"))
    counted = p.mapInArrow(count, p.schema)
    places = sinks.write_batches(counted, str(tmp_path / "w"), ["f0", "f1", "f2", "f3", "f4", "none"], each=2, writers=3)
    assert seen.value == 18 and len(places) == 3 and not list((tmp_path / "w").glob("_*"))
    assert spark.read.parquet(places[1]).columns == ["iglo", "f2", "f3"]
    last = {r["iglo"]: tuple(r) for r in spark.read.parquet(places[2]).collect()}
    assert len(last) == 18 and last[4] == (4, 16.0, None)
    again = sinks.write_batches(p.where("iglo < 2"), str(tmp_path / "w2"), ["f1"], each=2)
    assert spark.read.parquet(again[0]).count() == 2
    with pytest.raises(ValueError):
        sinks.write_batches(p.withColumnRenamed("f1", "a,b"), str(tmp_path / "w3"), ["a,b"])


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    def fail(rows):
        for r in rows:
            yield r
            raise ValueError("lost")

    p = grids.named("S6x3").points(spark).select("iglo", F.lit(1.0).alias("v"))
    with pytest.raises(Exception, match="lost"):
        sinks.write_batches(p.mapInArrow(fail, p.schema), str(tmp_path / "w"), ["v"], writers=2)
    assert not list((tmp_path / "w").rglob("*.parquet")) and not list((tmp_path / "w").glob("batch=*"))


@pytest.mark.parametrize("positioned", [True, False])
def test_a_record_by_many_tasks(spark, tmp_path, monkeypatch, positioned):
    """The bytes of one stream, whether tasks write into one file or parts are put together; keys need not be dense."""
    monkeypatch.setattr(writers, "SPAN", 16)
    n = 300
    df = spark.range(n).select((F.col("id") * 3 + 5).alias("iglo"), F.when(F.col("id") % 7 != 3, F.col("id") * 0.5).alias("v")).repartition(5)
    (tmp_path / "out").mkdir()
    if not positioned:
        monkeypatch.setattr(writers.RecordWriter, "positioned", lambda self: False)
        # The writer is made in a process of its own: only its parts can be tested here.
        own = writers.RecordWriter({"path": str(tmp_path / "out"), "job": "x", "file": "r", "count": "4", "nodata": "-1"}, False)
        from pyspark import TaskContext

        monkeypatch.setattr(TaskContext, "get", classmethod(lambda cls: None))
        import pyarrow as pa

        batch = lambda at, v: pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(v, pa.float64())], ["at", "value"])
        later = own.write(iter([batch([2], [None]), batch([3], [4.0])]))
        earlier = own.write(iter([batch([0, 1], [1.0, 2.0])]))
        own.commit([later, None, earlier])
        assert (tmp_path / "out/r").read_bytes() == doubles([1.0, 2.0, -1.0, 4.0]) and len(list((tmp_path / "out").iterdir())) == 1
        return
    got = sinks.write_record(df, str(tmp_path / "out/vgx_GL"), "v").collect()
    assert got[0]["n_values"] == n
    want = [k * 0.5 if k % 7 != 3 else -9999.0 for k in range(n)]
    assert (tmp_path / "out/vgx_GL").read_bytes() == doubles(want) and len(list((tmp_path / "out").iterdir())) == 1
    sinks.write_record(df.where("iglo < 0"), str(tmp_path / "out/none"), "v").collect()
    assert (tmp_path / "out/none").read_bytes() == bytes(8)


def test_bit_streams():
    rnd = np.random.default_rng(0)
    for n in (0, 1, 2, 3, 31, 33, 5000):
        for high in (1, 2, 255, 1 << 24, 1 << 52):
            v, width = rnd.integers(0, high, n), max(1, int(high - 1).bit_length())
            stream = bits.packed(v, width)
            assert len(stream) == -(-n * width // 8) and (bits.unpacked(stream, n, width) == v).all()
            for order in (0, 1, 2):
                assert (bits.from_second_order(bits.second_order(v, order), n) == v).all()
    with pytest.raises(ValueError):
        bits.unpacked(b"12", 3, 8)
    wave = (5000 + 3000 * np.sin(np.arange(65536) / 300)).astype(int)
    assert len(bits.best_order(wave)) < 0.2 * len(bits.packed(wave, 13))


def test_stored_blocks(spark):
    """Bytes follow the bits of a value; bitmaps only where values are missing; damaged blocks are refused; second order is smaller at the same step."""
    n = 40_000
    df = spark.range(n).select(F.col("id").alias("iglo"), (1000 * F.sin(F.col("id") / 500) + F.col("id") % 3).alias("a"), F.when(F.col("id") % 10 != 4, F.col("id") / 7).alias("b"), F.lit(2.5).alias("c"))
    head = packing.header(df, {"a": 12, "b": 20, "c": 64}).cache()
    codes = packing.packed(df, head)
    stored = packing.blocks(codes, head, block=5000).cache()
    sizes = {r["field"]: r for r in packing.stored_bytes(stored).collect()}
    for field, width in (("a", 12), ("b", 20), ("c", 64)):
        assert sizes[field]["data_bytes"] == pytest.approx(sizes[field]["n_codes"] * width / 8, rel=0.05)
    assert sizes["a"]["bitmap_bytes"] == sizes["c"]["bitmap_bytes"] == 0 and sizes["b"]["bitmap_bytes"] == n / 8
    assert stored.count() == 3 * 8
    back = packing.codes(stored)
    assert back.exceptAll(codes.select("iglo", "field", F.col("code").cast("double"))).count() == 0 and back.count() == codes.count()
    second = packing.blocks(codes, head, second=True, block=5000).cache()
    assert packing.codes(second).exceptAll(back).count() == 0
    smaller = {r["field"]: r["data_bytes"] for r in packing.stored_bytes(second).collect()}
    assert smaller["a"] < 0.7 * sizes["a"]["data_bytes"] and smaller["c"] == sizes["c"]["data_bytes"]
    for wrong in (stored.withColumn("n_codes", F.col("n_codes") - 1), stored.withColumn("data", F.expr("substring(data, 1, length(data) - 1)"))):
        with pytest.raises(Exception, match="marks|are not|cannot hold"):
            packing.codes(wrong).collect()


def test_limits():
    from pyspark.sql import datasource as ds

    own = records.Limits(("j", "i"), ("field",))
    for one, good in ((ds.GreaterThan(("j",), 3), True), (ds.LessThanOrEqual(("j",), 9), True), (ds.In(("i",), (2, 5, 90)), True), (ds.EqualTo(("field",), "a"), True), (ds.GreaterThan(("field",), "a"), False), (ds.EqualTo(("value",), 1.0), False), (ds.IsNotNull(("j",)), True)):
        assert own.take(one) is good
    assert own.span("j", 0, 8) == (4, 8) and own.span("j", 0, 3) == (0, 0) and own.span("i", 0, 10) == (2, 6)
    assert own.allows("i", 5) and not own.allows("i", 3) and not own.allows("field", "b")
