"""Missing coordinates and values, axes of projections, and plans that must not grow with the number of fields."""

import math

import pytest
from pyspark.sql import functions as F

from gridloom.functions import fields as fx
from gridloom.functions import geometry as geo
from gridloom.operators import mapping, regrid, stencil
from gridloom.plans import grids, pipelines
from gridloom.sources import sinks

GRIDS = [grids.shifted_lonlat(36, 18), grids.reduced_gaussian([8, 12, 12, 8]), grids.reduced_gaussian([8, 12, 12, 8], (2.4, 2.0, 46.7)), grids.regional_lonlat(5, 5, 50.0, 0.0, 46.0, 4.0), grids.lambert(9, 7, 1e5, 1e5, 9, 7, 46.2, 46.2, 46.2, 2.0)]


@pytest.mark.parametrize("grid", GRIDS)
def test_missing_coordinates_have_no_place(spark, grid):
    df = spark.createDataFrame([(0, None, 48.0), (1, 2.0, None), (2, None, None), (3, 2.0, 48.0)], "iglo1 long, lon double, lat double")
    got = {r["iglo1"]: r["iglo2"] for r in mapping.cell_of(df, grid).collect()}
    assert got.pop(3) is not None and got == {0: None, 1: None, 2: None}
    four = {r["iglo1"]: sum(c is not None for c in r["corners"]) for r in mapping.corners(df, grid).collect()}
    assert four.pop(3) > 0 and not any(four.values())


def test_angles_of_missing_points_are_missing(spark):
    df = spark.createDataFrame([(None, 1.0), (1.0, None)], "lon double, lat double")
    a = geo.angle(geo.unit_vector(F.col("lon"), F.col("lat")), geo.unit_vector(F.lit(0.0), F.lit(0.0)))
    assert [r[0] for r in df.select(a).collect()] == [None, None]


@pytest.mark.parametrize("grid", [GRIDS[2], GRIDS[4]])
def test_axes_follow_the_map(spark, grid):
    """North as the map shows it, by a small step."""
    df = spark.createDataFrame([(20.0, 50.0), (350.0, 40.0), (100.0, -20.0), (2.0, 46.0), (-60.0, 70.0)], "lon double, lat double")
    (x0, y0), (x1, y1) = grid.xy(F.col("lon"), F.col("lat")), grid.xy(F.col("lon"), F.col("lat") + 1e-4)
    dx = (x1 - x0) * (F.cos(F.radians(y0)) if grid.projection == "schmidt" else F.lit(1.0))
    axes = stencil.jacobian(grid)
    for r in df.select(dx.alias("u"), (y1 - y0).alias("v"), axes[1].alias("north_x"), axes[3].alias("north_y")).collect():
        n = math.hypot(r["u"], r["v"])
        assert (r["u"] / n, r["v"] / n) == pytest.approx((r["north_x"], r["north_y"]), abs=1e-4)


@pytest.mark.parametrize("grid", GRIDS)
def test_resolution_of_every_grid(spark, grid):
    p = grid.points(spark).withColumn("r", mapping.resolution(grid, F.col("j"), F.col("i")))
    rows = {(r["j"], r["i"]): r for r in p.collect()}
    for (j, i), r in rows.items():
        o = rows[j, i - 1 if i else i + 1]
        a, b = ([math.radians(x[c]) for c in ("lon", "lat")] for x in (r, o))
        cos = math.sin(a[1]) * math.sin(b[1]) + math.cos(a[1]) * math.cos(b[1]) * math.cos(a[0] - b[0])
        assert r["r"] == pytest.approx(math.acos(max(-1.0, min(1.0, cos))), abs=1e-6)


def test_four_points_reach_every_grid(spark):
    source = grids.shifted_lonlat(36, 18)
    s = source.points(spark).withColumn("z", F.lit(3.0))
    for grid in GRIDS:
        out = pipelines.field_to_field(s, source, grid, ["z"])
        assert out.where("abs(z - 3) > 1e-9 or z is null").count() == 0 and out.count() > 0


def test_windows_are_the_join(spark):
    for grid in (grids.shifted_lonlat(12, 6), grids.regional_lonlat(6, 5, 20.0, 0.0, 0.0, 25.0)):
        df = grid.points(spark).withColumn("v", F.when(F.col("iglo") % 7 != 3, F.sin(F.col("iglo") * 1.7))).where("iglo % 11 <> 4")
        a = stencil.neighbours(df, grid, ["v"])
        plain = grids.Grid(grid.y, grid.nx, grid.xmin, grid.dx, grid.is_global)
        object.__setattr__(plain, "y", (*grid.y[:-1], grid.y[-1] + 1e-6))  # not linear: the general way
        b = stencil.neighbours(df, plain, ["v"])
        cols = ["iglo", "v_w", "v_e", "v_nw", "v_sw"]
        assert sorted(map(str, a.select(cols).collect())) == sorted(map(str, b.select(cols).collect()))


def test_many_means_scan_once(spark):
    fields = [f"f{k}" for k in range(31)]
    df = spark.range(40).select("id", (F.col("id") % 2).alias("land"), *[F.when(F.col("id") % (k + 2) != 0, F.col("id") * 1.0 + k).alias(f) for k, f in enumerate(fields)])
    out = regrid.filled_with_means(df, {f: ("land" if k % 2 else None) for k, f in enumerate(fields)})
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (0, 40") == 2
    rows = out.collect()
    for k, f in enumerate(fields):
        own = [r for r in df.collect() if not k % 2 or r["land"]]
        known = [r[f] for r in own if r[f] is not None]
        for r, was in zip(sorted(rows), sorted(df.collect())):
            want = was[f] if was[f] is not None or (k % 2 and not was["land"]) else sum(known) / len(known)
            assert r[f] == pytest.approx(want) if want is not None else r[f] is None


def test_surface_schemes_with_missing_values(spark):
    df = spark.createDataFrame([(None, None, None), (1, 0.5, None), (3, None, 0.5), (2, 0.5, 0.5)], "kind int, a double, b double")
    kind, a, b = F.col("kind"), F.col("a"), F.col("b")
    soil = fx.soil_final(kind, a, {n: b for n in ("albedo", "emis", "depth_max", "clay", "sand", "veg_max", "depth", "urban")})
    got = df.select(*[c.alias(n) for n, c in soil.items()]).collect()
    assert not any(v is not None for v in got[0]) and got[1]["depth"] == 8.0 and got[1]["urban"] == 0.0 and got[3]["albedo"] == 0.75
    assert got[2]["veg_max"] is None and got[2]["albedo"] == 0.5
    water = df.select(*fx.water_surface(a, kind, {"albedo": b}).values()).collect()
    assert [r[0] for r in water] == [None, 0.65, 0.5, 0.5]
    assert [r[0] for r in df.select(fx.snow_limited(b, kind)).collect()] == [None, None, 0.5, 10000.0]
    assert [r[0] for r in df.select(fx.half_height(a - 1, falls=True)).collect()] == [None, 0.25, None, 0.25]


def test_saturation(spark):
    t = spark.createDataFrame([(273.16,), (300.0,), (250.0,), (None,)], "t double")
    got = [r[0] for r in t.select(fx.saturation_pressure(F.col("t"))).collect()]
    assert got[0] == pytest.approx(611.14) and got[1] == pytest.approx(3536, rel=5e-3) and got[2] == pytest.approx(76, rel=1e-2) and got[3] is None


def test_points_near_the_seam(spark):
    source = spark.createDataFrame([(k, lon, 0.0, 1.0) for k, lon in enumerate([0.1, 359.9, 359.2, 1.2, 180.0, None])], "k int, lon double, lat double, v double")
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 359.6, 0.0), (3, 90.0, None)], "point int, lon double, lat double")
    got = {r["point"]: r["n"] for r in pipelines.point_cells(source, points, 0.7, 1.0, {"v": "sum"}).collect()}
    assert got == {1: 2, 2: 1}


def test_geometry_mismatch():
    a, b = grids.shifted_lonlat(12, 6), grids.shifted_lonlat(12, 6, west=1.0)
    assert pipelines.same_geometry({"a": a, "c": grids.shifted_lonlat(12, 6)}) is a
    with pytest.raises(ValueError, match="b against a"):
        pipelines.same_geometry({"a": a, "b": b})


def test_record_of_an_empty_field(spark, tmp_path):
    out = sinks.write_record(spark.createDataFrame([], "iglo long, v double"), str(tmp_path / "x"), "v").collect()
    assert out[0]["n_values"] == 0 and (tmp_path / "x").read_bytes() == bytes(8)


def test_packing_keeps_its_step(spark):
    from gridloom.sources import packing

    df = spark.range(300).select(F.col("id").alias("iglo"), F.when(F.col("id") % 9 != 0, F.sin("id") * 70).alias("a"), F.lit(3.5).alias("b"), F.lit(None).cast("double").alias("c"))
    for bits in (1, 8, 16, 24, 64):
        head = packing.header(df, dict.fromkeys("abc", bits)).cache()
        codes = packing.packed(df, head)
        back = {(r["iglo"], r["field"]): r["value"] for r in packing.unpacked(codes, head).collect()}
        rows = df.collect()
        assert len(back) == sum(r[f] is not None for r in rows for f in "abc")
        assert all(abs(back[r["iglo"], "a"] - r["a"]) <= packing.largest_error(140, bits) * (1 + 1e-9) + 1e-12 and back[r["iglo"], "b"] == 3.5 for r in rows if r["a"] is not None)
        assert bits == 64 or codes.where("field = 'a'").agg(F.max("code")).first()[0] <= 2**bits - 1
    with pytest.raises(Exception, match="wrong number of values of a"):
        packing.unpacked(codes.where("iglo > 5"), head).collect()


def test_frames(spark):
    r = math.radians
    g = grids.from_frame({"kind": "lonlat", "nx": 21, "ny": 11, "west": r(10), "south": r(40), "east": r(50), "north": r(60)})
    assert g.like(grids.regional_lonlat(21, 11, 60.0, 10.0, 40.0, 50.0))
    g = grids.from_frame({"kind": "lonlat", "nx": 36, "ny": 19, "west": r(-180), "south": r(-90), "east": r(170), "north": r(90)})
    assert g.is_global and g.xmin[0] == -180 and g.y[0] == 90
    g = grids.from_frame({"kind": "lambert", "nx": 9, "ny": 7, "dx": 1e5, "dy": 1e5, "nux": 9, "nuy": 7, "lon0": r(2.0), "lat0": r(46.2)})
    assert g.like(GRIDS[4])
    g = grids.from_frame({"kind": "gaussian", "ny": 4, "nloen": [8, 12], "stretch": 2.4, "sin_lat": math.sin(r(46.7)), "sin_lon": math.sin(r(2.0)), "cos_lon": math.cos(r(2.0))})
    assert g.like(GRIDS[2]) and g.map.c == 2.4 and math.degrees(g.map.lat) == pytest.approx(46.7)
    with pytest.raises(ValueError, match="odd"):
        grids.from_frame({"kind": "gaussian", "ny": 3, "nloen": [8], "stretch": 1.0, "sin_lat": 1.0, "sin_lon": 0.0, "cos_lon": 1.0})


def test_tools(spark, tmp_path):
    from gridloom import tools

    df = grids.named("S6x3").points(spark).select("iglo", F.col("lat").alias("SURFB"), F.when(F.col("i") > 2, F.col("lon")).alias("S002A"), F.col("lon").alias("S001A"))
    df.write.parquet(str(tmp_path / "a"))
    df.withColumn("SURFB", F.col("SURFB") + 1).drop("S001A").write.parquet(str(tmp_path / "b"))
    file = lambda n: str(tmp_path / n)
    assert [tuple(r) for r in tools.run(spark, ["list", "--file", file("a")]).collect()] == [(1, "S001A", 18, 0), (2, "S002A", 18, 9), (3, "SURFB", 18, 0)]
    assert tools.run(spark, ["size", "--file", file("a")]).first() == (3, 18)
    assert {r["field"]: (r["differ"], r["largest"]) for r in tools.run(spark, ["diff", "--file-1", file("a"), "--file-2", file("b")]).collect()} == {"SURFB": (18, 1.0), "S002A": (0, 0.0)}
    tools.run(spark, ["cat", "--file-1", file("b"), "--file-2", file("a"), "--out", file("c")])
    assert set(spark.read.parquet(file("c")).columns) == set(df.columns)
    tools.run(spark, ["split", "--file", file("a"), "--out", file("d"), "--each", "2"])
    for out, way in (("e", "simple"), ("f", "second")):
        sizes = {r["field"]: r for r in tools.run(spark, ["convert", "--file", file("a"), "--out", file(out), "--bits", "8", "--skip", "SURFB", "--packing", way]).collect()}
        assert {f: r["n_codes"] for f, r in sizes.items()} == {"S001A": 18, "S002A": 9} and sizes["S002A"]["bitmap_bytes"] > 0 == sizes["S001A"]["bitmap_bytes"]
        assert way == "second" or sizes["S001A"]["data_bytes"] == 18
        tools.run(spark, ["decode", "--file", file(out), "--out", file(out + "back")])
        back = {r["iglo"]: r for r in spark.read.parquet(file(out + "back")).collect()}
        for r in df.collect():
            assert back[r["iglo"]]["S001A"] == pytest.approx(r["S001A"], abs=1.5) and (back[r["iglo"]]["S002A"] is None) == (r["S002A"] is None)
    with pytest.raises(ValueError, match="size mismatch"):
        tools.mixed(df.limit(3), df, "SURFB")
    with pytest.raises(SystemExit):
        tools.run(spark, ["mix", "--file-1", "x"])
