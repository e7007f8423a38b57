import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import geometry as geo
from gridloom.operators import covers, mapping, regrid, stencil
from gridloom.plans import grids


def test_gaussian_latitudes():
    x, _ = np.polynomial.legendre.leggauss(64)
    assert np.allclose(np.sin(np.radians(grids.gaussian_latitudes(64))), x[::-1], atol=1e-14)
    y = grids.gaussian_latitudes(2001)
    assert y[1000] == 0 and np.all(np.diff(y) < 0)


def test_namelists():
    g = grids.from_namelist("&NAMGRID\n LATLON=.TRUE., NDLON=16, NDGLG=16,\n ZLONW=6., ZLONE=8., ZLATS=45., ZLATN=47.\n/")
    assert (g.nx[0], g.ny, g.is_global, g.y[0], g.y[-1]) == (16, 16, False, 47.0, 45.0)
    g = grids.from_namelist(" NDGLG=4,\n NLOEN(1:4)=20,2*24,20\n NSMAX=7/")
    assert g.nx == (20, 24, 24, 20) and g.is_global
    g = grids.from_namelist("&NAMGRID LELAM=.T., NDLON=32, NDGLG=32, NUX=27, NUY=27, DXINMETRES=50000., DYINMETRES=50000. /")
    assert g.projection == "lambert" and g.xmin[0] == -13 * 50000.0
    assert grids.from_namelist("NDLON=180,NDGLG=89").size == 180 * 89
    assert g.like(g) and not g.like(grids.named("L80x40"))


@pytest.mark.parametrize("grid", [grids.lambert(9, 7, 1e5, 1e5, 9, 7, 46.2, 46.2, 46.2, 2.0), grids.lambert(9, 7, 1e5, 1e5, 9, 7, 46.2, 40.0, 50.0, 2.0), grids.reduced_gaussian([8, 12, 12, 8], (2.4, 2.0, 46.7))])
def test_projection_round_trip(spark, grid):
    p = grid.points(spark)
    x, y = grid.xy(F.col("lon"), F.col("lat"))
    far = p.select(F.max(F.abs(geo.wrapped(x - F.col("x"))) if grid.projection == "schmidt" else F.abs(x - F.col("x"))), F.max(F.abs(y - F.col("y")))).first()
    assert max(far) < 1e-5 if grid.projection == "lambert" else max(far) < 1e-8


def test_schmidt_stretches_towards_its_pole(spark):
    s = geo.Schmidt(2.0, 10.0, 50.0)
    df = spark.createDataFrame([(0.0, 90.0), (0.0, 0.0)], "x double, y double")
    lon, lat = s.inverse(F.col("x"), F.col("y"))
    pole, equator = df.select(lon, lat).collect()
    assert pole[0] == pytest.approx(10) and pole[1] == pytest.approx(50)
    c, = df.limit(1).select(geo.angle(geo.unit_vector(F.lit(equator[0]), F.lit(equator[1])), geo.unit_vector(F.lit(10.0), F.lit(50.0)))).first()
    assert math.degrees(c) == pytest.approx(90 - math.degrees(math.asin(3 / 5)))


def test_cell_of_matches_search(spark):
    rng = np.random.default_rng(1)
    lon, lat = rng.uniform(0, 360, 500), rng.uniform(-90, 90, 500)
    df = spark.createDataFrame([(int(k), float(a), float(b)) for k, (a, b) in enumerate(zip(lon, lat))], "iglo1 long, lon double, lat double")
    for grid in (grids.named("N8"), grids.reduced_gaussian([8, 12, 16, 16, 12, 8]), grids.named("L36x19"), grids.named("S12x6")):
        got = {r["iglo1"]: r["iglo2"] for r in mapping.cell_of(df, grid).collect()}
        off = np.concatenate([[0], np.cumsum(grid.nx)])
        for k in range(500):
            j = int(np.argmin(np.abs(np.array(grid.y) - lat[k])))
            i = math.floor((lon[k] - grid.xmin[j]) / grid.dx[j] + 0.5) % grid.nx[j]
            assert got[k] == off[j] + i


def test_regional_cells_reach_half_a_cell_out(spark):
    g = grids.regional_lonlat(3, 3, 2.0, 0.0, 0.0, 2.0)
    df = spark.createDataFrame([(0, -0.4, 1.0), (1, -0.6, 1.0), (2, 1.0, 2.4), (3, 1.0, 2.6), (4, 2.4, -0.4)], "iglo1 long, lon double, lat double")
    assert {r[0]: r[1] for r in mapping.cell_of(df, g).select("iglo1", "iglo2").collect()} == {0: 3, 1: None, 2: 1, 3: None, 4: 8}


def mapped(spark, source, targets, edge="first", near=1e-3):
    t = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(targets)], "iglo long, lon double, lat double")
    m = mapping.mapping4(t, source, F.lit(near), edge=edge)
    out: dict = {}
    for r in m.collect():
        out.setdefault(r["iglo2"], {})[r["corner"]] = r["w"]
    return out


def test_weights_on_points_edges_and_inside(spark):
    g = grids.regional_lonlat(3, 3, 20.0, 0.0, 0.0, 20.0)
    w = mapped(spark, g, [(10, 10), (5, 10), (15, 10), (3, 4)])
    assert max(w[0].values()) == pytest.approx(1, abs=1e-6)
    assert sum(w[1].values()) == pytest.approx(1) and sorted(w[1].values())[-2:] == pytest.approx([0.5, 0.5], abs=1e-3)
    assert sum(w[3].values()) == pytest.approx(1) and all(v > 0 for v in w[3].values())


def test_missing_corners(spark):
    g = grids.regional_lonlat(2, 2, 10.0, 0.0, 0.0, 10.0)
    beyond = [(5, 12), (12, 5), (5, -2), (-2, 5), (30, 30)]
    first = mapped(spark, g, beyond)
    # North missing: SE alone; east missing: SW alone; south missing: NW alone.
    assert {k: v for k, v in first[0].items() if v} == {1: 1.0}
    assert {k: v for k, v in first[1].items() if v} == {0: 1.0}
    assert {k: v for k, v in first[2].items() if v} == {2: 1.0}
    assert 4 not in first
    blend = mapped(spark, g, beyond, edge="blend")
    assert sorted(blend[0].values()) == pytest.approx([0.5, 0.5])


def test_interpolation_of_constants_and_first_order(spark):
    errors = []
    for n in (36, 72):
        source, target = grids.shifted_lonlat(n, n // 2), grids.uniform(17, 9, 3.3, 20.7, 71.3, -17.9, False)
        s = source.points(spark).withColumn("z", F.sin(F.radians("lat")) + F.cos(F.radians("lon"))).withColumn("one", F.lit(1.0))
        m = mapping.mapping4(target.points(spark), source, mapping.resolution(target, F.col("j"), F.col("i")))
        out = regrid.interpolate4(m, s, ["z", "one"]).join(target.points(spark).withColumnRenamed("iglo", "iglo2"), "iglo2")
        far, one, n_rows = out.select(F.max(F.abs(F.col("z") - F.sin(F.radians("lat")) - F.cos(F.radians("lon")))), F.max(F.abs(F.col("one") - 1)), F.count("*")).first()
        assert one < 1e-12 and n_rows == 17 * 9
        errors.append(far)
    assert errors[1] < 0.7 * errors[0]


def test_average_keeps_constants_and_counts(spark):
    source, target = grids.shifted_lonlat(72, 36), grids.named("N4")
    s = source.points(spark).withColumnRenamed("iglo", "iglo1").withColumn("v", F.lit(3.5))
    cells = mapping.in_domain(mapping.cell_of(s, target))
    assert regrid.regrid(cells, {"v": "avg"}).where("abs(v - 3.5) > 1e-12").count() == 0
    n = regrid.counts(cells)
    assert n.agg(F.sum("cnt")).first()[0] == 72 * 36
    assert n.orderBy(F.desc("off")).select(F.expr("off + cnt")).first()[0] == 72 * 36


def test_all_missing_and_negative_cells(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, -3.0), (2, -1.0), (2, None)], "iglo2 long, v double")
    got = {r["iglo2"]: tuple(r)[1:] for r in regrid.regrid(df, {"v": ("avg", "min", "max", "sum")}).collect()}
    assert got == {1: (None,) * 4, 2: (-2.0, -3.0, -1.0, -4.0)}


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_high_gradient_order(spark, order):
    far = []
    for n in (16, 32):
        g = spark.range(n * n).select(F.expr(f"int(id div {n})").alias("j"), F.expr(f"int(id % {n})").alias("i")).withColumn("v", F.sin(F.col("i") * (2 * math.pi / n)))
        out = stencil.high_gradient(g, "v", n, n, order, periodic=True)
        far.append(out.select(F.max(F.abs(F.col("v_di") * n / (2 * math.pi) - F.cos(F.col("i") * (2 * math.pi / n))))).first()[0])
    assert math.log2(far[0] / far[1]) == pytest.approx(2 * order, abs=0.3)


def test_gradient_of_the_unit_sphere_on_a_reduced_grid(spark):
    g = grids.named("N16")
    p = g.points(spark).withColumn("z", F.sin(F.radians("lat"))).withColumn("x_", F.cos(F.radians("lat")) * F.cos(F.radians("lon")))
    out = stencil.gradient(p, g, ["z", "x_"]).where("abs(lat) < 70")
    far = out.select(F.max(F.abs(F.col("z_dx"))), F.max(F.abs(F.col("z_dy") - F.cos(F.radians("lat")))), F.max(F.abs(F.col("x__dx") + F.sin(F.radians("lon"))))).first()
    assert max(far) < 0.02


def test_gradient_at_gaps(spark):
    g = grids.regional_lonlat(3, 3, 2.0, 0.0, 0.0, 2.0)
    p = g.points(spark).withColumn("v", F.when(F.col("iglo") != 5, F.col("i") + 10.0 * F.col("j")))
    got = {r["iglo"]: (r["v_dx"], r["v_dy"]) for r in stencil.gradient(p, g, ["v"]).collect()}
    per = math.degrees(1)
    assert got[4][1] == pytest.approx(-10 * per) and got[4][0] == pytest.approx(per, rel=1e-3)  # one-sided to the west
    assert got[0][1] == pytest.approx(-10 * per)  # one-sided at the edge
    assert got[5][0] is None


def test_half_differences(spark):
    g = grids.regional_lonlat(3, 3, 2.0, 0.0, 0.0, 2.0)
    p = g.points(spark).withColumn("v", F.when(F.col("iglo") != 5, F.col("i") + 10.0 * F.col("j")))
    got = {r["iglo"]: r for r in stencil.half_differences(p, g, ["v"]).collect()}
    assert [got[4][f"v_{n}"] for n in ("xp", "xm", "yp", "ym")] == [0.0, -1.0, -10.0, 10.0]
    assert got[5]["v_xp"] is None and got[0]["v_xm"] == 0.0


def test_rotation_keeps_length_and_comes_back(spark):
    g = grids.reduced_gaussian([8, 12, 12, 8], (2.4, 2.0, 46.7))
    p = g.points(spark).withColumns({"u": F.lit(1.0), "v": F.lit(2.0)})
    once = stencil.rotate(p, [("u", "v")], g, None)
    assert once.where("abs(u * u + v * v - 5) > 1e-9").count() == 0
    back = stencil.rotate(once, [("u", "v")], None, g)
    assert back.where("abs(u - 1) > 1e-9 or abs(v - 2) > 1e-9").count() == 0


def test_covers(spark):
    df = spark.createDataFrame([(1, 3), (1, 3), (1, 7), (2, None)], "iglo2 long, cover int")
    got = {(r["iglo2"], r["cover"]): r["frac"] for r in covers.fractions(df).collect()}
    assert got == {(1, 3): pytest.approx(2 / 3), (1, 7): pytest.approx(1 / 3)}
    with pytest.raises(Exception, match="out of range"):
        covers.fractions(spark.createDataFrame([(1, 300)], "iglo2 long, cover int")).collect()


def test_partitions_do_not_matter(spark):
    g = grids.shifted_lonlat(36, 18)
    p = g.points(spark).withColumn("v", F.sin(F.col("iglo").cast("double")))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    seen = []
    try:
        for n in (1, 7):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            seen.append(sorted(tuple(r) for r in stencil.gradient(p.repartition(n), g, ["v"]).select("iglo", "v_dx", "v_dy").collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1]
