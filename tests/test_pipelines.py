import pytest
from pyspark.sql import functions as F

from gridloom.functions import fields as fx
from gridloom.functions import geometry as geo
from gridloom.operators import covers, physio, regrid
from gridloom.plans import climatology, grids, pipelines

SOURCE, TARGET = grids.shifted_lonlat(72, 36), grids.shifted_lonlat(24, 12)


def classes(spark):
    return spark.createDataFrame([(1, 1.0, 0.0, 0.0, 0.0), (2, 0.0, 1.0, 0.0, 0.0), (3, 0.0, 0.5, 0.25, 0.25)], "cover int, sea double, nature double, water double, town double")


def land(spark):
    p = SOURCE.points(spark)
    return p.withColumns({"zs": F.lit(100.0), "clay": F.lit(0.2), "sand": F.lit(0.4), "cover": F.when(F.col("i") < 36, 1).otherwise(F.when(F.col("j") % 2 == 0, 2).otherwise(3))})


def test_surface(spark):
    out = pipelines.surface(land(spark), SOURCE, TARGET, classes(spark)).cache()
    assert out.count() == TARGET.size
    assert out.where("abs(sea + nature + water + town - 1) > 1e-9").count() == 0
    flat = out.where("sea = 0").agg(F.min("zs"), F.max("zs"), F.max("slope"), F.max("stdev")).first()
    assert flat == (100.0, 100.0, 0.0, 0.0)
    assert out.where("sea = 1").agg(F.max("zs_max"), F.max("bathy")).first() == (0.0, -300.0)
    assert out.where("sea = 1 and runoff is not null").count() == 0


def test_idealised_mountain(spark):
    out = pipelines.surface(land(spark), SOURCE, TARGET, classes(spark), ellipse=(180.0, 10.0, 2000.0, 1000.0, 3000.0))
    top = out.orderBy(F.desc("zs_avg")).first()
    assert geo.math.dist((top["lon"], top["lat"]), (180.0, 10.0)) < 20 and top["zs_max"] <= 3000
    assert out.where("nature < 1 or sea > 0").count() == 0


def test_terrain_direction(spark):
    # Heights that rise to the east only: the slope's main axis is along x and nothing varies along y.
    p = SOURCE.points(spark).withColumn("zs", F.sin(F.radians("lon")) * 1000)
    r = physio.terrain_tensor(p, SOURCE, TARGET).agg(F.max(F.abs("dir")), F.max("anis")).first()
    assert r[0] == pytest.approx(0, abs=1e-6) and r[1] == pytest.approx(0, abs=1e-6)


def test_initial_state(spark):
    s = SOURCE.points(spark).withColumns({"sea": F.when(F.col("i") < 40, 1.0).otherwise(0.0), "nature": F.when(F.col("i") < 40, 0.0).otherwise(1.0)})
    s = s.withColumns({"sst": F.when(F.col("sea") > 0, 290.0), "tg": F.when(F.col("nature") > 0, 280.0)})
    t = TARGET.points(spark).select("iglo", F.when(F.col("i") < 16, 1.0).otherwise(0.0).alias("sea"), F.when(F.col("i") < 16, 0.0).otherwise(1.0).alias("nature"))
    out = pipelines.initial_state(s, SOURCE, TARGET, ["sst", "tg"], ["sea", "nature"], t).join(t, "iglo").cache()
    assert out.where("sea > 0 and (sst is null or sst <> 290)").count() == 0 and out.where("sea = 0 and sst is not null").count() == 0
    assert out.where("nature > 0 and (tg is null or tg <> 280)").count() == 0


def test_field_to_field_and_recoding(spark):
    s = SOURCE.points(spark).withColumns({"a": F.lit(1.23456), "b": F.lit(2.0)})
    out = pipelines.field_to_field(s, SOURCE, TARGET, ["a", "b"])
    assert out.where("abs(a - 1.23456) > 1e-12 or b <> b").count() == 0
    named = pipelines.recoded(out, skip=["b"], digits=2, prefix="SFX.")
    assert named.columns == ["iglo", "SFX.a"] and named.first()[1] == 1.23


def test_field_expressions(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0), (4.0, 1.0, 1.0), (None, None, None)], "a double, b double, c double")
    t = fx.tensor(F.col("a"), F.col("b"), F.col("c"))
    got = df.select(t["slope"], t["anis"], fx.deviation(F.lit(2.0), F.col("a"))).collect()
    assert got[0] == (0.0, 1.0, 0.0) and got[2] == (None, None, None)
    assert df.select(fx.half_height(F.col("a")), fx.positive_slope(F.col("a") - 2, F.lit(-2.0))).collect() == [(None, 0.0), (2.0, 1.0), (None, None)]
    one = covers.top_two([F.lit(0.2), F.lit(0.5), F.lit(0.5), F.lit(None).cast("double"), F.lit(0.0)])
    assert tuple(df.select(*one).first()) == (2, 3)
    assert df.select(covers.dominant([F.lit(1.0), *[F.lit(0.0)] * 4], F.lit(1.0)), covers.dominant([F.lit(0.0), F.lit(1.0), *[F.lit(0.0)] * 3], F.lit(0.0))).first() == (covers.DESERT, covers.SEA)
    masks = regrid.matching_masks(df.withColumns({"f": F.lit(1.0), "g": F.when(F.col("a").isNotNull(), 1.0)}), ["a"], ["f", "g"]).collect()
    assert [tuple(r) for r in masks] == [("a", "g")]


def test_the_source_is_read_twice(spark, tmp_path):
    """Means, shares and slopes in one pass, obstacles in another; and inputs on other grids are refused."""
    land(spark).write.parquet(str(tmp_path / "land"))
    source = spark.read.parquet(str(tmp_path / "land"))
    for out in (pipelines.surface(source, {"zs": SOURCE, "clay": SOURCE}, TARGET, classes(spark)), climatology.relief(source, SOURCE, TARGET, classes(spark))):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        # What is left reads the source once, for the obstacles; the cells have been settled by one pass over it.
        assert sum("cover#" in x for x in plan.split("\n") if "Relation [" in x) == 1
    with pytest.raises(ValueError, match="clay against zs"):
        pipelines.surface(source, {"zs": SOURCE, "clay": TARGET}, TARGET, classes(spark))


def test_a_stored_mapping_serves_the_months(spark):
    import uuid

    s = SOURCE.points(spark).crossJoin(spark.range(1, 4).select(F.col("id").cast("int").alias("month"))).withColumns({"a": F.col("lat") + F.col("month"), "b": F.when(F.col("i") > 3, F.col("lon"))})
    plain = climatology.to_target(SOURCE, TARGET, spark)
    stored = climatology.to_target(SOURCE, TARGET, spark, f"months_{uuid.uuid4().hex}")
    want, got = ({(r["month"], r["iglo"]): (r["a"], r["b"]) for r in climatology.plain_months(s, m, ["a", "b"]).collect()} for m in (plain, stored))
    assert set(want) == set(got) and len(want) == 3 * TARGET.size
    for k, (a, b) in want.items():
        assert got[k][0] == pytest.approx(a) and (got[k][1] is None if b is None else got[k][1] == pytest.approx(b))
