"""PG-CLIM: the surface climatology of a target grid, whole-year fields first, then twelve months of each part.

Each part takes DataFrames on its own source grid and the target's whole-year fields so far, and gives new fields of the
target. Monthly parts are long, a row for each month and point, so one mapping join serves all months.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fields as fx
from ..operators import covers, kept, physio
from ..operators.mapping import mapping4, resolution
from ..operators.regrid import interpolate4
from .grids import Grid
from .pipelines import MOISTURE_LAG, TEMPERATURE_LAG, lagged_cycle
from .scratch import settled

#: Fall of temperature with height (K/m) by gravity, and the share from which a point counts as land or sea.
LAPSE, HALF = 6.5e-3 / fx.GRAVITY, 0.5
MONTHS = 12


def to_target(source: Grid, target: Grid, spark, name: str | None = None) -> DataFrame | kept.Kept:
    """The 4-point mapping of a source grid; stored under a table name if there is one, for parts that apply it again and again."""
    found = mapping4(target.points(spark), source, resolution(target, F.col("j"), F.col("i")))
    return kept.build(found, name) if name else found


def relief(source: DataFrame, grid: Grid, target: Grid, class_table: DataFrame, sea_class: int = 1) -> DataFrame:
    """Part 1: iglo, geo, sand, clay, dir (radians), anis (squared), stdev, z0_relief, z0, lsm, urban and land.

    source: iglo, j, i, x, y, lon, lat, zs, clay, sand, cover. Heights become geopotential; those of the sea do not count.
    The envelope adds the deviation, and obstacles are seen from the envelope. Slopes are turned to the target's axes."""
    land = source.withColumn("geo", fx.masked(F.col("zs") * fx.GRAVITY, F.col("cover") == sea_class))
    cells = physio.to_cells(physio.with_slopes(land, grid, target, "geo", turned=True), target)
    found = physio.cell_summary(cells, ["geo", "clay", "sand", *physio.PRODUCTS], [], class_table, ["sea", "water", "town"], sea_class)
    found = found.withColumnRenamed("iglo2", "iglo").withColumns(physio.shape("geo")).drop(*physio.PRODUCTS)
    found = settled(found, "cells")
    out = target.points(source.sparkSession).join(found, "iglo", "left")
    out = out.withColumn("geo", fx.envelope(F.col("geo"), F.col("stdev")))
    high = physio.obstacles(land, grid, out.select("iglo", F.col("geo").alias("avg")), target, "geo")
    out = out.join(high.withColumnRenamed("iglo2", "iglo"), "iglo", "left")
    slopes, heights = ([F.col(f"{k}_{n}") for n in ("ip", "im", "jp", "jm")] for k in ("aos", "ho2"))
    z0 = fx.or_zero(fx.relief_roughness(F.col("geo"), slopes, heights))
    lsm = F.when(F.coalesce(F.col("_sea") > HALF, F.lit(False)) | F.coalesce(F.col("water") > HALF, F.lit(False)), 0.0).otherwise(1.0)
    zero = {n: fx.or_zero(c) for n, c in {"geo": F.col("geo"), "sand": F.col("sand"), "clay": F.col("clay"), "dir": F.radians("dir"), "anis": F.col("anis") ** 2, "stdev": F.col("stdev")}.items()}
    return out.select("iglo", *[c.alias(n) for n, c in zero.items()], z0.alias("z0_relief"), z0.alias("z0"), lsm.alias("lsm"), F.col("town").alias("urban"), (1 - (F.col("sea") + F.col("water"))).alias("land"))


SOIL_FIELDS = ("alb", "emi", "dps", "vgx", "dpr")


def soil(base: DataFrame, fields: DataFrame, mapping: DataFrame | kept.Kept) -> DataFrame:
    """Part 2: base (iglo, lsm, land, sand, clay, urban and others) with kind, veg, and the final soil of soil_final.

    fields: iglo, itp (vegetation type) and SOIL_FIELDS on their own grid. Types become densities, so that 4-point values tell the dominant one."""
    hot = {f"type{k}": c for k, c in enumerate(covers.one_hot(F.col("itp")), 1)}
    found = interpolate4(mapping, fields.withColumns(hot), [*SOIL_FIELDS, *hot]).withColumnRenamed("iglo2", "iglo")
    out = base.join(found, "iglo", "left")
    kind = covers.dominant([F.col(n) for n in hot], F.col("lsm"))
    depth, veg = fx.soil_depth(F.col("vgx"), F.col("dpr"), F.col("dps"))
    out = out.withColumns({"kind": kind, "depth": depth, "veg": veg})
    before = {"albedo": F.col("alb"), "emis": F.col("emi"), "depth_max": F.col("dps"), "veg_max": F.col("veg"), "depth": F.col("depth"), **{n: F.col(n) for n in ("sand", "clay", "urban")}}
    return out.withColumns(fx.soil_final(F.col("kind"), F.col("land"), before)).drop(*SOIL_FIELDS, *hot)


def temperatures(base: DataFrame, fixed: DataFrame, monthly: DataFrame, mapping: DataFrame | kept.Kept, lags: tuple[float, float] = (TEMPERATURE_LAG, MOISTURE_LAG)) -> DataFrame:
    """Part 3: month, iglo, t, t_deep, wet, wet_deep, snow, albedo, emis and z0.

    fixed: iglo, lfrac, orog, ifrac; monthly: month, iglo, tg, td, ts, all on one source grid. base: iglo, lsm, geo, kind,
    albedo, emis, z0. Ground and dew-point temperatures are brought to sea level on the source; all come back up on the
    target. Deep temperatures and moisture follow the surface's by a lag each, on land only."""
    flat = monthly.join(fixed.select("iglo", "orog"), "iglo")
    flat = flat.withColumns({c: fx.lapse_corrected(F.col(c), F.col("orog"), LAPSE) for c in ("tg", "td")})
    shares = interpolate4(mapping, fixed, ["lfrac", "ifrac"])
    means = interpolate4(mapping, flat, ["tg", "td", "ts"], by=("month",)).join(shares, "iglo2").withColumnRenamed("iglo2", "iglo")
    own = means.join(base.select("iglo", "lsm", "geo", "kind", "albedo", "emis", "z0"), "iglo")
    land = F.col("lsm") >= HALF
    up = {c: fx.lapse_corrected(F.col(c), F.col("geo"), LAPSE, up=False) for c in ("tg", "td", "ts")}
    own = own.withColumns(up)
    wet = fx.soil_wetness(fx.relative_humidity(F.col("tg"), F.col("td")))
    own = own.withColumns({"t": F.when(land, F.col("tg")).otherwise(F.col("ts")), "wet": F.when(land, wet).otherwise(1.0)})
    snow = F.when(land, fx.snow_reserve(F.col("t"), F.col("wet"), F.col("ifrac"), F.col("lfrac"))).otherwise(0.0)
    own = own.withColumn("snow", fx.snow_limited(snow, F.col("kind")))
    own = own.withColumns(fx.water_surface(F.col("t"), F.col("kind"), {n: F.col(n) for n in ("albedo", "emis", "z0")}))
    for c, lag in zip(("t", "wet"), lags):
        own = lagged_cycle(own, c, lag).withColumn(f"{c}_deep", F.when(land, F.col(f"{c}_lagged")).otherwise(F.col(c))).drop(f"{c}_lagged")
    return own.select("month", "iglo", "t", "t_deep", "wet", "wet_deep", "snow", "albedo", "emis", "z0")


def vegetation(base: DataFrame, months: DataFrame, fixed: DataFrame, monthly: DataFrame, mapping: DataFrame | kept.Kept) -> DataFrame:
    """Part 4: month, iglo, veg, z0, albedo, lai, rsmin, z0_therm, z0_veg, albedo_veg.

    fixed: iglo, z0v, alv, rsm; monthly: month, iglo, veg, lai on one source grid. base: whole-year fields; months: z0 and albedo of part 3."""
    both = monthly.join(fixed, "iglo")
    log_z0, lai, ratio = fx.vegetation_before(F.col("z0v"), F.col("lai"), F.col("rsm"), F.col("veg"))
    ready = both.select("month", "iglo", "veg", "alv", log_z0.alias("log_z0"), lai.alias("lai"), ratio.alias("ratio"))
    found = interpolate4(mapping, ready, ["veg", "alv", "log_z0", "lai", "ratio"], by=("month",)).withColumnRenamed("iglo2", "iglo")
    year = base.select("iglo", "kind", *[F.col(c).alias(f"year_{c}") for c in ("veg", "land", "urban", "z0", "albedo")])
    own = found.join(year, "iglo").join(months.select("month", "iglo", F.col("z0").alias("month_z0"), F.col("albedo").alias("month_albedo")), ["month", "iglo"])
    at = lambda prefix, *names: {n: F.col(f"{prefix}_{n}") for n in names}
    after = fx.vegetation_after(F.col("log_z0"), F.col("alv"), F.col("lai"), F.col("ratio"), F.col("veg"), F.col("kind"), at("year", "veg", "land", "urban", "z0", "albedo"), at("month", "z0", "albedo"))
    return own.select("month", "iglo", *[c.alias(n) for n, c in after.items()])


def plain_months(monthly: DataFrame, mapping: DataFrame | kept.Kept, fields: list[str]) -> DataFrame:
    """Parts 8 and 9 (ozone coefficients, aerosols): month, iglo and the 4-point values of the fields."""
    return interpolate4(mapping, monthly, fields, by=("month",)).withColumnRenamed("iglo2", "iglo").select("month", "iglo", *fields)

