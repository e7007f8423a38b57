"""Field expressions: masks, fills and derived surface fields. A missing value is null and stays so unless a name says otherwise."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def masked(value: Column, where: Column) -> Column:
    """PRJ-MASKSET: missing where the condition holds."""
    return F.when(F.coalesce(where, F.lit(False)), None).otherwise(value)


def or_zero(value: Column) -> Column:
    """PRJ-NVL0."""
    return F.coalesce(value, F.lit(0.0))


def scaled(raw: Column, nodata: float, scale: float = 1.0) -> Column:
    """SRC-SCALE: what is not the file's sentinel, times the scale."""
    return F.when(raw != nodata, raw * scale)


def difference(a: Column, b: Column) -> Column:
    """PRJ-DIFF."""
    return a - b


def positive_slope(d: Column, distance: Column) -> Column:
    """PRJ-CLAMPPOS: a rise over its distance, 0 for a fall; null for a missing difference."""
    return F.when(d.isNotNull(), F.greatest(F.lit(0.0), F.try_divide(d, F.abs(distance))))


def half_height(d: Column, falls: bool = False) -> Column:
    """PRJ-HALFHT: half a rise, or half the depth of a fall; missing for none."""
    return F.when(d < 0, d * -0.5) if falls else F.when(d > 0, d * 0.5)


def tensor(dxdx: Column, dydy: Column, dxdy: Column) -> dict[str, Column]:
    """PRJ-TENSOR: direction in degrees, slope and anisotropy of the gradient tensor's means."""
    k, l = (dxdx + dydy) * 0.5, (dxdx - dydy) * 0.5
    root = F.sqrt(l * l + dxdy * dxdy)
    anis = F.when(k + root > 0, F.sqrt(F.greatest(k - root, F.lit(0.0)) / F.when(k + root > 0, k + root))).otherwise(F.when(k.isNotNull(), 1.0))
    return {"dir": F.atan2(dxdy, l) * (90 / math.pi), "slope": F.sqrt(k + root), "anis": anis}


def deviation(mean: Column, mean_square: Column) -> Column:
    """Standard deviation from the means of a field and of its square."""
    v = mean_square - mean * mean
    return F.when(v.isNotNull(), F.sqrt(F.greatest(v, F.lit(0.0))))


def envelope(height: Column, stdev: Column) -> Column:
    """PRJ-ENVELOPE."""
    return height + stdev


def dummies(sea: Column, nature: Column) -> dict[str, Column]:
    """PRJ-DUMMY: constant depth under the sea, runoff and drainage on nature."""
    return {"bathy": F.when(sea > 0, -300.0), "runoff": F.when(nature > 0, 0.5), "wdrain": F.when(nature > 0, 0.0)}


def land_sea(sea: Column, lake: Column | None = None) -> Column:
    """PRJ-LANDSEA: 0 where more than half is sea or lake, else 1."""
    wet = sea > 0.5
    wet = wet | (lake > 0.5) if lake is not None else wet
    return F.when(F.coalesce(wet, F.lit(False)), 0.0).otherwise(1.0)


#: Drag coefficient of the roughness length and von Karman's constant.
CDZ0EFF, KARMAN = 0.8, 0.4


def relief_roughness(geopotential: Column, slopes: list[Column], heights: list[Column]) -> Column:
    """PRJ-Z0REL: roughness length of the relief from the sums of four slopes and four half heights."""
    a, h = (or_zero(x[0]) + or_zero(x[1]) + or_zero(x[2]) + or_zero(x[3]) for x in (slopes, heights))
    z = a * (0.25 * CDZ0EFF / (2 * KARMAN**2))
    value = F.greatest(h * 0.25 * F.exp(-F.sqrt(1.0 / F.when(z > 0, z))), F.lit(1e-10))
    return F.when(geopotential.isNotNull(), F.when(z > 0, value).otherwise(0.0))


def clamped(value: Column, low: float, high: float) -> Column:
    """Within low and high; greatest and least skip nulls, so these are kept apart."""
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


def lesser(a: Column, b: Column) -> Column:
    """The smaller one; missing if either is."""
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))


#: Numbers of the vegetation classes sea, ice, desert and lake.
SEA, ICE, DESERT, LAKE = 1, 2, 3, 5
#: Standard gravity and the least share of vegetation that counts.
GRAVITY, LEAST_VEGETATION = 9.80665, 0.02
#: Soil under water and under ice, and the limits of other soil.
WATER_SOIL = {"albedo": 0.07, "emis": 0.96, "depth_max": 8.0, "clay": 3.0, "sand": 6.0}
ICE_SOIL = {"albedo": 0.75, "emis": 0.98, "depth_max": 0.1, "clay": 3.0, "sand": 6.0}
SOIL_LIMITS = {"albedo": (0.05, 0.80), "emis": (0.90, 1.0), "depth_max": (0.1, 8.0), "clay": (3.0, 58.0), "sand": (6.0, 92.0)}


def soil_shares(sand: Column, clay: Column) -> tuple[Column, Column]:
    """Percentages within their limits, brought down to 100 together."""
    s, c = clamped(sand, *SOIL_LIMITS["sand"]), clamped(clay, *SOIL_LIMITS["clay"])
    over = F.when((s + c) > 100, (s + c) / 100).otherwise(1.0)
    return s / over, c / over


def soil_final(kind: Column, land: Column, soil: dict[str, Column]) -> dict[str, Column]:
    """PRJ-SOILFIX: albedo, emis, depth_max, clay, sand, veg_max, depth and urban by vegetation class.

    Water and ice have fixed soil, no vegetation and no town. Elsewhere values are held within limits, vegetation is brought
    down to the share of land, and towns to what vegetation leaves."""
    s, c = soil_shares(soil["sand"], soil["clay"])
    own = {n: clamped(soil[n], *SOIL_LIMITS[n]) for n in ("albedo", "emis", "depth_max")} | {"clay": c, "sand": s}
    own["veg_max"] = soil["veg_max"] * land
    deep = lesser(own["depth_max"], soil["depth"])
    own["depth"] = F.when(deep.isNotNull(), F.greatest(F.lit(SOIL_LIMITS["depth_max"][0]), deep))
    own["urban"] = lesser(1 - own["veg_max"], soil["urban"])
    none = {"veg_max": 0.0, "urban": 0.0}
    water, ice = ({**v, **none, "depth": v["depth_max"]} for v in (WATER_SOIL, ICE_SOIL))
    return {n: F.when(kind.isin(SEA, LAKE), water[n]).when(kind == ICE, ice[n]).when(kind.isNotNull(), v) for n, v in own.items()}


def soil_depth(vegetation: Column, depth: Column, most: Column) -> tuple[Column, Column]:
    """PRJ-SOILDEPTH: depth and vegetation share; less than 2 % of vegetation is none."""
    v = clamped(vegetation, 0.0, 1.0)
    v = F.when(v < LEAST_VEGETATION, 0.0).otherwise(v)
    return v * lesser(depth, most) + (1 - v) * most, v


#: What counts as nothing, and vegetation's albedo, resistance and roughness limits (urban and bare roughness in metres).
TINY, ALBEDO_LOW, ALBEDO_HIGH, RESISTANCE_LOW, RESISTANCE_HIGH, RESISTANCE_BARE, Z0_URBAN, Z0_BARE, THERMAL = 1e-10, 0.05, 0.80, 1.0, 5000.0, 5000.0, 2.5, 0.001, 0.1


def vegetation_before(z0: Column, lai: Column, rsmin: Column, share: Column) -> tuple[Column, Column, Column]:
    """PRJ-VEGPREP: log of the roughness, leaf area, and leaf area over resistance, so that means can be taken; all missing where vegetation is under 2 %.

    A missing share does not mask; a missing resistance gives a ratio of 0."""
    bare = F.coalesce(share < LEAST_VEGETATION, F.lit(False))
    log_z0 = F.when(~bare & (z0 >= TINY), F.ln(F.when(z0 >= TINY, z0)))
    green = ~bare & lai.isNotNull() & F.coalesce(rsmin >= TINY, F.lit(True))
    return log_z0, F.when(green, lai), F.when(green, F.coalesce(lai / F.when(rsmin >= TINY, rsmin), F.lit(0.0)))


def vegetation_after(log_z0: Column, albedo: Column, lai: Column, conductance: Column, share: Column, kind: Column, base: dict[str, Column], month: dict[str, Column]) -> dict[str, Column]:
    """PRJ-VEGPOST: monthly fields veg, z0, albedo, lai, rsmin, z0_therm, z0_veg and albedo_veg from the means.

    base: veg, land, urban, z0 and albedo of the whole year; month: z0 and albedo of the month, which stay over water. Ice
    and land under 2 % of vegetation count as bare; the roughness is mixed from vegetation, towns and bare ground."""
    green = clamped(share, 0.0, 1.0)
    bare = (kind == ICE) | (green < LEAST_VEGETATION)
    veg = F.when(bare, 0.0).otherwise(lesser(base["veg"], green * base["land"]))
    leaves = F.coalesce(lai, F.lit(0.0))
    resistance = F.coalesce(leaves / F.when(conductance.isNotNull(), F.greatest(conductance, F.lit(TINY))), F.lit(0.0))
    rough = F.when(bare, Z0_BARE).otherwise(F.exp(F.coalesce(log_z0, F.lit(-100.0))))
    bright = F.when(bare, ALBEDO_LOW).otherwise(clamped(albedo, ALBEDO_LOW, ALBEDO_HIGH))
    z0 = GRAVITY * (veg * rough + base["urban"] * Z0_URBAN + (1 - base["urban"] - veg) * Z0_BARE)
    land = {
        "veg": veg,
        "z0": F.sqrt(base["z0"] * base["z0"] + z0 * z0),
        "albedo": clamped((1 - veg) * base["albedo"] + veg * bright, ALBEDO_LOW, ALBEDO_HIGH),
        "lai": F.when(bare, 0.0).otherwise(leaves),
        "rsmin": F.when(bare, RESISTANCE_BARE).otherwise(clamped(resistance, RESISTANCE_LOW, RESISTANCE_HIGH)),
        "z0_therm": z0 * THERMAL,
        "z0_veg": z0,
        "albedo_veg": bright,
    }
    water = {"veg": 0.0, "z0": month["z0"], "albedo": month["albedo"], "lai": 0.0, "rsmin": RESISTANCE_HIGH, "z0_therm": base["z0"], "z0_veg": 0.0, "albedo_veg": ALBEDO_LOW}
    return {n: F.when(kind.isin(SEA, LAKE), water[n]).otherwise(v) for n, v in land.items()}


def lapse_corrected(t: Column, geopotential: Column, rate: float, up: bool = True) -> Column:
    """PRJ-TLAPSE: a temperature brought to sea level (up) or back to the surface."""
    return t + geopotential * rate if up else t - geopotential * rate


def soil_wetness(humidity: Column) -> Column:
    """PRJ-HUM: wetness from relative humidity within 0 and 1."""
    h = clamped(humidity, 0.0, 1.0)
    return F.when(h.isNotNull(), F.acos(1 - 2 * h) / math.pi)


#: Gas constants of vapour (J/kg/K), heats of water, ice and vapour (J/kg/K), triple point (K), latent heats there (J/kg), pressure there (Pa).
VAPOUR = 1000 * 6.0221367e23 * 1.380658e-23 / 18.0153
HEAT_WATER, HEAT_ICE, HEAT_VAPOUR, TRIPLE, LATENT_WATER, LATENT_ICE, PRESSURE = 4218.0, 2106.0, 4 * VAPOUR, 273.16, 2.5008e6, 2.8345e6, 611.14


def _saturation(heat: float, latent: float) -> tuple[float, float, float]:
    """a, b and c of exp(a - b / t - c ln t), which integrates Clausius and Clapeyron's law from the triple point."""
    c = (heat - HEAT_VAPOUR) / VAPOUR
    b = latent / VAPOUR + c * TRIPLE
    return math.log(PRESSURE) + b / TRIPLE + c * math.log(TRIPLE), b, c


OVER_WATER, OVER_ICE = _saturation(HEAT_WATER, LATENT_WATER), _saturation(HEAT_ICE, LATENT_ICE)


def saturation_pressure(t: Column) -> Column:
    """Saturation vapour pressure in Pa at t kelvin, over water and, up to the triple point, over ice."""
    water, ice = (F.exp(a - b / t - c * F.ln(t)) for a, b, c in (OVER_WATER, OVER_ICE))
    return F.when(t <= TRIPLE, ice).otherwise(water)


def relative_humidity(t: Column, dew_point: Column) -> Column:
    """PRJ-HUM: ratio of saturation pressures, the dew point not above the temperature."""
    return clamped(saturation_pressure(lesser(dew_point, t)) / saturation_pressure(t), 0.0, 1.0)


#: Rise of passing snow by degree below the triple point, snow for permanent ice and its bound, largest passing snow, snow on ice caps.
SNOW_RISE, SNOW_ICE, SNOW_BOUND, SNOW_MOST, SNOW_CAP = 0.04, 10.0, 1.0001, 1000.0, 10000.0


def snow_reserve(t: Column, wetness: Column, ice: Column, land: Column) -> Column:
    """PRJ-SNOW: snow from the share of ice on land, and from temperature and soil wetness."""
    x = clamped(ice / F.greatest(land, F.lit(TINY)), 0.0, 1.0)
    y = clamped(SNOW_RISE * wetness * (TRIPLE - t), 0.0, 1.0)
    return F.greatest(F.lit(0.0), SNOW_ICE * x / (SNOW_BOUND - x) + SNOW_MOST * (1 - F.cos(y * math.pi)) / 2)


def snow_limited(snow: Column, kind: Column) -> Column:
    """PRJ-SNOW: the ice cap's snow on ice, at most the largest passing snow elsewhere."""
    return F.when(kind == ICE, SNOW_CAP).otherwise(lesser(snow, F.lit(SNOW_MOST)))


#: Below this temperature (K) water is ice; albedo, emissivity and roughness (times gravity) of ice and of open water.
FREEZES = 271.23
ON_ICE, ON_WATER = {"albedo": 0.65, "emis": 0.97, "z0": 0.001 * GRAVITY}, {"albedo": 0.07, "emis": 0.96, "z0": 0.001 * GRAVITY}


def water_surface(t: Column, kind: Column, base: dict[str, Column]) -> dict[str, Column]:
    """PRJ-WATERSFC: albedo, emissivity and roughness over water, frozen or open (also where t is missing); elsewhere those of the whole year."""
    frozen = F.coalesce(t <= FREEZES, F.lit(False))
    return {n: F.when(kind.isin(SEA, LAKE), F.when(frozen, ON_ICE[n]).otherwise(ON_WATER[n])).otherwise(v) for n, v in base.items()}


def log_scaled(total: Column, low: float, high: float) -> Column:
    """PRJ-LOGSCALE: 0 at low, 1 at high, in logarithms."""
    return F.ln(clamped(total, low, high) / low) / math.log(high / low)


def mixed(a: Column, b: Column) -> Column:
    """PRJ-COALESCE: b where a is missing."""
    return F.coalesce(a, b)


def rounded(x: Column) -> Column:
    """To 1e-7."""
    return F.round(x, 7)
