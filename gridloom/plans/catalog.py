"""Queries over the test tables, one for each operator or group of column expressions, with the SQL that gives the same rows.

Source points come from lineitem by integer arithmetic on a 360 by 180 grid of cell centres; the target has 36 by 18 cells.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fields as fx
from ..functions import geometry as geo
from ..operators import covers, exact, folds, kept, mapping, physio, regrid, stencil
from ..sources.rasters import unit_sphere
from . import grids, pipelines

NX, NY, TX, TY = 360, 180, 36, 18
SOURCE, TARGET = grids.shifted_lonlat(NX, NY), grids.shifted_lonlat(TX, TY)
GAUSS = grids.reduced_gaussian([12, 20, 24, 28, 28, 24, 20, 12])
REGION = grids.regional_lonlat(21, 11, 60.0, 10.0, 40.0, 50.0)
FINE = grids.uniform(50, 25, 2.3, 7.2, 80.1, -6.7, False)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

SRC = f"""src AS (SELECT k AS iglo1, k % {NX} AS i, (k // {NX}) % {NY} AS j, 0.5 + k % {NX} AS lon, 89.5 - (k // {NX}) % {NY} AS lat, zs, clay, sand, cover
  FROM (SELECT CAST(l_orderkey AS BIGINT) * 7 + l_linenumber AS k, CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_extendedprice END AS zs, l_discount AS clay, l_tax AS sand, CAST(1 + l_partkey % 256 AS INTEGER) AS cover FROM lineitem))"""
CELL = f"""cell AS (SELECT *, j2 * {TX} + i2 AS iglo2 FROM (SELECT *, CAST(greatest(0, least({TY - 1}, floor((lat - 85.0) / -10.0 + 0.5))) AS BIGINT) AS j2,
  CAST(CASE WHEN lon >= 5.0 THEN floor((lon - 5.0) / 10.0 + 0.5) ELSE ceil((lon - 5.0) / 10.0 - 0.5) END AS BIGINT) % {TX} AS i2 FROM src))"""
FIELD = f"""field AS (SELECT r.iglo, CAST(r.iglo // {TX} AS INTEGER) AS j, CAST(r.iglo % {TX} AS INTEGER) AS i, 5.0 + 10.0 * (r.iglo % {TX}) AS x, 85.0 - 10.0 * (r.iglo // {TX}) AS y, v
  FROM (SELECT unnest(range(0, {TX * TY})) AS iglo) r LEFT JOIN (SELECT iglo2, CASE WHEN count(zs) % 13 <> 5 THEN avg(zs) END AS v FROM cell GROUP BY iglo2) m ON r.iglo = m.iglo2)"""
CLASSES = """classes AS (SELECT CAST(c AS INTEGER) AS cover, (c % 5) / 10.0 AS sea, (c % 3) / 10.0 AS water, (c % 2) / 10.0 AS town, 1.0 - (c % 5) / 10.0 - (c % 3) / 10.0 - (c % 2) / 10.0 AS nature FROM (SELECT unnest(range(1, 257)) AS c))"""


#: Added before rounding to 6 digits, so that the engines, which round ties apart, meet none.
NUDGE = 1e-9


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql.replace(", 6)", f" + {NUDGE}, 6)")
        return f

    return add


def r6(c: Column | str) -> Column:
    return F.round((F.col(c) if isinstance(c, str) else c) + NUDGE, 6)


def source_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    k = F.col("l_orderkey").cast("long") * 7 + F.col("l_linenumber")
    zs = F.when(F.col("l_returnflag") != "R", F.col("l_extendedprice"))
    base = rows.select(k.alias("iglo1"), F.pmod(k, F.lit(NX)).cast("int").alias("i"), F.pmod(F.floor(k / NX), F.lit(NY)).cast("int").alias("j"), zs.alias("zs"), F.col("l_discount").alias("clay"), F.col("l_tax").alias("sand"), (F.col("l_partkey") % 256 + 1).cast("int").alias("cover"))
    return base.withColumns({"lon": 0.5 + F.col("i"), "lat": 89.5 - F.col("j")})


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.in_domain(mapping.cell_of(source_points(spark, sf_dir), TARGET))


def gappy(c: str) -> Column:
    """The mean of a cell, missing where the number of values leaves 5 when divided by 13."""
    return F.when(F.count(c) % 13 != 5, F.avg(c))


def field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field with gaps on the target grid: one row for each point; cells with some numbers of values have none."""
    means = cells(spark, sf_dir).groupBy(F.col("iglo2").alias("iglo")).agg(gappy("zs").alias("v"))
    return TARGET.points(spark).join(means, "iglo", "left")


def classes(spark: SparkSession) -> DataFrame:
    c = F.col("id")
    sea, water, town = (c % 5) / 10.0, (c % 3) / 10.0, (c % 2) / 10.0
    return spark.range(1, 257).select(c.cast("int").alias("cover"), sea.alias("sea"), water.alias("water"), town.alias("town"), (1.0 - sea - water - town).alias("nature"))


@query(f"WITH {SRC}, {CELL} SELECT iglo2, round(avg(zs), 6) AS zs_avg, min(zs) AS zs_min, max(zs) AS zs_max, round(sum(zs), 4) AS zs_sum, count(*) AS cnt FROM cell GROUP BY iglo2")
def ag_avg_min_max_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-AVG, AG-MIN, AG-MAX, AG-SUM, AG-SEL on JN-CELL."""
    c = cells(spark, sf_dir)
    z = F.col("zs")
    return c.groupBy("iglo2").agg(*[f(z).alias(f"zs_{n}") for n, f in regrid.OPTIONS.items()], F.count("*").alias("cnt")).withColumns({"zs_avg": r6("zs_avg"), "zs_sum": F.round("zs_sum", 4)})


@query(f"WITH {SRC}, {CELL} SELECT j2, i2, iglo2, count(*) AS n FROM cell GROUP BY j2, i2, iglo2")
def jn_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir).groupBy(F.col("j2").cast("long").alias("j2"), F.col("i2").cast("long").alias("i2"), "iglo2").agg(F.count("*").alias("n"))


def _gauss_sql() -> str:
    y = GAUSS.y
    mids = [(a + b) / 2 for a, b in zip(y, y[1:])]
    off, rows = 0, []
    for j, n in enumerate(GAUSS.nx):
        hi, lo = ("1e9" if j == 0 else repr(mids[j - 1])), ("-1e9" if j == len(y) - 1 else repr(mids[j]))
        rows.append(f"({j}, {lo}::DOUBLE, {hi}::DOUBLE, {n}, {repr(360.0 / n)}::DOUBLE, {off})")
        off += n
    return f"WITH {SRC}, rows(j2, lo, hi, nx, dx, off) AS (VALUES {', '.join(rows)}) SELECT CAST(off + CAST(floor(lon / dx + 0.5) AS BIGINT) % nx AS BIGINT) AS iglo2, count(*) AS n, round(avg(zs), 6) AS zs FROM src JOIN rows ON lat > lo AND lat <= hi GROUP BY 1"


@query(_gauss_sql())
def jn_cell_gaussian(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-CELL on rows of unequal y and size."""
    c = mapping.in_domain(mapping.cell_of(source_points(spark, sf_dir), GAUSS))
    return c.groupBy("iglo2").agg(F.count("*").alias("n"), r6(F.avg("zs")).alias("zs"))


@query(f"WITH {SRC}, t AS (SELECT *, floor((lat - 60.0) / -2.0 + 0.5) AS j2, floor((lon - 10.0) / 2.0 + 0.5) AS i2 FROM src) SELECT CAST(j2 * 21 + i2 AS BIGINT) AS iglo2, count(*) AS n, round(avg(zs), 6) AS zs FROM t WHERE j2 BETWEEN 0 AND 10 AND lon > 9.0 AND lon < 51.0 GROUP BY 1")
def flt_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-DOMAIN: a regional target."""
    c = mapping.in_domain(mapping.cell_of(source_points(spark, sf_dir), REGION))
    return c.groupBy("iglo2").agg(F.count("*").alias("n"), r6(F.avg("zs")).alias("zs"))


@query(f"WITH {SRC}, {CELL}, n AS (SELECT iglo2, count(*) AS cnt FROM cell GROUP BY iglo2) SELECT iglo2, cnt, CAST(sum(cnt) OVER (ORDER BY iglo2) - cnt AS BIGINT) AS off FROM n")
def ag_cnt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regrid.counts(cells(spark, sf_dir))


@query(f"WITH {SRC} SELECT count(*) AS n_missing FROM (SELECT unnest(range(0, {NX * NY})) AS iglo) WHERE iglo NOT IN (SELECT j * {NX} + i FROM src)")
def ag_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-MISS: points of the fine grid that no source point falls on."""
    found = mapping.in_domain(mapping.cell_of(source_points(spark, sf_dir), SOURCE))
    return regrid.missing_targets(SOURCE.points(spark), found)


@query(f"WITH {SRC}, {CELL} SELECT iglo2, count(*) AS n, string_agg(CAST(iglo1 AS VARCHAR) || '=' || CAST(cover AS VARCHAR), ',' ORDER BY iglo1, cover) AS \"list\" FROM cell GROUP BY iglo2")
def ag_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-LIST, SO-KEYS: source values of each target in source order, chunks put end to end as text."""
    found = folds.lists(cells(spark, sf_dir), ["cover"], span=CHUNK)
    text = F.array_join(F.transform("values", lambda x: F.concat_ws("=", x["iglo1"].cast("string"), x["cover"].cast("string"))), ",")
    each = found.groupBy("iglo2").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("chunk", text.alias("text")))).alias("texts"))
    return each.select("iglo2", "n", F.array_join(F.transform("texts", lambda x: x["text"]), ",").alias("list"))


#: Source numbers of a chunk in the queries, so that a target has several.
CHUNK = 4096


@query(f"""WITH {SRC}, {CELL}, c AS (SELECT iglo2, CAST(iglo1 // {CHUNK} AS BIGINT) AS chunk, count(*) AS n, min(iglo1) AS first, sum(iglo1 * cover) AS mark, max(iglo1) AS last FROM cell GROUP BY 1, 2)
  SELECT iglo2, chunk, n, CAST(sum(n) OVER (PARTITION BY iglo2 ORDER BY chunk) - n AS BIGINT) AS at, first, last, CAST(mark AS BIGINT) AS mark FROM c""")
def ag_list_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-LIST as compressed rows: chunks of bounded size with their offset in the target's list."""
    found = folds.lists(cells(spark, sf_dir), ["cover"], span=CHUNK)
    first, last = F.element_at("values", 1)["iglo1"], F.element_at("values", -1)["iglo1"]
    mark = F.aggregate("values", F.lit(0).cast("long"), lambda t, x: t + x["iglo1"] * x["cover"])
    return found.select("iglo2", "chunk", "n", "at", first.alias("first"), last.alias("last"), mark.alias("mark"))


ROOT = folds.Fold(np.add, 0.0, before=np.square, finish=lambda n, total: np.sqrt(total), parted=True)


@query(f"WITH {SRC}, {CELL} SELECT iglo2, round(sqrt(sum(zs * zs)), 4) AS zs FROM cell GROUP BY iglo2")
def ag_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-REDUCE: a fold of one's own, the root of the sum of squares, in source order."""
    return folds.folded(cells(spark, sf_dir), "zs", ROOT, span=CHUNK).withColumn("zs", F.round("zs", 4))


REMAINDER = folds.Fold(np.fmod, 1e9, before=lambda v: np.floor(v * 4 + 0.5))


@query(f"WITH {SRC}, {CELL} SELECT iglo2, list_reduce(list_prepend(1e9, list(floor(zs * 4 + 0.5) ORDER BY iglo1, zs)), lambda a, x: a % x) AS zs FROM cell WHERE zs IS NOT NULL GROUP BY iglo2")
def ag_reduce_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-REDUCE whose result depends on the order: the remainder of the remainders; the state travels from batch to batch."""
    return folds.folded(cells(spark, sf_dir), "zs", REMAINDER).where("zs is not null")


def _nearest(total: str, n: str, digits: int) -> str:
    """SQL for the double nearest to a non-negative sum of 2^-digits, divided by n, with ties to even: all in whole numbers."""
    q, rest = f"(({total}) // ({n}))", f"(({total}) % ({n}))"
    shift = f"greatest(0, CAST(floor(log2(CAST({q} AS DOUBLE))) AS INTEGER) - 52)"
    unit = f"(1::HUGEINT << {shift})"
    low = f"({q} % {unit})"
    up = f"CASE WHEN 2 * {low} > {unit} OR 2 * {low} = {unit} AND ({rest} > 0 OR ({q} // {unit}) % 2 = 1) THEN 1 ELSE 0 END"
    return f"CASE WHEN {total} = 0 THEN 0.0 ELSE CAST({q} // {unit} + {up} AS DOUBLE) * pow(2.0, {shift} - {digits}) END"


@query(f"""WITH {SRC}, {CELL}, t AS (SELECT iglo2, sum(CAST(zs * pow(2.0, 52) AS HUGEINT)) AS a, count(zs) AS n, sum(CAST(clay * pow(2.0, 62) AS HUGEINT)) AS b, count(clay) AS m FROM cell GROUP BY iglo2)
  SELECT iglo2, {_nearest('a', '1', 52)} AS zs_sum, {_nearest('a', 'n', 52)} AS zs_avg, n AS zs_cnt, {_nearest('b', '1', 62)} AS clay_sum, {_nearest('b', 'm', 62)} AS clay_avg, m AS clay_cnt FROM t WHERE n > 0""")
def ag_sum_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-SUM, AG-AVG with one rounding: the same bits whatever the partitioning, compared without rounding."""
    return exact.sums(cells(spark, sf_dir), ["zs", "clay"]).where("zs_cnt > 0")


COVER = f"{SRC}, {CELL}, n AS (SELECT iglo2, cover, count(*) AS n FROM cell GROUP BY iglo2, cover), frac AS (SELECT iglo2, cover, n, n / CAST(sum(n) OVER (PARTITION BY iglo2) AS DOUBLE) AS frac FROM n)"


@query(f"WITH {COVER} SELECT iglo2, cover, n, round(frac, 9) AS frac FROM frac")
def ag_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covers.fractions(cells(spark, sf_dir)).withColumn("frac", F.round("frac", 9))


@query(f"WITH {SRC}, {CELL} SELECT iglo2, {', '.join(f'round(count_if(cover = {k}) / CAST(count(*) AS DOUBLE), 9) AS cover{k:03d}' for k in range(1, 257))} FROM cell GROUP BY iglo2")
def ag_cover_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = covers.wide(cells(spark, sf_dir))
    return out.select("iglo2", *[F.round(c, 9).alias(c) for c in out.columns[1:]])


@query(f"WITH {SRC}, {CELL} SELECT DISTINCT cover FROM cell")
def ag_nonempty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covers.nonempty(covers.fractions(cells(spark, sf_dir)))


@query(f"WITH {COVER}, {CLASSES} SELECT iglo2, {', '.join(f'round(sum(frac * {p}) / nullif(sum(frac), 0), 6) AS {p}' for p in ('sea', 'nature', 'water', 'town'))} FROM frac JOIN classes USING (cover) GROUP BY iglo2")
def jn_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["sea", "nature", "water", "town"]
    out = covers.parameter_means(covers.fractions(cells(spark, sf_dir)), classes(spark), names)
    return out.select("iglo2", *[r6(c).alias(c) for c in names])


MEASURED = f"""measured AS (SELECT *, 1.0 - sea - water - town AS nature FROM (SELECT c AS cover, coalesce(sea, 0.0) AS sea, coalesce(water, 0.0) AS water, coalesce(town, 0.0) AS town FROM (SELECT CAST(unnest(range(1, 257)) AS INTEGER) AS c) r
  LEFT JOIN (SELECT cover, avg(clay) AS sea, avg(sand) AS water, max(clay) * max(sand) AS town FROM src GROUP BY cover) m ON m.cover = r.c))"""


def measured_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All classes with shares made of the source points that have them."""
    found = source_points(spark, sf_dir).groupBy("cover").agg(F.avg("clay").alias("sea"), F.avg("sand").alias("water"), (F.max("clay") * F.max("sand")).alias("town"))
    every = spark.range(1, 257).select(F.col("id").cast("int").alias("cover")).join(found, "cover", "left").fillna(0.0, ["sea", "water", "town"])
    return every.withColumn("nature", 1.0 - F.col("sea") - F.col("water") - F.col("town"))


@query(f"WITH {SRC}, {MEASURED} SELECT cover, round(sea, 6) AS sea, 0.0 AS water, 0.0 AS town, round(nature + water + town, 6) AS nature FROM measured")
def prj_resol(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = covers.resolved(measured_classes(spark, sf_dir), garden=False, water=False, town=False)
    return out.select("cover", *[r6(c).alias(c) for c in ("sea", "water", "town", "nature")])


SHARES = f"{SRC}, {CELL}, five AS (SELECT iglo2, {', '.join(f'count_if(cover % 5 = {k % 5} AND cover % 4 <> {k - 1}) / CAST(count(*) AS DOUBLE) AS s{k}' for k in range(1, 6))}, CAST(iglo2 % 2 AS DOUBLE) AS land FROM cell GROUP BY iglo2)"
_RANKED = f"ranked AS (SELECT iglo2, k, row_number() OVER (PARTITION BY iglo2 ORDER BY s DESC, k) AS n FROM ({' UNION ALL '.join(f'SELECT iglo2, {k} AS k, s{k} AS s FROM five' for k in range(1, 6))}) WHERE s > 0), two AS (SELECT f.iglo2, f.land, coalesce(max(k) FILTER (n = 1), 0) AS a, coalesce(max(k) FILTER (n = 2), 0) AS b FROM five f LEFT JOIN ranked r USING (iglo2) GROUP BY f.iglo2, f.land)"


def five_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("cover")
    counts = [(F.count_if((c % 5 == k % 5) & (c % 4 != k - 1)) / F.count("*")).alias(f"s{k}") for k in range(1, 6)]
    return cells(spark, sf_dir).groupBy("iglo2").agg(*counts).withColumn("land", (F.col("iglo2") % 2).cast("double"))


@query(f"WITH {SHARES}, {_RANKED} SELECT iglo2, CAST(a AS INTEGER) AS \"first\", CAST(b AS INTEGER) AS \"second\", CAST(CASE WHEN land >= 0.5 THEN CASE WHEN a IN ({covers.SEA}, {covers.LAKE}) THEN CASE WHEN b = 0 THEN {covers.DESERT} ELSE b END ELSE a END WHEN a = {covers.LAKE} THEN a ELSE {covers.SEA} END AS INTEGER) AS dominant FROM two")
def prj_domveg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-DOMVEG, TOP-2."""
    shares = [F.col(f"s{k}") for k in range(1, 6)]
    first, second = covers.top_two(shares)
    return five_shares(spark, sf_dir).select("iglo2", first.alias("first"), second.alias("second"), covers.dominant(shares, F.col("land")).alias("dominant"))


@query(f"WITH {SRC} SELECT iglo1, {', '.join(f'CAST(cover % 5 + 1 = {k} AS DOUBLE) AS t{k}' for k in range(1, 6))} FROM src")
def prj_onehot(spark: SparkSession, sf_dir: str) -> DataFrame:
    hot = covers.one_hot(F.col("cover") % 5 + 1)
    return source_points(spark, sf_dir).select("iglo1", *[h.alias(f"t{k}") for k, h in enumerate(hot, 1)])


@query(f"WITH {SRC} {' UNION ALL '.join(f'SELECT {chr(39)}{c}{chr(39)} AS field, min({c}) AS lo, max({c}) AS hi, round(avg({c}), 6) AS mean FROM src' for c in ('zs', 'clay', 'sand'))}")
def ag_stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regrid.statistics(source_points(spark, sf_dir), ["zs", "clay", "sand"]).withColumn("mean", r6("mean"))


FILL = f"{SRC}, {CELL}, {FIELD}, f AS (SELECT iglo, v, iglo % 3 / 2.0 AS frac FROM field)"


@query(f"WITH {FILL} SELECT iglo, round(CASE WHEN v IS NULL AND frac > 0 THEN (SELECT avg(v) FROM f WHERE frac > 0) ELSE v END, 6) AS v FROM f")
def ag_maskavg(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = field(spark, sf_dir).withColumn("frac", F.col("iglo") % 3 / 2)
    return regrid.filled_with_mean(f, "v", "frac").select("iglo", r6("v").alias("v"))


@query(f"WITH {FILL} SELECT iglo, round(coalesce(v, (SELECT avg(v) FROM f)), 6) AS v FROM f")
def ag_fillavg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regrid.filled_with_mean(field(spark, sf_dir), "v").select("iglo", r6("v").alias("v"))


@query(f"WITH {SRC}, b AS (SELECT zs, CASE WHEN cover % 3 <> 0 THEN zs + cover % 2 END AS w FROM src) SELECT count_if(zs IS NOT NULL AND w IS NULL) AS only_a, count_if(zs IS NULL AND w IS NOT NULL) AS only_b, count_if(zs <> w) AS differ FROM b")
def ag_countdiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = F.when(F.col("cover") % 3 != 0, F.col("zs") + F.col("cover") % 2)
    return regrid.count_differences(source_points(spark, sf_dir).withColumn("w", other), "zs", "w")


_PAIRS = [(f, m) for f in "abc" for m in ("f1", "f2")]
MATCH = f"""m AS (SELECT cover % 2 AS f1, CASE WHEN cover % 3 <> 0 THEN 0.5 ELSE 0.0 END AS f2, clay, sand, cover FROM src), v AS (SELECT f1, f2, CASE WHEN f1 > 0 THEN clay END AS a, CASE WHEN f2 > 0 THEN sand END AS b, CASE WHEN cover = 7 THEN sand END AS c FROM m),
  n AS ({' UNION ALL '.join(f"SELECT '{f}' AS field, '{m}' AS mask, {k} AS k, count_if(({m} > 0) <> ({f} IS NOT NULL)) AS off FROM v" for k, (f, m) in enumerate(_PAIRS))})"""


@query(f"WITH {SRC}, {MATCH} SELECT field, arg_min(mask, k) FILTER (off = 0) AS mask FROM n GROUP BY field")
def jn_maskmatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = source_points(spark, sf_dir)
    f1, f2 = F.col("cover") % 2, F.when(F.col("cover") % 3 != 0, 0.5).otherwise(0.0)
    made = p.withColumns({"f1": f1, "f2": f2}).withColumns({"a": F.when(F.col("f1") > 0, F.col("clay")), "b": F.when(F.col("f2") > 0, F.col("sand")), "c": F.when(F.col("cover") == 7, F.col("sand"))})
    return regrid.matching_masks(made, ["a", "b", "c"], ["f1", "f2"])


def _high_sql() -> str:
    """Central differences of order 2, 4, 6 and 8 around both ends, from arrays of each row and column; coefficients from Taylor's series."""
    out, parts = [], []
    for a, n, other in (("i", TX, "j"), ("j", TY, "i")):
        parts.append(f"l{a} AS (SELECT {other}, list(v ORDER BY {a}) AS l FROM field GROUP BY {other})")
        for order in range(1, 5):
            terms = []
            for k in range(1, order + 1):
                c = (-1) ** (k + 1) * math.factorial(order) ** 2 / (k * math.factorial(order - k) * math.factorial(order + k))
                terms.append(f"({c!r}) * (l{a}.l[(s.{a} + {k}) % {n} + 1] - l{a}.l[(s.{a} + {n} - {k}) % {n} + 1])")
            out.append(f"round({' + '.join(terms)}, 5) AS v_d{a}{order}")
    return f"WITH {SRC}, {CELL}, {FIELD}, {', '.join(parts)} SELECT s.iglo, {', '.join(out)} FROM field s JOIN li ON li.j = s.j JOIN lj ON lj.i = s.i"


@query(_high_sql())
def st_high(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = field(spark, sf_dir)
    for order in range(1, 5):
        out = stencil.high_gradient(out, "v", TX, TY, order=order, periodic=True).withColumnsRenamed({f"v_d{a}": f"v_d{a}{order}" for a in "ij"})
    return out.select("iglo", *[F.round(f"v_d{a}{order}", 5).alias(f"v_d{a}{order}") for a in "ij" for order in range(1, 5)])


ARMS = f"""{SRC}, {CELL}, {FIELD}, arms AS (SELECT s.*, e.v AS ve, w.v AS vw, CASE WHEN s.j = 0 THEN s.v ELSE n.v END AS vn, CASE WHEN s.j = {TY - 1} THEN s.v ELSE o.v END AS vs,
  CASE WHEN s.j = 0 THEN 180.0 - s.y ELSE n.y END AS yn, CASE WHEN s.j = {TY - 1} THEN -180.0 - s.y ELSE o.y END AS ys, cos(radians(s.y)) * radians(1.0) AS bx, radians(1.0) AS by_
  FROM field s JOIN field e ON e.j = s.j AND e.i = (s.i + 1) % {TX} JOIN field w ON w.j = s.j AND w.i = (s.i + {TX - 1}) % {TX} LEFT JOIN field n ON n.j = s.j - 1 AND n.i = s.i LEFT JOIN field o ON o.j = s.j + 1 AND o.i = s.i)"""


def _slope(a: str, b: str, pa: str, pb: str, origin: str, scale: str) -> str:
    core = f"(coalesce({a}, v) - coalesce({b}, v)) / nullif({scale} * ((CASE WHEN {a} IS NULL THEN {origin} ELSE {pa} END) - (CASE WHEN {b} IS NULL THEN {origin} ELSE {pb} END)), 0)"
    return f"CASE WHEN v IS NOT NULL THEN coalesce({core}, 0.0) ELSE {core} END"


@query(f"WITH {ARMS} SELECT iglo, round({_slope('ve', 'vw', 'x + 10.0', 'x - 10.0', 'x', 'bx')}, 4) AS v_dx, round({_slope('vn', 'vs', 'yn', 'ys', 'y', 'by_')}, 4) AS v_dy FROM arms")
def st_grad(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stencil.gradient(field(spark, sf_dir), TARGET, ["v"])
    return out.select("iglo", F.round("v_dx", 4).alias("v_dx"), F.round("v_dy", 4).alias("v_dy"))


@query(f"WITH {ARMS} SELECT iglo, {', '.join(f'round(CASE WHEN v IS NOT NULL THEN coalesce({a} - v, 0.0) END, 6) AS v_{n}' for n, a in (('xp', 've'), ('xm', 'vw'), ('yp', 'vn'), ('ym', 'vs')))}, round(bx * 10.0, 9) AS dxp, round(bx * -10.0, 9) AS dxm, round(by_ * (yn - y), 9) AS dyp, round(by_ * (ys - y), 9) AS dym FROM arms")
def st_half(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stencil.half_differences(field(spark, sf_dir), TARGET, ["v"])
    return out.select("iglo", *[r6(f"v_{n}").alias(f"v_{n}") for n in ("xp", "xm", "yp", "ym")], *[F.round(f"d{n}", 9).alias(f"d{n}") for n in ("xp", "xm", "yp", "ym")])


def gauss_rows() -> str:
    """SQL rows (j, y, lo, hi, nx, dx, off) of GAUSS."""
    y, off, rows = GAUSS.y, 0, []
    mids = [(a + b) / 2 for a, b in zip(y, y[1:])]
    for j, n in enumerate(GAUSS.nx):
        hi, lo = ("1e9" if j == 0 else repr(mids[j - 1])), ("-1e9" if j == len(y) - 1 else repr(mids[j]))
        rows.append(f"({j}, {y[j]!r}::DOUBLE, {lo}::DOUBLE, {hi}::DOUBLE, {n}, {360.0 / n!r}::DOUBLE, {off})")
        off += n
    return ", ".join(rows)


def _near(x: str) -> str:
    """x within half a turn of s.x."""
    turned = f"(180.0 - ({x} - s.x))"
    return f"(s.x + (180.0 - CASE WHEN {turned} % 360.0 < 0 THEN ({turned} % 360.0 + 360.0) % 360.0 ELSE {turned} % 360.0 END))"


def _between(r: str) -> str:
    """The value of a row at s.x between two of its points."""
    a, b = _near(f"{r}w.x"), _near(f"{r}e.x")
    share = f"(CASE WHEN {a} <> {b} THEN ({b} - s.x) / ({b} - {a}) ELSE 1.0 END)"
    return f"CASE WHEN {share} = 1 THEN {r}w.v WHEN {share} = 0 THEN {r}e.v ELSE {share} * {r}w.v + (1 - {share}) * {r}e.v END"


GARMS = f"""{SRC}, gr(j, y, lo, hi, nx, dx, off) AS (VALUES {gauss_rows()}), gcell AS (SELECT CAST(off + CAST(floor(lon / dx + 0.5) AS BIGINT) % nx AS BIGINT) AS iglo, zs FROM src JOIN gr ON lat > lo AND lat <= hi),
  gfield AS (SELECT p.*, m.v FROM (SELECT CAST(off + i AS BIGINT) AS iglo, j, i, i * dx AS x, y, nx, dx FROM (SELECT *, unnest(range(0, nx)) AS i FROM gr)) p LEFT JOIN (SELECT iglo, CASE WHEN count(zs) % 13 <> 5 THEN avg(zs) END AS v FROM gcell GROUP BY iglo) m USING (iglo)),
  arms AS (SELECT s.*, e.v AS ve, w.v AS vw, CASE WHEN s.j = 0 THEN s.v ELSE {_between('n')} END AS vn, CASE WHEN s.j = {GAUSS.ny - 1} THEN s.v ELSE {_between('o')} END AS vs, CASE WHEN s.j = 0 THEN 180.0 - s.y ELSE nr.y END AS yn, CASE WHEN s.j = {GAUSS.ny - 1} THEN -180.0 - s.y ELSE orow.y END AS ys, cos(radians(s.y)) * radians(1.0) AS bx, radians(1.0) AS by_
  FROM gfield s JOIN gfield e ON e.j = s.j AND e.i = (s.i + 1) % s.nx JOIN gfield w ON w.j = s.j AND w.i = (s.i + s.nx - 1) % s.nx LEFT JOIN gr nr ON nr.j = s.j - 1 LEFT JOIN gr orow ON orow.j = s.j + 1
  LEFT JOIN gfield nw ON nw.j = nr.j AND nw.i = CAST(floor(s.x / nr.dx) AS BIGINT) % nr.nx LEFT JOIN gfield ne ON ne.j = nr.j AND ne.i = (CAST(floor(s.x / nr.dx) AS BIGINT) + 1) % nr.nx
  LEFT JOIN gfield ow ON ow.j = orow.j AND ow.i = CAST(floor(s.x / orow.dx) AS BIGINT) % orow.nx LEFT JOIN gfield oe ON oe.j = orow.j AND oe.i = (CAST(floor(s.x / orow.dx) AS BIGINT) + 1) % orow.nx)"""


def gauss_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field with gaps on the reduced Gaussian grid."""
    c = mapping.in_domain(mapping.cell_of(source_points(spark, sf_dir), GAUSS))
    return GAUSS.points(spark).join(c.groupBy(F.col("iglo2").alias("iglo")).agg(gappy("zs").alias("v")), "iglo", "left")


@query(f"WITH {GARMS} SELECT iglo, round({_slope('ve', 'vw', 'x + dx', 'x - dx', 'x', 'bx')}, 4) AS v_dx, round({_slope('vn', 'vs', 'yn', 'ys', 'y', 'by_')}, 4) AS v_dy FROM arms")
def st_grad_gaussian(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-GRAD, JN-HALO on rows of unequal size: bands of rows with their halo."""
    out = stencil.gradient(gauss_field(spark, sf_dir), GAUSS, ["v"])
    return out.select("iglo", F.round("v_dx", 4).alias("v_dx"), F.round("v_dy", 4).alias("v_dy"))


@query(f"WITH {GARMS} SELECT iglo, {', '.join(f'round(CASE WHEN v IS NOT NULL THEN coalesce({a} - v, 0.0) END, 6) AS v_{n}' for n, a in (('xp', 've'), ('xm', 'vw'), ('yp', 'vn'), ('ym', 'vs')))}, round(bx * dx, 9) AS dxp, round(-bx * dx, 9) AS dxm, round(by_ * (yn - y), 9) AS dyp, round(by_ * (ys - y), 9) AS dym FROM arms")
def st_half_gaussian(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-HALF on rows of unequal size."""
    out = stencil.half_differences(gauss_field(spark, sf_dir), GAUSS, ["v"])
    return out.select("iglo", *[r6(f"v_{n}").alias(f"v_{n}") for n in ("xp", "xm", "yp", "ym")], *[F.round(f"d{n}", 9).alias(f"d{n}") for n in ("xp", "xm", "yp", "ym")])


def mapping_sql(pt: str, gauss: bool = False) -> str:
    """CTE w4 (iglo2, iglo1, w): the 4-point mapping from the target grid's points, or those of GAUSS, to points (iglo, plon, plat, qlon); qlon: longitude of the point's neighbour on its row."""
    xyz = lambda p: f"cos(radians({p}lat)) * cos(radians({p}lon)) AS {p}x, cos(radians({p}lat)) * sin(radians({p}lon)) AS {p}y, sin(radians({p}lat)) AS {p}z"
    ang = lambda a, b: f"acos(greatest(-1.0, least(1.0, {a}x * {b}x + {a}y * {b}y + {a}z * {b}z)))"
    c = ("c0", "c1", "c2", "c3")
    dist = ", ".join([f"{ang('p', c[k])} AS d{k}, {ang(c[k], c[mapping.NEXT[k]])} AS e{k}" for k in range(4)])
    after = [f"(d{k} + d{mapping.NEXT[k]} - e{k})" for k in range(4)]
    near = " ".join(f"WHEN {after[k]} < r / 1000 THEN [{', '.join(f'1.0 - d{k} / e{k}' if m == k else f'd{k} / e{k}' if m == mapping.NEXT[k] else '0.0' for m in range(4))}]" for k in range(4))
    plain = ", ".join(f"1.0 / greatest(1e-30, {after[k]} * {after[mapping.PREV[k]]})" for k in range(4))
    res = "acos(greatest(-1.0, least(1.0, cos(radians(plat)) * cos(radians(plon)) * cos(radians(plat)) * cos(radians(qlon)) + cos(radians(plat)) * sin(radians(plon)) * cos(radians(plat)) * sin(radians(qlon)) + sin(radians(plat)) * sin(radians(plat)))))"
    if gauss:
        ny = GAUSS.ny
        rows = f"gn(j, y, lo, hi, nx, dx, off) AS (VALUES {gauss_rows()})"
        keys = ", ".join(f"{r}.off + (CAST(floor(plon / {r}.dx) AS BIGINT) + {e}) % {r}.nx AS c{k}, ((CAST(floor(plon / {r}.dx) AS BIGINT) + {e}) % {r}.nx) * {r}.dx AS c{k}lon, {r}.y AS c{k}lat" for k, (r, e) in enumerate((("so", 0), ("so", 1), ("no", 0), ("no", 1))))
        start = f"""p4 AS ({pt}), {rows}, q4 AS (SELECT *, (SELECT count(*) FROM gn WHERE gn.y >= plat) - 1 AS jn FROM p4), g4 AS (SELECT q4.*, {keys}, {res} AS r FROM q4 LEFT JOIN gn no ON no.j = jn LEFT JOIN gn so ON so.j = jn + 1)"""
    else:
        ny = TY
        col = {0: "iw", 1: "(iw + 1)", 2: "iw", 3: "(iw + 1)"}
        row = {0: "(jn + 1)", 1: "(jn + 1)", 2: "jn", 3: "jn"}
        keys = ", ".join(f"{row[k]} * {TX} + {col[k]} % {TX} AS c{k}, 5.0 + 10.0 * ({col[k]} % {TX}) AS c{k}lon, 85.0 - 10.0 * {row[k]} AS c{k}lat" for k in range(4))
        start = f"""p4 AS ({pt}), q4 AS (SELECT *, CAST(floor((plat - 85.0) / -10.0) AS BIGINT) AS jn, CAST(((floor((plon - 5.0) / 10.0) + {TX}) % {TX}) AS BIGINT) AS iw FROM p4), g4 AS (SELECT *, {keys}, {res} AS r FROM q4)"""
    # Beyond the first or last row the first corner whose next is missing counts alone.
    edge = f"WHEN jn < 0 THEN [0.0, 1.0, 0.0, 0.0] WHEN jn >= {ny - 1} THEN [0.0, 0.0, 1.0, 0.0]"
    return f"""{start}, h4 AS (SELECT *, {xyz('p')}, {', '.join(xyz(x) for x in c)} FROM g4), t4 AS (SELECT *, {dist} FROM h4),
  u4 AS (SELECT iglo, [c0, c1, c2, c3] AS corners, CASE {edge} {near} ELSE [{plain}] END AS ws FROM t4), w4 AS (SELECT iglo AS iglo2, unnest(corners) AS iglo1, unnest(list_transform(ws, lambda x: x / list_sum(ws))) AS w FROM u4)"""


def mean4_sql(field: str) -> str:
    """The weighted mean of a field over the corners that have it."""
    return f"CASE WHEN sum(CASE WHEN {field} IS NOT NULL THEN w END) > 0 THEN sum(CASE WHEN w <> 0 THEN w * {field} END) / sum(CASE WHEN {field} IS NOT NULL THEN w END) END"


def _weights_sql(pt: str) -> str:
    return f"WITH {SRC}, {CELL}, {FIELD}, {mapping_sql(pt)} SELECT iglo2, round({mean4_sql('v')}, 5) AS v FROM w4 JOIN field ON field.iglo = w4.iglo1 GROUP BY iglo2"


FINE_POINTS = "SELECT *, CASE WHEN iglo % 50 > 0 THEN plon - 7.2 ELSE plon + 7.2 END AS qlon FROM (SELECT iglo, 2.3 + 7.2 * (iglo % 50) AS plon, 80.1 + (-6.7) * (iglo // 50) AS plat FROM (SELECT unnest(range(0, 1250)) AS iglo))"


def gauss_points() -> str:
    off, rows = 0, []
    for lat, n in zip(GAUSS.y, GAUSS.nx):
        rows.append(f"({off}, {lat!r}::DOUBLE, {n}, {360.0 / n!r}::DOUBLE)")
        off += n
    return f"SELECT off + i AS iglo, i * dx AS plon, lat AS plat, CASE WHEN i > 0 THEN (i - 1) * dx ELSE (i + 1) * dx END AS qlon FROM (SELECT *, unnest(range(0, nx)) AS i FROM (VALUES {', '.join(rows)}) AS r(off, lat, nx, dx))"


@query(_weights_sql(FINE_POINTS))
def st_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-CORNER, ST-WGT, ST-APPLY: 4-point values with gaps in the source."""
    m = mapping.mapping4(FINE.points(spark), TARGET, mapping.resolution(FINE, F.col("j"), F.col("i")))
    return regrid.interpolate4(m, field(spark, sf_dir), ["v"]).select("iglo2", F.round("v", 5).alias("v"))


@query(f"""WITH {SRC}, {CELL}, {FIELD}, {mapping_sql(FINE_POINTS)}, m AS (SELECT iglo, mm, v + 10 * mm AS v FROM field, (SELECT unnest(range(0, 3)) AS mm))
  SELECT iglo2, CAST(mm AS INTEGER) AS \"month\", round({mean4_sql('v')}, 5) AS v FROM w4 JOIN m ON m.iglo = w4.iglo1 GROUP BY iglo2, mm""")
def st_apply_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-APPLY of a mapping that is stored once and applied twice: to the field, then to two months at a time."""
    made = mapping.mapping4(FINE.points(spark), TARGET, mapping.resolution(FINE, F.col("j"), F.col("i")))
    stored = kept.build(made, f"gridloom_mapping_{uuid.uuid4().hex}", buckets=4, side=128)
    f = field(spark, sf_dir)
    year = kept.apply(stored, f, ["v"]).select("iglo2", F.lit(0).alias("month"), "v")
    each = f.withColumn("month", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("v", F.col("v") + 10 * F.col("month"))
    months = kept.apply(stored, each, ["v"], by=("month",)).select("iglo2", "month", "v")
    return year.unionByName(months).withColumn("v", F.round("v", 5))


_TURN = "CASE WHEN lon - {0} > 180 THEN lon - {0} - 360 ELSE lon - {0} END * radians(1.0) * sin(radians(46.2))"


@query(f"""WITH {SRC}, {CELL}, t AS (SELECT iglo2 AS iglo, 5.0 + 10.0 * (iglo2 % {TX}) AS lon, avg(zs) / 1000 AS u, avg(clay) * 100 AS v FROM cell GROUP BY iglo2), g AS (SELECT iglo, u, v, {_TURN.format(2.0)} AS a, {_TURN.format(30.0)} AS b FROM t),
  e AS (SELECT *, u * cos(a) + v * sin(a) AS east, v * cos(a) - u * sin(a) AS north FROM g) SELECT iglo, round(east, 6) AS east, round(north, 6) AS north, round(east * cos(b) - north * sin(b), 6) AS u, round(east * sin(b) + north * cos(b), 6) AS v FROM e""")
def st_rot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-ROT: from one Lambert grid's axes to east and north, and to another's axes."""
    a, b = (grids.lambert(8, 8, 5e4, 5e4, 8, 8, 46.2, 46.2, 46.2, lon) for lon in (2.0, 30.0))
    means = cells(spark, sf_dir).groupBy(F.col("iglo2").alias("iglo")).agg((F.avg("zs") / 1000).alias("u"), (F.avg("clay") * 100).alias("v"))
    p = TARGET.points(spark).join(means, "iglo").withColumns({"east": F.col("u"), "north": F.col("v")})
    out = stencil.rotate(stencil.rotate(p, [("east", "north")], a), [("u", "v")], a, b)
    return out.select("iglo", *[r6(c).alias(c) for c in ("east", "north", "u", "v")])


@query(f"WITH {SRC}, {CELL} SELECT iglo1, row_number() OVER (ORDER BY iglo2, iglo1) AS place FROM cell")
def so_reord(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SO-REORD, SO-KEYS, SO-OMP: places in the order of target and source; sorted within each target, offset by the targets before."""
    from pyspark.sql import Window

    c = cells(spark, sf_dir)
    own = F.row_number().over(Window.partitionBy("iglo2").orderBy("iglo1"))
    return c.withColumn("_n", own).join(regrid.counts(c).drop("cnt"), "iglo2").select("iglo1", (F.col("off") + F.col("_n")).alias("place"))


@query(f"WITH {ARMS}, g AS (SELECT iglo, x, y, v, ({_slope('ve', 'vw', 'x + 10.0', 'x - 10.0', 'x', 'bx')}) / {geo.EARTH_RADIUS} AS gx, ({_slope('vn', 'vs', 'yn', 'ys', 'y', 'by_')}) / {geo.EARTH_RADIUS} AS gy FROM arms),"
       " c AS (SELECT CAST(greatest(0, least(8, floor((y - 80.0) / -20.0 + 0.5))) * 18 + floor((x - 10.0) / 20.0 + 0.5) % 18 AS BIGINT) AS iglo2, avg(gx * gx) AS xx, avg(gy * gy) AS yy, avg(gx * gy) AS xy, avg(v * v) AS sq, avg(v) AS av"
       " FROM (SELECT *, x + 0.000001 AS x_ FROM g) GROUP BY 1), k AS (SELECT *, 0.5 * (xx + yy) AS k, 0.5 * (xx - yy) AS l, sqrt(0.25 * (xx - yy) * (xx - yy) + xy * xy) AS r FROM c)"
       " SELECT iglo2, CASE WHEN av IS NOT NULL THEN round(atan2(xy, l) * 90 / pi(), 4) END AS dir, CASE WHEN av IS NOT NULL THEN round(sqrt(k + r), 9) END AS slope, CASE WHEN av IS NOT NULL THEN round(CASE WHEN k + r > 0 THEN sqrt(greatest(k - r, 0.0) / (k + r)) ELSE 1.0 END, 5) END AS anis, CASE WHEN av IS NOT NULL THEN round(sqrt(greatest(sq - av * av, 0.0)), 3) END AS stdev FROM k")  # fmt: skip
def prj_tensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-PROD, PRJ-TENSOR: subgrid relief of 20-degree cells."""
    out = physio.terrain_tensor(field(spark, sf_dir).withColumnRenamed("v", "zs"), TARGET, grids.shifted_lonlat(18, 9))
    return out.select("iglo2", F.round("dir", 4).alias("dir"), F.round("slope", 9).alias("slope"), F.round("anis", 5).alias("anis"), F.round("stdev", 3).alias("stdev"))


@query(f"WITH {SRC}, t AS (SELECT iglo1, CASE WHEN cover = 1 THEN NULL ELSE zs END AS zs, cover FROM src) SELECT iglo1, zs AS masked, coalesce(zs, 0.0) AS zero, coalesce(zs, CAST(cover AS DOUBLE)) AS mixed, zs - cover AS diff, round(CASE WHEN zs IS NOT NULL THEN greatest(0.0, (zs - 40000) / 10) END, 6) AS rise, CASE WHEN zs > 40000 THEN (zs - 40000) * 0.5 END AS half, CASE WHEN zs < 40000 THEN (40000 - zs) * 0.5 END AS half_fall, zs + 10.0 AS envelope FROM t")
def prj_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-MASKSET, PRJ-NVL0, PRJ-COALESCE, PRJ-DIFF, PRJ-CLAMPPOS, PRJ-HALFHT, PRJ-ENVELOPE."""
    z = F.col("zs")
    p = source_points(spark, sf_dir).withColumn("zs", fx.masked(z, F.col("cover") == 1))
    return p.select("iglo1", z.alias("masked"), fx.or_zero(z).alias("zero"), fx.mixed(z, F.col("cover").cast("double")).alias("mixed"), fx.difference(z, F.col("cover")).alias("diff"), r6(fx.positive_slope(z - 40000, F.lit(10))).alias("rise"), fx.half_height(z - 40000).alias("half"), fx.half_height(z - 40000, falls=True).alias("half_fall"), fx.envelope(z, F.lit(10.0)).alias("envelope"))


@query(f"WITH {SRC} SELECT iglo1, CASE WHEN clay > 0.05 THEN -300.0 END AS bathy, CASE WHEN sand > 0.02 THEN 0.5 END AS runoff, CASE WHEN sand > 0.02 THEN 0.0 END AS wdrain, CASE WHEN clay * 10 > 0.5 OR sand * 10 > 0.5 THEN 0.0 ELSE 1.0 END AS land FROM src")
def prj_dummy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-DUMMY, PRJ-LANDSEA."""
    sea, nature = F.when(F.col("clay") > 0.05, F.col("clay")).otherwise(0.0), F.when(F.col("sand") > 0.02, F.col("sand")).otherwise(0.0)
    d = fx.dummies(sea, nature)
    return source_points(spark, sf_dir).select("iglo1", *[c.alias(n) for n, c in d.items()], fx.land_sea(F.col("clay") * 10, F.col("sand") * 10).alias("land"))


_Z = f"(4 * clay) * {0.25 * fx.CDZ0EFF / (2 * fx.KARMAN**2)!r}"


@query(f"WITH {SRC} SELECT iglo1, CASE WHEN zs IS NOT NULL THEN round(CASE WHEN {_Z} > 0 THEN greatest(4 * sand * 0.25 * exp(-sqrt(1.0 / nullif({_Z}, 0))), 1e-10) ELSE 0.0 END, 9) END AS z0 FROM src")
def prj_z0rel(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = fx.relief_roughness(F.col("zs"), [F.col("clay")] * 4, [F.col("sand")] * 4)
    return source_points(spark, sf_dir).select("iglo1", F.round(z, 9).alias("z0"))


def _both(a: str, b: str) -> str:
    return f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN least({a}, {b}) END"


def _within(x: str, low: float, high: float) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN greatest({low!r}, least({high!r}, {x})) END"


def _by_class(water: str, ice: str, else_: str) -> str:
    return f"CASE WHEN kind IN (1, 5) THEN {water} WHEN kind = 2 THEN {ice} ELSE {else_} END"


_DEEP = _both("depth_max_", "depth_")
SOIL = f"""t AS (SELECT iglo1, cover % 5 + 1 AS kind, sand * 1200 AS sand0, clay * 900 AS clay0, sand * 12 AS albedo0, 0.85 + clay * 2 AS emis0, zs / 8000 AS deepest0, zs / 9000 AS dpr, clay * 8 AS vgx, sand * 10 AS land, sand * 9 AS urban0 FROM src),
  v AS (SELECT *, CASE WHEN {_within('vgx', 0.0, 1.0)} < 0.02 THEN 0.0 ELSE {_within('vgx', 0.0, 1.0)} END AS veg FROM t),
  d AS (SELECT *, veg * {_both('dpr', 'deepest0')} + (1 - veg) * deepest0 AS depth_, {_within('clay0', 3.0, 58.0)} AS c, {_within('sand0', 6.0, 92.0)} AS s, {_within('deepest0', 0.1, 8.0)} AS depth_max_, veg * land AS veg_max_ FROM v)"""


@query(f"""WITH {SRC}, {SOIL} SELECT iglo1, round(depth_, 6) AS depth_before, round(veg, 9) AS veg, round({_by_class('0.07', '0.75', _within('albedo0', 0.05, 0.8))}, 9) AS albedo, round({_by_class('0.96', '0.98', _within('emis0', 0.9, 1.0))}, 9) AS emis,
  round({_by_class('8.0', '0.1', 'depth_max_')}, 6) AS depth_max, round({_by_class('3.0', '3.0', 'c / (greatest(100.0, c + s) / 100)')}, 6) AS clay, round({_by_class('6.0', '6.0', 's / (greatest(100.0, c + s) / 100)')}, 6) AS sand, round({_by_class('0.0', '0.0', 'veg_max_')}, 9) AS veg_max,
  round({_by_class('8.0', '0.1', f'CASE WHEN {_DEEP} IS NOT NULL THEN greatest(0.1, {_DEEP}) END')}, 6) AS depth, round({_by_class('0.0', '0.0', _both('1 - veg_max_', 'urban0'))}, 9) AS urban FROM d""")
def prj_soil(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-SOILFIX, PRJ-SOILDEPTH, with every column."""
    p = source_points(spark, sf_dir)
    sand, clay, zs = F.col("sand"), F.col("clay"), F.col("zs")
    before, veg = fx.soil_depth(clay * 8, zs / 9000, zs / 8000)
    soil = {"sand": sand * 1200, "clay": clay * 900, "albedo": sand * 12, "emis": 0.85 + clay * 2, "depth_max": zs / 8000, "depth": before, "veg_max": veg, "urban": sand * 9}
    out = fx.soil_final(F.col("cover") % 5 + 1, sand * 10, soil)
    return p.select("iglo1", r6(before).alias("depth_before"), F.round(veg, 9).alias("veg"), *[(r6(c) if n in ("depth_max", "clay", "sand", "depth") else F.round(c, 9)).alias(n) for n, c in out.items()])


VEG = """t AS (SELECT iglo1, cover % 5 + 1 AS kind, CASE WHEN cover % 11 = 0 THEN NULL ELSE clay END AS z0v, CASE WHEN cover % 7 = 0 THEN NULL ELSE cover / 50.0 END AS lai0, zs / 1000 AS rsm0, sand * 14 AS share, sand * 8 AS green0, 0.3 + clay * 6 AS land, clay * 3 AS urban, clay * 20 AS z00, sand * 9 AS alb0, clay * 7 AS alv, 0.02 AS z0m, 0.07 AS albm FROM src),
  b AS (SELECT *, CASE WHEN share < 0.02 OR z0v < 1e-10 OR z0v IS NULL THEN NULL ELSE ln(nullif(z0v, 0)) END AS log_z0, CASE WHEN share < 0.02 OR lai0 IS NULL OR rsm0 < 1e-10 THEN NULL ELSE lai0 END AS lai, CASE WHEN share < 0.02 OR lai0 IS NULL OR rsm0 < 1e-10 THEN NULL ELSE coalesce(lai0 / rsm0, 0.0) END AS ratio FROM t),
  c AS (SELECT *, greatest(0.0, least(1.0, share)) AS vi, kind = 2 OR share < 0.02 AS bare FROM b),
  w AS (SELECT *, CASE WHEN bare THEN 0.0 ELSE least(green0, vi * land) END AS zv, CASE WHEN bare THEN 0.001 ELSE exp(coalesce(log_z0, -100.0)) END AS rough, CASE WHEN bare THEN 0.05 ELSE greatest(0.05, least(0.8, alv)) END AS za, CASE WHEN bare THEN 0.0 ELSE coalesce(lai, 0.0) END AS zl,
    CASE WHEN bare THEN 5000.0 ELSE greatest(1.0, least(5000.0, coalesce(coalesce(lai, 0.0) / greatest(ratio, 1e-10), 0.0))) END AS zr FROM c),
  z AS (SELECT *, 9.80665 * (zv * rough + urban * 2.5 + (1 - urban - zv) * 0.001) AS zz, kind IN (1, 5) AS water FROM w)"""


@query(f"""WITH {SRC}, {VEG} SELECT iglo1, round(log_z0, 9) AS log_z0, round(lai, 6) AS lai_before, round(ratio, 9) AS conductance, round(CASE WHEN water THEN 0.0 ELSE zv END, 9) AS veg, round(CASE WHEN water THEN z0m ELSE sqrt(z00 * z00 + zz * zz) END, 6) AS z0,
  round(CASE WHEN water THEN albm ELSE greatest(0.05, least(0.8, (1 - zv) * alb0 + zv * za)) END, 9) AS albedo, round(CASE WHEN water THEN 0.0 ELSE zl END, 6) AS lai, round(CASE WHEN water THEN 5000.0 ELSE zr END, 6) AS rsmin, round(CASE WHEN water THEN z00 ELSE zz * 0.1 END, 6) AS z0_therm,
  round(CASE WHEN water THEN 0.0 ELSE zz END, 6) AS z0_veg, round(CASE WHEN water THEN 0.05 ELSE za END, 9) AS albedo_veg FROM z""")
def prj_veg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-VEGPREP, PRJ-VEGPOST, with every column."""
    p = source_points(spark, sf_dir)
    sand, clay, cover = F.col("sand"), F.col("clay"), F.col("cover")
    a, b, c = fx.vegetation_before(F.when(cover % 11 != 0, clay), F.when(cover % 7 != 0, cover / 50.0), F.col("zs") / 1000, sand * 14)
    base = {"veg": sand * 8, "land": 0.3 + clay * 6, "urban": clay * 3, "z0": clay * 20, "albedo": sand * 9}
    after = fx.vegetation_after(a, clay * 7, b, c, sand * 14, cover % 5 + 1, base, {"z0": F.lit(0.02), "albedo": F.lit(0.07)})
    digits = {"z0": 6, "lai": 6, "rsmin": 6, "z0_therm": 6, "z0_veg": 6}
    nudged = lambda n, x: r6(x) if digits.get(n) == 6 else F.round(x, digits.get(n, 9))
    return p.select("iglo1", F.round(a, 9).alias("log_z0"), r6(b).alias("lai_before"), F.round(c, 9).alias("conductance"), *[nudged(n, x).alias(n) for n, x in after.items()])


def _pressure_sql(t: str) -> str:
    water, ice = (f"exp({a!r} - {b!r} / ({t}) - {c!r} * ln({t}))" for a, b, c in (fx.OVER_WATER, fx.OVER_ICE))
    return f"CASE WHEN {t} <= 273.16 THEN {ice} ELSE {water} END"


CLIMATE = f"""t AS (SELECT iglo1, 250.0 + clay * 500 AS t, 240.0 + sand * 600 AS td, zs, clay, sand, cover % 5 + 1 AS kind FROM src), h AS (SELECT *, greatest(0.0, least(1.0, ({_pressure_sql('least(td, t)')}) / ({_pressure_sql('t')}))) AS hum FROM t),
  w AS (SELECT *, acos(1 - 2 * hum) / pi() AS wet FROM h), x AS (SELECT *, greatest(0.0, least(1.0, sand / greatest(1e-10, clay))) AS x, greatest(0.0, least(1.0, 0.04 * wet * (273.16 - t))) AS y FROM w),
  s AS (SELECT *, greatest(0.0, 10 * x / (1.0001 - x) + 1000 * (1 - cos(pi() * y)) / 2) AS snow FROM x)"""


@query(f"""WITH {SRC}, {CLIMATE} SELECT iglo1, round(t + zs * 0.0065, 6) AS sea_level, round(t - zs * 0.0065, 6) AS surface, round(hum, 9) AS humidity, round(wet, 7) AS wetness, round(snow, 3) AS snow, round(CASE WHEN kind = 2 THEN 10000.0 ELSE least(1000.0, snow) END, 3) AS snow_limited,
  CASE WHEN kind IN (1, 5) THEN CASE WHEN t <= 271.23 THEN 0.65 ELSE 0.07 END ELSE clay END AS albedo, CASE WHEN kind IN (1, 5) THEN CASE WHEN t <= 271.23 THEN 0.97 ELSE 0.96 END ELSE sand END AS emis, round(CASE WHEN kind IN (1, 5) THEN 0.001 * 9.80665 ELSE zs END, 6) AS z0,
  round(ln(greatest(0.01, least(0.08, sand)) / 0.01) / {math.log(0.08 / 0.01)!r}, 9) AS scaled FROM s""")
def prj_climate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-TLAPSE, PRJ-SNOW/HUM, PRJ-WATERSFC, PRJ-LOGSCALE, with every column."""
    p = source_points(spark, sf_dir).withColumns({"t": 250.0 + F.col("clay") * 500, "td": 240.0 + F.col("sand") * 600, "kind": F.col("cover") % 5 + 1})
    t, zs, kind = F.col("t"), F.col("zs"), F.col("kind")
    humid = fx.relative_humidity(t, F.col("td"))
    wet = fx.soil_wetness(humid)
    snow = fx.snow_reserve(t, wet, F.col("sand"), F.col("clay"))
    water = fx.water_surface(t, kind, {"albedo": F.col("clay"), "emis": F.col("sand"), "z0": zs})
    return p.select("iglo1", r6(fx.lapse_corrected(t, zs, 0.0065)).alias("sea_level"), r6(fx.lapse_corrected(t, zs, 0.0065, False)).alias("surface"), F.round(humid, 9).alias("humidity"), F.round(wet, 7).alias("wetness"), F.round(snow, 3).alias("snow"), F.round(fx.snow_limited(snow, kind), 3).alias("snow_limited"), water["albedo"].alias("albedo"), water["emis"].alias("emis"), r6(water["z0"]).alias("z0"), F.round(fx.log_scaled(F.col("sand"), 0.01, 0.08), 9).alias("scaled"))


_XYZ = "cos(radians(lat)) * cos(radians(lon)) AS px, cos(radians(lat)) * sin(radians(lon)) AS py, sin(radians(lat)) AS pz"


@query(f"WITH {SRC}, t AS (SELECT iglo1, {_XYZ} FROM src) SELECT iglo1, round(px, 9) AS x, round(py, 9) AS y, round(pz, 9) AS z, round(acos(greatest(-1.0, least(1.0, px))), 7) AS angle, round(sqrt(pz * pz + py * py), 9) AS cross_norm FROM t")
def prj_xyz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-XYZ, PRJ-ANGLE, PRJ-CROSS/NORM."""
    p, e = geo.unit_vector(F.col("lon"), F.col("lat")), (F.lit(1.0), F.lit(0.0), F.lit(0.0))
    return source_points(spark, sf_dir).select("iglo1", *[F.round(c, 9).alias(n) for n, c in zip("xyz", p)], F.round(geo.angle(p, e), 7).alias("angle"), F.round(geo.norm(geo.cross(e, p)), 9).alias("cross_norm"))


@query(f"WITH {SRC} SELECT iglo1, round(cos(radians(lat)) * cos(radians(lon)), 9) AS fx, round(-cos(radians(lat)) * sin(radians(lon)) * {math.pi / 180!r}, 9) AS fx_dlon, round(cos(radians(lat)) * {math.pi / 180!r}, 9) AS fz_dlat, round(pow(lon * (360 - lon) * (lat + 90) * (90 - lat), 2) / pow(CAST(64800 AS DOUBLE), 4), 9) AS bump FROM src")
def src_synthetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-SYN-XYZ, SRC-SYN-BUMP at the source points."""
    p = unit_sphere(source_points(spark, sf_dir))
    return p.select("iglo1", *[F.round(c, 9).alias(c) for c in ("fx", "fx_dlon", "fz_dlat")], F.round(geo.bump(F.col("lon"), F.col("lat"), 0.0, 360.0, -90.0, 90.0), 9).alias("bump"))


def lag_sql(lag: float) -> str:
    """What the month d months before adds, as SQL of d: the year's harmonics damped and turned one by one."""
    waves = " + ".join(f"2 * exp(-{lag!r} * sqrt({k})) * cos(2 * pi() * {k} * d / 12 - {lag!r} * sqrt({k}))" for k in range(1, 6))
    return f"(1 + {waves} + exp(-{lag!r} * sqrt(6)) * cos({lag!r} * sqrt(6)) * cos(pi() * d)) / 12"


@query(f"""WITH m AS (SELECT o_custkey % 36 AS iglo, CAST(month(o_orderdate) AS INTEGER) AS "month", avg(o_totalprice) AS v FROM orders GROUP BY 1, 2),
  p AS (SELECT a.iglo, a."month", a.v, b.v AS other, (a."month" - b."month" + 12) % 12 AS d FROM m a JOIN m b ON a.iglo = b.iglo)
  SELECT iglo, "month", round(any_value(v), 6) AS v, CASE WHEN count(*) = 12 THEN round(sum(other * {lag_sql(pipelines.TEMPERATURE_LAG)}), 5) END AS surface, CASE WHEN count(*) = 12 THEN round(sum(other * {lag_sql(pipelines.MOISTURE_LAG)}), 5) END AS moisture FROM p GROUP BY iglo, "month\"""")
def prj_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-LAG: the months of the orders, later by the lags of temperature and of moisture."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    m = o.groupBy((F.col("o_custkey") % 36).alias("iglo"), F.month("o_orderdate").alias("month")).agg(F.avg("o_totalprice").alias("v"))
    both = m
    for name, lag in (("surface", pipelines.TEMPERATURE_LAG), ("moisture", pipelines.MOISTURE_LAG)):
        both = pipelines.lagged_cycle(both, "v", lag).withColumnRenamed("v_lagged", name)
    return both.select("iglo", "month", r6("v").alias("v"), F.round("surface", 5).alias("surface"), F.round("moisture", 5).alias("moisture"))


@query(_weights_sql(gauss_points()).replace("SELECT iglo2, round", "SELECT iglo2 AS iglo, round"))
def pg_interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PG-INT onto a reduced Gaussian grid."""
    return pipelines.field_to_field(field(spark, sf_dir), TARGET, GAUSS, ["v"]).withColumn("v", F.round("v", 5))
