"""Queries for sources, sinks and whole programs, driven by files and fields made of the test tables, with their SQL.

Files go to the folder that driver and executors share (spark.checkpoint.dir); one of our own only where none is set
and all run in one process.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fields as fx
from ..operators import covers, kept, mapping
from .. import tools
from ..sources import classes, packing, rasters, sinks
from . import climatology, grids, pipelines
from .catalog import CELL, CLASSES, FIELD, GAUSS, MEASURED, NUDGE, NX, NY, REGION, SOURCE, SRC, TARGET, TX, TY, _both, _by_class, _pressure_sql, _within, field, gauss_points, gauss_rows, lag_sql, mapping_sql, mean4_sql, measured_classes, r6, source_points
from .catalog import classes as class_shares
from .scratch import folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql.replace(", 6)", f" + {NUDGE}, 6)")
        return f

    return add


def put(path: str, data: bytes) -> str:
    """Writes a small file to any file system."""
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(path if ":" in path else "file://" + path)
    system.create_dir(place.rpartition("/")[0], recursive=True)
    with system.open_output_stream(place, compression=None) as out:
        out.write(data)
    return path


def record(values: np.ndarray) -> bytes:
    data = values.astype(">f8").tobytes()
    mark = len(data).to_bytes(4, "big")
    return mark + data + mark


def dense(spark: SparkSession, sf_dir: str) -> np.ndarray:
    """The field's values in the order of its points, on the driver: the grid has 648 of them."""
    rows = field(spark, sf_dir).select("iglo", "v").orderBy("iglo").collect()
    return np.array([np.nan if r["v"] is None else r["v"] for r in rows])


CELLS = f"n AS (SELECT j, i, count(*) AS n, min(cover) AS c FROM src GROUP BY j, i), r AS (SELECT iglo // {NX} AS j, iglo % {NX} AS i FROM (SELECT unnest(range(0, {NX * NY})) AS iglo))"


@query(f"WITH {SRC}, {CELLS} SELECT 'height' AS kind, CAST(r.j AS INTEGER) AS j, CAST(r.i AS INTEGER) AS i, round(n * 0.25, 6) AS value FROM r LEFT JOIN n USING (j, i) WHERE r.i BETWEEN 9 AND 50 AND r.j BETWEEN 29 AND 50 UNION ALL SELECT 'cover', CAST(r.j AS INTEGER), CAST(r.i AS INTEGER), round(c % 200, 6) FROM r LEFT JOIN n USING (j, i)")
def src_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-DH, SRC-HDR, SRC-SCALE, SRC-CLIP, SRC-BBOX: 16-bit heights clipped to a target's box, 8-bit classes with a negative sentinel."""
    found = source_points(spark, sf_dir).groupBy("j", "i").agg(F.count("*").alias("n"), F.min("cover").alias("c")).collect()  # a row for each cell of the grid
    heights, kinds = np.full((NY, NX), -9999, ">i2"), np.full((NY, NX), 255, "u1")
    for r in found:
        heights[r["j"], r["i"]], kinds[r["j"], r["i"]] = r["n"], r["c"] % 200
    top = folder(spark, "raster")
    out = None
    for name, data, bits, nodata, scale, box in (("height", heights, 16, -9999, 0.25, REGION.box(spark)), ("cover", kinds, 8, -1, 1.0, None)):
        put(f"{top}/{name}.dir", data.tobytes())
        put(f"{top}/{name}.hdr", f"a raster\\nnodata: {nodata}\\nnorth: 90\\nsouth: -90\\nwest: 0\\neast: 360\\nrows: {NY}\\ncols: {NX}\\nrecordtype: integer {bits} bits\\n".replace("\\n", "\n").encode())
        head = rasters.read_header(spark, f"{top}/{name}.hdr")
        one = rasters.raster(spark, f"{top}/{name}.dir", head, scale, (box[0], box[1], box[2], box[3]) if box else None).select(F.lit(name).alias("kind"), "j", "i", r6("value").alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


BLOCKS = ("LFrac", "OrogG", "IFrac", "Temp_g.1", "Temp_d.1", "Temp_s.1", "Temp_g.2", "Temp_d.2", "Temp_s.2")


@query(f"WITH {SRC}, {CELL}, {FIELD} SELECT split_part(b.name, '.', 1) AS field, coalesce(try_cast(split_part(b.name, '.', 2) AS INTEGER), 0) AS \"month\", j, i, round(coalesce(v, 0) + b.k, 6) AS value FROM field, (SELECT unnest({list(BLOCKS)!r}) AS name, unnest(range(0, 9)) AS k) b")
def src_climate_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-N108."""
    v = np.nan_to_num(dense(spark, sf_dir))
    path = put(f"{folder(spark, 'blocks')}/n108", b"".join(record(v + k) for k in range(len(BLOCKS))))
    return rasters.climate_blocks(spark, path, TX, TY).withColumn("value", r6("value"))


@query(f"WITH {SRC}, {CELL}, {FIELD} SELECT 'Temp_d' AS field, 2 AS \"month\", j, i, round(coalesce(v, 0) + 7, 6) AS value FROM field WHERE j BETWEEN 3 AND 9 AND i < 20")
def src_climate_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-N108, SRC-CLIP: one field of one month, some rows and columns; the source opens one record and reads these only."""
    v = np.nan_to_num(dense(spark, sf_dir))
    path = put(f"{folder(spark, 'blocks')}/n108", b"".join(record(v + k) for k in range(len(BLOCKS))))
    one = rasters.climate_blocks(spark, path, TX, TY, band=100).where("field = 'Temp_d' and month = 2 and j between 3 and 9 and i < 20")
    return one.withColumn("value", r6("value"))


@query(f"WITH {SRC}, {CELL}, {FIELD} SELECT 'vgx_GL' AS field, j, i, round(v, 6) AS value FROM field")
def src_soil_and_vegetation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-SOILVEG, SRC-SOILVEG: one record written and read back, with its sentinel."""
    top = folder(spark, "soilveg")
    put(f"{top}/README", b"")
    written = sinks.write_record(field(spark, sf_dir), f"{top}/vgx_GL", "v").collect()  # one row
    return rasters.soil_and_vegetation(spark, written[0]["path"]).withColumn("value", r6("value"))


@query(f"WITH {SRC}, {CELL}, {FIELD} SELECT round(x, 4) AS lon, round(y, 4) AS lat, round(v, 3) AS a, round(v + 1, 3) AS b, round(v + 2, 3) AS c, CAST(3 + i % 2 AS INTEGER) AS \"month\" FROM field WHERE v IS NOT NULL")
def src_ozone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-OZONE: rows of two months' files."""
    top = folder(spark, "ozone")
    rows = field(spark, sf_dir).where("v is not null").select("i", "x", "y", "v").collect()  # a row for each point of a small grid
    for month in (3, 4):
        put(f"{top}/abc_coef.m{month:02d}", "".join(f" {r['x']!r} {r['y']!r} {r['v']!r} {r['v'] + 1!r} {r['v'] + 2!r}\n" for r in rows if 3 + r["i"] % 2 == month).encode())
    out = rasters.ozone(spark, top)
    return out.select(F.round("lon", 4).alias("lon"), F.round("lat", 4).alias("lat"), *[F.round(c, 3).alias(c) for c in "abc"], "month")


@query(f"WITH {SRC}, {CELL}, {FIELD} SELECT j, i, round(coalesce(v, 0), 3) AS sea, round(coalesce(v, 0) + 1, 3) AS land, round(coalesce(v, 0) + 2, 3) AS soot, round(coalesce(v, 0) + 3, 3) AS desert FROM field")
def src_aerosols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-AERO."""
    v = np.nan_to_num(dense(spark, sf_dir))
    text = "header\n" * 24 + "\n".join(" ".join(f"{x!r}".replace("e", "D") for x in (v + k).tolist()) for k in range(4))
    out = rasters.aerosols(spark, put(f"{folder(spark, 'aerosols')}/aero_GL", text.encode()), TX, TY)
    return out.select("j", "i", *[F.round(c, 3).alias(c) for c in rasters.AEROSOLS])


def _class_file(rows: list[tuple[int, float, float, float, float]]) -> bytes:
    """A class table of layout 1 with types 1, 2, 4, 8 and 10 by turns."""

    def rec(*values: float) -> bytes:
        return np.array(values, ">f8").tobytes().ljust(classes.RECORD, b"\0")

    out = []
    for cover, town, nature, water, sea in rows:
        out += [cover.to_bytes(4, "big").ljust(classes.RECORD, b"\0"), rec(town, nature, water, sea)]
        kinds = {1: 0.25, (2, 4, 8, 10)[cover % 4]: 0.75}
        if nature:
            out.append(rec(*[kinds.get(k, 0.0) for k in range(1, classes.TYPES + 1)]))
            out += [rec(*[0.1 + spell / 100 for spell in range(12 * k, 12 * k + 12)]) for k in (0, 1, 2)] * 2
            for kind in sorted(kinds):
                out.append(rec(kind / 10, kind / 5, kind / 2))
                if kind > 3:
                    out += [rec(*[cover + kind + spell for spell in range(12 * k, 12 * k + 12)]) for k in (0, 1, 2)]
                    out += [rec(kind * 2.0)] if classes.has_trees(kind) else []
                    out += [rec(*[0.2] * 12)] * 6
                if kind == 8:
                    out.append(np.array([5, 1, 9, 30], ">i4").tobytes() + np.array([1.5, 2.5], ">f8").tobytes() + bytes(128))
        if town:
            out += [rec(1.0, 20.0, 0.5, 0.6, 0.25), rec(0.1, 0.2, 0.3), rec(0.9, 0.91, 0.92), *[rec(k, k + 1, k + 2) for k in range(9)], rec(10, 20, 30, 40)]
    return b"".join(out)


@query(f"""WITH {SRC}, {MEASURED}, c AS (SELECT cover, town, nature, water, sea, CASE WHEN nature <> 0 THEN (ARRAY[2, 4, 8, 10])[cover % 4 + 1] END AS kind FROM measured),
  l AS (SELECT *, CASE WHEN kind > 3 THEN cover + kind + 17.5 WHEN kind IS NOT NULL THEN 0.0 END AS lai FROM c)
  SELECT cover, round(town * 0.75, 6) AS town, round(nature + 0.25 * town, 6) AS nature, round(water, 6) AS water, round(sea, 6) AS sea, CASE WHEN town <> 0 THEN 20.0 END AS bld_height, CASE WHEN town <> 0 THEN 15.0 END AS heat, CASE WHEN town <> 0 THEN 30.0 END AS h_industry, CASE WHEN kind IS NOT NULL THEN 0.45 END AS soil_nir,
  kind AS main_type, CASE WHEN kind IS NOT NULL THEN 0.75 END AS main_share, round(lai, 6) AS mean_lai, round(kind / 10.0, 6) AS root_depth, CASE WHEN kind = 4 THEN 8.0 END AS h_tree, CASE WHEN kind = 8 THEN 9 END AS reap_month, CASE WHEN kind = 8 THEN 2.5 END AS irrig FROM l""")
def src_covers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-COVERS, PRJ-RESOL: the class table read record by record, gardens moved to nature."""
    rows = [tuple(r) for r in measured_classes(spark, sf_dir).select("cover", "town", "nature", "water", "sea").orderBy("cover").collect()]  # 256 classes
    table = covers.resolved(classes.class_parameters(spark, _class_file(rows), len(rows)))
    main = F.element_at("types", -1)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return table.select("cover", *[r6(c).alias(c) for c in ("town", "nature", "water", "sea")], "bld_height", total("tc_road").alias("heat"), "h_industry", F.round(F.element_at("alb_soil_nir", 36), 9).alias("soil_nir"), main["type"].alias("main_type"), main["share"].alias("main_share"), r6(total(main["lai"]) / 36).alias("mean_lai"), r6(main["root_depth"]).alias("root_depth"), main["h_tree"].alias("h_tree"), main["reap_month"].alias("reap_month"), main["irrig"].alias("irrig"))


NAMELIST = "&NAMGRID LATLON=.TRUE., NDLON=21, NDGLG=11, ZLONW=10., ZLONE=50., ZLATS=40., ZLATN=60. /"


@query(f"""WITH {SRC}, t AS (SELECT zs, floor((lat - 60.0) / -2.0 + 0.5) AS j, floor((lon - 10.0) / 2.0 + 0.5) AS i FROM src WHERE lon > 9.0 AND lon < 51.0)
  SELECT CAST(j * 21 + i AS BIGINT) AS iglo, round(10.0 + 2.0 * i, 6) AS lon, round(60.0 - 2.0 * j, 6) AS lat, count(*) AS n, round(avg(zs), 6) AS zs FROM t WHERE j BETWEEN 0 AND 10 GROUP BY i, j""")
def src_namelist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-NML, PRED-GEOM: source points in the cells of a namelist's grid, which has the geometry of the region used elsewhere."""
    grid = pipelines.same_geometry({"namelist": grids.from_namelist(NAMELIST), "region": REGION})
    cells = mapping.in_domain(mapping.cell_of(source_points(spark, sf_dir).drop("i", "j"), grid))
    means = cells.groupBy(F.col("iglo2").alias("iglo")).agg(F.count("*").alias("n"), F.avg("zs").alias("zs"))
    return grid.points(spark).join(means, "iglo").select("iglo", r6("lon").alias("lon"), r6("lat").alias("lat"), "n", r6("zs").alias("zs"))


@query(f"""WITH {SRC}, u AS (SELECT *, acos(greatest(-1.0, least(1.0, sin(radians(lat)) * sin(radians(45.0)) + cos(radians(lat)) * cos(radians(45.0)) * cos(radians(lon - 10.0))))) * 6371.229 AS d, atan2(cos(radians(lat)) * sin(radians(lon - 10.0)), cos(radians(45.0)) * sin(radians(lat)) - sin(radians(45.0)) * cos(radians(lat)) * cos(radians(lon - 10.0))) AS b FROM src)
  SELECT iglo1, round(3000.0 / sqrt(1 + pow(d * sin(b) / 2000.0, 2) + pow(d * cos(b) / 1000.0, 2)), 4) AS zs FROM u""")
def src_mountain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-SYN-ELL: the source points' heights replaced by an idealised mountain."""
    from ..functions.geometry import elliptical_mountain

    p = source_points(spark, sf_dir)
    return p.select("iglo1", F.round(elliptical_mountain(F.col("lon"), F.col("lat"), 10.0, 45.0, 2000.0, 1000.0, 3000.0), 4).alias("zs"))


@query(f"WITH {SRC}, {CELL}, {FIELD} SELECT iglo, CAST({TY - 1} - j AS INTEGER) AS j, round(coalesce(v, 1e9), 6) AS v, round(coalesce(2 * v, 1e9), 6) AS w, CASE WHEN iglo = 7 THEN 'moved' END AS point FROM field")
def snk_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-GS, SNK-FA, SNK-POINT, SNK-NULL: batches of fields with rows turned and a sentinel, written and read back; one point kept under its key."""
    f = field(spark, sf_dir).withColumn("w", 2 * F.col("v"))
    sinks.discard(f)
    turned = sinks.with_sentinel(sinks.flipped(f, TY), ["v", "w"], 1e9)
    places = sinks.write_batches(turned.select("iglo", "j", "v", "w"), folder(spark, "batches"), ["j", "v", "w"], each=2, writers=2)
    out = None
    for place in places:
        part = spark.read.parquet(place)
        out = part if out is None else out.join(part, "iglo")
    kept = sinks.keep_point(sinks.keep_point(None, f.select("iglo"), 3, 5), f.select("iglo"), 4, 7)
    point = kept.where("iglo = 7").select("iglo", F.lit("moved").alias("point"))
    return out.join(point, "iglo", "left").select("iglo", "j", r6("v").alias("v"), r6("w").alias("w"), "point")


@query("WITH m AS (SELECT user_id % 36 AS iglo, CAST(month(ts) AS INTEGER) AS \"month\", avg(value) AS v FROM events GROUP BY 1, 2) SELECT \"month\", iglo, 'v' AS field, round(v, 6) AS value FROM m UNION ALL SELECT \"month\", iglo, 'odd', round(v, 6) FROM m WHERE \"month\" % 2 = 1")
def snk_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-MONTH: a folder for each month and field, none for what a month has no value of."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    m = e.groupBy((F.col("user_id") % 36).alias("iglo"), F.month("ts").alias("month")).agg(F.avg("value").alias("v"))
    m = m.withColumns({"odd": F.when(F.col("month") % 2 == 1, F.col("v")), "none": F.lit(None).cast("double")})
    path = folder(spark, "months")
    sinks.write_month_fields(m, path, ["v", "odd", "none"])
    return spark.read.parquet(path).select("month", "iglo", "field", r6("value").alias("value"))


@query(r"""WITH n AS (SELECT DISTINCT 'S' || lpad(CAST(p_size AS VARCHAR), 3, '0') || p_type AS name FROM part UNION SELECT DISTINCT p_type || 'HEIGHT' FROM part), p AS (SELECT name, regexp_extract(name, '^([SHP])([0-9]{3,5})(.+)$', 1) AS kind, regexp_extract(name, '^([SHP])([0-9]{3,5})(.+)$', 2) AS level, regexp_extract(name, '^([SHP])([0-9]{3,5})(.+)$', 3) AS rest FROM n),
  k AS (SELECT name, CASE WHEN kind = '' THEN name[1:4] ELSE kind END AS prefix, CASE WHEN kind = '' THEN name[5:] ELSE rest END AS suffix, coalesce(try_cast(level AS INTEGER), 0) AS lv FROM p) SELECT row_number() OVER (ORDER BY prefix, suffix, lv) AS place, 'SFX.' || name AS name FROM k WHERE name <> 'PROMOHEIGHT'""")
def tl_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SO-FLD, FLT-NAME, PRJ-RENAME, TL-CONV: a field for each size and kind of part, chosen, sorted by prefix, suffix and level, and renamed."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    level = F.concat(F.lit("S"), F.lpad(F.col("p_size").cast("string"), 3, "0"), F.col("p_type"))
    found = part.select(F.explode(F.array(level, F.concat("p_type", F.lit("HEIGHT")))).alias("name")).distinct().collect()  # names of columns
    df = spark.range(1).select(F.col("id").alias("iglo"), *[F.lit(1.0).alias(r["name"]) for r in found])
    names = pipelines.recoded(df, skip=["PROMOHEIGHT"], prefix="SFX.").columns[1:]
    return spark.createDataFrame([(k, n) for k, n in enumerate(names, 1)], "place long, name string")


@query(f"WITH {SRC} SELECT iglo1, round(zs / 7, 3) AS zs, round(clay, 3) AS clay FROM src WHERE cover % 2 = 1")
def tl_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TL-CONV: fields masked, rounded and written anew."""
    p = source_points(spark, sf_dir).where("cover % 2 = 1").select(F.col("iglo1").alias("iglo"), (F.col("zs") / 7).alias("zs"), "clay")
    return pipelines.recoded(p, digits=3).withColumnRenamed("iglo", "iglo1")


_STEP = "pow(2.0, ceil(log2((max(v * m) OVER (PARTITION BY f) - min(v * m) OVER (PARTITION BY f)) / (pow(2, bits) - 1)) - 1e-12))"


@query(f"""WITH {SRC}, {CELL}, {FIELD}, l AS (SELECT iglo, 'v' AS f, v, 12 AS bits, 1.0 AS m FROM field UNION ALL SELECT iglo, 'w', v / 3, 8, 100.0 FROM field UNION ALL SELECT iglo, 'x', v / 7, 64, 1.0 FROM field),
  p AS (SELECT iglo, f, v, m, bits, min(v * m) OVER (PARTITION BY f) AS lo, {_STEP} AS step FROM l), c AS (SELECT *, round((v * m - lo) / step) AS code FROM p)
  SELECT iglo, f AS field, CASE WHEN bits = 64 THEN 0 ELSE CAST(log2(step) AS INTEGER) END AS exponent, CASE WHEN bits = 64 THEN round(v, 6) ELSE code END AS code, round(CASE WHEN bits = 64 THEN v ELSE (lo + code * step) / m END, 6) AS value FROM c WHERE v IS NOT NULL""")
def snk_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-FA-ENC, SNK-FA-DEC: fields packed into streams of 12 and 8 bits a value and of IEEE numbers, written, read back and decoded."""
    f = field(spark, sf_dir).select("iglo", "v", (F.col("v") / 3).alias("w"), (F.col("v") / 7).alias("x"))
    top = folder(spark, "packed")
    packing.header(f, {"v": 12, "w": 8, "x": 64}, {"w": 100.0}).write.parquet(f"{top}/headers")
    headers = spark.read.parquet(f"{top}/headers")
    packing.blocks(packing.packed(f, headers), headers, block=100).write.parquet(f"{top}/blocks")
    codes = packing.codes(spark.read.parquet(f"{top}/blocks"))
    out = packing.unpacked(codes, headers).join(codes, ["iglo", "field"]).join(F.broadcast(headers.select("field", "exponent", "packing")), "field")
    return out.select("iglo", "field", "exponent", F.when(F.col("packing") == "ieee", r6("code")).otherwise(F.col("code")).alias("code"), r6("value").alias("value"))


@query(f"""WITH {SRC}, {CELLS}, l AS (SELECT r.j * {NX} + r.i AS iglo, n.n * 0.25 + sin(radians(r.i)) * 500 AS v FROM r LEFT JOIN n USING (j, i)), p AS (SELECT iglo, v, min(v) OVER () AS lo, pow(2.0, ceil(log2((max(v) OVER () - min(v) OVER ()) / 65535) - 1e-12)) AS step FROM l)
  SELECT iglo, CAST(round((v - lo) / step) AS BIGINT) AS code, round(lo + round((v - lo) / step) * step, 6) AS v FROM p WHERE v IS NOT NULL""")
def snk_second_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-FA-ENC, SNK-FA-DEC by second-order packing: 16 bits a value, stored as differences in groups, with a bitmap for the gaps."""
    n = source_points(spark, sf_dir).groupBy("j", "i").agg(F.count("*").alias("n"))
    f = SOURCE.points(spark).join(n, ["j", "i"], "left").select("iglo", (F.col("n") * 0.25 + F.sin(F.radians("i")) * 500).alias("v"))
    top = folder(spark, "second")
    packing.header(f, {"v": 16}).write.parquet(f"{top}/headers")
    headers = spark.read.parquet(f"{top}/headers")
    packing.blocks(packing.packed(f, headers), headers, second=True, block=4096).write.parquet(f"{top}/blocks")
    codes = packing.codes(spark.read.parquet(f"{top}/blocks"))
    out = packing.unpacked(codes, headers).join(codes, ["iglo", "field"])
    return out.select("iglo", F.col("code").cast("long").alias("code"), r6("value").alias("v"))


FRAME = {"kind": "gaussian", "ny": 8, "nloen": [12, 20, 24, 28], "stretch": 1.0, "sin_lat": 1.0, "sin_lon": 0.0, "cos_lon": 1.0}


@query(f"WITH {SRC}, p AS ({gauss_points()}), gr(j, y, lo, hi, nx, dx, off) AS (VALUES {gauss_rows()}), c AS (SELECT CAST(off + CAST(floor(lon / dx + 0.5) AS BIGINT) % nx AS BIGINT) AS iglo, count(*) AS n FROM src JOIN gr ON lat > lo AND lat <= hi GROUP BY 1) SELECT c.iglo, round(plon, 6) AS lon, round(plat, 6) AS lat, n FROM c JOIN p ON p.iglo = c.iglo")
def src_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-FA-GRID: source points in the cells of a frame's Gaussian grid."""
    grid = grids.from_frame(FRAME)
    counts = mapping.in_domain(mapping.cell_of(source_points(spark, sf_dir), grid)).groupBy(F.col("iglo2").alias("iglo")).agg(F.count("*").alias("n"))
    return grid.points(spark).join(counts, "iglo").select("iglo", r6("lon").alias("lon"), r6("lat").alias("lat"), "n")


@query(f"WITH {SRC}, {CELL}, {FIELD} SELECT iglo, round(coalesce(CASE WHEN iglo % 5 <> 0 THEN 2 * v END, v), 6) AS SST, CASE WHEN v IS NOT NULL THEN round(ln(greatest(0.001, least(1.0, v / 1e5 + v / 2e5)) / 0.001) / {float(np.log(1.0 / 0.001))!r}, 9) END AS water, (SELECT count_if(iglo % 5 = 0 AND v IS NOT NULL) FROM field) AS only_b FROM field")
def tl_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TL-MIX, TL-WC, TL-YYY, TL-LFI: one file's field updated from another, water content and mask differences, by the command line's tools."""
    f = field(spark, sf_dir).select("iglo", F.col("v").alias("SST"), (F.col("v") / 1e5).alias("LIQUID"), (F.col("v") / 2e5).alias("ICE"))
    top = folder(spark, "tools")
    f.select("iglo", F.when(F.col("iglo") % 5 != 0, 2 * F.col("SST")).alias("SST")).write.parquet(f"{top}/a")
    f.write.parquet(f"{top}/b")
    tools.run(spark, ["mix", "--file-1", f"{top}/a", "--file-2", f"{top}/b", "--out", f"{top}/c", "--field", "SST"])
    tools.run(spark, ["water-content", "--file", f"{top}/c", "--out", f"{top}/d", "--parts", "LIQUID", "ICE"])
    gaps = tools.run(spark, ["mask-diff", "--file-1", f"{top}/a", "--file-2", f"{top}/b", "--field", "SST"])
    return spark.read.parquet(f"{top}/d").crossJoin(F.broadcast(gaps.select("only_b"))).select("iglo", r6("SST").alias("SST"), F.round("`SURFTOT.WATER`", 9).alias("water"), "only_b")  # one row


@query(f"WITH {SRC} SELECT iglo1, round(zs / 3, 7) AS v FROM src")
def fn_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN round 1e-7."""
    return source_points(spark, sf_dir).select("iglo1", fx.rounded(F.col("zs") / 3).alias("v"))


POINTS = "pts AS (SELECT k AS point, 7.3 + 23.7 * k - CASE WHEN 7.3 + 23.7 * k >= 360 THEN 360 ELSE 0 END AS plon, -70.2 + 8.9 * k AS plat FROM (SELECT unnest(range(0, 16)) AS k))"


@query(f"""WITH {SRC}, {POINTS}, m AS (SELECT point, zs, clay, sand, ((lon - plon + 2.5) % 360 + 360) % 360 AS away, lat - plat AS up FROM src, pts)
  SELECT point, round(avg(zs), 6) AS zs, max(clay) AS clay, min(sand) AS sand, count(*) AS n FROM m WHERE away < 5.0 AND up > -2.0 AND up <= 2.0 GROUP BY point""")
def pg_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PG-PTS: box aggregates around single points, in one plan."""
    k = F.col("id")
    lon = 7.3 + 23.7 * k
    points = spark.range(16).select(k.alias("point"), F.when(lon >= 360, lon - 360).otherwise(lon).alias("lon"), (-70.2 + 8.9 * k).alias("lat"))
    out = pipelines.point_cells(source_points(spark, sf_dir), points, 5.0, 4.0, {"zs": "avg", "clay": "max", "sand": "min"})
    return out.withColumn("zs", r6("zs"))


def _gauss_rows() -> str:
    y, off, rows = GAUSS.y, 0, []
    mids = [(a + b) / 2 for a, b in zip(y, y[1:])]
    for j, n in enumerate(GAUSS.nx):
        rows.append(f"({'-1e9' if j == len(y) - 1 else repr(mids[j])}::DOUBLE, {'1e9' if j == 0 else repr(mids[j - 1])}::DOUBLE, {n}, {360.0 / n!r}::DOUBLE, {off})")
        off += n
    return f"gr(lo, hi, nx, dx, off) AS (VALUES {', '.join(rows)})"


@query(f"""WITH {SRC}, {CELL}, {FIELD}, {mapping_sql(gauss_points())}, {_gauss_rows()}, st AS (SELECT *, CASE WHEN i < 20 THEN 1.0 ELSE 0.0 END AS sea, CASE WHEN i < 20 THEN 0.0 ELSE 1.0 END AS nature, CASE WHEN i < 20 THEN 290.0 + y END AS sst, CASE WHEN i >= 20 THEN 280.0 + x END AS tg FROM field),
  box AS (SELECT CAST(off + CAST(floor(x / dx + 0.5) AS BIGINT) % nx AS BIGINT) AS iglo, {', '.join(f'avg({f}) AS {f}' for f in ('sst', 'tg', 'v'))} FROM st JOIN gr ON y > lo AND y <= hi GROUP BY 1),
  four AS (SELECT iglo2 AS iglo, {', '.join(f'{mean4_sql(f)} AS {f}' for f in ('sst', 'tg', 'v'))} FROM w4 JOIN st ON st.iglo = w4.iglo1 GROUP BY iglo2),
  t AS (SELECT p4.iglo, CASE WHEN plon < 200 THEN 1.0 ELSE 0.0 END AS sea, CASE WHEN plon < 200 THEN 0.0 ELSE 1.0 END AS nature, {', '.join(f'coalesce(box.{f}, four.{f}) AS {f}' for f in ('sst', 'tg', 'v'))} FROM p4 LEFT JOIN box USING (iglo) LEFT JOIN four USING (iglo)),
  m AS (SELECT iglo, sea, nature, CASE WHEN sea > 0 THEN sst END AS sst, CASE WHEN nature > 0 THEN tg END AS tg, v FROM t)
  SELECT iglo, round(CASE WHEN sea > 0 THEN coalesce(sst, (SELECT avg(sst) FROM m WHERE sea > 0)) ELSE sst END, 6) AS sst, round(CASE WHEN nature > 0 THEN coalesce(tg, (SELECT avg(tg) FROM m WHERE nature > 0)) ELSE tg END, 6) AS tg, round(coalesce(v, (SELECT avg(v) FROM m)), 4) AS v FROM m""")
def pg_prep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PG-PREP onto a reduced Gaussian grid: cell means, 4-point values, means over the field's mask."""
    west = F.col("i") < 20
    state = field(spark, sf_dir).withColumns({"sea": F.when(west, 1.0).otherwise(0.0), "nature": F.when(west, 0.0).otherwise(1.0), "sst": F.when(west, 290.0 + F.col("y")), "tg": F.when(~west, 280.0 + F.col("x"))})
    there = GAUSS.points(spark).select("iglo", F.when(F.col("lon") < 200, 1.0).otherwise(0.0).alias("sea"), F.when(F.col("lon") < 200, 0.0).otherwise(1.0).alias("nature"))
    out = pipelines.initial_state(state, {"state": TARGET, "fractions": TARGET}, GAUSS, ["sst", "tg", "v"], ["sea", "nature"], there)
    return out.select("iglo", r6("sst").alias("sst"), r6("tg").alias("tg"), F.round("v", 4).alias("v"))


def whole_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = source_points(spark, sf_dir).groupBy("j", "i").agg(F.avg("zs").alias("zs"), F.avg("clay").alias("clay"), F.avg("sand").alias("sand"), F.min("cover").alias("cover"))
    return SOURCE.points(spark).join(p, ["j", "i"], "left")


ALL_POINTS = f"SELECT iglo, 0.5 + iglo % {NX} AS plon, 89.5 - iglo // {NX} AS plat, CASE WHEN iglo % {NX} > 0 THEN iglo % {NX} - 0.5 ELSE 1.5 END AS qlon FROM (SELECT unnest(range(0, {NX * NY})) AS iglo)"


def _slope(a: str, b: str, pa: str, pb: str, origin: str, scale: str) -> str:
    core = f"(coalesce({a}, v) - coalesce({b}, v)) / nullif({scale} * ((CASE WHEN {a} IS NULL THEN {origin} ELSE {pa} END) - (CASE WHEN {b} IS NULL THEN {origin} ELSE {pb} END)), 0) / 6371229.0"
    return f"CASE WHEN v IS NOT NULL THEN coalesce({core}, 0.0) ELSE {core} END"


def relief_sql(factor: float, envelope: bool, gauss: bool = False) -> str:
    """CTE out2: iglo and all of a target cell that surface descriptions use; heights times the factor, obstacles seen from the mean or the envelope; cells of the target grid or of GAUSS."""
    arms = lambda f: f"""SELECT s.*, e.{f} AS ve, w.{f} AS vw, CASE WHEN s.j = 0 THEN s.{f} ELSE n.{f} END AS vn, CASE WHEN s.j = {NY - 1} THEN s.{f} ELSE o.{f} END AS vs, CASE WHEN s.j = 0 THEN 180.0 - s.y ELSE n.y END AS yn, CASE WHEN s.j = {NY - 1} THEN -180.0 - s.y ELSE o.y END AS ys,
    cos(radians(s.y)) * radians(1.0) AS bx, radians(1.0) AS b_y FROM {{0}} s JOIN {{0}} e ON e.j = s.j AND e.i = (s.i + 1) % {NX} JOIN {{0}} w ON w.j = s.j AND w.i = (s.i + {NX - 1}) % {NX} LEFT JOIN {{0}} n ON n.j = s.j - 1 AND n.i = s.i LEFT JOIN {{0}} o ON o.j = s.j + 1 AND o.i = s.i"""  # noqa: E731
    seen = "zs_avg + stdev" if envelope else "zs_avg"
    cells = f"s2 AS (SELECT *, CAST(greatest(0, least({TY - 1}, floor((y - 85.0) / -10.0 + 0.5))) AS BIGINT) * {TX} + CAST(CASE WHEN x >= 5.0 THEN floor((x - 5.0) / 10.0 + 0.5) ELSE ceil((x - 5.0) / 10.0 - 0.5) END AS BIGINT) % {TX} AS cell2 FROM s1)"
    if gauss:
        cells = f"gr(j, y, lo, hi, nx, dx, off) AS (VALUES {gauss_rows()}), s2 AS (SELECT s1.*, CAST(off + CAST(floor(x / dx + 0.5) AS BIGINT) % nx AS BIGINT) AS cell2 FROM s1 JOIN gr ON s1.y > lo AND s1.y <= hi)"
    size = GAUSS.size if gauss else TX * TY
    # Turned vectors have both components or none.
    gone = lambda a, b: f"CASE WHEN {b} IS NOT NULL THEN {a} END" if envelope else a
    sides = (("ip", "ve", "bx * 1.0"), ("im", "vw", "bx * 1.0"), ("jp", "vn", "b_y * abs(yn - y)"), ("jm", "vs", "b_y * abs(ys - y)"))
    rise = lambda v: f"coalesce({v} - d, 0.0)"
    obstacles = ", ".join(f"avg(CASE WHEN d IS NOT NULL THEN greatest(0.0, {rise(v)} / ({away} * 6371229.0)) END) AS aos_{n}, avg(CASE WHEN d IS NOT NULL AND {rise(v)} {'<' if n in ('im', 'jm') else '>'} 0 THEN {'-' if n in ('im', 'jm') else ''}({rise(v)}) * 0.5 END) AS ho2_{n}" for n, v, away in sides)
    return f"""{SRC}, {CLASSES}, pt AS (SELECT j, i, avg(zs) AS zs, avg(clay) AS clay, avg(sand) AS sand, min(cover) AS cover FROM src GROUP BY j, i),
  s1 AS (SELECT r.iglo, CAST(r.iglo // {NX} AS BIGINT) AS j, r.iglo % {NX} AS i, 0.5 + r.iglo % {NX} AS x, 89.5 - r.iglo // {NX} AS y, CASE WHEN cover = 1 THEN NULL ELSE zs * {factor!r} END AS v, clay, sand, cover FROM (SELECT unnest(range(0, {NX * NY})) AS iglo) r LEFT JOIN pt ON pt.j = r.iglo // {NX} AND pt.i = r.iglo % {NX}),
  {cells},
  sa AS ({arms('v').format('s2')}), sg AS (SELECT *, {_slope('ve', 'vw', 'x + 1.0', 'x - 1.0', 'x', 'bx')} AS gx, {_slope('vn', 'vs', 'yn', 'ys', 'y', 'b_y')} AS gy FROM sa),
  m2 AS (SELECT cell2, avg(v) AS zs_avg, min(v) AS zs_min, max(v) AS zs_max, avg(clay) AS clay, avg(sand) AS sand FROM s2 GROUP BY cell2),
  t2 AS (SELECT cell2, avg({gone('gx * gx', 'gy')}) AS xx, avg({gone('gy * gy', 'gx')}) AS yy, avg(gx * gy) AS xy, avg(v * v) AS sq, avg(v) AS av FROM sg GROUP BY cell2),
  k2 AS (SELECT cell2, xy, sq, av, 0.5 * (xx + yy) AS k, 0.5 * (xx - yy) AS l, sqrt(0.25 * (xx - yy) * (xx - yy) + xy * xy) AS r FROM t2),
  f2 AS (SELECT cell2, CASE WHEN av IS NOT NULL THEN atan2(xy, l) * 90 / pi() END AS dir, CASE WHEN av IS NOT NULL THEN sqrt(k + r) END AS slope, CASE WHEN av IS NOT NULL THEN CASE WHEN k + r > 0 THEN sqrt(greatest(k - r, 0.0) / (k + r)) ELSE 1.0 END END AS anis, CASE WHEN av IS NOT NULL THEN sqrt(greatest(sq - av * av, 0.0)) END AS stdev FROM k2),
  c2 AS (SELECT cell2, cover, count(*) / CAST(sum(count(*)) OVER (PARTITION BY cell2) AS DOUBLE) AS frac FROM s2 WHERE cover IS NOT NULL GROUP BY cell2, cover),
  h2 AS (SELECT cell2, max(CASE WHEN cover = 1 THEN frac END) AS first, {', '.join(f'sum(frac * {p}) / nullif(sum(frac), 0) AS {p}' for p in ('sea', 'nature', 'water', 'town'))} FROM c2 JOIN classes USING (cover) GROUP BY cell2),
  field AS (SELECT cell2 AS iglo, {seen} AS v FROM m2 JOIN f2 USING (cell2)), {mapping_sql(ALL_POINTS, gauss)}, sm AS (SELECT iglo2 AS iglo, {mean4_sql('v')} AS smooth FROM w4 JOIN field ON field.iglo = w4.iglo1 GROUP BY iglo2),
  sd AS (SELECT s2.iglo, j, i, x, y, cell2, v - smooth AS d FROM s2 LEFT JOIN sm USING (iglo)), sh AS ({arms('d').format('sd')}), o2 AS (SELECT cell2, {obstacles} FROM sh GROUP BY cell2),
  out2 AS (SELECT r.iglo, m2.* EXCLUDE (cell2), f2.* EXCLUDE (cell2), h2.* EXCLUDE (cell2), o2.* EXCLUDE (cell2) FROM (SELECT unnest(range(0, {size})) AS iglo) r LEFT JOIN m2 ON m2.cell2 = r.iglo LEFT JOIN f2 ON f2.cell2 = r.iglo LEFT JOIN h2 ON h2.cell2 = r.iglo LEFT JOIN o2 ON o2.cell2 = r.iglo)"""


SIDES = [f"{k}_{n}" for k in ("aos", "ho2") for n in ("ip", "im", "jp", "jm")]


@query(f"""WITH {relief_sql(1.0, False)} SELECT iglo, 5.0 + 10.0 * (iglo % {TX}) AS lon, 85.0 - 10.0 * (iglo // {TX}) AS lat, round(coalesce(zs_avg + stdev, 0.0), 6) AS zs, {', '.join(f'round(coalesce({c}, 0.0), 6) AS {c}' for c in ('zs_avg', 'zs_min', 'zs_max', 'clay', 'sand', 'dir', 'anis', 'stdev'))}, round(coalesce(zs_avg, 0.0), 6) AS sil, round(coalesce(slope, 0.0), 6) AS slope,
  {', '.join(f'round({c}, 6) AS {c}' for c in ('sea', 'nature', 'water', 'town'))}, {', '.join(f'round(coalesce({c}, 0.0), 6) AS {c}' for c in SIDES)}, CASE WHEN sea > 0 THEN -300.0 END AS bathy, CASE WHEN nature > 0 THEN 0.5 END AS runoff, CASE WHEN nature > 0 THEN 0.0 END AS wdrain FROM out2""")
def pg_pgd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PG-PGD over the whole chain."""
    out = pipelines.surface(whole_source(spark, sf_dir), {n: SOURCE for n in ("cover", "zs", "clay", "sand")}, TARGET, class_shares(spark))
    return out.select("iglo", *[r6(c).alias(c) for c in out.columns if c not in ("iglo", "j", "i", "x", "y")])


_A = "(coalesce(aos_ip, 0.0) + coalesce(aos_im, 0.0) + coalesce(aos_jp, 0.0) + coalesce(aos_jm, 0.0)) * 0.25 * 0.8 / (2 * 0.4 * 0.4)"
_Z0 = f"CASE WHEN zs_avg IS NULL THEN 0.0 WHEN {_A} > 0 THEN greatest(0.25 * (coalesce(ho2_ip, 0.0) + coalesce(ho2_im, 0.0) + coalesce(ho2_jp, 0.0) + coalesce(ho2_jm, 0.0)) * exp(-sqrt(1.0 / nullif({_A}, 0))), 1e-10) ELSE 0.0 END"


def clim_relief_sql(gauss: bool, digits: int) -> str:
    round_ = lambda c, n=digits: f"round({c}, {n})"
    whole = ", ".join(f"{round_(c, min(n, digits))} AS {name}" for name, c, n in (("geo", "coalesce(zs_avg + stdev, 0.0)", 4), ("sand", "coalesce(sand, 0.0)", 6), ("clay", "coalesce(clay, 0.0)", 6), ("dir", "coalesce(radians(dir), 0.0)", 6), ("anis", "coalesce(anis * anis, 0.0)", 6), ("stdev", "coalesce(stdev, 0.0)", 4), ("z0_relief", _Z0, 4), ("z0", _Z0, 4)))
    return f"""WITH {relief_sql(fx.GRAVITY, True, gauss)} SELECT iglo, {whole}, CASE WHEN coalesce(first > 0.5, false) OR coalesce(water > 0.5, false) THEN 0.0 ELSE 1.0 END AS lsm, {round_('town')} AS urban, {round_('1 - (sea + water)')} AS land FROM out2"""


@query(clim_relief_sql(False, 6))
def pg_clim_relief(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PG-CLIM, part 1: relief in geopotential, roughness from obstacles above the envelope, shares and land-sea mask."""
    out = climatology.relief(whole_source(spark, sf_dir), SOURCE, TARGET, class_shares(spark))
    return out.select("iglo", *[F.col(c) if c == "lsm" else (F.round(c, 4) if c in ("geo", "stdev", "z0_relief", "z0") else r6(c)).alias(c) for c in out.columns if c != "iglo"])


@query(clim_relief_sql(True, 4))
def pg_clim_relief_gaussian(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PG-CLIM, part 1, onto a reduced Gaussian grid."""
    out = climatology.relief(whole_source(spark, sf_dir), SOURCE, GAUSS, class_shares(spark))
    return out.select("iglo", *[F.round(c, 4).alias(c) for c in out.columns if c != "iglo"])


G = f"g AS (SELECT iglo, v, 1 + (iglo // 3) % 5 AS itp, 0.1 + (iglo % 9) / 10.0 AS alb, 0.88 + (iglo % 7) / 50.0 AS emi, v / 8000 AS dps, (iglo % 11) / 10.0 AS vgx, v / 9000 AS dpr, 0.001 * (iglo % 13) AS z0v, (iglo % 8) / 10.0 AS alv, 1.0 + iglo % 40 AS rsm, (iglo % 5) / 4.0 AS lfrac, iglo * 10.0 AS orog, (iglo % 3) / 4.0 AS ifrac FROM field)"
BASE = "base0 AS (SELECT iglo, CASE WHEN iglo % 3 = 0 THEN 0.0 ELSE 1.0 END AS lsm, 0.2 + (iglo % 7) / 10.0 AS land, 10.0 + iglo % 60 AS clay, 5.0 + iglo % 90 AS sand, (iglo % 5) / 10.0 AS urban, iglo * 5.0 AS geo, 0.05 + (iglo % 4) / 10.0 AS z0 FROM p4)"
MONTHLY = 'mo AS (SELECT iglo, m AS "month", 268.0 + alb * 20 + m AS tg, 262.0 + emi * 10 + m AS td, 266.0 + m AS ts, (iglo % 6) / 5.0 * m / 12 AS veg, CASE WHEN iglo % 4 <> 0 THEN 0.5 * m END AS lai FROM g, (SELECT unnest(range(1, 13)) AS m))'


def given(spark: SparkSession, sf_dir: str, stored: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame | kept.Kept]:
    """Source fields, their months, the target's fields so far and the mapping, stored as a table or not."""
    k = F.col("iglo")
    g = field(spark, sf_dir).select("iglo", "v", (1 + F.floor(k / 3) % 5).cast("int").alias("itp"), (0.1 + k % 9 / 10.0).alias("alb"), (0.88 + k % 7 / 50.0).alias("emi"), (F.col("v") / 8000).alias("dps"), (k % 11 / 10.0).alias("vgx"), (F.col("v") / 9000).alias("dpr"), (0.001 * (k % 13)).alias("z0v"), (k % 8 / 10.0).alias("alv"), (1.0 + k % 40).alias("rsm"), (k % 5 / 4.0).alias("lfrac"), (k * 10.0).alias("orog"), (k % 3 / 4.0).alias("ifrac"))
    m = F.col("month")
    months = g.crossJoin(F.broadcast(spark.range(1, 13).select(F.col("id").cast("int").alias("month"))))  # twelve rows
    months = months.select("iglo", "month", (268.0 + F.col("alb") * 20 + m).alias("tg"), (262.0 + F.col("emi") * 10 + m).alias("td"), (266.0 + m).alias("ts"), (k % 6 / 5.0 * m / 12).alias("veg"), F.when(k % 4 != 0, 0.5 * m).alias("lai"))
    base = GAUSS.points(spark).select("iglo", F.when(k % 3 == 0, 0.0).otherwise(1.0).alias("lsm"), (0.2 + k % 7 / 10.0).alias("land"), (10.0 + k % 60).alias("clay"), (5.0 + k % 90).alias("sand"), (k % 5 / 10.0).alias("urban"), (k * 5.0).alias("geo"), (0.05 + k % 4 / 10.0).alias("z0"))
    return g, months, base, climatology.to_target(TARGET, GAUSS, spark, f"gridloom_mapping_{uuid.uuid4().hex}" if stored else None)


_FIVE = ", ".join(f"{mean4_sql(f'CASE WHEN itp = {k} THEN 1.0 ELSE 0.0 END')} AS s{k}" for k in range(1, 6))
_S = [f"CASE WHEN s{k} > 0 THEN s{k} ELSE 0 END" for k in range(1, 6)]
SOILS = f"""f4 AS (SELECT iglo2 AS iglo, {_FIVE}, {', '.join(f'{mean4_sql(f)} AS {f}' for f in climatology.SOIL_FIELDS)} FROM w4 JOIN g ON g.iglo = w4.iglo1 GROUP BY iglo2),
  o4 AS (SELECT *, list_sort([{', '.join(f'struct_pack(minus := -({s}), k := {k})' for k, s in enumerate(_S, 1))}]) AS o FROM f4),
  k4 AS (SELECT b.*, o4.alb, o4.emi, o4.dps, o4.vgx, o4.dpr, o[1].k AS fk, CASE WHEN o[2].minus < 0 THEN o[2].k ELSE 0 END AS sk FROM base0 b JOIN o4 USING (iglo)),
  n4 AS (SELECT *, CASE WHEN lsm >= 0.5 THEN CASE WHEN fk IN (1, 5) THEN CASE WHEN sk = 0 THEN 3 ELSE sk END ELSE fk END WHEN fk = 5 THEN 5 ELSE 1 END AS kind, CASE WHEN {_within('vgx', 0.0, 1.0)} < 0.02 THEN 0.0 ELSE {_within('vgx', 0.0, 1.0)} END AS veg FROM k4),
  d4 AS (SELECT *, veg * {_both('dpr', 'dps')} + (1 - veg) * dps AS deep, {_within('clay', 3.0, 58.0)} AS c, {_within('sand', 6.0, 92.0)} AS s, {_within('dps', 0.1, 8.0)} AS most, veg * land AS vmax FROM n4),
  base1 AS (SELECT iglo, lsm, land, geo, z0, kind, veg, {_by_class('0.07', '0.75', _within('alb', 0.05, 0.8))} AS albedo, {_by_class('0.96', '0.98', _within('emi', 0.9, 1.0))} AS emis, {_by_class('8.0', '0.1', 'most')} AS depth_max, {_by_class('3.0', '3.0', 'c / (greatest(100.0, c + s) / 100)')} AS clay,
    {_by_class('6.0', '6.0', 's / (greatest(100.0, c + s) / 100)')} AS sand, {_by_class('0.0', '0.0', 'vmax')} AS veg_max, {_by_class('8.0', '0.1', f"CASE WHEN {_both('most', 'deep')} IS NOT NULL THEN greatest(0.1, {_both('most', 'deep')}) END")} AS depth, {_by_class('0.0', '0.0', _both('1 - vmax', 'urban'))} AS urban FROM d4)"""
_START = f"{SRC}, {CELL}, {FIELD}, {G}, {mapping_sql(gauss_points())}, {BASE}, {SOILS}"
SOIL_OUT = ("veg", "albedo", "emis", "depth_max", "clay", "sand", "veg_max", "depth", "urban")


@query(f"WITH {_START} SELECT iglo, CAST(kind AS INTEGER) AS kind, {', '.join(f'round({c}, 6) AS {c}' for c in SOIL_OUT)} FROM base1")
def pg_clim_soil(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PG-CLIM, part 2: soil and the dominant vegetation."""
    g, _, base, m = given(spark, sf_dir)
    return climatology.soil(base, g, m).select("iglo", F.col("kind").cast("int").alias("kind"), *[r6(c).alias(c) for c in SOIL_OUT])


_ES = _pressure_sql
TEMPS = f"""s4 AS (SELECT iglo2 AS iglo, {mean4_sql('lfrac')} AS lfrac, {mean4_sql('ifrac')} AS ifrac FROM w4 JOIN g ON g.iglo = w4.iglo1 GROUP BY iglo2),
  fl AS (SELECT mo.iglo, "month", tg + orog * 6.5e-3 / 9.80665 AS tg, td + orog * 6.5e-3 / 9.80665 AS td, ts FROM mo JOIN g USING (iglo)),
  a4 AS (SELECT iglo2 AS iglo, "month", {', '.join(f'{mean4_sql(f)} AS {f}' for f in ('tg', 'td', 'ts'))} FROM w4 JOIN fl ON fl.iglo = w4.iglo1 GROUP BY iglo2, "month"),
  b4 AS (SELECT a4.iglo, "month", tg - geo * 6.5e-3 / 9.80665 AS tg, td - geo * 6.5e-3 / 9.80665 AS td, ts - geo * 6.5e-3 / 9.80665 AS ts, lfrac, ifrac, base1.* EXCLUDE (iglo) FROM a4 JOIN s4 USING (iglo) JOIN base1 USING (iglo)),
  c4 AS (SELECT *, acos(1 - 2 * greatest(0.0, least(1.0, ({_ES('least(td, tg)')}) / ({_ES('tg')})))) / pi() AS w0, lsm >= 0.5 AS on_land FROM b4),
  e4 AS (SELECT *, CASE WHEN on_land THEN tg ELSE ts END AS t, CASE WHEN on_land THEN w0 ELSE 1.0 END AS wet, greatest(0.0, least(1.0, ifrac / greatest(1e-10, lfrac))) AS ix, greatest(0.0, least(1.0, 0.04 * w0 * (273.16 - tg))) AS iy FROM c4),
  months AS (SELECT iglo, "month", t, wet, on_land, CASE WHEN kind = 2 THEN 10000.0 WHEN on_land THEN least(1000.0, greatest(0.0, 10 * ix / (1.0001 - ix) + 500 * (1 - cos(pi() * iy)))) ELSE 0.0 END AS snow,
    CASE WHEN kind IN (1, 5) THEN CASE WHEN t <= 271.23 THEN 0.65 ELSE 0.07 END ELSE albedo END AS albedo, CASE WHEN kind IN (1, 5) THEN CASE WHEN t <= 271.23 THEN 0.97 ELSE 0.96 END ELSE emis END AS emis, CASE WHEN kind IN (1, 5) THEN 0.001 * 9.80665 ELSE z0 END AS z0 FROM e4),
  year AS (SELECT a.iglo, a."month", sum(b.t * {lag_sql(pipelines.TEMPERATURE_LAG)}) AS t_later, sum(b.wet * {lag_sql(pipelines.MOISTURE_LAG)}) AS wet_later, count(b.t) = 12 AS t_all, count(b.wet) = 12 AS wet_all FROM (SELECT a.iglo, a."month", b.t, b.wet, (a."month" - b."month" + 12) % 12 AS d FROM months a JOIN months b ON a.iglo = b.iglo) b JOIN months a ON a.iglo = b.iglo AND a."month" = b."month" GROUP BY 1, 2),
  lags AS (SELECT a.*, CASE WHEN NOT a.on_land THEN a.t WHEN t_all THEN t_later END AS t_deep, CASE WHEN NOT a.on_land THEN a.wet WHEN wet_all THEN wet_later END AS wet_deep FROM months a JOIN year USING (iglo, "month"))"""


@query(f'WITH {_START}, {MONTHLY}, {TEMPS} SELECT iglo, CAST("month" AS INTEGER) AS "month", {", ".join(f"round({c}, 6) AS {c}" for c in ("t", "t_deep", "albedo", "emis", "z0"))}, round(wet, 5) AS wet, round(wet_deep, 5) AS wet_deep, round(snow, 2) AS snow FROM lags')
def pg_clim_temperatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PG-CLIM, part 3: monthly temperatures, wetness, snow and water surfaces. The lag stands in for a body that is not known."""
    g, months, base, m = given(spark, sf_dir)
    out = climatology.temperatures(climatology.soil(base, g, m), g.select("iglo", "lfrac", "orog", "ifrac"), months.select("iglo", "month", "tg", "td", "ts"), m)
    return out.select("iglo", "month", *[r6(c).alias(c) for c in ("t", "t_deep", "albedo", "emis", "z0")], F.round("wet", 5).alias("wet"), F.round("wet_deep", 5).alias("wet_deep"), F.round("snow", 2).alias("snow"))


PLANTS = f"""pv AS (SELECT mo.iglo, "month", veg, alv, CASE WHEN veg < 0.02 OR z0v < 1e-10 THEN NULL ELSE ln(nullif(z0v, 0)) END AS log_z0, CASE WHEN veg < 0.02 OR lai IS NULL THEN NULL ELSE lai END AS lai, CASE WHEN veg < 0.02 OR lai IS NULL THEN NULL ELSE lai / rsm END AS ratio FROM mo JOIN g USING (iglo)),
  pa AS (SELECT iglo2 AS iglo, "month", {', '.join(f'{mean4_sql(f)} AS {f}' for f in ('veg', 'alv', 'log_z0', 'lai', 'ratio'))} FROM w4 JOIN pv ON pv.iglo = w4.iglo1 GROUP BY iglo2, "month"),
  pb AS (SELECT pa.iglo, pa."month", kind IN (1, 5) AS water, greatest(0.0, least(1.0, pa.veg)) AS vi, kind = 2 OR pa.veg < 0.02 AS bare, alv, log_z0, lai, ratio, y.veg AS yv, land, urban, y.z0 AS yz, y.albedo AS ya, l.z0 AS mz, l.albedo AS ma FROM pa JOIN base1 y USING (iglo) JOIN lags l ON l.iglo = pa.iglo AND l."month" = pa."month"),
  pc AS (SELECT *, CASE WHEN bare THEN 0.0 ELSE least(yv, vi * land) END AS zv, CASE WHEN bare THEN 0.001 ELSE exp(coalesce(log_z0, -100.0)) END AS rough, CASE WHEN bare THEN 0.05 ELSE greatest(0.05, least(0.8, alv)) END AS za, CASE WHEN bare THEN 0.0 ELSE coalesce(lai, 0.0) END AS zl, CASE WHEN bare THEN 5000.0 ELSE greatest(1.0, least(5000.0, coalesce(coalesce(lai, 0.0) / greatest(ratio, 1e-10), 0.0))) END AS zr FROM pb),
  pd AS (SELECT *, 9.80665 * (zv * rough + urban * 2.5 + (1 - urban - zv) * 0.001) AS zz FROM pc)"""


@query(f"""WITH {_START}, {MONTHLY}, {TEMPS}, {PLANTS} SELECT iglo, CAST("month" AS INTEGER) AS "month", round(CASE WHEN water THEN 0.0 ELSE zv END, 6) AS veg, round(CASE WHEN water THEN mz ELSE sqrt(yz * yz + zz * zz) END, 6) AS z0, round(CASE WHEN water THEN ma ELSE greatest(0.05, least(0.8, (1 - zv) * ya + zv * za)) END, 6) AS albedo,
  round(CASE WHEN water THEN 0.0 ELSE zl END, 6) AS lai, round(CASE WHEN water THEN 5000.0 ELSE zr END, 6) AS rsmin, round(CASE WHEN water THEN yz ELSE zz * 0.1 END, 6) AS z0_therm, round(CASE WHEN water THEN 0.0 ELSE zz END, 6) AS z0_veg, round(CASE WHEN water THEN 0.05 ELSE za END, 6) AS albedo_veg FROM pd""")
def pg_clim_vegetation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PG-CLIM, part 4: monthly vegetation."""
    g, months, base, m = given(spark, sf_dir, stored=True)
    year = climatology.soil(base, g, m)
    third = climatology.temperatures(year, g.select("iglo", "lfrac", "orog", "ifrac"), months.select("iglo", "month", "tg", "td", "ts"), m)
    out = climatology.vegetation(year, third, g.select("iglo", "z0v", "alv", "rsm"), months.select("iglo", "month", "veg", "lai"), m)
    return out.select("iglo", "month", *[r6(c).alias(c) for c in out.columns if c not in ("iglo", "month")])


@query(f'WITH {_START}, {MONTHLY} SELECT iglo2 AS iglo, CAST("month" AS INTEGER) AS "month", {", ".join(f"round({mean4_sql(f)}, 6) AS {f}" for f in ("tg", "td", "ts"))} FROM w4 JOIN mo ON mo.iglo = w4.iglo1 GROUP BY iglo2, "month"')
def pg_clim_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PG-CLIM, parts 8 and 9: plain monthly fields."""
    _, months, _, m = given(spark, sf_dir, stored=True)
    return climatology.plain_months(months, m, ["tg", "td", "ts"]).select("iglo", "month", *[r6(c).alias(c) for c in ("tg", "td", "ts")])
