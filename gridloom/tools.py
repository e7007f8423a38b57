"""Command line tools over fields in Parquet: python -m gridloom.tools NAME --option value.

A file of fields has the key iglo and a column for each field. list, size, diff, cat and split look at and rearrange files;
mix, water-content, mask-diff and convert make new ones.
"""

from __future__ import annotations

import argparse
import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import fields as fx
from .operators import regrid
from .plans import pipelines
from .sources import packing


def fields_of(df: DataFrame, key: str = "iglo") -> list[str]:
    return [c for c in df.columns if c != key]


def listed(df: DataFrame) -> DataFrame:
    """place, field, n and n_missing, in the order of names."""
    names = sorted(fields_of(df), key=pipelines.name_key)
    one = df.agg(F.count("*").alias("n"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"m{k}") for k, c in enumerate(names)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(k + 1).alias("place"), F.lit(c).alias("field"), F.col("n"), F.col(f"m{k}").alias("n_missing")) for k, c in enumerate(names)])))


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """field and how often it is in one file only, or has other values: only_a, only_b, differ, largest."""
    names = [c for c in fields_of(a) if c in b.columns]
    both = a.select("iglo", *[F.col(f"`{c}`").alias(f"a{k}") for k, c in enumerate(names)]).join(b.select("iglo", *[F.col(f"`{c}`").alias(f"b{k}") for k, c in enumerate(names)]), "iglo", "full")
    found = []
    for k in range(len(names)):
        x, y = F.col(f"a{k}"), F.col(f"b{k}")
        found += [F.count_if(x.isNotNull() & y.isNull()).alias(f"oa{k}"), F.count_if(x.isNull() & y.isNotNull()).alias(f"ob{k}"), F.count_if(x != y).alias(f"d{k}"), F.max(F.abs(x - y)).alias(f"l{k}")]
    rows = [F.struct(F.lit(c).alias("field"), F.col(f"oa{k}").alias("only_a"), F.col(f"ob{k}").alias("only_b"), F.col(f"d{k}").alias("differ"), F.col(f"l{k}").alias("largest")) for k, c in enumerate(names)]
    return both.agg(*found).select(F.inline(F.array(*rows)))


def mixed(a: DataFrame, b: DataFrame, field: str) -> DataFrame:
    """b with the field of a, and its own where a has none; both must have the same points."""
    n, m, both = a.count(), b.count(), a.join(b, "iglo", "left_semi").count()
    if not n == m == both:
        raise ValueError(f"size mismatch: {n} and {m} points, {both} in common")
    other = a.select("iglo", F.col(f"`{field}`").alias("_other"))
    return b.join(other, "iglo").withColumn(field, fx.mixed(F.col("_other"), F.col(f"`{field}`"))).drop("_other")


def water_content(df: DataFrame, parts: Sequence[str], low: float = 0.001, high: float = 1.0, name: str = "SURFTOT.WATER") -> DataFrame:
    """df with the logarithmic scale of the sum of the parts."""
    total = F.lit(0.0)
    for c in parts:
        total = total + F.col(f"`{c}`")
    return df.withColumn(name, fx.log_scaled(total, low, high))


def converted(df: DataFrame, out: str, bits: int, skip: Sequence[str] = (), only: Sequence[str] | None = None, second: bool = False) -> DataFrame:
    """Writes headers and packed blocks of the fields; gives field, n_codes, data_bytes, bitmap_bytes and the seconds that all of them took."""
    spark, began = df.sparkSession, time.time()
    chosen = pipelines.recoded(df, include=list(only) if only else None, skip=list(skip))
    packing.header(chosen, dict.fromkeys(fields_of(chosen), bits)).write.parquet(f"{out}/headers")
    headers = spark.read.parquet(f"{out}/headers")
    packing.blocks(packing.packed(chosen, headers), headers, second).write.parquet(f"{out}/blocks")
    return packing.stored_bytes(spark.read.parquet(f"{out}/blocks")).withColumn("seconds", F.lit(time.time() - began))


def decoded(spark: SparkSession, file: str) -> DataFrame:
    """The fields that converted() wrote, a column each."""
    headers = spark.read.parquet(f"{file}/headers")
    names = sorted((r["field"] for r in headers.select("field").collect()), key=pipelines.name_key)  # a row for each field
    values = packing.unpacked(packing.codes(spark.read.parquet(f"{file}/blocks")), headers)
    return values.groupBy("iglo").pivot("field", names).agg(F.first("value"))


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="gridloom.tools", description=__doc__.splitlines()[0])
    sub = out.add_subparsers(dest="tool", required=True)

    def tool(name: str, *files: str, **options) -> argparse.ArgumentParser:
        one = sub.add_parser(name)
        for f in files:
            one.add_argument(f"--{f}", required=True)
        for k, v in options.items():
            one.add_argument(f"--{k}", **v)
        return one

    tool("list", "file")
    tool("size", "file")
    tool("diff", "file-1", "file-2")
    tool("mask-diff", "file-1", "file-2", field={"default": "SFX.SST"})
    tool("cat", "file-1", "file-2", "out")
    tool("split", "file", "out", each={"type": int, "default": 10})
    tool("mix", "file-1", "file-2", "out", field={"default": "SFX.SST"})
    tool("water-content", "file", "out", parts={"nargs": "+", "required": True}, low={"type": float, "default": 0.001}, high={"type": float, "default": 1.0})
    tool("convert", "file", "out", bits={"type": int, "default": 16}, skip={"nargs": "*", "default": []}, only={"nargs": "*", "default": None}, packing={"choices": ["simple", "second"], "default": "simple"})
    tool("decode", "file", "out")
    return out


def run(spark: SparkSession, arguments: Sequence[str]) -> DataFrame | None:
    """The table that a tool shows, or None if it writes."""
    from .sources import sinks

    o = parser().parse_args(arguments)
    read: Callable[[str], DataFrame] = spark.read.parquet
    if o.tool in ("list", "size"):
        found = listed(read(o.file))
        return found if o.tool == "list" else found.agg(F.count("*").alias("n_fields"), F.max("n").alias("n_points"))
    if o.tool == "diff":
        return differing(read(o.file_1), read(o.file_2))
    if o.tool == "mask-diff":
        both = read(o.file_1).select("iglo", F.col(f"`{o.field}`").alias("a")).join(read(o.file_2).select("iglo", F.col(f"`{o.field}`").alias("b")), "iglo", "full")
        return regrid.count_differences(both, "a", "b")
    if o.tool == "split":
        df = read(o.file)
        sinks.write_batches(df, o.out, sorted(fields_of(df), key=pipelines.name_key), o.each)
    elif o.tool == "cat":
        a, b = read(o.file_1), read(o.file_2)
        a.join(b.drop(*[c for c in fields_of(b) if c in a.columns]), "iglo", "full").write.parquet(o.out)
    elif o.tool == "mix":
        mixed(read(o.file_1), read(o.file_2), o.field).write.parquet(o.out)
    elif o.tool == "water-content":
        water_content(read(o.file), o.parts, o.low, o.high).write.parquet(o.out)
    elif o.tool == "decode":
        decoded(spark, o.file).write.parquet(o.out)
    else:
        return converted(read(o.file), o.out, o.bits, o.skip, o.only, o.packing == "second")
    return None


if __name__ == "__main__":
    import sys

    found = run(SparkSession.builder.getOrCreate(), sys.argv[1:])
    if found is not None:
        found.show(1000, truncate=False)
