"""Regridding: aggregates over the source points of each target cell, and weighted means over four corners.

Missing values are nulls: sum, avg, min and max skip them and give null for a cell without any, as folds
with a sentinel do. Aggregates are partial before the shuffle, so at most a row for each cell and task travels. Folds and lists
in source order are in folds, sums whose bits do not depend on the partitioning in exact.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kept

#: AG-SEL.
OPTIONS: dict[str, Callable[[Column], Column]] = {"avg": F.avg, "min": F.min, "max": F.max, "sum": F.sum}
CODES = {0: "avg", 1: "min", 2: "max", 3: "sum"}


def regrid(mapped: DataFrame, fields: dict[str, str | tuple[str, ...]], key: str = "iglo2") -> DataFrame:
    """AG-AVG, AG-SUM, AG-MIN, AG-MAX: one row for each target; fields maps a field to its option or options."""
    out = []
    for field, options in fields.items():
        many = not isinstance(options, str)
        out += [OPTIONS[o](F.col(field)).alias(f"{field}_{o}" if many else field) for o in (options if many else (options,))]
    return mapped.groupBy(key).agg(*out)


def counts(mapped: DataFrame, key: str = "iglo2") -> DataFrame:
    """AG-CNT: cnt and off, the number of earlier targets' source points, of each target.

    The running sum is by ranges: a sum for each range of keys, then offsets within each; no task sees all targets."""
    from pyspark.sql import Window

    per = mapped.groupBy(key).agg(F.count("*").alias("cnt"))
    ranged = per.withColumn("_r", F.floor(F.col(key) / 4096))
    total = ranged.groupBy("_r").agg(F.sum("cnt").alias("_n"))
    super_ = total.withColumn("_s", F.floor(F.col("_r") / 4096))
    top = super_.groupBy("_s").agg(F.sum("_n").alias("_m"))
    before_top = top.withColumn("_top", F.coalesce(F.sum("_m").over(Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inner = super_.withColumn("_in", F.coalesce(F.sum("_n").over(Window.partitionBy("_s").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    start = inner.join(before_top, "_s").select("_r", (F.col("_in") + F.col("_top")).alias("_start"))
    own = F.coalesce(F.sum("cnt").over(Window.partitionBy("_r").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.withColumn("_own", own).join(start, "_r").select(key, "cnt", (F.col("_start") + F.col("_own")).alias("off"))


def missing_targets(targets: DataFrame, mapped: DataFrame) -> DataFrame:
    """AG-MISS: n_missing, the number of targets without any source point."""
    return targets.join(mapped.select(F.col("iglo2").alias("iglo")), "iglo", "left_anti").agg(F.count("*").alias("n_missing"))


def interpolate4(mapping: DataFrame | kept.Kept, source: DataFrame, fields: list[str], undef: bool = True, by: tuple[str, ...] = ()) -> DataFrame:
    """ST-APPLY: weighted mean of each field over the corners; with undef, over those that have a value, null if their weights are 0.

    by: columns of the source, such as a month, for each of whose values there is a mean. A stored mapping is applied by blocks."""
    if isinstance(mapping, kept.Kept):
        return kept.apply(mapping, source, fields, undef, by)
    values = source.select(F.col("iglo").alias("iglo1"), *by, *fields)
    joined = mapping.join(values, "iglo1", "inner" if by else "left")
    out = []
    for f in fields:
        # A weight of 0 times a missing value counts as nothing.
        top = F.sum(F.when(F.col("w") != 0, F.col("w") * F.col(f)))
        if undef:
            below = F.sum(F.when(F.col(f).isNotNull(), F.col("w")))
            out.append(F.when(below > 0, top / below).alias(f))
        else:
            gaps = F.count_if((F.col("w") != 0) & F.col(f).isNull())
            out.append(F.when(gaps == 0, top).alias(f))
    return joined.groupBy("iglo2", *by).agg(*out)


def statistics(df: DataFrame, fields: list[str]) -> DataFrame:
    """AG-STAT: field, lo, hi, mean over all points, nulls skipped; partial sums travel, whatever the number of points."""
    one = df.agg(*[f(c).alias(f"{n}_{c}") for c in fields for n, f in (("lo", F.min), ("hi", F.max), ("mean", F.avg))])
    each = F.array(*[F.struct(F.lit(c).alias("field"), *[F.col(f"{n}_{c}").alias(n) for n in ("lo", "hi", "mean")]) for c in fields])
    return one.select(F.inline(each))


def filled_with_means(df: DataFrame, fractions: dict[str, str | None]) -> DataFrame:
    """AG-MASKAVG, AG-FILLAVG: missing values of each field become the mean of its present ones, both only where its fraction is over 0 if it has one.

    One aggregate serves all fields, so the plan holds the input twice, however many they are."""
    if not fractions:
        return df
    inside = {f: F.col(m) > 0 if m else F.lit(True) for f, m in fractions.items()}
    means = df.agg(*[F.avg(F.when(w, F.col(f))).alias(f"_mean_{f}") for f, w in inside.items()])
    out = df.crossJoin(F.broadcast(means))  # one row
    filled = {f: F.when(F.col(f).isNull() & w, F.col(f"_mean_{f}")).otherwise(F.col(f)) for f, w in inside.items()}
    return out.withColumns(filled).drop(*[f"_mean_{f}" for f in fractions])


def filled_with_mean(df: DataFrame, field: str, fraction: str | None = None) -> DataFrame:
    return filled_with_means(df, {field: fraction})


def count_differences(df: DataFrame, a: str, b: str) -> DataFrame:
    """AG-COUNTDIFF: points that only a has, that only b has, and that both have with other values."""
    x, y = F.col(a), F.col(b)
    return df.agg(F.count_if(x.isNotNull() & y.isNull()).alias("only_a"), F.count_if(x.isNull() & y.isNotNull()).alias("only_b"), F.count_if(x != y).alias("differ"))


def matching_masks(df: DataFrame, fields: list[str], fractions: list[str]) -> DataFrame:
    """JN-MASKMATCH: field and mask, the first fraction (or null) that is over 0 exactly where the field has a value; one pass for all pairs."""
    tests = [F.count_if(F.coalesce(F.col(m) > 0, F.lit(False)) != F.col(f).isNotNull()).alias(f"{f}__{m}") for f in fields for m in fractions]
    one = df.agg(*tests)
    rows = []
    for f in fields:
        first = F.coalesce(*[F.when(F.col(f"{f}__{m}") == 0, F.lit(m)) for m in fractions])
        rows.append(F.struct(F.lit(f).alias("field"), first.alias("mask")))
    return one.select(F.inline(F.array(*rows)))
