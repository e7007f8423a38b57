"""Sums and means with the same bits at any partitioning.

A double is split into whole numbers of two fixed weights, which depend on its size alone: values within a factor of 2^BIN go
to one bin, where the upper and lower halves of their digits add up as 64-bit integers. Integer sums do not depend on the order,
so they are partial aggregates like any other: a row for each cell, bin and task travels, and cells meet few bins. At the end
each cell's bins are one exact number, which is rounded once: the sum is the double nearest to the true sum, the mean the one
nearest to the true mean.

Missing values count for nothing; a cell without any has null. NaN and infinities give what adding them gives in any order. A bin
of a cell holds two thousand million values; beyond that the addition fails rather than wraps. Digits below 2^-1014 are cut off.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

#: Powers of two that share a bin, and how many digits after the bin's point the upper and the lower half reach.
BIN, UPPER, LOWER = 8, 24, 54
#: The lowest and the highest bin.
FIRST, LAST = -120, 127
#: Whole numbers of 2^-DEPTH hold every digit of every bin.
DEPTH = LOWER - BIN * FIRST


def halves(value: Column) -> dict[str, Column]:
    """bin, upper and lower of a finite value that is there, as columns that are null for others."""
    size = F.abs(value)
    good = value.isNotNull() & ~F.isnan(value) & (size < float("inf"))
    own = F.when(size > 0, F.floor(F.log2(F.when(size > 0, size)) / BIN)).otherwise(0)
    number = F.greatest(F.lit(FIRST), F.least(F.lit(LAST), own))
    # Powers of two as literals: nothing rests on how exact a power function is.
    scale = F.get(F.array(*[F.lit(2.0 ** (-BIN * b)) for b in range(FIRST, LAST + 1)]), (number - FIRST).cast("int"))
    shifted = value * scale * 2.0**UPPER
    upper = F.when(shifted >= 0, F.floor(shifted)).otherwise(F.ceil(shifted))
    lower = (shifted - upper) * 2.0 ** (LOWER - UPPER)
    return {"bin": F.when(good, number.cast("int")), "upper": F.when(good, upper), "lower": F.when(good, lower.cast("long")), "other": F.when(value.isNotNull() & ~good, value)}


def sums(mapped: DataFrame, fields: list[str], key: str = "iglo2") -> DataFrame:
    """key, and field_sum, field_avg and field_cnt of each field: correctly rounded, whatever the order and number of partitions."""
    each = F.array(*[F.struct(F.lit(k).alias("field"), F.col(f).cast("double").alias("value")) for k, f in enumerate(fields)])
    long = mapped.select(F.col(key), F.inline(each))
    parts = long.select(key, "field", "value", *[c.alias(n) for n, c in halves(F.col("value")).items()])
    per = parts.groupBy(key, "field", "bin").agg(F.count("value").alias("n"), F.sum("upper").alias("upper"), F.sum("lower").alias("lower"), F.sum("other").alias("other"))
    n = len(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, out = None, None, []

        def row():
            found = [now]
            for count, total, other in state:
                if not count:
                    found += [None, None, 0]
                elif other is not None:
                    found += [other, other, count]
                else:
                    found += [nearest(total, 1 << DEPTH), nearest(total, count << DEPTH), count]
            return found

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int64(), *[pa.float64(), pa.float64(), pa.int64()] * n])], names)

        for rows in batches:
            for cell, field, place, count, upper, lower, other in zip(*(rows.column(c).to_pylist() for c in (key, "field", "bin", "n", "upper", "lower", "other"))):
                if state is None or cell != now:
                    if state is not None:
                        out.append(row())
                    now, state = cell, [[0, 0, None] for _ in range(n)]
                own = state[field]
                own[0] += count
                if place is not None:
                    own[1] += (upper << BIN * place - UPPER + DEPTH) + (lower << BIN * place - LOWER + DEPTH)
                elif other is not None:
                    own[2] = other
            if len(out) >= 10_000:
                yield batch()
                out = []
        if state is not None:
            out.append(row())
            yield batch()

    names = [key, *[f"{f}_{c}" for f in fields for c in ("sum", "avg", "cnt")]]
    kinds = [LongType(), *[DoubleType(), DoubleType(), LongType()] * n]
    schema = StructType([StructField(c, t) for c, t in zip(names, kinds)])
    return per.withColumn(key, F.col(key).cast("long")).repartition(key).sortWithinPartitions(key, "field").mapInArrow(run, schema)


def nearest(top: int, below: int) -> float:
    """The double nearest to top / below; Python divides whole numbers with one rounding."""
    try:
        return top / below
    except OverflowError:
        return float("inf") if top > 0 else float("-inf")
