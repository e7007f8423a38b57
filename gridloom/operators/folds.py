"""Ordered folds and lists of cells of any size.

The points of a cell are not gathered. They are sorted behind the shuffle, by cell and source number, so Spark spills what does
not fit, and a fold runs over them batch by batch with a small state that is carried from one batch to the next. Where partial
results may be put together, and for lists, a cell is cut by source number into spans of SPAN, each of which may go to another
task, so that one cell with most points is shared by many.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Source numbers of a span: the most points of a list's chunk, if each source number comes once in a cell.
SPAN = 1 << 16


@dataclass(frozen=True)
class Fold:
    """AG-REDUCE: from seed on, acc = op(acc, before(value)) over the values that are there, in source order; then finish(count, acc).

    op is a binary ufunc, applied from left to right; values of one source number come by size. Without a value the result is null.
    finish gets arrays. With parted, for which seed must change nothing, the results of spans are put together by op as well, in their
    order: for sums that are not exact these are other last bits than from left to right, but the same ones at any partitioning."""

    op: np.ufunc
    seed: float
    before: Callable[[np.ndarray], np.ndarray] | None = None
    finish: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None
    parted: bool = False


def _runs(keys: list[np.ndarray]) -> list[int]:
    """Where in sorted columns another key starts, from 0 to their length."""
    n = len(keys[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return [*np.flatnonzero(new).tolist(), n]


def _stream(df: DataFrame, names: list[str], fold: Fold, merging: bool) -> DataFrame:
    """names, n and acc: a row for each key, from rows sorted by key and order; merging: values are partial results with counts n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, count, acc = None, 0, fold.seed
        for batch in batches:
            if not batch.num_rows:
                continue
            out = []
            keys = [batch.column(c).to_numpy() for c in names]
            values = batch.column("value")
            there = values.is_valid().to_numpy(zero_copy_only=False)
            plain = values.to_numpy(zero_copy_only=False).astype(float)
            times = batch.column("n").to_numpy() if merging else there.astype(np.int64)
            if fold.before is not None and not merging:
                plain = fold.before(plain)
            bounds = _runs(keys)
            for a, b in zip(bounds, bounds[1:]):
                key = tuple(int(k[a]) for k in keys)
                if key != now:
                    if now is not None:
                        out.append((*now, count, acc))
                    now, count, acc = key, 0, fold.seed
                own = plain[a:b][there[a:b]]
                count += int(times[a:b].sum())
                if len(own):
                    acc = float(fold.op.accumulate(np.concatenate([[acc], own]))[-1])
            yield pack(out)
        if now is not None:
            yield pack([(*now, count, acc)])

    def pack(rows):
        columns = list(zip(*rows)) if rows else [()] * (len(names) + 2)
        kinds = [pa.int64()] * (len(names) + 1) + [pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [*names, "n", "acc"])

    return df.mapInArrow(run, ", ".join(f"`{c}` long" for c in [*names, "n"]) + ", acc double")


def folded(mapped: DataFrame, field: str, fold: Fold, key: str = "iglo2", order: str = "iglo1", span: int = SPAN) -> DataFrame:
    """key and field: the fold over each cell's values in the order of their source number; bounded memory for cells of any size."""
    rows = mapped.select(F.col(key).cast("long").alias(key), F.col(order).cast("long").alias("_order"), F.col(field).cast("double").alias("value"))
    if fold.parted:
        cut = rows.withColumn("_span", F.floor(F.col("_order") / span))
        parts = _stream(cut.repartition(key, "_span").sortWithinPartitions(key, "_span", "_order", "value").select(key, "_span", "value"), [key, "_span"], fold, False)
        # A span without values has none to add; its cell is there all the same.
        rows = parts.select(key, "_span", F.when(F.col("n") > 0, F.col("acc")).alias("value"), "n")
        done = _stream(rows.repartition(key).sortWithinPartitions(key, "_span").select(key, "value", "n"), [key], fold, True)
    else:
        done = _stream(rows.repartition(key).sortWithinPartitions(key, "_order", "value").select(key, "value"), [key], fold, False)
    finish = fold.finish

    def end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, acc = batch.column("n").to_numpy(), batch.column("acc").to_numpy()
            value = finish(n, acc) if finish else acc
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(value.astype(float), mask=n == 0)], [key, field])

    return done.mapInArrow(end, f"`{key}` long, `{field}` double")


def lists(mapped: DataFrame, fields: list[str], key: str = "iglo2", order: str = "iglo1", span: int = SPAN) -> DataFrame:
    """AG-LIST: key, chunk, at, n and values: the source rows of each target as arrays of structs sorted by source number, a span of source numbers in each.

    at: how many of the target's rows stand in earlier chunks, so that at is the row offset of a chunk within its target, and with
    counts() that of the whole list. Chunks of a target go to many tasks; only their counts meet."""
    cut = mapped.withColumn("chunk", F.floor(F.col(order) / span))
    per = cut.groupBy(key, "chunk").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(key).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = cut.groupBy(key, "chunk").agg(F.array_sort(F.collect_list(F.struct(order, *fields))).alias("values"))
    return held.join(per.withColumn("at", before), [key, "chunk"]).select(key, "chunk", "at", "n", "values")
