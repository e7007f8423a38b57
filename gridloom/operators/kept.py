"""A 4-point mapping that is built once, kept as a table, and applied to any number of fields and months.

The mapping is a sparse matrix with a row for each target and a column for each source point. It is stored in blocks: all
entries between SIDE consecutive targets and SIDE consecutive sources, in compressed rows, as packed arrays. The table is bucketed
by source block, so applying it moves only the source values, once, to where their blocks are: each block is multiplied by the
vectors of all fields (and months) of its source block in place. What leaves is, for each pair of blocks, the partial sums of its
targets, which are added up in the order of their source blocks: the same bits each time.

Building is one shuffle of the entries by source block. The table stands in Spark's warehouse under its name until it is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Targets, and sources, of a block.
SIDE = 1 << 14
#: Buckets of a stored mapping: tasks that apply it, at most.
BUCKETS = 64


@dataclass(frozen=True)
class Kept:
    """The name of the stored table, its buckets, and the sides of its blocks."""

    name: str
    buckets: int = BUCKETS
    side: int = SIDE

    def blocks(self, spark: SparkSession) -> DataFrame:
        return spark.table(self.name)


ENTRIES = "source long, target long, n int, targets binary, starts binary, sources binary, weights binary"


def build(mapping: DataFrame, name: str, buckets: int = BUCKETS, side: int = SIDE) -> Kept:
    """Stores rows iglo2, corner, iglo1, w (of mapping4()) under a table name.

    A block: targets (numbers within the block of those that have entries), starts (of each one's entries, with their end),
    sources (numbers within the block) and weights; targets in order, entries by corner."""
    rows = mapping.select(F.expr(f"iglo1 div {side}").alias("source"), F.expr(f"iglo2 div {side}").alias("target"), F.col("iglo2").cast("long").alias("iglo2"), F.col("iglo1").cast("long").alias("iglo1"), F.col("corner").cast("int").alias("corner"), F.col("w").cast("double").alias("w"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def block():
            rows_, columns, weights = (np.concatenate(x) for x in zip(*held))
            targets, first = np.unique(rows_, return_index=True)
            made = (targets.astype("<u4"), np.r_[first, len(rows_)].astype("<u4"), columns.astype("<u4"), weights.astype("<f8"))
            return pa.RecordBatch.from_arrays([pa.array([now[0]]), pa.array([now[1]]), pa.array([len(targets)], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in made]], [x.split(" ")[0] for x in ENTRIES.split(", ")])

        for batch in batches:
            if not batch.num_rows:
                continue
            source, target, iglo2, iglo1, w = (batch.column(c).to_numpy() for c in ("source", "target", "iglo2", "iglo1", "w"))
            bounds = [0, *(np.flatnonzero((source[1:] != source[:-1]) | (target[1:] != target[:-1])) + 1).tolist(), len(source)]
            for a, b in zip(bounds, bounds[1:]):
                key = (int(source[a]), int(target[a]))
                if key != now:
                    if now is not None:
                        yield block()
                    now, held = key, []
                held.append((iglo2[a:b] - key[1] * side, iglo1[a:b] - key[0] * side, w[a:b]))
        if now is not None:
            yield block()

    blocks = rows.repartition(buckets, "source").sortWithinPartitions("source", "target", "iglo2", "corner").mapInArrow(run, ENTRIES)
    blocks.write.mode("overwrite").bucketBy(buckets, "source").sortBy("source").saveAsTable(name)
    return Kept(name, buckets, side)


def apply(kept: Kept, source: DataFrame, fields: list[str], undef: bool = True, by: tuple[str, ...] = ()) -> DataFrame:
    """ST-APPLY by blocks: iglo2, by and the weighted mean of each field, as interpolate4() gives them.

    source: iglo, by and fields, a row for each point (and value of by) at most. With undef, the mean over the corners that have
    a value; else null where one with a weight is missing. by: columns, such as a month, whose values get a mean each."""
    side, n = kept.side, len(fields)
    values = source.select(F.expr(f"iglo div {side}").alias("source"), F.expr(f"int(iglo % {side})").alias("at"), *by, *[F.col(f).cast("double").alias(f"v{k}") for k, f in enumerate(fields)])
    dealt = values.repartition(kept.buckets, "source")
    vectors = dealt.groupBy("source", *by).agg(F.collect_list(F.struct("at", *[f"v{k}" for k in range(n)])).alias("points"))  # `side` points at most
    met = kept.blocks(source.sparkSession).hint("merge").join(vectors, "source", "inner" if by else "left")
    by_fields = [vectors.schema[c] for c in by]
    by_types = [f"`{f.name}` {f.dataType.simpleString()}" for f in by_fields]

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                targets, starts, sources = (np.frombuffer(batch.column(c)[r].as_buffer(), "<u4").astype(np.int64) for c in ("targets", "starts", "sources"))
                w = np.frombuffer(batch.column("weights")[r].as_buffer(), "<f8")
                points = batch.column("points")[r].values
                made = []
                for k in range(n):
                    dense, there = np.zeros(side), np.zeros(side, bool)
                    if points is not None:
                        own = points.field(f"v{k}")
                        at = points.field("at").to_numpy()[own.is_valid().to_numpy(zero_copy_only=False)]
                        dense[at], there[at] = own.drop_null().to_numpy(), True
                    has = there[sources]
                    top = np.add.reduceat(np.where(has & (w != 0), w * dense[sources], 0.0), starts[:-1])
                    below = np.add.reduceat(np.where(has, w, 0.0), starts[:-1])
                    gaps = np.add.reduceat((~has & (w != 0)).astype(float), starts[:-1])
                    made += [x.astype("<f8").tobytes() for x in (top, below, gaps)]
                row = batch.slice(r, 1)
                yield pa.RecordBatch.from_arrays([row.column("target"), row.column("source"), *[row.column(c) for c in by], row.column("targets"), *[pa.array([x], pa.binary()) for x in made]], ["target", "source", *by, "targets", *names])

    names = [f"{x}{k}" for k in range(n) for x in ("top", "below", "gaps")]
    schema = ", ".join(["target long", "source long", *by_types, "targets binary", *[f"{c} binary" for c in names]])
    partial = met.select("target", "source", *by, "targets", "starts", "sources", "weights", "points").mapInArrow(multiply, schema)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums, seen, labels = None, None, None, None

        def out():
            at = np.flatnonzero(seen)
            columns = [pa.array(now[0] * side + at), *[x.take(pa.array(np.zeros(len(at), np.int64))) for x in labels]]
            for k in range(n):
                top, below, gaps = (x[at] for x in sums[3 * k : 3 * k + 3])
                good = below > 0 if undef else gaps == 0
                columns.append(pa.array(np.divide(top, below, out=np.zeros(len(at)), where=good) if undef else top, mask=~good))
            return pa.RecordBatch.from_arrays(columns, ["iglo2", *by, *fields])

        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1)
                key = (row.column("target")[0].as_py(), *[row.column(c)[0].as_py() for c in by])
                if key != now:
                    if now is not None:
                        yield out()
                    now, sums, seen, labels = key, [np.zeros(side) for _ in names], np.zeros(side, bool), [row.column(c) for c in by]
                targets = np.frombuffer(row.column("targets")[0].as_buffer(), "<u4")
                seen[targets] = True
                for total, c in zip(sums, names):
                    total[targets] += np.frombuffer(row.column(c)[0].as_buffer(), "<f8")
        if now is not None:
            yield out()

    done = partial.repartition("target", *by).sortWithinPartitions("target", *by, "source")
    return done.mapInArrow(add, ", ".join(["iglo2 long", *by_types, *[f"`{f}` double" for f in fields]]))


def drop(spark: SparkSession, kept: Kept) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {kept.name}")
