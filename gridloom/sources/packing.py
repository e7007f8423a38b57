"""Fields as integers of a few bits and back: simple packing as in the GRIB code tables of the WMO, and plain IEEE numbers.

A value is (reference + code * 2^exponent) / multiplier. The reference is the least value, the exponent the smallest that
lets the largest fit into the bits. One aggregate finds both for all fields; codes are columns, so nothing is collected. A header
is a row for each field.

Codes are stored in blocks of consecutive points, as a stream of so many bits a value; or, by second-order packing, as
differences in the order of the points, in groups of a width each. A block has a bitmap only if a value is missing in it. Blocks
are made and taken apart where they are, each by itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bits as streams

#: Points of a block.
BLOCK = 1 << 16
SIMPLE, SECOND, RAW = "simple", "second", "ieee"
BLOCKS = "field string, first long, n int, n_codes int, packing string, bits int, bitmap binary, data binary"
HEADER = ("field", "packing", "bits", "n", "n_missing", "reference", "exponent", "multiplier")
IEEE = 64


def header(df: DataFrame, fields: dict[str, int], multiplier: dict[str, float] | None = None) -> DataFrame:
    """SNK-FA-ENC: HEADER of each field with so many bits; 64 bits are IEEE numbers."""
    times = multiplier or {}
    found = []
    for f, bits in fields.items():
        v = F.col(f) * times.get(f, 1.0)
        found += [F.count("*").alias(f"n_{f}"), F.count_if(F.col(f).isNull()).alias(f"gap_{f}"), F.min(v).alias(f"lo_{f}"), F.max(v).alias(f"hi_{f}")]
    one = df.agg(*found)
    rows = []
    for f, bits in fields.items():
        span = F.col(f"hi_{f}") - F.col(f"lo_{f}")
        exponent = F.when(span > 0, F.ceil(F.log2(F.when(span > 0, span) / float(2**bits - 1)) - 1e-12)).otherwise(0)
        ieee = bits >= IEEE
        rows.append(F.struct(F.lit(f).alias("field"), F.lit("ieee" if ieee else "simple").alias("packing"), F.lit(bits).alias("bits"), F.col(f"n_{f}").alias("n"), F.col(f"gap_{f}").alias("n_missing"), F.lit(0.0).alias("reference") if ieee else F.coalesce(F.col(f"lo_{f}"), F.lit(0.0)).alias("reference"), (F.lit(0) if ieee else exponent.cast("int")).alias("exponent"), F.lit(float(times.get(f, 1.0))).alias("multiplier")))
    return one.select(F.inline(F.array(*rows)))


def coded(value: Column, packing: Column, reference: Column, exponent: Column, multiplier: Column) -> Column:
    """The code of a value, or the value itself if it is IEEE."""
    return F.when(packing == "ieee", value * multiplier).otherwise(F.round((value * multiplier - reference) / F.pow(F.lit(2.0), exponent)))


def packed(df: DataFrame, headers: DataFrame, key: str = "iglo") -> DataFrame:
    """key, field and code of every value that is there. headers: of header(), a row for each field."""
    names = [r["field"] for r in headers.select("field").collect()]  # a row for each field
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("value")) for f in names])).alias("x")
    long = df.select(key, each).select(key, "x.*").where("value is not null")
    both = long.join(F.broadcast(headers), "field")
    return both.select(key, "field", coded(F.col("value"), F.col("packing"), F.col("reference"), F.col("exponent"), F.col("multiplier")).alias("code"))


def unpacked(codes: DataFrame, headers: DataFrame, key: str = "iglo") -> DataFrame:
    """SNK-FA-DEC: key, field and value of codes; an error if a field does not have as many codes as its header says."""
    counts = codes.groupBy("field").agg(F.count("*").alias("got"))
    checked = headers.join(counts, "field", "left").withColumn("got", F.coalesce("got", F.lit(0)))
    right = F.col("got") == F.col("n") - F.col("n_missing")
    wrong = F.raise_error(F.concat(F.lit("wrong number of values of "), F.col("field")))
    fit = checked.withColumn("multiplier", F.when(right, F.col("multiplier")).otherwise(wrong.cast("double")))
    value = F.when(F.col("packing") == "ieee", F.col("code")).otherwise(F.col("reference") + F.col("code") * F.pow(F.lit(2.0), F.col("exponent")))
    return codes.join(F.broadcast(fit), "field").select(key, "field", (value / F.col("multiplier")).alias("value"))


def largest_error(span: float, bits: int) -> float:
    """Half a step of a field whose values span so much."""
    return 0.0 if bits >= IEEE or span <= 0 else 2.0 ** (math.ceil(math.log2(span / (2**bits - 1))) - 1)


def encoded(codes: np.ndarray, packing: str, bits: int) -> bytes:
    """The stream of a block's codes."""
    if packing == RAW:
        return codes.astype(">f8").tobytes()
    whole = codes.astype(np.int64)
    return streams.best_order(whole) if packing == SECOND else streams.packed(whole, bits)


def decoded(data: bytes, n: int, packing: str, bits: int) -> np.ndarray:
    """The codes of a block's stream; an error if the stream is too short or too long for them."""
    if packing == RAW:
        if len(data) != 8 * n:
            raise ValueError(f"{len(data)} bytes are not {n} numbers of 8 bytes")
        return np.frombuffer(data, ">f8").astype(float)
    if packing == SECOND:
        return streams.from_second_order(data, n).astype(float)
    if len(data) != -(-n * bits // 8):
        raise ValueError(f"{len(data)} bytes are not {n} numbers of {bits} bits")
    return streams.unpacked(data, n, bits).astype(float)


def blocks(codes: DataFrame, headers: DataFrame, second: bool = False, key: str = "iglo", block: int = BLOCK) -> DataFrame:
    """SNK-FA-ENC: BLOCKS of rows key, field and code: the first point's key, points up to the last, codes, bitmap and stream.

    second: second-order packing for fields that are not IEEE numbers. Keys are numbers of points, each once for a field."""
    way = F.when(F.col("packing") == RAW, RAW).otherwise(SECOND if second else SIMPLE)
    rows = codes.join(F.broadcast(headers.select("field", way.alias("packing"), "bits")), "field")  # a row for each field
    dealt = rows.select("field", F.col(key).cast("long").alias("key"), "code", "packing", "bits").withColumn("block", F.expr(f"key div {block}"))
    names = [x.split(" ")[0] for x in BLOCKS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def out():
            whole = pa.Table.from_batches(held)
            at, own = whole.column("key").to_numpy(), whole.column("code").to_numpy()
            first, n = int(at[0]), int(at[-1] - at[0]) + 1
            there = np.zeros(n, bool)
            there[at - first] = True
            packing, bits = whole.column("packing")[0].as_py(), whole.column("bits")[0].as_py()
            row = (now[0], first, n, len(own), packing, bits, b"" if n == len(own) else np.packbits(there).tobytes(), encoded(own, packing, bits))
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds)], names)

        for batch in batches:
            start = 0
            while start < batch.num_rows:  # of a batch, the rows of one block after another
                key_ = (batch.column("field")[start].as_py(), batch.column("block")[start].as_py())
                numbers = batch.column("block").to_numpy()[start:]
                fields = batch.column("field").slice(start).dictionary_encode().indices.to_numpy()
                other = np.flatnonzero((numbers != numbers[0]) | (fields != fields[0]))
                stop = start + int(other[0]) if len(other) else batch.num_rows
                if key_ != now:
                    if now is not None:
                        yield out()
                    now, held = key_, []
                held.append(batch.slice(start, stop - start))
                start = stop
        if now is not None:
            yield out()

    return dealt.repartition("field", "block").sortWithinPartitions("field", "block", "key").mapInArrow(run, BLOCKS)


def codes(stored: DataFrame, key: str = "iglo") -> DataFrame:
    """SNK-FA-DEC: key, field and code of BLOCKS, each block taken apart by itself; an error if its parts do not fit together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                if x["bitmap"]:
                    at = np.flatnonzero(np.unpackbits(np.frombuffer(x["bitmap"], np.uint8))[: x["n"]])
                else:
                    at = np.arange(x["n"])
                if len(at) != x["n_codes"]:
                    raise ValueError(f"block at {x['first']} of {x['field']} marks {len(at)} values and holds {x['n_codes']}")
                own = decoded(x["data"], x["n_codes"], x["packing"], x["bits"])
                yield pa.RecordBatch.from_arrays([pa.array(x["first"] + at), pa.array([x["field"]] * len(at)), pa.array(own)], [key, "field", "code"])

    return stored.select(*[x.split(" ")[0] for x in BLOCKS.split(", ")]).mapInArrow(run, f"`{key}` long, field string, code double")


def stored_bytes(stored: DataFrame) -> DataFrame:
    """field, n_codes and the bytes of its streams and bitmaps."""
    return stored.groupBy("field").agg(F.sum("n_codes").alias("n_codes"), F.sum(F.octet_length("data")).alias("data_bytes"), F.sum(F.octet_length("bitmap")).alias("bitmap_bytes"))
