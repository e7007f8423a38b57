"""Keys that come more than once in the corpus, found without a row for each key.

Index entries are many and most of them come once. A block keeps its own, sorted, with the unit (a row of the block) that has
each. Sorted keys are dealt by range into parts, compressed as steps from one to the next: some seven bytes an entry with
its unit. A task gets a part of all blocks, sorts it and gives back only what comes again. The number of parts follows the
number of entries, so that what a task sorts has a bounded size. Two keys that fall together by chance cost a comparison,
not a result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import deflated, inflated
from .common import given_back

BITS = 48
#: Entries that a task sorts at a time, and the least number of parts.
PER_PART, LEAST_PARTS = 1_000_000, 32
ROWS = 1 << 16
U = np.uint64


def planes(values: np.ndarray) -> bytes:
    """Integers below 2^64, compressed: all lowest bytes, then all second ones and so on, as far as they are not 0."""
    values = values.astype("<u8")
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + deflated(np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes())


def restored(data: bytes, n: int) -> np.ndarray:
    """The n integers that planes() got."""
    width = data[0]
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(inflated(data[1:]), np.uint8).reshape(width, n).T
    return out.view("<u8").ravel()


def kept(keys: np.ndarray, units: np.ndarray, drop: int = 64 - BITS) -> tuple[int, bytes, bytes]:
    """A block's entries: how many, the keys without their lowest bits in order as steps, and the unit of each."""
    keys = keys >> U(drop)
    order = np.argsort(keys, kind="stable")
    return len(keys), planes(np.diff(keys[order], prepend=U(0))), planes(units[order].astype(U))


def parts_for(blocks: DataFrame, entries: str = "entries", each: int = PER_PART) -> int:
    """A power of two of parts such that one has about `each` entries at most."""
    total, parts = blocks.agg(F.coalesce(F.sum(entries), F.lit(0))).first()[0], LEAST_PARTS
    while parts * each < total:
        parts *= 2
    return parts


def dealt(blocks: DataFrame, columns: tuple[str, ...], bits: int = BITS) -> DataFrame:
    """part, block, entries, keys and other columns of entries: each block's share of each part, parts in one task each, sorted by part."""
    parts = parts_for(blocks)
    shift = bits - (parts.bit_length() - 1)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, n, keys, *others in zip(*(batch.column(c).to_pylist() for c in ("block", "entries", "keys", *columns))):
                keys, others = np.cumsum(restored(keys, n), dtype=U), [restored(x, n) for x in others]
                ends = np.r_[np.searchsorted(keys, np.arange(1, parts, dtype=U) << U(shift)), n]
                own = [(p, b - a, planes(np.diff(keys[a:b], prepend=U(0))), *[planes(x[a:b]) for x in others]) for p, (a, b) in enumerate(zip(np.r_[0, ends[:-1]].tolist(), ends.tolist())) if b > a]
                if own:
                    p, size, *data = zip(*own)
                    yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array([block] * len(p), pa.int64()), pa.array(size, pa.int32()), *[pa.array(x, pa.binary()) for x in data]], ["part", "block", "entries", "keys", *columns])
        given_back()

    schema = "part int, block long, entries int, keys binary, " + ", ".join(f"{c} binary" for c in columns)
    return blocks.select("block", "entries", "keys", *columns).mapInArrow(deal, schema).repartition("part").sortWithinPartitions("part")


def by_part(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]]:
    """Of each part: its blocks, how many entries each has, all keys, the other columns, and the order that sorts the keys."""
    part, blocks, sizes, held = None, [], [], []

    def whole():
        keys, *others = (np.concatenate(x) for x in zip(*held))
        return blocks, np.array(sizes), keys, others, np.argsort(keys, kind="stable")

    for batch in batches:
        for p, block, n, keys, *others in zip(*(batch.column(c).to_pylist() for c in ("part", "block", "entries", "keys", *columns))):
            if p != part:
                if held:
                    yield whole()
                part, blocks, sizes, held = p, [], [], []
            blocks.append(block)
            sizes.append(n)
            held.append((np.cumsum(restored(keys, n), dtype=U), *[restored(x, n) for x in others]))
    if held:
        yield whole()
    given_back()


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted keys: the first place of each distinct one, and how often it comes."""
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return first, np.diff(np.r_[first, len(keys)])


def again(blocks: DataFrame) -> DataFrame:
    """bucket (a key), n (how often it comes), block and unit: a row for each entry whose key comes again. blocks: a written table with block, entries, keys and units as kept() gives them."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, sizes, keys, (units,), order in by_part(batches, ("units",)):
            _, times = runs(keys[order])
            n = np.repeat(times, times)
            place = np.flatnonzero(n > 1)
            at = order[place]
            block = np.repeat(np.array(names, np.int64), sizes)[at]
            for i in range(0, len(place), ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + ROWS].astype(np.int64)) for x in (keys[at], n[place], block, units[at])], ["bucket", "n", "block", "unit"])

    return dealt(blocks, ("units",)).mapInArrow(meet, "bucket long, n long, block long, unit long")


def shared_units(blocks: DataFrame, prints: int) -> DataFrame:
    """block, n, units and buckets, packed: the units of a block's entries whose key comes again with other fingerprints, or which come again themselves, by part.

    blocks: as for again(), with all 64 bits of their keys, of which the lowest `prints` are a fingerprint and the others the
    key. An entry's bucket is 2 key + 2 where the key has other fingerprints too and the entry is the first with its own, else 0,
    and 1 more if the entry comes again in another block: so of the many equal ones under a key one names the bucket."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, sizes, keys, (units,), order in by_part(batches, ("units",)):
            whole = keys[order]
            first, times = runs(whole >> U(prints))
            _, equal = runs(whole)
            new = np.r_[True, whole[1:] != whole[:-1]]
            name = new & np.repeat(np.add.reduceat(new, first) > 1, times)
            bucket = np.zeros(len(keys), U)
            bucket[order[name]] = ((whole[name] >> U(prints)) + U(1)) * U(2)
            bucket[order] += np.repeat(equal > 1, equal).astype(U)
            rows, start = [], 0
            for block, size in zip(names, sizes.tolist()):
                own = np.flatnonzero(bucket[start : start + size]) + start
                if len(own):
                    rows.append((block, len(own), planes(units[own]), planes(bucket[own])))
                start += size
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.binary(), pa.binary()))], ["block", "n", "units", "buckets"])

    return dealt(blocks, ("units",), 64).mapInArrow(meet, "block long, n int, units binary, buckets binary")
