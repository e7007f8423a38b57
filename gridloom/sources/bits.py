"""Whole numbers as streams of bits: plain with one width, or as differences in groups with a width each.

All is done on arrays: a stream is built from, and taken apart into, the bits of all its numbers at a time.
"""

from __future__ import annotations

import numpy as np

#: Numbers of a group of differences.
GROUP = 32
#: Bits that hold a group's width.
WIDTH = 6


def packed(values: np.ndarray, width: int) -> bytes:
    """Whole numbers of `width` bits each, the highest bit first, filled up to a byte."""
    if not width or not len(values):
        return b""
    shifts = np.arange(width - 1, -1, -1, dtype=np.uint64)
    return np.packbits((values.astype(np.uint64)[:, None] >> shifts & np.uint64(1)).astype(np.uint8).ravel()).tobytes()


def unpacked(data: bytes, n: int, width: int) -> np.ndarray:
    """The n whole numbers that packed() got."""
    if not width:
        return np.zeros(n, np.int64)
    if len(data) * 8 < n * width:
        raise ValueError(f"{len(data)} bytes cannot hold {n} numbers of {width} bits")
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width).reshape(n, width)
    out = np.zeros(n, np.int64)
    for k in range(width):
        out = out << 1 | bits[:, k]
    return out


def widths_of(values: np.ndarray) -> np.ndarray:
    """How many bits each non-negative number needs."""
    out = np.zeros(len(values), np.int64)
    left = values.astype(np.int64)
    while left.any():
        out += left > 0
        left = left >> 1
    return out


def ragged(values: np.ndarray, widths: np.ndarray) -> bytes:
    """Numbers of a width each, one after another, filled up to a byte."""
    ends = np.cumsum(widths)
    total = int(ends[-1]) if len(ends) else 0
    # Bit k of the stream is bit (end of its number - 1 - k) of that number.
    number = np.repeat(np.arange(len(values)), widths)
    shift = np.repeat(ends, widths) - 1 - np.arange(total)
    return np.packbits((values[number] >> shift & 1).astype(np.uint8)).tobytes()


def from_ragged(data: bytes, widths: np.ndarray) -> np.ndarray:
    """The numbers that ragged() got."""
    ends = np.cumsum(widths)
    total = int(ends[-1]) if len(ends) else 0
    if len(data) * 8 < total:
        raise ValueError(f"{len(data)} bytes cannot hold {total} bits")
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=total).astype(np.int64)
    number = np.repeat(np.arange(len(widths)), widths)
    shift = np.repeat(ends, widths) - 1 - np.arange(total)
    out = np.zeros(len(widths), np.int64)
    np.add.at(out, number, bits << shift)
    return out


def differences(values: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The first `order` numbers, and the others as differences of that order."""
    first, now = values[:order].astype(np.int64), values.astype(np.int64)
    for _ in range(order):
        now = np.diff(now)
    return first, now


def undone(first: np.ndarray, diffs: np.ndarray) -> np.ndarray:
    """The numbers of which differences() made first and diffs."""
    order, n = len(first), len(first) + len(diffs)
    # The start of each lower order's differences follows from the first numbers.
    starts = []
    level = first.astype(np.int64)
    for _ in range(order):
        starts.append(level[0])
        level = np.diff(level)
    now = diffs.astype(np.int64)
    for start in reversed(starts):
        now = np.concatenate([[start], start + np.cumsum(now)])
    return now[:n]


def second_order(values: np.ndarray, order: int, group: int = GROUP) -> bytes:
    """Second-order packing: differences of an order (0, 1 or 2) in groups, each with its least value and the bits that the rest needs.

    Head: order, widths of the first numbers and of group references, the least difference (as 8 bytes); then first numbers,
    references, widths and the numbers of all groups."""
    order = min(order, len(values))
    first, diffs = differences(values, order)
    low = int(diffs.min(initial=0)) if len(diffs) else 0
    rest = diffs - low
    groups = -(-len(rest) // group)
    edges = np.arange(groups) * group
    least = np.minimum.reduceat(rest, edges) if groups else rest
    sizes = np.diff(np.r_[edges, len(rest)]) if groups else edges
    own = rest - np.repeat(least, sizes)
    widths = widths_of(np.maximum.reduceat(own, edges)) if groups else edges
    wide_first, wide_least = int(widths_of(np.abs(first)).max(initial=0)) + 1, int(widths_of(least).max(initial=0))
    head = bytes([order, wide_first, wide_least]) + low.to_bytes(8, "big", signed=True)
    signed = first & ((1 << wide_first) - 1)
    return head + packed(signed, wide_first) + packed(least, wide_least) + packed(widths, WIDTH) + ragged(own, np.repeat(widths, sizes))


def from_second_order(data: bytes, n: int, group: int = GROUP) -> np.ndarray:
    """The n numbers that second_order() got."""
    order, wide_first, wide_least = data[:3]
    low, at = int.from_bytes(data[3:11], "big", signed=True), 11

    def take(count: int, width: int) -> np.ndarray:
        nonlocal at
        size = -(-count * width // 8)
        out = unpacked(data[at : at + size], count, width)
        at += size
        return out

    first = take(order, wide_first)
    first = np.where(first >> (wide_first - 1) & 1, first - (1 << wide_first), first)
    groups = -(-(n - order) // group)
    least, widths = take(groups, wide_least), take(groups, WIDTH)
    sizes = np.diff(np.r_[np.arange(groups) * group, n - order]) if groups else np.zeros(0, np.int64)
    own = from_ragged(data[at:], np.repeat(widths, sizes))
    return undone(first, own + np.repeat(least, sizes) + low)


def best_order(values: np.ndarray, group: int = GROUP) -> bytes:
    """The shortest of the second-order packings with orders 0, 1 and 2."""
    return min((second_order(values, k, group) for k in (2, 1, 0)), key=len)
