"""Blocks: per-document token frequencies with a dictionary for each block of about 8 MB of text.

A value that is known once per distinct token (its number of pieces, its count in the corpus) has to reach every document
that holds the token. Rows of (document, token) would be as many as the text has different words. Here a block keeps its
documents' frequencies as three arrays over its own dictionary. The dictionary is dealt by a hash of the token into PARTS
parts of some hundred tokens each, sorted and compressed; a task gets the same part of all blocks, so it meets every distinct
token of that part, and answers each with an array of values. Blocks, and a block's share of a part, have a bounded size; a
frequent token is one entry of each block, and tokens travel without the cost of a row each. What sums over a part
(`gathered`) or looks tokens up in it (`looked_up`) holds the part's distinct tokens, which is the vocabulary over PARTS:
some ten thousand tokens for 10^7 distinct ones. Rows of known tokens hold KNOWN of them at most.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, sliced

BLOCK_BYTES = 8 << 20
PARTS = 1024
#: Tokens in a row of known ones, at most.
KNOWN = 1 << 17
#: Between the tokens of a part; UTF-8 never holds it.
BETWEEN = b"\xff"
LONGS = pa.list_(pa.int64())
LISTS = {"long": LONGS, "double": pa.list_(pa.float64()), "binary": pa.list_(pa.binary())}


class Codes(dict):
    """Numbers keys in the order in which they first come."""

    def __missing__(self, key):
        value = self[key] = len(self)
        return value


class Block:
    """What a tokenizer adds rows to. tokens: code of each; rows, codes, counts: a frequency for each pair."""

    def __init__(self):
        self.tokens, self.rows, self.codes, self.counts = Codes(), [], [], []
        self.columns: dict[str, list] = {}
        self.n = self.size = 0
        #: For the tokenizer: codes of what it has met in this block.
        self.met: dict | None = None

    def add(self, codes: np.ndarray, **columns) -> None:
        """The next document: the codes of its tokens and what else is kept of it."""
        found, at = np.unique(codes, return_inverse=True)
        self.rows.append(np.full(len(found), self.n, np.int32))
        self.codes.append(found.astype(np.int32))
        self.counts.append(np.bincount(at.ravel(), minlength=len(found)))
        for k, v in columns.items():
            self.columns.setdefault(k, []).append(v)
        self.n += 1


def deflated(data: bytes) -> bytes:
    return zstandard.ZstdCompressor().compress(data)


def inflated(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def small(values: np.ndarray, kind: str) -> bytes:
    """Non-negative integers, compressed as the narrow kind; its largest value stands for those beyond it, which follow as longs."""
    most = np.iinfo(kind).max
    over = values >= most
    return deflated(np.where(over, most, values).astype(kind).tobytes() + values[over].astype("<i8").tobytes())


def restored(data: bytes, n: int, kind: str) -> np.ndarray:
    """The n integers that small() got."""
    raw = inflated(data)
    out = np.frombuffer(raw, kind, n).astype(np.int64)
    out[out == np.iinfo(kind).max] = np.frombuffer(raw, "<i8", offset=n * np.dtype(kind).itemsize)
    return out


def pack(rows: np.ndarray, codes: np.ndarray, counts: np.ndarray, n: int) -> list[bytes]:
    """Pairs by row and code, compressed: how many each row has, steps from one code of a row to its next, counts."""
    if n < 1 << 22 and codes.max(initial=0) < 1 << 24 and counts.max(initial=0) < 1 << 16:  # as one integer, sorted fast
        key = np.sort(rows << 40 | codes << 16 | counts)
        rows, codes, counts = key >> 40, key >> 16 & 0xFFFFFF, key & 0xFFFF
    else:
        order = np.lexsort((codes, rows))
        rows, codes, counts = rows[order], codes[order], counts[order]
    sizes = np.bincount(rows, minlength=n)
    steps = np.diff(codes, prepend=0)
    first = np.cumsum(sizes)[:-1]
    first = np.concatenate([[0], first])[sizes > 0]
    steps[first] = codes[first]
    return [small(x, t) for x, t in ((sizes, "<u4"), (steps, "<u2"), (counts, "u1"))]


def unpack(n: int, sizes: bytes, codes: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """rows, codes and counts of all pairs of a block of n documents."""
    sizes = restored(sizes, n, "<u4")
    m = int(sizes.sum())
    steps, counts = restored(codes, m, "<u2"), restored(counts, m, "u1")
    rows = np.repeat(np.arange(n), sizes)
    sums = np.cumsum(steps, dtype=np.int64)
    before = np.concatenate([[0], sums])[np.concatenate([[0], np.cumsum(sizes)[:-1]])] if n else sums
    return rows, sums - before[rows], counts


def joined(tokens: list[bytes]) -> bytes:
    """The tokens of a part of a block, compressed."""
    return deflated(BETWEEN.join(tokens)) if tokens else b""


def parted(data: bytes) -> list[bytes]:
    """The tokens that joined() got."""
    return inflated(data).split(BETWEEN) if data else []


def build(docs: DataFrame, read: Callable[[Block, pa.RecordBatch], None], kept: dict[str, str], size: int = BLOCK_BYTES, also: tuple[str, ...] = ()) -> DataFrame:
    """A row for each block: block, n, an array of each kept column, held (tokens of each part), tokens (the parts as joined() gives them; codes run through all of them), and the documents' pairs as pack() gives them.

    read puts the documents of a slice into the block, tokens as UTF-8. kept: the columns it keeps of a document, long, double or binary.
    also: columns of longs that read needs besides doc_id and text."""
    schema = ", ".join(["block long", "n int", *[f"{k} array<{v}>" for k, v in kept.items()], "held array<int>", "tokens array<binary>", "sizes binary", "codes binary", "counts binary"])

    def row(block: Block, number: int) -> pa.RecordBatch:
        columns = [pa.array([number]), pa.array([block.n], pa.int32())]
        columns += [pa.array([block.columns.get(k, [])], LISTS[v]) for k, v in kept.items()]
        lists: list[list[bytes]] = [[] for _ in range(PARTS)]
        for token in sorted(block.tokens):  # neighbours are alike
            lists[zlib.crc32(token) % PARTS].append(token)
        place = np.empty(len(block.tokens), np.int64)
        place[np.fromiter((block.tokens[t] for x in lists for t in x), np.int64, len(block.tokens))] = np.arange(len(block.tokens))
        columns += [pa.array([[len(x) for x in lists]], pa.list_(pa.int32())), pa.array([[joined(x) for x in lists]], LISTS["binary"])]
        rows, codes, counts = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (block.rows, block.codes, block.counts))
        columns += [pa.array([x], pa.binary()) for x in pack(rows, place[codes], counts, block.n)]
        return pa.RecordBatch.from_arrays(columns, ["block", "n", *kept, "held", "tokens", "sizes", "codes", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, block = TaskContext.get().partitionId() << 32, Block()
        for batch in sliced(batches, "text"):
            read(block, batch)
            block.size += batch.nbytes
            if block.size >= size:
                yield row(block, number)
                number, block = number + 1, Block()
        if block.n:
            yield row(block, number)

    return only(docs, doc_id="long", text="string", **dict.fromkeys(also, "long")).mapInArrow(run, schema)


def parts(blocks: DataFrame) -> DataFrame:
    """block, part, tokens: a row for each part of each block's dictionary that has tokens."""
    return blocks.select("block", F.posexplode("tokens").alias("part", "tokens")).where(F.length("tokens") > 0)


def packed(values) -> bytes:
    return deflated(np.asarray(values, "<i8").tobytes())


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(inflated(data), "<i8")


def answered(parts: DataFrame, value: Callable[[], Callable[[list], list]]) -> DataFrame:
    """block, part and the values of each part's tokens. value() makes, once a task, what maps tokens to values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = value()
        for batch in batches:
            found = [packed(own(parted(tokens))) for tokens in batch.column("tokens").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("part"), pa.array(found, pa.binary())], ["block", "part", "values"])

    return parts.repartition("part").mapInArrow(run, "block long, part int, values binary")


def gathered(parts: DataFrame) -> DataFrame:
    """part, tokens, values, total and kinds: the sums by token of rows part, tokens, values, KNOWN tokens a row; tokens of sum 0 are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(part, sums):
            every = sorted(t for t, n in sums.items() if n)
            for at in range(0, len(every), KNOWN):
                kept = every[at : at + KNOWN]
                values = [sums[t] for t in kept]
                row = [pa.array([part], pa.int32()), pa.array([joined(kept)], pa.binary()), pa.array([packed(values)], pa.binary()), pa.array([sum(values)], pa.int64()), pa.array([len(kept)], pa.int64())]
                yield pa.RecordBatch.from_arrays(row, ["part", "tokens", "values", "total", "kinds"])

        part, sums = None, {}
        for batch in batches:
            for p, tokens, values in zip(batch.column("part").to_pylist(), batch.column("tokens").to_pylist(), batch.column("values").to_pylist()):
                if p != part:
                    yield from out(part, sums)
                    part, sums = p, {}
                for t, n in zip(parted(tokens), unpacked(values).tolist()):
                    sums[t] = sums.get(t, 0) + n
        yield from out(part, sums)

    return parts.repartition("part").sortWithinPartitions("part").mapInArrow(run, "part int, tokens binary, values binary, total long, kinds long")


def looked_up(parts: DataFrame, known: DataFrame) -> DataFrame:
    """block, part and the values of each part's tokens, from rows part, tokens, values; 0 for other tokens."""
    none = F.lit(None)
    both = known.select(none.cast("long").alias("block"), "part", "tokens", "values").union(parts.select("block", "part", "tokens", none.cast("binary")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, own = None, {}
        for batch in batches:
            blocks, numbers, found = [], [], []
            for b, p, tokens, values in zip(*(batch.column(c).to_pylist() for c in ("block", "part", "tokens", "values"))):
                if p != part:
                    part, own = p, {}
                if b is None:  # a part's known tokens come before its blocks
                    own.update(zip(parted(tokens), unpacked(values).tolist()))
                    continue
                blocks.append(b)
                numbers.append(p)
                found.append(packed([own.get(t, 0) for t in parted(tokens)]))
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(numbers, pa.int32()), pa.array(found, pa.binary())], ["block", "part", "values"])

    return both.repartition("part").sortWithinPartitions("part", F.col("block").asc_nulls_first()).mapInArrow(run, "block long, part int, values binary")


def summed(blocks: DataFrame, values: DataFrame, make: Callable[[dict, np.ndarray, np.ndarray, np.ndarray, np.ndarray], dict], kept: list[str], schema: str) -> DataFrame:
    """Rows of the documents again. values: block, part, values. make gets a block's kept columns, the rows, codes and counts of its pairs and the value of each code; it gives the columns of schema."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x = {name: batch.column(name)[i] for name in batch.schema.names}
                rows, codes, counts = unpack(x["n"].as_py(), *(x[k].as_py() for k in ("sizes", "codes", "counts")))
                answers = sorted(x["at"].as_py() or [], key=lambda a: a["part"])
                value = np.concatenate([np.zeros(0, np.int64), *[unpacked(a["values"]) for a in answers]])
                made = make({k: x[k].values for k in kept} | {"n": x["n"].as_py()}, rows, codes, counts, value)
                yield pa.RecordBatch.from_arrays(list(made.values()), list(made))

    joined = blocks.select("block", "n", *kept, "sizes", "codes", "counts").join(values.groupBy("block").agg(F.collect_list(F.struct("part", "values")).alias("at")), "block", "left")
    return joined.mapInArrow(run, schema)
