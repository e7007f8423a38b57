"""Ranked search for words by branch and bound over trees of maxima.

Documents stand in blocks of BLOCK, in the order in which tasks read them. A block holds, for each term, what every document
gains from it (its impact), and a tree over ranges of documents: the largest impact within each range of SPANS documents, up
to the whole block. The sum of a query's maxima over a range bounds the score of each document there. Within a block the
search is best first: the range of the highest bound is opened into its smaller ranges, and at last into documents, until no
bound reaches the k-th score; ranges whose bound equals it are opened, since a tie may go to a smaller doc_id.

Across blocks there are two rounds. First each query opens the SEEDS blocks of its highest bounds, which gives a score that k
documents reach. Then every block is judged by its bound against that score, and searched only for queries that can still find
something in it. What leaves a block is k rows at most for each query that entered it.

Impacts need counts over the whole corpus, so blocks are written twice: term frequencies first, then the index. Queries go in
groups of bounded size, since their terms are sent to every task; the index is made for the terms of a group.

Defined cases: a null or empty text has no terms and is never found; a null doc_id comes after others of the same score;
repeated documents and repeated items are rows of their own; a null item text has no terms and finds nothing; other columns
are ignored; without items or documents the result is empty.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernel
from .blocks import deflated, inflated
from .common import buffers, only, sliced, written

K = 10
#: Documents of a block, and of the ranges in it, from the smallest.
BLOCK, SPANS = 4096, (64, 512)
SEEDS = 4
#: Queries of a group and bytes of their texts, at most.
MOST_ITEMS, MOST_BYTES = 10_000, 16 << 20
#: Fixed values of the score: thousandths of the length's share and of the saturation.
SHARE, FLAT = 90, 8
#: Bytes within terms: 0-9, A-Z, a-z and all beyond 0x7F.
APART = np.ones(256, bool)
APART[0x30:0x3A] = APART[0x41:0x5B] = APART[0x61:0x7B] = APART[0x80:] = False
U = np.uint64


def packed(values: np.ndarray, kind: str) -> bytes:
    return deflated(values.astype(kind).tobytes())


def unpacked(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(inflated(data), kind).astype(np.int64)


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased bytes, and starts, ends and row numbers of all terms."""
    return kernel.LOWER[data], *kernel.words(data, offsets, APART)


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each of the sizes, one after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes) + np.repeat(starts, sizes)


class Terms:
    """Terms that are asked for, numbered; known by hash, then compared byte by byte."""

    def __init__(self, terms: list[bytes]):
        self.data = np.frombuffer(b"".join(terms), np.uint8)
        sizes = np.array([len(t) for t in terms], np.int64)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        hashes = kernel.word_hashes(self.data, self.starts, self.ends)
        self.order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.order]

    def numbers(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the words are asked for, and the number of each of these."""
        if not len(self.hashes) or not len(starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        hashes = kernel.word_hashes(data, starts, ends)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        place = np.flatnonzero(self.hashes[at] == hashes)
        term = self.order[at[place]]
        sizes = ends[place] - starts[place]
        same = sizes == self.ends[term] - self.starts[term]
        place, term, sizes = place[same], term[same], sizes[same]
        equal = data[spread(starts[place], sizes)] == self.data[spread(self.starts[term], sizes)]
        good = np.logical_and.reduceat(equal, np.cumsum(sizes) - sizes) if len(sizes) else np.zeros(0, bool)
        return place[good], term[good]


def frequencies(docs: DataFrame, asked: list[bytes]) -> DataFrame:
    """A row for each block: block, ids, lengths (terms of each document), held and df (asked terms and in how many of its documents), and the documents, terms and frequencies of the postings, packed, by term and document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, number, ids, held, n = Terms(asked), TaskContext.get().partitionId() << 32, [], [], 0

        def out() -> pa.RecordBatch:
            sizes, rows, terms, times = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((rows, terms))
            rows, terms, times = rows[order], terms[order], times[order]
            found, df = np.unique(terms, return_counts=True)
            columns = [pa.array([number], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([found], pa.list_(pa.int64())), pa.array([df], pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays([*columns, *[pa.array([packed(x, k)], pa.binary()) for x, k in ((rows, "<u2"), (terms, "<u4"), (times, "<u4"))]], ["block", "ids", "lengths", "held", "df", "rows", "terms", "times"])

        for batch in sliced(batches, "text"):
            data, offsets = buffers(batch.column("text"))
            data, starts, ends, rows = terms_of(data, offsets)
            sizes = np.bincount(rows, minlength=batch.num_rows)
            place, term = own.numbers(data, starts, ends)
            pair, times = np.unique(rows[place] * max(1, len(asked)) + term, return_counts=True)
            row, term = pair // max(1, len(asked)), pair % max(1, len(asked))
            names = batch.column("doc_id").to_pylist()
            start = 0
            while start < batch.num_rows:
                stop = min(batch.num_rows, start + BLOCK - n)
                a, b = np.searchsorted(row, (start, stop))
                held.append((sizes[start:stop], row[a:b] - start + n, term[a:b], times[a:b]))
                ids += names[start:stop]
                n, start = n + stop - start, stop
                if n == BLOCK:
                    yield out()
                    number, ids, held, n = number + 1, [], [], 0
        if n:
            yield out()

    schema = "block long, ids array<long>, lengths array<long>, held array<long>, df array<long>, rows binary, terms binary, times binary"
    return only(docs, doc_id="long", text="string").mapInArrow(run, schema)


def weights(n: int, df: dict[int, int], terms: int) -> np.ndarray:
    """What a term weighs, in thousandths, by the documents that hold it."""
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * df.get(t, 0) + 1))) for t in range(terms)], np.int64)


def index(blocks: DataFrame, n: int, total: int, weight: np.ndarray) -> DataFrame:
    """A row for each block: block, ids, held, top (the largest impact of each held term), keys and impacts of documents, and keys and maxima of each of SPANS.

    A key is a term's place in held times the ranges of a block, plus the range; keys are sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                lengths, held = (batch.column(c)[i].values.to_numpy() for c in ("lengths", "held"))
                rows, terms, times = (unpacked(batch.column(c)[i].as_py(), k) for c, k in (("rows", "<u2"), ("terms", "<u4"), ("times", "<u4")))
                m = 100 - SHARE + SHARE * lengths * n // max(1, total)
                impact = weight[terms] * (1_000_000_000 * times // (1000 * times + FLAT * m[rows]))
                place = np.searchsorted(held, terms)
                made, top = [], np.zeros(0, np.int64)
                for span in (1, *SPANS):
                    key = place * (BLOCK // span) + rows // span
                    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
                    made += [packed(key[first], "<i8"), packed(np.maximum.reduceat(impact, first) if len(first) else impact, "<i8")]
                if len(held):
                    top = np.maximum.reduceat(impact, np.flatnonzero(np.r_[True, place[1:] != place[:-1]]))
                row = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays([row.column("block"), row.column("ids"), row.column("held"), pa.array([top], pa.list_(pa.int64())), pa.array([made], pa.list_(pa.binary()))], ["block", "ids", "held", "top", "levels"])

    return blocks.select("block", "ids", "lengths", "held", "rows", "terms", "times").mapInArrow(run, "block long, ids array<long>, held array<long>, top array<long>, levels array<binary>")


class Queries:
    """Items of a group: the numbers of each one's distinct terms, one after another."""

    def __init__(self, numbers: list[np.ndarray], terms: int):
        self.n, self.terms = len(numbers), terms
        self.flat = np.concatenate([np.zeros(0, np.int64), *numbers])
        sizes = np.array([len(x) for x in numbers], np.int64)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes

    def bounds(self, held: np.ndarray, top: np.ndarray) -> np.ndarray:
        """The most that a document of a block can score, for each item."""
        every = np.zeros(self.terms + 1, np.int64)
        every[held] = top
        sums = np.concatenate([[0], np.cumsum(every[self.flat])])
        return sums[self.ends] - sums[self.starts]

    def of(self, item: int) -> np.ndarray:
        return self.flat[self.starts[item] : self.ends[item]]


class Tree:
    """A block's terms and maxima, ready to be searched."""

    def __init__(self, ids: list, held: np.ndarray, levels: list[bytes]):
        self.ids, self.held = ids, held
        arrays = [unpacked(x, "<i8") for x in levels]
        self.levels = {span: (arrays[2 * k], arrays[2 * k + 1]) for k, span in enumerate((1, *SPANS))}

    def sums(self, place: np.ndarray, span: int, low: int, high: int) -> np.ndarray:
        """Of the terms at these places: the sums of their maxima in each of the ranges low to high - 1 of a span."""
        keys, values = self.levels[span]
        base = place * (BLOCK // span)
        a, b = np.searchsorted(keys, base + low), np.searchsorted(keys, base + high)
        at = spread(a, b - a)
        out = np.zeros(high - low, np.int64)
        np.add.at(out, keys[at] - np.repeat(base, b - a) - low, values[at])
        return out

    def search(self, terms: np.ndarray, k: int, least: int) -> list[tuple[int, bool, int]]:
        """(score, whether it has an id, -id) of the k best documents that score `least` at least, best first."""
        place = np.searchsorted(self.held, terms)
        there = place < len(self.held)
        place, terms = place[there], terms[there]
        place = place[self.held[place] == terms]
        found: list[tuple[int, bool, int]] = []
        inner = [1, *SPANS, BLOCK]
        heap = [(-math.inf, len(inner) - 1, 0)]
        while heap:
            bound, level, node = heapq.heappop(heap)
            if -bound < (max(least, found[0][0]) if len(found) == k else least):
                break
            span, below = inner[level], inner[level - 1]
            ratio = span // below
            sums = self.sums(place, below, node * ratio, (node + 1) * ratio)
            cut = max(least, found[0][0]) if len(found) == k else least
            for x in np.flatnonzero(sums >= cut).tolist():
                if below > 1:
                    heapq.heappush(heap, (-int(sums[x]), level - 1, node * ratio + x))
                    continue
                own = self.ids[node * ratio + x]
                one = (int(sums[x]), own is not None, -own if own is not None else 0)
                if len(found) < k:
                    heapq.heappush(found, one)
                elif one > found[0]:
                    heapq.heapreplace(found, one)
        return sorted(found, reverse=True)


FOUND = "item int, doc_id long, score long"


def rows_of(found: list[tuple[int, list]]) -> pa.RecordBatch:
    every = [(item, -minus if named else None, score) for item, own in found for score, named, minus in own]
    item, ids, scores = zip(*every) if every else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(ids, pa.int64()), pa.array(scores, pa.int64())], ["item", "doc_id", "score"])


def seeds(blocks: DataFrame, queries: Queries, k: int) -> DataFrame:
    """item, block: the k blocks of the highest bounds of each item; a task gives k of its own for each item at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds, numbers = np.zeros((0, queries.n), np.int64), np.zeros(0, np.int64)
        for batch in batches:
            own = [queries.bounds(batch.column("held")[i].values.to_numpy(), batch.column("top")[i].values.to_numpy()) for i in range(batch.num_rows)]
            bounds = np.concatenate([bounds, *[x[None] for x in own]])
            numbers = np.concatenate([numbers, batch.column("block").to_numpy()])
            # The k best of each item stay: a column each, with its block's number.
            if numbers.ndim == 1:
                numbers = np.broadcast_to(numbers[:, None], bounds.shape)
            order = np.argsort(-bounds, axis=0, kind="stable")[:k]
            bounds, numbers = np.take_along_axis(bounds, order, 0), np.take_along_axis(numbers, order, 0)
            for r in range(len(bounds)):
                some = np.flatnonzero(bounds[r] > 0)
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(numbers[r][some]), pa.array(bounds[r][some])], ["item", "block", "bound"])
            bounds, numbers = np.zeros((0, queries.n), np.int64), np.zeros(0, np.int64)

    each = blocks.select("block", "held", "top").mapInArrow(run, "item int, block long, bound long")
    order = Window.partitionBy("item").orderBy(F.desc("bound"), "block")
    return each.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).select("item", "block")


def opened(blocks: DataFrame, queries: Queries, k: int, least: np.ndarray) -> DataFrame:
    """item, doc_id, score: the k best of each block for each item whose bound there reaches what it must at least score.

    blocks: of an index, with a column items where only these are to be searched for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                held, top = (batch.column(c)[i].values.to_numpy() for c in ("held", "top"))
                items = np.flatnonzero(queries.bounds(held, top) >= least)
                if "items" in batch.schema.names:
                    items = np.intersect1d(items, batch.column("items")[i].values.to_numpy())
                if len(items):
                    tree = Tree(batch.column("ids")[i].as_py(), held, batch.column("levels")[i].as_py())
                    yield rows_of([(x, tree.search(queries.of(x), k, int(least[x]))) for x in items.tolist()])

    return blocks.mapInArrow(run, FOUND)


def first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def searched(docs: DataFrame, items: DataFrame, k: int = K, most: int = MOST_ITEMS) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item with a score over 0."""
    own = written(only(items, item_id="long", text="string"), "items")
    n_items, size = own.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    groups = max(1, -(-n_items // most), -(-size // MOST_BYTES))
    out = None
    for g in range(groups):
        part = own.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == g) if groups > 1 else own
        now = _group(docs, part.collect(), k)
        out = now if out is None else out.unionByName(now)
    return out


def _group(docs: DataFrame, items: list, k: int) -> DataFrame:
    """searched() for the items of a group, whose number and size are bounded."""
    data, offsets = buffers(pa.array([r["text"] for r in items], pa.string()))
    data, starts, ends, rows = terms_of(data, offsets)
    raw = data.tobytes()
    words = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
    asked = sorted({*words})
    number = {t: i for i, t in enumerate(asked)}
    each = np.array([number[w] for w in words], np.int64)
    queries = Queries([np.unique(each[rows == i]) for i in range(len(items))], len(asked))
    counted = written(frequencies(docs, asked), "frequencies")
    n, total = counted.select(F.explode("lengths").alias("n")).agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    pairs = counted.select(F.inline(F.arrays_zip("held", "df"))).groupBy("held").agg(F.sum("df").alias("df"))
    made = written(index(counted, n, total, weights(n, {r["held"]: r["df"] for r in pairs.collect()}, len(asked))), "index")
    # A score of 1 is the least that counts, until SEEDS blocks have been opened.
    least = np.ones(len(items), np.int64)
    start = seeds(made, queries, SEEDS).groupBy("block").agg(F.collect_list("item").alias("items"))
    best = first(opened(made.join(F.broadcast(start), "block"), queries, k, least), k)  # SEEDS rows for each item at most
    for r in best.where(F.col("rank") == k).select("item", "score").collect():
        least[r["item"]] = r["score"]
    found = first(opened(made, queries, k, least), k)
    names = docs.sparkSession.createDataFrame([(i, r["item_id"]) for i, r in enumerate(items)], "item int, item_id long")
    return found.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op13(docs: DataFrame, items: DataFrame) -> DataFrame:
    return searched(docs, items)
