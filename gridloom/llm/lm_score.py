"""Language-model scores by prediction by partial matching (PPM) over bytes.

The model is a byte-context trie of depth ORDER + 1 with a count at each node, fitted to the learning documents: every
task counts its own byte strings with NumPy, Spark adds the counts up. Escape probabilities are those of PPM method C
(distinct followers over occurrences and distinct followers), with symbol exclusion: after an escape, the followers that
the longer context has shown are left out of the shorter one. A text is followed by an end symbol that UTF-8 never holds
and preceded by ORDER of them as context. Bytes that no context has shown share what is left evenly.

Every node of the trie counts, however rare. The trie is a table dealt into parts, the more the more text there is, by a
hash of the NEAR newest symbols of a context: nodes with contexts of NEAR symbols or more, and the contexts they escape to
down to that length, lie in one part. Only the nodes of shorter contexts are sent to all tasks, at most 256^NEAR of the
longest. The distinct strings of each block of documents go to the parts, get their probabilities there and come back.

Beside it stands a word-unigram base with add-one counts; see op2.

Defined cases: a null text is empty: it has one end token and one end symbol; a null doc_id counts as learning; repeated
rows are scored alike, row by row; other columns are ignored; an empty table gives an empty result. Without learning
documents every byte has the same probability.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .common import buffers, only, sliced, small_batches, texts, written
from .kernel import LOWER, mix

ORDER = 5
MOST_NODES = 1 << 22
#: Parts of the trie, at least, and blocks of texts for which so many do: twice the blocks have twice the parts.
PARTS, PART_BLOCKS = 256, 256
NEAR = 2
#: Grams in a row of the trie's table, at most.
ROW_GRAMS = 1 << 20
#: Grams that a task sorts or looks up at a time, and text bytes whose grams it makes at a time: some 100 bytes of memory for each.
ASKED, GRAM_BYTES = 1 << 18, 1 << 19
END = 0xFF
SYMBOLS = 256
U = np.uint64
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def held_out(doc_id: F.Column) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def gram_keys(data: np.ndarray, offsets: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """For each symbol of each row, its end included: the last order + 1 symbols as an integer, the newest lowest; and its row."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    at = offsets[:-1] + np.arange(n) * (order + 1)  # each row gets `order` end symbols before it and one after it
    padded = np.full(len(data) + n * (order + 1), END, np.uint8)
    rows = np.repeat(np.arange(n), size)
    padded[np.arange(len(data)) + (rows + 1) * (order + 1) - 1] = data
    key = np.zeros(len(padded) - order if n else 0, U)
    for i in range(order + 1):
        key = key << U(8) | padded[i : i + len(key)]
    start = np.repeat(at, size + 1)
    inside = np.arange(len(start)) - np.repeat(np.cumsum(size + 1) - (size + 1), size + 1)
    return key[start + inside], np.repeat(np.arange(n), size + 1)


def tally(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and how often each comes."""
    if counts is None:
        keys = np.sort(keys)
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
        return keys[first], np.diff(np.r_[first, len(keys)])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def gram_counts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """gram and n: how often each string of order + 1 symbols comes in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting = (np.zeros(0, U), np.zeros(0, np.int64)), []

        def merged():
            return tally(np.concatenate([held[0], *[k for k, _ in waiting]]), np.concatenate([held[1], *[n for _, n in waiting]]))

        def out(x):
            return pa.RecordBatch.from_arrays([pa.array(x[0].view(np.int64)), pa.array(x[1])], ["gram", "n"])

        for batch in sliced(batches, "text"):
            waiting.append(tally(gram_keys(*buffers(batch.column("text")), order)[0]))
            if sum(len(k) for k, _ in waiting) > 1 << 21:
                held, waiting = merged(), []
                if len(held[0]) > 1 << 21:
                    yield out(held)
                    held = (np.zeros(0, U), np.zeros(0, np.int64))
        yield out(merged())

    return only(docs, text="string").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


@dataclass
class Level:
    """The trie's nodes of one depth: nodes (context and symbol) with their counts, and contexts with their totals."""

    grams: np.ndarray
    counts: np.ndarray
    contexts: np.ndarray
    totals: np.ndarray
    kinds: np.ndarray
    #: Of each context: total and kinds of its suffix context, without the symbols that it has shown itself.
    left: np.ndarray = field(default=None)
    left_kinds: np.ndarray = field(default=None)


def find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys among sorted keys, and which of them are there."""
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


class Model:
    """PPM over the kept nodes; levels[k] has contexts of k symbols."""

    def __init__(self, grams: list[tuple[np.ndarray, np.ndarray]]):
        self.levels: list[Level] = []
        for k, (nodes, counts) in enumerate(grams):
            contexts, first = np.unique(nodes >> U(8), return_index=True)
            totals = np.add.reduceat(counts, first) if len(first) else counts
            level = Level(nodes, counts, contexts, totals, np.diff(np.r_[first, len(nodes)]))
            if k:
                below = self.levels[k - 1]
                at, there = find(below.grams, nodes & U((1 << 8 * k) - 1))
                excluded = np.add.reduceat(np.where(there, below.counts[at] if len(below.counts) else 0, 0), first) if len(first) else totals
                up, known = find(below.contexts, contexts & U((1 << 8 * (k - 1)) - 1))
                level.left = np.where(known, below.totals[up] - excluded, 0) if len(contexts) else totals
                level.left_kinds = np.where(known, below.kinds[up] - level.kinds, 0) if len(contexts) else totals
            self.levels.append(level)

    def log10(self, grams: np.ndarray) -> np.ndarray:
        """log10 of the probability of the newest symbol of each gram after the others."""
        out = np.zeros(len(grams))
        rest, above = np.arange(len(grams)), np.full(len(grams), -1)  # grams still without a probability; the longer context of each, where it is known
        for k in range(len(self.levels) - 1, -1, -1):
            level = self.levels[k]
            if not len(level.contexts):
                continue
            own = grams[rest] & U((1 << 8 * (k + 1)) - 1)
            context, known = find(level.contexts, own >> U(8))
            node, shown = find(level.grams, own)
            total, kinds = level.totals[context], level.kinds[context]
            if k + 1 < len(self.levels) and len(self.levels[k + 1].contexts):
                up = self.levels[k + 1]
                total = np.where(above >= 0, up.left[above], total)
                kinds = np.where(above >= 0, up.left_kinds[above], kinds)
            use = known & (kinds > 0)
            hit = use & shown
            count = np.where(hit, level.counts[node], np.maximum(kinds, 1))
            out[rest] += np.where(use, np.log10(count / np.maximum(total + kinds, 1)), 0)
            rest, above = rest[~hit], np.where(known, context, -1)[~hit]
        unseen = SYMBOLS - (int(self.levels[0].kinds[0]) if len(self.levels[0].kinds) else 0)
        out[rest] -= math.log10(max(unseen, 1))
        return out


def fitted(counts: DataFrame, order: int = ORDER, most_nodes: int = MOST_NODES) -> Model:
    """A model in one place, which keeps only nodes of at least 1 / most_nodes of all counts. op2 keeps all; see trie."""
    spark = counts.sparkSession
    held = written(counts, "grams")
    total = held.agg(F.sum("n")).first()[0] or 0
    least = max(1, -(-total // most_nodes))
    grams: list[tuple[np.ndarray, np.ndarray]] = []
    suffixes = F.array(*[F.struct(F.lit(k).alias("k"), F.col("gram").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1)).alias("gram")) for k in range(order + 1)])
    nodes = held.select(F.explode(suffixes).alias("x"), "n").groupBy("x.k", "x.gram").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    found = nodes.toArrow()
    k, gram, n = (found.column(c).to_numpy() for c in ("k", "gram", "n"))
    for i in range(order + 1):
        own = k == i
        by = np.argsort(gram[own].view(U))
        grams.append((gram[own].view(U)[by], n[own][by].astype(np.int64)))
    return Model(grams)


def parts_for(blocks: int) -> int:
    """Parts that keep what a task holds of the trie at about one size, at most one for each string of NEAR symbols."""
    parts = PARTS
    while parts * PART_BLOCKS < blocks * PARTS and parts < 1 << 8 * NEAR:
        parts *= 2
    return parts


@functools.cache
def part_table(parts: int) -> np.ndarray:
    return (mix(np.arange(1 << 8 * NEAR, dtype=U)) % U(parts)).astype(np.int64)


def part_of(grams: np.ndarray, parts: int) -> np.ndarray:
    return part_table(parts)[(grams >> U(8)) & U((1 << 8 * NEAR) - 1)]


def squeezed(values: np.ndarray) -> bytes:
    return pa.compress(values.tobytes(), "zstd", asbytes=True)


def restored(data: bytes, n: int, kind=np.int64) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, 8 * n, "zstd", asbytes=True), kind)


def stepped(grams: np.ndarray) -> bytes:
    """Sorted grams, compressed as steps from one to the next."""
    return squeezed(np.diff(grams, prepend=U(0)))


def walked(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(restored(data, n, U), dtype=U)


def text_slices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes and offsets of a block's texts, a slice at a time."""
    for batch in sliced(iter([pa.RecordBatch.from_arrays([column.view(pa.string())], ["text"])]), "text", GRAM_BYTES):
        yield buffers(batch.column("text"))


def dictionary(column: pa.Array, learns: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct grams of a block's texts, sorted, and how often its learning documents have each."""
    held, found, at = (np.zeros(0, U), np.zeros(0, np.int64)), [], 0

    def merged():
        return tally(*(np.concatenate(x) for x in zip(held, *found)))

    for data, offsets in text_slices(column):
        keys, rows = gram_keys(data, offsets, order)
        own = learns[at + rows] > 0
        at += len(offsets) - 1
        for k, weight in ((keys[own], 1), (keys[~own], 0)):
            k, n = tally(k)
            found.append((k, n.astype(np.int64) * weight))
        if sum(len(k) for k, _ in found) > max(ASKED, len(held[0])):
            held, found = merged(), []
    return merged()


def gram_parts(held: DataFrame, order: int, parts: int) -> DataFrame:
    """block, part, size, grams and counts: the distinct grams of each block by part, with their counts in learning documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                grams, counts = dictionary(batch.column("text")[i].values, batch.column("learns")[i].values.to_numpy(), order)
                part = part_of(grams, parts)
                by = np.argsort(part, kind="stable")
                grams, counts = grams[by], counts[by]
                ends = np.cumsum(np.bincount(part, minlength=parts))
                own = [(p, b - a, stepped(grams[a:b]), squeezed(counts[a:b])) for p, (a, b) in enumerate(zip(np.r_[0, ends[:-1]].tolist(), ends.tolist())) if b > a]
                p, size, g, n = zip(*own) if own else ((), (), (), ())
                yield pa.RecordBatch.from_arrays([pa.array([batch.column("block")[i].as_py()] * len(own), pa.int64()), pa.array(p, pa.int32()), pa.array(size, pa.int32()), pa.array(g, pa.binary()), pa.array(n, pa.binary())], ["block", "part", "size", "grams", "counts"])

    return held.select("block", "text", "learns").mapInArrow(run, "block long, part int, size int, grams binary, counts binary")


def trie(parts: DataFrame) -> DataFrame:
    """part, size, grams and counts: all grams of the learning documents with their counts, each in one row of its part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, waiting = None, (np.zeros(0, U), np.zeros(0, np.int64)), []

        def merged():
            return tally(np.concatenate([held[0], *[k for k, _ in waiting]]), np.concatenate([held[1], *[n for _, n in waiting]]))

        def out(x):
            for at in range(0, len(x[0]), ROW_GRAMS):
                grams, counts = x[0][at : at + ROW_GRAMS], x[1][at : at + ROW_GRAMS]
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([len(grams)], pa.int32()), pa.array([stepped(grams)], pa.binary()), pa.array([squeezed(counts)], pa.binary())], ["part", "size", "grams", "counts"])

        for batch in batches:
            for p, size, grams, counts in zip(*(batch.column(c).to_pylist() for c in ("part", "size", "grams", "counts"))):
                if p != part:
                    yield from out(merged())
                    part, held, waiting = p, (held[0][:0], held[1][:0]), []
                grams, counts = walked(grams, size), restored(counts, size)
                waiting.append((grams[counts > 0], counts[counts > 0]))
                if sum(len(k) for k, _ in waiting) > max(ASKED, len(held[0])):
                    held, waiting = merged(), []
        yield from out(merged())

    return parts.select("part", "size", "grams", "counts").repartition("part").sortWithinPartitions("part").mapInArrow(run, "part int, size int, grams binary, counts binary")


def near_levels(known: DataFrame, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Nodes and counts of the levels whose contexts have less than NEAR symbols, from the trie's table."""
    top = min(NEAR, order + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, grams, counts in zip(*(batch.column(c).to_pylist() for c in ("size", "grams", "counts"))):
                nodes, n = tally(walked(grams, size) & U((1 << 8 * top) - 1), restored(counts, size))
                yield pa.RecordBatch.from_arrays([pa.array(nodes.view(np.int64)), pa.array(n)], ["gram", "n"])

    with small_batches(known.sparkSession):
        found = known.select("size", "grams", "counts").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    grams, counts = found.column("gram").to_numpy().view(U), found.column("n").to_numpy().astype(np.int64)
    return [tally(grams & U((1 << 8 * (k + 1)) - 1), counts) for k in range(top)]


def answered(parts: DataFrame, known: DataFrame, order: int) -> DataFrame:
    """block, part and values: log10 of the probability of each gram of each block's part."""
    near = near_levels(known, order)
    none = F.lit(None)
    both = known.select(none.cast("long").alias("block"), "part", "size", "grams", "counts").union(parts.select("block", "part", "size", "grams", none.cast("binary")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shown, model, asked = None, [], None, []

        def out():
            nonlocal model
            if model is None:
                grams, counts = (np.concatenate(x) for x in zip((np.zeros(0, U), np.zeros(0, np.int64)), *shown))
                model = Model([*near, *[tally(grams & U((1 << 8 * (k + 1)) - 1), counts) for k in range(len(near), order + 1)]])
            every, at = np.unique(np.concatenate([g for _, g in asked]), return_inverse=True)
            values = np.split(model.log10(every)[at.ravel()], np.cumsum([len(g) for _, g in asked])[:-1])
            n = len(asked)
            return pa.RecordBatch.from_arrays([pa.array([b for b, _ in asked], pa.int64()), pa.array([part] * n, pa.int32()), pa.array([squeezed(v) for v in values], pa.binary())], ["block", "part", "values"])

        for batch in batches:
            held = 0
            for b, p, size, grams, counts in zip(*(batch.column(c).to_pylist() for c in ("block", "part", "size", "grams", "counts"))):
                if p != part:
                    if asked:
                        yield out()
                    part, shown, model, asked, held = p, [], None, [], 0
                if b is None:  # a part's known grams come before its blocks
                    shown.append((walked(grams, size), restored(counts, size)))
                    continue
                asked.append((b, walked(grams, size)))
                held += size
                if held > ASKED:
                    yield out()
                    asked, held = [], 0
            if asked:
                yield out()
                asked = []

    return both.repartition("part").sortWithinPartitions("part", F.col("block").asc_nulls_first()).mapInArrow(run, "block long, part int, values binary")


def scores(value: Callable[[np.ndarray], np.ndarray], data: np.ndarray, offsets: np.ndarray, order: int = ORDER) -> np.ndarray:
    """log10 probability of each row: each distinct string is looked up once, in sorted order."""
    keys, rows = gram_keys(data, offsets, order)
    if not len(keys):
        return np.zeros(len(offsets) - 1)
    by = np.argsort(keys, kind="stable") if len(offsets) > 1 << 16 or order > 5 else None
    if by is None:  # 48 bits of string and 16 of row are sorted as one integer, which is much faster
        packed = np.sort(keys << U(16) | rows.astype(U))
        keys, rows = packed >> U(16), (packed & U(0xFFFF)).astype(np.int64)
    else:
        keys, rows = keys[by], rows[by]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    each = np.repeat(value(keys[first]), np.diff(np.r_[first, len(keys)]))
    return np.bincount(rows, each, len(offsets) - 1)


def block_scores(held: DataFrame, values: DataFrame, order: int, parts: int) -> DataFrame:
    """block and score, the log10 probability of each of its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                column = batch.column("text")[i].values
                grams, _ = dictionary(column, np.zeros(len(column), np.int64), order)
                part = part_of(grams, parts)
                by = np.argsort(part, kind="stable")
                bounds = np.r_[0, np.cumsum(np.bincount(part, minlength=parts))]
                value = np.full(len(grams), np.nan)
                for x in batch.column("at")[i].as_py() or []:
                    own = by[bounds[x["part"]] : bounds[x["part"] + 1]]
                    value[own] = restored(x["values"], len(own), np.float64)
                score = [scores(lambda g: value[np.searchsorted(grams, g)], data, offsets, order) for data, offsets in text_slices(column)]
                yield pa.RecordBatch.from_arrays([batch.column("block").slice(i, 1), pa.array([np.concatenate([np.zeros(0), *score])], pa.list_(pa.float64()))], ["block", "score"])

    each = values.groupBy("block").agg(F.collect_list(F.struct("part", "values")).alias("at"))
    return held.select("block", "text").join(each, "block", "left").mapInArrow(run, "block long, score array<double>")


def scored(docs: DataFrame, learning: F.Column, order: int = ORDER, size: int = blocks.BLOCK_BYTES) -> DataFrame:
    """The base's and the model's log10 probability of every text; both learn from the rows for which `learning` holds."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(learning, F.lit(False)).cast("long").alias("learns"))

    def read(block: blocks.Block, batch: pa.RecordBatch) -> None:
        data, offsets = buffers(batch.column("text"))
        plain, lower = data.tobytes(), LOWER[data].tobytes()
        for i, doc_id in enumerate(batch.column("doc_id").to_pylist()):
            found = lower[offsets[i] : offsets[i + 1]].split()  # at the contract's white space
            block.add(np.fromiter(map(block.tokens.__getitem__, found), np.int32, len(found)), doc_id=doc_id, learns=batch.column("learns")[i].as_py(), text=plain[offsets[i] : offsets[i + 1]], n_words=len(found))

    kept = {"doc_id": "long", "learns": "long", "text": "binary", "n_words": "long"}
    held = written(blocks.build(own, read, kept, size, ("learns",)), "words")
    parts = parts_for(held.count())
    grams = gram_parts(held, order, parts)
    known = written(trie(grams), "trie")
    score = written(block_scores(held, answered(grams, known, order), order, parts), "scores")
    own_counts = held.select("n", "learns", "held", "tokens", "sizes", "codes", "counts").mapInArrow(learned, "part int, tokens binary, values binary")  # without the texts
    counts = written(blocks.gathered(own_counts), "unigrams")
    words, kinds = counts.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
    ends = own.where("learns = 1").count()
    n, v = words + ends, kinds + (ends > 0)

    def make(x: dict, rows: np.ndarray, codes: np.ndarray, freq: np.ndarray, value: np.ndarray) -> dict:
        below = math.log10(n + v + 1) if n + v + 1 else 0.0
        size = x["n_words"].to_numpy() + 1
        base = np.bincount(rows, freq * np.log10(value[codes] + 1.0), x["n"]) + math.log10(ends + 1.0) - size * below
        known = np.bincount(rows, freq * (value[codes] > 0), x["n"]).astype(np.int64) + (ends > 0)
        return {"doc_id": x["doc_id"], "held_out": pa.array(x["learns"].to_numpy() == 0), "n_tokens": pa.array(size), "n_known": pa.array(known), "train_tokens": pa.array(np.full(len(size), n)), "base_score": pa.array(base), "score": x["score"]}

    rows = blocks.summed(held.join(score, "block"), blocks.looked_up(blocks.parts(held), counts), make, ["doc_id", "learns", "score", "n_words"], SCHEMA)
    return written(rows, "scored")  # some 50 bytes a document; else the batches of blocks would have no bound


def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The parts of each block's dictionary with the counts of its learning documents."""
    for batch in batches:
        for i in range(batch.num_rows):
            rows, codes, counts = blocks.unpack(*(batch.column(k)[i].as_py() for k in ("n", "sizes", "codes", "counts")))
            sizes = batch.column("held")[i].values.to_numpy()
            ends = np.cumsum(sizes)
            learns = batch.column("learns")[i].values.to_numpy()
            n = np.bincount(codes, counts * learns[rows], ends[-1]).astype(np.int64)
            found = pa.array([blocks.packed(x) for x in np.split(n, ends[:-1])], pa.binary())
            own = pa.RecordBatch.from_arrays([pa.array(np.arange(len(ends), dtype=np.int32)), batch.column("tokens")[i].values, found], ["part", "tokens", "values"])
            yield own.filter(pa.array(sizes > 0))


def op2(docs: DataFrame) -> DataFrame:
    return scored(docs, ~held_out(F.col("doc_id")))
