"""Repeated passages by MinHash over paragraphs.

Line breaks do not show where a passage was pasted, so paragraphs are content-defined: WORDS words from each anchor, and from
the start and up to the end of each text. Anchors are chosen by winnowing: of any CHOICE places in a row at which a paragraph
may start, the one whose pair of words has the least hash is one. They depend on nothing else, so whatever passage of
WORDS + CHOICE - 1 = 34 words two texts have in common, they have a paragraph in common. Every paragraph gets bands of ROWS
MinHash values over its 5-word shingles and nothing else, as many as paragraphs of Jaccard similarity 0.8 need to collide with
probability `recall`. Colliding paragraphs are compared exactly (see linking) and clustered by connected components. The first
paragraph of a cluster, by document, stays; the others are removals. Each removal is extended to both sides as long as its
words agree with those beside the first paragraph, so it reaches to the ends of the passage or to an edit. Paragraphs of a
document that overlap are put together into spans.

Texts stay in blocks, and which of their paragraphs collide is found by meeting, without a row for each. Equal paragraphs are
one node, and one of them speaks for all, so a passage in a third of all documents costs one comparison. (The one is chosen
by 16 bits of the node within a band: two other paragraphs that collide and agree in these are not compared in this band.)
The shingle sets of colliding nodes meet packed, too. Buckets of TOGETHER nodes at most are compared in place, exactly but for
the width of a shingle's hash (24 bits); only links that join components go on. Nodes of larger buckets go through linking.
Rows of paragraphs are made for those nodes only that come again or are linked.

Defined cases: a null or empty text has no paragraph; a text of 5 to WORDS - 1 words is one paragraph; a null doc_id comes
back as null; repeated rows count as one document, and repeats within a document only are none; other columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import meeting
from .blocks import deflated, inflated
from .common import buffers, discarded, given_back, sliced, texts, written
from .jaccard_join import keyed
from .kernel import BASE, INVERSE, LOWER, U, mix, powers, row_bounds, shingles, word_hashes, words
from .linking import components, few, having, linked, portions, shared

WORDS, CHOICE, SHINGLE = 15, 20, 5
#: MinHash values in a band; bits of a node that tell equal paragraphs in a bucket; nodes of a bucket that are compared in place.
ROWS, PRINT, TOGETHER = 1, 16, 128
BLOCK_BYTES = 8 << 20
#: Shingles of a paragraph, at most; entries with sets that a task holds.
MOST, SETS = WORDS - SHINGLE + 1, 1 << 18
#: Words by which two linked paragraphs may be shifted against each other: |shift| <= 1 at 0.8, and some for edits.
SHIFTS = (0, 1, -1, 2, -2, 3, -3, 4, -4)
#: Documents that a copy of a first document's text serves.
SHARE = 200
RECALL = 0.95


def tuned(similarity: float, recall: float, rows: int = 1) -> int:
    """The least number of bands of so many rows whose collision probability at the similarity reaches the recall."""
    bands = 1
    while 1 - (1 - similarity**rows) ** bands < recall:
        bands += 1
    return bands


def least_near(values: np.ndarray, size: int) -> np.ndarray:
    """The least of values[i : i + size] for each i that has so many."""
    out, have = values, 1
    while have * 2 <= size:
        out, have = np.minimum(out[:-have], out[have:]), have * 2
    rest = size - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def winnowed(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Places of the least pair of words of any CHOICE places in a row of a text, each followed by WORDS words of it."""
    n = len(hashes) - (WORDS + CHOICE - 2)
    if n <= 0:
        return np.zeros(0, np.int64)
    key = shingles(mix(hashes ^ U(0xA0761D6478BD642F)), 2)[: n + CHOICE - 1]
    least = np.where(rows[:n] == rows[-n:], least_near(key, CHOICE), U(0))
    # The largest of the windows' least values at each place: only a place that is the least of some window reaches it.
    none = np.full(CHOICE - 1, U(2**64 - 1))
    most = ~least_near(np.concatenate([none, ~least, none]), CHOICE)
    return np.flatnonzero(key == most)


class Paragraphs:
    """All paragraphs of a slice: row, first word, number of words, node (hash of the words) and the hashes to band."""

    def __init__(self, batch: pa.RecordBatch):
        data, offsets = buffers(batch.column("text"))
        starts, ends, rows = words(data, offsets)
        self.hashes = h = word_hashes(LOWER[data], starts, ends)
        n = len(h)
        bounds = row_bounds(rows, batch.num_rows)
        first, last = bounds[:-1], bounds[1:]
        size = last - first
        anchors = winnowed(h, rows)
        long_ = size >= WORDS
        whole = ~long_ & (size >= SHINGLE)
        at = np.concatenate([anchors, first[long_], last[long_] - WORDS])
        at = np.unique(at)
        self.first = np.concatenate([at, first[whole]])
        self.size = np.concatenate([np.full(len(at), WORDS), size[whole]])
        order = np.argsort(self.first, kind="stable")
        self.first, self.size = self.first[order], self.size[order]
        self.row = rows[self.first] if n else self.first
        self.at = self.first - first[self.row]
        sums = np.zeros(n + 1, U)
        np.cumsum(mix(h) * powers(BASE, n), out=sums[1:])
        self.node = mix((sums[self.first + self.size] - sums[self.first]) * (powers(INVERSE, n)[self.first] if n else U(1)) + self.size.astype(U)) if n else h
        plain = np.cumsum(np.concatenate([[0], (data & 0xC0) != 0x80]))  # code points before each byte
        base = plain[offsets[self.row]] if n else self.first
        self.start = plain[starts[self.first]] - base if n else self.first
        self.end = plain[ends[self.first + self.size - 1]] - base if n else self.first

    def band(self, number: int) -> np.ndarray:
        """The band's hash of each paragraph: ROWS least shingle hashes, each under a permutation of its own."""
        out = np.full(len(self.first), U(number + 1))
        usual = self.size == WORDS
        short = np.flatnonzero(~usual)
        for k in range(number * ROWS, (number + 1) * ROWS):
            every = mix(shingles(self.hashes, SHINGLE) ^ mix(np.array([k + 1], U)))
            least = np.zeros(len(out), U)
            if usual.any():
                least[usual] = least_near(every, WORDS - SHINGLE + 1)[self.first[usual]]
            for i in short:
                least[i] = every[self.first[i] : self.first[i] + self.size[i] - SHINGLE + 1].min()
            out = mix(out * U(3) + least)
        return out


    def shingle_sets(self, chosen: np.ndarray) -> np.ndarray:
        """The distinct shingles of some paragraphs, 24 bits each and not 0, a row of MOST for each paragraph, 0 where there are fewer."""
        every = np.maximum((shingles(self.hashes, SHINGLE) >> U(40)).astype(np.uint32), np.uint32(1))
        size = self.size[chosen] - SHINGLE + 1
        place = np.minimum(self.first[chosen][:, None] + np.arange(MOST), max(len(every) - 1, 0))
        own = np.where(np.arange(MOST) < size[:, None], every[place], np.uint32(0)) if len(chosen) else np.zeros((0, MOST), np.uint32)
        own.sort(1)
        own[:, 1:][own[:, 1:] == own[:, :-1]] = 0
        return own


def indexed(docs: DataFrame, bands: int) -> DataFrame:
    """Blocks: doc_id, key and text of each document, texts compressed in one piece, and the bands of their distinct paragraphs as meeting keeps them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, size = TaskContext.get().partitionId() << 32, 0
        held, nodes, keys = [], [], []

        def block():
            node, first = np.unique(np.concatenate(nodes), return_index=True)
            bands_ = np.concatenate(keys, 1)[:, first]
            every = (bands_ >> U(PRINT) << U(PRINT)) | (node & U((1 << PRINT) - 1))
            whole = pa.concat_batches(held)
            column = texts(whole.column("text"))
            raw = [deflated(b"".join(t.encode() for t in column.slice(a, 256).to_pylist())) for a in range(0, len(column), 256)]
            values = [[number], [whole.column("doc_id").to_pylist()], [whole.column("key").to_pylist()], [pc.binary_length(column).to_pylist()], [raw], *[[e] for e in meeting.kept(every.ravel(), np.tile(first, bands), 0)]]
            kinds = [pa.int64(), *[pa.list_(pa.int64())] * 3, pa.list_(pa.binary()), pa.int32(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds)], ["block", "doc_id", "key", "size", "text", "entries", "keys", "units"])

        for batch in sliced(batches, "text"):
            x = Paragraphs(batch)
            nodes.append(x.node)
            keys.append(np.stack([x.band(i) for i in range(bands)]))
            held.append(batch)
            size += batch.nbytes
            if size >= BLOCK_BYTES:
                yield block()
                number, size, held, nodes, keys = number + 1, 0, [], [], []
        if held:
            yield block()

    return keyed(docs).mapInArrow(run, "block long, doc_id array<long>, key array<long>, size array<long>, text array<binary>, entries int, keys binary, units binary")


PLACE = "key long, nameless boolean, start int, end int, at int, n_words int, node long"


def block_slices(x: dict) -> Iterator[tuple[int, int, Paragraphs]]:
    """Of a block's texts, a slice at a time: the documents and the paragraphs before it, and its paragraphs."""
    size = x["size"].values
    raw = b"".join(inflated(v) for v in x["text"].as_py())
    column = pa.StringArray.from_buffers(len(size), pa.py_buffer(np.r_[0, np.cumsum(size.to_numpy())].astype(np.int32)), pa.py_buffer(raw))
    docs = base = 0
    for part in sliced(iter([pa.RecordBatch.from_arrays([column], ["text"])]), "text"):
        p = Paragraphs(part)
        yield docs, base, p
        docs, base = docs + part.num_rows, base + len(p.node)


def told(x: dict) -> tuple[np.ndarray, np.ndarray]:
    """The units of a block that have an answer, sorted, and the answers; see meeting.shared_units."""
    met = x["met"].as_py() or []
    units, buckets = (np.concatenate([np.zeros(0, U), *[meeting.restored(m[c], m["n"]) for m in met]]) for c in ("units", "buckets"))
    order = np.argsort(units, kind="stable")
    return units[order].astype(np.int64), buckets[order]


def over_blocks(joined: DataFrame, block: Callable[[dict], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield from block({c: batch.column(c)[k] for c in batch.schema.names})
        given_back()

    return joined.mapInArrow(run, schema)


def colliding_sets(held: DataFrame, answers: DataFrame) -> DataFrame:
    """part, block, entries, keys, nodes and sets: of each block the entries that speak for a bucket with other nodes, with their sets, by part of the bucket."""
    parts = meeting.parts_for(held, "entries", 4 * SETS)
    edges = np.arange(1, parts, dtype=U) << U(64 - PRINT - (parts.bit_length() - 1))

    def block(x: dict) -> Iterator[pa.RecordBatch]:
        units, answer = told(x)
        found = []
        for _, base, p in block_slices(x):
            lo, hi = np.searchsorted(units, [base, base + len(p.node)])
            bucket = answer[lo:hi] // U(2)
            at = units[lo:hi][bucket > 0] - base
            found.append((bucket[bucket > 0], p.node[at], p.shingle_sets(at)))
        bucket, nodes, sets = (np.concatenate(v) for v in zip(*found)) if found else (np.zeros(0, U),) * 3
        order = np.argsort(bucket, kind="stable")
        bucket, nodes, sets = bucket[order], nodes[order], sets[order]
        bounds = np.r_[0, np.searchsorted(bucket, edges), len(bucket)]
        out = [(i, b - a, meeting.planes(np.diff(bucket[a:b], prepend=U(0))), meeting.planes(nodes[a:b]), meeting.planes(sets[a:b].ravel())) for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())) if b > a]
        if out:
            part, *rest = zip(*out)
            columns = [pa.array(part, pa.int32()), pa.array([x["block"].as_py()] * len(out), pa.int64()), *[pa.array(v, t) for v, t in zip(rest, (pa.int32(), pa.binary(), pa.binary(), pa.binary()))]]
            yield pa.RecordBatch.from_arrays(columns, ["part", "block", "entries", "keys", "nodes", "sets"])

    return over_blocks(held.select("block", "size", "text").join(answers, "block"), block, "part int, block long, entries int, keys binary, nodes binary, sets binary")


def places(held: DataFrame, answers: DataFrame, linked_: DataFrame) -> DataFrame:
    """PLACE: a row for each paragraph whose node comes again, in another block or another document of its own, or is linked. linked_: block and nodes, packed."""

    def block(x: dict) -> Iterator[pa.RecordBatch]:
        units, answer = told(x)
        slices = list(block_slices(x))
        doc_id, key = (x[c].values for c in ("doc_id", "key"))
        rows = np.concatenate([np.zeros(0, np.int64), *[p.row + docs for docs, _, p in slices]])
        node = np.concatenate([np.zeros(0, U), *[p.node for _, _, p in slices]])
        own, of = np.unique(node, return_inverse=True)
        least, most = np.full(len(own), len(key)), np.full(len(own), -1)
        np.minimum.at(least, of, rows)
        np.maximum.at(most, of, rows)
        wanted = least < most
        wanted[of[units[answer % U(2) == 1]]] = True
        for v in x["linked"].as_py() or []:
            wanted |= np.isin(own, np.frombuffer(v, U))
        for docs, base, p in slices:
            chosen = np.flatnonzero(wanted[of[base : base + len(p.node)]])
            doc = pa.array(p.row[chosen] + docs)
            columns = [key.take(doc), pc.and_(key.take(doc).is_valid(), doc_id.take(doc).is_null()), *[pa.array(v[chosen].astype(np.int32)) for v in (p.start, p.end, p.at, p.size)], pa.array(p.node[chosen].view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in PLACE.split(", ")])

    lists = linked_.groupBy("block").agg(F.collect_list("nodes").alias("linked"))
    joined = held.select("block", "doc_id", "key", "size", "text").join(answers, "block", "left").join(lists, "block", "left")
    return over_blocks(joined, block, PLACE)


def linked_pairs(sets: np.ndarray, a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which pairs of rows of sets are linked."""
    sizes = np.count_nonzero(sets, 1)
    out = np.zeros(len(a), bool)
    for i in range(0, len(a), 1 << 15):
        x, y = sets[a[i : i + (1 << 15)]], sets[b[i : i + (1 << 15)]]
        both = np.zeros(len(x), np.int64)
        for k in range(MOST):
            both += (x[:, k] != 0) & (y == x[:, k : k + 1]).any(1)
        out[i : i + len(x)] = den * both >= num * (sizes[a[i : i + len(x)]] + sizes[b[i : i + len(x)]] - both)
    return out


def smallest_reached(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest number that each of n reaches over links a, b."""
    label = np.arange(n)
    while True:
        before = label.copy()
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        label = label[label]
        if np.array_equal(label, before):
            return label


LINKS = "a long, b long, block long, nodes binary, bucket long, items binary"


def links_in_place(met: DataFrame, num: int, den: int) -> DataFrame:
    """LINKS, of three kinds: a and b, links that join all linked nodes of a part's buckets; block and nodes, the linked ones of a block, packed; bucket, a (a node), block and items (its set) of buckets with more than TOGETHER nodes."""
    names_ = [c.split()[0] for c in LINKS.split(", ")]
    kinds = {"a": pa.int64(), "b": pa.int64(), "block": pa.int64(), "nodes": pa.binary(), "bucket": pa.int64(), "items": pa.binary()}

    def made(**columns) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in kinds.items()], names_)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []

        def found():
            bucket, node, sets, block = (np.concatenate(v) for v in zip(*held))
            order = np.argsort(bucket, kind="stable")
            bucket, node, sets, block = bucket[order], node[order], sets[order], block[order]
            _, times = meeting.runs(bucket)
            large = np.repeat(times > TOGETHER, times)
            for i in range(0, np.count_nonzero(large), 4096):
                at = np.flatnonzero(large)[i : i + 4096]
                yield made(a=node[at].view(np.int64), block=block[at], bucket=bucket[at].view(np.int64), items=[v[v > 0].astype(U).tobytes() for v in sets[at]])
            bucket, node, sets, block = bucket[~large], node[~large], sets[~large], block[~large]
            if not len(bucket):
                return
            _, times = meeting.runs(bucket)
            left = np.repeat(np.cumsum(times), times) - np.arange(len(bucket)) - 1  # members of the bucket after each
            a = np.repeat(np.arange(len(bucket)), left)
            b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(left) - left, left)
            names, first, of = np.unique(node, return_index=True, return_inverse=True)
            apart = of[a] != of[b]
            a, b = a[apart], b[apart]
            good = linked_pairs(sets, a, b, num, den)
            a, b = of[a[good]], of[b[good]]
            label = smallest_reached(len(names), a, b)
            moved = np.flatnonzero(label != np.arange(len(names)))
            yield made(a=names[moved].view(np.int64), b=names[label[moved]].view(np.int64))
            joined = np.unique(np.concatenate([a, b]))
            where = block[first[joined]]
            order = np.argsort(where, kind="stable")
            joined, where = joined[order], where[order]
            start, size = meeting.runs(where) if len(where) else (where, where)
            yield made(block=where[start], nodes=[names[joined[i : i + n]].tobytes() for i, n in zip(start.tolist(), size.tolist())])

        for batch in batches:
            for p, block, n, keys, nodes, sets in zip(*(batch.column(c).to_pylist() for c in ("part", "block", "entries", "keys", "nodes", "sets"))):
                if p != part:
                    if held:
                        yield from found()
                    part, held = p, []
                held.append((np.cumsum(meeting.restored(keys, n), dtype=U), meeting.restored(nodes, n), meeting.restored(sets, n * MOST).astype(np.uint32).reshape(n, MOST), np.full(n, block)))
        if held:
            yield from found()
        held = []
        given_back()

    return met.repartition("part").sortWithinPartitions("part").mapInArrow(run, LINKS)


def clustered(docs: DataFrame, num: int = 80, den: int = 100, recall: float = RECALL) -> DataFrame:
    """doc_id, key, start, end, at, n_words, cluster of each paragraph that another document repeats, and removed: not in the first document of its cluster."""
    bands = tuned(num / den, recall, ROWS)
    held = written(indexed(docs, bands), "paragraphs")
    answers = written(meeting.shared_units(held, PRINT).groupBy("block").agg(F.collect_list(F.struct(F.col("n"), "units", "buckets")).alias("met")), "answers")
    links = written(links_in_place(colliding_sets(held, answers), num, den), "links")
    edges = links.where("b is not null").select("a", "b")
    found = links.where("nodes is not null").select("block", "nodes")
    large = links.where("bucket is not null").select("bucket", F.col("a").alias("node"), "block", "items")
    members = shared(large.select("bucket", "node").distinct())
    if not members.isEmpty():
        sets = lambda nodes: having(large.select("node", "items"), written(nodes.distinct(), "nodes"), "node").dropDuplicates(["node"])
        more = written(linked(members, sets, lambda found: [np.frombuffer(x, U) for x in found], num, den), "large")
        edges = edges.union(more.select(F.col("node").alias("a"), F.col("component").alias("b")))
        there = large.select("node", "block").distinct().join(more.select("node"), "node")
        found = found.union(in_bytes(there))
    labels = components(edges)
    met = written(places(held, answers, found), "places")
    discarded(held, answers, links)  # texts and index entries; all that follows stands on places and on labels, which is written
    # Clusters are settled on nodes; the paragraphs move once, if the nodes of real clusters are too many to broadcast.
    nodes = met.groupBy("node").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).join(labels, "node", "left").withColumn("cluster", F.coalesce("component", "node"))
    nodes = written(nodes.select("node", "cluster", "lo", "hi"), "nodes")
    several = written(nodes.groupBy("cluster").agg(F.min("lo").alias("first_key"), F.max("hi").alias("last_key")).where("first_key <> last_key").select("cluster", "first_key"), "clusters")
    named = written(nodes.select("node", "cluster").join(few(several), "cluster"), "named")
    out = met.join(few(named), "node")
    return out.select(F.when(~F.col("nameless"), F.col("key")).alias("doc_id"), "key", "start", "end", "at", "n_words", "cluster", (F.col("key") != F.col("first_key")).alias("removed"))


def in_bytes(rows: DataFrame) -> DataFrame:
    """block and nodes, as little-endian bytes, of rows block and node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array([v.tobytes() for v in batch.column("node").to_numpy(zero_copy_only=False).astype("<i8")], pa.binary())], ["block", "nodes"])

    return rows.select("block", "node").mapInArrow(run, "block long, nodes binary")


def agreeing(sums: np.ndarray, inverse: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
    """How many words from a on (back: before a) agree with those from b on, at most `most`, by hashes of ranges."""
    lo, hi = np.zeros(len(a), np.int64), np.maximum(most, 0)
    while (lo < hi).any():
        mid = (lo + hi + 1) // 2
        x, y = (a - mid, b - mid) if back else (a, b)
        same = (sums[x + mid] - sums[x]) * inverse[x] == (sums[y + mid] - sums[y]) * inverse[y]
        lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
    return lo


def reached(sums, inverse, a, b, a_most, b_most, a_inside, b_inside, back: bool) -> tuple[np.ndarray, np.ndarray]:
    """By how many words paragraphs with edges at a extend beside those at b, and the edge of b then.

    most: words on the outer side; inside: on the inner side. Where the words inside the edges disagree, shifts that make a shingle of them agree are tried."""
    sign = -1 if back else 1
    gain, edge = np.zeros(len(a), np.int64), b.copy()
    open_ = np.arange(len(a))
    for d in SHIFTS:
        x, y = a[open_], b[open_] + sign * d
        fits = (b_inside[open_] + d >= 0) & (b_most[open_] - d >= 0)
        y = np.where(fits, y, b[open_])
        shown = agreeing(sums, inverse, x, y, np.minimum(SHINGLE, np.minimum(a_inside[open_], b_inside[open_] + np.where(fits, d, 0))), not back) == SHINGLE
        more = agreeing(sums, inverse, x, y, np.minimum(a_most[open_], b_most[open_] - np.where(fits, d, 0)), back)
        better = fits & (shown | (d == 0)) & (more > gain[open_])
        gain[open_[better]], edge[open_[better]] = more[better], (y + sign * more)[better]
        open_ = open_[~(fits & shown)] if d == 0 else open_
    return gain, edge


def compressed(rows: DataFrame) -> DataFrame:
    """key and text, the text compressed: what moves twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([deflated(t.encode()) for t in texts(batch.column("text")).to_pylist()], pa.binary())], ["key", "text"])

    return rows.mapInArrow(run, "key long, text binary")


def restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches whose text is compressed, with the text as it was, a portion at a time."""
    for whole in batches:
        for part in portions(whole, "text"):
            at = part.schema.get_field_index("text")
            yield part.set_column(at, "text", pa.array([inflated(t).decode() for t in part.column("text").to_pylist()], pa.string()))


MARK = ("start", "end", "at", "n_words", "cluster", "first_start", "first_at", "first_words")


def extended(docs: DataFrame, found: DataFrame) -> DataFrame:
    """found, each row a paragraph, and rows that are none: for every removed paragraph, and for the first one that it repeats, what reaches as far as the words beside them agree.

    The text of a first document travels to the documents that repeat it, a copy for every SHARE of them."""
    found = written(found, "found")
    first = found.where("not removed").groupBy("cluster").agg(F.min(F.struct("key", "start", "at", "n_words")).alias("o"))
    # Start, at and n_words as one long: what may be broadcast is three longs a row. Paragraphs have less than 64 words.
    place = F.col("o.start").cast("long") * (1 << 33) + F.col("o.at").cast("long") * 64 + F.col("o.n_words")
    first = written(first.select("cluster", F.col("o.key").alias("first_key"), place.alias("place")), "firsts")
    told_ = [F.shiftrightunsigned("place", 33).cast("int").alias("first_start"), F.shiftright("place", 6).bitwiseAND(F.lit((1 << 27) - 1)).cast("int").alias("first_at"), F.col("place").bitwiseAND(F.lit(63)).cast("int").alias("first_words")]
    names = found.where("removed").join(few(first), "cluster").select("doc_id", "key", "first_key", "start", "end", "at", "n_words", "cluster", *told_)
    pairs = written(names.groupBy("first_key", "key").agg(F.first("doc_id").alias("doc_id"), F.collect_set(F.struct(*MARK)).alias("marks")), "pairs")
    copies = written(pairs.groupBy("first_key").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("copies")), "copies")

    def stored(keys: DataFrame) -> DataFrame:
        """key and compressed text of the documents asked for, dealt by key once, for what is distinct and for joins."""
        return compressed(having(keyed(docs).select("key", "text").where("key is not null"), keys, "key")).repartition("key").distinct()

    dealt = pairs.join(copies, "first_key").withColumn("copy", F.pmod(F.xxhash64("key"), "copies").cast("int")).drop("copies")
    own = dealt.join(stored(pairs.select("key")), "key").select("first_key", "copy", "key", "doc_id", "text", "marks")
    kind = own.schema["marks"].dataType
    lead = stored(copies.select(F.col("first_key").alias("key"))).join(copies.withColumnRenamed("first_key", "key"), "key")
    lead = lead.select(F.col("key").alias("first_key"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.lit(None).cast("long").alias("key"), F.lit(None).cast("long").alias("doc_id"), "text", F.lit(None).cast(kind).alias("marks"))
    both = lead.union(own).repartition("first_key", "copy").sortWithinPartitions("first_key", "copy", F.col("key").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_key = pa.array([None], pa.string()), None
        for batch in sliced(restored(batches), "text"):
            column = pa.concat_arrays([held, batch.column("text")])
            is_first = np.r_[True, batch.column("key").is_null().to_numpy(zero_copy_only=False)]
            firsts = [held_key, *batch.column("first_key").to_pylist()]
            origin = np.maximum.accumulate(np.where(is_first, np.arange(len(is_first)), 0))
            held, held_key = column.slice(int(origin[-1]), 1), firsts[origin[-1]]
            data, offsets = buffers(column)
            starts, ends, rows = words(data, offsets)
            n = len(starts)
            sums = np.zeros(n + 1, U)
            np.cumsum(mix(word_hashes(LOWER[data], starts, ends)) * powers(BASE, n), out=sums[1:])
            inverse, bounds = powers(INVERSE, n + 1), row_bounds(rows, len(column))
            plain = np.cumsum(np.concatenate([[0], (data & 0xC0) != 0x80]))
            marks = batch.column("marks")
            row = 1 + np.repeat(np.arange(batch.num_rows), marks.value_lengths().fill_null(0).to_numpy())
            flat = marks.flatten()
            x = {k: flat.field(k).to_numpy().astype(np.int64) for k in MARK}
            lead = origin[row]
            a, b = bounds[row] + x["at"], bounds[lead] + x["first_at"]
            ea, eb = a + x["n_words"], b + x["first_words"]
            good = (ea <= bounds[row + 1]) & (eb <= bounds[lead + 1])
            # Of rows that share a doc_id, only those whose text has the paragraph there.
            good[good] &= (plain[starts[a[good]]] - plain[offsets[row[good]]] == x["start"][good]) & (plain[starts[b[good]]] - plain[offsets[lead[good]]] == x["first_start"][good])
            good = np.flatnonzero(good)
            row, lead, a, b, ea, eb = (v[good] for v in (row, lead, a, b, ea, eb))
            left, fa = reached(sums, inverse, a, b, a - bounds[row], b - bounds[lead], ea - a, eb - b, True)
            right, fb = reached(sums, inverse, ea, eb, bounds[row + 1] - ea, bounds[lead + 1] - eb, ea - a, eb - b, False)
            out = [batch.column("doc_id").take(pa.array(row - 1)), batch.column("key").take(pa.array(row - 1)), batch.column("first_key").take(pa.array(row - 1))]
            base, lead_base = plain[offsets[row]], plain[offsets[lead]]
            if len(good):
                places = [plain[starts[a - left]] - base, plain[ends[ea + right - 1]] - base, plain[starts[np.minimum(fa, b)]] - lead_base, plain[ends[np.maximum(fb, eb) - 1]] - lead_base]
                out += [pa.array(v.astype(np.int32)) for v in (x["start"][good], *places)]
                yield pa.RecordBatch.from_arrays([*out, pa.array(x["cluster"][good])], ["doc_id", "key", "first_key", "was", "start", "end", "first_from", "first_to", "cluster"])
        given_back()

    more = written(both.mapInArrow(run, "doc_id long, key long, first_key long, was int, start int, end int, first_from int, first_to int, cluster long"), "extended")
    wide = more.select("doc_id", "key", "start", "end", "cluster", F.lit(True).alias("removed"))
    kept = more.groupBy("cluster", "first_key").agg(F.min("first_from").alias("start"), F.max("first_to").alias("end"))
    kept = kept.select(F.lit(None).cast("long").alias("doc_id"), F.col("first_key").alias("key"), "start", "end", "cluster", F.lit(False).alias("removed"))
    return found.select(*wide.columns, F.lit(True).alias("paragraph")).unionByName(wide.unionByName(kept).withColumn("paragraph", F.lit(False)))


def spans(found: DataFrame) -> DataFrame:
    """Spans of a document whose rows overlap and are alike kept or removed: doc_id, start, end, n_paragraphs, the first cluster, removed. Rows that come twice, from repeated documents, count once."""
    by = Window.partitionBy("key", "removed").orderBy("start", "end", "cluster", "paragraph")
    before = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    same = F.lag(F.struct("start", "end", "cluster", "paragraph")).over(by)
    marked = found.withColumns({"new": F.coalesce(F.col("start") > before, F.lit(True)).cast("int"), "counts": F.col("paragraph") & ~F.coalesce(same == F.struct("start", "end", "cluster", "paragraph"), F.lit(False))})
    numbered = marked.withColumn("span", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    out = numbered.groupBy("key", "removed", "span").agg(F.min("doc_id").alias("doc_id"), F.min("start").alias("start"), F.max("end").alias("end"), F.count_if("counts").alias("n_paragraphs"), F.min("cluster").alias("cluster"))
    return out.select("doc_id", "start", "end", "n_paragraphs", "cluster", "removed")


def op9(docs: DataFrame) -> DataFrame:
    return spans(extended(docs, clustered(docs)))
