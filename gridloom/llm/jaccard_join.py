"""Exact Jaccard join of documents on word shingles by universe partition and pigeonhole.

Sizes are dealt into bands. Within a band's scheme two linked sets differ in at most H values, whatever their sizes. The
universe of hashed shingles is dealt into segments, each with an allowance (0: equal; 1: equal up to one value). A segment
with allowance 0 is indexed by its values' hash, one with allowance 1 also by its one-deletion neighbours. How many segments
get allowance 1 is chosen for each band by cost: index entries against the false partners that short segments bring.

A segment beyond its allowance takes 1 (allowance 0) or 2 (allowance 1) of the differences at least, so two linked sets
agree in many segments: `good` of them, for the differences that their own sizes allow. An empty segment of allowance 0 is
no entry; so a set shares at least `need` = good - (its empty ones) entries with whatever set it is linked to. Where that is
less than 1, which is rare, empty ones are entries too. Since at least `need` entries are shared, each set leaves out
need - 1 of those whose keys come most often in the corpus: the rarest common entry of two linked sets is left out by neither.

Candidates are first compared by sketches of two bytes a segment, which tell how many values must differ at least; only
those that may be linked, and those that a third set could hide (see linking), are compared on their whole sets. Texts move
compressed, and sets are made where they are compared. No step makes all pairs of a bucket.

Equal sets are one node. Sets are told apart by 64 bits of BLAKE2b over 64-bit shingle hashes.

Defined cases: a null or empty text has the empty set, n_shingles 0 and itself as component; a null doc_id takes part in
links and is ignored by the smallest doc_id; repeated rows are copies of each other; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import meeting
from .blocks import deflated, inflated
from .common import buffers, sliced, written
from .kernel import LOWER, U, distinct_shingles, mix, row_bounds, word_hashes, words
from .linking import MOST_KEYS, few, having, linked, portions, shared

#: Ratio of neighbouring size bands.
RATIO = 1.4
#: Cost model: sets in a band, chance that a value of one set is a given other's, cost of a comparison in index entries.
SETS, SHARED, COMPARE = 1e6, 0.2, 20
BLOCK_BYTES = 8 << 20


@dataclass(frozen=True)
class Scheme:
    number: int
    low: int
    #: Of the larger set, and of the smaller one.
    high: int
    top: int
    #: Segments; of these so many at the end with allowance 1; empty ones that are no entries.
    segments: int
    deletions: int
    spare: int


def cost(size: float, segments: int, deletions: int) -> float:
    """Index entries and expected false comparisons of a set."""
    each = size / segments
    false = (segments - deletions) * SHARED**each + deletions * (1 + each) * SHARED ** max(each - 1, 0)
    return segments - deletions + deletions * (1 + each) + COMPARE * SETS * false


def allocated(differ: int, size: float) -> tuple[int, int, int]:
    """Segments, deletions and spare of least cost for sets of about that size with at most so many differences."""
    best = None
    for deletions in range(min(differ // 2, 8) + 1):
        for spare in range(5):
            segments = max(1, differ + 1 - deletions) + spare
            empty = segments * math.exp(-size / segments) if segments > 1 else 0.0
            tail = max(0.0, 1 - sum(math.exp(-empty) * empty**i / math.factorial(i) for i in range(spare + 1)))  # of sets that index empty segments too
            found = cost(size, segments, deletions) + COMPARE * SETS * tail**2
            if best is None or found < best[0]:
                best = found, segments, deletions, spare
    return best[1:]


@functools.cache
def schemes(size: int, num: int, den: int) -> tuple[Scheme, ...]:
    """The schemes that a set of this size is indexed under: of each band that holds its smaller partners or itself."""
    out, number, low = [], 0, 1
    while low <= size:
        high = max(low, math.ceil(low * RATIO) - 1)  # of the smaller set
        most = high * den // num
        if size <= most:
            differ = (high + most) * (den - num) // (den + num)
            out.append(Scheme(number, low, most, high, *allocated(differ, (low + most) / 2)))
        number, low = number + 1, high + 1
    return tuple(out)


def agreeing(size: int, scheme: Scheme, num: int, den: int) -> int:
    """The least number of segments within their allowance that a set of this size has in common with a linked one."""
    partner = max(size, min(size * den // num, scheme.high)) if size <= scheme.top else scheme.top
    differ = (size + partner) * (den - num) // (den + num)
    plain = scheme.segments - scheme.deletions
    return scheme.segments - (differ if differ <= plain else plain + (differ - plain) // 2)


def segmented(items: np.ndarray, scheme: Scheme) -> tuple[np.ndarray, ...]:
    """Of a set: each value's segment and hash, each segment's sum of hashes, number of values and name."""
    m, salt = scheme.segments, mix(np.array([scheme.number + 1], U))[0]
    at = (mix(items + salt) % U(m)).astype(np.int64)
    value = mix(items ^ U(0xD6E8FEB86659FD93))
    sums = np.zeros(m, U)
    np.add.at(sums, at, value)
    return at, value, sums, np.bincount(at, minlength=m), mix(np.arange(m, dtype=U) + salt)


def unit(items: np.ndarray, scheme: Scheme, num: int, den: int) -> tuple[np.ndarray, int, bytes]:
    """A set under a scheme: its index entries (a hash for each segment, and for each neighbour of those with allowance 1), its need and its sketch."""
    at, value, sums, filled, name = segmented(items, scheme)
    m = scheme.segments
    plain = np.arange(m) < m - scheme.deletions
    keep = (filled > 0) | ~plain
    need = agreeing(len(items), scheme, num, den) - (m - np.count_nonzero(keep))
    if need < 1:
        keep[:], need = True, 1
    own = mix(sums ^ name)
    out = own[keep]
    if scheme.deletions:
        late = ~plain[at]
        out = np.unique(np.concatenate([out, mix((sums[at[late]] - value[late]) ^ name[at[late]])]))
    sketch = np.concatenate([(own & U(0xFF)).astype(np.uint8), np.minimum(filled, 255).astype(np.uint8)])
    return out, need, sketch.tobytes()


def entries(items: np.ndarray, scheme: Scheme, num: int = 90, den: int = 100) -> np.ndarray:
    return unit(items, scheme, num, den)[0]


def least_apart(a: bytes, b: bytes) -> int:
    """How many values two sets with these sketches differ in at least: in a segment that is not equal, as many as their numbers of values, and two if those are equal."""
    (ha, na), (hb, nb) = (np.frombuffer(x, np.uint8).reshape(2, -1).astype(np.int16) for x in (a, b))
    apart = np.abs(na - nb)
    return int(np.where((ha != hb) & (apart == 0), np.where(na == 255, 1, 2), apart).sum())


def digest(items: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(items.tobytes(), digest_size=8).digest(), "little", signed=True)


def sets_of(batch: pa.RecordBatch, k: int) -> list[np.ndarray]:
    """The shingle set of each row of a slice."""
    data, offsets = buffers(batch.column("text"))
    data = LOWER[data]
    starts, ends, rows = words(data, offsets)
    return distinct_shingles(word_hashes(data, starts, ends), row_bounds(rows, batch.num_rows), k)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and key, which stands for the document also where doc_id is null."""
    text = F.col("text").cast("string")
    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.xxhash64(text)).alias("key"), text.alias("text"))


UNITS = {"unit_node": "long", "unit_size": "int", "kind": "int", "need": "int", "sketch": "binary"}
LISTS = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def indexed(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Blocks: doc_id, key, n (set size) and node of each document; UNITS, a row for each set and scheme, only for the first of equal sets that a task meets; and their entries as meeting keeps them."""
    kinds = {"doc_id": "long", "key": "long", "n": "long", "node": "long", **UNITS}
    schema = ", ".join(["block long", *[f"{c} array<{t}>" for c, t in kinds.items()], "entries int, keys binary, units binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        number, size = TaskContext.get().partitionId() << 32, 0
        rows: dict[str, list] = {c: [] for c in kinds}
        found: list[np.ndarray] = []

        def block():
            every = np.concatenate([np.zeros(0, U), *found])
            owner = np.repeat(np.arange(len(found)), [len(x) for x in found])
            columns = [pa.array([number]), *[pa.array([rows[c]], pa.list_(LISTS[t])) for c, t in kinds.items()]]
            columns += [pa.array([x], t) for x, t in zip(meeting.kept(every, owner), (pa.int32(), pa.binary(), pa.binary()))]
            return pa.RecordBatch.from_arrays(columns, ["block", *kinds, "entries", "keys", "units"])

        for batch in sliced(batches, "text"):
            rows["doc_id"] += batch.column("doc_id").to_pylist()
            rows["key"] += batch.column("key").to_pylist()
            for items in sets_of(batch, k):
                node = digest(items) if len(items) else None
                rows["n"].append(len(items))
                rows["node"].append(node)
                if node is None or node in met:
                    continue
                if len(met) > 1_000_000:
                    met.clear()
                met.add(node)
                for scheme in schemes(len(items), num, den):
                    own, need, sketch = unit(items, scheme, num, den)
                    found.append(own)
                    for c, v in zip(UNITS, (node, len(items), scheme.number, need, sketch)):
                        rows[c].append(v)
            size += batch.nbytes
            if size >= BLOCK_BYTES:
                yield block()
                number, size, rows, found = number + 1, 0, {c: [] for c in kinds}, []
        if rows["n"]:
            yield block()

    return keyed(docs).mapInArrow(run, schema)


def listed(held: DataFrame, columns: list[str]) -> DataFrame:
    """block, at and a row for each place of the arrays."""
    return held.select("block", F.posexplode(F.arrays_zip(*columns)).alias("at", "x")).select("block", "at", "x.*")


def candidates(held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """members (bucket, node, kind, n) of buckets with two nodes or more, and units (node, kind, unit_size, sketch), both written tables."""
    units = listed(held, list(UNITS)).withColumnRenamed("unit_node", "node")
    one = units.groupBy("node", "kind").agg(F.min(F.struct("block", F.col("at").cast("long").alias("unit"))).alias("x")).select("node", "kind", "x.*")
    owners = written(one.join(units.select("block", F.col("at").cast("long").alias("unit"), "need", "unit_size", "sketch"), ["block", "unit"]), "units")
    rows = meeting.again(held).join(owners.drop("unit_size", "sketch"), ["block", "unit"])
    by = Window.partitionBy("block", "unit").orderBy(F.desc("n"), F.desc("bucket"))
    rare = rows.withColumn("place", F.row_number().over(by)).where("place >= need")
    return shared(rare.select("bucket", "node", "kind")), owners.select("node", "kind", "unit_size", "sketch")


def apart(size: int, other: int, num: int, den: int) -> int:
    """The most that linked sets of these sizes differ in, -1 if such sets cannot be linked."""
    return (size + other) * (den - num) // (den + num) if den * min(size, other) >= num * max(size, other) else -1


@dataclass(frozen=True)
class Sketches:
    """What sketches tell about pairs. units: a written table of node, kind, unit_size and sketch."""

    units: DataFrame
    num: int
    den: int

    def near(self, pairs: DataFrame) -> DataFrame:
        """node and leader of those pairs (node, leader, kind) that may be linked."""
        num, den = self.num, self.den

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in portions(batch, "sketch", "other"):
                    found = [least_apart(a, b) <= apart(n, m, num, den) for n, m, a, b in zip(*(part.column(c).to_pylist() for c in ("unit_size", "other_size", "sketch", "other")))]
                    yield part.select(["node", "leader"]).filter(pa.array(found, pa.bool_()))

        both = pairs.join(self.units, ["node", "kind"]).join(self.units.select(F.col("node").alias("leader"), "kind", F.col("unit_size").alias("other_size"), F.col("sketch").alias("other")), ["leader", "kind"])
        return both.select("node", "leader", "unit_size", "other_size", "sketch", "other").mapInArrow(run, "node long, leader long").distinct()

    def together(self, rows: DataFrame) -> DataFrame:
        """node and leader of the pairs of a bucket that may be linked and do not have the same label. rows: bucket, node, kind and label; a bucket has TOGETHER rows at most.

        Sketches are compared in place, once for each distinct group of nodes; other pairs are never rows."""
        num, den = self.num, self.den

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    group = batch.column("group")[k].as_py()
                    node, label, size = (np.array([x[c] for x in group], np.int64) for c in ("node", "label", "unit_size"))
                    each = np.stack([np.frombuffer(x["sketch"], np.uint8) for x in group]).astype(np.int16)
                    hashes, counts = np.split(each, 2, 1)
                    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                    for i in range(len(group) - 1):
                        off = np.abs(counts[i + 1 :] - counts[i])
                        least = np.where((hashes[i + 1 :] != hashes[i]) & (off == 0), np.where(counts[i] == 255, 1, 2), off).sum(1)
                        most = (size[i + 1 :] + size[i]) * (den - num) // (den + num)
                        good = (least <= most) & (label[i + 1 :] != label[i]) & (den * np.minimum(size[i + 1 :], size[i]) >= num * np.maximum(size[i + 1 :], size[i]))
                        b.append(node[i + 1 :][good])
                        a.append(np.full(len(b[-1]), node[i]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["node", "leader"])

        groups = rows.groupBy("bucket", "kind").agg(F.array_sort(F.collect_list(F.struct("node", "label"))).alias("x")).select("kind", "x").distinct()
        each = groups.select("kind", F.xxhash64("x").alias("group"), F.explode("x").alias("x")).select("kind", "group", "x.*")
        whole = each.join(self.units, ["node", "kind"]).groupBy("kind", "group").agg(F.collect_list(F.struct("node", "label", "unit_size", "sketch")).alias("group_"))
        return whole.select(F.col("group_").alias("group")).mapInArrow(run, "node long, leader long").distinct()


def clustered(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """doc_id, key, n_shingles, component_id and first_key (the smallest key of the component) of each document; documents are linked when den * intersection >= num * union."""
    held = written(indexed(docs, k, num, den), "entries")
    own = listed(held, ["doc_id", "key", "n", "node"]).select("doc_id", "key", "n", "node")
    members, units = candidates(held)

    def items(nodes: DataFrame) -> DataFrame:
        """node and its text, compressed, from one document of each node asked for."""
        chosen = written(having(own, nodes, "node").groupBy("node").agg(F.min("key").alias("key")), "chosen")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches, "text"):
                found = [(digest(x), deflated(t.encode())) for x, t in zip(sets_of(batch, k), batch.column("text").to_pylist()) if len(x)]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.binary())], ["node", "items"])

        return having(keyed(docs), chosen, "key").mapInArrow(run, "node long, items binary").dropDuplicates(["node"])

    def decode(found: list[bytes]) -> list[np.ndarray]:
        text = pa.RecordBatch.from_arrays([pa.array([inflated(x).decode() for x in found], pa.string())], ["text"])
        return [x for batch in sliced(iter([text]), "text") for x in sets_of(batch, k)]

    labels = linked(members, items, decode, num, den, Sketches(units, num, den))
    nodes = own.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"), F.min("key").alias("first_key"), F.count("*").alias("copies"))
    nodes = written(nodes.join(labels, "node", "left").where("copies > 1 or component is not null").withColumn("component", F.coalesce("component", "node")), "nodes")
    smallest = written(nodes.groupBy("component").agg(F.min("least").alias("least"), F.min("first_key").alias("first_key")), "smallest")
    named = written(nodes.select("node", "component").join(few(smallest), "component").drop("component"), "named")
    return own.join(few(named), "node", "left").select("doc_id", "key", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"), F.coalesce("first_key", "key").alias("first_key"))


def op4(docs: DataFrame) -> DataFrame:
    return clustered(docs).select("doc_id", "n_shingles", "component_id")


def without(rows: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows whose key is not among the keys, a written table: broadcast if a count proves it small, else shuffled."""
    return rows.join(F.broadcast(keys) if keys.count() <= MOST_KEYS else keys, on, "left_anti")


def stage(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One document of each component, that with the smallest key; rows that share its key are copies of it and only one stays."""
    columns = docs.columns
    found = written(clustered(docs, k, num, den).select("key", "first_key"), "classes")
    gone = written(found.where("key <> first_key").select("key").distinct(), "gone")
    several = written(found.where("key = first_key").groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "several")
    key = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")))
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), key.alias("key"))
    once = without(without(own, gone, "key"), several, "key")
    return once.union(having(own, several, "key").dropDuplicates(["key"])).select("row.*")
