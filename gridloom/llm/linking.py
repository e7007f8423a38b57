"""Links and connected components between sets that share buckets, without ever making all pairs of a bucket.

Each bucket compares its members with one leader, the member that shares most; most groups of near copies are one component
after that. Where there are sketches, they tell which of these pairs cannot be linked. The members of a bucket with
TOGETHER others at most are then compared by sketches in place, unless they are in one component by now. Larger buckets, and
all if there are no sketches, go the general way:

Of two other members X and Y, the differences from their leader, DX and DY, tell all: |X ^ Y| is |DX ^ DY|. If
X is not linked to the leader, a linked Y must share some of DX, at least (|DX| + |DY| - H) / 2 values where H is the most
that linked sets of these sizes differ in. So a prefix filter runs on the differences, the rarest values of a leader's group
first: only members with a common value among the first H + 1 of their differences are compared. Random edits have few of
these in common. Every pair of a bucket is compared with the leader, in one component, or excluded by a filter, so no
link between different components is lost, and a group of n copies costs about n comparisons.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import given_back, written

#: Rows of one long column that may be broadcast: 16 MB.
MOST_KEYS = 2_000_000


def few(keys: DataFrame) -> DataFrame:
    """A written table of a few longs a row, marked for broadcast if a count proves it small."""
    return F.broadcast(keys) if keys.count() <= MOST_KEYS else keys


def having(rows: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows whose key is among the keys, a written table: broadcast if a count proves it small, else shuffled."""
    keys = keys.select(on).distinct()
    small = keys.count() <= MOST_KEYS
    return rows.join(F.broadcast(keys) if small else keys, on, "left_semi")


def components(edges: DataFrame) -> DataFrame:
    """node and component, its smallest reachable node, for every node of the edges (a, b): large star and small star by turns."""
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    before = None
    while True:
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if mark == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b"), F.col("b"))).distinct()
        before = mark
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        now = written(small.select("b", "m").where("b <> m").union(small.select("a", "m")).distinct().toDF("a", "b"), "edges")


#: Bytes of items, as they are stored, that a task decodes at a time.
PORTION = 1 << 19


def portions(batch: pa.RecordBatch, *columns: str) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold about PORTION bytes in binary columns, or a single row."""
    ends = np.cumsum(sum(pc.binary_length(batch.column(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns))
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + PORTION, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def differences(pairs: DataFrame, items: DataFrame, decode: Callable[[list[bytes]], list[np.ndarray]], num: int, den: int) -> DataFrame:
    """Of each pair (node, leader): n, the size of the node's set; linked, if den * |intersection| >= num * |union|; diff, the values of one only.

    items: node and items, of which decode makes sorted 64-bit values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, "x", "y"):
                leaders = part.column("leader").to_pylist()
                place = {x: i for i, x in enumerate(leaders)}
                sets = decode([*part.column("x").to_pylist(), *part.column("y").take(pa.array(place.values())).to_pylist()])
                other = dict(zip(place, sets[len(leaders) :]))
                size, good, diff = [], [], []
                for x, leader in zip(sets, leaders):
                    y = other[leader]
                    every = np.sort(np.concatenate([x, y]))
                    same = every[1:] == every[:-1]
                    alone = np.ones(len(every), bool)
                    alone[1:] &= ~same
                    alone[:-1] &= ~same
                    both = int(np.count_nonzero(same))
                    size.append(len(x))
                    good.append(den * both >= num * (len(x) + len(y) - both))
                    diff.append(every[alone].view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column("node"), part.column("leader"), pa.array(size, pa.int64()), pa.array(good, pa.bool_()), pa.array(diff, pa.list_(pa.int64()))], ["node", "leader", "n", "linked", "diff"])
        given_back()

    first = pairs.join(items.select("node", F.col("items").alias("x")), "node")
    both = first.join(items.select(F.col("node").alias("leader"), F.col("items").alias("y")), "leader")
    return both.select("node", "leader", "x", "y").mapInArrow(run, "node long, leader long, n long, linked boolean, diff array<long>")


def shared(buckets: DataFrame) -> DataFrame:
    """Rows (bucket, node and others) of buckets with two nodes or more, and n, the bucket's rows; a written table."""
    several = buckets.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("bucket", "n")
    return written(buckets.join(several, "bucket").distinct(), "members")


#: Members of a bucket, beside its leader, whose sketches are compared in one place, at most.
TOGETHER = 128


def linked(members: DataFrame, items: Callable[[DataFrame], DataFrame], decode: Callable[[list[bytes]], list[np.ndarray]], num: int, den: int, sketches=None) -> DataFrame:
    """node and component of all nodes that have a link.

    members: written rows (bucket, node, n), with sketches also kind; items gives (node, items) of the nodes asked for.
    sketches: near() and together() as in jaccard_join.Sketches."""
    score = members.groupBy("node").agg(F.sum("n").alias("score"))
    kind = ["kind"] if sketches else []
    ranked = members.join(score, "node").select("bucket", "node", *kind, "score")
    leader = ranked.groupBy("bucket").agg(F.max(F.struct("score", (-F.col("node")).alias("minus"))).alias("x")).select("bucket", (-F.col("x.minus")).alias("leader"))
    led = ranked.join(leader, "bucket").where("node <> leader").select("bucket", "node", "leader", *kind)

    def compared(pairs: DataFrame) -> DataFrame:
        pairs = written(pairs, "pairs")
        held = written(items(pairs.select("node").union(pairs.select("leader")).distinct()), "sets")
        return written(differences(pairs, held, decode, num, den), "tested")

    def as_edges(tested: DataFrame) -> DataFrame:
        return tested.where("linked").select(F.col("node").alias("a"), F.col("leader").alias("b"))

    more = None
    if sketches:
        led = written(led, "led")
        near = written(sketches.near(led.select("node", "leader", "kind").distinct()), "near")
        first = compared(near)
        labels = written(components(as_edges(first)), "labels")
        labelled = written(led.join(labels, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component"), "labelled")
        open_ = written(labelled.groupBy("bucket").agg(F.count("*").alias("others"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("bucket", "others"), "open")
        more = sketches.together(labelled.join(open_.where(F.col("others") <= TOGETHER), "bucket").select("bucket", "node", "kind", "label"))
        large = written(labelled.join(open_.where(F.col("others") > TOGETHER), "bucket").select("node", "leader").distinct(), "large")
        tested = first.join(large, ["node", "leader"], "left_semi")
        if not large.isEmpty():
            tested = tested.union(compared(large.join(near, ["node", "leader"], "left_anti")))
    else:
        tested = compared(led.select("node", "leader").distinct())
        labels = written(components(as_edges(tested)), "labels")
    # Groups with a member that is not linked to its leader, and with others.
    open_ = tested.groupBy("leader").agg(F.count("*").alias("members"), F.count_if(~F.col("linked")).alias("off")).where("members > 1 and off > 0").select("leader")
    size = F.size("diff")
    most = F.expr(f"(n + n * {den} div {num}) * {den - num} div {den + num}")  # H with the largest partner
    rest = tested.join(open_, "leader").join(labels, "node", "left").select("leader", "node", "n", F.coalesce("component", "node").alias("label"), size.alias("d"), F.least(size, most + 1).alias("prefix"), "diff")
    rest = written(rest, "differences")
    values = rest.select("leader", "node", F.explode("diff").alias("value"))
    common = values.groupBy("leader", "value").agg(F.count("*").alias("times")).where("times > 1")
    # Values of one member only come first in the order and match nothing: they just take places of the prefix.
    places = values.join(common, ["leader", "value"]).groupBy("leader", "node").agg(F.array_sort(F.collect_list(F.struct("times", "value"))).alias("ordered"))
    kept = rest.drop("diff").join(places, ["leader", "node"]).withColumn("left", F.col("prefix") - (F.col("d") - F.size("ordered"))).where("left > 0")
    front = F.slice("ordered", F.lit(1), F.col("left").cast("int"))
    each = kept.select("leader", "node", "n", "label", "d", F.size("ordered").alias("size"), F.posexplode(front).alias("k", "x"))
    probes = written(each.select("leader", "node", "n", "label", "d", "x.value", (F.col("size") - F.col("k")).alias("after")), "probes")
    a, b = probes.alias("a"), probes.alias("b")
    apart = F.expr(f"(a.n + b.n) * {den - num} div {den + num}")
    # From a common value on, no more can be common than what either has from there.
    enough = 2 * F.least("a.after", "b.after") >= F.col("a.d") + F.col("b.d") - apart
    met = a.join(b, enough & (F.col("a.leader") == F.col("b.leader")) & (F.col("a.value") == F.col("b.value")) & (F.col("a.node") < F.col("b.node")) & (F.col("a.label") != F.col("b.label")) & (F.abs(F.col("a.d") - F.col("b.d")) <= apart) & (den * F.least("a.n", "b.n") >= num * F.greatest("a.n", "b.n")))
    fresh = met.select(F.col("a.node").alias("node"), F.col("b.node").alias("leader"))
    found = written(as_edges(compared((fresh.union(more) if more is not None else fresh).distinct())), "links")
    if found.isEmpty():
        return labels
    return components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).union(found))
