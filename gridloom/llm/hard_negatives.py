"""Hard negatives of anchors by a block matrix product in two dimensions.

Vectors become integers and are cut into blocks of anchors and blocks of rows. Each anchor block meets each row block; what
their product gives, a tile of scores, is reduced where it is made: to the best partners of the anchor's label, which after a
merge are its positives, and, in a second product, to the best rows of other labels within the window of scores of each
positive. A task multiplies one anchor block by the row blocks of a part after each other and keeps the best so far, so most
of a tile is passed by with two comparisons. Tiles are never written or sent, since they grow with the square of the table:
what leaves a task is a few rows for each anchor (and positive), and what it holds is a slice of a tile.

Defined cases: rows take no part with a null vec_id, label or vector, or with any null or non-finite component; a vector
that is shorter than the longest counts 0 beyond its end; components are held to 32 bits, and sums are taken modulo 2^64.
A row is never a partner of an anchor with its own vec_id. Repeated rows are rows of their own: a repeated anchor gives its
rows again, a repeated partner takes a place of its own. Other columns are ignored; without anchors the result is empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import given_back, written

#: Rows of a block on either side, and numbers in a block, at most.
ANCHORS, ROWS, NUMBERS = 1024, 4096, 1 << 20
#: Rows of a part, about, and parts of rows for which no part holds more than a block.
PART_ROWS, FEW_PARTS = 1 << 17, 16
#: Columns of the first slice of a tile and of later ones: the first finds bounds that pass most of the later ones by.
FIRST, SLICE = 64, 512
#: Tasks that blocks are made in, at most.
MOST_PARTS = 1 << 15
#: Anchors' positives that may be broadcast, some 100 bytes for each anchor.
MOST_SENT = 200_000
POSITIVES, NEGATIVES = 5, 3
#: 100 times a negative's score lies between these times the positive's.
WINDOW = (50, 95)


def usable(rows: DataFrame, label: Column) -> DataFrame:
    """vec_id, label and v, the vector in doubles, or in floats if it was, of rows that take part."""
    kind = rows.schema["embedding"].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    v = F.col("embedding").cast("array<float>" if single else "array<double>")
    own = rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), v.alias("v"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return own.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & sound)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """floor(256 x) of a list column as rows of `width` 32-bit integers; zeros beyond a vector's end."""
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    out = np.zeros((len(sizes), width), np.int32)
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(offsets[0], offsets[-1]) - np.repeat(offsets[:-1], sizes)
    whole = np.clip(np.floor(256 * values[offsets[0] : offsets[-1]].astype(np.float64)), -(2.0**31), 2.0**31 - 1)
    out[row, place] = whole.astype(np.int32)
    return out


def blocks(rows: DataFrame, most: int, width: int, parts: int) -> DataFrame:
    """block, ids, labels and data (see narrow()): blocks of `most` rows at most, sorted by label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, n = TaskContext.get().partitionId() << 32, [], 0

        def out(k):
            nonlocal held, n, number
            ids, labels, data = (np.concatenate(x) for x in zip(*held))
            by = np.argsort(labels[:k], kind="stable")
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([ids[by]], pa.list_(pa.int64())), pa.array([labels[by]], pa.list_(pa.int64())), pa.array([narrow(data[by])], pa.binary())], ["block", "ids", "labels", "data"])
            number, n = number + 1, n - k
            held = [(ids[k:], labels[k:], data[k:])] if n else []

        for batch in batches:
            for at in range(0, batch.num_rows, most):
                own = batch.slice(at, most)
                held.append((own.column("vec_id").to_numpy(), own.column("label").to_numpy(), matrix(own.column("v"), width)))
                n += own.num_rows
                if n >= most:
                    yield from out(most)
        if n:
            yield from out(n)
        given_back()

    return rows.select("vec_id", "label", "v").repartition(parts).mapInArrow(run, "block long, ids array<long>, labels array<long>, data binary")


def narrow(tile: np.ndarray) -> bytes:
    """Scores as the narrowest integers that hold them all, after a byte that tells their width."""
    lo, hi = int(tile.min(initial=0)), int(tile.max(initial=0))
    kind = next(k for k in ("<i2", "<i4", "<i8") if np.iinfo(k).min <= lo and hi <= np.iinfo(k).max)
    return bytes([int(kind[2])]) + tile.astype(kind).tobytes()


def wide(data: bytes, n: int, m: int) -> np.ndarray:
    """The n times m scores that narrow() got, as 64-bit integers."""
    return np.frombuffer(data, f"<i{data[0]}", offset=1).reshape(n, m).astype(np.int64)


#: Sums stay below these, so that they are exact in any order.
EXACT = {np.float32: 1 << 24, np.float64: 1 << 53}


def kind_for(a: np.ndarray, b: np.ndarray) -> type:
    """The numbers in which a times b transposed is exact: floats, doubles, or else integers."""
    most = int(np.abs(a, dtype=np.int64).max(initial=0)) * int(np.abs(b, dtype=np.int64).max(initial=0)) * a.shape[1]
    return next((kind for kind, bound in EXACT.items() if most < bound), np.int64)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a times b transposed, exact."""
    kind = kind_for(a, b)
    return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)


def bound(scores: np.ndarray, kind: type) -> np.ndarray:
    """Scores to compare a tile with: its own are below EXACT, so larger ones may be held to it."""
    return np.clip(scores, -EXACT[kind], EXACT[kind]).astype(kind) if kind in EXACT else scores


def share(scores: np.ndarray, times: int) -> np.ndarray:
    """times / 100 of integers, rounded down, where times * score may not fit 64 bits."""
    return scores // 100 * times + scores % 100 * times // 100


LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


class Best:
    """The k highest scores of each slot, ties by smaller id, among those offered so far."""

    def __init__(self, slots: int, k: int):
        self.k, self.count = k, np.zeros(slots, np.int64)
        self.scores, self.ids = np.zeros((slots, k), np.int64), np.zeros((slots, k), np.int64)

    def least(self) -> np.ndarray:
        """Of each slot, the score that another one needs."""
        return np.where(self.count == self.k, self.scores[:, -1], LEAST)

    def offer(self, slots: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        last, last_id = self.scores[slots, -1], self.ids[slots, -1]
        new = (self.count[slots] < self.k) | (scores > last) | ((scores == last) & (ids < last_id))
        if not new.any():
            return
        slots, scores, ids = slots[new], scores[new], ids[new]
        own = np.unique(slots)
        at, place = np.nonzero(np.arange(self.k) < self.count[own, None])
        held = own[at]
        slots, scores, ids = np.r_[held, slots], np.r_[self.scores[held, place], scores], np.r_[self.ids[held, place], ids]
        order = np.lexsort((ids, ~scores, slots))
        slots, scores, ids = slots[order], scores[order], ids[order]
        first = np.searchsorted(slots, own)
        sizes = np.diff(np.r_[first, len(slots)])
        rank = np.arange(len(slots)) - np.repeat(first, sizes)
        kept = rank < self.k
        self.count[own] = np.minimum(sizes, self.k)
        self.scores[slots[kept], rank[kept]], self.ids[slots[kept], rank[kept]] = scores[kept], ids[kept]

    def kept(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Slots, scores and ids."""
        slots, place = np.nonzero(np.arange(self.k) < self.count[:, None])
        return slots, self.scores[slots, place], self.ids[slots, place]


def slices(n: int, fresh: bool) -> Iterator[slice]:
    """The columns of a tile: few at first where nothing is known of its rows."""
    at, size = 0, FIRST if fresh else SLICE
    while at < n:
        yield slice(at, at + size)
        at, size = at + size, min(2 * size, SLICE)


def spots(fit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of what fits; faster over the flat array than nonzero() over both dimensions."""
    return np.divmod(np.flatnonzero(fit), fit.shape[1])


def pairs(anchors: DataFrame, rows: DataFrame) -> DataFrame:
    """Every anchor block (a_ columns) with every row block (r_ columns), the pairs of an anchor block after each other; written blocks are read, not dealt."""
    right = rows.select(*[F.col(c).alias(f"r_{c}") for c in ("ids", "labels", "data")])
    return anchors.hint("shuffle_replicate_nl").crossJoin(right)


def each_pair(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, bool, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, type]]:
    """The row, whether its anchor block is a new one, ids, labels and vectors of the anchors and of the rows, and the kind of numbers for their product."""
    block = None
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            now = row.column("ablock")[0].as_py()
            if fresh := now != block:
                block, a_ids, a_labels = now, *(row.column(f"a_{c}")[0].values.to_numpy() for c in ("ids", "labels"))
                a = wide(row.column("a_data")[0].as_py(), len(a_ids), -1 if len(a_ids) else 0)
            r_ids, r_labels = (row.column(f"r_{c}")[0].values.to_numpy() for c in ("ids", "labels"))
            r = wide(row.column("r_data")[0].as_py(), len(r_ids), a.shape[1])
            kind = kind_for(a, r)
            yield row, fresh, a_ids, a_labels, a.astype(kind), r_ids, r_labels, r.astype(kind), kind
    given_back()


def best_partners(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """ablock, anchor (a place in the block), anchor_id, place, positive_id, positive_score: the k best rows of the anchor's label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, best = None, None, None

        def out():
            x, scores, partners = best.kept()
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(x), block, np.int64)), pa.array(x), pa.array(ids[x]), pa.array(partners), pa.array(scores)], ["ablock", "anchor", "anchor_id", "positive_id", "positive_score"])

        for row, fresh, a_ids, a_labels, a, r_ids, r_labels, r, kind in each_pair(batches):
            if fresh:
                if best is not None:
                    yield out()
                block, ids, best = row.column("ablock")[0].as_py(), a_ids, Best(len(a_ids), k)
            for label in np.intersect1d(a_labels, r_labels).tolist():  # both are sorted by label
                x0, x1, y0, y1 = (int(np.searchsorted(c, label, side)) for c in (a_labels, r_labels) for side in ("left", "right"))
                for at in slices(y1 - y0, fresh):
                    tile = a[x0:x1] @ r[y0:y1][at].T
                    x, y = spots(tile >= bound(best.least()[x0:x1], kind)[:, None])
                    scores, partners = tile[x, y].astype(np.int64), r_ids[y0:y1][at][y]
                    other = partners != a_ids[x0 + x]
                    best.offer(x0 + x[other], scores[other], partners[other])
        if best is not None:
            yield out()

    each = pairs(left, right).mapInArrow(run, "ablock long, anchor long, anchor_id long, positive_id long, positive_score long")
    order = Window.partitionBy("ablock", "anchor").orderBy(F.desc("positive_score"), "positive_id")
    return each.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def within(left: DataFrame, right: DataFrame, positives: DataFrame, sent: bool, each_anchor: int, k: int, window: tuple[int, int]) -> DataFrame:
    """ablock, anchor, place, negative_id, negative_score: the k best rows of each part in the window of each positive."""
    lists = positives.groupBy("ablock").agg(F.collect_list("anchor").alias("xs"), F.collect_list("place").alias("places"), F.collect_list("positive_score").alias("scores"))
    low, high = window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, best, lo, hi = None, None, None, None

        def out():
            slots, scores, ids = best.kept()
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(slots), block, np.int64)), pa.array(slots // each_anchor), pa.array((slots % each_anchor + 1).astype(np.int32)), pa.array(ids), pa.array(scores)], ["ablock", "anchor", "place", "negative_id", "negative_score"])

        for row, fresh, a_ids, a_labels, a, r_ids, r_labels, r, kind in each_pair(batches):
            if fresh:
                if best is not None:
                    yield out()
                block, best = row.column("ablock")[0].as_py(), Best(len(a_ids) * each_anchor, k)
                xs, places, scores = (row.column(c)[0].values.to_numpy() for c in ("xs", "places", "scores"))
                lo, hi = np.full((len(a_ids), each_anchor), MOST), np.full((len(a_ids), each_anchor), LEAST)  # no window
                lo[xs, places - 1], hi[xs, places - 1] = -share(-scores, low), share(scores, high)
            for at in slices(len(r), fresh):
                tile = a @ r[at].T
                # The least and the most that any window of the anchor still asks for.
                least, most = np.maximum(lo, best.least().reshape(lo.shape)).min(axis=1), hi.max(axis=1)
                fit = tile >= bound(least, kind)[:, None]
                fit &= tile <= bound(most, kind)[:, None]
                x, y = spots(fit)
                other = r_labels[at][y] != a_labels[x]
                x, y = x[other], y[other]
                scores, ids = tile[x, y].astype(np.int64), r_ids[at][y]
                for place in range(each_anchor):
                    inside = (scores >= lo[x, place]) & (scores <= hi[x, place])
                    best.offer(x[inside] * each_anchor + place, scores[inside], ids[inside])
        if best is not None:
            yield out()

    schema = "ablock long, anchor long, place int, negative_id long, negative_score long"
    asked = left.join(F.broadcast(lists) if sent else lists, "ablock")
    return pairs(asked, right).mapInArrow(run, schema)


def mined(rows: DataFrame, anchor: Column, label: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, window: tuple[int, int] = WINDOW, sent: int = MOST_SENT) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of every anchor and each of its positives.

    rows: vec_id, embedding and what `anchor` (which rows are anchors) and `label` (of a row) are made of."""
    own = usable(rows.withColumn("_label", label).withColumn("_anchor", anchor), F.col("_label")).withColumn("is_anchor", F.coalesce(anchor, F.lit(False)))
    n, n_anchors, width = own.agg(F.count("*"), F.count_if("is_anchor"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    sizes = [max(1, min(most, NUMBERS // max(1, width))) for most in (ANCHORS, ROWS)]
    several, every = (-(-k // size) for k, size in zip((n_anchors, n), sizes))
    parts = [min(MOST_PARTS, max(1, k)) for k in (several, max(-(-n // PART_ROWS), min(FEW_PARTS, every)))]
    left = written(blocks(own.where("is_anchor"), sizes[0], width, parts[0]), "anchors").select(F.col("block").alias("ablock"), *[F.col(c).alias(f"a_{c}") for c in ("ids", "labels", "data")])
    right = written(blocks(own, sizes[1], width, parts[1]), "rows")
    best_ = written(best_partners(left, right, positives), "positives")
    each = within(left, right, best_, n_anchors <= sent, positives, negatives, window)
    order = Window.partitionBy("ablock", "anchor", "place").orderBy(F.desc("negative_score"), "negative_id")
    ranked = each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.join(best_, ["ablock", "anchor", "place"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op12(embeddings: DataFrame) -> DataFrame:
    vec, label = F.col("vec_id").cast("long"), F.col("label").cast("long")
    return mined(embeddings, vec % 50 == 0, F.when(vec % 7 == 0, (label + 1) % 10).otherwise(label))
