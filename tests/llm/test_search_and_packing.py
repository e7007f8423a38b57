"""Packing, hard negatives and lexical search against brute force, with the awkward cases that their docstrings define."""

import collections
import math
import os
import random
import re
import zlib

import pytest

pytest.importorskip("gridloom.llm")

import numpy as np
from pyspark.sql import functions as F

from data import CLASH, documents, frame, plain, prose
from gridloom.llm import hard_negatives, lexical_search, sequence_packing
from gridloom.llm.common import written
from gridloom.llm.token_counts import library

ODD = ["It's 5² ½x µªº <|endoftext|> a<|startoftext|>b İstanbul ΣΑΣ é ́x don't'll\x1cz\tq\x85r\xa0s ÀÉÎ×÷ß­soft 日本 🎉", "  ", " \n ", "'s x'S", "éè_- --- ...", "a\r\nb"]


def checked(rows, texts, size):
    """Pieces cover every id of every document once; sequences have no gap, at most `size` ids and no padding."""
    own = library(sequence_packing.vocabulary_path())
    ids = [[*own.encode(t or "", add_special_tokens=False).ids, 2] for _, t in texts]
    expected = collections.Counter((d, tuple(x)) for (d, _), x in zip(texts, ids))
    by_document, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_document[r["doc_id"], r["doc_tokens"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in pieces] == [sum(r["length"] for r in pieces[:k]) for k in range(len(pieces))]
        n = sum(r["length"] for r in pieces)
        assert n == size or (n < size and n & (n - 1) == 0)
    found = collections.Counter()
    for (d, n), pieces in by_document.items():
        same = [x for (e, x) in expected if e == d and len(x) == n]
        times = sum(expected[d, x] for x in same)
        places = collections.Counter(p for r in pieces for p in range(r["start"], r["start"] + r["length"]))
        assert set(places) == set(range(n)) and set(places.values()) == {times}
        for r in pieces:
            own_ids = np.frombuffer(r["ids"], "<u4").tolist()
            assert any(own_ids == list(x[r["start"] : r["start"] + r["length"]]) for x in same)
        found.update({(d, x): expected[d, x] for x in same})
    assert found == expected


def test_packing(spark):
    texts = [*documents(), *((500 + i, t) for i, t in enumerate(ODD))]
    rnd = random.Random(1)
    texts += [(600, prose(rnd, 3000)), (601, "z" * 3000), (602, "b&" * 2000)]
    rows = sequence_packing.packed(frame(spark, texts).repartition(5), size=256, windows=3, group=2).collect()
    checked(rows, texts, 256)
    derived = sequence_packing.op11(frame(spark, texts)).collect()
    assert set(derived[0].asDict()) == {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}
    own = sequence_packing.packed(frame(spark, texts)).collect()
    assert sorted(r["ids_crc32"] for r in derived) == sorted(zlib.crc32(r["ids"]) for r in own)
    checked(own, texts, 4096)


def test_packing_of_nothing_and_of_sequences(spark):
    assert sequence_packing.op11(frame(spark, [])).collect() == []
    texts = documents()
    pieces = sequence_packing.packed(frame(spark, texts), size=512)
    made = {r["sequence_id"]: r for r in sequence_packing.sequences(pieces).collect()}
    own = library(sequence_packing.vocabulary_path())
    every = collections.Counter(i for _, t in texts for i in [*own.encode(t or "", add_special_tokens=False).ids, 2])
    assert collections.Counter(i for r in made.values() for i in np.frombuffer(r["ids"], "<u4").tolist()) == every
    assert all(len(r["ids"]) == 4 * r["length"] and r["starts"][0] == 0 for r in made.values())


def test_packing_keeps_documents_whole_where_they_fit():
    """One cut for each window that is filled up, at most: best fit places the others whole."""
    rnd = random.Random(2)
    packer = sequence_packing.Packer(1024, 32)
    pieces = [rnd.randrange(1, 400) for _ in range(3000)]
    out = [x for i, n in enumerate(pieces) for x in packer.put([sequence_packing.Piece(i, 0, b"\0\0\0\0" * n, n)])]
    whole = sum(p.length == p.doc_tokens for s in out for p in s)
    assert len(packer.rooms) <= 32 and whole > 0.7 * sum(len(s) for s in out)
    assert all(sum(p.length for p in s) == 1024 for s in out)


def mined_by_hand(rows, relabel=True):
    own = []
    for v, e, lab in rows:
        if v is None or lab is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        own.append((v, (lab + 1) % 10 if relabel and v % 7 == 0 else lab, [math.floor(256 * float(np.float32(x))) for x in e]))
    out = []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    for a, la, va in own:
        if a % 50:
            continue
        scored = [(-dot(va, vb), b, lb) for b, lb, vb in own if b != a]
        for s, p, _ in sorted(x for x in scored if x[2] == la)[:5]:
            ok = sorted((t, n) for t, n, lb in scored if lb != la and 50 * -s <= 100 * -t <= 95 * -s)
            out += [(a, p, k, n, -s, -t) for k, (t, n) in enumerate(ok[:3], 1)]
    return sorted(out)


def vectors(seed=3, n=700, dim=70):
    rnd = np.random.default_rng(seed)
    middle = rnd.normal(size=(10, dim))
    rows = []
    for i in range(n):
        label = int(rnd.integers(0, 10))
        v = 0.35 * middle[label] + rnd.normal(size=dim) + 0.5
        rows.append((i, [float(np.float32(x)) for x in v / np.linalg.norm(v)], label))
    hot = rows[3][1]
    rows += [(1000 + i, hot, i % 10) for i in range(250)]  # one vector, many rows: ties everywhere
    rows += [(None, hot, 1), (2000, None, 1), (2050, hot, None), (2100, [*hot[:3], None], 2), (2150, [*hot[:3], float("nan")], 2), (2200, [float("inf")], 2)]
    rows += [(2250, hot[:20], 4), (2300, [], 4), (2350, [0.0] * dim, 5)]
    return rows


def embeddings(spark, rows, parts=3):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(parts)
    return df.withColumns({c: F.lit("other") for c in CLASH if c != "label"})


def test_hard_negatives(spark, monkeypatch):
    rows = vectors()
    expected = mined_by_hand(rows)
    assert plain(hard_negatives.op12(embeddings(spark, rows)).collect()) == sorted(expected, key=repr)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 7)
    monkeypatch.setattr(hard_negatives, "ROWS", 100)
    monkeypatch.setattr(hard_negatives, "MOST_SENT", 0)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    shuffled = hard_negatives.mined(embeddings(spark, rows), F.col("vec_id") % 50 == 0, label, sent=0)
    assert plain(shuffled.collect()) == sorted(expected, key=repr)


def test_hard_negatives_of_repeated_and_of_no_rows(spark):
    assert hard_negatives.op12(embeddings(spark, [])).collect() == []
    assert hard_negatives.op12(embeddings(spark, [(1, [1.0], 2), (2, [1.0], 3)])).collect() == []
    twice = [(50, [1.0, 0.0], 1)] * 2 + [(1, [1.0, 0.0], 1)] * 2 + [(2, [0.7, 0.0], 2)]
    got = plain(hard_negatives.op12(embeddings(spark, twice)).collect())
    assert got == [(50, 1, 1, 2, 65536, 256 * 179)] * 4


def test_hard_negatives_write_no_tiles(spark, monkeypatch):
    """What is written follows the table, not its square; thousands of equal scores, slices and parts give what a full sort gives."""
    rnd = np.random.default_rng(8)
    n, dim = 20_000, 8
    v = rnd.normal(size=(n, dim)).round(1)
    v[5000:9000] = v[5000]
    label, ids = rnd.integers(0, 10, n), rnd.permutation(n)
    df = spark.createDataFrame([(int(i), x, int(k)) for i, x, k in zip(ids, v.tolist(), label)], "vec_id long, embedding array<double>, label int")
    tables = []
    monkeypatch.setattr(hard_negatives, "written", lambda df, name: tables.append(written(df, name)) or tables[-1])
    got = plain(hard_negatives.op12(df).collect())
    assert sum(os.path.getsize(f.removeprefix("file://")) for t in tables for f in t.inputFiles()) < 3 * v.size * 4
    whole = np.floor(256 * v).astype(np.int64)
    own = np.where(ids % 7 == 0, (label + 1) % 10, label)
    expected = []
    for a in np.flatnonzero(ids % 50 == 0):
        score = whole @ whole[a]
        order = np.lexsort((ids, -score))
        for p in order[(own[order] == own[a]) & (order != a)][:5]:
            fit = order[(own[order] != own[a]) & (50 * score[p] <= 100 * score[order]) & (100 * score[order] <= 95 * score[p])][:3]
            expected += [(int(ids[a]), int(ids[p]), r, int(ids[b]), int(score[p]), int(score[b])) for r, b in enumerate(fit, 1)]
    assert got == sorted(expected, key=repr)


def test_shares_of_scores_near_the_ends():
    s = np.array([0, 7, -7, 1 << 62, -(1 << 62), 199, -201])
    assert hard_negatives.share(s, 95).tolist() == [int(x) * 95 // 100 for x in s]
    assert hard_negatives.bound(np.array([hard_negatives.LEAST, 5, hard_negatives.MOST]), np.float32).tolist() == [-(1 << 24), 5, 1 << 24]


def test_products_are_exact():
    rnd = np.random.default_rng(1)
    a, b = (rnd.integers(-(1 << 30), 1 << 30, (4, 5)).astype(np.int32) for _ in range(2))
    exact = [[sum(int(x) * int(y) for x, y in zip(r, s)) for s in b] for r in a]
    assert hard_negatives.product(a, b).tolist() == exact
    tile = np.array([[5, -70000], [1 << 40, 0]])
    assert hard_negatives.wide(hard_negatives.narrow(tile), 2, 2).tolist() == tile.tolist()


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def low(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def ranked_by_hand(docs, items, k=10):
    own = [(d, collections.Counter(TERM.findall(low(t or "")))) for d, t in docs]
    n = sum(1 for _, c in own if c)
    total = sum(sum(c.values()) for _, c in own)
    df = collections.Counter(t for _, c in own for t in c)
    out = []
    for item, text in items:
        asked = set(TERM.findall(low(text or "")))
        scored = []
        for d, c in own:
            size = sum(c.values())
            m = 10 + (90 * size * n) // total if total else 10
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in asked if c[t])
            if s > 0:
                scored.append((-s, d is None, d if d is not None else 0))
        out += [(item, r, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def asked(spark, items):
    return spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit("other") for c in CLASH})


ITEMS = [(0, "w1 w2 W3 same row text"), (1, "A b c one"), (2, ""), (3, None), (4, "x"), (5, "nothing-known here"), (5, "w7 w8 w9"), (6, "日本 é 🎉"), (None, "w11 w12"), (0, "w1 w2 W3 same row text")]


def test_lexical_search(spark):
    docs = documents()
    assert plain(lexical_search.op13(frame(spark, docs), asked(spark, ITEMS)).collect()) == ranked_by_hand(docs, ITEMS)
    assert lexical_search.op13(frame(spark, []), asked(spark, ITEMS)).collect() == []
    assert lexical_search.op13(frame(spark, docs), asked(spark, [])).collect() == []


def test_lexical_search_over_many_blocks(spark):
    """More than a block in a partition, thousands of equal scores, a very long text, and items in several groups."""
    rnd = random.Random(6)
    docs = [(20_000 - i, " ".join(f"t{int(rnd.paretovariate(0.7)) % 900}" for _ in range(rnd.randrange(1, 9)))) for i in range(9000)]
    docs += [(30_000 + i, "t1 t2 t3") for i in range(5000)] + [(50_000, "t4 t5 " * 150_000), (None, "t1 t2 t3")]
    rnd.shuffle(docs)
    items = [(i, " ".join(f"t{rnd.randrange(1, 60)}" for _ in range(5))) for i in range(12)] + [(100, "t1 t2 t3"), (101, "t1"), (102, "t5 t899")]
    expected = ranked_by_hand(docs, items)
    assert plain(lexical_search.searched(frame(spark, docs).coalesce(1), asked(spark, items)).collect()) == expected
    assert plain(lexical_search.searched(frame(spark, docs).repartition(5), asked(spark, items), most=4).collect()) == expected


def test_a_tree_opens_equal_bounds():
    """All documents score alike: the k smallest ids are found wherever they stand."""
    ids = list(range(4000, 0, -1))
    held = np.array([2])
    levels = []
    for span in (1, *lexical_search.SPANS):
        keys = np.unique(np.arange(4000) // span)
        levels += [lexical_search.packed(keys, "<i8"), lexical_search.packed(np.full(len(keys), 9), "<i8")]
    tree = lexical_search.Tree(ids, held, levels)
    assert [-m for _, _, m in tree.search(np.array([2]), 5, 1)] == [1, 2, 3, 4, 5]
    assert tree.search(np.array([2]), 5, 10) == [] and tree.search(np.array([1, 3]), 5, 1) == []
