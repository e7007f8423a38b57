"""Operators that work document by document, against plain Python and the libraries."""

import base64
import collections
import hashlib
import math
import random
import tracemalloc
import zlib

import pytest

pytest.importorskip("gridloom.llm")

import numpy as np
import pyarrow as pa

from data import WORD, documents, frame, low, plain
from gridloom.llm import byte_bpe, lm_score, quality_rules, token_counts


def test_quality_base(spark):
    expected = []
    for i, text in documents():
        text = text or ""
        w = WORD.findall(text)
        seen, dup = set(), 0
        for line in text.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        win = collections.Counter(zip(w, w[1:], w[2:]))
        hit = {k for j in range(len(w) - 2) if win[tuple(w[j : j + 3])] > 1 for k in (j, j + 1, j + 2)}
        failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
        expected.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(hit), failed))
    got = quality_rules.op3(frame(spark)).collect()
    assert plain(r[:7] for r in got) == plain(expected)
    assert not any(r["kept"] and r["base_failed"] for r in got)
    assert quality_rules.op3(frame(spark, [])).count() == 0


def test_quality_lines(spark):
    lines = "\n".join(f"Line {k} is a plain sentence {k}{k} with quite {k * 7} a few words {k * 3} in it {k + 50}." for k in range(6))
    text = lines + "\nHome | News | Sport | About | Login\nLicensed under the Apache License, Version 2.0."
    junk = "\n".join(["spam*** eggs&&& ham%%% foo### bar$$$"] * 3 + [f"a{k} | b{k} | c{k} | d{k}" for k in range(20)])
    df = frame(spark, [(1, text), (2, junk)])
    out = quality_rules.stage(df)
    assert out.schema == df.schema
    (row,) = out.collect()
    assert row["doc_id"] == 1 and row["text"] == lines


def test_lines_of_other_languages():
    for phrase in ("Alle Rechte vorbehalten", "Tous droits réservés", "Todos los derechos reservados", "Conditions d’utilisation"):
        assert quality_rules.bad_line(f"Das hier ist: {phrase}.") == "boilerplate"
    assert quality_rules.bad_line("漢字" * 40) == "punctuation" and quality_rules.bad_line("漢字" * 40 + "。") is None
    assert quality_rules.bad_line("漢字の題") is None


def test_bpe_is_the_library(spark):
    tiktoken = pytest.importorskip("tiktoken")
    import public_tokenizers

    with open(byte_bpe.vocabulary_path(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = documents() + [(k, t) for k, t in enumerate(["  a  b \n c\n\n d", " x", "don't we'll\t\tx \n", "<|endoftext|> <unk> ▁a", " \x85 \x1c y  "], 400)]
    expected = []
    for i, text in rows:
        ids = library.encode_ordinary(text or "")
        raw = (text or "").encode()
        expected.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(raw).hexdigest()))
    df = frame(spark, rows)
    assert plain(byte_bpe.op7(df).collect()) == plain(expected)
    full = byte_bpe.encoded(df)
    assert plain((r[0], bytes(r[1])) for r in byte_bpe.decoded(full).collect()) == plain((i, (t or "").encode()) for i, t in rows)
    assert byte_bpe.op7(frame(spark, [])).count() == 0


def test_token_counts_are_the_library(spark):
    own = token_counts.library(token_counts.vocabulary_path())
    rows = documents() + [(400, "x<|endoftext|> y <|endoftext|>"), (401, "  a  b \n c\n\n d")]
    expected = []
    for i, text in rows:
        n = len(own.encode(text or "", add_special_tokens=False).ids)
        expected.append((i, len((text or "").encode()), n, n > 1024))
    for size in (2000, 1 << 20):
        assert plain(token_counts.counted(frame(spark, rows), size=size).collect()) == plain(expected)
    assert token_counts.op5(frame(spark, [])).count() == 0


def ppm(counts, text, order):
    """log10 probability by the method's definition, symbol by symbol."""
    data, out = b"\xff" * order + text.encode() + b"\xff", 0.0
    for j in range(order, len(data)):
        excluded: set = set()
        for k in range(order, -1, -1):
            shown = counts[k].get(data[j - k : j])
            if not shown:
                continue
            total, kinds = sum(n for s, n in shown.items() if s not in excluded), sum(s not in excluded for s in shown)
            if kinds and data[j] in shown:
                out += math.log10(shown[data[j]] / (total + kinds))
                break
            if kinds:
                out += math.log10(kinds / (total + kinds))
            excluded |= set(shown)
        else:
            out -= math.log10(256 - len(excluded))
    return out


def test_lm_scores(spark):
    rows = [r for r in documents() if r[0] != 306]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    words = lambda s: [*WORD.findall(low(s or "")), None]
    unigrams = collections.Counter(w for i, s in rows if not held(i) for w in words(s))
    n, v = sum(unigrams.values()), len(unigrams)
    counts = [collections.defaultdict(collections.Counter) for _ in range(lm_score.ORDER + 1)]
    for i, s in rows:
        if not held(i):
            data = b"\xff" * lm_score.ORDER + (s or "").encode() + b"\xff"
            for j in range(lm_score.ORDER, len(data)):
                for k in range(lm_score.ORDER + 1):
                    counts[k][data[j - k : j]][data[j]] += 1
    expected = [(i, held(i), len(words(s)), sum(unigrams[w] > 0 for w in words(s)), n, round(sum(math.log10((unigrams[w] + 1) / (n + v + 1)) for w in words(s)), 5), round(ppm(counts, s or "", lm_score.ORDER), 5)) for i, s in rows]
    got = [(*r[:5], round(r[5], 5), round(r[6], 5)) for r in lm_score.op2(frame(spark, rows)).collect()]
    assert plain(got) == plain(expected)
    assert lm_score.op2(frame(spark, [])).count() == 0


def test_trie_keeps_frequent_nodes(spark):
    grams = lm_score.gram_counts(frame(spark))
    small = lm_score.fitted(grams, most_nodes=500)
    assert all(len(x.grams) <= 500 for x in small.levels)
    for a, b in zip(small.levels, small.levels[1:]):
        assert lm_score.find(a.grams, b.grams & np.uint64((1 << 8 * lm_score.ORDER) - 1))[0].size == len(b.grams)
    keys, _ = lm_score.gram_keys(np.frombuffer(b"w12 w7.", np.uint8), np.array([0, 7]))
    # All next symbols of one context add up to 1.
    every = (keys[3] & ~np.uint64(255)) | np.arange(256, dtype=np.uint64)
    assert np.sum(10 ** small.log10(every)) == pytest.approx(1)


def test_rare_nodes_count_beyond_the_bound(spark):
    """More than 2^22 learning bytes: strings that come once still count."""
    common = "the usual words come again and again. " * 400
    rare = [(1000 + i, t) for i, t in documents() if t and i is not None and i < 60]
    rows = [(i, common) for i in range(400)] + rare
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    assert sum(len(t) for i, t in rows if not held(i)) > lm_score.MOST_NODES
    counts = [collections.defaultdict(collections.Counter) for _ in range(lm_score.ORDER + 1)]
    times = collections.Counter(t for i, t in rows if not held(i))
    for text, n in times.items():
        data = b"\xff" * lm_score.ORDER + text.encode() + b"\xff"
        for j in range(lm_score.ORDER, len(data)):
            for k in range(lm_score.ORDER + 1):
                counts[k][data[j - k : j]][data[j]] += n
    got = {r["doc_id"]: r["score"] for r in lm_score.op2(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i, t in [rows[0], *rare]:
        assert got[i] == pytest.approx(ppm(counts, t, lm_score.ORDER), abs=1e-5)


def test_more_blocks_have_more_parts(spark, monkeypatch):
    assert [lm_score.parts_for(n) for n in (0, 256, 257, 1024, 10**9)] == [256, 256, 512, 1024, 65536]
    docs = frame(spark, [r for r in documents() if r[0] != 306])
    few = plain((r["doc_id"], round(r["score"], 6)) for r in lm_score.op2(docs).collect())
    monkeypatch.setattr(lm_score, "parts_for", lambda n: 4096)
    assert plain((r["doc_id"], round(r["score"], 6)) for r in lm_score.op2(docs).collect()) == few


def test_a_block_takes_little_memory(spark):
    """Grams of a block of 8 MB are made and sorted a slice at a time; no lazy batch of whole blocks is left in the result."""
    rnd = random.Random(11)
    words = [f"w{rnd.randrange(10**6)}" for _ in range(30_000)]
    texts = pa.array([" ".join(rnd.choices(words, k=1000)).encode() for _ in range(1100)], pa.binary())
    learns = np.arange(len(texts)) % 3
    tracemalloc.start()
    grams, counts = lm_score.dictionary(texts, learns, lm_score.ORDER)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert texts.nbytes > 8 << 20 and peak < 80 << 20
    keys, rows = lm_score.gram_keys(*lm_score.buffers(texts.view(pa.string())))
    every, at = np.unique(keys, return_inverse=True)
    assert np.array_equal(grams, every) and np.array_equal(counts, np.bincount(at.ravel(), learns[rows] > 0).astype(int))
    assert all("scored-" in f for f in lm_score.op2(frame(spark)).inputFiles())
