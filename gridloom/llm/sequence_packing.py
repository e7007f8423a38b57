"""Token sequences of a fixed size packed from whole documents, in bounded space.

Each task keeps WINDOWS open windows at most. A document longer than a sequence gives full sequences of its own first; what is
left goes to the window that it fits best. When it fits none and all windows are open, the fullest is filled up with
the document's next ids and emitted, and the rest goes on. At a task's end its open windows are left over. Leftovers of GROUP
tasks at a time are merged: whole windows into one another by best fit, then what is still open is put end to end and cut.
What is less than a sequence goes to the next round with those of other groups, until there is one group; its last ids are
cut into sequences at powers of two, which need no padding. So no sequence is padded at all, and a document is cut only where
a window was filled up, at the end of a round, or because it is longer than a sequence.

A group's leftovers have a bounded size (GROUP * WINDOWS sequences at most), whatever the corpus.

Defined cases: a null text is empty and has the end id alone; a null doc_id is carried along; repeated rows are packed row
by row; other columns are ignored; an empty table gives an empty result; a text of any length is encoded whole.
"""

from __future__ import annotations

import codecs
import functools
import json
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import given_back, only, sliced, texts, written
from .pretokens import Kept
from .token_counts import library

SIZE, END, WINDOWS, GROUP = 4096, 2, 32, 64
#: Characters of a stretch between blanks whose ids are kept for its next time, at most.
KEPT_CHARS = 64
#: Stretches, and words in them, whose ids a task keeps before it starts anew.
KEPT_WORDS = 400_000
#: How the vocabulary's file prepares a text, as it states itself.
PREPARED = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
)
#: Stretches whose pre-tokens are runs of letters, single digits and runs of signs: no apostrophe, white space or control.
SIMPLE = regex.compile("[!-&(-~\u00a1-\u00ff]+")
RUNS = regex.compile(r"\p{L}+|\p{N}|[^\p{L}\p{N}]+")
#: Byte-level letters: printable Latin-1 bytes stand for themselves, the others for characters from 256 on, in order.
_PLAIN = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_OTHERS = [b for b in range(256) if b not in _PLAIN]
SHOWN = "".join(chr(b) if b in _PLAIN else chr(256 + _OTHERS.index(b)) for b in range(256))
#: Bytes of ids in an output batch.
OUT_BYTES = 4 << 20
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, part long, open boolean"
COLUMNS = [x.split(" ")[0] for x in SCHEMA.split(", ")]


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@dataclass(frozen=True)
class Piece:
    """Ids (little-endian, 32 bits each) of a document, the first of which is number `start` of its doc_tokens."""

    doc_id: int | None
    start: int
    ids: bytes
    doc_tokens: int

    @property
    def length(self) -> int:
        return len(self.ids) // 4

    def part(self, a: int, b: int) -> Piece:
        return Piece(self.doc_id, self.start + a, self.ids[4 * a : 4 * b], self.doc_tokens)


def cut(pieces: list[Piece], n: int) -> tuple[list[Piece], list[Piece]]:
    """Pieces of the first n ids, and the rest."""
    before: list[Piece] = []
    for k, x in enumerate(pieces):
        if n >= x.length:
            before.append(x)
            n -= x.length
        elif n:
            return [*before, x.part(0, n)], [x.part(n, x.length), *pieces[k + 1 :]]
        else:
            return before, pieces[k:]
    return before, []


@dataclass
class Packer:
    """Open windows, by room. put() gives the sequences that are full now."""

    size: int = SIZE
    most: int = WINDOWS
    #: (room, number) in order, and the pieces of each number.
    rooms: list[tuple[int, int]] = field(default_factory=list)
    held: dict[int, list[Piece]] = field(default_factory=dict)
    made: int = 0

    def put(self, item: list[Piece]) -> Iterator[list[Piece]]:
        n = sum(x.length for x in item)
        if n >= self.size:  # one long document
            long, n = item[0], n % self.size
            for a in range(0, long.length - n, self.size):
                yield [long.part(a, a + self.size)]
            item = [long.part(long.length - n, long.length)]
        while n:
            at = bisect_left(self.rooms, (n, -1))
            if at < len(self.rooms):
                room, number = self.rooms.pop(at)
                self.held[number] += item
                if room == n:
                    yield self.held.pop(number)
                else:
                    insort(self.rooms, (room - n, number))
                return
            if len(self.rooms) < self.most:
                self.held[self.made] = list(item)
                insort(self.rooms, (self.size - n, self.made))
                self.made += 1
                return
            room, number = self.rooms.pop(0)
            first, item = cut(item, room)
            n -= room
            yield self.held.pop(number) + first

    def left(self) -> list[list[Piece]]:
        """The open windows, the fullest first."""
        return [self.held[number] for _, number in self.rooms]


@functools.cache
def plain_model(path: str):
    """The file's merges alone, if it prepares texts as PREPARED says; else None."""
    from tokenizers import models

    found = json.loads(Path(path).read_text())
    if (found["normalizer"], found["pre_tokenizer"]) != PREPARED or found["model"]["end_of_word_suffix"] != "</w>":
        return None
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in found["model"]["merges"]]
    return models.BPE(found["model"]["vocab"], merges, end_of_word_suffix="</w>", cache_capacity=0)


def as_bytes(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


def encoder(path: str):
    """Texts to the bytes of their ids.

    No token crosses white space, so ids of short stretches between blanks and line ends are kept for their next time. In a stretch
    of Latin-1 letters, digits and signs pre-tokens are plain runs, and the library's merges see each distinct one once; all
    other stretches, such as those with apostrophes, controls, special strings or other scripts, go through the whole library."""
    own, model = library(path), plain_model(path)

    def merged(low: str) -> bytes:
        return as_bytes([t.id for t in model.tokenize(codecs.charmap_decode(low.encode(), "strict", SHOWN)[0])])

    word = Kept(merged, KEPT_WORDS)

    def fresh(stretch: str) -> bytes:
        if model is not None and len(stretch) <= KEPT_CHARS:
            if stretch.isalpha() and max(stretch) <= "\u00ff":
                return word[stretch.lower()]
            if SIMPLE.fullmatch(stretch) and "<|" not in stretch:
                return b"".join([word[x] for x in RUNS.findall(stretch.lower())])
        return as_bytes(own.encode(stretch, add_special_tokens=False).ids)

    kept = Kept(fresh, KEPT_WORDS)

    def ids(text: str) -> bytes:
        return b"".join([kept[x] if len(x) <= KEPT_CHARS else fresh(x) for x in text.replace("\n", " ").split(" ")])

    return ids


def as_rows(sequences: list[tuple[int, list[Piece], bool]], part: int) -> pa.RecordBatch:
    rows: list[tuple] = []
    for number, pieces, is_open in sequences:
        at = 0
        for x in pieces:
            rows.append((x.doc_id, x.start, x.length, x.ids, x.doc_tokens, number, at, part, is_open))
            at += x.length
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * len(kinds), kinds)], COLUMNS)


def first_pass(docs: DataFrame, path: str, size: int, end: int, windows: int) -> DataFrame:
    """Pieces of full sequences, and of the windows that are open at each task's end."""
    last = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, packer, ids = TaskContext.get().partitionId(), 0, Packer(size, windows), encoder(path)
        out, held = [], 0
        for batch in sliced(batches, "text"):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch.column("text")).to_pylist()):
                own = ids(text) + last
                for pieces in packer.put([Piece(doc_id, 0, own, len(own) // 4)]):
                    out.append((part << 32 | number, pieces, False))
                    number, held = number + 1, held + 4 * size
                    if held >= OUT_BYTES:
                        yield as_rows(out, part)
                        out, held = [], 0
        for pieces in packer.left():
            out.append((part << 32 | number, pieces, True))
            number += 1
        if out:
            yield as_rows(out, part)
        given_back()

    return only(docs, doc_id="long", text="string").mapInArrow(run, SCHEMA)


def merge(windows: list[list[Piece]], size: int, most: int, final: bool) -> tuple[list[list[Piece]], list[Piece]]:
    """Full sequences made of left windows, and the ids that are less than a sequence; if final, those too, cut at powers of two."""
    packer = Packer(size, most)
    done = [x for w in sorted(windows, key=lambda w: -sum(p.length for p in w)) for x in packer.put(w)]
    rest = [x for w in packer.left() for x in w]
    while sum(x.length for x in rest) >= size:
        full, rest = cut(rest, size)
        done.append(full)
    while final and (n := sum(x.length for x in rest)):
        own, rest = cut(rest, 1 << n.bit_length() - 1)
        done.append(own)
    return done, rest


def merged(left: DataFrame, level: int, final: bool, size: int, windows: int, group: int) -> DataFrame:
    """Pieces of what `group` parts at a time left over; part is the number of the group."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        number = key[0].as_py()
        held: dict[int, list[Piece]] = {}
        for x in rows.sort_by([("sequence_id", "ascending"), ("offset", "ascending")]).to_pylist():
            held.setdefault(x["sequence_id"], []).append(Piece(x["doc_id"], x["start"], x["ids"], x["doc_tokens"]))
        done, rest = merge(list(held.values()), size, windows, final)
        # Levels stand above the numbers of tasks and their sequences.
        out = [(level << 58 | number << 32 | i, x, False) for i, x in enumerate(done)]
        return pa.Table.from_batches([as_rows(out + [(level << 58 | number << 32 | len(done), rest, True)] if rest else out, number)])

    return left.withColumn("group", F.expr(f"part div {group}")).groupBy("group").applyInArrow(run, SCHEMA)


def packed(docs: DataFrame, path: str | None = None, size: int = SIZE, end: int = END, windows: int = WINDOWS, group: int = GROUP) -> DataFrame:
    """doc_id, start, length, ids, doc_tokens, sequence_id, offset: a row for each piece of a document; size is a power of two."""
    now = written(first_pass(docs, path or vocabulary_path(), size, end, windows), "packed")
    parts = now.agg(F.coalesce(F.max("part"), F.lit(0))).first()[0] + 1
    out, level = now.where("not open"), 0
    while True:
        left, level, parts = now.where("open"), level + 1, -(-parts // group)
        now = written(merged(left, level, parts == 1, size, windows, group), "merged")
        out = out.unionByName(now.where("not open"))
        if parts == 1:
            return out.drop("part", "open")


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, ids and length of each sequence, with where its pieces start: what a training job reads."""
    each = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("x"), F.sum("length").alias("length"))
    joined = F.aggregate("x", F.lit(b""), lambda s, p: F.concat(s, p["ids"]))
    return each.select("sequence_id", joined.alias("ids"), "length", F.transform("x", lambda p: p["offset"]).alias("starts"))


def op11(docs: DataFrame) -> DataFrame:
    return packed(docs).withColumn("ids_crc32", F.crc32("ids")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
