"""Byte-level BPE through a sentencepiece model that is serialised straight from a rank file; nothing is trained.

Every byte sequence of the vocabulary becomes a piece in which each byte stands as one printable character; its score is
its negative rank, so that sentencepiece merges in rank order. The model's normaliser changes nothing. Pre-tokens are
encoded one by one; ids are decoded by the inverse mapping of their pieces.

Defined cases: a null text is empty and has no ids; repeated rows are encoded alike, row by row; other columns are
ignored; an empty table gives an empty result. One pass without a shuffle; memory follows the longest single text.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, sliced, texts
from .pretokens import Kept, pretokens, stretches

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_chars() -> list[str]:
    """A printable character for each byte: itself where it is one, else the next from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def varint(n: int) -> bytes:
    out = bytearray()
    n &= (1 << 64) - 1
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def field(number: int, value: int | float | bytes) -> bytes:
    """A protobuf field: a varint, a 32-bit float or bytes."""
    if isinstance(value, bytes):
        return varint(number << 3 | 2) + varint(len(value)) + value
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    return varint(number << 3) + varint(value)


def ranks_of(path: str) -> list[bytes]:
    """The vocabulary's byte sequences in rank order."""
    with open(path, "rb") as file:
        pairs = [line.split() for line in file if line.strip()]
    found = {int(rank): base64.b64decode(piece) for piece, rank in pairs}
    return [found[i] for i in range(len(found))]


def serialised(vocabulary: list[bytes]) -> bytes:
    """A sentencepiece ModelProto: pieces (1), trainer (2: type BPE, unknown last) and normaliser (3: identity)."""
    chars = byte_chars()
    out = [field(1, field(1, "".join(chars[b] for b in piece).encode()) + field(2, float(-rank)) + field(3, 1)) for rank, piece in enumerate(vocabulary)]
    out.append(field(1, field(1, b"<unk>") + field(2, float(-len(vocabulary))) + field(3, 2)))
    trainer = field(3, 2) + field(4, len(vocabulary) + 1) + field(40, len(vocabulary)) + field(41, -1) + field(42, -1) + field(43, -1)
    normaliser = field(1, b"identity") + field(3, 0) + field(4, 0) + field(5, 0)
    return b"".join([*out, field(2, trainer), field(3, normaliser)])


class Codec:
    """Encodes texts to ids and decodes ids to bytes."""

    def __init__(self, path: str):
        import sentencepiece

        vocabulary = ranks_of(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialised(vocabulary))
        self.whole = {piece: rank for rank, piece in enumerate(vocabulary)}
        self.chars = byte_chars()
        back = {c: b for b, c in enumerate(self.chars)}
        self.bytes_of = [bytes(back[c] for c in self.model.id_to_piece(i)) for i in range(len(vocabulary))]
        self.kept = Kept(lambda x: np.array([i for t in pretokens(x) for i in self.pretoken(t)], "<u4").tobytes())

    def pretoken(self, text: str) -> list[int]:
        raw = text.encode()
        if (rank := self.whole.get(raw)) is not None:  # a pre-token that is a piece is that piece
            return [rank]
        return self.model.encode("".join([self.chars[b] for b in raw]))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        found = stretches(text)
        if found is None:
            return np.array([i for t in pretokens(text) for i in self.pretoken(t)], "<u4").tobytes()
        return b"".join(map(self.kept.__getitem__, found))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.cache
def codec(path: str) -> Codec:
    return Codec(path)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoded(docs: DataFrame, path: str | None = None, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, digests of ids and decoded bytes, and on request the ids and the decoded bytes themselves."""
    path = path or vocabulary_path()
    schema = SCHEMA + (", ids binary, decoded binary" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in sliced(batches, "text"):
            ids = [own.encode(t) for t in texts(batch.column("text")).to_pylist()]
            back = [own.decode(x) for x in ids]
            columns = [batch.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()), pa.array([hashlib.sha256(x).hexdigest() for x in back], pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns += [pa.array(ids, pa.binary()), pa.array(back, pa.binary())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return only(docs, doc_id="long", text="string").mapInArrow(run, schema)


def decoded(ids: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and the decoded bytes of rows of doc_id and ids; null ids give no bytes."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            back = [own.decode(x or b"") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(back, pa.binary())], ["doc_id", "decoded"])

    return ids.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("binary").alias("ids")).mapInArrow(run, "doc_id long, decoded binary")


def op7(docs: DataFrame) -> DataFrame:
    return encoded(docs, with_ids=False)
