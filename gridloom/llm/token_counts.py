"""Token counts without token ids.

Each block of documents keeps its pre-token frequencies over its own dictionary; the library counts the pieces of every
distinct pre-token of all blocks once; the counts are joined back and summed as frequency times pieces. Special strings
inside texts are cut out first and count as one token each, which is the library's default.

Defined cases: a null text is empty and has 0 tokens; repeated rows and repeated ids are counted row by row; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import blocks
from .common import texts, written
from .pretokens import Kept, pretokens, stretches

LIMIT = 1024
#: Pre-tokens of its parts that a task remembers before it starts anew.
MOST_KEPT = 500_000
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


@functools.cache
def library(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.no_truncation()
    own.no_padding()
    return own


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def specials(path: str) -> list[str]:
    return [x.content for x in library(path).get_added_tokens_decoder().values()]


def frequencies(docs: DataFrame, path: str | None = None, size: int = blocks.BLOCK_BYTES) -> DataFrame:
    """Blocks of pre-token frequencies; the special strings of a document are only counted."""
    path = path or vocabulary_path()

    def read(block: blocks.Block, batch: pa.RecordBatch) -> None:
        import regex

        def coded(text: str) -> np.ndarray:
            return np.array([block.tokens[t.encode()] for t in pretokens(text)], np.int32)

        if block.met is None:
            block.met = Kept(coded)
        marks = specials(path)
        cut = regex.compile("|".join(map(regex.escape, marks))) if marks else None
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch.column("text")).to_pylist()):
            n, parts = 0, [text]
            if cut is not None and any(m in text for m in marks):
                parts = cut.split(text)
                n = len(parts) - 1
            codes = []
            for part in parts:
                found = stretches(part)
                codes += [coded(part)] if found is None else map(block.met.__getitem__, found)
            block.add(np.concatenate([np.zeros(0, np.int32), *codes]), doc_id=doc_id, n_bytes=len(text.encode()), special=n)

    return blocks.build(docs, read, {"doc_id": "long", "n_bytes": "long", "special": "long"}, size=size)


def pieces(parts: DataFrame, path: str | None = None) -> DataFrame:
    """block, part and the number of pieces of each token; the library counts a distinct pre-token once in its part's task."""
    path = path or vocabulary_path()

    def value():
        own, kept = library(path), {}

        def count(tokens: list[bytes]) -> list[int]:
            if fresh := [t for t in tokens if t not in kept]:
                if len(kept) > MOST_KEPT:
                    kept.clear()
                    fresh = tokens
                kept.update(zip(fresh, (len(x.ids) for x in own.encode_batch_fast([t.decode() for t in fresh], add_special_tokens=False))))
            return [kept[t] for t in tokens]

        return count

    return blocks.answered(parts, value)


def counted(docs: DataFrame, path: str | None = None, limit: int = LIMIT, size: int = blocks.BLOCK_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_tokens and whether n_tokens is over the limit."""
    held = written(frequencies(docs, path, size), "pretokens")

    def make(x: dict, rows: np.ndarray, codes: np.ndarray, counts: np.ndarray, value: np.ndarray) -> dict:
        n = np.zeros(x["n"], np.int64)
        np.add.at(n, rows, counts * value[codes])
        n += x["special"].to_numpy()
        return {"doc_id": x["doc_id"], "n_bytes": x["n_bytes"], "n_tokens": pa.array(n), "over_limit": pa.array(n > limit)}

    return blocks.summed(held, pieces(blocks.parts(held), path), make, ["doc_id", "n_bytes", "special"], SCHEMA)


def op5(docs: DataFrame) -> DataFrame:
    return counted(docs)
