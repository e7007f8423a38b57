"""Pre-tokens of the byte-level vocabularies: the split by public_tokenizers.PATTERN, made once for each distinct stretch of text.

A text is cut at blanks. A stretch that starts with a character that is no white space has the same pre-tokens with any
neighbours, so its split can be kept; a text with another stretch is split as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import public_tokenizers
import regex

SPLIT = regex.compile(public_tokenizers.PATTERN)


def stretches(text: str) -> list[str] | None:
    """Stretches whose pre-tokens can be put together, each but the first with the blank before it; None if there are none such."""
    if not text:
        return []
    first, *rest = text.split(" ")
    if not first or first[0].isspace() or any(not x or x[0].isspace() for x in rest):
        return None
    return [first, *[" " + x for x in rest]]


def pretokens(text: str) -> list[str]:
    return SPLIT.findall(text)


class Kept(dict):
    """What `make` gives for a key, kept until `most` keys are held; then it starts anew, so memory is bounded."""

    def __init__(self, make, most: int = 200_000):
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.make(key)
        return value


def parts(text: str) -> Iterator[str]:
    """Pre-tokens of a whole text, in order."""
    found = stretches(text)
    if found is None:
        yield from pretokens(text)
    else:
        for x in found:
            yield from pretokens(x)
