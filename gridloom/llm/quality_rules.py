"""Line-first quality rules.

Each line of a text is judged on its own by three rules: punctuation, navigation and boilerplate. Lines that fail
are removed; a document that loses more than `max_lost` of its non-blank characters, or fails the base rule, is rejected.
Python runs over Arrow slices in one pass without any shuffle; memory follows the longest single text.

Defined cases: a null text is empty; an empty text has no words, fails the base rule and is rejected; repeated rows are
judged alike, row by row; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, sliced, texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOL = re.compile(r"[#*$%&|<>]")
#: Characters after which a line counts as a finished sentence, closing quotes and brackets aside.
FINAL = tuple(".!?:;…。！？")
CLOSING = "\"')]”’»"
SEPARATOR = re.compile(r"[|»›•·>]")
#: Phrases that mark a line as boilerplate, in English, German, French and Spanish.
BOILERPLATE = re.compile(
    r"licensed under|all rights reserved|spdx-license|copyright \(c\)|©|cookie policy|use of cookies|privacy policy|terms of (?:use|service)|enable javascript|subscribe to our|sign up for our|click here|lorem ipsum|powered by"
    r"|lizenziert unter|alle rechte vorbehalten|cookie-richtlinie|datenschutzerklärung|nutzungsbedingungen|javascript aktivieren|newsletter abonnieren|hier klicken"
    r"|sous licence|tous droits réservés|politique de cookies|politique de confidentialité|conditions d.utilisation|mentions légales|activer javascript|cliquez ici"
    r"|bajo licencia|todos los derechos reservados|política de cookies|política de privacidad|términos de uso|aviso legal|activar javascript|haga clic aquí"
)
#: Letters that count as a word in a line that is not written with blanks.
LETTERS = 12
MAX_LOST = 0.5

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lines long, n_removed_lines long, lost double, cleaned string"


def bad_line(line: str, last: bool = False) -> str | None:
    """The first rule that a line fails, or None; blank lines pass, and so does a last line of several sentences that was cut off."""
    body = line.strip()
    if not body:
        return None
    n = body.count(" ") + 1
    if len(SEPARATOR.findall(body)) * 3 >= n and n >= 3:
        return "navigation"
    if BOILERPLATE.search(body.lower()):
        return "boilerplate"
    if len(SYMBOL.findall(body)) * 2 > n and len(SYMBOL.findall(body)) >= 3 or body.count("!!") * 2 > n:
        return "punctuation"
    if max(n, len(body) // LETTERS) < 4 or body.rstrip(CLOSING).endswith(FINAL) or last and ". " in body:
        return None
    return "punctuation"


def repeat_words(words: list[str]) -> int:
    """Words inside 3-word windows that are found twice or more."""
    if len(words) < 4 or len(set(zip(words, words[1:], words[2:]))) == len(words) - 2:
        return 0
    seen = Counter(zip(words, words[1:], words[2:]))
    total, end = 0, 0
    for i, window in enumerate(zip(words, words[1:], words[2:])):
        if seen[window] > 1:
            total += i + 3 - max(i, end)
            end = i + 3
    return total


def judge(text: str, max_lost: float = MAX_LOST) -> tuple:
    """All columns of SCHEMA but doc_id."""
    words = WORD.findall(text)
    lines = text.split("\n")
    seen: set[str] = set()
    dup, keep, all_chars, lost_chars = 0, [], 0, 0
    for i, line in enumerate(lines, 1):
        chars = len(line) - line.count(" ")
        all_chars += chars
        if line in seen:
            dup += 1
        elif WORD.search(line):
            seen.add(line)
        if bad_line(line, i == len(lines)):
            lost_chars += chars
        else:
            keep.append(line)
    n, repeated = len(words), repeat_words(words)
    failed = n < 50 or 100 * repeated > 50 * n
    lost = lost_chars / all_chars if all_chars else 0.0
    return n, sum(map(len, words)), len(SYMBOL.findall(text)), dup, repeated, failed, not failed and lost <= max_lost, len(lines), len(lines) - len(keep), lost, "\n".join(keep)


def judged(docs: DataFrame, max_lost: float = MAX_LOST) -> DataFrame:
    """A row of SCHEMA for each document, with the text as cleaned."""
    schema = docs.sparkSession.createDataFrame([], SCHEMA).schema
    names = [f.name for f in schema][1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            rows = list(zip(*(judge(t, max_lost) for t in texts(batch.column("text")).to_pylist())))
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()] * 2 + [pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(r, k) for r, k in zip(rows, kinds)]], ["doc_id", *names])

    return only(docs, doc_id="long", text="string").mapInArrow(run, schema)


def op3(docs: DataFrame) -> DataFrame:
    return judged(docs).drop("cleaned")


def stage(docs: DataFrame, max_lost: float = MAX_LOST) -> DataFrame:
    """Documents that pass, with failing lines taken out of their texts; the columns of docs."""
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            found = [judge(t, max_lost) for t in texts(batch.column("text")).to_pylist()]
            mask = pa.array([r[6] for r in found], pa.bool_())
            cleaned = pa.array([r[10] for r in found], batch.column("text").type)
            at = batch.schema.get_field_index("text")
            new = batch.set_column(at, batch.schema.field(at), cleaned)
            if (at := batch.schema.get_field_index("n_chars")) >= 0:
                new = new.set_column(at, batch.schema.field(at), pa.array([len(r[10]) for r in found]).cast(batch.schema.field(at).type))
            yield new.filter(mask)

    return docs.mapInArrow(run, docs.schema).select(*[F.col(f"`{c}`") for c in columns])
