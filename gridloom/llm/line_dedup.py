"""Repeated multi-line chunks across the corpus.

A text's lines are cut into chunks where the content says so: a rolling hash over the hashes of two lines (a rotation and
an exclusive or) is mixed, and a chunk starts at each line whose value is less than the one before it and no more than the
one after it. Such a boundary depends on four lines only, so text put in before it does not shift it, and no inner chunk
has less than two lines. A repeated block is found where both ends of a chunk are decided by its own lines, which takes six
lines at least (a cut depends on the two lines before it, its own and the next); in shorter blocks only chunks are found
whose cuts happen to agree outside of the block too, and no number of lines makes a find certain.

Chunks of at least two lines that are not blank and MIN_CHARS characters are counted over all documents by their hash. Those
that come again are compared byte for byte by grouping them on hash and body, so that of the copies in one task one body
travels, however common the chunk is. The first of a chunk (by document, then by place) stays, the others are removed.
Chunks of other bytes than the first's under the same hash stay.

Only DataFrame functions run. What is shuffled for all documents is a hash for each chunk. The places of the removed chunks
are broadcast to the texts if a count shows that they are few enough; else the texts that hold one move, once.

Defined cases: a null or empty text is one blank line and stays empty; a null doc_id comes back as null; repeated rows (the
same doc_id and text) are one document and come back cleaned alike; rows that share a doc_id but not the text are cleaned
each by its own chunks; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .decontaminate import MOST_KEYS, small

MIN_CHARS = 60


def body_hash(body: Column | str) -> Column:
    return F.xxhash64(body)


def rolled(hashes: Column) -> Column:
    """The rolling hash at each line: its hash and the rotated one before it, mixed."""

    def at(i):
        before = F.coalesce(F.get(hashes, i - 1), F.lit(0).cast("long"))
        turned = F.shiftleft(before, 1).bitwiseOR(F.shiftrightunsigned(before, 63))
        return F.xxhash64(turned.bitwiseXOR(F.get(hashes, i)))

    return F.transform(F.sequence(F.lit(0), F.size(hashes) - 1), at)


def starts(values: Column) -> Column:
    """The lines at which chunks start."""

    def cut(v, i):
        return (i == 0) | ((v < F.get(values, i - 1)) & (v <= F.coalesce(F.get(values, i + 1), F.lit(2**63 - 1))))

    flagged = F.transform(values, lambda v, i: F.when(cut(v, i), i))
    return F.filter(flagged, lambda i: i.isNotNull())


def with_lines(docs: DataFrame) -> DataFrame:
    """key, version and lines. key stands for the document also where doc_id is null; version tells texts apart that share it."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(text)).alias("key"), F.xxhash64(text).alias("version"), F.split(text, "\n", -1).alias("lines"))


def chunks(own: DataFrame, *keep: str) -> DataFrame:
    """The kept columns and, a row for each chunk that may be removed at all, first (its first line), n_lines and body."""
    hashes = own.select(*keep, "lines", F.transform("lines", lambda x: F.xxhash64(x)).alias("hashes"))
    cut = hashes.select(*keep, "lines", rolled(F.col("hashes")).alias("rolled")).select(*keep, "lines", starts(F.col("rolled")).alias("starts"))
    n = F.size("lines")
    parts = F.transform("starts", lambda s, j: F.struct(s.alias("first"), (F.coalesce(F.get("starts", j + 1), n) - s).alias("n_lines")))
    whole = F.transform(parts, lambda p: F.struct(p["first"].alias("first"), p["n_lines"].alias("n_lines"), F.transform(F.sequence(p["first"], p["first"] + p["n_lines"] - 1), lambda i: F.get("lines", i)).alias("own")))
    # Line by line: a pattern over the whole chunk would take time with the square of a long line.
    enough = F.filter(whole, lambda p: F.size(F.filter(p["own"], lambda x: x.rlike(r"\S"))) >= 2)
    bodies = F.transform(enough, lambda p: F.struct(p["first"].alias("first"), p["n_lines"].alias("n_lines"), F.array_join(p["own"], "\n").alias("body")))
    return cut.select(*keep, F.inline(F.filter(bodies, lambda p: F.length(p["body"]) >= MIN_CHARS)))


PLACE = ("key", "version", "first")


def repeated(docs: DataFrame) -> DataFrame:
    """key, version, first and n_lines of every chunk that equals an earlier one; a written table."""
    own = with_lines(docs)
    slim = written(chunks(own, "key", "version").select(*PLACE, "n_lines", body_hash("body").alias("hash")), "chunks")
    again = written(slim.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"), "again")
    held = written(slim.join(small(again, MOST_KEYS), "hash").distinct(), "candidates")
    first = written(held.groupBy("hash").agg(*[F.min(F.struct(*PLACE)).alias("x"), F.count("*").alias("n")]).where("n > 1").select("hash", "x.*"), "firsts")
    keys = written(held.select("key").distinct(), "keys")
    texts = own.join(small(keys, MOST_KEYS), "key", "left_semi")
    bodies = chunks(texts, *PLACE[:2]).withColumn("hash", body_hash("body"))
    named = small(first.select("hash"), MOST_KEYS)
    several = bodies.join(named, "hash", "left_semi").groupBy("hash", "body").agg(F.count("*").alias("n")).groupBy("hash").agg(F.count("*").alias("n")).where("n > 1")
    mixed = written(several.select("hash"), "mixed")
    later = held.join(small(first.select("hash", *[F.col(c).alias(f"{c}_0") for c in PLACE]), MOST_KEYS), "hash").where("not (key = key_0 and version = version_0 and first = first_0)")
    same = later.join(small(mixed, MOST_KEYS), "hash", "left_anti").select(*PLACE, "n_lines")
    if not mixed.isEmpty():  # other bytes under one hash: only those of the first's body go
        body = written(bodies.join(small(mixed, MOST_KEYS), "hash", "left_semi").distinct(), "bodies")
        one = body.join(first, ["hash", *PLACE]).select("hash", F.col("body").alias("origin"), *[F.col(c).alias(f"{c}_0") for c in PLACE])
        same = same.union(body.join(one, "hash").where("body = origin and not (key = key_0 and version = version_0 and first = first_0)").select(*PLACE, "n_lines"))
    return written(same, "repeated")


def cleaned(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed_chunks, n_removed_lines, text without repeated chunks, and the row as it was."""
    gone = repeated(docs)
    lists = gone.groupBy("key", "version").agg(F.collect_list(F.struct("first", "n_lines")).alias("gone"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    row = F.struct(*[F.col(f"`{c}`").alias(c) for c in docs.columns])
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(text)).alias("key"), F.xxhash64(text).alias("version"), row.alias("row"))
    if gone.count() <= MOST_KEYS:
        both = own.join(F.broadcast(lists), ["key", "version"], "left")
    else:  # only texts that lose a chunk move
        keys = written(lists.select("key", "version"), "keys")
        both = own.join(keys, ["key", "version"], "left_anti").withColumn("gone", F.lit(None).cast("array<struct<first:int,n_lines:int>>")).union(own.join(keys, ["key", "version"], "left_semi").join(lists, ["key", "version"]).select("key", "version", "row", "gone"))
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    parts = both.select(F.col("row.doc_id").cast("long").alias("doc_id"), F.split(text, "\n", -1).alias("lines"), text.alias("text"), "row", F.coalesce("gone", F.array().cast("array<struct<first:int,n_lines:int>>")).alias("gone"))
    out = parts.withColumn("out", F.flatten(F.transform("gone", lambda g: F.sequence(g["first"], g["first"] + g["n_lines"] - 1))))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("out"))
    kept = F.when(F.size("out") == 0, F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n"))
    return out.select("doc_id", F.size("lines").alias("n_lines"), F.size("gone").alias("n_removed_chunks"), F.size("out").alias("n_removed_lines"), kept.alias("text"), "row")


def op8(docs: DataFrame) -> DataFrame:
    return cleaned(docs).drop("row")


def stage(docs: DataFrame) -> DataFrame:
    """All documents, without repeated chunks in their texts; the columns of docs."""
    new = {"text": F.col("text"), "n_chars": F.length("text")}
    kinds = {f.name: f.dataType for f in docs.schema}
    out = [new[c].cast(kinds[c]).alias(c) if c in new else F.col("row").getField(c).alias(c) for c in docs.columns]
    return cleaned(docs).select(*out)
