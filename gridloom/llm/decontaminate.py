"""Benchmark decontamination: short test items found inside long documents.

A size-partitioned MinHash containment search. Test items are partitioned by their number of shingles, and each partition
gets a sketch of the least hashes of an item, bottom-k MinHash, with k the partition's own: of n shingles at most
n - ceil(t n) can be missing from a document that contains the item to the share t, so the k = n_max - ceil(t n_max) + 1 least
(or all of fewer) cannot all be missing, and no item is lost. A document is not sketched, since the resemblance of a short
item to a long document says nothing; its shingles are probed against the sketches, those of documents with fewer words
than the partition's least item aside. A candidate is then verified: the item's shingles, as text, are counted in the
document as text.

Only DataFrame functions run. The benchmark's sketches are broadcast if a count shows that they are small, else joined by
shuffles. Documents and items are compared as lower-case runs of letters and digits, so punctuation and line breaks do not
hide an item. An item of fewer than SHINGLE words is one shingle of its own length.

Defined cases: a null or empty text or item holds nothing and is found nowhere; a null doc_id or item_id is returned as
null; repeated rows are one document and one item; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

SHINGLE, SHARE = 5, 0.8
#: Rows of sketches or items that may be broadcast, and bytes of text in them.
MOST_ROWS, MOST_BYTES = 500_000, 32 << 20
#: Documents named in a broadcast set of keys.
MOST_KEYS = 2_000_000


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def sized(words: Column, k: Column | int, make) -> Column:
    """make(i) for each start i, from 1 on, of k consecutive words; null if there are fewer words."""
    k = F.lit(k) if isinstance(k, int) else k
    return F.when(F.size(words) >= k, F.transform(F.sequence(F.lit(1), F.size(words) - k + 1), make))


def shingle_texts(words: Column, k: Column) -> Column:
    """The distinct k-word shingles of an array of words, as text."""
    return F.array_distinct(F.coalesce(sized(words, k, lambda i: F.array_join(F.slice(words, i, k), " ")), F.array().cast("array<string>")))


def long_shingle_texts(words: Column, k: int) -> Column:
    """The same for long texts and a fixed k: slice() copies the whole array each time, get() does not."""
    found = sized(words, k, lambda i: F.concat_ws(" ", *[F.get(words, i + (j - 1)) for j in range(k)]))
    return F.array_distinct(F.coalesce(found, F.array().cast("array<string>")))


def shingle_hashes(words: Column, k: int) -> Column:
    """The hashes of all k-word shingles, repeated ones too; as hashed() gives them for their texts."""
    return F.coalesce(sized(words, k, lambda i: F.xxhash64(*[F.get(words, i + (j - 1)) for j in range(k)])), F.array().cast("array<bigint>"))


def items_of(benchmark: DataFrame, k: int = SHINGLE) -> DataFrame:
    """item, item_id, length (words in a shingle), n (distinct shingles) and, a row for each, shingle."""
    own = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.lower(F.col("text").cast("string")).alias("text"))
    own = own.withColumn("words", tokens(F.col("text"))).where(F.size("words") > 0)
    own = own.withColumn("length", F.least(F.lit(k), F.size("words"))).withColumn("item", F.xxhash64("item_id", F.array_join("words", " ")))
    own = own.dropDuplicates(["item"]).withColumn("shingles", shingle_texts(F.col("words"), F.col("length")))
    return own.select("item", "item_id", "length", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))


def hashed(shingle: Column, length: int) -> Column:
    parts = F.split(shingle, " ")
    return F.xxhash64(*[F.get(parts, F.lit(j)) for j in range(length)])


def sketches(items: DataFrame, share: float = SHARE, lengths: list[int] | None = None) -> DataFrame:
    """item, length, n and hash: the bottom-k hashes of each item, k by its size partition (powers of two)."""
    by_length = None
    for length in lengths or []:
        part = items.where(F.col("length") == length).select("item", "length", "n", hashed(F.col("shingle"), length).alias("hash"))
        by_length = part if by_length is None else by_length.union(part)
    band = F.pow(F.lit(2.0), F.ceil(F.log2(F.col("n").cast("double")))).cast("int")  # the partition's largest size
    k = band - F.ceil(F.lit(share) * band - 1e-9).cast("int") + 1
    grouped = by_length.groupBy("item", "length", "n").agg(F.array_sort(F.collect_set("hash")).alias("hashes"))
    return grouped.select("item", "length", "n", F.explode(F.slice("hashes", 1, k)).alias("hash"))


def documents_of(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.xxhash64(text)).alias("key"), text.alias("text"))


def small(df: DataFrame, most: int, text: str | None = None) -> DataFrame:
    """df, a written table, marked for broadcast if its count, and the bytes of its text column if it has one, allow."""
    rows, size = df.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)) if text else F.lit(0)).first()
    return F.broadcast(df) if rows <= most and size <= MOST_BYTES else df


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, k: int = SHINGLE) -> DataFrame:
    """doc_id, key, item_id, n_shingles, n_found and containment of each document and item with containment of at least the share."""
    own = documents_of(docs)
    items = written(items_of(benchmark, k), "items")
    lengths = sorted(r[0] for r in items.select("length").distinct().collect())  # of 1 to k
    if not lengths:
        empty = F.lit(0).cast("long")
        return own.limit(0).select("doc_id", "key", empty.alias("item_id"), empty.alias("n_shingles"), empty.alias("n_found"), F.lit(0.0).alias("containment"))
    held = written(sketches(items, share, lengths), "sketches")
    by_hash = small(held, MOST_ROWS)
    with_words = own.select("key", tokens(F.col("text")).alias("words"))
    hits = None
    for length in lengths:
        # No filter on the number of words: it would be pushed down and split every text twice; fewer words have no shingles.
        probes = with_words.select("key", F.size("words").alias("size"), F.explode(shingle_hashes(F.col("words"), length)).alias("hash"))
        found = probes.join(by_hash.where(F.col("length") == length), "hash").where(F.col("size") - length + 1 >= F.ceil(F.lit(share) * F.col("n") - 1e-9)).select("key", "item")
        hits = found if hits is None else hits.union(found)
    candidates = written(hits.distinct(), "candidates")
    keys = written(candidates.select("key").distinct(), "keys")
    chosen = own.join(small(keys, MOST_KEYS), "key", "left_semi").dropDuplicates(["key", "text"])
    words = tokens(F.col("text"))
    parts = F.flatten(F.array(*[long_shingle_texts(F.col("words"), length) for length in lengths]))  # of other lengths: all different
    shown = chosen.select("doc_id", "key", F.xxhash64("text").alias("version"), words.alias("words")).select("doc_id", "key", "version", F.explode(parts).alias("shingle"))
    known = items.select("item", "item_id", "n", "shingle")
    matched = shown.join(small(known, MOST_ROWS, "shingle"), "shingle").join(candidates, ["key", "item"], "left_semi")
    counts = matched.groupBy("doc_id", "key", "version", "item", "item_id", "n").agg(F.count("*").alias("n_found"))
    contained = F.col("n_found") / F.col("n")
    return counts.where(contained >= share - 1e-12).select("doc_id", "key", "item_id", F.col("n").cast("long").alias("n_shingles"), "n_found", contained.alias("containment")).distinct()


def op1(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return contaminated(docs, benchmark).drop("key")


def stage(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents that hold no test item; the columns of docs."""
    columns = docs.columns
    bad = written(contaminated(docs, benchmark).select("key").distinct(), "contaminated")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(text)).alias("key"))
    return own.join(small(bad, MOST_KEYS), "key", "left_anti").select("row.*")
