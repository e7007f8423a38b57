"""Small documents with every awkward case: nulls, empty and long texts, copies, repeated rows, other columns with clashing names."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASH = ["key", "node", "hash", "n", "label", "lines", "row", "blob", "bucket", "words", "text_", "component"]


def low(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def prose(rnd, n, vocabulary=4000):
    out = []
    for k in range(n):
        out.append(f"w{rnd.randrange(vocabulary)}" + (".\n" if k % 11 == 10 else "." if k % 7 == 6 else ""))
    return " ".join(out).replace(".\n ", ".\n")


def documents(seed=5, n=60):
    rnd = random.Random(seed)
    rows = [(i, prose(rnd, rnd.randrange(1, 200))) for i in range(n)]
    shared = prose(rnd, 70)
    rows += [(100 + i, prose(rnd, 40) + " " + shared + " " + prose(rnd, 40)) for i in range(6)]
    base = prose(rnd, 150)
    for i in range(12):
        words = base.split(" ")
        for _ in range(i % 4):
            words[rnd.randrange(len(words))] = f"e{rnd.randrange(9999)}"
        rows.append((200 + i, " ".join(words)))
    rows += [(300, "A b c"), (301, "a  B c"), (302, "one"), (303, ""), (304, None), (None, "null id text here"), (None, None), (305, "é 日本 🎉 \x1c z\tq\x0bend"), (306, "x " * 6000)]
    rows += [(307, "same row text. " * 5)] * 3
    return rows


def frame(spark, rows=None):
    """doc_id and text, with other columns whose names operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(documents() if rows is None else rows, "doc_id long, text string")
    return df.withColumns({c: F.lit("other") for c in CLASH})


def plain(rows):
    return sorted((tuple(r) for r in rows), key=repr)
