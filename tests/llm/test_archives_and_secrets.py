import base64
import hashlib
import io
import random
import re

import pytest

pytest.importorskip("gridloom.llm")

from data import frame, plain
from gridloom.llm import secret_scan, warc
from gridloom.llm.common import written

BASE = [
    ("assign", re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
]


def brute(text):
    found = sorted((m.start(), k, m.end()) for k, (_, p, g, n) in enumerate(BASE) for m in p.finditer(text or "") if len(m.group(g)) >= n)
    return [sum(x[1] == k for x in found) for k in range(3)], ",".join(f"{BASE[k][0]}:{a}:{b}" for a, k, b in found)


def texts(n=120):
    rnd = random.Random(3)
    parts = ["token", "=", ": ", '"', "'", "secret", "API_KEY", "api key", "abc", "abcdef12", " ", "\n", "é", "🎉", "AKIA", "ABCDEFGHIJKLMNOP12", "deadbeef", "0123456789abcdef" * 2, "Passwd", "ghp_" + "a1" * 18, "xoxb-1234567890-abc", "==", "ſecret"]
    return [(i, "".join(rnd.choice(parts) for _ in range(rnd.randrange(0, 40)))) for i in range(n)] + [(200, None), (201, ""), (None, "token=abcdef"), (202, "token=abcdef"), (202, "token=abcdef"), (203, "secret=token = abcdefgh")]


def test_secrets(spark):
    rows = texts()
    got = secret_scan.op10(frame(spark, rows)).collect()
    expected = [(i, *brute(t)[0], hashlib.sha256(brute(t)[1].encode()).hexdigest()) for i, t in rows]
    assert plain(r[:5] for r in got) == plain(expected)
    for r in got:
        base = [x for x in r["spans"].split(",") if x.split(":")[0] in ("assign", "access", "hex")]
        assert hashlib.sha256(",".join(base).encode()).hexdigest() == r["base_sha256"]
    assert any("github:" in r["spans"] for r in got) and any("slack:" in r["spans"] for r in got)
    assert secret_scan.op10(frame(spark, [])).count() == 0


def test_only_unseen_pairs_are_scanned(spark):
    rows = texts()
    old, new = frame(spark, rows[:60]), frame(spark, rows)
    ledger = secret_scan.scan(old)
    more = secret_scan.scan(new, ledger)
    assert ledger.select("blob", "rule").intersect(more.select("blob", "rule")).count() == 0
    both = written(ledger.unionByName(more))
    assert secret_scan.scan(new, both).count() == 0
    assert plain(map(str, secret_scan.located(new, both).collect())) == plain(map(str, secret_scan.located(new, secret_scan.scan(new)).collect()))
    newer = tuple(secret_scan.Rule(**{**r.__dict__, "version": 2}) if r.name == "hex" else r for r in secret_scan.RULES)
    assert {r["rule"] for r in secret_scan.scan(new, both, newer).select("rule").distinct().collect()} == {"hex"}


def test_archives(spark):
    rows = [(i, f"http://x/{i}", f"<p>{i % 7} é</p>" * (i % 9)) for i in range(80)] + [(900, "u", None), (901, None, ""), (902, "u", "twice"), (902, "u", "twice"), (None, "u", "twice"), (None, "u", "alone")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS last", "1 AS size", "'y' AS digest")
    last: dict = {}
    for i, _, h in rows:
        if i is not None:
            last[h or ""] = max(i, last.get(h or "", i))
    expected = []
    for i, _, h in rows:
        data, top = (h or "").encode(), last.get(h or "")
        again = top is not None and (i is None or i < top)
        expected.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", top if again else None))
    got = warc.op6(spark, df).collect()
    assert plain(r[:5] for r in got) == plain(expected)
    assert warc.op6(spark, df.limit(0)).count() == 0


@pytest.mark.parametrize("packed", [True, False])
def test_salvage(packed):
    rnd = random.Random(1)
    records = [warc.record(i, f"u{i}", rnd.randbytes(rnd.randrange(0, 5000)), None, False) for i in range(50)]
    parts = [warc.member(r) if packed else r for r in records]
    starts = [sum(map(len, parts[:k])) for k in range(len(parts))]
    data = bytearray(b"".join(parts))
    for k in (3, 20, 21, 44):
        data[starts[k] + len(parts[k]) // 2] ^= 0x41
    data = b"noise before" + bytes(data[:-9])
    found = list(warc.salvaged(io.BytesIO(data).read))
    ids = [warc.page_of(r.headers["warc-record-id"]) for _, _, r, _ in found if r]
    assert ids == [k for k in range(50) if k not in (3, 20, 21, 44, 49)]
    gaps = [(a, n) for a, n, r, _ in found if not r]
    assert gaps[0] == (0, 12) and (starts[3] + 12, len(parts[3])) in gaps and (starts[20] + 12, len(parts[20]) + len(parts[21])) in gaps
    assert sum(n for _, n, _, _ in found) == len(data)
    assert list(warc.salvaged(io.BytesIO(b"").read)) == []
    assert [x[3] for x in warc.salvaged(io.BytesIO(b"not an archive").read)] == ["version line"]


def test_any_url_is_read_back(spark):
    urls = ["http://x/" + "long" * 50000, "http://x/\r\n\r\nWARC/1.1\r\n", "http://x/a\nb\tc\x00", "\r\n", ":", None]
    df = spark.createDataFrame([(i, u, f"page {i}") for i, u in enumerate(urls)], "page_id long, url string, html string")
    assert sorted(r["page_id"] for r in warc.op6(spark, df).collect()) == list(range(len(urls)))
    for pack in (warc.member, bytes):
        data = b"".join(pack(warc.record(i, u or "", b"page", None, False)) for i, u in enumerate(urls))
        found = list(warc.salvaged(io.BytesIO(data).read))
        assert [r and warc.page_of(r.headers["warc-record-id"]) for _, _, r, _ in found] == list(range(len(urls)))
        assert found[0][2].headers["warc-target-uri"] == urls[0] and found[2][2].headers["warc-target-uri"] == "http://x/a%0Ab%09c%00"


def test_a_text_full_of_findings(spark):
    """Time follows the number of findings: a hundred thousand in one text, and every span where it is."""
    import time

    n = 100_000
    text = " ".join(f"é{i} token=abcdef{i}" for i in range(n))
    docs = spark.createDataFrame([(1, text), (2, "token=abcdefg")], "doc_id long, text string")
    began = time.time()
    rows = {r["doc_id"]: r for r in secret_scan.op10(docs).collect()}
    assert time.time() - began < 120
    at, want = 0, []
    for i in range(n):
        start = at + len(f"é{i} ")
        at = start + len(f"token=abcdef{i}") + 1
        want.append(f"assign:{start}:{at - 1}")
    assert rows[1]["spans"] == ",".join(want) and rows[1]["n_assign"] == n and rows[2]["spans"] == "assign:0:13"
