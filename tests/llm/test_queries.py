"""Queries over a whole test folder, against their SQL; the pipeline against brute force stage by stage."""

import hashlib

import duckdb
import pytest

pytest.importorskip("gridloom.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

import numpy as np

from gridloom.llm import byte_bpe, jaccard_join, quality_rules
from gridloom.llm.queries import QUERIES, SQL


def plain(rows):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", list(SQL))
def test_sql(spark, sf_dir, name):
    db = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "embeddings"):
        db.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    run = db.execute(SQL[name])
    columns = [d[0] for d in run.description]
    got = QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(columns)
    assert plain(got.select(*columns).collect()) == plain(run.fetchall())


def test_every_operator_has_a_query():
    assert [int(n[2:].split("_")[0]) for n in QUERIES] == list(range(1, 14))


def test_pipeline(spark, sf_dir):
    """Each stage on the one before it: quality by the judge, one document of each class, no test item left, ids that decode."""
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    first = stages["quality rules"](spark, docs, sf_dir)
    judged = {i: quality_rules.judge(t) for i, t in texts.items()}
    assert {r["doc_id"]: r["text"] for r in first.collect()} == {i: v[10] for i, v in judged.items() if v[6]}
    assert first.schema == docs.schema
    out = corpus_pipeline.run(spark, sf_dir)
    rows = out.collect()
    ids = [r["doc_id"] for r in rows]
    assert len(ids) == len(set(ids)) and set(ids) <= {i for i, v in judged.items() if v[6]}
    second = stages["line dedup"](spark, first, sf_dir)
    cleaned = {r["doc_id"]: r["text"] for r in second.collect()}
    classes = {r["doc_id"]: r["component_id"] for r in jaccard_join.clustered(second, 5, 80, 100).collect()}
    assert len({classes[i] for i in ids}) == len(ids)
    items = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    words = lambda t: " ".join("".join(c if c.isalnum() else " " for c in t.lower()).split())
    dirty = {i for i in cleaned if any(words(x) in words(cleaned[i]) for x in items)}
    assert not dirty & set(ids)
    assert set(classes.values()) == {classes[i] for i in ids} | {classes[i] for i in dirty}
    for r in rows:
        assert bytes(r["decoded"]).decode() == cleaned[r["doc_id"]]
        assert r["n_tokens"] * 4 == len(r["ids"]) and hashlib.sha256(r["ids"]).hexdigest() == r["ids_sha256"]
        assert int(np.frombuffer(r["ids"], "<u4").max(initial=0)) < len(byte_bpe.ranks_of(byte_bpe.vocabulary_path()))
