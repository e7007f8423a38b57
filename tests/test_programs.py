"""Queries of sources, sinks and programs against their SQL."""

import duckdb
import pytest

from gridloom.plans import programs
from test_catalog import plain


@pytest.mark.parametrize("name", list(programs.QUERIES))
def test_query(spark, sf_dir, name):
    df = programs.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    found = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    assert found
    if name not in programs.SQL:
        return
    db = duckdb.connect()
    for t in ("lineitem", "events", "part"):
        db.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    run = db.execute(programs.SQL[name])
    names = [d[0] for d in run.description]
    assert sorted(names) == columns
    expected = [tuple(plain(dict(zip(names, r))[c]) for c in columns) for r in run.fetchall()]
    assert sorted(found, key=str) == sorted(expected, key=str)
