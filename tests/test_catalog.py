"""Every query of the catalog against its SQL."""

import math

import duckdb
import pytest

from gridloom.plans import catalog


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    return v if v is None or isinstance(v, str) else float(v)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    found = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    assert found
    if name not in catalog.SQL:
        return
    db = duckdb.connect()
    for t in ("lineitem", "events", "orders"):
        db.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    run = db.execute(catalog.SQL[name])
    names = [d[0] for d in run.description]
    assert sorted(names) == columns
    expected = [tuple(plain(dict(zip(names, r))[c]) for c in columns) for r in run.fetchall()]
    assert sorted(found, key=str) == sorted(expected, key=str)
