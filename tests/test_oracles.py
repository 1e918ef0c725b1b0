"""Every query that has SQL, against DuckDB at the smallest scale; the others must run."""

import math

import duckdb
import pytest

from tidemark.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    ours = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name not in registry.ORACLES:
        return
    cursor = duck.execute(registry.ORACLES[name])
    names = [x[0] for x in cursor.description]
    theirs = sorted((tuple(plain(dict(zip(names, r))[c]) for c in cols) for r in cursor.fetchall()), key=repr)
    assert sorted(names) == cols
    assert ours == theirs
