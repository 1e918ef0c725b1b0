"""The cross grid holds every customer and quarter."""

import duckdb

from tidemark.plans import registry, relational

SF = "/root/testdata/sf0.001"


def test_cross_grid_is_whole(spark):
    got = registry.QUERIES["join_cross_grid"](spark, SF).collect()
    c = duckdb.connect()
    for t in ("customer", "orders"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = c.execute(relational._GRID).fetchall()
    assert len({(r.c_custkey, r.q) for r in got}) == len(got)
    assert sorted((r.c_custkey, r.q, r.n) for r in got) == sorted((k, q, n) for k, q, n, _ in want)
    assert all(abs(a - b) < 0.011 for a, b in zip([r.v for r in sorted(got)], [float(r[3]) for r in sorted(want)]))
