"""Every query against its DuckDB twin on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from ledgerloom.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    return f"{float(value):.9g}" if isinstance(value, (int, float)) else str(value)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_equals_the_oracle(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    names = sorted(df.columns)
    got = sorted(tuple(plain(r[n]) for n in names) for r in df.collect())
    rel = duck.execute(registry.oracle_sql()[name])
    held = [c[0] for c in rel.description]
    assert sorted(held) == names
    want = sorted(tuple(plain(r[held.index(n)]) for n in names) for r in rel.fetchall())
    assert got == want
