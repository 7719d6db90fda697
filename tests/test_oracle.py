"""Every registered query against its DuckDB SQL on the smallest tables."""

import os

import duckdb
import pytest

from ethoframe.plans import registry

SF = os.environ.get("ETHOFRAME_SF", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(columns):
    names = sorted(columns)
    return names, sorted(tuple("~" if v is None else repr(v) for v in r) for r in zip(*(columns[n] for n in names), strict=True))


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, oracle, name):
    got = registry.queries()[name](spark, SF).toArrow().to_pydict()
    if name not in registry.oracle_sql():
        assert got
        return
    cursor = oracle.execute(registry.oracle_sql()[name])
    names, values = [d[0] for d in cursor.description], cursor.fetchall()
    want = {n: [v[i] for v in values] for i, n in enumerate(names)}
    assert rows(got) == rows(want)
