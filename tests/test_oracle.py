"""Every registered reference query against its DuckDB twin on the smallest tables."""

import os

import duckdb
import pytest

from corpusloom.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}/*' )" if os.path.isdir(path) else f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def shown(v):
    return "null" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(shown(r[c]) for c in columns) for r in df.collect())
    assert got
    if name in registry.oracle_sql():
        result = duck.execute(registry.oracle_sql()[name])
        names = [x[0] for x in result.description]
        assert sorted(names) == columns
        assert got == sorted(tuple(shown(row[names.index(c)]) for c in columns) for row in result.fetchall())
