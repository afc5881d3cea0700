"""The operators' queries that have SQL give its rows, with its columns and no others."""

import math

import pytest

from hammerfield.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ["documents", "embeddings", "pages", "benchmark", "labels"]


def plain(v):
    if isinstance(v, float):
        return "∅" if math.isnan(v) else f"{v + 0.0:.6g}"
    return "∅" if v is None else str(v)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    found = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(tuple(plain(r[c]) for c in names) for r in df.collect()) == sorted(tuple(map(plain, r)) for r in found.fetchall())
