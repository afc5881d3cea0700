"""Every registered query that has SQL gives the rows that SQL gives on the same tables."""

import math
from decimal import Decimal

import pytest

from hammerfield.plans.registry import ORACLE_SQL, QUERIES, load

load()
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None:
        return "∅"
    if isinstance(v, (float, Decimal)):
        return "∅" if math.isnan(v) else f"{float(v) + 0.0:.6g}"  # -0.0 equals 0.0
    return v.isoformat().replace("+00:00", "") if hasattr(v, "isoformat") else str(v)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    if name in ORACLE_SQL:
        found = duck.execute(ORACLE_SQL[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == sorted(df.columns)
        assert sorted(tuple(plain(r[c]) for c in names) for r in rows) == sorted(tuple(map(plain, r)) for r in found.fetchall())
    else:
        assert rows


def test_entry_and_names(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns
    assert __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()
