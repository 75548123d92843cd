import os

import duckdb
import pytest

from cairn.plans import catalogue

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def engine():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(x):
    return round(float(x), 6) + 0.0 if type(x).__name__ in ("float", "Decimal") else x


@pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, engine, name):
    df = catalogue.queries()[name](spark, DIR)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name in catalogue.oracle_sql():
        found = engine.sql(catalogue.oracle_sql()[name])
        assert sorted(found.columns) == columns
        at = [found.columns.index(c) for c in columns]
        assert rows == sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)
