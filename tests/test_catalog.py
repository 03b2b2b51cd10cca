import duckdb
import pytest

import __spark_entry__ as entry
from tessella.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    assert rows
    if name in catalog.ORACLE_SQL:
        got = duck.execute(catalog.ORACLE_SQL[name])
        names = [d[0] for d in got.description]
        assert sorted(names) == columns
        want = [tuple(plain(r[names.index(c)]) for c in columns) for r in got.fetchall()]
        assert sorted(map(repr, rows)) == sorted(map(repr, want))


def test_entry(spark):
    assert entry.entry(spark).count() == 40
    assert set(entry.oracle_sql()) <= set(entry.queries())
