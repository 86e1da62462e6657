"""Every query of the catalogue against its SQL."""

import duckdb
import pytest

from folioscan.plans import catalogue, index_queries

QUERIES, ORACLE_SQL = catalogue.QUERIES | index_queries.QUERIES, catalogue.ORACLE_SQL | index_queries.ORACLE_SQL
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    rows = [tuple(r[c] for c in columns) for r in df.collect()]
    if name not in ORACLE_SQL:
        assert rows
        return
    result = duck.execute(ORACLE_SQL[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    expected = [tuple(r[names.index(c)] for c in columns) for r in result.fetchall()]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(rows, key=key) == sorted(expected, key=key)


def test_oracles_have_queries():
    assert set(ORACLE_SQL) <= set(QUERIES)
