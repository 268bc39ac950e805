"""Every query of the memory engine against its SQL, on the smallest tables."""

import duckdb
import pytest

from loomstead import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(values, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted(tuple(repr(plain(r[i])) for i in order) for r in values)


@pytest.mark.parametrize("name", sorted(catalog.oracles()))
def test_query_matches_sql(spark, db, name):
    got = catalog.queries()[name](spark, SF)
    want = db.sql(catalog.oracles()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows([tuple(r) for r in got.collect()], got.columns) == rows(want.fetchall(), want.columns)
