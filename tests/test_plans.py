"""Every catalogued query against its SQL, on the smallest tables."""

import duckdb
import pytest

from veilspark.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module", autouse=True)
def detected_once(spark):
    """Queries over notes share them, detected."""
    made, first = {}, catalog._notes

    def notes(session, sf):
        if sf not in made:
            made[sf] = first(session, sf).cache()
        return made[sf]

    catalog._notes = notes
    yield
    catalog._notes = first


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())
    rel = duck.sql(ORACLES[name])
    assert sorted(rel.columns) == cols
    assert got == sorted(repr(tuple(dict(zip(rel.columns, x))[c] for c in cols)) for x in rel.fetchall())
