"""Every query with SQL, side by side on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from roadweave import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def base():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def rows(found):
    return sorted((tuple(round(x, 6) + 0.0 if isinstance(x, float) else x for x in r) for r in found), key=str)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows(spark, base, name):
    want = base.sql(queries.SQL[name])
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.select(*want.columns).collect()) == rows(want.fetchall())


def test_the_flagship_query(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["stream_thin", "infer_roads_kde"])
def test_others_run(spark, name):
    assert queries.QUERIES[name](spark, SF).count() >= 0
