"""Every registered query with SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

from tessera.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(rows):
    return sorted((tuple(None if v is None else round(v, 4) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, db, name):
    mine = registry.queries()[name](spark, SF)
    theirs = db.sql(registry.oracle_sql()[name])
    columns = sorted(mine.columns)
    assert columns == sorted(theirs.columns)
    order = ", ".join(f'"{c}"' for c in columns)
    assert plain(tuple(r) for r in mine.select(columns).collect()) == plain(db.sql(f"select {order} from ({registry.oracle_sql()[name]})").fetchall())
