"""The SQL of one split's Shapley values to all six digits, where a mean of rounded weights is another number."""

import duckdb

from tessera.plans import registry

SF = "/root/testdata/sf0.01"


def test_values_of_a_split_equal_the_sql_to_six_digits(spark):
    con = duckdb.connect()
    con.sql(f"create view lineitem as select * from '{SF}/lineitem.parquet'")
    want = con.sql(f"select distinct value, mean from ({registry.oracle_sql()['boost_shapley_split']})").fetchall()
    got = registry.queries()["boost_shapley_split"](spark, SF).select("value", "mean").distinct().collect()
    assert sorted(tuple(r) for r in got) == sorted(want)
