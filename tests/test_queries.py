"""Every query with an SQL twin gives the twin's rows."""

import pytest
from compare import DATA, lines

from wardline.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_its_sql_twin(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    got = df.collect()
    cursor = duck.execute(catalogue.ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    names = sorted(df.columns)
    assert lines(got, df.columns, names) == lines(cursor.fetchall(), columns, names)


def test_entry_gives_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 50


def test_every_query_has_a_name_and_twins_have_queries():
    import __spark_entry__

    queries = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(queries)
    assert set(catalogue.QUERIES) <= set(queries)


def test_filters_reach_the_scan(spark):
    plan = catalogue.QUERIES["graph_components"]
    assert plan
    df = spark.read.parquet(f"{DATA}/events.parquet").filter("value > 250").select("event_id")
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(value), GreaterThan(value,250.0)]" in text
    assert "ReadSchema: struct<event_id:bigint,value:double>" in text
