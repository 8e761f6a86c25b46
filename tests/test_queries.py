import pytest

import __spark_entry__
from sparrowline.plans import catalog

from .oracle import same


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, data, name):
    same(spark, catalog.QUERIES[name], catalog.ORACLES[name], data)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_has_rows(spark, data, name):
    assert catalog.QUERIES[name](spark, data).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())


def plan(df):
    return df._jdf.queryExecution().toString()


def test_scans_are_pruned_and_filters_pushed(spark, data):
    p = plan(spark.read.parquet(f"{data}/events.parquet").where("event_type = 'click'").select("user_id"))
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,click)]" in p
    d = plan(catalog.QUERIES["daily_delivery"](spark, data))
    assert "ReadSchema" in d and "Python" not in d


def test_no_query_of_the_engine_runs_python(spark, data):
    for name in ("fct_impressions", "fct_conversions", "mart_campaign_daily", "calendar_asof", "clean_typed"):
        p = plan(catalog.QUERIES[name](spark, data))
        assert "Python" not in p and "BroadcastNestedLoopJoin" not in p and "CartesianProduct" not in p
