"""Every registered query that has SQL gives the rows of an independent engine."""

import pytest
from compare import database, rows_of, sql_rows
from pyspark.sql import functions as F

from localmarkets.operators.lifecycle import append_document_log
from localmarkets.plans.registry import QUERIES, SQL, flagship


@pytest.fixture(scope="module")
def con(sf):
    return database(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf, con, name):
    assert rows_of(QUERIES[name](spark, sf)) == sql_rows(con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).columns


def test_flagship(spark, sf):
    assert flagship(spark, sf).count() > 0


@pytest.mark.parametrize("name", ["Q6_fallback_suggestions", "Q13_events_for_city"])
def test_shows_something(spark, sf, name):
    assert QUERIES[name](spark, sf).head(1)


def test_document_log_appends_new_contents_only(spark):
    at = F.lit("2026-07-03").cast("date")
    pages = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", None), (None, "y")], "url string, html string")
    log = append_document_log(spark.createDataFrame([], "url string, hash string"), pages, at)
    assert sorted(r.url for r in log.collect()) == ["a", "b"]
    more = append_document_log(log, spark.createDataFrame([("a", "x"), ("a", "z"), ("b", "")], "url string, html string"), at)
    assert [r.url for r in more.collect()] == ["a"]


def test_no_python_in_plans(spark, sf):
    for name in ("J2_match_pairs", "Q3_explore", "J6_nearest_events", "J13_place_pairs"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().toString()
        assert "Python" not in plan and "CartesianProduct" not in plan, name
