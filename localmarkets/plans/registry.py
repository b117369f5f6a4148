"""All registered queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from localmarkets.plans import dates, extraction, lifecycle, listing, places, publishing, resolve, text

PLANS = [text, dates, resolve, listing, places, lifecycle, extraction, publishing]
QUERIES = {name: query for plan in PLANS for name, query in plan.QUERIES.items()}
SQL = {name: sql for plan in PLANS for name, sql in plan.SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a visitor near the capital sees: large, corroborated outdoor markets of the next ten days within 150 km, nearest first."""
    return listing.explore(spark, sf_dir).orderBy("km", "next_date", "k")
