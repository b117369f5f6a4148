"""What listings and venues are published as: JSON objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def listing_json(rows: DataFrame, key: str, **fields: str) -> DataFrame:
    """(key, json): an object of the named fields; nulls are left out."""
    return rows.select(key, F.to_json(F.struct(*[F.col(c).alias(n) for n, c in fields.items()])).alias("json"))
