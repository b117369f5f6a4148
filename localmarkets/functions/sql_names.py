"""SQL names for parts of the expression library, as SQL functions without Python."""

from __future__ import annotations

from pyspark.sql import SparkSession

FUNCTIONS = {
    "normalize_title(t STRING) RETURNS STRING": r"trim(regexp_replace(regexp_replace(replace(replace(replace(lower(t), 'æ', 'ae'), 'ø', 'oe'), 'å', 'aa'), '[^a-z0-9 ]+', ' '), ' +', ' '))",
    "haversine_m(a DOUBLE, b DOUBLE, x DOUBLE, y DOUBLE) RETURNS DOUBLE": "asin(sqrt(least(1D, pow(sin(radians(x - a) / 2), 2) + cos(radians(a)) * cos(radians(x)) * pow(sin(radians(y - b) / 2), 2)))) * 12742000D",
    "trust_level(c DOUBLE) RETURNS STRING": "CASE WHEN c >= 0.75D THEN 'confirmed' WHEN c >= 0.45D THEN 'ok' ELSE 'unverified' END",
}


def register(spark: SparkSession) -> None:
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
