"""Suggestions; text search itself is in ``postings``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from localmarkets.functions import text as T

def first_per_key(rows: DataFrame, key: str, *order: Column | str) -> DataFrame:
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__n = 1").drop("__n")


def build_suggestions(events: DataFrame, venues: DataFrame) -> DataFrame:
    """(label, kind, fold, weight): cities by their listings, then titles of markets and shops, each folded title once."""
    cities = events.select("city").unionByName(venues.select("city")).withColumn("city", F.trim("city")).where("city <> ''").groupBy("city").agg(F.count("*").alias("n"))
    cities = cities.select(F.col("city").alias("label"), F.lit("by").alias("kind"), T.fold_for_search(F.col("city")).alias("fold"), (F.col("n") + 1000).alias("weight"))
    titles = events.select(F.trim("title").alias("label"), F.lit("marked").alias("kind"), F.lit(100).cast("long").alias("weight"), F.col("k").alias("o"))
    titles = titles.unionByName(venues.select(F.trim("title").alias("label"), F.lit("butik").alias("kind"), F.lit(50).cast("long").alias("weight"), F.col("source_id").alias("o")))
    titles = titles.where("label <> ''").withColumn("fold", T.fold_for_search(F.col("label")))
    return cities.unionByName(first_per_key(titles, "fold", F.desc("weight"), "o").select("label", "kind", "fold", "weight"))


def suggest(index: DataFrame, prefix: str, most: int = 7) -> DataFrame:
    at = F.instr("fold", F.lit(prefix)) - 1
    rank = F.when(at == 0, 100_000).otherwise(0) + F.col("weight") - at
    return index.where(F.contains("fold", F.lit(prefix))).select("label", "kind", "weight", rank.alias("rank")).orderBy(F.desc("rank"), "label", "kind").limit(most)


def suggest_cities(gazetteer: DataFrame, prefix: str, most: int = 8) -> DataFrame:
    hit = gazetteer.where(F.contains("fold", F.lit(prefix))).withColumn("starts", F.col("fold").startswith(prefix))
    return hit.orderBy(F.desc("starts"), F.desc("weight"), "label").limit(most)


