"""Counts, spans and shares of listings, sources, reviews and observations: one aggregate each, combined before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def source_rollup(links: DataFrame, event: str, source: str, seen: str) -> DataFrame:
    """(event, sources, newest, listed): distinct sources of each event, its latest sighting, and the sources in order."""
    own = links.where(F.col(source).isNotNull()).groupBy(event, source).agg(F.max(seen).alias("newest"))  # a row a source: the list is as long as there are sources
    told = own.groupBy(event).agg(F.count("*").alias("sources"), F.max("newest").alias("newest"), F.array_sort(F.collect_list(source)).alias("listed"))
    bare = links.where(F.col(source).isNull()).groupBy(event).agg(F.max(seen).alias("bare"))
    none = F.array().cast(told.schema["listed"].dataType)
    return told.join(bare, event, "full").select(event, F.coalesce("sources", F.lit(0).cast("long")).alias("sources"), F.greatest("newest", "bare").alias("newest"), F.coalesce("listed", none).alias("listed"))


def active_sources(sources: DataFrame, links: DataFrame, key: str, name: str, event: str) -> DataFrame:
    """(key, name, events) of every source, those without an event too; most events first."""
    counts = links.where(F.col(key).isNotNull()).groupBy(key).agg(F.count_distinct(event).alias("n"))
    rows = sources.join(counts, key, "left")
    return rows.select(key, name, F.coalesce("n", F.lit(0).cast("long")).alias("events")).orderBy(F.desc("events"), name)


def summarize_reviews(reviews: DataFrame, place: str, rating: str) -> DataFrame:
    """(place, n, mean): ratings from 1 to 5 only, the mean to one decimal, halves up."""
    valid = reviews.where(F.col(rating).between(1, 5))
    return valid.groupBy(place).agg(F.count("*").alias("n"), (F.floor(F.avg(rating) * 10 + 0.5) / 10).alias("mean"))


def newest_reviews(reviews: DataFrame, place: str, rating: str, at: str, key: str) -> DataFrame:
    """The valid reviews with ``place_in_list``: from 1 for the newest of each place, by key among those of one time. Rows, so a place may have any number."""
    order = Window.partitionBy(place).orderBy(F.desc(at), key)
    return reviews.where(F.col(rating).between(1, 5)).withColumn("place_in_list", F.row_number().over(order))


def pipeline_stats(rows: DataFrame, status: str, **conditions: Column) -> DataFrame:
    """(status, n, and under each name how many rows meet its condition)."""
    return rows.groupBy(status).agg(F.count("*").alias("n"), *[F.count_if(told).alias(name) for name, told in conditions.items()])


def latest_update(rows: DataFrame, *stamps: Column) -> DataFrame:
    """One row: the latest of several time columns over all rows; nulls don't count."""
    newest = [F.max(s) for s in stamps]
    return rows.agg((F.greatest(*newest) if len(newest) > 1 else newest[0]).alias("latest"))


def new_share_guard(rows: DataFrame, fresh: str, most: float = 0.4) -> DataFrame:
    """``fresh`` becomes false everywhere where more than ``most`` of all rows are fresh: that is a first load, not news."""
    share = rows.agg(F.avg(F.col(fresh).cast("int")).alias("__share"))  # one row
    kept = F.col(fresh) & ~(F.col("__share") > most)
    return rows.join(F.broadcast(share), F.lit(True)).withColumn(fresh, kept).drop("__share")


def newly_added(rows: DataFrame, first_seen: str, today: Column, days: int = 10, most: float = 0.4) -> DataFrame:
    """``fresh``: first seen less than ``days`` days ago, under the guard of ``new_share_guard``."""
    return new_share_guard(rows.withColumn("fresh", F.datediff(today, first_seen) < days), "fresh", most)


#: The fields whose source is shown, in this order, and what they are called.
FIELD_LABELS = [
    ("schedule_text", "datoer"), ("street", "adresse"), ("price_text", "pris"), ("is_free", "entré"), ("stall_count_text", "antal stande"), ("organizer", "arrangør"),
    ("contact_website", "website"), ("opening_hours_text", "åbningstider"), ("indoor_outdoor", "inde/ude"), ("venue_name", "sted"),
]


def contributions_by_source(events: DataFrame, event: str, provenance: str = "provenance") -> DataFrame:
    """(event, source, fields): which of the shown fields each source won, from an event's map of field to source; fields in their fixed order."""
    won = F.array_compact(F.array(*[
        F.when(F.try_element_at(provenance, F.lit(f)).isNotNull(), F.struct(F.lit(i).alias("i"), F.lit(label).alias("label"), F.try_element_at(provenance, F.lit(f)).alias("source")))
        for i, (f, label) in enumerate(FIELD_LABELS)
    ]))
    named = events.select(event, F.inline(won))
    return named.groupBy(event, "source").agg(F.array_sort(F.collect_list(F.struct("i", "label"))).alias("f")).select(event, "source", F.col("f.label").alias("fields"))


def facet_options(rows: DataFrame, column: str) -> DataFrame:
    """(value, n) of a facet, the most frequent first."""
    return rows.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def majority(rows: DataFrame, group: str, value: str, order: str) -> DataFrame:
    """(group, value): the most frequent value; of equally frequent ones the one that came first by ``order``."""
    counts = rows.groupBy(group, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return counts.groupBy(group).agg(F.max_by(value, F.struct("n", -F.col("first"))).alias(value))


def first_last_seen(observations: DataFrame, place: str, seen: str, human: Column) -> DataFrame:
    """(place, first, last, verified): the span of sightings and the last one by a person."""
    return observations.groupBy(place).agg(F.min(seen).alias("first"), F.max(seen).alias("last"), F.max(F.when(human, F.col(seen))).alias("verified"))


def best_candidate(rows: DataFrame, group: str, *rank: Column) -> DataFrame:
    """Of each group the row whose rank is greatest, as a struct maximum: no group is held or sorted."""
    best = rows.groupBy(group).agg(F.max_by(F.struct(*[c for c in rows.columns if c != group]), F.struct(*rank)).alias("__row"))
    return best.select(group, "__row.*")


def freshest_per_source(rows: DataFrame, source: str, seen: str, url: str, event: str | None = None) -> DataFrame:
    """(event, source, newest, url): the newest confirmation of each source, of each event if there is one, and its address; of equally new ones the least."""
    key = [c for c in (event, source) if c]
    newest = rows.groupBy(*key).agg(F.max(seen).alias("newest"))
    at = rows.groupBy(*key, F.col(seen).alias("newest")).agg(F.min(url).alias("url"))
    return newest.join(at, [*key, "newest"]).select(*key, "newest", "url")


def detect_recurrence(rows: DataFrame, place: str, date: Column, least: int = 3, span: int = 21) -> DataFrame:
    """(place, recurring, n, span): at least ``least`` distinct days over at least ``span`` days."""
    seen = rows.groupBy(place).agg(F.count_distinct(date).alias("n"), F.datediff(F.max(date), F.min(date)).cast("long").alias("span"))
    return seen.select(place, ((F.col("n") >= least) & (F.col("span") >= span)).alias("recurring"), "n", "span")


def map_pyramid(points: DataFrame, finest: int = 12, width: float = 32.0) -> DataFrame:
    """(zoom, y, x, n): points of each cell at every zoom from 0 (cells of ``width`` degrees) to ``finest``, each zoom halving the cells.

    A cell's number is half of that of the cells in it, so the finest cells are counted before they are dealt to all zooms: one
    aggregate by grouping sets, whose shuffle carries counts of cells and not points.
    """
    size = width / 2**finest
    own = points.where("lat is not null and lng is not null").groupBy(F.floor(F.col("lat") / size).alias("y0"), F.floor(F.col("lng") / size).alias("x0")).agg(F.count("*").alias("n"))
    steps = range(finest + 1)
    rows = own.select("n", *[F.shiftright(f"{a}0", z).alias(f"{a}_{z}") for a in "yx" for z in steps])
    sets = [[F.col(f"y_{z}"), F.col(f"x_{z}")] for z in steps]
    told = rows.groupingSets(sets, *[F.col(f"{a}_{z}") for z in steps for a in "yx"]).agg(F.sum("n").alias("n"), F.grouping_id().alias("g"))
    pick = lambda a: F.coalesce(*[F.col(f"{a}_{z}") for z in steps])
    zoom = F.coalesce(*[F.when(F.col(f"y_{z}").isNotNull(), finest - z) for z in steps])
    return told.select(zoom.alias("zoom"), pick("y").alias("y"), pick("x").alias("x"), "n")
