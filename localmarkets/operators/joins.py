"""Joins of listings with links, dates, lookup tables and forecasts, all by equality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from localmarkets.functions import geo
from localmarkets.functions import text as T
from localmarkets.shared import cut


def attach_source_links(events: DataFrame, links: DataFrame, sources: DataFrame, event: tuple[str, str], source: tuple[str, str]) -> DataFrame:
    """Events with each of their links and its source; ``event`` and ``source``: the key's name on either side."""
    rows = events.join(links, F.col(event[0]) == F.col(event[1]))
    return rows.join(sources, F.col(source[0]) == F.col(source[1]))


def has_future_dates(events: DataFrame, occurrences: DataFrame, first: Column, key: str = "event_id") -> DataFrame:
    """``ahead``: whether an event has a date from ``first`` on."""
    later = occurrences.where(F.col("date") >= first).select(F.col("event_id").alias(key)).distinct().withColumn("__ahead", F.lit(True))
    return events.join(later, key, "left").withColumn("ahead", F.col("__ahead").isNotNull()).drop("__ahead")


def geocode_lookup(rows: DataFrame, addresses: DataFrame, centres: DataFrame) -> DataFrame:
    """``quality``, ``lat``, ``lng``, ``resolved_postcode``, ``resolved_city`` of each row (street, postcode, city), by the first stage that answers: its
    address (A or B), its postcode's centre (P), or that of its town, if only one postcode has the town's name (P).

    ``addresses``: street, postcode, quality, city, lat, lng, one row a street and postcode; other qualities than A and B are no answer.
    ``centres``: postcode, city, lat, lng, one row a postcode. Points outside the country are no answer, nor is anything for less than
    four characters of address. A row without a city and a postcode may name its town as the street.
    """
    inside = geo.in_denmark(F.col("lat"), F.col("lng"))
    answer = lambda quality: F.struct(quality.alias("quality"), "lat", "lng", F.col("postcode").alias("resolved_postcode"), F.col("city").alias("resolved_city"))
    exact = addresses.where(inside & F.col("quality").isin("A", "B")).select(F.col("street").alias("__street"), F.col("postcode").alias("__code"), answer(F.col("quality")).alias("__address"))
    by_code = centres.where(inside).select(F.col("postcode").alias("__code"), answer(F.lit("P")).alias("__centre"))
    # A name that several postcodes have is no answer, even if some of their centres are none.
    named = centres.groupBy(F.col("city").alias("__town")).agg(F.count("*").alias("n"), F.max(F.when(inside, answer(F.lit("P")))).alias("__only")).where("n = 1").drop("n")
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    given = [c for c in rows.columns if c not in ("quality", "lat", "lng", "resolved_postcode", "resolved_city")]
    bare = rows.select(*given).withColumns({
        "__street": T.normalize_exonym(some(F.col("street"))), "__code": some(F.col("postcode")), "__city": T.normalize_exonym(some(F.col("city"))),
    })
    bare = bare.withColumn("__town", F.coalesce("__city", F.when(F.col("__code").isNull(), F.col("__street"))))
    found = bare.join(exact, ["__street", "__code"], "left").join(by_code, "__code", "left").join(named, "__town", "left")
    asked = F.length(F.concat_ws(", ", "__street", "__code", "__city")) >= 4
    found = found.withColumn("__g", F.when(asked, F.coalesce("__address", "__centre", "__only")))
    return found.select(*given, *[F.col(f"__g.{n}").alias(n) for n in ("quality", "lat", "lng", "resolved_postcode", "resolved_city")])


def centroid_fallback(points: DataFrame, key: str, usable: Column) -> DataFrame:
    """(key, kind, lat): ``centre`` where all points of a key are in the country, else ``mean``; of the usable points."""
    inside = geo.in_denmark(F.col("lat"), F.col("lng"))
    kind = F.when(F.bool_and(inside), "centre").otherwise("mean")
    return points.groupBy(key).agg(kind.alias("kind"), F.round(F.avg(F.when(usable, F.col("lat"))), 6).alias("lat"))


def reverse_lookup(rows: DataFrame, places: DataFrame, digits: int = 5) -> DataFrame:
    """``town`` and ``town_postcode`` of each row: those of the places at its coordinates, rounded; the least where there are several, null where there is none."""
    at = {"__y": F.round("lat", digits), "__x": F.round("lng", digits)}
    named = places.where("lat is not null and lng is not null").withColumns(at).groupBy(*at).agg(F.min(F.struct("city", "postcode")).alias("__p"))
    found = rows.withColumns(at).join(named, list(at), "left")
    return found.select(*rows.columns, F.col("__p.city").alias("town"), F.col("__p.postcode").alias("town_postcode"))


def fill_hours(venues: DataFrame, curated: DataFrame, confirmations: DataFrame, key: str) -> DataFrame:
    """(key, hours, confirms): own opening hours, else the curated ones; 0 without a confirmation.

    ``curated``: key, own; ``confirmations``: key, confirms; one row a key each.
    """
    hours = F.coalesce(F.nullif(F.trim("opening_hours_text"), F.lit("")), "own")
    rows = venues.select(key, "opening_hours_text").join(curated, key, "left").join(confirmations, key, "left")
    return rows.select(key, hours.alias("hours"), F.coalesce("confirms", F.lit(0)).alias("confirms"))


def grid_weather(events: DataFrame, forecast: DataFrame, date: str, rain_dependent: Column | None = None, size: float = 0.5, warn: int = 50) -> DataFrame:
    """Outdoor and mixed events, and those that depend on the weather, with the ``rain`` of their grid cell and day; ``warn`` where such a one has rain from a bound on.

    ``forecast``: y, x, date, rain, one row a cell and day. Events without a forecast are left out. Without ``rain_dependent`` an event
    depends on the weather if it is in the open air.
    """
    open_air = F.coalesce(F.col("indoor_outdoor").isin("outdoor", "mixed"), F.lit(False))
    depends = open_air if rain_dependent is None else F.coalesce(rain_dependent, F.lit(False))
    placed = events.withColumn("__depends", depends).where(open_air | F.col("__depends")).withColumns({"__y": geo.cell(F.col("lat"), size), "__x": geo.cell(F.col("lng"), size)})
    told = forecast.select(F.col("y").alias("__y"), F.col("x").alias("__x"), F.col("date").alias("__date"), "rain")
    rows = placed.join(told, [placed[c] == told[c] for c in ("__y", "__x")] + [placed[date] == told["__date"]])
    return rows.select(*events.columns, "rain", (F.col("__depends") & (F.col("rain") >= warn)).alias("warn"))


def added_domains(domains: DataFrame, active: DataFrame) -> DataFrame:
    """``added``: whether a domain is among the active ones."""
    known = active.select("domain").distinct().withColumn("__known", F.lit(True))
    return domains.join(known, "domain", "left").withColumn("added", F.col("__known").isNotNull()).drop("__known")


def date_sets(occurrences: DataFrame) -> DataFrame:
    """(event_id, days): the distinct dates of each event, in order."""
    return occurrences.groupBy("event_id").agg(F.array_sort(F.collect_set("date")).alias("days"))


def date_overlap(days: Column, other: Column) -> Column:
    """Whether two sets of dates have one in common."""
    return F.arrays_overlap(days, other)


def identical_dates(days: Column, other: Column) -> Column:
    """Whether two sets of dates are the same set."""
    return (F.size(days) == F.size(other)) & (F.size(F.array_except(days, other)) == 0)


def distinct_union(days: Column, more: Column) -> Column:
    return F.array_union(days, more)


def read_once(rows: DataFrame, text: str | list[str], **told: Column) -> DataFrame:
    """``rows`` with columns that depend on the column ``text`` alone, read once for each distinct text (``__text``) into a table, spread over tasks by a hash of the text: a filter on them reads the table.

    Of several columns each distinct row is read once, under their names after ``__``.
    """
    own = {text: "__text"} if isinstance(text, str) else {n: f"__{n}" for n in text}
    read = cut(rows.select([F.col(n).alias(o) for n, o in own.items()]).distinct().select(*own.values(), *[v.alias(n) for n, v in told.items()]), "readings")
    same = F.lit(True)
    for n, o in own.items():
        same = same & F.col(n).eqNullSafe(F.col(o))
    return rows.join(read, same, "left").drop(*own.values())
