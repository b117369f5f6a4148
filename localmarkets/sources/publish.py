"""What is published: calendars, linked data, site maps, and folders that are switched as a whole.

A text is rows in order, never one value that grows with its group: a city's calendar is a header, a row
for each day of a market, and a footer. ``Published`` writes such rows as one file a name.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from localmarkets.functions import text as T
from localmarkets.operators.joins import read_once
from localmarkets.shared import without_shuffle_files

CRLF = "\r\n"
#: Days of a market in its own calendar and in that of its city; items of a list.
OWN_DAYS, CITY_DAYS, LISTED = 30, 20, 50


# --- calendars ---
def ical_text(c: Column) -> Column:
    """A value of a calendar: backslash, semicolon and comma escaped, every line break as one escaped one."""
    for plain in ("\\", ";", ","):
        c = F.replace(c, F.lit(plain), F.lit("\\" + plain))
    return F.regexp_replace(c, "\r\n|\r|\n", r"\\n")


def ical_number(c: Column) -> Column:
    """Six decimals at most, none that say nothing."""
    return F.call_function("format_number", c, F.lit("0.######"))


def folded(line: Column) -> Column:
    """A line of a calendar, broken after at most 75 bytes where no character is cut; the rest begins with a blank."""
    as_bytes = F.decode(F.encode(line, "UTF-8"), "ISO-8859-1")
    cut = F.regexp_replace(as_bytes, r"(?s)(?=.{75})(.{1,74}(?![\x80-\xBF]))", "$1\r\n ")
    return F.decode(F.encode(cut, "ISO-8859-1"), "UTF-8")


def _joined(*parts: Column, by: str = " ") -> Column:
    """The parts that say something, null if none does."""
    return F.nullif(F.concat_ws(by, *[F.nullif(p, F.lit("")) for p in parts]), F.lit(""))


def ical_market(base: str, street: bool = True) -> Column:
    """The lines that all days of a market have; columns slug, title, venue_name, street, postcode, city, lat, lng."""
    place = _joined(F.col("venue_name"), *([F.col("street")] if street else []), _joined(F.col("postcode"), F.col("city")), by=", ")
    lines = [
        F.concat(F.lit("SUMMARY:"), ical_text(F.col("title"))), F.concat(F.lit("LOCATION:"), ical_text(place)),
        F.concat(F.lit("GEO:"), ical_number(F.col("lat")), F.lit(";"), ical_number(F.col("lng"))), F.concat(F.lit(f"URL:{base}/marked/"), "slug"), F.lit("END:VEVENT"),
    ]
    return F.concat_ws(CRLF, *lines)


def ical_day(host: str, stamp: str, zone: str) -> Column:
    """One day of a market as text; columns slug, market (``ical_market``), date, start_time, end_time."""
    day = F.replace(F.col("date").cast("string"), F.lit("-"), F.lit(""))
    at = lambda c: F.concat(F.lit(f";TZID={zone}:"), day, F.lit("T"), F.replace(c, F.lit(":"), F.lit("")), F.lit("00"))
    timed = F.col("start_time").isNotNull() & (F.col("start_time") != "")
    lines = [
        F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), "slug", F.lit("-"), F.col("date").cast("string"), F.lit(f"@{host}")), F.lit(f"DTSTAMP:{stamp}"),
        F.concat(F.lit("DTSTART"), F.when(timed, at(F.col("start_time"))).otherwise(F.concat(F.lit(";VALUE=DATE:"), day))),
        F.when(timed & (F.col("end_time") != "") & (F.col("end_time") >= F.col("start_time")), F.concat(F.lit("DTEND"), at(F.col("end_time")))),
        F.col("market"),
    ]
    return F.concat_ws(CRLF, *lines)


def _ahead(occurrences: DataFrame, today: Column, most: int) -> DataFrame:
    """The next ``most`` days of each event; n: their order, first: the first of them."""
    order = Window.partitionBy("event_id").orderBy("date", F.asc_nulls_first("start_time"), F.asc_nulls_first("end_time"))
    days = occurrences.where(F.col("date") >= today).select("event_id", "date", "start_time", "end_time")
    return days.withColumns({"n": F.row_number().over(order), "first": F.min("date").over(order)}).where(F.col("n") <= most)


def _upcoming(events: DataFrame, occurrences: DataFrame, today: Column, most: int) -> DataFrame:
    """The next ``most`` days of each event (column k) with what is told of it."""
    return _ahead(occurrences, today, most).join(events, F.col("event_id") == F.col("k"))


def event_calendars(events: DataFrame, occurrences: DataFrame, today: Column, host: str, base: str, stamp: str, product: str, zone: str = "Europe/Copenhagen", most: int = OWN_DAYS) -> DataFrame:
    """(event_id, slug, text): the calendar of each event with a day from today on; at most ``most`` days are in a text."""
    days = _upcoming(events.select("k", "slug", ical_market(base).alias("market")), occurrences, today, most)
    rows = days.select("event_id", "slug", F.struct("n", ical_day(host, stamp, zone).alias("text")).alias("d")).groupBy("event_id", "slug").agg(F.array_sort(F.collect_list("d")).alias("d"))
    head, body = f"BEGIN:VCALENDAR{CRLF}VERSION:2.0{CRLF}PRODID:{product}{CRLF}", F.array_join(F.col("d.text"), CRLF)
    return rows.select("event_id", "slug", F.concat(F.lit(head), body, F.lit(f"{CRLF}END:VCALENDAR")).alias("text"))


def city_markets(events: DataFrame, occurrences: DataFrame, today: Column, base: str, product: str, most: int = CITY_DAYS) -> DataFrame:
    """(city_slug, part, first, k, slug, market, days, text): what each city's calendar is made of, a row a market with its next days (at most ``most``), and rows with the
    text of the header (part 0) and the footer (2). Cancelled markets (column ``status``) are left out; the header has the city's name that most of its markets use."""
    known = events.where(F.col("city").isNotNull() & (F.trim("city") != "") & ~F.col("status").eqNullSafe("cancelled"))
    known = read_once(known, "city", city_slug=T.slugify_city(F.col("__text"))).where("city_slug <> ''")
    markets = known.select("k", "slug", "city_slug", ical_market(base, street=False).alias("market"))
    days = _ahead(occurrences, today, most).groupBy("event_id").agg(F.min("first").alias("first"), F.array_sort(F.collect_list(F.struct("n", "date", "start_time", "end_time"))).alias("days"))
    body = days.join(markets, F.col("event_id") == F.col("k")).select("city_slug", F.lit(1).alias("part"), "first", "k", "slug", "market", "days", F.lit(None).cast("string").alias("text"))
    # The days of a name are counted by event.
    held = occurrences.where(F.col("date") >= today).groupBy("event_id").agg(F.least(F.count("*"), F.lit(most)).alias("c"))
    cities = held.join(known.select("k", "city_slug", "city"), F.col("event_id") == F.col("k")).groupBy("city_slug", "city").agg(F.sum("c").alias("c"))
    cities = cities.select("city_slug", F.trim("city").alias("name"), "c")
    names = cities.groupBy("city_slug", "name").agg(F.sum("c").alias("c")).groupBy("city_slug").agg(F.max_by("name", F.struct("c", "name")).alias("name"))
    head = F.concat(
        F.lit(f"BEGIN:VCALENDAR{CRLF}VERSION:2.0{CRLF}PRODID:{product}{CRLF}X-WR-CALNAME:Loppemarkeder i "), ical_text(F.col("name")),
        F.lit(f"{CRLF}REFRESH-INTERVAL;VALUE=DURATION:PT12H{CRLF}X-PUBLISHED-TTL:PT12H"),
    )
    ends = names.select("city_slug", F.inline(F.array(F.struct(F.lit(0).alias("part"), head.alias("text")), F.struct(F.lit(2).alias("part"), F.lit("END:VCALENDAR").alias("text")))))
    return body.unionByName(ends, allowMissingColumns=True)


def told_days(rows: DataFrame, host: str, stamp: str, zone: str = "Europe/Copenhagen") -> DataFrame:
    """(city_slug, part, first, k, n, text): the rows of ``city_markets`` in their order, a row a market's day."""
    days = rows.select("city_slug", "part", "first", "k", "slug", "market", "text", F.explode_outer("days").alias("d")).select("*", "d.*")
    return days.select("city_slug", "part", "first", "k", "n", F.when(F.col("part") == 1, ical_day(host, stamp, zone)).otherwise(F.col("text")).alias("text"))


def city_calendars(events: DataFrame, occurrences: DataFrame, today: Column, host: str, base: str, stamp: str, product: str, zone: str = "Europe/Copenhagen", most: int = CITY_DAYS) -> DataFrame:
    """(city_slug, part, first, k, n, text): rows of each city's calendar, in order of part (0 header, 1 a market's day, 2 footer), the market's
    next day, its key and the day's number."""
    return told_days(city_markets(events, occurrences, today, base, product, most), host, stamp, zone)


#: Order of ``city_markets`` in a calendar.
MARKET_ORDER = ["part", "first", "k"]


# --- linked data ---
def script_safe(json: Column) -> Column:
    """JSON that may stand in a script element: what could end the element or a line is escaped."""
    for plain in ("<", ">", "\u2028", "\u2029"):
        json = F.replace(json, F.lit(plain), F.lit(f"\\u{ord(plain):04x}"))
    return json


def event_json_ld(events: DataFrame, occurrences: DataFrame, today: Column, base: str) -> DataFrame:
    """(k, json): each event with a day from today on, told by its next day. Fields that are null are left out."""
    start = F.struct("date", "start_time", "end_time")
    ahead = occurrences.where(F.col("date") >= today).groupBy("event_id").agg(F.min(start).alias("next"))
    # Titles come back from year to year: each is made ready once.
    named = read_once(events.withColumn("place_title", F.coalesce("venue_name", "title")), "title", shown=T.display_title(F.col("__text")))
    named = read_once(named, "place_title", place_shown=T.display_title(F.col("__text")))
    rows = named.join(ahead, F.col("k") == F.col("event_id"))
    day = F.col("next.date").cast("string")
    at = lambda t: F.concat(day, F.lit("T"), t, F.lit(":00"))
    url = F.concat(F.lit(f"{base}/marked/"), "slug")
    geo = F.when(F.col("lat").isNotNull() & F.col("lng").isNotNull(), F.struct(F.lit("GeoCoordinates").alias("@type"), F.col("lat").alias("latitude"), F.col("lng").alias("longitude")))
    address = F.struct(F.lit("PostalAddress").alias("@type"), F.col("street").alias("streetAddress"), F.col("postcode").alias("postalCode"), F.col("city").alias("addressLocality"), F.lit("DK").alias("addressCountry"))
    place = F.struct(F.lit("Place").alias("@type"), F.col("place_shown").alias("name"), address.alias("address"), geo.alias("geo"))
    offer = F.when(F.col("is_free"), F.struct(F.lit("Offer").alias("@type"), F.lit("0").alias("price"), F.lit("DKK").alias("priceCurrency"), F.lit("https://schema.org/InStock").alias("availability"), url.alias("url")))
    held = F.struct(
        F.lit("https://schema.org").alias("@context"), F.lit("Event").alias("@type"), F.col("shown").alias("name"), url.alias("url"),
        F.when(F.col("next.start_time") != "", at(F.col("next.start_time"))).otherwise(day).alias("startDate"), F.when(F.col("next.end_time") != "", at(F.col("next.end_time"))).alias("endDate"),
        F.when(F.col("status").eqNullSafe("cancelled"), "https://schema.org/EventCancelled").otherwise("https://schema.org/EventScheduled").alias("eventStatus"),
        F.lit("https://schema.org/OfflineEventAttendanceMode").alias("eventAttendanceMode"), place.alias("location"), F.when(F.col("description") != "", F.substring("description", 1, 500)).alias("description"),
        offer.alias("offers"), F.col("is_free").alias("isAccessibleForFree"),
    )
    return rows.select("k", script_safe(F.to_json(held)).alias("json"))


def collection_json_ld(items: DataFrame, group: str, order: list[Column], name: Column, path: Column, base: str, most: int = LISTED) -> DataFrame:
    """(group, json): a page of each group with the list of its first ``most`` items (columns slug, title) and the number of all."""
    ranked = items.withColumn("position", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    entry = F.struct(F.lit("ListItem").alias("@type"), "position", F.concat(F.lit(f"{base}/marked/"), "slug").alias("url"), F.col("title").alias("name"))
    first = ranked.where(F.col("position") <= most).groupBy(group).agg(F.array_sort(F.collect_list(F.struct("position", entry.alias("e")))).alias("e"))
    rows = first.join(items.groupBy(group).agg(F.count("*").alias("n")), group)
    listed = F.struct(F.lit("ItemList").alias("@type"), F.col("n").alias("numberOfItems"), F.col("e.e").alias("itemListElement"))
    page = F.struct(F.lit("https://schema.org").alias("@context"), F.lit("CollectionPage").alias("@type"), name.alias("name"), F.concat(F.lit(base), path).alias("url"), listed.alias("mainEntity"))
    return rows.select(group, script_safe(F.to_json(page)).alias("json"))


# --- site map ---
#: Pages that every site has, how often they change, and their priority.
PAGES = [("", "daily", 1.0), ("/i-dag", "daily", 0.9), ("/i-weekenden", "daily", 0.9), ("/naer-mig", "daily", 0.9), ("/byer", "weekly", 0.8), ("/skjulte-steder", "daily", 0.8), ("/tip-perle", "monthly", 0.6), ("/kilder", "weekly", 0.5)]


def sitemap(events: DataFrame, venues: DataFrame, cities: DataFrame, base: str, today: Column) -> DataFrame:
    """(url, lastmod, changefreq, priority) of the fixed pages, and of each city, event and venue (column slug)."""
    fixed = events.sparkSession.createDataFrame(PAGES, "page string, changefreq string, priority double").select(F.concat(F.lit(base), "page").alias("url"), "changefreq", "priority")
    parts = [(cities, "by", "daily", 0.8), (events, "marked", "daily", 0.7), (venues, "sted", "weekly", 0.5)]
    for df, folder, often, priority in parts:
        fixed = fixed.unionByName(df.select(F.concat(F.lit(f"{base}/{folder}/"), "slug").alias("url"), F.lit(often).alias("changefreq"), F.lit(priority).alias("priority")))
    return fixed.select("url", today.alias("lastmod"), "changefreq", "priority")


def sitemap_xml(rows: DataFrame) -> DataFrame:
    """(text): an element for each row of ``sitemap``, as lines of a site map."""
    safe = F.col("url")
    for plain, kept in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        safe = F.replace(safe, F.lit(plain), F.lit(kept))
    tag = lambda name, c: F.concat(F.lit(f"<{name}>"), c, F.lit(f"</{name}>"))
    fields = [("loc", safe), ("lastmod", F.col("lastmod").cast("string")), ("changefreq", F.col("changefreq")), ("priority", F.col("priority").cast("string"))]
    return rows.select(tag("url", F.concat(*[tag(n, c) for n, c in fields])).alias("text"))


# --- folders ---
class Published:
    """A folder whose whole contents change at once.

    Each set of files is a folder of its own; a small file names the one that counts and is replaced by a
    rename, after the set is complete. A failed or killed attempt leaves the old set as it is.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def current(self) -> str | None:
        """The set that counts, or nothing."""
        named = self._at(f"{self.path}/CURRENT")
        files = named.getFileSystem(self._conf)
        if not files.exists(named):
            return None
        return f"{self.path}/{self.spark.read.text(f'{self.path}/CURRENT').first()[0]}"

    def _switch(self, own: str) -> None:
        before = self.current()
        told, named = self._at(f"{self.path}/_{own}"), self._at(f"{self.path}/CURRENT")
        files = told.getFileSystem(self._conf)
        out = files.create(told, True)
        out.writeBytes(own)
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), self._conf)
        rename = getattr(self._jvm, "org.apache.hadoop.fs.Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        context.rename(told, named, how)
        if before:
            files.delete(self._at(before), True)

    def texts(self, rows: DataFrame, name: str, order: list[str], text: str = "text", line_end: str = "\n", told: Callable[[DataFrame], DataFrame] | None = None) -> None:
        """A folder ``name=value`` with one compressed file for each value of ``name``: its rows in order. A file is written by one task, row by row.

        ``told`` makes the rows of text of the ordered ones, so a text is made where it is written and not sent.
        """
        own = f"set-{uuid.uuid4().hex}"
        dealt = rows.repartition(name).sortWithinPartitions(name, *[F.asc_nulls_first(o) for o in order])
        dealt = dealt if told is None else told(dealt)
        with without_shuffle_files(self.spark):
            dealt.select(name, text).write.partitionBy(name).option("lineSep", line_end).option("compression", "gzip").text(f"{self.path}/{own}")
        self._switch(own)

    def lines(self, rows: DataFrame, text: str = "text") -> None:
        """Rows without an order, over as many files as there are tasks."""
        own = f"set-{uuid.uuid4().hex}"
        rows.select(text).write.text(f"{self.path}/{own}")
        self._switch(own)


def text_digests(spark: SparkSession, path: str, name: str, line_end: str = "\n") -> DataFrame:
    """(name, text): the MD5 of each file that ``Published.texts`` wrote. A compressed file is read by one task in its order, so lines are hashed as they are read."""
    lines = spark.read.schema(f"value string, {name} string").option("lineSep", line_end).text(path).select(name, "value")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = None, None
        told = lambda: pa.RecordBatch.from_pydict({name: pa.array([own], pa.string()), "text": pa.array([seen.hexdigest()], pa.string())})
        for batch in batches:
            for key, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if seen is None or key != own:
                    if seen is not None:
                        yield told()
                    own, seen = key, hashlib.md5()
                seen.update(f"{line}{line_end}".encode())
        if seen is not None:
            yield told()

    return lines.mapInArrow(digests, f"{name} string, text string")
