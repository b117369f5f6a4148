"""Queries for what is published."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from localmarkets.functions import text as T
from localmarkets.plans.text import q_display, q_title
from localmarkets.shared import shared_path
from localmarkets.sources import publish as P
from localmarkets.views import TODAY, view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
c = F.col
HOST, BASE, STAMP, PRODUCT = "example.org", "https://example.org/lopper", "20260703T060000Z", "-//Local markets//DA"


def today():
    return F.lit(TODAY).cast("date")


def query(name: str, sql: str | None = None) -> Callable:
    def keep(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            SQL[name] = with_views(sql)
        return f

    return keep


def published(spark: SparkSession, d: str) -> DataFrame:
    """Events as they are published; some titles hold what the formats have to escape."""
    hard = F.lit(' a\\b; c, "d"\r\n<script> \u2028æ')
    return view(spark, d, "v_raw").withColumns({
        "slug": F.concat(F.lit("marked-"), c("k").cast("string")), "title": F.when(c("k") % 7 == 0, F.concat("title", hard)).otherwise(c("title")),
        "status": F.when(c("cancelled"), "cancelled").otherwise("active"),
    })


_hard = r"""' a\b; c, "d"' || chr(13) || chr(10) || '<script> ' || chr(8232) || 'æ'"""
_nl = "chr(13) || chr(10)"
Q_EVENTS = f"""e AS (SELECT * REPLACE (CASE WHEN k % 7 = 0 THEN title || {_hard} ELSE title END AS title), 'marked-' || k AS slug, CASE WHEN cancelled THEN 'cancelled' ELSE 'active' END AS status FROM v_raw)"""


def q_escape(x: str) -> str:
    kept = rf"replace(replace(replace({x}, '\', '\\'), ';', '\;'), ',', '\,')"
    return rf"replace(replace(replace({kept}, {_nl}, '\n'), chr(13), '\n'), chr(10), '\n')"


def q_number(x: str) -> str:
    return f"regexp_replace(printf('%.6f', {x}), '[.]?0+$', '')"


def q_day(street: str) -> str:
    at = lambda x: f"';TZID=Europe/Copenhagen:' || strftime(date, '%Y%m%d') || 'T' || replace({x}, ':', '') || '00'"
    place = f"concat_ws(', ', nullif(venue_name, ''), {street} nullif(concat_ws(' ', nullif(postcode, ''), nullif(city, '')), ''))"
    return f"""concat_ws({_nl}, 'BEGIN:VEVENT', 'UID:' || slug || '-' || CAST(date AS VARCHAR) || '@{HOST}', 'DTSTAMP:{STAMP}',
  'DTSTART' || CASE WHEN start_time <> '' THEN {at('start_time')} ELSE ';VALUE=DATE:' || strftime(date, '%Y%m%d') END,
  CASE WHEN start_time <> '' AND end_time <> '' AND end_time >= start_time THEN 'DTEND' || {at('end_time')} END, 'SUMMARY:' || {q_escape('title')},
  'LOCATION:' || {q_escape(f"nullif({place}, '')")}, 'GEO:' || {q_number('lat')} || ';' || {q_number('lng')}, 'URL:{BASE}/marked/' || slug, 'END:VEVENT')"""


def q_days(most: int, where: str = "true") -> str:
    return f"""o AS (SELECT event_id, date, start_time, end_time, row_number() OVER (PARTITION BY event_id ORDER BY date, start_time NULLS FIRST, end_time NULLS FIRST) AS n FROM v_occ WHERE date >= DATE '2026-07-03'),
u AS (SELECT o.n, o.date, o.start_time, o.end_time, e.* EXCLUDE (start_time, end_time) FROM o JOIN e ON e.k = o.event_id WHERE n <= {most} AND {where})"""


@query("S20_export_ical", f"""
WITH {Q_EVENTS}, {q_days(30)}
SELECT k AS event_id, md5(concat_ws({_nl}, 'BEGIN:VCALENDAR', 'VERSION:2.0', 'PRODID:{PRODUCT}', string_agg({q_day("nullif(street, ''),")}, {_nl} ORDER BY n), 'END:VCALENDAR')) AS text FROM u GROUP BY k""")
def _(spark, d):
    text = P.event_calendars(published(spark, d), view(spark, d, "v_occ"), today(), HOST, BASE, STAMP, PRODUCT)
    return text.select("event_id", F.md5("text").alias("text"))


_slug = f"substr(replace({q_title('city')}, ' ', '-'), 1, 60)"
Q_CITY = f"""{Q_EVENTS}, {q_days(20, "status <> 'cancelled' AND trim(city) <> ''")}, z AS (SELECT *, {_slug} AS city_slug, min(date) OVER (PARTITION BY k) AS first FROM u),
nm AS (SELECT city_slug, first(name ORDER BY n DESC, name DESC) AS name FROM (SELECT city_slug, trim(city) AS name, count(*) AS n FROM z GROUP BY 1, 2) y GROUP BY 1),
x AS (SELECT city_slug, 1 AS part, first, k, n, {q_day('')} AS text FROM z
  UNION ALL SELECT city_slug, 0, NULL, NULL, NULL, concat_ws({_nl}, 'BEGIN:VCALENDAR', 'VERSION:2.0', 'PRODID:{PRODUCT}', 'X-WR-CALNAME:Loppemarkeder i ' || {q_escape('name')}, 'REFRESH-INTERVAL;VALUE=DURATION:PT12H', 'X-PUBLISHED-TTL:PT12H') FROM nm
  UNION ALL SELECT city_slug, 2, NULL, NULL, NULL, 'END:VCALENDAR' FROM nm)"""


def city_rows(spark: SparkSession, d: str) -> DataFrame:
    return P.city_calendars(published(spark, d), view(spark, d, "v_occ"), today(), HOST, BASE, STAMP, PRODUCT)


@query("S20_city_calendars", f"WITH {Q_CITY} SELECT city_slug, part, first, k, CAST(n AS INT) AS n, md5(text) AS text FROM x")
def _(spark, d):
    return city_rows(spark, d).withColumn("text", F.md5("text"))


@query("S20_city_files", f"WITH {Q_CITY} SELECT city_slug, md5(string_agg(text, {_nl} ORDER BY part, first, k, n) || {_nl}) AS text FROM x GROUP BY city_slug")
def _(spark, d):
    folder = P.Published(spark, shared_path(spark, "calendars"))
    markets = P.city_markets(published(spark, d), view(spark, d, "v_occ"), today(), BASE, PRODUCT)
    folder.texts(markets, "city_slug", P.MARKET_ORDER, line_end=P.CRLF, told=lambda rows: P.told_days(rows, HOST, STAMP))
    return P.text_digests(spark, folder.current(), "city_slug", P.CRLF)


def site_rows(spark: SparkSession, d: str) -> DataFrame:
    cities = view(spark, d, "v_raw").select(T.slugify_city(c("city")).alias("slug")).where("slug <> ''").distinct()
    venues = view(spark, d, "v_venues").select(F.concat(F.lit("sted-"), c("source_id").cast("string")).alias("slug"))
    return P.sitemap(published(spark, d).select("slug"), venues, cities, BASE, today())


Q_SITE = f"""s AS (SELECT '{BASE}' || page AS url, changefreq, priority FROM (VALUES ('', 'daily', 10e-1), ('/i-dag', 'daily', 9e-1), ('/i-weekenden', 'daily', 9e-1), ('/naer-mig', 'daily', 9e-1),
    ('/byer', 'weekly', 8e-1), ('/skjulte-steder', 'daily', 8e-1), ('/tip-perle', 'monthly', 6e-1), ('/kilder', 'weekly', 5e-1)) t(page, changefreq, priority)
  UNION ALL SELECT '{BASE}/marked/marked-' || k, 'daily', 7e-1 FROM v_raw UNION ALL SELECT '{BASE}/sted/sted-' || source_id, 'weekly', 5e-1 FROM v_venues
  UNION ALL SELECT DISTINCT '{BASE}/by/' || {_slug}, 'daily', 8e-1 FROM v_raw WHERE {_slug} <> '')"""


@query("S22_export_sitemap", f"WITH {Q_SITE} SELECT url, DATE '2026-07-03' AS lastmod, changefreq, priority FROM s")
def _(spark, d):
    return site_rows(spark, d)


@query("S22_sitemap_file", f"WITH {Q_SITE} SELECT '<url><loc>' || url || '</loc><lastmod>2026-07-03</lastmod><changefreq>' || changefreq || '</changefreq><priority>' || CAST(priority AS VARCHAR) || '</priority></url>' AS text FROM s")
def _(spark, d):
    folder = P.Published(spark, shared_path(spark, "sitemap"))
    folder.lines(P.sitemap_xml(site_rows(spark, d)))
    return spark.read.text(folder.current()).withColumnRenamed("value", "text")


def q_script(x: str) -> str:
    return rf"replace(replace(replace(replace({x}, '<', '\u003c'), '>', '\u003e'), chr(8232), '\u2028'), chr(8233), '\u2029')"


def q_json(x: str) -> str:
    return f"CAST(to_json({x}) AS VARCHAR)"


def q_field(name: str, x: str) -> str:
    return f"""',"{name}":' || {q_json(f'({x})')}"""


def q_maybe(name: str, x: str) -> str:
    return f"coalesce({q_field(name, x)}, '')"


_url = f"'{BASE}/marked/' || slug"
_free = """',"offers":{"@type":"Offer","price":"0","priceCurrency":"DKK","availability":"https://schema.org/InStock"'"""
Q_JSON_LD = " || ".join([
    """'{"@context":"https://schema.org","@type":"Event"'""", q_field("name", q_display("title")), q_field("url", _url),
    q_field("startDate", "CASE WHEN start_time <> '' THEN CAST(date AS VARCHAR) || 'T' || start_time || ':00' ELSE CAST(date AS VARCHAR) END"),
    q_maybe("endDate", "CASE WHEN end_time <> '' THEN CAST(date AS VARCHAR) || 'T' || end_time || ':00' END"),
    """',"eventStatus":"https://schema.org/' || CASE WHEN status = 'cancelled' THEN 'EventCancelled' ELSE 'EventScheduled' END || '"'""",
    """',"eventAttendanceMode":"https://schema.org/OfflineEventAttendanceMode","location":{"@type":"Place"'""", q_field("name", q_display("coalesce(venue_name, title)")),
    """',"address":{"@type":"PostalAddress"'""", q_maybe("streetAddress", "street"), q_maybe("postalCode", "postcode"), q_maybe("addressLocality", "city"), """',"addressCountry":"DK"}'""",
    """coalesce(',"geo":{"@type":"GeoCoordinates","latitude":' || CAST(round(lat, 6) AS VARCHAR) || ',"longitude":' || CAST(round(lng, 6) AS VARCHAR) || '}', '') || '}'""",
    q_maybe("description", "nullif(substr(description, 1, 500), '')"), f"CASE WHEN is_free THEN {_free} || {q_field('url', _url)} || '}}' ELSE '' END",
    """coalesce(',"isAccessibleForFree":' || CAST(is_free AS VARCHAR), '') || '}'""",
])


@query("S23_export_json_ld", f"""
WITH {Q_EVENTS}, o AS (SELECT event_id, date, start_time, end_time, row_number() OVER (PARTITION BY event_id ORDER BY date, start_time NULLS FIRST, end_time NULLS FIRST) AS n FROM v_occ WHERE date >= DATE '2026-07-03'),
u AS (SELECT o.date, o.start_time, o.end_time, e.* EXCLUDE (start_time, end_time) FROM o JOIN e ON e.k = o.event_id WHERE n = 1)
SELECT k, {q_script(Q_JSON_LD)} AS json FROM u""")
def _(spark, d):
    rows = published(spark, d).withColumns({"lat": F.round("lat", 6), "lng": F.round("lng", 6)})
    return P.event_json_ld(rows, view(spark, d, "v_occ"), today(), BASE)


_item = f"""'{{"@type":"ListItem","position":' || i || {q_field('url', _url)} || {q_field('name', 'title')} || '}}'"""
Q_LIST = " || ".join([
    """'{"@context":"https://schema.org","@type":"CollectionPage"'""", q_field("name", "'Loppemarkeder: ' || city_slug"), q_field("url", f"'{BASE}/by/' || city_slug"),
    """',"mainEntity":{"@type":"ItemList","numberOfItems":' || n || ',"itemListElement":['""", f"string_agg({_item}, ',' ORDER BY i)", "']}}'",
])


@query("S23_item_list", f"""
WITH {Q_EVENTS}, g AS (SELECT *, {_slug} AS city_slug FROM e), r AS (SELECT *, row_number() OVER (PARTITION BY city_slug ORDER BY start_date, k) AS i, count(*) OVER (PARTITION BY city_slug) AS n FROM g WHERE city_slug <> '')
SELECT city_slug, {q_script(Q_LIST)} AS json FROM r WHERE i <= 50 GROUP BY city_slug, n""")
def _(spark, d):
    items = published(spark, d).withColumn("city_slug", T.slugify_city(c("city"))).where("city_slug <> ''")
    return P.collection_json_ld(items, "city_slug", [c("start_date"), c("k")], F.concat(F.lit("Loppemarkeder: "), "city_slug"), F.concat(F.lit("/by/"), "city_slug"), BASE)
