"""Listing-shaped views over the given tables. The SQL is plain enough for any engine, so tests build the same view elsewhere.

Each view grows with its tables: listings with orders, places with suppliers and events, shops with
customers, texts with orders and their keys.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from localmarkets.functions.scores import STATUSES, VISIBILITIES
from localmarkets.shared import table

#: The day that listings are looked at, and a position.
TODAY, LAT, LNG = "2026-07-03", 55.7, 12.5

#: Announcement sentences in Danish, one facet or trap each.
SENTENCES = [
    "Loppemarked lørdag d. 5. juli 2026 kl. 10-16 på Torvet",
    "Stort kræmmermarked med over 150 stader og gratis adgang",
    "AFLYST - Loppemarked ved hallen",
    "Markedet aflyses ikke ved regn, kun i godt vejr",
    "Bagagerumsmarked hver søndag 9-14, ingen parkering på pladsen",
    "Julemarked i forsamlingshuset med æbleskiver og kaffe",
    "Entré 30 kr for voksne, og hallen har toiletter",
    "Antikmarked indendørs i sportshallen, voksne 40 kr",
    "Gårdloppemarked på Bagvejen 12, 8600 Silkeborg",
    "Kun kontant betaling, medbring kontanter",
    "Vi tager både MobilePay og kontanter",
    "Salg af møbler, lamper, keramik og gamle bøger",
    "Vinyl, LP plader, legetøj og lego til billige penge",
    "Hoppeborge og ansigtsmaling for de små",
    "Hallen er handicapvenlig med plads til kørestole",
    "Aflyses ved regn eller dårligt vejr",
    "Book din stand via example.com/book senest fredag",
    "Åbent hver anden søndag fra 10 til 15",
    "Første lørdag i måneden kl. 10.00-15.30",
    "Sidste søndag i måneden hele sommeren",
    "Lørdag i ulige uger 11-17",
    "Tøj, sko, smykker og porcelæn, royal copenhagen",
    "Garagesalg fra privat, alt skal væk, ring 20 30 40 50",
    "Loppesupermarked (kun for private)",
    "Stort marked 16. sæson Sol Event ved Ole",
    "Flea market at the harbour, free parking",
    "Toiletforhold findes ikke, men der er foodtrucks",
    "Gratis entré for alle, voksne 30 kr",
    "Adgang: gratis, 78 stande og 50-60 boder",
    "Uden parkering, p-plads findes i nærheden",
    "Vintage og retro tøj på Nørrebro, 2200 København N",
    "Genbrugsmarked ved kirken på Nygade 7, 5000 Odense C",
    "Vi samler ind til spejderne, kom og hjælp",
    "Mødes torsdag aften til fællesspisning",
    "Dødsbo sælges: værktøj, radioer og gammelt legetøj",
    "Fast loppelade, åbent hele året efter aftale",
    "Rydder laden, store mængder billige lopper, kontant",
    "3 stader ledige, ca. 2 boder tilbage",
    "Mad og drikke kan købes, musik hele dagen",
    "Nødebo Kro den 23. august, tilmelding nødvendig",
]

STREET_FILL = "CASE CAST(k % 6 AS INT) WHEN 0 THEN NULL WHEN 1 THEN n.n_name ELSE 'Vej ' || CAST(m % 90 AS VARCHAR(20)) END"


def choose(key: str, values: list[str | None]) -> str:
    """SQL that picks the value at key modulo their number."""
    cases = " ".join(f"WHEN {i} THEN " + ("NULL" if v is None else f"'{v}'") for i, v in enumerate(values))
    return f"CASE CAST({key} % {len(values)} AS INT) {cases} END"


CATEGORIES = ["loppemarked", "kraemmermarked", "bagagerumsmarked", "antikmarked", "genbrugsmarked", "byloppemarked", "julemarked", "andet"]
SCHEDULES = [
    "Hver søndag", "Hver lørdag og søndag", "Alle søndage", "Første lørdag i måneden", "Sidste søndag i måneden", "Tredje torsdag i hver måned",
    "2. fredag i måneden", "Søndag i alle ulige uger", "Lørdag i lige uger", "Hver anden søndag", "Efter aftale", None, "", "onsdage i ulige uger", "hver torsdag hele sommeren",
]
HOURS = [
    "Søndag 12-17", "Lørdag-søndag 10-16", "Lørdag 10-16, Søndag 10-15", "kl. 10.00-16.30", "lørdag-søndag 5.-6. september", "10-9", "Fredag-mandag 9-12:30",
    None, "", "tirsdag: 8.30-17, torsdag 25-26", "mandag 10-18 tirsdag 10-18 onsdag 10-18", "efter aftale",
]
WEEK_HOURS = [
    "Mo-Fr 10:00-17:30", "Mo,We,Fr 10:00-14:00", "Mo 10:00-12:00,13:00-17:00", "24/7", "Mo-Sa 09:00-18:00; Su off", "Fr-Mo 12:00-00:00",
    "PH off", "Mo-Su 08:00-20:00; We 10:00-12:00", "Apr-Sep Mo-Fr 10:00-16:00", "closed", None, "", "Sa 10:00-14:00; PH off; Sa 11:00-13:00", "nonsense", "10:00-16:00",
]
PLACE_TYPES = ["lade", "gaard", "garage", "dodsbo", "andet"]
SOURCE_TYPES = ["facebook_post", "website", "user_visit", "phone_verification", "classified"]

VIEWS: dict[str, str] = {
    "v_key": "SELECT o.o_orderkey AS k, CAST(floor(o.o_orderkey / 3) AS BIGINT) AS m, o.o_custkey AS custkey FROM orders o",
    "v_raw": f"""
SELECT k, m, 'src' || CAST(k % 5 AS VARCHAR(20)) AS source_key,
  CASE CAST(k % 5 AS INT) WHEN 0 THEN 7e-1 WHEN 1 THEN 65e-2 WHEN 2 THEN 6e-1 WHEN 3 THEN 4e-1 ELSE 3e-1 END AS trust,
  p.p_name || ' marked ' || n.n_name || CASE WHEN k % 4 = 1 THEN ' lørdag d. 5. juli 2026' ELSE '' END AS title,
  CAST(1000 + (m * 13) % 8999 AS VARCHAR(20)) AS postcode,
  CASE WHEN k % 4 = 3 THEN floor((546e-1 + (m % 300) * 1e-2 + (k % 3) * 5e-4) * 10 + 5e-1) / 10 ELSE 546e-1 + (m % 300) * 1e-2 + (k % 3) * 5e-4 END AS lat,
  CASE WHEN k % 101 = 0 THEN 30e-1 WHEN k % 4 = 3 THEN floor((82e-1 + ((m * 7) % 650) * 1e-2 + (k % 3) * 5e-4) * 10 + 5e-1) / 10 ELSE 82e-1 + ((m * 7) % 650) * 1e-2 + (k % 3) * 5e-4 END AS lng,
  {choose("k", ["source", "A", "B", "P"])} AS geocode_quality,
  n.n_name || {choose("m", ["", " C", " N", " SV", " Ø"])} AS city,
  {STREET_FILL} AS street,
  DATE '2026-06-01' + CAST(m % 120 AS INT) AS start_date,
  CASE WHEN k % 3 = 2 THEN DATE '2026-06-08' + CAST(m % 120 AS INT) END AS second_date,
  CASE WHEN k % 3 <> 1 THEN '10:00' END AS start_time, CASE WHEN k % 3 <> 1 THEN '16:00' END AS end_time,
  CASE CAST(k % 3 AS INT) WHEN 0 THEN true WHEN 1 THEN false ELSE NULL END AS is_free,
  {choose("m", ["indoor", "outdoor", "mixed", "unknown"])} AS indoor_outdoor,
  CASE WHEN m % 5 = 0 THEN NULL ELSE CAST(m % 200 AS VARCHAR(20)) || ' stader' END AS stall_count_text,
  {choose("m", CATEGORIES)} AS category,
  CASE WHEN k % 4 = 2 THEN NULL ELSE {choose("k", SENTENCES)} END AS description,
  CASE WHEN k % 7 < 3 THEN 'Hal ' || CAST(m % 50 AS VARCHAR(20)) END AS venue_name,
  CASE WHEN k % 5 < 2 THEN g.url END AS contact_website,
  DATE '2026-04-01' + CAST(k % 93 AS INT) AS last_seen,
  m % 97 = 0 AND k % 3 = 0 AS cancelled
FROM v_key JOIN part p ON p.p_partkey = m % 200 JOIN nation n ON n.n_nationkey = m % 25 LEFT JOIN pages g ON g.page_id = k % 50""",
    "v_occ": """
SELECT event_id, date, start_time, end_time FROM (
  SELECT k AS event_id, start_date AS date, start_time, end_time FROM v_raw
  UNION ALL SELECT k, second_date, start_time, end_time FROM v_raw WHERE second_date IS NOT NULL
  UNION ALL SELECT l_orderkey, DATE '2026-06-15' + CAST((l_orderkey + l_linenumber * 11) % 90 AS INT),
    CASE WHEN l_linenumber % 2 = 0 THEN '09:30' END, CASE WHEN l_linenumber % 2 = 0 THEN '14:00' END FROM lineitem) x""",
    "v_text": f"SELECT k, {choose('k', SENTENCES)} || CASE WHEN k % 9 = 0 THEN ' ' || CAST(k % 1000 AS VARCHAR(20)) || ' boder' ELSE '' END AS text FROM v_key",
    "v_schedule": f"""
SELECT c_custkey AS k, {choose("c_custkey", SCHEDULES)} AS schedule_text, {choose("c_custkey", HOURS)} AS hours_text,
  CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE DATE '2026-06-20' + CAST(c_custkey % 60 AS INT) END AS range_start,
  CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 3 = 1 THEN DATE '2026-06-20' + CAST(c_custkey % 60 + c_custkey % 7 AS INT)
    ELSE DATE '2026-07-20' + CAST(c_custkey % 60 AS INT) END AS range_end
FROM customer""",
    "v_venues": f"""
SELECT * FROM (
  SELECT 'map' AS source_type, c_custkey AS source_id,
    {choose("c_custkey", ["Reolen", "Loppelade", "Antik", "Genbrug", "Second Hand"])} || ' ' || c_mktsegment AS title,
    {choose("c_custkey", ["reolmarked", "loppebutik", "antik", "genbrug", "genbrug"])} AS category,
    n.n_name AS city, CAST(1000 + (c_custkey * 17) % 8999 AS VARCHAR(20)) AS postcode,
    550e-1 + (c_custkey % 200) * 1e-2 AS lat, 90e-1 + ((c_custkey * 7) % 400) * 1e-2 AS lng, {choose("c_custkey", WEEK_HOURS)} AS opening_hours_text
  FROM customer JOIN nation n ON n.n_nationkey = c_nationkey
  UNION ALL
  SELECT 'chain' AS source_type, 1000000000 + s_suppkey AS source_id, 'Genbrug ' || s_name AS title, 'genbrug' AS category, n.n_name AS city,
    CAST(1000 + (s_suppkey * 170) % 8999 AS VARCHAR(20)) AS postcode,
    CASE WHEN s_suppkey % 11 = 0 THEN NULL ELSE 550e-1 + ((s_suppkey * 10) % 200) * 1e-2 + 1e-3 END AS lat,
    CASE WHEN s_suppkey % 11 = 0 THEN NULL ELSE 90e-1 + ((s_suppkey * 70) % 400) * 1e-2 END AS lng, 'Mo-Fr 10:00-17:00' AS opening_hours_text
  FROM supplier JOIN nation n ON n.n_nationkey = s_nationkey) x""",
    "v_places": f"""
SELECT c_custkey AS id, 'sted-' || CAST(c_custkey AS VARCHAR(20)) AS slug, {choose("c_custkey", ["Hansens loppelade", "Bagvejens garagesalg", "Møllegårdens lopper", "Ørbæk loppe", "Kirkens hus"])} || CASE WHEN c_custkey % 4 = 0 THEN ' og lade' ELSE '' END AS name,
  {choose("c_custkey", PLACE_TYPES)} AS place_type,
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'Bagvejen ' || CAST(c_custkey % 40 AS VARCHAR(20)) || CASE WHEN c_custkey % 3 = 0 THEN ' B' ELSE '' END END AS street,
  CAST(1000 + (c_custkey * 13) % 8999 AS VARCHAR(20)) AS postcode, n.n_name AS city,
  CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE 551e-1 + (c_custkey % 150) * 1e-2 + (c_custkey % 2) * 4e-4 END AS lat,
  CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE 89e-1 + ((c_custkey * 7) % 611) * 1e-2 END AS lng,
  {choose("c_custkey", ["exact", "street", "postcode", "area", "unknown"])} AS geo_precision,
  {choose("c_custkey", VISIBILITIES)} AS address_visibility, {choose("c_custkey", STATUSES)} AS status,
  CASE CAST(c_custkey % 7 AS INT) WHEN 0 THEN CAST(20300000 + CAST(floor(c_custkey / 21) AS BIGINT) AS VARCHAR(20)) WHEN 1 THEN NULL WHEN 2 THEN '+45 ' || CAST(31220000 + CAST(floor(c_custkey / 28) AS BIGINT) AS VARCHAR(20))
    WHEN 3 THEN '12345678' WHEN 4 THEN '0045 ' || CAST(40500000 + CAST(floor(c_custkey / 21) AS BIGINT) AS VARCHAR(20)) WHEN 5 THEN '11111111' ELSE '555' END AS phone,
  CASE CAST(c_custkey % 6 AS INT) WHEN 0 THEN 'https://www.facebook.com/groups/' || CAST(CAST(floor(c_custkey / 18) AS BIGINT) AS VARCHAR(20)) WHEN 1 THEN NULL WHEN 2 THEN 'facebook.com/lopper' || CAST(CAST(floor(c_custkey / 24) AS BIGINT) AS VARCHAR(20))
    WHEN 3 THEN 'https://facebook.com/profile.php?id=' || CAST(CAST(floor(c_custkey / 12) AS BIGINT) AS VARCHAR(20)) WHEN 4 THEN 'https://example.com/x' ELSE 'https://fb.com/posts/1' END AS profile_url,
  CASE WHEN c_custkey % 4 = 0 THEN 'Jens ' || CAST(CAST(floor(c_custkey / 8) AS BIGINT) AS VARCHAR(20)) END AS contact_name,
  CASE WHEN c_custkey % 3 = 0 THEN 'Hver weekend' END AS pattern,
  c_custkey % 6 = 0 AS call_first, CAST(20 + c_custkey % 81 AS INT) AS confidence, CAST(c_custkey % 101 AS INT) AS find_score,
  CASE WHEN c_custkey % 4 = 1 THEN 'Ring først' END AS opening_notes, CAST(c_custkey % 3 AS INT) AS n_images,
  {choose("c_custkey", ["lav", "middel", "hoej", None])} AS price_level,
  DATE '2024-09-01' + CAST(c_custkey % 660 AS INT) AS last_seen, CASE WHEN c_custkey % 4 = 3 THEN DATE '2025-03-01' + CAST(c_custkey % 480 AS INT) END AS last_verified
FROM customer JOIN nation n ON n.n_nationkey = c_nationkey""",
    "v_sources": f"""
SELECT event_id, user_id AS place_id, {choose("event_id", SOURCE_TYPES)} AS source_type,
  CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'https://www.kilde' || CAST(event_id % 6 AS VARCHAR(20)) || '.example.com/opslag/' || CAST(event_id AS VARCHAR(20)) END AS url,
  CAST(ts AS DATE) AS observed_at FROM events""",
    "v_visits": """
SELECT event_id, user_id AS place_id, CAST(ts AS DATE) AS visited_at,
  CASE CAST(event_id % 5 AS INT) WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false ELSE NULL END AS was_open, event_id % 17 = 0 AS reported_closed
FROM events WHERE event_type = 'view'""",
    "v_trips": """
SELECT trip_id, pos, event_id, lat, lng FROM (
  SELECT custkey AS trip_id, row_number() OVER (PARTITION BY custkey ORDER BY a.k) AS pos, a.k AS event_id, lat, lng FROM v_key a JOIN v_raw b ON b.k = a.k) x
WHERE pos <= 10""",
    "v_stamp": "SELECT k, m, source_key, title, CASE WHEN k % 7 = 0 THEN description ELSE NULL END AS payload FROM v_raw",
}
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "labels", "conversations"]


def _needs(sql: str, names: list[str]) -> list[str]:
    return [n for n in names if re.search(rf"\b{n}\b", sql)]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view as a DataFrame; base tables are read as they are."""
    made: dict[str, DataFrame] = {}

    def make(n: str) -> DataFrame:
        if n not in made:
            if n in VIEWS:
                inner = _needs(VIEWS[n], [*VIEWS, *TABLES])
                sql = re.sub(rf"\b({'|'.join(inner)})\b(?!\.)", lambda m: "{" + m[1] + "}", VIEWS[n])
                made[n] = spark.sql(sql, **{i: make(i) for i in inner})
            else:
                made[n] = table(spark, sf_dir, n)
        return made[n]

    return make(name)


def with_views(sql: str) -> str:
    """SQL with the views that it names as common table expressions."""
    order: list[str] = []

    def add(text: str) -> None:
        for n in _needs(text, list(VIEWS)):
            if n not in order:
                add(VIEWS[n])
                order.append(n)

    add(sql)
    head = ", ".join(f"{n} AS ({VIEWS[n]})" for n in order)
    own = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", sql)
    if not order:
        return sql
    return f"WITH {own[1] or ''}{head}, {sql[own.end() :]}" if own else f"WITH {head} {sql}"
