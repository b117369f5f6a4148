"""Queries for aggregations, lifecycle, sources and streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from localmarkets.functions import geo
from localmarkets.functions import text as T
from localmarkets.operators import joins as J
from localmarkets.operators import lifecycle as L
from localmarkets.operators import rollups as U
from localmarkets.operators.resolve import merge_fields
from localmarkets.plans.resolve import q_haversine
from localmarkets.plans.text import Q_INDOOR, Q_OUTDOOR, q_domain, q_free, q_has, q_in_out, q_stalls, q_title
from localmarkets.shared import cut, shared_path
from localmarkets.sources import exports, feeds
from localmarkets.streaming import events as R
from localmarkets.views import TODAY, view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
c = F.col


def today():
    return F.lit(TODAY).cast("date")


def query(name: str, sql: str | None = None) -> Callable:
    def keep(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            SQL[name] = with_views(sql)
        return f

    return keep


# --- aggregations ---
@query("A1_source_rollup", "SELECT l_orderkey, count(DISTINCT l_suppkey) AS sources, max(l_shipdate) AS newest, array_to_string(list_sort(list_distinct(list(l_suppkey))), ',') AS listed FROM lineitem GROUP BY l_orderkey")
def _(spark, d):
    told = U.source_rollup(view(spark, d, "lineitem"), "l_orderkey", "l_suppkey", "l_shipdate")
    return told.withColumn("listed", F.array_join(F.transform("listed", lambda s: s.cast("string")), ","))


@query("A2_active_sources", "SELECT s_suppkey, s_name, count(DISTINCT l_orderkey) AS events FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey AND l_linestatus = 'O' GROUP BY ALL")
def _(spark, d):
    links = view(spark, d, "lineitem").where("l_linestatus = 'O'").withColumnRenamed("l_suppkey", "s_suppkey")
    return U.active_sources(view(spark, d, "supplier"), links, "s_suppkey", "s_name", "l_orderkey")


Q_MINED = f"""d AS (SELECT k, {q_domain('contact_website')} AS domain, title, source_key FROM v_raw WHERE contact_website IS NOT NULL),
m AS (SELECT domain, count(*) AS mentions, count(DISTINCT title) AS titles, count(DISTINCT title) FILTER (WHERE {q_title('title')} IN (SELECT DISTINCT {q_title('title')} FROM v_raw WHERE k % 4 = 0)) AS covered, count(DISTINCT source_key) AS sources
  FROM d WHERE domain IS NOT NULL AND domain <> 'blog.tiontion.example.com' GROUP BY domain)"""


def mined(spark, d):
    raws = view(spark, d, "v_raw")
    known = raws.where("k % 4 = 0").select("title").distinct().select(T.normalize_title(c("title")).alias("title"))
    return cut(feeds.mine_domains(raws, ["blog.tiontion.example.com"], known), "mined-domains")


@query("A3_mine_domains", f"WITH {Q_MINED} SELECT domain, mentions, titles, covered, sources FROM m")
def _(spark, d):
    return mined(spark, d)


@query("J15_coverage_join", f"WITH {Q_MINED} SELECT domain, titles, covered FROM m")
def _(spark, d):
    return mined(spark, d).select("domain", "titles", "covered")


@query("A4_net_new_candidates", f"WITH {Q_MINED} SELECT domain, titles - covered AS fresh FROM m WHERE titles - covered >= 1")
def _(spark, d):
    return mined(spark, d).select("domain", (c("titles") - c("covered")).alias("fresh"), "mentions").where("fresh >= 1").orderBy(F.desc("fresh"), F.desc("mentions"), "domain").select("domain", "fresh")


@query("T29_domains_from_raw", f"SELECT k, {q_domain('contact_website')} AS domain, 'website' AS field FROM v_raw WHERE ({q_domain('contact_website')}) IS NOT NULL")
def _(spark, d):
    return feeds.domains_of(view(spark, d, "v_raw"))


@query("A8_summarize_reviews", "SELECT user_id % 50 AS place, count(*) AS n, floor(avg(rating) * 10 + 5e-1) / 10 AS mean FROM (SELECT user_id, CAST(event_id % 7 AS INT) AS rating FROM events) x WHERE rating BETWEEN 1 AND 5 GROUP BY 1")
def _(spark, d):
    rows = view(spark, d, "events").select((c("user_id") % 50).alias("place"), (c("event_id") % 7).cast("int").alias("rating"))
    return U.summarize_reviews(rows, "place", "rating")


@query("A8_newest_reviews", "SELECT user_id % 50 AS place, event_id, CAST(row_number() OVER (PARTITION BY user_id % 50 ORDER BY ts DESC, event_id) AS INT) AS place_in_list FROM events WHERE event_id % 7 BETWEEN 1 AND 5")
def _(spark, d):
    rows = view(spark, d, "events").select("event_id", "ts", (c("user_id") % 50).alias("place"), (c("event_id") % 7).cast("int").alias("rating"))
    return U.newest_reviews(rows, "place", "rating", "ts", "event_id").select("place", "event_id", "place_in_list")


@query("A10_pipeline_stats", "SELECT o_orderstatus, count(*) AS n, count(*) FILTER (WHERE o_totalprice > 250000) AS large FROM orders GROUP BY 1")
def _(spark, d):
    return U.pipeline_stats(view(spark, d, "orders"), "o_orderstatus", large=c("o_totalprice") > 250000)


@query("A11_latest_update", "SELECT greatest(max(ts) FILTER (WHERE event_type = 'purchase'), max(ts) FILTER (WHERE event_type = 'view')) AS latest FROM events")
def _(spark, d):
    of = lambda t: F.when(c("event_type") == t, c("ts"))
    return U.latest_update(view(spark, d, "events"), of("purchase"), of("view"))


@query("A14_new_share_guard", "SELECT o_orderkey, CASE WHEN (SELECT avg(CAST(o_orderdate >= TIMESTAMP '1998-01-01' AS INT)) FROM orders) > 4e-1 THEN false ELSE o_orderdate >= TIMESTAMP '1998-01-01' END AS fresh FROM orders")
def _(spark, d):
    rows = view(spark, d, "orders").select("o_orderkey", (c("o_orderdate") >= "1998-01-01").alias("fresh"))
    return U.new_share_guard(rows, "fresh")


@query("L15_newly_added", "SELECT k, DATE '2026-07-03' - last_seen < 10 AND (SELECT avg(CAST(DATE '2026-07-03' - last_seen < 10 AS INT)) FROM v_raw) <= 4e-1 AS fresh FROM v_raw")
def _(spark, d):
    return U.newly_added(view(spark, d, "v_raw").select("k", "last_seen"), "last_seen", today()).select("k", "fresh")


_won = "first(source_key ORDER BY trust DESC, last_seen DESC, k DESC) FILTER (WHERE {0} IS NOT NULL AND CAST({0} AS VARCHAR) NOT IN ('', '{1}'))"


@query("A16_contributions_by_source", f"""
WITH w AS (SELECT m, {", ".join(_won.format(f, none) + f" AS {f}" for f, none in [("street", ""), ("is_free", ""), ("stall_count_text", ""), ("contact_website", ""), ("indoor_outdoor", "unknown"), ("venue_name", "")])} FROM v_raw GROUP BY m),
p AS (SELECT m, 1 AS i, 'adresse' AS label, street AS source FROM w UNION ALL SELECT m, 3, 'entré', is_free FROM w UNION ALL SELECT m, 4, 'antal stande', stall_count_text FROM w
  UNION ALL SELECT m, 6, 'website', contact_website FROM w UNION ALL SELECT m, 8, 'inde/ude', indoor_outdoor FROM w UNION ALL SELECT m, 9, 'sted', venue_name FROM w)
SELECT m, source, string_agg(label, ',' ORDER BY i) AS fields FROM p WHERE source IS NOT NULL GROUP BY m, source""")
def _(spark, d):
    events = merge_fields(view(spark, d, "v_raw").withColumn("cluster", c("m"))).select(c("cluster").alias("m"), "provenance")
    return U.contributions_by_source(events, "m").withColumn("fields", F.array_join("fields", ","))


@query("A17_map_clusters", "SELECT CAST(floor(lat / 5e-1) AS BIGINT) AS y, CAST(floor(lng / 5e-1) AS BIGINT) AS x, count(*) AS n FROM v_raw GROUP BY 1, 2")
def _(spark, d):
    return view(spark, d, "v_raw").groupBy(geo.cell(c("lat"), 0.5).alias("y"), geo.cell(c("lng"), 0.5).alias("x")).agg(F.count("*").alias("n"))


@query("A17_map_pyramid", "SELECT CAST(z AS INT) AS zoom, CAST(floor(lat * pow(2, z) / 32) AS BIGINT) AS y, CAST(floor(lng * pow(2, z) / 32) AS BIGINT) AS x, count(*) AS n FROM v_raw, range(0, 13) t(z) GROUP BY 1, 2, 3")
def _(spark, d):
    return U.map_pyramid(view(spark, d, "v_raw"))


# --- joins ---
@query("J5_enrich_venues", f"""
WITH k AS (SELECT * FROM v_venues WHERE source_type = 'map' AND contains({q_title('title')}, 'genbrug')), h AS (SELECT * FROM v_venues WHERE source_type = 'chain'),
b AS (SELECT h.source_id, first(k.source_id ORDER BY k.category, k.title, k.source_id) AS match FROM h JOIN k ON {q_haversine('h.lat', 'h.lng', 'k.lat', 'k.lng')} <= 220 GROUP BY 1)
SELECT h.source_id, match, CASE WHEN match IS NOT NULL THEN 'enrich' WHEN lat IS NULL THEN 'skip' ELSE 'insert' END AS action FROM h LEFT JOIN b ON b.source_id = h.source_id""")
def _(spark, d):
    rows = view(spark, d, "v_venues")
    return feeds.enrich_venues(rows.where("source_type = 'chain'"), rows.where("source_type = 'map'"), "genbrug")


@query("J8_attach_source_links", "SELECT o_orderkey, l_linenumber, s_name, s_acctbal FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey WHERE o_orderstatus = 'F'")
def _(spark, d):
    orders = view(spark, d, "orders").where("o_orderstatus = 'F'")
    rows = J.attach_source_links(orders, view(spark, d, "lineitem"), view(spark, d, "supplier"), ("o_orderkey", "l_orderkey"), ("l_suppkey", "s_suppkey"))
    return rows.select("o_orderkey", "l_linenumber", "s_name", "s_acctbal")


@query("J9_has_future_dates", "SELECT k, k IN (SELECT event_id FROM v_occ WHERE date >= DATE '2026-08-20') AS ahead FROM v_raw")
def _(spark, d):
    return J.has_future_dates(view(spark, d, "v_raw").select("k"), view(spark, d, "v_occ"), F.lit("2026-08-20").cast("date"), "k")


_home = lambda t: f"coalesce({t}.lat BETWEEN 544e-1 AND 579e-1 AND {t}.lng BETWEEN 78e-1 AND 153e-1, false)"
Q_ASKED = "CASE WHEN k % 11 = 0 THEN NULL ELSE street END AS street, CASE WHEN k % 4 = 2 THEN NULL ELSE postcode END AS postcode, CASE WHEN k % 3 = 0 THEN NULL WHEN k % 2 = 0 THEN 'By ' || postcode ELSE city END AS city"


@query("J10_geocode_lookup", f"""
WITH n AS (SELECT k, {Q_ASKED} FROM v_raw),
a AS (SELECT street, postcode, min(city) AS city, round(avg(lat), 6) AS lat, round(avg(lng), 6) AS lng, CASE CAST(min(k) % 3 AS INT) WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS quality FROM v_raw WHERE street IS NOT NULL AND k % 2 = 0 GROUP BY street, postcode),
p AS (SELECT postcode, CASE WHEN min(k) % 2 = 0 THEN 'By ' || postcode ELSE min(city) END AS city, round(avg(lat), 6) AS lat, round(avg(lng), 6) AS lng FROM v_raw WHERE k % 3 <> 1 GROUP BY postcode),
o AS (SELECT city AS town, count(*) AS n, any_value(postcode) AS code FROM p GROUP BY city), t AS (SELECT o.town, p.* FROM o JOIN p ON p.postcode = o.code WHERE n = 1),
s AS (SELECT n.k, CASE WHEN a.quality IN ('A', 'B') AND {_home('a')} THEN 1 WHEN {_home('p')} THEN 2 WHEN {_home('t')} THEN 3 END AS stage, a.quality AS aq, a.lat AS alat, a.postcode AS ac, a.city AS an, p.lat AS plat, p.postcode AS pc, p.city AS pn, t.lat AS tlat, t.postcode AS tc, t.city AS tn
  FROM n LEFT JOIN a ON a.street = n.street AND a.postcode = n.postcode LEFT JOIN p ON p.postcode = n.postcode
  LEFT JOIN t ON t.town = coalesce(n.city, CASE WHEN n.postcode IS NULL THEN n.street END))
SELECT k, CASE stage WHEN 1 THEN aq WHEN 2 THEN 'P' WHEN 3 THEN 'P' END AS quality, CASE stage WHEN 1 THEN alat WHEN 2 THEN plat WHEN 3 THEN tlat END AS lat,
  CASE stage WHEN 1 THEN ac WHEN 2 THEN pc WHEN 3 THEN tc END AS resolved_postcode, CASE stage WHEN 1 THEN an WHEN 2 THEN pn WHEN 3 THEN tn END AS resolved_city FROM s""")
def _(spark, d):
    rows = view(spark, d, "v_raw")
    asked = rows.selectExpr("k", *[x.strip() for x in Q_ASKED.replace("END AS street,", "END AS street;").replace("END AS postcode,", "END AS postcode;").split(";")])
    point = [F.round(F.avg(n), 6).alias(n) for n in ("lat", "lng")]
    quality = F.when(F.min("k") % 3 == 0, "A").when(F.min("k") % 3 == 1, "B").otherwise("C")
    addresses = rows.where("street is not null and k % 2 = 0").groupBy("street", "postcode").agg(F.min("city").alias("city"), quality.alias("quality"), *point)
    name = F.when(F.min("k") % 2 == 0, F.concat(F.lit("By "), "postcode")).otherwise(F.min("city"))
    centres = rows.where("k % 3 <> 1").groupBy("postcode").agg(name.alias("city"), *point)
    return J.geocode_lookup(asked, addresses, centres).select("k", "quality", "lat", "resolved_postcode", "resolved_city")


@query("J11_centroid_fallback", "SELECT postcode, CASE WHEN bool_and(lat BETWEEN 544e-1 AND 579e-1 AND lng BETWEEN 78e-1 AND 153e-1) THEN 'centre' ELSE 'mean' END AS kind, round(avg(CASE WHEN lng >= 78e-1 THEN lat END), 6) AS lat FROM v_raw GROUP BY postcode")
def _(spark, d):
    return J.centroid_fallback(view(spark, d, "v_raw"), "postcode", c("lng") >= 7.8)


@query("J12_reverse_lookup", """
WITH g AS (SELECT round(lat, 5) AS y, round(lng, 5) AS x, min(city) AS town FROM v_venues WHERE lat IS NOT NULL GROUP BY 1, 2),
p AS (SELECT g.*, min(v.postcode) AS code FROM g JOIN v_venues v ON round(v.lat, 5) = y AND round(v.lng, 5) = x AND v.city = town GROUP BY y, x, town)
SELECT k, town, code AS town_postcode FROM (SELECT k, floor(lat * 100) / 100 AS lat, floor(lng * 100) / 100 AS lng FROM v_raw) r LEFT JOIN p ON y = round(lat, 5) AND x = round(lng, 5)""")
def _(spark, d):
    rows = view(spark, d, "v_raw").select("k", *[(F.floor(c(n) * 100) / 100).alias(n) for n in ("lat", "lng")])
    return J.reverse_lookup(rows, view(spark, d, "v_venues")).select("k", "town", "town_postcode")


@query("J16_hours_fill", "SELECT source_id, coalesce(nullif(trim(opening_hours_text), ''), CASE WHEN source_id % 2 = 0 THEN 'Sa 10:00-14:00' END) AS hours, coalesce(source_id % 7, 0) AS confirms FROM v_venues")
def _(spark, d):
    rows = view(spark, d, "v_venues")
    curated = rows.where("source_id % 2 = 0").select("source_id", F.lit("Sa 10:00-14:00").alias("own"))
    return J.fill_hours(rows, curated, rows.select("source_id", (c("source_id") % 7).alias("confirms")), "source_id")


@query("J17_grid_weather_join", """
WITH f AS (SELECT y, x, date, CAST((y + x + day(date)) % 10 AS INT) * 10 AS rain FROM (SELECT DISTINCT CAST(floor(lat / 5e-1) AS BIGINT) AS y, CAST(floor(lng / 5e-1) AS BIGINT) AS x, start_date AS date FROM v_raw WHERE k % 5 < 3) z)
SELECT k, rain, k % 6 < 3 AND rain >= 50 AS warn FROM v_raw JOIN f ON y = CAST(floor(lat / 5e-1) AS BIGINT) AND x = CAST(floor(lng / 5e-1) AS BIGINT) AND f.date = start_date WHERE indoor_outdoor IN ('outdoor', 'mixed') OR k % 6 < 3""")
def _(spark, d):
    rows = view(spark, d, "v_raw")
    cells = rows.where("k % 5 < 3").select(geo.cell(c("lat"), 0.5).alias("y"), geo.cell(c("lng"), 0.5).alias("x"), c("start_date").alias("date")).distinct()
    forecast = cells.withColumn("rain", ((c("y") + c("x") + F.dayofmonth("date")) % 10).cast("int") * 10)
    return J.grid_weather(rows, forecast, "start_date", c("k") % 6 < 3).select("k", "rain", "warn")


@query("J18_added_domains", f"WITH d AS (SELECT DISTINCT {q_domain('url')} AS domain FROM pages) SELECT domain, domain LIKE 'm.%' AS added FROM d WHERE domain IS NOT NULL")
def _(spark, d):
    domains = view(spark, d, "pages").select(T.normalize_domain(c("url")).alias("domain")).where("domain is not null").distinct()
    return J.added_domains(domains, domains.where("domain like 'm.%'"))


# --- windows ---
@query("W5_best_candidate", "SELECT l_orderkey, l_linenumber FROM (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem) x WHERE n = 1")
def _(spark, d):
    rank = [c("l_extendedprice"), -c("l_linenumber"), -c("l_partkey"), -c("l_suppkey")]
    rows = view(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey", "l_suppkey")
    return U.best_candidate(rows, "l_orderkey", *rank).select("l_orderkey", "l_linenumber")


@query("W6_freshest_per_source", """
SELECT l_orderkey, l_suppkey, newest, min('/' || l_orderkey || '/' || l_linenumber) AS url FROM (SELECT *, max(l_shipdate) OVER (PARTITION BY l_orderkey, l_suppkey) AS newest FROM lineitem) x WHERE l_shipdate = newest GROUP BY 1, 2, 3""")
def _(spark, d):
    rows = view(spark, d, "lineitem").withColumn("url", F.concat(F.lit("/"), c("l_orderkey").cast("string"), F.lit("/"), c("l_linenumber").cast("string")))
    return U.freshest_per_source(rows, "l_suppkey", "l_shipdate", "url", "l_orderkey")


# --- sets ---
@query("U4_vanished", "SELECT k FROM v_raw WHERE source_key <> 'src4' AND k % 10 = 0")
def _(spark, d):
    rows = view(spark, d, "v_raw").select("source_key", "k")
    healthy = rows.select("source_key").distinct().where("source_key <> 'src4'")
    return L.vanished(rows, rows.where("k % 10 <> 0"), ["k"], healthy).select("k")


Q_DAYS = "SELECT event_id, list_sort(list_distinct(list(date))) AS days FROM v_occ GROUP BY event_id"


@query("U5_date_overlap", f"WITH d AS ({Q_DAYS}) SELECT a.event_id, list_has_any(a.days, b.days) AS overlap, len(a.days) = len(b.days) AND list_has_all(b.days, a.days) AS same FROM d a JOIN d b ON b.event_id = a.event_id + 1")
def _(spark, d):
    days = J.date_sets(view(spark, d, "v_occ"))
    after = days.select((c("event_id") - 1).alias("event_id"), c("days").alias("other"))
    same = J.identical_dates(c("days"), c("other"))
    return days.join(after, "event_id").select("event_id", J.date_overlap(c("days"), c("other")).alias("overlap"), same.alias("same"))


@query("U6_distinct_union", f"WITH d AS ({Q_DAYS}) SELECT event_id, len(list_distinct(list_concat(days, [DATE '2026-07-04', DATE '2026-07-11']))) AS n FROM d")
def _(spark, d):
    more = F.array(F.lit("2026-07-04").cast("date"), F.lit("2026-07-11").cast("date"))
    return J.date_sets(view(spark, d, "v_occ")).select("event_id", F.size(J.distinct_union(c("days"), more)).cast("long").alias("n"))


# --- lifecycle ---
def snapshots(spark, d):
    rows = view(spark, d, "v_raw").select("source_key", "k", c("title").alias("payload"), "last_seen")
    old = rows.where("k % 10 <> 1")
    new = rows.where("k % 10 <> 2").withColumns({"payload": F.when(c("k") % 10 == 3, F.concat("payload", F.lit("!"))).otherwise(c("payload")), "last_seen": today()})
    return old, new


@query("L1_upsert_raw", """
SELECT source_key, k, CASE CAST(k % 10 AS INT) WHEN 1 THEN 'new' WHEN 2 THEN 'kept' WHEN 3 THEN 'changed' ELSE 'unchanged' END AS change, CASE WHEN k % 10 = 2 THEN last_seen ELSE DATE '2026-07-03' END AS last_seen,
  substr(sha256(title || CASE WHEN k % 10 = 3 THEN '!' ELSE '' END), 1, 24) AS hash FROM v_raw""")
def _(spark, d):
    return L.upsert_raw(*snapshots(spark, d), ["source_key", "k"]).select("source_key", "k", "change", "last_seen", "hash")


@query("L5_expire_past", "SELECT k, CASE WHEN k % 5 > 0 AND k NOT IN (SELECT event_id FROM v_occ WHERE date >= DATE '2026-08-20') THEN 'expired' WHEN k % 5 = 0 THEN 'cancelled' ELSE 'active' END AS status FROM v_raw")
def _(spark, d):
    rows = view(spark, d, "v_raw").select("k", F.when(c("k") % 5 == 0, "cancelled").otherwise("active").alias("status"))
    return L.expire_past(rows, view(spark, d, "v_occ"), F.lit("2026-08-20").cast("date"))


@query("L6_reconcile_vanished", """
WITH g AS (SELECT m AS event_id, count(*) AS links, count(*) FILTER (WHERE NOT (k % 4 = 0 AND source_key <> 'src4')) AS left_ FROM v_raw GROUP BY m) SELECT event_id, links, left_ AS remaining FROM g WHERE left_ < links""")
def _(spark, d):
    rows = view(spark, d, "v_raw").select(c("m").alias("event_id"), c("k").alias("raw_id"), "source_key")
    gone = L.vanished(rows, rows.where("raw_id % 4 <> 0"), ["raw_id"], rows.select("source_key").distinct().where("source_key <> 'src4'"))
    return L.reconcile(rows.select("event_id").distinct(), rows, gone).withColumnRenamed("left", "remaining")


@query("L8_backfill", f"""
SELECT k, CASE WHEN indoor_outdoor = 'unknown' THEN {q_in_out(q_has("(title || ' ' || coalesce(description, ''))", Q_INDOOR), q_has("(title || ' ' || coalesce(description, ''))", Q_OUTDOOR))} ELSE indoor_outdoor END AS place,
  coalesce(stall_count_text, {q_stalls("(title || ' ' || coalesce(description, ''))")}) AS stalls, coalesce(is_free, {q_free("(title || ' ' || coalesce(description, ''))")}) AS free,
  CASE WHEN lat BETWEEN 544e-1 AND 579e-1 AND lng BETWEEN 78e-1 AND 153e-1 THEN lat END AS lat FROM v_raw""")
def _(spark, d):
    return L.backfill(view(spark, d, "v_raw")).select("k", "place", "stalls", "free", "lat")


Q_STATE = "CASE WHEN source_id % 9 = 0 THEN 'gone' ELSE 'active' END"


@query("L9_upsert_venues", f"""
SELECT source_type, source_id, CASE WHEN source_id % 2 = 0 AND source_id % 3 = 0 THEN title || ' ny' ELSE title END AS title, category, CASE WHEN source_id % 2 = 0 THEN NULL ELSE city END AS city,
  CASE WHEN source_id % 5 = 0 THEN 'ny-' ELSE 'slug-' END || source_id AS slug, CASE WHEN source_id % 2 = 0 THEN 'active' ELSE {Q_STATE} END AS status FROM v_venues WHERE source_id % 2 = 0 OR source_id % 5 <> 0""")
def _(spark, d):
    rows = view(spark, d, "v_venues").select("source_type", "source_id", "title", "category", "city", F.concat(F.lit("slug-"), c("source_id").cast("string")).alias("slug"), F.expr(Q_STATE).alias("status"))
    title = F.when(c("source_id") % 3 == 0, F.concat("title", F.lit(" ny"))).otherwise(c("title"))
    batch = rows.where("source_id % 2 = 0").select("source_type", "source_id", title.alias("title"), "category", F.lit(None).cast("string").alias("city"))
    return L.upsert_venues(rows.where("source_id % 5 <> 0"), batch, ["source_type", "source_id"], F.concat(F.lit("ny-"), c("source_id").cast("string")))


@query("L10_retire_venues", f"SELECT source_type, source_id, CASE WHEN source_type = 'chain' AND source_id % 4 = 0 AND {Q_STATE} = 'active' THEN 'gone' ELSE {Q_STATE} END AS status FROM v_venues")
def _(spark, d):
    rows = view(spark, d, "v_venues").select("source_type", "source_id", F.expr(Q_STATE).alias("status"))
    return L.retire(rows, rows.where("source_id % 4 <> 0"), ["chain"])


@query("L14_candidate_funnel", f"""
WITH {Q_MINED} SELECT domain, mentions, CASE WHEN length(domain) % 3 = 0 THEN 'promoted' WHEN length(domain) % 3 = 1 THEN 'rejected' ELSE 'new' END AS status, length(domain) % 3 = 2 AS due FROM m""")
def _(spark, d):
    fresh = mined(spark, d)
    old = fresh.where(F.length("domain") % 3 != 2).select("domain", F.when(F.length("domain") % 3 == 0, "promoted").otherwise("rejected").alias("status"), F.lit("seen").alias("note"), F.lit(1).cast("long").alias("mentions"))
    return L.candidate_funnel(old, fresh).select("domain", "mentions", "status", "due")


@query("S16_accumulate_harvest", """
WITH b AS (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(ts AS DATE) END AS date, event_id % 2 AS batch, event_id % 500 AS key FROM events),
n AS (SELECT key, date, row_number() OVER (PARTITION BY key ORDER BY batch DESC, event_id DESC) AS n FROM b) SELECT key, date FROM n WHERE n = 1 AND (date IS NULL OR date >= DATE '2025-02-15' - 400)""")
def _(spark, d):
    rows = view(spark, d, "events").select((c("event_id") % 500).alias("key"), F.when(c("event_id") % 4 != 0, F.to_date("ts")).alias("date"), "event_id")
    newest = lambda x: x.groupBy("key").agg(F.max_by(F.struct("date"), "event_id").alias("s")).select("key", "s.date")
    return L.accumulate(newest(rows.where("event_id % 2 = 0")), newest(rows.where("event_id % 2 = 1")), "key", F.lit("2025-02-15").cast("date")).select("key", "date")


# --- sources ---
@query("S1_read_post_feed", "SELECT CAST(k AS VARCHAR) AS id, title AS name FROM v_raw WHERE k % 7 <> 6")
def posts(spark, d):
    rows = view(spark, d, "v_raw")
    item = F.struct(c("k").cast("string").alias("id"), c("title").alias("name"), c("description").alias("text"), c("start_date").cast("string").alias("startDate"))
    line = F.when(c("k") % 7 == 6, F.lit("not json")).when(c("k") % 2 == 0, F.to_json(F.array(item))).otherwise(F.to_json(F.struct(F.array(item).alias("items"))))
    return feeds.post_items(rows.select(line.alias("line"))).select("id", "name")


@query("S2_route_feed_item", f"SELECT k, 'event' AS path FROM v_raw WHERE k % 3 = 0 UNION ALL SELECT k, 'post' FROM v_raw WHERE k % 3 <> 0 AND {q_has('description', 'loppe|kr(?:æ|ae)mmer|genbrug|bagagerum|antik|julemarked|flea|marked')}")
def _(spark, d):
    rows = view(spark, d, "v_raw").select("k", F.when(c("k") % 3 == 0, c("title")).alias("name"), F.when(c("k") % 3 == 0, c("start_date").cast("string")).alias("startDate"), c("description").alias("text"))
    events, others = feeds.route_items(rows)
    return events.select("k", F.lit("event").alias("path")).unionByName(others.select("k", F.lit("post").alias("path")))


@query("S3_feed_event_days", """
SELECT event_id, CAST(day AS DATE) AS date, CASE WHEN CAST(day AS DATE) = CAST(ts AS DATE) THEN strftime(ts, '%H:%M') END AS start_time, CASE WHEN CAST(day AS DATE) = CAST(z AS DATE) THEN strftime(z, '%H:%M') END AS end_time
FROM (SELECT event_id, ts, z, unnest(generate_series(CAST(ts AS DATE), CAST(z AS DATE), INTERVAL 1 DAY)) AS day FROM (SELECT event_id, ts, ts + INTERVAL 50 HOUR AS z FROM events) a) x""")
def _(spark, d):
    ts = c("ts").cast("timestamp")
    return view(spark, d, "events").select("event_id", F.inline(feeds.event_days(ts, ts + F.expr("interval 50 hours"))))


@query("S4_calendar_api", "SELECT k AS id, title, CASE WHEN k % 2 = 0 THEN true END AS is_free, postcode, start_date AS date, CASE WHEN k % 3 <> 0 THEN '10:00' END AS start_time FROM v_raw")
def _(spark, d):
    at = lambda h: F.concat(c("start_date").cast("string"), F.lit(h))
    venue = F.struct(F.lit("x").alias("venue"), F.concat(F.lit("Vej 1, "), c("postcode"), F.lit(" By")).alias("address"))
    item = F.struct(c("k").alias("id"), "title", at(" 10:00:00").alias("start_date"), at(" 16:00:00").alias("end_date"), (c("k") % 3 == 0).alias("all_day"), F.when(c("k") % 2 == 0, "Gratis").alias("cost"), venue.alias("venue"))
    found = feeds.calendar_events(view(spark, d, "v_raw").select(F.to_json(item).alias("line")))
    return found.select("id", "title", "is_free", c("address.postcode").alias("postcode"), F.explode("days").alias("o")).select("id", "title", "is_free", "postcode", "o.date", "o.start_time")


@query("S6_merge_bureau_items", "SELECT o_custkey, first(o_orderpriority ORDER BY o_orderkey) AS path, count(*) AS n FROM orders GROUP BY o_custkey")
def _(spark, d):
    items = view(spark, d, "orders").withColumn("periods", F.array(F.to_date("o_orderdate")))
    return feeds.merge_items(items, "o_custkey", "o_orderkey", "o_orderpriority", "periods").select("o_custkey", "path", F.size("periods").cast("long").alias("n"))


def pages_ld(spark, d):
    """Pages with an event object, label rows and calendar rows put in by their number."""
    k = c("page_id").cast("string")
    event = F.concat(F.lit('{"@context":"https://schema.org","@type":"Event","name":"Marked '), k, F.lit('","startDate":"2026-08-01","endDate":"2026-08-02","location":{"name":"Torv","address":{"addressLocality":"By"}}} trailing'))
    label = F.concat(F.lit("<table><tr><th>Adresse</th><td>Vej <b>"), k, F.lit("</b></td></tr><tr><th>Entré</th><td>Gratis</td></tr><tr><th>Adresse</th><td>x</td></tr></table>"))
    rows = F.concat(F.lit("<li>2026-08-01 - 2026-08-0"), (c("page_id") % 9 + 1).cast("string"), F.lit(" | Marked</li><li>2026-08-01 - 2026-08-01 | Andet</li>"))
    html = F.concat("html", F.when(c("page_id") % 3 == 0, event).otherwise(""), F.when(c("page_id") % 2 == 0, label).otherwise(""), rows)
    return view(spark, d, "pages").select("page_id", html.alias("html"))


@query("S7_json_ld_events", "SELECT page_id, 'Marked ' || page_id AS name, DATE '2026-08-01' AS start, DATE '2026-08-02' AS \"end\", 'By' AS town FROM pages WHERE page_id % 3 = 0")
def _(spark, d):
    return feeds.json_ld_events(pages_ld(spark, d))


@query("S9_labelled_fields", "SELECT page_id, 'Vej ' || page_id AS address, 'Gratis' AS entry FROM pages WHERE page_id % 2 = 0")
def _(spark, d):
    return feeds.labelled_fields(pages_ld(spark, d), {"address": "Adresse", "entry": "Entré"})


@query("S10_calendar_rows", "SELECT page_id, DATE '2026-08-01' AS start, CASE WHEN page_id % 9 <= 6 THEN 'Marked' ELSE 'Andet' END AS name FROM pages")
def _(spark, d):
    return feeds.calendar_rows(pages_ld(spark, d)).select("page_id", "start", "name")


@query("S11_extract_links", """SELECT DISTINCT href FROM (SELECT unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages) x WHERE href <> ''""")
def _(spark, d):
    return feeds.links(view(spark, d, "pages"))


@query("S13_registry_to_venues", "SELECT s_suppkey AS id, s_name AS name, 'Vej ' || s_suppkey AS street, CAST(1000 + s_suppkey % 8999 AS VARCHAR) AS postcode, 'By' AS city FROM supplier WHERE s_suppkey % 4 <> 0 AND s_suppkey % 5 <> 0 AND s_suppkey % 3 <> 0")
def _(spark, d):
    k = c("s_suppkey")
    address = F.when(k % 3 == 0, F.lit("Ukendt")).otherwise(F.concat(F.lit("Vej "), k.cast("string"), F.lit(", "), (1000 + k % 8999).cast("string"), F.lit(" By, Danmark")))
    return feeds.registry_venues(view(spark, d, "supplier").select(k.alias("id"), c("s_name").alias("name"), address.alias("address"), (k % 4 != 0).alias("active"), (k % 5 == 0).alias("opted_out")))


@query("S14_osm_to_venues", r"""
SELECT source_id AS id, title, CASE WHEN regexp_matches(lower(title), '\breol') THEN 'reolmarked' WHEN regexp_matches(lower(title), 'loppe|flea|kraemmer') THEN 'loppebutik' WHEN regexp_matches(lower(title), '\bantik') THEN 'antik' ELSE 'genbrug' END AS category
FROM v_venues WHERE source_type = 'map' AND source_id % 6 <> 0 AND source_id % 7 <> 0""")
def _(spark, d):
    k = c("source_id")
    tags = F.map_filter(F.map_from_arrays(F.array(*[F.lit(n) for n in ("name", "shop", "amenity", "opening_hours")]), F.array(F.when(k % 6 != 0, c("title")), F.lit("second_hand"), F.when(k % 7 == 0, "recycling"), c("opening_hours_text"))), lambda _, v: v.isNotNull())
    objects = view(spark, d, "v_venues").where("source_type = 'map'").select(F.lit("node").alias("type"), k.alias("id"), "lat", c("lng").alias("lon"), tags.alias("tags"))
    return feeds.osm_venues(objects).select("id", "title", "category")


@query("S19_append_document_log", "SELECT url, sha256(coalesce(html, '')) AS hash FROM pages WHERE page_id % 3 <> 0 EXCEPT SELECT url, sha256(coalesce(html, '')) FROM pages WHERE page_id % 3 = 0")
def _(spark, d):
    pages = view(spark, d, "pages")
    log = L.append_document_log(spark.createDataFrame([], "url string, hash string"), pages.where("page_id % 3 = 0"), today())
    return L.append_document_log(log, pages.where("page_id % 3 <> 0"), today()).select("url", "hash")


@query("Q18_list_candidates", f"WITH {Q_MINED} SELECT domain, mentions, CASE WHEN length(domain) % 4 > 0 THEN length(domain) % 4 END AS score FROM m WHERE mentions >= 2")
def _(spark, d):
    rows = mined(spark, d).withColumn("score", F.when(F.length("domain") % 4 > 0, F.length("domain") % 4))
    return L.list_candidates(rows).select("domain", "mentions", "score")


@query("Q20_list_tips", "SELECT conv_id, turn FROM conversations WHERE role = 'user' AND length(text) > 40")
def _(spark, d):
    return L.list_tips(view(spark, d, "conversations"), "conv_id", "turn", status=(c("role") == "user") & (F.length("text") > 40)).select("conv_id", "turn")


# --- streams ---
def stream(spark, d) -> DataFrame:
    return R.read_events(spark, d)


@query("R4_stream_source_counts", """
WITH w AS (SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2) SELECT start, event_type, n, total FROM w WHERE start + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY""")
def _(spark, d):
    path = shared_path(spark, "stream-counts")
    R.run_to_table(R.source_counts(stream(spark, d)), "append", path, path + "-checkpoint")
    return spark.read.parquet(path).select("start", "event_type", "n", F.round("total", 2).alias("total"))


@query("R2_stream_last_seen", "SELECT user_id, event_type, max(ts) AS last_seen FROM events GROUP BY 1, 2")
def _(spark, d):
    path = shared_path(spark, "stream-last-seen")
    rows = stream(spark, d).withColumnRenamed("ts", "last_seen")
    R.write_partials(rows, R.last_seen, path, path + "-checkpoint", R.last_seen).awaitTermination()
    return R.last_seen(R.read_partials(spark, path))


@query("R3_stream_recurrence", "SELECT user_id, count(DISTINCT CAST(ts AS DATE)) AS days, max(CAST(ts AS DATE)) - min(CAST(ts AS DATE)) AS span FROM events GROUP BY 1")
def _(spark, d):
    path = shared_path(spark, "stream-recurrence")
    R.write_partials(stream(spark, d), R.seen_days, path, path + "-checkpoint", lambda rows: rows.distinct()).awaitTermination()
    return R.recurrence(R.read_partials(spark, path))


@query("R1_stream_upsert_raw", "SELECT user_id, event_type, max(CAST(ts AS DATE)) AS last_seen FROM events GROUP BY 1, 2")
def _(spark, d):
    """Each batch makes the next snapshot of (source, id); the newest is read back."""
    path = shared_path(spark, "stream-snapshots")
    key = ["user_id", "event_type"]
    rows = stream(spark, d).select(*key, c("props").alias("payload"), c("ts").alias("last_seen"))
    R.upsert_stream(rows, key, path, path + "-checkpoint").awaitTermination()
    return R.snapshot(spark, path).select(*key, F.to_date("last_seen").alias("last_seen"))
