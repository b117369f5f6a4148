"""Queries for discovery: windows, filters, nearest, search, cities, trips, facts of texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from localmarkets.functions import facts, geo
from localmarkets.functions import text as T
from localmarkets.operators import listing as Q
from localmarkets.operators import postings as X
from localmarkets.operators import rollups as U
from localmarkets.operators import search as S
from localmarkets.plans.dates import reading
from localmarkets.plans.resolve import Q_CONF, Q_CONF_IN, Q_GEM, Q_HITS, confidence, q_haversine
from localmarkets.plans.text import q_base, q_clean_city, q_fold, q_folds, q_has, q_squeeze, q_title
from localmarkets.views import SENTENCES, TODAY, view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
c = F.col
HERE = (55.7, 12.5)
Q_DIST = lambda a="lat", b="lng": q_haversine("557e-1", "125e-1", a, b, "6371e0")


def query(name: str, sql: str | None = None) -> Callable:
    def keep(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            SQL[name] = with_views(sql)
        return f

    return keep


# --- facts of texts: expected readings are written out by sentence ---


def told(**by: dict[int, str]) -> dict[str, list[str]]:
    """SQL values by sentence; NULL where the text says nothing."""
    return {n: [v.get(i, "NULL") for i in range(len(SENTENCES))] for n, v in by.items()}


READ = told(
    parking={4: "false", 29: "false"},
    food={5: "true", 26: "false", 38: "true"},
    toilets={6: "true", 26: "false"},
    kids={13: "true"},
    accessibility={14: "true"},
    mobilepay={10: "true"},
    cash_only={9: "true", 10: "false"},
    weather_dependent={3: "true", 15: "true"},
    family_friendly={13: "true"},
)
GOODS = {
    7: "antik", 11: "moebler,keramik,boeger", 12: "vinyl,lego,legetoej", 21: "porcelaen,toej,smykker", 30: "toej,retro", 34: "legetoej,vaerktoej,elektronik",
}
_text = "regexp_replace(text, ' [0-9]+ boder$', '')"


@query("X1_extract_amenities", "SELECT k, " + ", ".join(f"{reading(_text, SENTENCES, v)} AS {n}" for n, v in READ.items()) + " FROM v_text")
def _(spark, d):
    return view(spark, d, "v_text").select("k", *[e.alias(n) for n, e in facts.amenities(c("text")).items()])


@query("X2_cash_only_resolution", f"SELECT k, {reading(_text, SENTENCES, READ['cash_only'])} AS cash_only FROM v_text")
def _(spark, d):
    low = F.lower("text")
    rows = view(spark, d, "v_text").select("k", facts.facet(low, facts.FACETS["cash"]).alias("cash"), facts.facet(low, facts.FACETS["mobilepay"]).alias("pay"))
    return rows.select("k", facts.cash_only(c("cash"), c("pay")).alias("cash_only"))


@query("X3_booking_url", f"SELECT k, CASE WHEN {_text} LIKE 'Book din stand%' THEN 'https://example.com/book' END AS url FROM v_text")
def _(spark, d):
    return view(spark, d, "v_text").select("k", facts.booking_url(c("text")).alias("url"))


@query("X4_goods_signals", f"SELECT k, coalesce({reading(_text, SENTENCES, [repr(GOODS.get(i, '')) for i in range(len(SENTENCES))])}, '') AS goods FROM v_text")
def _(spark, d):
    return view(spark, d, "v_text").select("k", F.array_join(facts.goods_signals(c("text")), ",").alias("goods"))


@query("X5_classify_venue", r"""
SELECT source_type, source_id, CASE WHEN regexp_matches(lower(title), '\breol') THEN 'reolmarked' WHEN regexp_matches(lower(title), 'loppe|flea|kraemmer') THEN 'loppebutik'
  WHEN source_id % 9 = 0 THEN 'antik' WHEN regexp_matches(lower(title), '\bantik') THEN 'antik' ELSE 'genbrug' END AS kind FROM v_venues""")
def _(spark, d):
    shop = F.when(c("source_id") % 9 == 0, "antiques").otherwise("second_hand")
    return view(spark, d, "v_venues").select("source_type", "source_id", facts.classify_venue(shop, c("title")).alias("kind"))


@query("X8_page_signals", """
SELECT page_id, regexp_matches(html, '"@type"[ ]*:[ ]*"Event"') AS json_ld, regexp_matches(html, '\\.ics|text/calendar', 'i') AS ical, regexp_matches(html, 'application/(rss|atom)\\+xml', 'i') AS rss,
  regexp_matches(html, 'wp-content|wp-json') AS wordpress, regexp_matches(html, 'lang="da"|æ|ø|å', 'i') AS danish FROM pages""")
def _(spark, d):
    told_ = facts.page_signals(c("html"))
    return view(spark, d, "pages").select("page_id", *[told_[n].alias(n) for n in ("json_ld", "ical", "rss", "wordpress", "danish")])


@query("K9_probe_score", """
SELECT page_id, score, CASE WHEN score >= 6 THEN 'promote' WHEN score >= 3 THEN 'review' ELSE 'none' END AS verdict FROM (
SELECT page_id, CASE WHEN page_id % 10 = 9 THEN 0 ELSE CAST(page_id % 3 = 0 AS INT) * 3 + CAST(page_id % 4 = 0 AS INT) * 4 + CAST(regexp_matches(html, '\\.ics|text/calendar', 'i') AS INT) * 2
  + CAST(regexp_matches(html, 'application/(rss|atom)\\+xml', 'i') AS INT) * 2 + CAST(regexp_matches(html, 'lang="da"|æ|ø|å', 'i') AS INT) + CAST(regexp_matches(html, 'wp-content|wp-json') AS INT) END AS score FROM pages) x""")
def _(spark, d):
    from localmarkets.functions import scores

    t = facts.page_signals(c("html"))
    score = scores.probe_score(F.when(c("page_id") % 10 == 9, 404).otherwise(200), c("page_id") % 3 == 0, c("page_id") % 4 == 0, t["ical"], t["rss"], F.size(t["keywords"]), t["danish"], t["wordpress"])
    return view(spark, d, "pages").select("page_id", score.alias("score"), scores.probe_verdict(score).alias("verdict"))


@query("X9_detect_recurrence", """
SELECT user_id, n >= 3 AND span >= 21 AS recurring, n, span FROM (SELECT user_id, count(DISTINCT CAST(ts AS DATE)) AS n, max(CAST(ts AS DATE)) - min(CAST(ts AS DATE)) AS span FROM events WHERE event_type = 'purchase' GROUP BY user_id) x""")
def _(spark, d):
    return U.detect_recurrence(view(spark, d, "events").where("event_type = 'purchase'"), "user_id", F.to_date("ts"))


# --- listings ---
def listings(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "v_raw").withColumn("source_count", (c("k") % 3 + 1).cast("int"))


def upcoming(spark: SparkSession, d: str) -> DataFrame:
    return Q.upcoming_listing(listings(spark, d), view(spark, d, "v_occ"), TODAY, confidence())


_kids, _access, _rain = (reading("description", SENTENCES, READ[n]) for n in ("kids", "accessibility", "weather_dependent"))
_inside = "(lat BETWEEN 544e-1 AND 579e-1 AND lng BETWEEN 78e-1 AND 153e-1)"
Q_UP = f"""
o AS (SELECT event_id, count(*) AS n, min(date) AS first_date, bool_or(v_occ.start_time IS NOT NULL) AS timed, list(date ORDER BY date, v_occ.start_time NULLS FIRST, v_occ.end_time NULLS FIRST) AS days FROM v_occ WHERE date BETWEEN DATE '2026-07-03' AND DATE '2026-07-03' + 365 GROUP BY event_id),
x AS (SELECT *, {Q_CONF} AS confidence, {Q_GEM.replace('CAST(start_time IS NOT NULL AS INT)', 'CAST(timed AS INT)')} AS points FROM (SELECT q.*, o.n, o.first_date, o.timed, o.days FROM ({Q_CONF_IN}) q JOIN o ON o.event_id = q.k) z),
u AS (SELECT k, title, category, venue_name, {q_clean_city('city', 'postcode')} AS city, postcode, street, CASE WHEN {_inside} THEN lat END AS lat, CASE WHEN {_inside} THEN lng END AS lng,
  {_inside} AND geocode_quality NOT IN ('source', 'A', 'B') AS approximate, is_free, indoor_outdoor, stall_count_text, confidence, CAST(k % 3 + 1 AS INT) AS source_count,
  confidence >= 7e-1 AND k % 3 = 0 AND n BETWEEN 1 AND 6 AND lat IS NOT NULL AND coalesce(CAST(nullif(regexp_extract(stall_count_text, '[0-9]+'), '') AS INT), 0) <= 150 AND points >= 6 AS gem,
  coalesce({_kids}, false) AS family_friendly, coalesce({_access}, false) AS accessible, coalesce({_rain}, false) AS weather_dependent,
  coalesce(substr({q_squeeze(q_folds('description'))}, 1, 400), '') AS search_text, first_date, least(n, 40) AS n_days, list_slice(days, 1, 40) AS days FROM x)"""
LISTING = ["k", "title", "category", "city", "lat", "lng", "approximate", "confidence", "gem", "family_friendly", "accessible", "weather_dependent", "first_date"]


@query("Q1_events_between", """
SELECT k, count(*) AS days, min(date) AS first_date FROM v_raw JOIN v_occ ON event_id = k WHERE date BETWEEN DATE '2026-07-03' AND DATE '2026-07-31' GROUP BY k""")
def _(spark, d):
    found = Q.events_between(listings(spark, d), view(spark, d, "v_occ"), TODAY, "2026-07-31")
    return found.select("k", F.size("occ").cast("long").alias("days"), F.element_at("occ", 1)["date"].alias("first_date"))


@query("Q2_upcoming_listing", f"WITH {Q_UP} SELECT {', '.join(LISTING)}, md5(search_text) AS search, n_days FROM u")
def q2(spark, d):
    return upcoming(spark, d).select(*LISTING, F.md5("search_text").alias("search"), F.size("occ").cast("long").alias("n_days"))


_next = lambda a, z: f"list_min(list_filter(days, lambda x: x BETWEEN {a} AND {z}))"


@query("Q3_explore", f"""
WITH {Q_UP} SELECT k, {_next("DATE '2026-07-03'", "DATE '2026-07-12'")} AS next_date, round({Q_DIST()}, 6) AS km FROM u
WHERE next_date IS NOT NULL AND coalesce(CAST(nullif(regexp_extract(stall_count_text, '[0-9]+'), '') AS INT), 0) >= 15 AND confidence >= 45e-2 AND source_count >= 2
  AND indoor_outdoor IN ('outdoor', 'mixed') AND {Q_DIST()} <= 150""")
def explore(spark, d):
    f = Q.Filters(last="2026-07-12", large=True, verified=True, place="outdoor", position=HERE, radius_km=150)
    return Q.explore(upcoming(spark, d), f, TODAY).select("k", "next_date", F.round("km", 6).alias("km"))


_hay = q_fold("concat_ws(' ', title, venue_name, city, postcode, street, search_text)")


@query("Q3_explore_text", f"""
WITH {Q_UP} SELECT k, first_date AS next_date FROM u WHERE contains({_hay}, 'marked') AND (contains({_hay}, 'vinyl') OR len(list_filter(string_split_regex({_hay}, '[^a-z0-9]+'), lambda w: length(w) >= 3 AND levenshtein(w, 'vinyl') <= 1)) > 0)""")
def _(spark, d):
    return Q.explore(upcoming(spark, d), Q.Filters(query="Vinyl marked"), TODAY).select("k", "next_date")


@query("Q4_explore_order", f"""
WITH {Q_UP}, s AS (SELECT k, confidence, n_days, {_next("DATE '2026-07-03'", "DATE '2026-07-05'")} AS next_date, {Q_DIST()} AS km FROM u WHERE family_friendly)
SELECT k, row_number() OVER (ORDER BY round(km, 9) NULLS LAST, next_date, n_days, k) AS place FROM s WHERE next_date IS NOT NULL""")
def _(spark, d):
    f = Q.Filters(family=True, position=HERE)
    rows = Q.explore(upcoming(spark, d), f, TODAY).withColumn("km", F.round("km", 9))
    return Q.numbered(rows, Q.explore_order(f), "place").select("k", "place")


@query("Q6_fallback_suggestions", f"""
WITH {Q_UP}, s AS (SELECT k, confidence, {_next("DATE '2026-07-03'", "DATE '2026-08-17'")} AS next_date FROM u WHERE family_friendly)
SELECT k, next_date FROM s WHERE next_date IS NOT NULL ORDER BY next_date, confidence DESC, k LIMIT 3""")
def _(spark, d):
    f = Q.Filters(family=True, position=(10.0, 10.0), radius_km=1)
    return Q.fallback_suggestions(upcoming(spark, d), f, TODAY).select("k", "next_date")


@query("Q7_near_me", f"WITH {Q_UP} SELECT k, round({Q_DIST()}, 6) AS km FROM u WHERE lat IS NOT NULL ORDER BY round({Q_DIST()}, 6), k LIMIT 12")
def _(spark, d):
    rows = Q.with_distance(upcoming(spark, d).where("lat is not null"), HERE)
    return rows.select("k", F.round("km", 6).alias("km")).orderBy("km", "k").limit(12)


@query("Q8_date_page", "SELECT k, title, min(date) AS date FROM v_raw JOIN v_occ ON event_id = k WHERE date BETWEEN DATE '2026-07-04' AND DATE '2026-07-05' GROUP BY k, title")
def _(spark, d):
    return Q.date_page(listings(spark, d), view(spark, d, "v_occ"), "2026-07-04", "2026-07-05").select("k", "title", "date")


_d21 = _next("DATE '2026-07-03'", "DATE '2026-07-24'")


@query("Q9_recommend", f"""
WITH {Q_UP}, s AS (SELECT *, {_d21} AS next_date, {Q_DIST()} AS km FROM u), t AS (SELECT k, next_date, round(confidence * 3e-1 + CASE WHEN km IS NOT NULL THEN greatest(0e0, 1e0 - km / 60) * 35e-2 ELSE 0 END
  + CASE WHEN next_date - DATE '2026-07-03' <= 7 THEN 25e-2 ELSE 0 END + CASE WHEN gem THEN 3e-1 ELSE 0 END + CASE WHEN k % 11 = 0 THEN 35e-2 ELSE 0 END + CASE WHEN family_friendly THEN 12e-2 ELSE 0 END
  + CASE WHEN is_free THEN 8e-2 ELSE 0 END, 6) AS score FROM s WHERE next_date IS NOT NULL)
SELECT k, next_date, score FROM t ORDER BY score DESC, next_date, k LIMIT 4""")
def _(spark, d):
    return Q.recommend(upcoming(spark, d), TODAY, HERE, c("k") % 11 == 0).select("k", "next_date", "score")


@query("K7_recommend_score", f"""
WITH {Q_UP}, s AS (SELECT *, {Q_DIST()} AS km, first_date - DATE '2026-07-03' AS days_left FROM u)
SELECT k, round(confidence * 3e-1 + CASE WHEN km IS NOT NULL THEN greatest(0e0, 1e0 - km / 60) * 35e-2 ELSE 0 END + CASE WHEN days_left <= 7 THEN 25e-2 ELSE 0 END + CASE WHEN gem THEN 3e-1 ELSE 0 END
  + CASE WHEN k % 11 = 0 THEN 35e-2 ELSE 0 END + CASE WHEN family_friendly THEN 12e-2 ELSE 0 END + CASE WHEN is_free THEN 8e-2 ELSE 0 END, 6) AS score FROM s""")
def _(spark, d):
    from localmarkets.functions import scores

    rows = Q.with_distance(upcoming(spark, d), HERE)
    score = scores.recommend_score(c("confidence"), c("km"), F.datediff("first_date", Q.day(TODAY)), c("gem"), c("k") % 11 == 0, c("family_friendly"), F.coalesce("is_free", F.lit(False)))
    return rows.select("k", F.round(score, 6).alias("score"))


@query("Q10_slugs_by_status", "SELECT DISTINCT k FROM v_raw JOIN v_occ ON event_id = k WHERE cancelled AND date BETWEEN DATE '2026-07-03' AND DATE '2026-12-30'")
def _(spark, d):
    return Q.with_date_between(listings(spark, d), view(spark, d, "v_occ"), TODAY, "2026-12-30", c("cancelled")).select("k")


@query("Q11_event_detail", """
WITH s AS (SELECT m, source_key, max(last_seen) AS seen FROM v_raw GROUP BY m, source_key), a AS (SELECT m, string_agg(source_key || '@' || CAST(seen AS VARCHAR), ',' ORDER BY source_key) AS sources FROM s GROUP BY m),
o AS (SELECT m, count(DISTINCT date) AS days FROM v_occ JOIN v_raw ON v_raw.k = event_id GROUP BY m)
SELECT a.m, sources, days FROM a JOIN o ON o.m = a.m""")
def _(spark, d):
    return Q.event_detail(view(spark, d, "v_raw"), view(spark, d, "v_occ"))


@query("Q13_events_for_city", f"WITH {Q_UP} SELECT k, city FROM u WHERE substr(replace({q_title('city')}, ' ', '-'), 1, 60) = 'nation-1-c'")
def _(spark, d):
    return upcoming(spark, d).where(T.slugify_city(c("city")) == "nation-1-c").select("k", "city")


@query("Q12_venues_for_city", "SELECT city, source_id, title FROM (SELECT *, row_number() OVER (PARTITION BY city ORDER BY CASE category WHEN 'loppebutik' THEN 0 WHEN 'reolmarked' THEN 1 WHEN 'antik' THEN 2 ELSE 9 END, title, source_id) AS n FROM v_venues) x WHERE n <= 60")
def _(spark, d):
    return Q.venues_for_city(view(spark, d, "v_venues")).select("city", "source_id", "title")


@query("Q14_list_venues", "SELECT source_type, source_id, category, title FROM v_venues WHERE source_type = 'map' AND category = 'antik'")
def _(spark, d):
    return Q.list_venues(view(spark, d, "v_venues"), "map", "antik").select("source_type", "source_id", "category", "title")


@query("Q5_explore_venues", f"SELECT source_type, source_id, round({Q_DIST()}, 6) AS km FROM v_venues WHERE category IN ('antik', 'reolmarked') AND {Q_DIST()} <= 100 AND contains({q_fold('title')}, 'machinery')")
def _(spark, d):
    rows = Q.with_distance(view(spark, d, "v_venues").where(c("category").isin("antik", "reolmarked")), HERE).where("km <= 100")
    rows = rows.where(F.contains(T.fold_for_search(c("title")), F.lit("machinery")))
    return rows.select("source_type", "source_id", F.round("km", 6).alias("km")).orderBy("km", "source_id")


@query("J6_nearest_events", f"""
SELECT id, other, km, rank FROM (SELECT a.k AS id, b.k AS other, round({q_haversine('a.lat', 'a.lng', 'b.lat', 'b.lng', '6371e0')}, 6) AS km,
  row_number() OVER (PARTITION BY a.k ORDER BY round({q_haversine('a.lat', 'a.lng', 'b.lat', 'b.lng', '6371e0')}, 6), b.k) AS rank
  FROM v_raw a JOIN v_raw b ON b.k <> a.k AND b.lat BETWEEN a.lat - 4e-1 AND a.lat + 4e-1 WHERE {q_haversine('a.lat', 'a.lng', 'b.lat', 'b.lng', '6371e0')} <= 40) x WHERE rank <= 3""")
def _(spark, d):
    rows = view(spark, d, "v_raw").select(c("k").alias("id"), "lat", "lng")
    return Q.nearest(rows, rows, 3, 40.0)


@query("J6_nearest_venues", f"""
SELECT id, other, km, rank FROM (SELECT a.source_id AS id, b.source_id AS other, round({q_haversine('a.lat', 'a.lng', 'b.lat', 'b.lng', '6371e0')}, 6) AS km,
  row_number() OVER (PARTITION BY a.source_id ORDER BY round({q_haversine('a.lat', 'a.lng', 'b.lat', 'b.lng', '6371e0')}, 6), b.source_id) AS rank
  FROM v_venues a JOIN v_venues b ON b.source_id <> a.source_id AND b.lat BETWEEN a.lat - 4e-1 AND a.lat + 4e-1 WHERE {q_haversine('a.lat', 'a.lng', 'b.lat', 'b.lng', '6371e0')} <= 40) x WHERE rank <= 3""")
def _(spark, d):
    rows = view(spark, d, "v_venues").select(c("source_id").alias("id"), "lat", "lng")
    return Q.nearest(rows, rows, 3, 40.0)


_slug = f"substr(replace({q_title('city')}, ' ', '-'), 1, 60)"


@query("A5_list_cities", f"""
WITH e AS (SELECT {_slug} AS slug, min(city) AS city, count(*) AS n FROM v_raw GROUP BY 1), v AS (SELECT {_slug} AS slug, min(city) AS city, count(*) AS n FROM v_venues GROUP BY 1)
SELECT coalesce(e.slug, v.slug) AS slug, coalesce(e.city, v.city) AS city, coalesce(e.n, 0) AS events, coalesce(v.n, 0) AS venues FROM e FULL JOIN v ON e.slug = v.slug WHERE coalesce(e.n, 0) >= 2 OR coalesce(v.n, 0) >= 3""")
def _(spark, d):
    e, v = Q.city_centroids(view(spark, d, "v_raw")), Q.city_centroids(view(spark, d, "v_venues"))
    both = e.select("slug", "city", c("n").alias("events")).join(v.select("slug", c("city").alias("city2"), c("n").alias("venues")), "slug", "full")
    zero = lambda n: F.coalesce(n, F.lit(0).cast("long")).alias(n)
    return both.select("slug", F.coalesce("city", "city2").alias("city"), zero("events"), zero("venues")).where("events >= 2 or venues >= 3")


@query("U2_union_city_sources", f"SELECT slug, count(*) FILTER (WHERE kind = 'event') AS events, count(*) FILTER (WHERE kind = 'venue') AS venues FROM (SELECT {_slug} AS slug, 'event' AS kind FROM v_raw UNION ALL SELECT {_slug}, 'venue' FROM v_venues) x GROUP BY slug")
def _(spark, d):
    rows = view(spark, d, "v_raw").select("city", F.lit("event").alias("kind")).unionByName(view(spark, d, "v_venues").select("city", F.lit("venue").alias("kind")))
    return rows.groupBy(T.slugify_city(c("city")).alias("slug")).agg(F.count_if(c("kind") == "event").alias("events"), F.count_if(c("kind") == "venue").alias("venues"))


@query("J7_nearby_cities", f"""
WITH g AS (SELECT {_slug} AS slug, round(avg(lat), 6) AS lat, round(avg(lng), 6) AS lng FROM v_raw GROUP BY 1)
SELECT a, b, rank FROM (SELECT x.slug AS a, y.slug AS b, row_number() OVER (PARTITION BY x.slug ORDER BY round(pow(x.lat - y.lat, 2) + pow((x.lng - y.lng) * 55e-2, 2), 9), y.slug) AS rank FROM g x JOIN g y ON x.slug <> y.slug) z WHERE rank <= 4""")
def _(spark, d):
    # A row a city: the pairs are those of a gazetteer, not of listings.
    g = Q.city_centroids(view(spark, d, "v_raw")).select("slug", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"))
    other = g.select(c("slug").alias("b"), c("lat").alias("lat2"), c("lng").alias("lng2"))
    d2 = F.round(F.pow(c("lat") - c("lat2"), F.lit(2.0)) + F.pow((c("lng") - c("lng2")) * 0.55, F.lit(2.0)), 9)
    near = g.join(other, c("slug") != c("b")).withColumn("rank", F.row_number().over(Window.partitionBy("slug").orderBy(d2, "b")))
    return near.where("rank <= 4").select(c("slug").alias("a"), "b", "rank")


@query("A6_city_gazetteer", f"""
WITH l AS (SELECT trim(city) AS label, round(avg(lat), 6) AS lat, round(avg(lng), 6) AS lng, count(*) AS n FROM v_raw WHERE NOT regexp_matches(city, '^[0-9]') GROUP BY 1),
g AS (SELECT *, {q_fold(q_base('label'))} AS base FROM l), s AS (SELECT x.base, max({q_haversine('x.lat', 'x.lng', 'y.lat', 'y.lng', '6371e0')}) AS spread, count(DISTINCT x.label) AS members FROM g x JOIN g y ON x.base = y.base GROUP BY x.base)
SELECT g.base, min(g.label) AS label, round(sum(g.lat * n) / sum(n), 5) AS lat, CAST(sum(n) AS BIGINT) AS weight FROM g JOIN s ON s.base = g.base WHERE members > 1 AND spread <= 25 GROUP BY g.base
UNION ALL SELECT g.base, g.label, round(g.lat, 5), n FROM g JOIN s ON s.base = g.base WHERE members = 1 OR spread > 25""")
def _(spark, d):
    labels = view(spark, d, "v_raw").where(~c("city").rlike("^[0-9]")).groupBy(F.trim("city").alias("label")).agg(F.round(F.avg("lat"), 6).alias("lat"), F.round(F.avg("lng"), 6).alias("lng"), F.count("*").alias("n"))
    labels = labels.withColumn("base", T.fold_for_search(T.base_label(c("label"))))
    other = labels.select("base", c("lat").alias("lat2"), c("lng").alias("lng2"))
    spread = labels.join(other, "base").groupBy("base").agg(F.max(geo.distance_km(c("lat"), c("lng"), c("lat2"), c("lng2"))).alias("spread"), F.count_distinct("label").alias("members"))
    rows = labels.join(spread, "base")
    one = (c("members") > 1) & (c("spread") <= 25)
    merged = rows.where(one).groupBy("base").agg(F.min("label").alias("label"), F.round(F.sum(c("lat") * c("n")) / F.sum("n"), 5).alias("lat"), F.sum("n").alias("weight"))
    return merged.unionByName(rows.where(~one).select("base", "label", F.round("lat", 5).alias("lat"), c("n").alias("weight")))


@query("F1_search_events", """
WITH w AS (SELECT doc_id AS id, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS words FROM documents),
z AS (SELECT count(*) AS docs, avg(len(words)) AS mean FROM w), h AS (SELECT id, len(words) AS length, q, len(list_filter(words, lambda x: starts_with(x, q))) AS tf FROM w, (VALUES ('thea'), ('onen')) t(q)),
f AS (SELECT q, count(*) AS df FROM h WHERE tf > 0 GROUP BY q)
SELECT id, round(sum(ln(1e0 + (docs - df + 5e-1) / (df + 5e-1)) * tf * 22e-1 / (tf + 12e-1 * (1 - 75e-2 + 75e-2 * length / mean))), 6) AS score FROM h JOIN f ON f.q = h.q, z WHERE tf > 0 GROUP BY id HAVING count(*) = 2
ORDER BY score DESC, id LIMIT 50""")
def _(spark, d):
    words = F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda w: w != "")
    index = X.build_index(view(spark, d, "documents"), "doc_id", words)
    return X.search(index.postings(), index.totals(), [["thea"], ["onen"]])


Q_FOUND = f"""WITH l AS (SELECT * FROM v_raw), {Q_HITS.split("qt AS")[0]}qw(t, v) AS (VALUES ('lørdag', 'lørdag'), ('lørdag', 'loerdag'), ('lørdag', 'lordag'), ('mark', 'mark')),
sh AS (SELECT t, k, length, count(*) AS tf FROM sp JOIN qw ON starts_with(token, v) GROUP BY t, k, length), sd AS (SELECT t, count(*) AS df FROM sh GROUP BY t)
SELECT k AS id, round(sum(ln(1e0 + (docs - df + 5e-1) / (df + 5e-1)) * tf * 22e-1 / (tf + 12e-1 * (1 - 75e-2 + 75e-2 * length / mean))), 6) AS score
FROM sh JOIN sd ON sd.t = sh.t, sz GROUP BY k HAVING count(*) = 2 ORDER BY score DESC, id LIMIT 50"""


@query("F1_search_listings", Q_FOUND)
def _(spark, d):
    """Words as typed or in either fold, over title, venue, city and description; the index is built over half of the listings and updated with the rest."""
    # Few large files don't decide how many tasks share the work of words.
    rows = view(spark, d, "v_raw").select("k", "title", "venue_name", "city", "description").repartition("k").select("k", X.event_words("title", "venue_name", "city", "description").alias("words"))
    index = X.build_index(rows.where("k % 2 = 0"), "k", c("words"))
    index.update(rows.where("k % 2 = 1"), "k", c("words"))
    return X.search(index.postings(), index.totals(), [["lørdag", "loerdag", "lordag"], ["mark"]])


@query("F2_matches_query", """
SELECT doc_id FROM documents WHERE contains(lower(text), 'theaing') OR len(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: length(w) >= 3 AND abs(length(w) - 7) <= 1 AND levenshtein(w, 'theaing') <= 1)) > 0""")
def _(spark, d):
    return view(spark, d, "documents").where(Q.matches_query(F.lower("text"), "theaing")).select("doc_id")


@query("F4_build_suggestions", f"""
WITH t AS (SELECT trim(title) AS label, 'marked' AS kind, 100 AS weight, k AS o FROM v_raw UNION ALL SELECT trim(title), 'butik', 50, source_id FROM v_venues)
SELECT city AS label, 'by' AS kind, {q_fold('city')} AS fold, count(*) + 1000 AS weight FROM (SELECT trim(city) AS city FROM v_raw UNION ALL SELECT trim(city) FROM v_venues) x WHERE city <> '' GROUP BY city
UNION ALL SELECT label, kind, fold, weight FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY weight DESC, o) AS n FROM (SELECT *, {q_fold('label')} AS fold FROM t) y) z WHERE n = 1""")
def suggestions(spark, d):
    return S.build_suggestions(view(spark, d, "v_raw"), view(spark, d, "v_venues"))


@query("F5_suggest", f"""
WITH t AS (SELECT p_name AS label, {q_fold('p_name')} AS fold, count(*) + 100 AS weight FROM part GROUP BY 1)
SELECT label, rank FROM (SELECT label, CASE WHEN instr(fold, 'wi') = 1 THEN 100000 ELSE 0 END + weight - (instr(fold, 'wi') - 1) AS rank FROM t WHERE contains(fold, 'wi')) x ORDER BY rank DESC, label LIMIT 7""")
def _(spark, d):
    index = view(spark, d, "part").groupBy(c("p_name").alias("label")).agg((F.count("*") + 100).alias("weight")).withColumns({"fold": T.fold_for_search(c("label")), "kind": F.lit("marked")})
    return S.suggest(index, "wi").select("label", "rank")


@query("F6_suggest_cities", f"""
WITH t AS (SELECT city AS label, {q_fold('city')} AS fold, count(*) AS weight FROM v_raw GROUP BY 1)
SELECT label, weight FROM t WHERE contains(fold, 'nation_1') ORDER BY starts_with(fold, 'nation_1') DESC, weight DESC, label LIMIT 8""")
def _(spark, d):
    index = view(spark, d, "v_raw").groupBy(c("city").alias("label")).agg(F.count("*").alias("weight")).withColumn("fold", T.fold_for_search(c("label")))
    return S.suggest_cities(index, "nation_1").select("label", "weight")


@query("F7_index_text", f"SELECT k, md5({q_folds(chr(34).join(['']) + 'concat_ws(' + chr(39) + ' ' + chr(39) + ', title, venue_name, city, description)')}) AS blob FROM v_raw")
def _(spark, d):
    return view(spark, d, "v_raw").select("k", F.md5(T.search_fold(F.concat_ws(" ", "title", "venue_name", "city", "description"))).alias("blob"))


@query("W9_cap_per_group", "SELECT event_id, date, n FROM (SELECT event_id, date, row_number() OVER (PARTITION BY event_id ORDER BY date, start_time NULLS FIRST, end_time NULLS FIRST) AS n FROM v_occ) x WHERE n <= 3")
def _(spark, d):
    return Q.cap_per_group(view(spark, d, "v_occ"), "event_id", ["date", "start_time", "end_time"], 3).select("event_id", "date", "n")


@query("W8_first_per_key", "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) x WHERE n = 1")
def _(spark, d):
    return S.first_per_key(view(spark, d, "documents").select("doc_id", "source"), "source", "doc_id")


_leg = q_haversine("coalesce(a, 557e-1)", "coalesce(b, 125e-1)", "lat", "lng", "6371e0")


@query("W10_route_length", f"""
SELECT trip_id, round(sum({_leg}), 3) AS km FROM (SELECT trip_id, lat, lng, lag(lat) OVER w AS a, lag(lng) OVER w AS b FROM v_trips WINDOW w AS (PARTITION BY trip_id ORDER BY pos)) x GROUP BY trip_id""")
def _(spark, d):
    return Q.route_length(view(spark, d, "v_trips"), HERE)


@query("G1_pick_trip_day", """
SELECT trip_id, min(date) AS day FROM (SELECT trip_id, date, count(DISTINCT v_trips.event_id) AS n FROM v_trips JOIN v_occ ON v_occ.event_id = v_trips.event_id WHERE date >= DATE '2026-07-03' GROUP BY trip_id, date) x WHERE n >= 2 GROUP BY trip_id""")
def _(spark, d):
    return Q.pick_trip_day(view(spark, d, "v_trips"), view(spark, d, "v_occ"), Q.day(TODAY))


@query("G2_auto_plan", f"""
SELECT date, event_id, n FROM (SELECT date, event_id, row_number() OVER (PARTITION BY date ORDER BY km, event_id) AS n, count(*) OVER (PARTITION BY date) AS t FROM (
  SELECT DISTINCT date, event_id, round({Q_DIST()}, 6) AS km FROM v_occ JOIN v_raw ON v_raw.k = event_id) y) x WHERE n <= 10 AND t >= 2""")
def _(spark, d):
    return Q.auto_plan(view(spark, d, "v_occ"), view(spark, d, "v_raw"), HERE)


@query("G3_order_trips", f"""
WITH RECURSIVE g AS (SELECT DISTINCT trip_id, CAST([] AS BIGINT[]) AS stops, 557e-1 AS lat, 125e-1 AS lng FROM v_trips
  UNION ALL SELECT trip_id, stops, lat, lng FROM (SELECT g.trip_id, list_append(g.stops, t.event_id) AS stops, t.lat, t.lng,
    row_number() OVER (PARTITION BY g.trip_id ORDER BY {q_haversine('g.lat', 'g.lng', 't.lat', 't.lng', '6371e0')}, t.pos) AS n FROM g JOIN v_trips t ON t.trip_id = g.trip_id AND NOT list_contains(g.stops, t.event_id)) x WHERE n = 1)
SELECT trip_id, array_to_string(arg_max(stops, len(stops)), ' ') AS stops FROM g GROUP BY trip_id""")
def _(spark, d):
    return Q.order_trips(view(spark, d, "v_trips"), HERE).select("trip_id", F.array_join(F.col("stops").cast("array<string>"), " ").alias("stops"))


@query("G4_trip_geometry", "SELECT trip_id, count(*) AS points, string_agg(CAST(event_id AS VARCHAR), '-' ORDER BY pos) AS line FROM v_trips GROUP BY trip_id HAVING count(*) >= 2")
def _(spark, d):
    return Q.trip_geometry(view(spark, d, "v_trips"))
