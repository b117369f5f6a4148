"""Queries for scores, similarity and entity resolution."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from localmarkets.functions import geo, scores, similarity
from localmarkets.functions import text as T
from localmarkets.operators import resolve as R
from localmarkets.plans.text import q_strip_dates, q_title
from localmarkets.views import view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
c = F.col


def query(name: str, sql: str | None = None) -> Callable:
    def keep(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            SQL[name] = with_views(sql)
        return f

    return keep


def q_bigrams(x: str) -> str:
    pairs = f"list_transform(range(1, greatest(length({x}), 1)), lambda i: substr({x}, i, 2))"
    return f"list_transform({pairs}, lambda p, i: p || CAST(len(list_filter(({pairs})[1:i], lambda q: q = p)) AS VARCHAR))"


GENERIC_ALONE = similarity.GENERIC_ALONE


def q_similarity(a: str, b: str, ap: str, bp: str) -> str:
    short, long = f"CASE WHEN length({a}) <= length({b}) THEN {a} ELSE {b} END", f"CASE WHEN length({a}) <= length({b}) THEN {b} ELSE {a} END"
    return f"""CASE WHEN {a} = '' OR {b} = '' THEN 0e0 WHEN {a} = {b} THEN 1e0
 WHEN length({short}) >= 8 AND contains({long}, {short}) AND NOT regexp_matches({short}, '{GENERIC_ALONE}') AND contains({short}, ' ') THEN 9e-1
 WHEN length({a}) + length({b}) - 2 = 0 THEN 0e0 ELSE len(list_intersect({ap}, {bp})) * 2e0 / (length({a}) + length({b}) - 2) END"""


def q_haversine(a: str, b: str, x: str, y: str, radius: str = "6371000e0") -> str:
    h = f"pow(sin(radians({x} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({x})) * pow(sin(radians({y} - {b}) / 2), 2)"
    return f"asin(sqrt(least({h}, 1e0))) * 2 * {radius}"


def listings(spark: SparkSession, d: str) -> DataFrame:
    """Listings to resolve: some without a postcode."""
    rows = view(spark, d, "v_raw")
    return rows.withColumns({"postcode": F.when(c("k") % 50 != 7, c("postcode")), "dates": F.array_compact(F.array("start_date", "second_date"))})


def q_plain(x: str) -> str:
    return f"translate(lower({x}), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy')"


def q_words(x: str) -> str:
    return rf"list_filter(string_split_regex({x}, '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"


def q_spelled(x: str, oe: str, aa: str) -> str:
    return f"replace(replace(replace(lower({x}), 'æ', 'ae'), 'ø', '{oe}'), 'å', '{aa}')"


_blob = "concat_ws(' ', title, venue_name, city, description)"
#: The 20 best listings that a search for each title finds: a word may be spelled as typed, or with oe and aa, or with o and a.
Q_HITS = f"""sw AS (SELECT k, list_concat({q_words(q_plain(_blob))}, {q_words(q_plain(q_spelled(_blob, 'oe', 'aa') + " || ' ' || " + q_spelled(_blob, 'o', 'a')))}) AS words FROM l),
sz AS (SELECT count(*) AS docs, avg(len(words)) AS mean FROM sw), sp AS (SELECT k, len(words) AS length, unnest(words) AS token FROM sw),
post AS (SELECT token, k, length, count(*) AS tf FROM sp GROUP BY ALL), qt AS (SELECT DISTINCT lower(title) AS q FROM l), qw AS (SELECT DISTINCT q, unnest({q_words('q')}) AS t FROM qt),
sv AS (SELECT DISTINCT t, unnest([{q_plain('t')}, {q_plain(q_spelled('t', 'oe', 'aa'))}, {q_plain(q_spelled('t', 'o', 'a'))}]) AS v FROM qw),
mp AS (SELECT DISTINCT token, t FROM (SELECT DISTINCT token FROM post) z JOIN sv ON starts_with(token, v)),
sh AS (SELECT t, k, length, sum(tf) AS tf FROM post JOIN mp USING (token) GROUP BY t, k, length), sd AS (SELECT t, count(*) AS df FROM sh GROUP BY t),
sn AS (SELECT q, count(*) AS n FROM qw GROUP BY q),
sc AS (SELECT qw.q, k, round(sum(ln(1e0 + (docs - df + 5e-1) / (df + 5e-1)) * tf * 22e-1 / (tf + 12e-1 * (1 - 75e-2 + 75e-2 * length / mean))), 6) AS score
  FROM qw JOIN sh ON sh.t = qw.t JOIN sd ON sd.t = qw.t JOIN sn ON sn.q = qw.q, sz GROUP BY qw.q, k, n HAVING count(*) = n),
top AS (SELECT q, k FROM (SELECT q, k, row_number() OVER (PARTITION BY q ORDER BY score DESC, k) AS i FROM sc) z WHERE i <= 20)"""
Q_ROWS = f"""
l AS (SELECT * EXCLUDE (postcode), CASE WHEN k % 50 <> 7 THEN postcode END AS postcode,
  CASE WHEN second_date IS NULL THEN [start_date] ELSE [start_date, second_date] END AS dates FROM v_raw),
n AS (SELECT *, {q_title(q_strip_dates('title'))} AS name, {q_title("CASE WHEN NOT regexp_matches(street, '[0-9]') AND " + q_title('street') + " = " + q_title('city') + " THEN NULL ELSE nullif(street, '') END")} AS st FROM l),
w AS (SELECT *, len(list_filter(string_split(name, ' '), lambda x: length(x) > 1 AND x NOT IN ({', '.join(repr(v) for v in R.GENERIC_WORDS)}))) >= 1 AS proper FROM n),
r AS (SELECT *, {q_bigrams('name')} AS grams, proper AND (length(name) >= 15 OR len(string_split(name, ' ')) >= 3) AS distinctive,
  lat IS NOT NULL AND lng IS NOT NULL AND geocode_quality NOT IN ('P', 'C') AS precise FROM w),
{Q_HITS},
p AS (SELECT DISTINCT a, b FROM (
  SELECT x.k AS a, y.k AS b FROM r x JOIN r y ON x.postcode = y.postcode AND x.k < y.k
  UNION ALL SELECT x.k, y.k FROM r x JOIN r y ON x.lat BETWEEN y.lat - 1e-2 AND y.lat + 1e-2 AND abs(x.lat - y.lat) <= 1e-2 AND abs(x.lng - y.lng) <= 2e-2 AND x.k < y.k
  UNION ALL SELECT least(x.k, y.k), greatest(x.k, y.k) FROM r x JOIN r y ON lower(x.title) = lower(y.title) AND x.k <> y.k WHERE x.postcode IS NULL
  UNION ALL SELECT least(x.k, y.k), greatest(x.k, y.k) FROM r x JOIN top ON top.q = lower(x.title) JOIN r y ON y.k = top.k
    WHERE x.k <> y.k AND (x.postcode IS NULL OR y.postcode IS NULL)) u)"""


def q_verdict(x: str, y: str) -> str:
    differ = f"coalesce({x}.st IS NOT NULL AND {y}.st IS NOT NULL AND NOT contains({x}.st, {y}.st) AND NOT contains({y}.st, {x}.st), false)"
    both = f"({x}.st IS NOT NULL AND {y}.st IS NOT NULL)"
    precise = f"({x}.precise AND {y}.precise)"
    code = f"({x}.postcode = {y}.postcode)"
    near = f"({q_haversine(f'{x}.lat', f'{x}.lng', f'{y}.lat', f'{y}.lng')} <= 500)"
    rescued = f"(coalesce({code}, false) AND {both} AND NOT {differ})"
    colocated = f"(CASE WHEN {precise} THEN {near} OR {rescued} ELSE {code} END)"
    spot = f"coalesce(CASE WHEN {precise} THEN {near} OR {rescued} ELSE {code} AND {both} AND NOT {differ} END, false)"
    overlap = f"list_has_any({x}.dates, {y}.dates)"
    identical = f"(len({x}.dates) > 0 AND len({x}.dates) = len({y}.dates) AND list_has_all({y}.dates, {x}.dates))"
    return f"""CASE WHEN ({x}.category = 'julemarked') <> ({y}.category = 'julemarked') THEN '-christmas market and another' WHEN sim < 45e-2 THEN '-titles differ'
 WHEN {differ} AND sim < 85e-2 THEN '-different streets'
 WHEN sim >= 95e-2 AND NOT {differ} AND coalesce({code}, false) AND {identical} AND ({x}.distinctive OR ({x}.proper AND len({x}.dates) >= 2 AND NOT {precise})) THEN '+same title, postcode and dates'
 WHEN {colocated} IS NOT DISTINCT FROM false THEN '-different locations' WHEN sim >= 85e-2 AND {spot} THEN '+strong title, same spot'
 WHEN sim >= 85e-2 AND {colocated} IS NULL AND {overlap} THEN '+strong title, same dates' WHEN {colocated} AND {overlap} AND {spot} THEN '+title, spot and dates'
 WHEN {colocated} AND {overlap} AND NOT {spot} AND {x}.distinctive AND sim >= 65e-2 THEN '+title, district and dates'
 WHEN sim >= 95e-2 AND {x}.distinctive AND NOT {differ} THEN '+same distinctive title' ELSE '-not enough evidence' END"""


Q_MATCH = f"""{Q_ROWS},
s AS (SELECT a, b, {q_similarity('x.name', 'y.name', 'x.grams', 'y.grams')} AS sim FROM p JOIN r x ON x.k = a JOIN r y ON y.k = b),
m AS (SELECT a, b, sim, {q_verdict('x', 'y')} AS f, {q_verdict('y', 'x')} AS g FROM s JOIN r x ON x.k = a JOIN r y ON y.k = b)"""
Q_CLUSTER = f"""{Q_MATCH},
e AS (SELECT a, b FROM m WHERE f LIKE '+%' OR g LIKE '+%' UNION ALL SELECT b, a FROM m WHERE f LIKE '+%' OR g LIKE '+%'),
reach AS (SELECT k AS node, k AS seen FROM r UNION SELECT reach.node, e.b FROM reach JOIN e ON e.a = reach.seen),
cl AS (SELECT node AS k, min(seen) AS cluster FROM reach GROUP BY node)"""


@query("J1_candidate_pairs", f"WITH {Q_ROWS} SELECT a, b FROM p")
def _(spark, d):
    return R.candidate_pairs(R.prepared_table(listings(spark, d)))


@query("J2_match_pairs", f"WITH {Q_MATCH} SELECT a, b, round(sim, 6) AS similarity, f LIKE '+%' AS forward, substr(f, 2) AS forward_reason, g LIKE '+%' AS backward, substr(g, 2) AS backward_reason FROM m")
def _(spark, d):
    rows = R.prepared_table(listings(spark, d))
    told = R.matches(rows).withColumns({"f": R.verdict(c("forward")), "g": R.verdict(c("backward"))})
    return told.select("a", "b", "similarity", "f.is_match", "f.reason", "g.is_match", "g.reason").toDF("a", "b", "similarity", "forward", "forward_reason", "backward", "backward_reason")


@query("J3_title_similarity", f"""
WITH t AS (SELECT p_partkey, {q_title('p_name')} AS a, {q_title("lead(p_name, 1, '') OVER (ORDER BY p_partkey)")} AS b FROM part),
g AS (SELECT *, {q_bigrams('a')} AS ap, {q_bigrams('b')} AS bp FROM t)
SELECT p_partkey, round({q_similarity('a', 'b', 'ap', 'bp')}, 6) AS similarity FROM g""")
def _(spark, d):
    part = view(spark, d, "part").select("p_partkey", T.normalize_title(c("p_name")).alias("a"))
    after = part.select((c("p_partkey") - 1).alias("p_partkey"), c("a").alias("b"))
    both = part.join(after, "p_partkey", "left").withColumn("b", F.coalesce("b", F.lit("")))
    both = both.withColumns({"ap": similarity.bigrams(c("a")), "bp": similarity.bigrams(c("b"))})
    return both.select("p_partkey", F.round(similarity.similarity(c("a"), c("b"), c("ap"), c("bp")), 6).alias("similarity"))


@query("J4_haversine", f"SELECT k, round({q_haversine('557e-1', '125e-1', 'lat', 'lng')}, 3) AS metres, round({q_haversine('557e-1', '125e-1', 'lat', 'lng', '6371e0')}, 6) AS km FROM v_raw")
def _(spark, d):
    at = (F.lit(55.7), F.lit(12.5), c("lat"), c("lng"))
    return view(spark, d, "v_raw").select("k", F.round(geo.haversine(*at), 3).alias("metres"), F.round(geo.distance_km(*at), 6).alias("km"))


@query("P2_blur_coord", """
SELECT k, round(floor(lat / 2e-2 + 5e-1) * 2e-2, 5) AS lat, round(floor(lng / (2e-2 / greatest(3e-1, cos(radians(lat)))) + 5e-1) * (2e-2 / greatest(3e-1, cos(radians(lat)))), 5) AS lng FROM v_raw""")
def _(spark, d):
    return view(spark, d, "v_raw").select("k", geo.blur(c("lat"), c("lng")).alias("p")).select("k", "p.lat", "p.lng")


@query("P5_coarsen", "SELECT k, floor(lat * 1000 + 5e-1) / 1000 AS lat, floor(lng * 1000 + 5e-1) / 1000 AS lng FROM v_raw")
def _(spark, d):
    return view(spark, d, "v_raw").select("k", geo.coarsen(c("lat")).alias("lat"), geo.coarsen(c("lng")).alias("lng"))


_days = "(DATE '2026-07-03' - last_seen)"
Q_CONF = f"""CASE WHEN k % 3 + 1 <= 1 AND trust < 5e-1 THEN least(x, CASE WHEN k % 7 >= 3 THEN 6e-1 ELSE 44e-2 END) ELSE x END"""
Q_CONF_IN = f"""SELECT *, least(1e0, greatest(0e0, floor((trust * 5e-1 + least(k % 3, 2) * 1e-1 + greatest(0e0, 1e0 - greatest(0, {_days} - 14) / 106) * 2e-1
  + CASE WHEN geocode_quality NOT IN ('P', 'C') THEN 1e-1 ELSE 0 END + CASE WHEN start_date >= DATE '2026-07-03' THEN 1e-1 ELSE 0 END + least(k % 7, 4) * 3e-2) * 100 + 5e-1) / 100)) AS x FROM v_raw"""


def confidence():
    days = F.datediff(F.lit("2026-07-03").cast("date"), c("last_seen"))
    return scores.event_confidence(c("trust"), (c("k") % 3 + 1).cast("int"), days, T.is_precise(c("geocode_quality")), c("start_date") >= F.lit("2026-07-03").cast("date"), (c("k") % 7).cast("int"))


@query("K1_event_confidence", f"SELECT k, {Q_CONF} AS confidence FROM ({Q_CONF_IN}) q")
def _(spark, d):
    return view(spark, d, "v_raw").select("k", confidence().alias("confidence"))


@query("K3_trust_level", f"SELECT k, CASE WHEN conf >= 75e-2 THEN 'confirmed' WHEN conf >= 45e-2 THEN 'ok' ELSE 'unverified' END AS level FROM (SELECT k, {Q_CONF} AS conf FROM ({Q_CONF_IN}) q) z")
def _(spark, d):
    return view(spark, d, "v_raw").select("k", scores.trust_level(confidence()).alias("level"))


@query("K2_recompute_confidence", """
WITH a AS (SELECT m, count(DISTINCT source_key) AS n, max(last_seen) AS seen, max(trust) AS trust, bool_or(coalesce(start_date, second_date) >= DATE '2026-07-03' OR coalesce(second_date >= DATE '2026-07-03', false)) AS dated,
  bool_or(geocode_quality NOT IN ('P', 'C')) AS located FROM v_raw GROUP BY m),
x AS (SELECT *, least(1e0, greatest(0e0, floor((trust * 5e-1 + least(n - 1, 2) * 1e-1 + greatest(0e0, 1e0 - greatest(0, (DATE '2026-07-03' - seen) - 14) / 106) * 2e-1
  + CASE WHEN located THEN 1e-1 ELSE 0 END + CASE WHEN dated THEN 1e-1 ELSE 0 END) * 100 + 5e-1) / 100)) AS s FROM a)
SELECT m, n AS sources, CASE WHEN n <= 1 AND trust < 5e-1 THEN least(s, 44e-2) ELSE s END AS confidence FROM x""")
def _(spark, d):
    today = F.lit("2026-07-03").cast("date")
    dated = F.greatest(c("start_date"), c("second_date")) >= today
    rows = view(spark, d, "v_raw").groupBy("m").agg(
        F.count_distinct("source_key").alias("sources"), F.max("last_seen").alias("seen"), F.max("trust").alias("trust"), F.bool_or(dated).alias("dated"), F.bool_or(T.is_precise(c("geocode_quality"))).alias("located")
    )
    days = F.coalesce(F.datediff(today, c("seen")), F.lit(365))
    return rows.select("m", "sources", scores.event_confidence(F.coalesce("trust", F.lit(0.0)), c("sources"), days, c("located"), c("dated"), F.lit(0)).alias("confidence"))


_len = "coalesce(length(description), 0)"
Q_GEM = f"CASE WHEN {_len} >= 200 THEN 2 WHEN {_len} >= 80 THEN 1 ELSE 0 END + CAST(stall_count_text IS NOT NULL AS INT) + CAST(is_free IS NOT NULL AS INT) + CAST(start_time IS NOT NULL AS INT) + CAST(venue_name IS NOT NULL AS INT) + CAST(contact_website IS NOT NULL AS INT)"


def gem_points():
    return scores.gem_points(c("description"), c("stall_count_text"), c("is_free").isNotNull(), c("start_time").isNotNull(), c("venue_name"), c("contact_website"))


@query("K4_hidden_gem", f"""
SELECT k, points, conf >= 7e-1 AND k % 3 = 0 AND lat IS NOT NULL AND coalesce(CAST(nullif(regexp_extract(stall_count_text, '[0-9]+'), '') AS INT), 0) <= 150 AND points >= 4 AS gem
FROM (SELECT k, lat, stall_count_text, {Q_GEM} AS points, {Q_CONF} AS conf FROM ({Q_CONF_IN}) q) z""")
def _(spark, d):
    dates = F.size(F.array_compact(F.array("start_date", "second_date")))
    gem = scores.hidden_gem(confidence(), (c("k") % 3 + 1).cast("int"), dates, c("lat").isNotNull(), c("stall_count_text"), gem_points(), least=4)
    return view(spark, d, "v_raw").select("k", gem_points().alias("points"), gem.alias("gem"))


Q_SURVIVOR = "CASE WHEN lat IS NOT NULL AND geocode_quality NOT IN ('P', 'C') THEN 100 WHEN lat IS NOT NULL THEN 20 ELSE 0 END + CASE WHEN postcode <> '' THEN 10 ELSE 0 END + CASE WHEN street <> '' THEN 10 ELSE 0 END + CASE WHEN venue_name <> '' THEN 5 ELSE 0 END + CASE WHEN description <> '' THEN 3 ELSE 0 END + CASE WHEN second_date IS NULL THEN 1 ELSE 2 END"


def survivor():
    dates = F.size(F.array_compact(F.array("start_date", "second_date")))
    return scores.survivor_score(c("lat"), T.is_precise(c("geocode_quality")), c("postcode"), c("street"), c("venue_name"), c("description"), dates)


@query("K8_survivor_score", f"SELECT k, {Q_SURVIVOR} AS score FROM v_raw")
def _(spark, d):
    return view(spark, d, "v_raw").select("k", survivor().alias("score"))


@query("K11_source_trust_label", "SELECT s_suppkey, CASE WHEN t >= 7e-1 THEN 'hoej' WHEN t >= 55e-2 THEN 'god' WHEN t >= 45e-2 THEN 'middel' ELSE 'faellesskab' END AS label FROM (SELECT s_suppkey, (s_suppkey % 21) / 20e0 AS t FROM supplier) x")
def _(spark, d):
    return view(spark, d, "supplier").select("s_suppkey", scores.source_trust_label((c("s_suppkey") % 21) / 20).alias("label"))


@query("U1_same_market_components", f"WITH RECURSIVE {Q_CLUSTER} SELECT k, cluster FROM cl")
def _(spark, d):
    return R.same_market(listings(spark, d))


def clustered(spark, d):
    return listings(spark, d).join(view(spark, d, "v_key").select("k", c("m").alias("cluster")), "k")


@query("W1_pick_survivor", f"SELECT cluster, survivor, size FROM (SELECT m AS cluster, k AS survivor, count(*) OVER (PARTITION BY m) AS size, row_number() OVER (PARTITION BY m ORDER BY {Q_SURVIVOR} DESC, k) AS n FROM v_raw) x WHERE n = 1")
def _(spark, d):
    return R.pick_survivor(view(spark, d, "v_raw").withColumn("cluster", c("m")), survivor())


def q_pick(name: str, none: str = "", clean: str = "") -> str:
    some = f"{name} IS NOT NULL AND CAST({name} AS VARCHAR) NOT IN ('', '{none}')"
    return f"first({name} ORDER BY {clean} trust DESC, last_seen DESC, k DESC) FILTER (WHERE {some}) AS {name}, first(source_key ORDER BY {clean} trust DESC, last_seen DESC, k DESC) FILTER (WHERE {some}) AS {name}_source"


Q_DATED = r"regexp_matches(title, '\b20\d{2}\b|d\.\s*\d')"


@query("W2_merge_fields", f"""
WITH g AS (SELECT m AS cluster, {q_pick('title', '', f'{Q_DATED},')}, {q_pick('category', 'andet')}, {q_pick('street')}, {q_pick('description')}, {q_pick('is_free')}, {q_pick('indoor_outdoor', 'unknown')},
  {q_pick('stall_count_text')}, count(DISTINCT source_key) AS sources FROM v_raw GROUP BY m)
SELECT cluster, title, coalesce(category, 'andet') AS category, street, description, is_free, coalesce(indoor_outdoor, 'unknown') AS indoor_outdoor, stall_count_text, sources,
  title_source, street_source, description_source, is_free_source FROM g""")
def _(spark, d):
    merged = R.merge_fields(view(spark, d, "v_raw").withColumn("cluster", c("m")))
    source = lambda n: F.try_element_at(c("provenance"), F.lit(n)).alias(f"{n}_source")
    return merged.select("cluster", "title", "category", "street", "description", "is_free", "indoor_outdoor", "stall_count_text", "sources", *[source(n) for n in ("title", "street", "description", "is_free")])


@query("W3_merge_location", """
SELECT cluster, lat, lng, geocode_quality FROM (
  SELECT m AS cluster, lat, lng, geocode_quality, row_number() OVER (PARTITION BY m ORDER BY CASE geocode_quality WHEN 'source' THEN 3 WHEN 'A' THEN 2 WHEN 'B' THEN 1 ELSE 0 END DESC, trust DESC, last_seen DESC, k DESC) AS n
  FROM v_raw WHERE lat IS NOT NULL) x WHERE n = 1""")
def _(spark, d):
    return R.merge_fields(view(spark, d, "v_raw").withColumn("cluster", c("m"))).select("cluster", "lat", "lng", "geocode_quality")


def q_occ() -> str:
    return "SELECT v_raw.m AS cluster, v_raw.k, trust, date, v_occ.start_time, v_occ.end_time FROM v_occ JOIN v_raw ON v_raw.k = v_occ.event_id"


@query("W4_merge_occurrences", f"""
WITH o AS ({q_occ()}), t AS (SELECT cluster, least(max(trust), 5e-1) AS least_trust FROM o GROUP BY cluster),
n AS (SELECT *, row_number() OVER (PARTITION BY cluster, date ORDER BY start_time IS NULL, trust DESC, k, start_time, end_time) AS i, max(trust) OVER (PARTITION BY cluster, date) AS date_trust FROM o)
SELECT n.cluster, date, start_time, end_time, date_trust FROM n JOIN t ON t.cluster = n.cluster WHERE i = 1 AND date_trust >= least_trust""")
def _(spark, d):
    rows = view(spark, d, "v_raw").select("k", c("m").alias("cluster"), "trust")
    return R.merge_occurrences(view(spark, d, "v_occ").join(rows, c("event_id") == c("k")))


@query("U3_absorb_duplicates", f"""
WITH s AS (SELECT k, first_value(k) OVER (PARTITION BY m ORDER BY {Q_SURVIVOR} DESC, k) AS survivor FROM v_raw),
o AS (SELECT survivor AS event_id, date, start_time, end_time, row_number() OVER (PARTITION BY survivor, date ORDER BY event_id <> survivor, event_id, start_time NULLS LAST, end_time NULLS FIRST) AS n FROM v_occ JOIN s ON s.k = v_occ.event_id)
SELECT event_id, date, start_time, end_time FROM o WHERE n = 1""")
def _(spark, d):
    rows = view(spark, d, "v_raw").withColumn("cluster", c("m"))
    best = R.pick_survivor(rows, survivor()).select("cluster", "survivor")
    return R.absorb(view(spark, d, "v_occ"), rows.select("k", "cluster").join(best, "cluster"))


@query("L4_event_status", """
SELECT k, CASE WHEN cancelled AND trust >= least(5e-1, best) THEN 'cancelled' WHEN NOT cancelled AND s = 'cancelled' AND trust >= best AND k % 2 = 0 THEN 'active' WHEN s = 'expired' THEN 'active' ELSE s END AS status
FROM (SELECT k, trust, k % 4 = 0 AS cancelled, max(trust) OVER (PARTITION BY m) AS best, CASE CAST(k % 3 AS INT) WHEN 0 THEN 'active' WHEN 1 THEN 'cancelled' ELSE 'expired' END AS s FROM v_raw) x""")
def _(spark, d):
    rows = view(spark, d, "v_raw")
    best = rows.groupBy("m").agg(F.max("trust").alias("best"))
    s = F.when(c("k") % 3 == 0, "active").when(c("k") % 3 == 1, "cancelled").otherwise("expired")
    return rows.join(best, "m").select("k", R.event_status(s, c("k") % 4 == 0, c("trust"), c("best"), c("k") % 2 == 0).alias("status"))


@query("W7_unique_slugs", f"""
WITH b AS (SELECT p_partkey, substr(replace({q_title('p_name')}, ' ', '-'), 1, 80) AS base FROM part)
SELECT p_partkey, CASE WHEN n = 1 THEN base ELSE base || '-' || n END AS slug FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY p_partkey) AS n FROM b) x""")
def _(spark, d):
    rows = view(spark, d, "part").select("p_partkey", T.slugify(c("p_name")).alias("base"))
    return R.unique_slugs(rows, "base", "p_partkey").select("p_partkey", "slug")


@query("L3_merge_duplicates", f"""
WITH RECURSIVE {Q_CLUSTER}, z AS (SELECT l.*, cl.cluster FROM l JOIN cl ON cl.k = l.k)
SELECT cluster, survivor, size FROM (SELECT cluster, k AS survivor, count(*) OVER (PARTITION BY cluster) AS size, row_number() OVER (PARTITION BY cluster ORDER BY {Q_SURVIVOR} DESC, k) AS n FROM z) x WHERE n = 1""")
def _(spark, d):
    rows = listings(spark, d)
    return R.pick_survivor(rows.join(R.same_market(rows), "k"), survivor())
