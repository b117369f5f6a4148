"""Queries for informal places: evidence, scores, matching, publication, quality."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from localmarkets.functions import text as T
from localmarkets.operators import places as P
from localmarkets.operators import rollups as U
from localmarkets.plans.resolve import q_haversine
from localmarkets.plans.text import q_phone, q_profile, q_street, q_title, q_tokens
from localmarkets.functions.scores import STATUSES, VISIBILITIES
from localmarkets.views import view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
c = F.col
TODAY = "2026-07-15"


def today():
    return F.lit(TODAY).cast("date")


def query(name: str, sql: str | None = None) -> Callable:
    def keep(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            SQL[name] = with_views(sql)
        return f

    return keep


def evidence(spark: SparkSession, d: str) -> DataFrame:
    return P.with_evidence(view(spark, d, "v_places"), view(spark, d, "v_sources"), view(spark, d, "v_visits"))


Q_HOST = r"coalesce(regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]+)', 1)), '^www\.', ''), '')"
Q_EVIDENCE = f"""
s AS (SELECT place_id, count(DISTINCT source_type || '|' || {Q_HOST}) AS sources, count(*) AS rows_, bool_or(source_type = 'phone_verification') AS phone_verified FROM v_sources GROUP BY place_id),
w AS (SELECT place_id, count(*) AS visits, count(*) FILTER (WHERE coalesce(was_open, false) AND NOT reported_closed) AS confirmed, count(*) FILTER (WHERE reported_closed) AS closed FROM v_visits GROUP BY place_id),
e AS (SELECT v_places.*, coalesce(sources, 0) AS sources, coalesce(rows_, 0) AS rows_, coalesce(phone_verified, false) AS phone_verified, coalesce(visits, 0) AS visits, coalesce(confirmed, 0) AS confirmed, coalesce(closed, 0) AS closed,
  DATE '{TODAY}' - coalesce(last_verified, last_seen) AS age FROM v_places LEFT JOIN s ON s.place_id = id LEFT JOIN w ON w.place_id = id)"""


@query("A12_independent_sources", f"WITH {Q_EVIDENCE} SELECT place_id, sources, rows_ AS rows FROM s")
def _(spark, d):
    return P.independent_sources(view(spark, d, "v_sources")).select("place_id", "sources", "rows")


@query("K5_place_confidence", f"""
WITH {Q_EVIDENCE} SELECT id, CAST(greatest(0, least(100, 20 + CASE WHEN street <> '' THEN 14 ELSE 0 END + CASE WHEN phone <> '' THEN 10 ELSE 0 END + least(greatest(sources - 1, 0), 3) * 9 + CASE WHEN pattern <> '' THEN 8 ELSE 0 END
  + CASE WHEN n_images > 0 THEN 6 ELSE 0 END + CASE WHEN geo_precision = 'exact' THEN 6 ELSE 0 END + CASE WHEN opening_notes <> '' THEN 5 ELSE 0 END + CASE WHEN phone_verified THEN 16 ELSE 0 END
  + CASE WHEN confirmed >= 2 THEN 12 WHEN confirmed = 1 THEN 6 ELSE 0 END + CASE WHEN age <= 60 THEN 18 WHEN age < 540 THEN floor(18 * (1e0 - (age - 60) / 480e0) + 5e-1) ELSE 0 END
  + CASE WHEN rows_ <= 1 AND age > 180 THEN -14 ELSE 0 END + CASE WHEN closed >= 2 THEN -20 WHEN closed = 1 THEN -5 ELSE 0 END)) AS INT) AS score FROM e""")
def _(spark, d):
    return evidence(spark, d).select("id", P.place_confidence(today())["score"].alias("score"))


@query("K5_place_reasons", f"WITH {Q_EVIDENCE} SELECT id, coalesce(street <> '', false) AS address, sources > 1 AS corroborated, age < 540 AND (age <= 60 OR floor(18 * (1e0 - (age - 60) / 480e0) + 5e-1) > 0) AS seen FROM e")
def _(spark, d):
    reasons = P.place_confidence(today())["reasons"]
    has = lambda r: F.array_contains(reasons, r)
    return evidence(spark, d).select("id", has("precise address").alias("address"), has("several sources").alias("corroborated"), has("seen lately").alias("seen"))


@query("K6_find_score", f"""
WITH {Q_EVIDENCE}, f AS (SELECT id, CAST(greatest(0, least(100, floor((30 + CASE WHEN place_type IN ('lade', 'gaard', 'garage', 'dodsbo') THEN 16 ELSE 0 END + CASE WHEN place_type = 'dodsbo' THEN 14 ELSE 0 END + CASE WHEN sources <= 2 THEN 10 ELSE 0 END
  + CASE WHEN status IN ('sporadic', 'call_first') THEN 7 ELSE 0 END + 6 + CASE price_level WHEN 'lav' THEN 12 WHEN 'hoej' THEN -14 ELSE 0 END + CASE WHEN confirmed >= 2 THEN 12 WHEN confirmed = 1 THEN 6 ELSE 0 END) / 157e0 * 100 + 5e-1))) AS INT) AS score FROM e)
SELECT id, score, CASE WHEN score >= 80 THEN 'very promising' WHEN score >= 60 THEN 'promising' WHEN score >= 40 THEN 'maybe' ELSE 'unlikely' END AS band FROM f""")
def _(spark, d):
    told = P.find_score(["dodsbo"])
    return evidence(spark, d).select("id", told["score"].alias("score"), told["band"].alias("band"))


Q_LAYER = """CASE WHEN status IN ('rejected', 'historical', 'unverified', 'possibly_inactive') OR confidence < 45 THEN 'radar' WHEN call_first OR status IN ('call_first', 'sporadic') THEN 'kontroller-foerst'
 WHEN status = 'confirmed_active' AND confidence >= 70 THEN 'bekraeftet' ELSE 'kontroller-foerst' END"""


@query("K10_trust_layer", f"SELECT id, {Q_LAYER} AS layer FROM v_places")
def _(spark, d):
    return P.with_layer(view(spark, d, "v_places")).select("id", "layer")


Q_KEYS = f"SELECT id, {q_phone('phone')} AS phone, {q_profile('profile_url')} AS profile, {q_street('street')} AS street, {q_title('city')} AS city, lat, lng, {q_tokens('name')} AS tokens, {q_title('contact_name')} AS contact, {q_title('pattern')} AS pattern, place_type FROM v_places"
_far = q_haversine("x.lat", "x.lng", "y.lat", "y.lng")


@query("J13_place_pairs", f"""
WITH p AS ({Q_KEYS}), m AS (SELECT x.id AS a, y.id AS b, coalesce(x.phone <> y.phone, false) AS veto, coalesce(x.phone = y.phone, false) OR coalesce(x.profile = y.profile, false) AS hard,
  CASE WHEN x.phone = y.phone THEN 100 ELSE 0 END + CASE WHEN x.profile = y.profile THEN 100 ELSE 0 END + CASE WHEN x.city = y.city AND x.street = y.street THEN 45 WHEN x.city = y.city AND x.street <> y.street THEN -35 ELSE 0 END
  + CASE WHEN {_far} <= 120 THEN 35 WHEN {_far} <= 800 THEN 10 ELSE 0 END + CASE WHEN list_has_any(x.tokens, y.tokens) THEN 30 ELSE 0 END + CASE WHEN x.contact = y.contact THEN 20 ELSE 0 END + CASE WHEN x.pattern = y.pattern THEN 8 ELSE 0 END
  + CASE WHEN x.place_type = y.place_type THEN 5 ELSE -10 END AS score FROM p x JOIN p y ON x.id < y.id),
v AS (SELECT a, b, CASE WHEN veto THEN 'distinct' WHEN hard AND score >= 100 THEN 'merge' WHEN score >= 55 THEN 'review' ELSE 'distinct' END AS verdict, score FROM m)
SELECT a, b, verdict, score FROM v WHERE verdict <> 'distinct'""")
def _(spark, d):
    return P.place_pairs(view(spark, d, "v_places"))


@query("J14_match_places", f"""
WITH p AS ({Q_KEYS}), m AS (SELECT x.id AS a, coalesce(x.phone <> y.phone, false) AS veto, coalesce(x.phone = y.phone, false) OR coalesce(x.profile = y.profile, false) AS hard,
  CASE WHEN x.phone = y.phone THEN 100 ELSE 0 END + CASE WHEN x.profile = y.profile THEN 100 ELSE 0 END + CASE WHEN x.city = y.city AND x.street = y.street THEN 45 WHEN x.city = y.city AND x.street <> y.street THEN -35 ELSE 0 END
  + CASE WHEN {_far} <= 120 THEN 35 WHEN {_far} <= 800 THEN 10 ELSE 0 END + CASE WHEN list_has_any(x.tokens, y.tokens) THEN 30 ELSE 0 END + CASE WHEN x.contact = y.contact THEN 20 ELSE 0 END + CASE WHEN x.pattern = y.pattern THEN 8 ELSE 0 END
  + CASE WHEN x.place_type = y.place_type THEN 5 ELSE -10 END AS score FROM p x JOIN p y ON y.id = x.id + 150)
SELECT a, CASE WHEN veto THEN 'distinct' WHEN hard AND score >= 100 THEN 'merge' WHEN score >= 55 THEN 'review' ELSE 'distinct' END AS verdict, CASE WHEN veto THEN -60 ELSE score END AS score FROM m""")
def _(spark, d):
    rows = P._keyed(view(spark, d, "v_places"))
    a, b = (rows.select([c(n).alias(f"{p}_{n}") for n in rows.columns]) for p in "ab")
    return a.join(b, c("b_id") == c("a_id") + 150).select(c("a_id").alias("a"), *[e.alias(n) for n, e in P.match_score().items()])


_snap_lat = "round(floor(lat / 2e-2 + 5e-1) * 2e-2, 5)"
_size = "(2e-2 / greatest(3e-1, cos(radians(lat))))"
_snap_lng = f"round(floor(lng / {_size} + 5e-1) * {_size}, 5)"
Q_PUBLIC = f"""SELECT slug, name, CASE WHEN address_visibility = 'fuld' THEN street END AS street, CASE address_visibility WHEN 'kontakt-kraeves' THEN NULL WHEN 'fuld' THEN lat ELSE {_snap_lat} END AS lat,
 CASE address_visibility WHEN 'kontakt-kraeves' THEN NULL WHEN 'fuld' THEN lng ELSE {_snap_lng} END AS lng, CASE WHEN address_visibility = 'fuld' THEN geo_precision ELSE 'area' END AS geo_precision, address_visibility <> 'fuld' AS area_only
 FROM v_places WHERE address_visibility NOT IN ('intern', 'ikke-offentlig') AND status <> 'rejected'"""


@query("P1_public_view", Q_PUBLIC)
def _(spark, d):
    return P.public_view(view(spark, d, "v_places")).select("slug", "name", "street", "lat", "lng", "geo_precision", "area_only")


@query("P3_visibility_leaks", """
SELECT slug, unnest(list_filter([CASE WHEN address_visibility IN ('intern', 'ikke-offentlig') THEN 'published' END, CASE WHEN part AND street IS NOT NULL THEN 'street' END, CASE WHEN part THEN 'not marked as an area' END,
  CASE WHEN part AND lat IS NOT NULL THEN 'exact point' END, CASE WHEN part AND geo_precision <> 'area' THEN 'precision' END, CASE WHEN address_visibility = 'kontakt-kraeves' AND lat IS NOT NULL THEN 'pin' END], lambda x: x IS NOT NULL)) AS leak
FROM (SELECT *, address_visibility IN ('omraade', 'kun-aabningsdage', 'kontakt-kraeves') AS part FROM v_places) x""")
def _(spark, d):
    # A view that was published without the gate: it has to be found out.
    rows = view(spark, d, "v_places")
    return P.visibility_leaks(rows, rows.withColumn("area_only", F.lit(False)))


@query("P4_publish_places", f"WITH v AS ({Q_PUBLIC}) SELECT v.slug, {Q_LAYER} AS layer, v.lat FROM v JOIN v_places ON v_places.slug = v.slug")
def _(spark, d):
    return P.publish(view(spark, d, "v_places")).select("slug", "layer", "lat")


_none = lambda n: f"coalesce({n}, '') = ''"
_rules = [
    (f"status NOT IN ({', '.join(repr(s) for s in STATUSES)})", "error", "unknown status"), (f"address_visibility NOT IN ({', '.join(repr(s) for s in VISIBILITIES)})", "error", "unknown visibility"),
    ("confidence NOT BETWEEN 0 AND 100 OR find_score NOT BETWEEN 0 AND 100", "error", "score out of range"), ("lat IS NOT NULL AND NOT (lat BETWEEN 544e-1 AND 579e-1 AND lng BETWEEN 78e-1 AND 153e-1)", "error", "point abroad"),
    ("NOT regexp_matches(postcode, '^[1-9][0-9]{3}$')", "error", "bad postcode"), (f"address_visibility = 'fuld' AND NOT {_none('street')} AND NOT phone_verified", "error", "full address without vetting"), ("rows_ = 0", "warn", "no sources"),
    (f"NOT {_none('phone')} AND ({q_phone('phone')}) IS NULL", "warn", "bad telephone"), ("status = 'confirmed_active' AND last_verified IS NULL", "error", "confirmed but never verified"),
    ("status = 'confirmed_active' AND last_verified IS NOT NULL AND age > 180", "warn", "old confirmation"), ("age > 540 AND status NOT IN ('historical', 'rejected', 'possibly_inactive')", "warn", "no activity"),
    (f"status = 'call_first' AND {_none('phone')}", "warn", "call first without telephone"), (f"call_first AND {_none('phone')} AND {_none('profile_url')}", "warn", "no contact"),
    (f"address_visibility = 'kontakt-kraeves' AND {_none('phone')} AND {_none('profile_url')}", "error", "contact asked for but none given"), (f"NOT {_none('pattern')} AND rows_ < 2", "warn", "regular without history"),
]
Q_REPORT = f"""{Q_EVIDENCE}, i AS ({' UNION ALL '.join(f"SELECT '{s}' AS severity, slug, '{k}' AS check_ FROM e WHERE {r}" for r, s, k in _rules)}
 UNION ALL SELECT 'warn', key || ' x' || n, 'same telephone' FROM (SELECT {q_phone('phone')} AS key, count(*) AS n FROM e GROUP BY 1) x WHERE key IS NOT NULL AND n > 1
 UNION ALL SELECT 'warn', key || ' x' || n, 'same address' FROM (SELECT lower(trim(street) || '|' || trim(city)) AS key, count(*) AS n FROM e WHERE street <> '' GROUP BY 1) x WHERE n > 1
 UNION ALL SELECT 'info', CAST(count(*) AS VARCHAR), 'total' FROM e)"""


@query("V1_quality_report", f"WITH {Q_REPORT} SELECT severity, slug, check_ AS rule FROM i")
def report(spark, d):
    return P.quality_report(evidence(spark, d), today()).withColumnRenamed("check", "rule")


@query("V2_report_summary", f"WITH {Q_REPORT} SELECT check_ AS rule, severity, count(*) AS n FROM i GROUP BY 1, 2")
def _(spark, d):
    return P.report_summary(P.quality_report(evidence(spark, d), today())).withColumnRenamed("check", "rule")


@query("Q15_filter_places", f"SELECT id FROM v_places WHERE place_type IN ('lade', 'garage') AND {Q_LAYER} IN ('bekraeftet', 'kontroller-foerst') AND find_score >= 40 AND NOT call_first")
def _(spark, d):
    return P.filter_places(view(spark, d, "v_places"), ["lade", "garage"], ["bekraeftet", "kontroller-foerst"], 40, hide_call_first=True).select("id")


@query("Q16_sort_within_layers", f"""
SELECT id, layer, row_number() OVER (PARTITION BY layer ORDER BY find_score DESC, id) AS place FROM (SELECT id, find_score, {Q_LAYER} AS layer FROM v_places) x""")
def _(spark, d):
    rows = P.with_layer(view(spark, d, "v_places"))
    own = Window.partitionBy("layer").orderBy(F.desc("find_score"), "id")
    return rows.withColumn("place", F.row_number().over(own)).orderBy(*P.sort_within_layers(rows, F.desc("find_score"))).select("id", "layer", "place")


@query("Q17_active_filter_count", """
SELECT c_custkey, CAST(c_mktsegment = 'BUILDING' AS INT) + CAST(c_acctbal > 0 AS INT) + CAST(c_custkey % 3 = 0 AS INT) AS active FROM customer""")
def _(spark, d):
    states = [F.when(c("c_mktsegment") == "BUILDING", "x"), F.when(c("c_acctbal") > 0, c("c_acctbal")), c("c_custkey") % 3 == 0]
    return view(spark, d, "customer").select("c_custkey", P.active_filter_count(*states).alias("active"))


@query("A7_facet_options", "SELECT place_type, count(*) AS n FROM v_places GROUP BY place_type")
def _(spark, d):
    return U.facet_options(view(spark, d, "v_places"), "place_type")


@query("A15_duplicate_keys", f"SELECT phone, count(*) AS n, min(id) AS first FROM (SELECT id, {q_phone('phone')} AS phone FROM v_places) x WHERE phone IS NOT NULL GROUP BY phone HAVING count(*) > 1")
def _(spark, d):
    rows = view(spark, d, "v_places").select("id", T.normalize_phone(c("phone")).alias("phone")).where("phone is not null")
    return rows.groupBy("phone").agg(F.count("*").alias("n"), F.min("id").alias("first")).where("n > 1")


@query("A9_validate_photos", r"""
SELECT id, file FROM (SELECT id, CASE WHEN id % 5 = 0 THEN '../' || slug || '.jpg' WHEN id % 5 = 1 THEN slug || '.exe' ELSE slug || '-' || n_images || '.jpg' END AS file FROM v_places) x WHERE regexp_matches(file, '^[a-z0-9][a-z0-9_-]*\.(jpg|jpeg|png|webp)$')""")
def _(spark, d):
    name = F.when(c("id") % 5 == 0, F.concat(F.lit("../"), c("slug"), F.lit(".jpg"))).when(c("id") % 5 == 1, F.concat("slug", F.lit(".exe"))).otherwise(F.concat("slug", F.lit("-"), c("n_images").cast("string"), F.lit(".jpg")))
    return P.validate_photos(view(spark, d, "v_places").select("id", name.alias("file")), "file")


@query("A13_majority", """
SELECT place_id, source_type FROM (SELECT place_id, source_type, row_number() OVER (PARTITION BY place_id ORDER BY count(*) DESC, min(event_id)) AS n FROM v_sources GROUP BY place_id, source_type) x WHERE n = 1""")
def _(spark, d):
    return U.majority(view(spark, d, "v_sources"), "place_id", "source_type", "event_id")


@query("W11_first_last_seen", "SELECT place_id, min(observed_at) AS first, max(observed_at) AS last, max(observed_at) FILTER (WHERE source_type IN ('user_visit', 'phone_verification', 'operator_review')) AS verified FROM v_sources GROUP BY place_id")
def _(spark, d):
    return U.first_last_seen(view(spark, d, "v_sources"), "place_id", "observed_at", c("source_type").isin(P.HUMAN))


_rank = "CASE {} WHEN 'fuld' THEN 5 WHEN 'omraade' THEN 4 WHEN 'kun-aabningsdage' THEN 3 WHEN 'kontakt-kraeves' THEN 2 WHEN 'intern' THEN 1 ELSE 0 END"


@query("L11_upsert_places", f"""
WITH n AS (SELECT id, slug, address_visibility AS incoming, CASE WHEN id % 2 = 0 THEN 'omraade' ELSE 'intern' END AS stored, id % 10 = 0 AS fresh FROM v_places)
SELECT slug, CASE WHEN fresh OR {_rank.format('incoming')} <= {_rank.format('stored')} THEN incoming ELSE stored END AS address_visibility FROM n""")
def _(spark, d):
    rows = view(spark, d, "v_places").select("id", "slug", "address_visibility")
    stored = rows.where("id % 10 <> 0").withColumn("address_visibility", F.when(c("id") % 2 == 0, "omraade").otherwise("intern"))
    return P.upsert_places(stored, rows)


@query("L12_add_observations", """
SELECT place_id, source_type, observed_at, event_id FROM (SELECT *, row_number() OVER (PARTITION BY place_id, source_type, coalesce(url, ''), observed_at ORDER BY event_id DESC) AS n FROM v_sources) x WHERE n = 1""")
def _(spark, d):
    return P.add_observations(view(spark, d, "v_sources")).select("place_id", "source_type", "observed_at", "event_id")


@query("L13_ingest_places", f"""
WITH {Q_EVIDENCE}, b AS (SELECT place_id, min(observed_at) AS first_seen, max(observed_at) AS newest FROM v_sources GROUP BY place_id)
SELECT e.slug, b.first_seen, b.newest, sources FROM e LEFT JOIN b ON b.place_id = e.id WHERE lat IS NOT NULL OR street IS NOT NULL""")
def _(spark, d):
    return P.ingest_places(evidence(spark, d), view(spark, d, "v_sources")).select("slug", "first_seen", "newest", "sources")
