"""Queries for posts, announcements, landed files and whole jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from localmarkets.functions import dates as D
from localmarkets.functions import facts, posts, sql_names
from localmarkets.functions import text as T
from localmarkets.operators import canonical, lifecycle, runs
from localmarkets.operators.joins import read_once
from localmarkets.operators.listing import ALIASES, saved_filter_parse
from localmarkets.plans.dates import reading
from localmarkets.plans.lifecycle import Q_MINED, mined
from localmarkets.plans.resolve import Q_CLUSTER, q_haversine
from localmarkets.plans.text import q_clean_city, q_domain, q_fold, q_strip_dates, q_title
from localmarkets.shared import scratch, shared_path
from localmarkets.sources import adapters, exports, feeds, tips
from localmarkets.views import SENTENCES, TODAY, view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
c = F.col
_text = "regexp_replace(text, ' [0-9]+ boder$', '')"


def today():
    return F.lit(TODAY).cast("date")


def query(name: str, sql: str | None = None) -> Callable:
    def keep(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            SQL[name] = with_views(sql)
        return f

    return keep


def by_sentence(values: dict[int, str], other: str = "NULL") -> str:
    return reading(_text, SENTENCES, [values.get(i, other) for i in range(len(SENTENCES))])


# --- posts ---
# Recorded from the classifier's own output, so they show a later change and not an error of the rules: label, confidence, kind of place, evidence, to be reviewed.
POSTS = {
    0: ("kraever_review", "3e-1", None, "market words, unclear", True), 1: ("loppemarked", "7e-1", None, "stalls", False), 2: ("loppemarked", "7e-1", None, "public place", False),
    7: ("kraever_review", "3e-1", None, "market words, unclear", True), 22: ("enkeltstaaende_privatsalg", "75e-2", None, "all must go", False), 23: ("kraever_review", "3e-1", None, "market words, unclear", True),
    30: ("kraever_review", "3e-1", None, "market words, unclear", True), 31: ("kraever_review", "3e-1", None, "market words, unclear", True), 32: ("kraever_review", "3e-1", None, "market words, unclear", True),
    34: ("doedsbosalg", "75e-2", None, "estate", False), 35: ("informal_place", "55e-2", "loppelade", "flea barn", True), 36: ("kraever_review", "3e-1", None, "market words, unclear", True),
}
_told = lambda at, show, other: by_sentence({i: show(v[at]) for i, v in POSTS.items()}, other)
_quoted = lambda v: "NULL" if v is None else f"'{v}'"


@query("X6_classify_post", f"""
SELECT k, {_told(0, _quoted, "'irrelevant'")} AS label, {_told(1, str, '9e-1')} AS confidence, {_told(2, _quoted, 'NULL')} AS place_type, {_told(3, _quoted, "'no market words'")} AS evidence, {_told(4, str, 'false')} AS needs_review FROM v_text""")
def classified(spark, d):
    return view(spark, d, "v_text").select("k", posts.classify_post(c("text")).alias("p")).select("k", "p.label", "p.confidence", "p.place_type", F.array_join("p.evidence", ", ").alias("evidence"), "p.needs_review")


@query("X7_corpus_candidate", r"""
SELECT k, regexp_matches(f, '\bloppe|\bkraemmer|\bgenbrug|\bantik|\bbrugte?\b|\bbohave\b|\bindbo\b|\bsamler|\bdoedsbo|\bretro\b|\bvintage\b|\bgaardsalg\b|\bgaragesalg\b|\blade.{0,15} lopper\b|\bforening\b|\bspejder\b|\bmenighed\b|\bkirke\b|\bborgerforening\b') AS candidate
FROM (SELECT k, replace(replace(replace(lower(text), 'æ', 'ae'), 'ø', 'oe'), 'å', 'aa') AS f FROM v_text) x""")
def _(spark, d):
    return view(spark, d, "v_text").select("k", posts.is_corpus_candidate(c("text")).alias("candidate"))


# --- announcements ---
_own = "make_date(2026, CAST(k % 12 + 1 AS INT), CAST(k % 28 + 1 AS INT))"


@query("D2_scan_dates", f"""
WITH x AS (SELECT k, list_filter([{by_sentence({0: "DATE '2026-07-05'", 39: "DATE '2026-08-23'"}, 'CAST(NULL AS DATE)')}, CASE WHEN {_own} >= DATE '2026-07-03' THEN {_own} WHEN DATE '2026-07-03' - {_own} > 45 THEN make_date(2027, CAST(k % 12 + 1 AS INT), CAST(k % 28 + 1 AS INT)) END], lambda d: d IS NOT NULL) AS days FROM v_text)
SELECT k, array_to_string(list_sort(list_distinct(days)), ' ') AS dates FROM x""")
def _(spark, d):
    text = F.concat(c("text"), F.lit(" og den "), (c("k") % 28 + 1).cast("string"), F.lit("."), (c("k") % 12 + 1).cast("string"))
    return view(spark, d, "v_text").select("k", F.array_join(D.scan_dates(text, today()).cast("array<string>"), " ").alias("dates"))


@query("D16_recurring_in_month", """
SELECT c_custkey AS k, CAST(d AS DATE) AS date FROM (SELECT c_custkey, unnest(generate_series(greatest(DATE '2026-07-03', make_date(2026, CAST(c_custkey % 12 + 1 AS INT), 1)), last_day(make_date(2026, CAST(c_custkey % 12 + 1 AS INT), 1)), INTERVAL 1 DAY)) AS d FROM customer) x
WHERE isodow(d) = 6""")
def _(spark, d):
    name = F.element_at(F.array(*[F.lit(m) for m in D.MONTH_NAMES]), (c("c_custkey") % 12 + 1).cast("int"))
    text = F.concat(F.lit("Sommermarked hver lørdag i "), name, F.lit(" måned"))
    rows = view(spark, d, "customer").select(c("c_custkey").alias("k"), text.alias("text"))
    return read_once(rows, "text", days=tips.recurring_in_month(c("__text"), today())).select("k", F.explode("days").alias("date"))


@query("S15_tips_to_raw", f"""
SELECT k, {by_sentence({0: "'Loppemarked'", 39: "'Nødebo Kro'"})} AS title, {by_sentence({0: "DATE '2026-07-05'", 39: "DATE '2026-08-23'"})} AS first, {by_sentence({0: "'10:00'"})} AS start_time FROM v_text WHERE {by_sentence({0: '1', 39: '1'})} = 1""")
def parsed(spark, d):
    return tips.tips_to_raw(view(spark, d, "v_text"), today()).select("k", "title", F.element_at("days", 1).alias("first"), "start_time")


@query("L16_process_tips", f"SELECT k, CASE WHEN {by_sentence({0: '1', 39: '1'})} = 1 THEN 'processed' ELSE 'new' END AS status FROM v_text")
def _(spark, d):
    return runs.process_tips(view(spark, d, "v_text"), today())[0]


_tip = f"({by_sentence({0: '1', 39: '2'})})"


@query("L16_tip_figures", f"""
WITH t AS (SELECT {_tip} AS kind FROM v_text), n AS (SELECT count(*) AS tips, count(kind) AS parsed, count(DISTINCT kind) AS created FROM t)
SELECT figure, value FROM (SELECT unnest(['tips', 'unparsed', 'created', 'merged', 'unchanged', 'skipped']) AS figure, unnest([tips, tips - parsed, created, parsed - created, 0, 0]) AS value FROM n) x""")
def _(spark, d):
    """Tips of one market, however many, make one event; its figures go to the log and are read back."""
    log = runs.RunLog(spark, shared_path(spark, "runs"))
    log.append("tips", "tips", runs.process_tips(view(spark, d, "v_text"), today())[3])
    return log.read().select(F.explode("figures").alias("figure", "value"))


@query("T35_extract_title", "SELECT k, title || ' ' || postcode AS title FROM (SELECT k, trim(regexp_replace(title, 'lørdag.*$', '')) AS title, postcode FROM v_raw) x")
def _(spark, d):
    title = T.squeeze(F.regexp_replace("title", "lørdag.*$", ""))
    return view(spark, d, "v_raw").select("k", tips.extract_title(F.concat(title, F.lit(" "), c("postcode"), F.lit(" lørdag den 5. juli kl. 10. Kom og se"))).alias("title"))


@query("T32_strip_feed_chrome", "SELECT k, 'Anna ' || regexp_replace(regexp_replace(text, '^[^a-zA-Z0-9æøåÆØÅ]+', ''), '^Book ', '') AS text FROM v_text")  # "Book" is a button's word
def _(spark, d):
    noisy = F.concat(F.lit("• 3 Public group 1,2k members Anna July 2 at 8:11PM "), c("text"), F.lit(" • Share"))
    return view(spark, d, "v_text").select("k", T.strip_feed_chrome(noisy).alias("text"))


# Labels of weather codes by range.
WEATHER = [(0, 0, "clear"), (1, 3, "clouds"), (45, 48, "fog"), (51, 67, "rain"), (71, 77, "snow"), (80, 82, "showers"), (95, 99, "thunder")]


@query("T40_code_label", "SELECT event_id, CASE " + " ".join(f"WHEN event_id % 100 BETWEEN {a} AND {b} THEN '{n}'" for a, b, n in WEATHER) + " ELSE 'unknown' END AS label FROM events")
def _(spark, d):
    return view(spark, d, "events").select("event_id", T.code_label(c("event_id") % 100, WEATHER).alias("label"))


@query("T42_extract_postal_town", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '5000 Odense' END AS town FROM pages")
def _(spark, d):
    html = F.concat("html", F.lit(" Kalender 2026 Program. "), F.when(c("page_id") % 2 == 0, "Torvet 1, 5000 Odense C").otherwise(""))
    return view(spark, d, "pages").select("page_id", T.extract_postal_town(html).alias("town"))


@query("T43_extract_phone", "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN '20 ' || substr(CAST(100000 + s_suppkey AS VARCHAR), 1, 2) || ' ' || substr(CAST(100000 + s_suppkey AS VARCHAR), 3, 2) || ' ' || substr(CAST(100000 + s_suppkey AS VARCHAR), 5, 2) END AS phone FROM supplier")
def _(spark, d):
    lines = F.array(c("s_name"), F.when(c("s_suppkey") % 2 == 0, F.concat(F.lit("Tlf. 20"), (100000 + c("s_suppkey")).cast("string"))).otherwise("ingen telefon her"))
    return view(spark, d, "supplier").select("s_suppkey", T.extract_phone(lines).alias("phone"))


# --- landed files ---
@query("S5_discovered_feeds", f"""
WITH {Q_MINED}, r AS (SELECT domain, row_number() OVER (ORDER BY mentions DESC, domain) AS n FROM m), t AS (SELECT k, {q_domain('contact_website')} AS domain, title FROM v_raw)
SELECT k, t.domain || '-' || k AS source_event_id, 3e-1 AS trust FROM t JOIN r ON r.domain = t.domain WHERE n <= 30 AND regexp_matches(title, 'marked', 'i')""")
def _(spark, d):
    top = mined(spark, d).orderBy(F.desc("mentions"), "domain").limit(30).select("domain")
    rows = view(spark, d, "v_raw").withColumn("domain", T.normalize_domain(c("contact_website"))).where(c("title").rlike("(?i)marked"))
    return rows.join(top, "domain").select("k", F.concat("domain", F.lit("-"), c("k").cast("string")).alias("source_event_id"), F.lit(0.3).alias("trust"))


@query("S8_embedded_objects", "SELECT page_id AS id, 'marked-' || page_id AS slug FROM pages")
def _(spark, d):
    item = lambda i: F.concat(F.lit('{"id":'), i.cast("string"), F.lit(',"slug":"marked-'), i.cast("string"), F.lit('","title":"Loppemarked"} junk '))
    html = F.concat("html", item(c("page_id")), item(c("page_id")))
    rows = view(spark, d, "pages").select(F.explode(feeds.embedded_objects(html)).alias("o")).where("o.id is not null")
    return rows.where(T.looks_like_market(c("o.title"))).groupBy("o.id").agg(F.min("o.slug").alias("slug"))


@query("S12_store_locator", "SELECT source_id AS shop, 'Vej ' || source_id AS street, postcode, 'By' AS city FROM v_venues WHERE source_type = 'chain' AND source_id % 3 <> 0")
def _(spark, d):
    shop = F.struct(c("source_id").alias("no"), F.concat(F.lit("Vej "), c("source_id").cast("string"), F.lit(", "), c("postcode"), F.lit(" By")).alias("address"), F.when(c("source_id") % 3 == 0, "office").otherwise("shop").alias("kind"))
    lines = view(spark, d, "v_venues").where("source_type = 'chain'").select(F.to_json(F.struct(F.array(shop, shop).alias("stores"))).alias("line"))
    return feeds.store_locator_to_venues(lines, "chain").select("shop", "street", "postcode", "city")


@query("S17_curated_map", "SELECT 'sted-' || c_custkey AS slug, CAST(floor(c_custkey % 7 + 5e-1) AS BIGINT) AS n FROM customer WHERE c_custkey % 4 <> 0")
def _(spark, d):
    value = F.when(c("c_custkey") % 4 == 0, F.lit("x")).otherwise((c("c_custkey") % 7 + 0.5).cast("string"))
    lines = view(spark, d, "customer").select(F.to_json(F.create_map(F.concat(F.lit("sted-"), c("c_custkey").cast("string")), value)).alias("line"))
    return feeds.curated_counts(lines)


@query("S18_vetted_places", "SELECT slug, name FROM v_places WHERE id % 9 <> 0")
def _(spark, d):
    row = F.struct(F.when(c("id") % 9 != 0, c("slug")).alias("slug"), "name")
    lines = view(spark, d, "v_places").select(F.to_json(F.array(row)).alias("line"))
    return feeds.vetted_places(lines).where("kept").select("slug", "name")


@query("S21_export_listing_json", """SELECT source_id, '{"id":' || source_id || ',"title":"' || title || '"}' AS json FROM v_venues WHERE source_type = 'map'""")
def _(spark, d):
    return exports.listing_json(view(spark, d, "v_venues").where("source_type = 'map'"), "source_id", id="source_id", title="title")


@query("S24_run_log", """
SELECT 'listings' AS run, 'n' AS figure, count(*) AS value FROM v_raw UNION ALL SELECT 'listings', 'without_street', count(*) FILTER (WHERE street IS NULL) FROM v_raw
UNION ALL SELECT 'venues', 'n', count(*) FROM v_venues""")
def _(spark, d):
    """The figures are observed while the rows are written; each run appends a row."""
    log = runs.RunLog(spark, shared_path(spark, "runs"))
    for run, rows, figures in (("listings", view(spark, d, "v_raw"), {"without_street": F.count_if(c("street").isNull())}), ("venues", view(spark, d, "v_venues"), {})):
        log.append(run, "load", runs.observed_cut(rows, run, n=F.count("*"), **figures)[1])
    return log.read().select("run", F.explode("figures").alias("figure", "value"))


@query("Q19_structured_feed_domains", f"SELECT DISTINCT {q_domain('url')} AS domain FROM pages WHERE page_id % 3 = 0 AND page_id % 5 <> 0 AND page_id % 4 <> 0")
def _(spark, d):
    probe = F.when(c("page_id") % 5 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct((c("page_id") % 3 == 0).alias("api"))))
    return lifecycle.structured_feed_domains(view(spark, d, "pages").withColumns({"probe": probe, "status": F.when(c("page_id") % 4 == 0, "rejected").when(c("page_id") % 7 != 0, "candidate")}), "url", "probe", "status")


@query("Q21_saved_filter_parse", """
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'today' ELSE 'weekend' END AS dates, CASE WHEN o_orderkey % 2 = 0 THEN true ELSE false END AS free, CASE WHEN o_orderkey % 5 = 0 THEN 'indoor' END AS place, o_orderkey % 7 = 0 AS map, CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END AS stops FROM orders""")
def _(spark, d):
    k = c("o_orderkey")
    link = F.concat_ws("&", F.when(k % 3 == 0, "dato=today").when(k % 3 == 1, "dato=nonsense"), F.when(k % 2 == 0, "gratis=1"), F.when(k % 5 == 0, "inde=1"), F.when(k % 7 == 0, "visning=kort"), F.when(k % 4 == 0, "tur=e:abc-1,x:no,E:bad"))
    return saved_filter_parse(view(spark, d, "orders"), "o_orderkey", link).withColumn("stops", F.size("stops"))


@query("F3_expand_aliases", f"SELECT k, replace({q_fold('q')}, 'cph', 'kobenhavn') AS query FROM (SELECT k, 'CPH ' || category AS q FROM v_raw) x")
def _(spark, d):
    names = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    tokens = F.transform(F.split(T.fold_for_search(F.concat(F.lit("CPH "), c("category"))), r"\s+"), lambda t: F.coalesce(F.try_element_at(names, t), t))
    return view(spark, d, "v_raw").select("k", F.array_join(tokens, " ").alias("query"))


# --- whole jobs ---
def canonical_events(spark, d, previous=None):
    events, _ = canonical.canonicalize(view(spark, d, "v_raw"), view(spark, d, "v_occ"), today(), previous)
    return events


# The parts of a rebuild that SQL of moderate length can say: listings with a day ahead, cleaned, and their clusters by the rules of J1, J2.
_inside = "coalesce(lat BETWEEN 544e-1 AND 579e-1 AND lng BETWEEN 78e-1 AND 153e-1, false)"
Q_CLEANED = f"""
ahead AS (SELECT event_id, list_sort(list_distinct(list(date))) AS dates FROM v_occ WHERE date >= DATE '2026-07-03' GROUP BY event_id),
l AS (SELECT v.* EXCLUDE (title, street, city, lat, lng, geocode_quality), {q_strip_dates('v.title')} AS title, v.street, {q_clean_city('v.city', 'v.postcode')} AS city,
  CASE WHEN {_inside} THEN v.lat END AS lat, CASE WHEN {_inside} THEN v.lng END AS lng, CASE WHEN {_inside} THEN v.geocode_quality END AS geocode_quality, ahead.dates
  FROM v_raw v JOIN ahead ON ahead.event_id = v.k),"""
Q_CANON = f"""WITH RECURSIVE {Q_CLEANED} {Q_CLUSTER[Q_CLUSTER.index('n AS (SELECT'):]},
z AS (SELECT l.*, cl.cluster, max(trust) OVER (PARTITION BY cl.cluster) AS best FROM l JOIN cl ON cl.k = l.k),
days AS (SELECT cluster, min(date) AS first_date, count(*) AS days FROM (SELECT cluster, date FROM v_occ JOIN z ON z.k = event_id WHERE date >= DATE '2026-07-03' GROUP BY cluster, date, best HAVING max(trust) >= least(best, 5e-1)) x GROUP BY cluster)"""


_rank = "CASE geocode_quality WHEN 'source' THEN 3 WHEN 'A' THEN 2 WHEN 'B' THEN 1 ELSE 0 END DESC, trust DESC, last_seen DESC, k DESC"
_place = lambda n: f"first({n} ORDER BY {_rank}) FILTER (WHERE lat IS NOT NULL)"
_title_city = "concat_ws(' ', title, city)"
_base = f"substr(replace({q_title(_title_city)}, ' ', '-'), 1, 80)"


@query("L2_canonicalize", rf"""{Q_CANON},
ev AS (SELECT z.cluster, count(*) AS size, count(DISTINCT source_key) AS sources, any_value(first_date) AS first_date, any_value(days) AS days, CASE WHEN bool_or(cancelled AND trust >= least(5e-1, best)) THEN 'cancelled' ELSE 'active' END AS status,
  first(title ORDER BY regexp_matches(title, '\b20\d{{2}}\b|d\.\s*\d'), trust DESC, last_seen DESC, k DESC) AS title, first(city ORDER BY trust DESC, last_seen DESC, k DESC) FILTER (WHERE city <> '') AS city,
  coalesce(first(category ORDER BY trust DESC, last_seen DESC, k DESC) FILTER (WHERE category NOT IN ('', 'andet')), 'andet') AS category, {_place('lat')} AS lat, {_place('lng')} AS lng, {_place('geocode_quality')} AS quality,
  max(trust) AS trust, max(last_seen) AS seen FROM z JOIN days ON days.cluster = z.cluster GROUP BY z.cluster),
cf AS (SELECT *, least(1e0, greatest(0e0, floor((trust * 5e-1 + least(sources - 1, 2) * 1e-1 + greatest(0e0, 1e0 - greatest(0, greatest(0, DATE '2026-07-03' - seen) - 14) / 106) * 2e-1
  + CASE WHEN lat IS NOT NULL AND quality NOT IN ('P', 'C') THEN 1e-1 ELSE 0 END + 1e-1) * 100 + 5e-1) / 100)) AS raw, {_base} AS base, row_number() OVER (PARTITION BY {_base} ORDER BY cluster) AS nth FROM ev)
SELECT cluster, CASE WHEN nth = 1 THEN base ELSE base || '-' || nth END AS slug, title, category, city, lat, lng, sources, size, first_date, days, status, CASE WHEN sources <= 1 AND trust < 5e-1 THEN least(raw, 44e-2) ELSE raw END AS confidence FROM cf""")
def _(spark, d):
    return canonical_events(spark, d).select("cluster", "slug", "title", "category", "city", "lat", "lng", "sources", "size", "first_date", "days", "status", "confidence")


@query("L7_rebuild", rf"""{Q_CANON},
h AS (SELECT *, 'kept-' || CAST(floor(k / 2) AS BIGINT) AS had FROM z),
ev AS (SELECT z.cluster, count(*) AS size, first(had ORDER BY trust DESC, k) FILTER (WHERE k % 2 = 0) AS kept,
  first(title ORDER BY regexp_matches(title, '\b20\d{{2}}\b|d\.\s*\d'), trust DESC, last_seen DESC, k DESC) AS title, first(city ORDER BY trust DESC, last_seen DESC, k DESC) FILTER (WHERE city <> '') AS city,
  CASE WHEN bool_or(cancelled AND trust >= least(5e-1, best)) OR bool_or(k % 8 = 0) THEN 'cancelled' ELSE 'active' END AS status FROM h z JOIN days ON days.cluster = z.cluster GROUP BY z.cluster),
nb AS (SELECT *, coalesce(kept, {_base}) AS base FROM ev), nt AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY cluster) AS nth FROM nb)
SELECT cluster, CASE WHEN nth = 1 THEN base ELSE base || '-' || nth END AS slug, size, status FROM nt""")
def _(spark, d):
    """Slugs and states that listings' events had before go on; the others are named anew."""
    k = c("k")
    previous = view(spark, d, "v_raw").where("k % 2 = 0").select("k", F.concat(F.lit("kept-"), F.floor(k / 2).cast("string")).alias("slug"), F.when(k % 8 == 0, "cancelled").otherwise("active").alias("status"))
    return canonical_events(spark, d, previous).select("cluster", "slug", "size", "status")


@query("L2_run_figures", f"""{Q_CANON},
b AS (SELECT cluster, count(*) AS n, bool_or(k % 2 = 0) AS had, count(*) FILTER (WHERE k % 2 = 0 AND k % 3 <> 0) AS same FROM z GROUP BY cluster)
SELECT figure, value FROM (SELECT unnest(['created', 'merged', 'unchanged', 'skipped']) AS figure,
  unnest([count(*) FILTER (WHERE NOT had), CAST(sum(n - same) AS BIGINT) - count(*) FILTER (WHERE NOT had), CAST(sum(same) AS BIGINT), (SELECT count(*) FROM v_raw) - (SELECT count(*) FROM l)]) AS value FROM b) x""")
def _(spark, d):
    """A run in which half of the listings' events were known and a third of the payloads changed."""
    raws = view(spark, d, "v_raw").withColumn("changed", c("k") % 3 == 0)
    previous = view(spark, d, "v_raw").where("k % 2 = 0").select("k", F.concat(F.lit("kept-"), F.floor(c("k") / 2).cast("string")).alias("slug"), F.lit("active").alias("status"))
    with scratch(spark):  # only the figures are asked for
        figures = canonical.canonicalize_run(raws, view(spark, d, "v_occ"), today(), previous)[2]
    return spark.createDataFrame(list(figures.items()), "figure string, value long")


Q_FUNNEL = f"""{Q_MINED}, old AS (SELECT domain, CASE WHEN length(domain) % 5 = 0 THEN 'rejected' ELSE 'candidate' END AS status, CASE WHEN length(domain) % 4 = 0 THEN 7 END AS score FROM m WHERE length(domain) % 2 = 0),
f AS (SELECT m.domain, mentions, coalesce(status, 'new') AS status, score FROM m LEFT JOIN old ON old.domain = m.domain),
due AS (SELECT domain FROM f WHERE status <> 'rejected' AND mentions >= 2 ORDER BY score DESC NULLS LAST, mentions DESC, domain LIMIT 10),
pw AS (SELECT {q_domain('url')} AS domain, html, list_filter([{", ".join(f"CASE WHEN regexp_matches(lower(html), '{w}') THEN 1 END" for w in ["loppemarked", "kræmmermarked|kraemmermarked", "bagagerumsmarked", "genbrugsmarked", "antikmarked", "stadeplads", "stadeleje", "markedskalender", "kræmmere|kraemmere"])}], lambda x: x IS NOT NULL) AS words FROM pages),
ps AS (SELECT domain, max(CAST(regexp_matches(html, '"@type"[ ]*:[ ]*"Event"') AS INT) * 3 + CAST(regexp_matches(html, '\\.ics|text/calendar', 'i') AS INT) * 2 + CAST(regexp_matches(html, 'application/(rss|atom)\\+xml', 'i') AS INT) * 2
  + least(len(words), 3) + CAST(regexp_matches(html, 'lang="da"|æ|ø|å', 'i') AS INT) + CAST(regexp_matches(html, 'wp-content|wp-json') AS INT)) AS score FROM pw WHERE domain IN (SELECT domain FROM due) GROUP BY domain),
cand AS (SELECT f.domain, mentions, status, CASE WHEN f.domain IN (SELECT domain FROM due) THEN coalesce(ps.score, 0) ELSE f.score END AS score FROM f LEFT JOIN ps ON ps.domain = f.domain)"""


def discovered(spark, d):
    found = mined(spark, d)
    status = F.when(F.length("domain") % 5 == 0, "rejected").otherwise("candidate")
    existing = found.where(F.length("domain") % 2 == 0).select("domain", status.alias("status"), F.lit("seen").alias("note"), F.lit(1).cast("long").alias("mentions"), F.when(F.length("domain") % 4 == 0, 7).alias("score"))
    return runs.discovery_run(found, existing, view(spark, d, "pages"))


@query("L17_discovery_run", f"WITH {Q_FUNNEL} SELECT domain, mentions, status, CAST(score AS INT) AS score FROM cand")
def _(spark, d):
    return discovered(spark, d)[0].select("domain", "mentions", "status", "score")


@query("L17_shortlist", f"WITH {Q_MINED} SELECT domain, mentions, titles - covered AS fresh FROM m WHERE titles - covered >= 1 ORDER BY fresh DESC, mentions DESC, domain LIMIT 20")
def _(spark, d):
    return discovered(spark, d)[1].select("domain", "mentions", "fresh")


@query("L17_run_figures", f"WITH {Q_FUNNEL} SELECT (SELECT count(*) FROM m) AS domains, (SELECT count(*) FROM due) AS probed, count(*) FILTER (WHERE score >= 6) AS strong FROM cand")
def _(spark, d):
    figures = discovered(spark, d)[2]
    return spark.createDataFrame([(figures["domains"], figures["probed"], figures["strong"])], "domains long, probed long, strong long")


# --- extension surface ---
@query("E1_source_adapters", "SELECT 'orders' AS source_key, CAST(o_orderkey AS VARCHAR) AS source_event_id, 7e-1 AS trust FROM orders UNION ALL SELECT 'events', CAST(event_id AS VARCHAR), 4e-1 FROM events")
def _(spark, d):
    none = F.lit(None).cast("string")
    raw = lambda df, key, day: df.select(c(key).cast("string").alias("source_event_id"), none.alias("title"), none.alias("description"), none.alias("city"), none.alias("postcode"), F.to_date(day).alias("date"))
    known = [adapters.Adapter("orders", "Orders", 0.7, lambda df: raw(df, "o_orderkey", "o_orderdate")), adapters.Adapter("events", "Events", 0.4, lambda df: raw(df, "event_id", "ts")), adapters.Adapter("absent", "Absent", 0.1, lambda df: df)]
    return adapters.extract_all(known, {n: view(spark, d, n) for n in ("orders", "events")}).select("source_key", "source_event_id", "trust")


@query("E5_sql_names", f"SELECT k, {q_title('title')} AS title, round({q_haversine('557e-1', '125e-1', 'lat', 'lng')}, 3) AS metres, CASE WHEN trust >= 75e-2 THEN 'confirmed' WHEN trust >= 45e-2 THEN 'ok' ELSE 'unverified' END AS level FROM v_raw")
def _(spark, d):
    sql_names.register(spark)
    return spark.sql("SELECT k, normalize_title(title) AS title, round(haversine_m(55.7D, 12.5D, lat, lng), 3) AS metres, trust_level(trust) AS level FROM {rows}", rows=view(spark, d, "v_raw"))


