"""Landed files to listings: post feeds, calendar feeds, pages, store lists. Schemas are stated; malformed rows are dropped where said."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from localmarkets.functions import geo
from localmarkets.functions import text as T
from localmarkets.functions.facts import classify_venue

POST = "struct<id:string,url:string,text:string,name:string,description:string,startDate:string,endDate:string,location:struct<name:string,address:string,latitude:double,longitude:double>,isCanceled:boolean>"
CALENDAR = "struct<id:bigint,title:string,description:string,url:string,start_date:string,end_date:string,all_day:boolean,cost:string,venue:struct<venue:string,address:string>>"


def read_post_feed(spark: SparkSession, path: str) -> DataFrame:
    """Items of JSON files that hold an array or {"items": [...]}; files that are neither give no rows."""
    raw = spark.read.text(path, wholetext=True)
    return post_items(raw.withColumnRenamed("value", "line"))


def post_items(lines: DataFrame) -> DataFrame:
    """Items of a column ``line`` with a JSON array or {"items": [...]}."""
    array = F.from_json("line", f"array<{POST}>", {"mode": "PERMISSIVE"})
    wrapped = F.from_json("line", f"struct<items:array<{POST}>>", {"mode": "PERMISSIVE"})["items"]
    items = F.when(F.ltrim("line").startswith("["), array).otherwise(wrapped)
    return lines.select(F.explode(items).alias("item")).where("item is not null").select("item.*")


def route_items(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events with machine dates, posts with market words in their text); the rest is dropped."""
    dated = F.col("name").isNotNull() & F.col("startDate").isNotNull()
    posts = items.where(~F.coalesce(dated, F.lit(False)) & T.looks_like_market(F.col("text")))
    return items.where(dated), posts


def event_days(start: Column, end: Column, most: int = 30) -> Column:
    """array of struct(date, start_time, end_time) from two timestamps of one clock: the start time on the first day, the end time on the last."""
    first, last = F.to_date(start), F.greatest(F.to_date(start), F.coalesce(F.to_date(end), F.to_date(start)))
    return F.transform(F.slice(F.sequence(first, last), 1, most), lambda d: F.struct(
        d.alias("date"), F.when(d == first, F.date_format(start, "HH:mm")).alias("start_time"), F.when(d == F.to_date(end), F.date_format(end, "HH:mm")).alias("end_time")))


def calendar_events(lines: DataFrame) -> DataFrame:
    """Typed calendar items (JSON text column ``line``) to id, title, days, address parts; times are null for all-day items."""
    e = F.from_json("line", CALENDAR)
    rows = lines.select(e.alias("e")).where("e.id is not null").select("e.*")
    days = event_days(F.to_timestamp("start_date"), F.to_timestamp("end_date"), 60)
    days = F.when(F.col("all_day"), F.transform(days, lambda o: F.struct(o["date"].alias("date"), F.lit(None).cast("string").alias("start_time"), F.lit(None).cast("string").alias("end_time")))).otherwise(days)
    return rows.select("id", "title", T.parse_is_free(F.col("cost")).alias("is_free"), T.parse_address(F.col("venue.address")).alias("address"), days.alias("days"))


def merge_items(items: DataFrame, key: str, order: str, path: str, periods: str) -> DataFrame:
    """Items that several sites list under one key: the first path, all periods."""
    return items.groupBy(key).agg(F.min_by(path, order).alias("path"), F.array_sort(F.flatten(F.collect_list(periods))).alias("periods"))


def json_ld_events(pages: DataFrame) -> DataFrame:
    """The first schema.org Event of each page: name, start, end, town. Text after the object is ignored."""
    tails = F.split(F.concat(F.lit(" "), "html"), r'(?=\{[^{}]*"@type"\s*:\s*"Event")')
    event = "struct<name:string,startDate:string,endDate:string,location:struct<name:string,address:struct<addressLocality:string>>>"
    found = F.filter(F.transform(F.slice(tails, 2, F.greatest(F.size(tails) - 1, F.lit(0))), lambda t: F.from_json(t, event)), lambda e: e["name"].isNotNull())
    return pages.select("page_id", F.try_element_at(found, F.lit(1)).alias("e")).where("e is not null").select(
        "page_id", "e.name", F.to_date("e.startDate").alias("start"), F.to_date("e.endDate").alias("end"), F.col("e.location.address.addressLocality").alias("town")
    )


def labelled_fields(pages: DataFrame, labels: dict[str, str]) -> DataFrame:
    """Rows of "<th>label</th><td>value</td>" to one column a label; the first of each label counts."""
    cells = F.regexp_extract_all("html", F.lit(r"(?is)<th>(.*?</th>\s*<td>.*?)</td>"), F.lit(1))
    pairs = F.transform(cells, lambda x: F.struct(F.trim(F.regexp_extract(x, r"(?s)^(.*?)</th>", 1)).alias("label"), F.trim(F.regexp_replace(F.regexp_extract(x, r"(?s)<td>(.*)$", 1), "<[^>]+>", "")).alias("value")))
    first = lambda text: F.try_element_at(F.filter("pairs", lambda p: p["label"] == text), F.lit(1))["value"]
    return pages.select("page_id", pairs.alias("pairs")).where(F.size("pairs") > 0).select("page_id", *[first(text).alias(name) for name, text in labels.items()])


def calendar_rows(pages: DataFrame) -> DataFrame:
    """Rows of "<li>yyyy-mm-dd - yyyy-mm-dd | name</li>": spans of 0 to 6 days, each start of a page once."""
    found = F.regexp_extract_all("html", F.lit(r"<li>(\d{4}-\d{2}-\d{2} - \d{4}-\d{2}-\d{2} \| [^<]*)</li>"), F.lit(1))
    rows = pages.select("page_id", F.posexplode(found).alias("i", "x")).select(
        "page_id", "i", F.try_to_date(F.substring("x", 1, 10)).alias("start"), F.try_to_date(F.substring("x", 14, 10)).alias("end"), F.trim(F.substr("x", F.lit(26))).alias("name")
    )
    rows = rows.where(F.datediff("end", "start").between(0, 6))
    return rows.groupBy("page_id", "start").agg(F.min_by("name", "i").alias("name"), F.min_by("end", "i").alias("end"))


def links(pages: DataFrame) -> DataFrame:
    """Distinct link targets of all pages."""
    return pages.select(F.explode(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), F.lit(1))).alias("href")).where("href <> ''").distinct()


def osm_venues(objects: DataFrame) -> DataFrame:
    """Tagged map objects (type, id, lat, lon, tags) to venues; nameless ones, recycling points and car dealers are dropped."""
    tag = lambda n: F.try_element_at(F.col("tags"), F.lit(n))
    name = F.coalesce(tag("name"), tag("brand"), tag("operator"))
    rows = objects.where(name.isNotNull() & ~F.coalesce(tag("amenity") == "recycling", F.lit(False)) & ~F.coalesce(tag("shop") == "car", F.lit(False)))
    return rows.select("type", "id", name.alias("title"), classify_venue(tag("shop"), name).alias("category"), tag("addr:city").alias("city"), "lat", "lon", tag("opening_hours").alias("hours"))


def registry_venues(records: DataFrame) -> DataFrame:
    """Company records (id, name, address, active, opted_out) to shops: active, not opted out, with a full address, each id once."""
    rows = records.where("active and not opted_out").withColumn("a", T.parse_address(F.col("address"))).where("a.street is not null and a.postcode is not null and a.city is not null")
    return rows.dropDuplicates(["id"]).select("id", "name", "a.street", "a.postcode", "a.city")


def enrich_venues(chain: DataFrame, known: DataFrame, token: str, metres: float = 220) -> DataFrame:
    """Chain shops against shops that are known from elsewhere: action enrich (with the known shop), insert, or skip without a place.

    The known shop is the first by category and title whose name holds the chain's token, inside the distance.
    """
    near = F.lit(metres)
    one = chain.where("lat is not null").select("source_id", "lat", "lng", geo.cell(F.col("lat"), 0.01).alias("y"), geo.cell(F.col("lng"), 0.01).alias("x"))
    two = known.where(F.contains(T.normalize_title(F.col("title")), F.lit(token)) & F.col("lat").isNotNull()).select(F.col("source_id").alias("match"), F.col("lat").alias("lat2"), F.col("lng").alias("lng2"), "category", "title", F.explode(geo.near_cells(F.col("lat"), 0.01)).alias("y"))
    two = two.select("*", F.explode(geo.near_cells(F.col("lng2"), 0.01)).alias("x"))
    both = one.join(two, ["y", "x"]).where(geo.haversine(F.col("lat"), F.col("lng"), F.col("lat2"), F.col("lng2")) <= near)
    best = both.groupBy("source_id").agg(F.min(F.struct("category", "title", "match")).alias("b")).select("source_id", "b.match")
    return chain.join(best, "source_id", "left").select("source_id", "match", F.when(F.col("match").isNotNull(), "enrich").when(F.col("lat").isNull(), "skip").otherwise("insert").alias("action"))


def _addresses() -> Column:
    """Addresses in a listing's text."""
    return F.regexp_extract_all("description", F.lit(r"(?i)((?:https?://|www\.)[^\s\"'<>()\]]+)"), F.lit(1))


def domains_of(raws: DataFrame) -> DataFrame:
    """(k, domain, field): each domain a listing names, once; its own website before its text."""
    site = raws.select("k", T.normalize_domain(F.col("contact_website")).alias("domain"), F.lit(0).alias("o"))
    text = raws.select("k", F.explode(_addresses()).alias("u"))
    text = text.select("k", T.normalize_domain(F.col("u")).alias("domain"), F.lit(1).alias("o"))
    both = site.unionByName(text).where("domain is not null").groupBy("k", "domain").agg(F.min("o").alias("o"))
    return both.select("k", "domain", F.when(F.col("o") == 0, "website").otherwise("text").alias("field"))


def mine_domains(raws: DataFrame, own: list[str], titles: DataFrame) -> DataFrame:
    """Per domain: mentions, distinct titles, those already known (``titles``: column title, normalised), sources. Own and excluded domains are left out."""
    named = raws.select("title", "source_key", "contact_website", F.coalesce(_addresses(), F.array().cast("array<string>")).alias("found")).where("contact_website is not null or size(found) > 0")
    # Listings of one title, source and addresses are read once and counted.
    alike = named.groupBy("title", "source_key", "contact_website", "found").agg(F.count("*").alias("n"))
    domains = F.array_distinct(F.transform(F.concat(F.array("contact_website"), "found"), T.normalize_domain))
    rows = alike.select("title", "source_key", "n", F.explode(domains).alias("domain"), T.normalize_title(F.col("title")).alias("t")).where(F.col("domain").isNotNull() & ~T.is_excluded_domain(F.col("domain"), own))
    known = titles.select(F.col("title").alias("t")).distinct().withColumn("known", F.lit(True))
    return rows.join(known, "t", "left").groupBy("domain").agg(
        F.sum("n").alias("mentions"), F.count_distinct("title").alias("titles"), F.count_distinct(F.when(F.col("known"), F.col("title"))).alias("covered"), F.count_distinct("source_key").alias("sources")
    )


def embedded_objects(html: Column) -> Column:
    """Every object of a page that begins with an id."""
    parts = F.split(F.concat(F.lit(" "), html), r'(?=\{"id":)')  # a page may begin with an object
    return F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.from_json(p, "struct<id:bigint,slug:string,title:string>"))


STORE = "struct<stores:array<struct<no:bigint,name:string,address:string,kind:string>>>"


def store_locator_to_venues(lines: DataFrame, chain: str) -> DataFrame:
    """Shops of a chain's store lists (JSON text column ``line``): id of street and postcode, number, name, address parts; each id once.

    What isn't a shop is dropped, as are malformed lines; of rows with one id the smallest number stays.
    """
    shops = lines.select(F.explode(F.from_json("line", STORE)["stores"]).alias("s")).where("s.kind = 'shop'")
    rows = shops.select("s.no", "s.name", T.parse_address(F.col("s.address")).alias("a")).select("no", "name", "a.*")
    own = T.stable_id(F.concat_ws("|", F.lit(chain), "street", "postcode"))
    first = rows.groupBy(own.alias("source_id")).agg(F.min_by(F.struct("no", "name", "street", "postcode", "city"), "no").alias("r"))
    return first.select(F.lit(chain).alias("chain"), "source_id", F.col("r.no").alias("shop"), "r.name", "r.street", "r.postcode", "r.city")


def curated_counts(lines: DataFrame) -> DataFrame:
    """(slug, n) of JSON maps (text column ``line``): numbers rounded down; values that are none are ignored."""
    rows = lines.select(F.explode(F.from_json("line", "map<string,string>")).alias("slug", "value"))
    return rows.select("slug", F.floor(F.expr("try_cast(value as double)")).alias("n")).where("n is not null and not isnan(double(n))")


def read_curated_map(spark: SparkSession, path: str) -> DataFrame:
    """``curated_counts`` of JSON files."""
    return curated_counts(spark.read.text(path, wholetext=True).withColumnRenamed("value", "line"))


def vetted_places(lines: DataFrame) -> DataFrame:
    """(slug, name, kept) of JSON arrays (text column ``line``); a row without a slug or a name isn't kept, so rejected ones can be counted."""
    rows = lines.select(F.inline(F.from_json("line", "array<struct<slug:string,name:string>>")))
    return rows.withColumn("kept", F.coalesce((F.trim("slug") != "") & (F.trim("name") != ""), F.lit(False)))


def read_vetted_places(spark: SparkSession, path: str) -> DataFrame:
    """``vetted_places`` of JSON files."""
    return vetted_places(spark.read.text(path, wholetext=True).withColumnRenamed("value", "line"))
