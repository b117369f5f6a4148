"""Discovery queries over listings and their occurrences."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from localmarkets.functions import dates, facts, geo, scores
from localmarkets.functions import text as T
from localmarkets.shared import cut

HORIZON = 365


def day(d: str) -> Column:
    return F.lit(d).cast("date")


def events_between(listings: DataFrame, occurrences: DataFrame, first: str, last: str) -> DataFrame:
    """Listings with a day in the window, and their days there in order (``occ``)."""
    held = occurrences.where(F.col("date").between(day(first), day(last))).groupBy("event_id").agg(
        F.array_sort(F.collect_list(F.struct("date", "start_time", "end_time"))).alias("occ")
    )
    return listings.join(held, listings["k"] == held["event_id"]).drop("event_id")


def upcoming_listing(listings: DataFrame, occurrences: DataFrame, today: str, confidence: Column, horizon: int = HORIZON, most: int = 40) -> DataFrame:
    """Projection for display: cleaned fields, coordinates inside the country only, derived flags, at most ``most`` days each."""
    last = F.date_add(day(today), horizon)
    days = F.slice(F.col("occ"), 1, most)
    events = events_between(listings, occurrences.where(F.col("date") <= last), today, "9999-12-31").withColumn("confidence", confidence)
    inside = geo.in_denmark(F.col("lat"), F.col("lng"))
    low = F.lower("description")
    points = scores.gem_points(F.col("description"), F.col("stall_count_text"), F.col("is_free").isNotNull(), F.exists("occ", lambda o: o["start_time"].isNotNull()), F.col("venue_name"), F.col("contact_website"))
    gem = scores.hidden_gem(F.col("confidence"), F.col("source_count"), F.size("occ"), F.col("lat").isNotNull(), F.col("stall_count_text"), points)
    search = F.substring(T.squeeze(T.search_fold(F.col("description"))), 1, 400)
    return events.select(
        "k", "title", "category", T.clean_venue_name(F.col("venue_name")).alias("venue_name"), T.clean_city(F.col("city"), F.col("postcode")).alias("city"), "postcode", "street",
        F.when(inside, F.col("lat")).alias("lat"), F.when(inside, F.col("lng")).alias("lng"), (inside & T.is_approximate_geocode(F.col("geocode_quality"))).alias("approximate"),
        "is_free", "indoor_outdoor", "stall_count_text", "confidence", "source_count", gem.alias("gem"),
        F.coalesce(facts.facet(low, facts.FACETS["kids"]), F.lit(False)).alias("family_friendly"), F.coalesce(facts.facet(low, facts.FACETS["accessibility"]), F.lit(False)).alias("accessible"),
        F.coalesce(facts.weather_dependent(low), F.lit(False)).alias("weather_dependent"), facts.goods_signals(F.concat_ws(" ", "title", "description")).alias("goods"),
        F.coalesce(search, F.lit("")).alias("search_text"), days.alias("occ"), F.element_at("occ", 1)["date"].alias("first_date"),
    )


@dataclass
class Filters:
    """A state of the explorer; what is left at its default doesn't filter."""

    first: str = "2026-07-03"
    last: str = "2026-07-05"
    categories: list[str] = field(default_factory=list)
    goods: list[str] = field(default_factory=list)
    free: bool = False
    family: bool = False
    accessible: bool = False
    large: bool = False
    verified: bool = False
    place: str | None = None
    query: str = ""
    position: tuple[float, float] | None = None
    radius_km: float | None = None
    open_at: tuple[str, str] | None = None


def matches_query(hay: Column, query: str) -> Column:
    """Every token is in the folded text, or, from four characters on, within one edit of a word of three or more."""
    ok = F.lit(True)
    for t in query.split():
        ok = ok & (F.contains(hay, F.lit(t)) | F.exists(F.split(hay, "[^a-z0-9]+"), _within_an_edit(t)) if len(t) >= 4 else F.contains(hay, F.lit(t)))
    return ok


def _within_an_edit(token: str):
    return lambda w: (F.length(w) >= 3) & F.levenshtein(w, F.lit(token), 1).between(0, 1)


def haystack(*columns: str) -> Column:
    return T.fold_for_search(F.concat_ws(" ", *columns))


def fold_query(query: str) -> str:
    q = query.lower()
    for old, new in (("æ", "ae"), ("ø", "o"), ("å", "a"), ("oe", "o"), ("aa", "a")):
        q = q.replace(old, new)
    return " ".join(ALIASES.get(t, t) for t in q.split())


# Short names of cities in folded form.
ALIASES = {"kbh": "kobenhavn", "cph": "kobenhavn", "copenhagen": "kobenhavn"}
TEXT_COLUMNS = ("title", "venue_name", "city", "postcode", "street", "search_text")


def with_distance(rows: DataFrame, position: tuple[float, float] | None) -> DataFrame:
    km = geo.distance_km(F.lit(position[0]), F.lit(position[1]), F.col("lat"), F.col("lng")) if position else F.lit(None).cast("double")
    return rows.withColumn("km", km)


def explore(rows: DataFrame, f: Filters, today: str, columns: tuple[str, ...] = TEXT_COLUMNS) -> DataFrame:
    """The listings that a filter state shows, with ``next_date`` and ``km``. A text query looks over the whole horizon."""
    first, last = (day(today), F.date_add(day(today), HORIZON)) if f.query.strip() else (day(f.first), day(f.last))
    rows = with_distance(rows.withColumn("next_date", F.array_min(F.filter(F.transform("occ", lambda o: o["date"]), lambda x: x.between(first, last)))), f.position)
    keep = [F.col("next_date").isNotNull()]
    if f.open_at:
        keep.append(F.exists("occ", lambda o: dates.is_open_at(o["date"], o["start_time"], o["end_time"], day(f.open_at[0]), F.lit(f.open_at[1]))))
    if f.categories:
        keep.append(F.col("category").isin(f.categories))
    if f.goods:
        keep.append(F.arrays_overlap("goods", F.array(*[F.lit(g) for g in f.goods])))
    for on, test in ((f.free, F.col("is_free")), (f.family, F.col("family_friendly")), (f.accessible, F.col("accessible")), (f.large, T.parse_stall_count(F.col("stall_count_text")) >= 15), (f.verified, (F.col("confidence") >= 0.45) & (F.col("source_count") >= 2))):
        if on:
            keep.append(test)
    if f.place:
        keep.append(F.col("indoor_outdoor").isin(f.place, "mixed"))
    if f.query.strip():
        keep.append(T.let(haystack(*columns), lambda hay: matches_query(hay, fold_query(f.query))))
    if f.position and f.radius_km is not None:
        keep.append(F.col("km") <= f.radius_km)
    for test in keep:
        rows = rows.where(test)
    return rows


def explore_order(f: Filters) -> list[Column]:
    """Sort keys: nearest first with a position, the sooner end with open-now, else by day, fewer days, confidence; the key last."""
    few = F.size("occ")
    if f.open_at:
        end = F.array_max(F.filter(F.transform("occ", lambda o: F.when(o["date"] == day(f.open_at[0]), o["end_time"])), lambda e: e.isNotNull()))
        return [end.asc_nulls_last(), F.col("next_date"), few, F.desc("confidence"), F.col("k")]
    if f.position:
        return [F.col("km").asc_nulls_last(), F.col("next_date"), few, F.col("k")]
    return [F.col("next_date"), few, F.desc("confidence"), F.col("k")]


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """The rows with their place (from 1) in an order over all of them, by ranges of it: no task holds more than its range."""
    part = f"{name}_part"
    dealt = cut(rows.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy(part).agg(F.count("*").alias("n"))  # one row a range
    before = sizes.select(part, (F.sum("n").over(Window.orderBy(part)) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy(part).orderBy(*order))
    return dealt.withColumn(name, own.cast("long")).join(F.broadcast(before), part).withColumn(name, F.col(name) + F.col("before")).drop(part, "before")


def fallback_suggestions(rows: DataFrame, f: Filters, today: str, most: int = 3) -> DataFrame:
    """When a filter state shows nothing: the same facets over 45 days and without the radius, the first ``most``."""
    # Both states have these facets, so the listings are read once.
    facets = Filters(**{**f.__dict__, "radius_km": None, "first": "0001-01-01", "last": "9999-12-31", "query": "", "open_at": None})
    rows = cut(explore(rows, facets, today).drop("next_date", "km"), "faceted")
    shown = explore(rows, f, today).limit(1).agg(F.count("*").alias("shown"))
    wider = Filters(**{**f.__dict__, "radius_km": None, "first": today, "last": "2026-08-17", "open_at": None})
    found = explore(rows, wider, today, ("title", "venue_name", "city", "search_text"))
    # The guard is one row: a flag, not data.
    return found.join(F.broadcast(shown.where("shown = 0")), F.lit(True)).drop("shown").orderBy("next_date", F.desc("confidence"), "k").limit(most)


def recommend(rows: DataFrame, today: str, position: tuple[float, float], saved: Column, days: int = 21, most: int = 4) -> DataFrame:
    """The best next days by score, with reasons."""
    last = F.date_add(day(today), days)
    near = with_distance(rows.withColumn("next_date", F.array_min(F.filter(F.transform("occ", lambda o: o["date"]), lambda x: x.between(day(today), last)))), position).where("next_date is not null")
    free = F.coalesce(F.col("is_free"), F.lit(False))
    score = scores.recommend_score(F.col("confidence"), F.col("km"), F.datediff("next_date", day(today)), F.col("gem"), saved, F.col("family_friendly"), free)
    reasons = scores.recommend_reasons(dates.timing_label(day(today), F.col("next_date")), F.col("confidence"), F.col("km"), F.col("gem"), saved, F.col("family_friendly"), free, T.parse_stall_count(F.col("stall_count_text")))
    return near.select("k", "next_date", F.round(score, 6).alias("score"), reasons.alias("reasons")).orderBy(F.desc("score"), "next_date", "k").limit(most)


def nearest(left: DataFrame, right: DataFrame, k: int, km: float, north: float = 58.0, widen: float = 4.0, rounds: int = 4) -> DataFrame:
    """(id, other, km, rank): the k nearest rows of ``right`` inside the radius, the smaller id first among equally near ones.

    Both have id, lat, lng, and lie south of the latitude ``north``; rows without a place have no neighbours and are none.
    Places are compared and not rows: a place stands for its k + 1 smallest ids, so many rows at one place cost no pairs.
    The radius grows by ``widen`` up to ``km``, and only places that have fewer than k + 1 ids within one go on to the next.
    """
    held = k + 1
    ids = right.where("lat is not null and lng is not null").select(F.col("lat").alias("lat2"), F.col("lng").alias("lng2"), F.col("id").alias("other"))
    ids = cap_per_group(ids.where("other is not null").distinct(), ["lat2", "lng2"], ["other"], held)
    points = cut(ids.groupBy("lat2", "lng2").agg(F.array_sort(F.collect_list("other")).alias("others")), "points")
    rows = left.where("lat is not null and lng is not null").select("id", "lat", "lng")
    short, found = rows.select("lat", "lng").distinct(), []
    for i in reversed(range(rounds)):
        told = cut(_nearest_ids(short, points, held, km / widen**i, north), "near")
        settled = told.where(F.size("near") >= held) if i else told
        found.append(settled)
        short = short.join(settled.select("lat", "lng"), ["lat", "lng"], "left_anti")
    lists = found[0]
    for more in found[1:]:
        lists = lists.unionByName(more)
    own = rows.join(lists, ["lat", "lng"])
    others = F.slice(F.filter("near", lambda x: x["other"] != F.col("id")), 1, k)
    return own.select("id", F.posexplode(others).alias("rank", "n")).select("id", "n.other", "n.km", (F.col("rank") + 1).alias("rank"))


def _nearest_ids(short: DataFrame, points: DataFrame, held: int, km: float, north: float) -> DataFrame:
    """(lat, lng, near): the ``held`` nearest (km, other) of each place within the radius, by cells as wide as the radius at ``north``."""
    lat_step = km / 111.0  # a degree is 111.19 km
    lng_step = lat_step / math.cos(math.radians(min(north + lat_step, 89.0)))
    one = short.select("lat", "lng", geo.cell(F.col("lat"), lat_step).alias("y"), geo.cell(F.col("lng"), lng_step).alias("x"))
    two = points.select("*", F.explode(geo.near_cells(F.col("lat2"), lat_step)).alias("y")).select("*", F.explode(geo.near_cells(F.col("lng2"), lng_step)).alias("x"))
    both = one.join(two, ["y", "x"]).withColumn("km", F.round(geo.distance_km(F.col("lat"), F.col("lng"), F.col("lat2"), F.col("lng2")), 6)).where(F.col("km") <= km)
    # The first ``held`` ids are among those of the first ``held`` places by distance and smallest id.
    near = cap_per_group(both, ["lat", "lng"], ["km", F.element_at("others", 1)], held)
    listed = F.flatten(F.collect_list(F.transform("others", lambda o: F.struct(F.col("km").alias("km"), o.alias("other")))))
    return near.groupBy("lat", "lng").agg(F.slice(F.array_sort(listed), 1, held).alias("near"))


def city_centroids(rows: DataFrame) -> DataFrame:
    """(slug, city, n, lat, lng) of each city slug."""
    return rows.withColumn("slug", T.slugify_city(F.col("city"))).where("slug <> ''").groupBy("slug").agg(F.min("city").alias("city"), F.count("*").alias("n"), F.avg("lat").alias("lat"), F.avg("lng").alias("lng"))


def route_length(trips: DataFrame, start: tuple[float, float] | None = None) -> DataFrame:
    """(trip_id, km): from the start, if there is one, through the stops in order."""
    order = Window.partitionBy("trip_id").orderBy("pos")
    lat, lng = F.lag("lat").over(order), F.lag("lng").over(order)
    if start:
        lat, lng = F.coalesce(lat, F.lit(start[0])), F.coalesce(lng, F.lit(start[1]))
    legs = trips.withColumn("leg", F.coalesce(geo.distance_km(lat, lng, F.col("lat"), F.col("lng")), F.lit(0.0)))
    return legs.groupBy("trip_id").agg(F.round(F.sum("leg"), 3).alias("km"))


def order_trips(trips: DataFrame, start: tuple[float, float]) -> DataFrame:
    """(trip_id, stops): nearest next stop first from the start; trips have ten stops at most."""
    held = trips.groupBy("trip_id").agg(F.array_sort(F.collect_list(F.struct("pos", "event_id", "lat", "lng"))).alias("left"))
    kind = "struct<left:array<struct<pos:int,event_id:bigint,lat:double,lng:double>>,lat:double,lng:double,done:array<bigint>>"
    held = held.withColumn("left", F.col("left").cast("array<struct<pos:int,event_id:bigint,lat:double,lng:double>>"))
    begin = F.struct(F.col("left").alias("left"), F.lit(start[0]).alias("lat"), F.lit(start[1]).alias("lng"), F.array().cast("array<bigint>").alias("done")).cast(kind)

    def step(a: Column, _: Column) -> Column:
        next_ = F.array_min(F.transform(a["left"], lambda s: F.struct(geo.distance_km(a["lat"], a["lng"], s["lat"], s["lng"]).alias("d"), s["pos"].alias("pos"), s.alias("stop"))))
        return dates.let(next_, lambda n: F.struct(
            F.filter(a["left"], lambda s: s["pos"] != n["pos"]).alias("left"), n["stop"]["lat"].alias("lat"), n["stop"]["lng"].alias("lng"), F.concat(a["done"], F.array(n["stop"]["event_id"])).alias("done")))

    return held.select("trip_id", F.aggregate("left", begin, step)["done"].alias("stops"))


def date_page(listings: DataFrame, occurrences: DataFrame, first: str, last: str) -> DataFrame:
    """Listings with a day in the window and their first one (``date``), in order of it."""
    days = occurrences.where(F.col("date").between(day(first), day(last))).groupBy(F.col("event_id").alias("k")).agg(F.min("date").alias("date"))
    return listings.join(days, "k").orderBy("date", "title", "k")


def with_date_between(listings: DataFrame, occurrences: DataFrame, first: str, last: str, state: Column) -> DataFrame:
    """Listings in a state (cancelled, vanished) that have a day in the window, once each."""
    days = occurrences.where(F.col("date").between(day(first), day(last))).select(F.col("event_id").alias("k"))
    return listings.where(state).join(days, "k", "left_semi")


def event_detail(listings: DataFrame, occurrences: DataFrame, event: str = "m") -> DataFrame:
    """(event, sources, days): each source with its latest sighting, and how many days; events without a day are left out."""
    seen = listings.groupBy(event, "source_key").agg(F.max("last_seen").alias("seen"))
    told = F.array_sort(F.collect_list(F.concat("source_key", F.lit("@"), F.col("seen").cast("string"))))
    sources = seen.groupBy(event).agg(F.array_join(told, ",").alias("sources"))
    days = occurrences.join(listings.select(F.col("k").alias("event_id"), event), "event_id").groupBy(event).agg(F.count_distinct("date").alias("days"))
    return sources.join(days, event)


def cap_per_group(rows: DataFrame, group: str | list[str], order: list[Column | str], most: int) -> DataFrame:
    """The first ``most`` rows of each group by ``order``, and their number ``n`` (Spark drops later rows before the shuffle)."""
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("n") <= most)


def venues_for_city(venues: DataFrame, most: int = 60) -> DataFrame:
    """Of each city the first venues: flea shops, rental shelves, antiques, the rest; by title within."""
    rank = F.when(F.col("category") == "loppebutik", 0).when(F.col("category") == "reolmarked", 1).when(F.col("category") == "antik", 2).otherwise(9)
    return cap_per_group(venues, "city", [rank, "title", "source_id"], most).drop("n")


def list_venues(venues: DataFrame, kind: str | None = None, category: str | None = None) -> DataFrame:
    for column, value in (("source_type", kind), ("category", category)):
        venues = venues if value is None else venues.where(F.col(column) == value)
    return venues.orderBy("category", "title", "source_id")


def first_date_in_window(occurrences: DataFrame, first: Column, last: Column) -> DataFrame:
    """(event_id, first): the first day of each listing in the window; those without one are left out."""
    return occurrences.where(F.col("date").between(first, last)).groupBy("event_id").agg(F.min("date").alias("first"))


def periods_to_occurrences(periods: DataFrame, key: str, start: Column, end: Column, today: Column, each: int = 30, most: int = 60) -> DataFrame:
    """(key, date): distinct days from today on of each key's periods, ``each`` days of a period and ``most`` of a key.

    The days are rows, not one array a key, so a key may have any number of periods.
    """
    days = periods.select(key, F.explode(dates.expand_span(start, end, each)).alias("date")).where(F.col("date") >= today).distinct()
    return cap_per_group(days, key, ["date"], most).drop("n")


def pick_trip_day(stops: DataFrame, occurrences: DataFrame, today: Column, least: int = 2) -> DataFrame:
    """(trip_id, day): the earliest day from today on when at least ``least`` stops of a trip are open."""
    days = stops.select("trip_id", "event_id").join(occurrences.where(F.col("date") >= today).select("event_id", "date"), "event_id")
    many = days.groupBy("trip_id", "date").agg(F.count_distinct("event_id").alias("n")).where(F.col("n") >= least)
    return many.groupBy("trip_id").agg(F.min("date").alias("day"))


def auto_plan(occurrences: DataFrame, listings: DataFrame, position: tuple[float, float], most: int = 10) -> DataFrame:
    """(date, event_id, n): of each day with two listings or more the nearest ones, in order of distance."""
    days = occurrences.select("date", "event_id").distinct().join(listings.select(F.col("k").alias("event_id"), "lat", "lng"), "event_id")
    many = days.groupBy("date").agg(F.count("*").alias("t")).where("t >= 2").select("date")
    near = with_distance(days, position).withColumn("km", F.round("km", 6))
    return cap_per_group(near, "date", ["km", "event_id"], most).join(many, "date", "left_semi").select("date", "event_id", "n")


def trip_geometry(trips: DataFrame) -> DataFrame:
    """(trip_id, points, line): the stops in order, ids joined by dashes; a trip of one stop has no line. Trips have ten stops at most."""
    held = trips.groupBy("trip_id").agg(F.array_sort(F.collect_list(F.struct("pos", "event_id"))).alias("stops")).where(F.size("stops") >= 2)
    return held.select("trip_id", F.size("stops").cast("long").alias("points"), F.array_join(F.transform("stops", lambda x: x["event_id"].cast("string")), "-").alias("line"))


# The windows that a shared link may name.
LINK_WINDOWS = ["all", "today", "tomorrow", "weekend", "next-weekend"]


def saved_filter_parse(rows: DataFrame, key: str, link: Column) -> DataFrame:
    """(key, dates, free, place, map, stops) of query strings; unknown values fall back to the defaults, stops are ten valid ids at most."""
    parts = rows.select(key, F.str_to_map(link, F.lit("&"), F.lit("=")).alias("p"))
    get = lambda n: F.try_element_at(F.col("p"), F.lit(n))
    yes = lambda n, v: F.coalesce(get(n) == v, F.lit(False))
    stops = F.slice(F.filter(F.split(F.coalesce(get("tur"), F.lit("")), ","), lambda t: t.rlike("^[ev]:[a-z0-9-]+$")), 1, 10)
    place = F.when(get("inde") == "1", "indoor").when(get("ude") == "1", "outdoor")
    return parts.select(key, F.when(get("dato").isin(LINK_WINDOWS), get("dato")).otherwise("weekend").alias("dates"), yes("gratis", "1").alias("free"), place.alias("place"), yes("visning", "kort").alias("map"), stops.alias("stops"))
