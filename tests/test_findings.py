"""What the findings of round 3 named: work by row that is done once."""

from pyspark.sql import functions as F

from localmarkets.functions import text as T
from localmarkets.operators import listing as Q
from localmarkets.operators import places as S
from localmarkets.operators import postings as X
from localmarkets.operators import resolve as R
from localmarkets.plans.registry import QUERIES
from localmarkets.sources import feeds
from localmarkets.sources import publish as P


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_domains_are_mined_without_a_join_of_listings(spark, sf):
    rows = [
        (1, "Marked A", "s1", "https://a.example.com/x", "se www.a.example.com/y og http://b.example.com"), (2, "Marked A", "s1", "https://a.example.com/x", "se www.a.example.com/y og http://b.example.com"),
        (3, "Marked B", "s2", None, "HTTP://B.example.com/z"), (4, None, "s2", "b.example.com", None), (5, "Marked C", "s3", None, None), (6, "Marked D", "s3", "https://own.example.com", None),
    ]
    raws = spark.createDataFrame(rows, "k long, title string, source_key string, contact_website string, description string")
    found = feeds.mine_domains(raws, ["own.example.com"], spark.createDataFrame([("marked a",)], "title string"))
    assert sorted(map(tuple, found.select("domain", "mentions", "titles", "covered", "sources").collect())) == [("a.example.com", 2, 1, 1, 1), ("b.example.com", 4, 2, 1, 2)]
    assert found._jdf.queryExecution().analyzed().toString().count("Join") == 1
    assert "Aggregate" not in optimized(QUERIES["A3_mine_domains"](spark, sf))


def test_schedules_are_resolved_once(spark, sf):
    assert "regexp" not in optimized(QUERIES["D7_resolve_schedule"](spark, sf)).lower()


def test_a_text_filter_folds_a_listing_once(spark):
    names = [*Q.TEXT_COLUMNS, "km"]
    rows = spark.range(3).select(F.col("id").alias("k"), *[F.lit("Vinyl på Torvet").alias(n) for n in names], F.array(F.struct(F.lit("2026-07-04").cast("date").alias("date"))).alias("occ"))
    shown = Q.explore(rows, Q.Filters(query="vinil torvet marked"), "2026-07-03")
    assert shown._jdf.queryExecution().analyzed().toString().count("concat_ws") == 1
    assert shown.count() == 0 and Q.explore(rows, Q.Filters(query="vinil torvet"), "2026-07-03").count() == 3


def test_fallback_reads_listings_once(spark, sf):
    assert "event_id" not in optimized(QUERIES["Q6_fallback_suggestions"](spark, sf))


def test_titles_for_display_are_cleaned_once(spark):
    cases = {"østers (kun for private)": "Østers", "STORT MARKED": "Stort marked", "éclair": "éclair", "ABC": "ABC", "x": "X", "": "", None: None, "æ 16. sæson": "æ 16. sæson".replace("æ", "Æ", 1)}
    rows = spark.createDataFrame([(a,) for a in cases], "a string").select("a", T.display_title(F.col("a")).alias("t"))
    assert {r.a: r.t for r in rows.collect()} == cases
    assert rows._jdf.queryExecution().analyzed().toString().count("regexp_replace") <= 8


def test_lines_of_a_market_are_made_once(spark):
    schema = "k long, slug string, title string, venue_name string, street string, postcode string, city string, lat double, lng double, status string"
    events = spark.createDataFrame([(1, "a", "A; b", "", None, "1000", " By ", 55.5, 12.0, None), (2, "b", None, None, "Vej 1", None, None, None, None, None), (3, "c", "C", "", "", "", "By", 1.0, 2.0, "cancelled")], schema)
    days = spark.createDataFrame([(1, "2026-07-05", "10:00", "09:00"), (1, "2026-07-04", None, None), (2, "2026-07-04", "10:00", "12:00"), (3, "2026-07-04", None, None)], "event_id long, date string, start_time string, end_time string").withColumn("date", F.to_date("date"))
    today = F.lit("2026-07-03").cast("date")
    own = P.event_calendars(events, days, today, "h", "b", "S", "P")
    texts = {r.event_id: r.text.split("\r\n") for r in own.collect()}
    assert texts[2][3:-1] == ["BEGIN:VEVENT", "UID:b-2026-07-04@h", "DTSTAMP:S", "DTSTART;TZID=Europe/Copenhagen:20260704T100000", "DTEND;TZID=Europe/Copenhagen:20260704T120000", "LOCATION:Vej 1", "URL:b/marked/b", "END:VEVENT"]
    assert texts[1][3:11] == ["BEGIN:VEVENT", "UID:a-2026-07-04@h", "DTSTAMP:S", "DTSTART;VALUE=DATE:20260704", "SUMMARY:A\\; b", "LOCATION:1000  By ", "GEO:55.5;12", "URL:b/marked/a"]
    city = P.city_calendars(events, days, today, "h", "b", "S", "P")
    assert sorted((r.city_slug, r.part, str(r.first), r.n) for r in city.collect()) == [("by", 0, "None", None), ("by", 1, "2026-07-04", 1), ("by", 1, "2026-07-04", 2), ("by", 2, "None", None)]
    assert "regexp_replace" not in own._jdf.queryExecution().analyzed().toString().split("Join")[0]


def test_words_of_an_index_are_made_once(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def own(text):
        read.add(1)
        return text.split()

    docs = spark.createDataFrame([(1, "a b a"), (2, "b"), (3, "")], "id long, text string")
    made = X.build_index(docs, "id", own.asNondeterministic()("text"), str(tmp_path / "index"))
    assert read.value == 3
    assert sorted(map(tuple, made.postings().collect())) == [("a", 1, 2, 3), ("b", 1, 1, 3), ("b", 2, 1, 1)]
    assert tuple(made.totals().first()) == (3, 4 / 3)


def test_occurrences_are_read_once(spark):
    rows = spark.createDataFrame([(1, 1, 0.3, "a", "10", "11"), (1, 2, 0.6, "b", None, None), (1, 3, 0.4, "b", "09", None), (2, 4, 0.3, "a", None, None), (2, 5, 0.2, "b", "1", "2"), (None, 6, 0.9, "a", "1", "2")], "cluster long, k long, trust double, date string, start_time string, end_time string")
    days = R.merge_occurrences(rows)
    assert sorted(map(tuple, days.collect())) == [(1, "b", "09", None, 0.6), (2, "a", None, None, 0.3)]
    assert "Join" not in optimized(days)


def drawn_listings(spark, n):
    """Listings that repeat titles, points, postcodes and days, or lack them."""
    day = F.to_date(F.lit("2026-07-05"))
    some = lambda i, m, v: F.when(F.pmod(F.hash("id", F.lit(i)), F.lit(m)) != 0, v)
    of = lambda i, *v: F.element_at(F.array(*[F.lit(x) for x in v]), F.pmod(F.hash("id", F.lit(i)), F.lit(len(v))) + 1)
    rows = spark.range(n).select(
        F.col("id").alias("k"), some(1, 9, of(2, "Broens Lopper i Odense", "broens lopper i odense", "Havnens marked Faaborg", "Loppemarked", "!")).alias("title"), some(3, 3, of(4, "Vej 1", "Vej 12", "")).alias("street"),
        F.lit("Odense").alias("city"), some(5, 3, of(6, "5000", "5600")).alias("postcode"), some(7, 5, of(8, 55.0, 55.004, 55.02)).alias("lat"), some(9, 5, of(10, 10.0, 10.015, 10.1)).alias("lng"), some(11, 6, of(12, "A", "P")).alias("geocode_quality"),
        some(13, 5, of(14, "loppemarked", "loppemarked", "julemarked")).alias("category"), some(15, 6, F.when(F.col("id") % 2 == 0, F.array(day)).otherwise(F.array(F.date_add(day, 7), day))).alias("dates"),
    )
    return R.prepared_table(rows)


def test_listings_of_one_block_meet_as_sets(spark):
    rows = drawn_listings(spark, 300)
    left, right = R._sides(rows)
    plain = R.located_pairs(left, right, F.col("a_k") < F.col("b_k")).select(F.least("a_k", "b_k").alias("a"), F.greatest("a_k", "b_k").alias("b")).unionByName(R.found_pairs(rows))
    for tile in (R.TILE, 50):
        assert sorted(map(tuple, R.candidate_pairs(rows, tile).collect())) == sorted(map(tuple, plain.collect()))
    same = rows.where("k = 0").drop("k", "postcode", "title_key").withColumns({"k": F.explode(F.sequence(F.lit(0), F.lit(299)).cast("array<long>")), "postcode": F.lit("5000"), "title_key": F.lit("x"), "lat": F.lit(55.0), "lng": F.lit(10.0)})
    for met in (R.coded_sets(same, [], ["k"]), R.placed_sets(same, [])):
        assert met.count() <= 6
    assert R.each(R.coded_sets(same, [], ["k"])).count() == 300 * 299 // 2


def test_sets_are_judged_as_their_listings(spark):
    rows = drawn_listings(spark, 120)
    left, right = R._sides(rows.select(R.RULED))
    plain = R.judged(R.located_pairs(left, right, F.col("a_k") < F.col("b_k"))).unionByName(R.match_pairs(rows, R.found_pairs(rows))).withColumn("similarity", F.round("similarity", 6))
    told = R.matches(rows)
    assert sorted(map(tuple, told.select(plain.columns).collect())) == sorted(map(tuple, plain.collect()))
    # Titles are compared for sets, below what tells their members.
    plan = told._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("explode(b_members") < plan.index("array_intersect")


def test_places_are_judged_where_they_meet(spark):
    of = lambda i, *v: F.element_at(F.array(*[F.lit(x) for x in v]), F.pmod(F.hash("id", F.lit(i)), F.lit(len(v))) + 1)
    places = spark.range(120).select(
        "id", of(1, "20300001", "20300002", None, None).alias("phone"), of(2, "facebook.com/a", "facebook.com/b", None, None).alias("profile_url"), of(3, "Vej 1", "Gade 9", None).alias("street"), of(4, "Odense", None).alias("city"),
        of(5, 55.0, 55.0005, 55.009, None).alias("lat"), of(6, 10.0, 10.001, None).alias("lng"), of(7, "Kirkens hus", "Ørbæk loppe", None).alias("name"), of(8, "Jens", "Ole", None, None).alias("contact_name"), of(9, "Hver weekend", None).alias("pattern"), of(10, "lade", "garage", None).alias("place_type"),
    )
    rows = S._keyed(places)
    a, b = (rows.select([F.col(n).alias(f"{p}_{n}") for n in rows.columns]) for p in "ab")
    plain = a.crossJoin(b).where("a_id < b_id").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), *[e.alias(n) for n, e in S.match_score().items()]).where("verdict <> 'distinct'")
    for tile in (R.TILE, 20):
        found = S.place_pairs(places, tile)
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.collect()))
    # No pair is made distinct or sent to another task after it was met.
    assert optimized(found).count("explode(a_members") == 1 and "Aggregate [a#" not in optimized(found)
