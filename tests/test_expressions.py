"""Tables of inputs and expected readings, with null, empty and boundary rows."""

import datetime

import pytest
from pyspark.sql import functions as F

from localmarkets.functions import dates as D
from localmarkets.functions import facts as X
from localmarkets.functions import geo, scores
from localmarkets.functions import text as T
from localmarkets.operators.joins import read_once
from localmarkets.sources import feeds


def read(spark, expression, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in df.select("i", expression(F.col("v")).alias("o")).orderBy("i").collect()]


@pytest.mark.parametrize(
    ("expression", "cases"),
    [
        (T.normalize_title, {None: None, "": "", "  Ærø  LOPPE-marked!! ": "aeroe loppe marked", "Å": "aa"}),
        (T.title_signals_cancelled, {None: False, "AFLYST: marked": True, "Aflyses ikke": False, "Genaflyst": False}),
        (T.strip_date_tokens, {None: None, "Loppemarked lørdag d. 4. juli 2026": "Loppemarked", "3. sæson": "3. sæson", "d. 5. juli": "d. 5. juli"}),
        (T.clean_venue_name, {None: None, " ": None, "På adressen": None, "Hal  B": "Hal B", "Kør frem. Drej så": None, "x" * 81: None}),
        (T.clean_street, {None: None, "Hele byen.": None, " Torvet ": "Torvet"}),
        (T.normalize_category, {None: "andet", "Tohjulede cykler": "andet", "Julekræmmermarked": "julemarked", "loppe": "loppemarked"}),
        (T.infer_indoor_outdoor, {None: "unknown", "uden for hallen": "indoor", "i det fri": "outdoor", "inden søndag": "unknown"}),
        (T.infer_is_free, {None: None, "gratis parkering": None, "gratis entré": True, "voksne 30 kr": False, "gratis adgang, voksne 20 kr": None}),
        (T.extract_stall_count_text, {None: None, "over 150 stader": "150 stader", "50-60 Boder": "50–60 boder", "2 boder": None, "50 pladser": None}),
        (T.extract_postcode, {None: None, "": None, "kl. 12345": None, "0999 x": None, "5000 Odense": "5000"}),
        (T.normalize_phone, {None: None, "20 30 40 50": "4520304050", "+4520304050": "4520304050", "12345678": None, "10203040": None, "22222222": None}),
        (T.normalize_domain, {None: None, "": None, "https://www.A-b.dk/x?y": "a-b.dk", "localhost": None, "ftp://user@c.dk:8": "c.dk"}),
        (T.base_label, {None: None, "Odense C": "Odense", "C": "C", "Hårlev": "Hårlev"}),
        (T.truncate_at_word, {None: None, "kort": "kort", "a" * 200: "a" * 154 + "…"}),
        (D.describe_recurrence, {None: None, "": None, "hver anden søndag": None, "hver lørdag og søndag": "Hver lørdag og søndag", "4. søndag i måneden": "Fjerde søndag i måneden"}),
    ],
)
def test_readings(spark, expression, cases):
    assert read(spark, expression, list(cases)) == list(cases.values())


def test_dates(spark):
    given = ["30-02-2026", "29.02.2028", "Lørdag den 5. juli 2026", "5/7 2026", "", None]
    assert read(spark, D.parse_danish_date, given) == [None, datetime.date(2028, 2, 29), datetime.date(2026, 7, 5), datetime.date(2026, 7, 5), None, None]


def test_schedule_stays_in_season(spark):
    day = lambda s: F.lit(s).cast("date")
    df = spark.range(1).select(D.resolve_schedule(day("2026-07-01"), day("2026-07-20"), F.lit("hver søndag"), F.lit("Søndag 10-12"), day("2026-07-03"), 180).alias("o"))
    assert [(str(o["date"]), o["start_time"]) for o in df.first().o] == [("2026-07-05", "10:00"), ("2026-07-12", "10:00"), ("2026-07-19", "10:00"), ("2026-07-20", None)]


def test_facets(spark):
    told = read(spark, lambda c: X.facet(F.lower(c), X.FACETS["parking"]), ["Ingen parkering. Men parkering ved hallen", "P-plads findes ikke", "parkering", "", None, "der er ikke langt til byen og til vores parkering"])
    assert told == [True, False, True, None, None, True]


def test_week_hours_roundtrip(spark):
    given = ["Mo-Fr 10:00-17:30; We off", "Mo-Su 09:00-12:00,13:00-18:00", "Fr-Mo 10:00-00:00"]
    assert read(spark, lambda c: D.to_week_string(D.parse_week_hours(c)), given) == ["Mo-Tu 10:00-17:30; Th-Fr 10:00-17:30", "Mo-Su 09:00-12:00,13:00-18:00", "Mo 10:00-24:00; Fr-Su 10:00-24:00"]


def test_confidence_gates(spark):
    lit = F.lit
    row = spark.range(1).select(
        scores.event_confidence(lit(0.4), lit(1), lit(0), lit(True), lit(True), lit(0)).alias("lone"), scores.event_confidence(lit(0.4), lit(1), lit(0), lit(True), lit(True), lit(3)).alias("crowd"),
        scores.event_confidence(lit(0.7), lit(2), lit(0), lit(True), lit(True), lit(0)).alias("two"), scores.event_confidence(lit(0.7), lit(1), lit(500), lit(False), lit(False), lit(0)).alias("old"),
    ).first()
    assert tuple(row) == (0.44, 0.6, 0.85, 0.35)


def test_blur_moves_points(spark):
    row = spark.range(1).select(geo.blur(F.lit(55.6761), F.lit(12.5683)).alias("p")).first().p
    assert row.lat == 55.68 and row.lng != 12.5683


def test_pages_with_many_objects(spark):
    page = "".join(f'{{"id":{i},"slug":"s{i}","title":"t"}} junk ' for i in range(1500))
    events = '{"@type":"Event","startDate":"2026-08-01"} ' * 30 + '{"@type":"Event","name":"Marked","startDate":"2026-08-02"}'
    pages = spark.createDataFrame([(1, page), (2, "none"), (3, None), (4, events)], "page_id long, html string")
    rows = {r.page_id: r.o for r in pages.select("page_id", feeds.embedded_objects(F.col("html")).alias("o")).collect()}
    assert [o.id for o in rows[1]] == list(range(1500)) and not rows[2] and not rows[3]
    assert [(r.page_id, r.name, str(r.start)) for r in feeds.json_ld_events(pages).collect()] == [(4, "Marked", "2026-08-02")]


def test_house_numbers_of_four_figures(spark):
    cases = {"Vej 1001, 2001 By, Danmark": "2001", "Vej 1001, By": None, "Torvet 1 5000 Odense": "5000", "Hal 2, 5000 Odense C, Fyn": "5000", "Torvet 1 5000 Odense, Fyn": "5000"}
    rows = spark.createDataFrame([(a,) for a in cases], "a string").select("a", T.parse_address(F.col("a")).alias("p")).collect()
    assert {r.a: r.p.postcode for r in rows} == cases and rows[0].p.street == "Vej 1001" and rows[0].p.city == "By"


def test_telephones_are_no_towns(spark):
    cases = {"Ring +1 (848) 555-1373 Un. Torvet 1, 5000 Odense C": "5000 Odense", "20.30.4050 Anna": None, "DK-5000 Odense": "5000 Odense", "1-5000 Odense": None}
    rows = spark.createDataFrame([(a,) for a in cases], "a string").select("a", T.extract_postal_town(F.col("a")).alias("t")).collect()
    assert {r.a: r.t for r in rows} == cases


def test_texts_are_read_once(spark):
    texts = ["Mo-Fr 10:00-17:30", "nonsense", "", None]
    rows = spark.range(400).select("id", F.element_at(F.array(*[F.lit(t) for t in texts]), (F.col("id") % 4 + 1).cast("int")).alias("hours"))
    once = read_once(rows, "hours", week=D.to_week_string(D.parse_week_hours(F.col("__text"))))
    want = rows.select("id", "hours", D.to_week_string(D.parse_week_hours(F.col("hours"))).alias("week"))
    assert once.columns == want.columns and sorted(once.collect(), key=lambda r: r.id) == sorted(want.collect(), key=lambda r: r.id)
    assert "regexp" not in once._jdf.queryExecution().optimizedPlan().toString().lower()
