"""Resolution: what may merge and what may not; running again changes nothing."""

import datetime
import random

import pytest

from localmarkets.operators import canonical as C
from localmarkets.operators import lifecycle as L
from localmarkets.operators import places as P
from localmarkets.operators import resolve as R
from localmarkets.operators.components import connected_components
from localmarkets.views import view

SCHEMA = "k long, title string, street string, city string, postcode string, lat double, lng double, geocode_quality string, category string, dates array<date>"
D1, D2 = datetime.date(2026, 7, 5), datetime.date(2026, 7, 12)


def reasons(spark, a, b):
    base = {"street": None, "city": None, "postcode": None, "lat": None, "lng": None, "geocode_quality": "A", "category": "loppemarked", "dates": [D1]}
    rows = R.prepared(spark.createDataFrame([{"k": i, **base, **x} for i, x in enumerate((a, b))], SCHEMA))
    pairs = spark.createDataFrame([(0, 1)], "a long, b long")
    r = R.match_pairs(rows, pairs).first()
    return r.is_match, r.forward


@pytest.mark.parametrize(
    ("a", "b", "match"),
    [
        ({"title": "Broens Lopper", "lat": 55.6799, "lng": 12.5988}, {"title": "Broens lopper lørdag d. 5. juli", "lat": 55.68, "lng": 12.599}, True),
        ({"title": "Loppemarked"}, {"title": "Loppemarked", "dates": [D2]}, False),
        ({"title": "Fredensborg Kokkedal Loppemarked"}, {"title": "Fredensborg Kokkedal Loppemarked", "dates": [D2]}, True),
        ({"title": "Ørbæk Marked", "lat": 55.0, "lng": 10.0}, {"title": "Ørbæk Marked", "lat": 56.0, "lng": 11.0}, False),
        ({"title": "Torvets marked i Odense", "category": "julemarked"}, {"title": "Torvets marked i Odense", "category": "andet"}, False),
        ({"title": "Garagesalg på vejen", "street": "Vej 1", "postcode": "5000"}, {"title": "Garagesalg på gaden", "street": "Gade 9", "postcode": "5000"}, False),
        ({"title": "Havnens marked Faaborg", "postcode": "5600"}, {"title": "Faaborg havnens marked", "postcode": "5600"}, True),
    ],
)
def test_rules(spark, a, b, match):
    assert reasons(spark, a, b)[0] is match


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (2, 1), (9, 8), (7, 7), (10, None)], "u long, v long")
    assert {(r.node, r.component) for r in connected_components(edges).collect()} == {(5, 1), (4, 1), (3, 1), (2, 1), (1, 1), (9, 8), (8, 8)}
    assert connected_components(edges.limit(0)).count() == 0


def test_upsert_twice_changes_nothing(spark):
    rows = spark.createDataFrame([("a", 1, "x", D1), ("a", 2, None, D1)], "s string, k long, payload string, last_seen date")
    once = L.upsert_raw(rows.limit(0), rows, ["s", "k"])
    assert {r.change for r in once.collect()} == {"new"}
    assert {r.change for r in L.upsert_raw(once, rows, ["s", "k"]).collect()} == {"unchanged"}


def test_nothing_leaks(spark, sf):
    places = view(spark, sf, "v_places")
    assert P.visibility_leaks(places, P.public_view(places)).count() == 0
    assert P.publish(places).count() == P.public_view(places).count()


def test_status_and_slugs_go_on(spark):
    members = spark.createDataFrame(
        [
            (1, 10, 0.3, True, False, "active", None), (2, 10, 0.7, False, False, "active", "ten"),  # a weak source can't call off
            (3, 11, 0.3, True, False, "active", "b"), (4, 11, 0.3, False, False, "active", "a"),  # it can what it dominates; the first of equals names it
            (5, 12, 0.7, False, False, "cancelled", "c"), (6, 13, 0.7, False, True, "cancelled", "d"),  # taken back only with a change
            (7, 14, 0.4, False, True, "cancelled", "e"), (8, 14, 0.7, False, False, "cancelled", None),  # and by a best source
            (9, 15, 0.6, False, False, "expired", None), (20, 16, 0.5, True, False, None, None), (21, 16, 0.9, False, True, None, None),
        ],
        "k long, cluster long, trust double, called_off boolean, changed boolean, status string, slug string",
    )
    assert {r.cluster: r.status for r in C.merge_status(members).collect()} == {10: "active", 11: "cancelled", 12: "cancelled", 13: "active", 14: "cancelled", 15: "active", 16: "cancelled"}
    assert {r.cluster: r.hint for r in C.kept_slugs(members).collect()} == {10: "ten", 11: "b", 12: "c", 13: "d", 14: "e", 15: None, 16: None}


@pytest.mark.parametrize("seed", [1])
def test_links_lead_where_all_matches_do(spark, seed):
    draw = random.Random(seed)
    titles = ["Broens Lopper", "Broens lopper i Odense", "Havnens marked Faaborg", "Faaborg havnens marked", "Loppemarked", "LOPPEMARKED", "Byens store loppemarked", "Julemarked i byen", "!", None]
    days = [None, [], [D1], [D2], [D1, D2], [D1, D2], [None, D1]]
    one = lambda k: {
        "k": k, "title": draw.choice(titles), "street": draw.choice([None, "", "Vej 1", "Vej 12", "Gade 9"]), "city": draw.choice([None, "Odense"]), "postcode": draw.choice([None, "5000", "5000", "5600", "8000"]),
        "lat": draw.choice([None, 55.0, 55.001, 55.004, 55.02]) if k % 3 else 55.0 + draw.randrange(8) * 0.004, "lng": draw.choice([None, 10.0, 10.001, 10.019]), "geocode_quality": draw.choice(["A", "P", "source", None]),
        "category": draw.choice([None, "loppemarked", "loppemarked", "julemarked"]), "dates": draw.choice(days),
    }
    for n in (15, 60):
        rows = [one(k) for k in range(n)]
        rows += [r | {"k": n + i} for i, r in enumerate(draw.choices(rows, k=n // 3))]
        table = R.prepared_table(spark.createDataFrame(rows, SCHEMA))
        whole, brief = (dict(R.clusters(table, f(table)).collect()) for f in (R.accepted_pairs, R.linked))
        assert whole == brief and 1 < len(set(whole.values()))


def test_copies_are_not_paired(spark):
    row = {"title": "Loppemarked", "street": None, "city": None, "postcode": None, "lat": None, "lng": None, "geocode_quality": None, "category": "loppemarked", "dates": [D1]}
    table = R.prepared_table(spark.createDataFrame([row | {"k": k, "title": row["title"] if k % 2 else "Broens Lopper"} for k in range(400)], SCHEMA))
    assert R.linked(table).count() <= 3 * 400
    assert {r.cluster for r in R.clusters(table, R.linked(table)).collect()} == {0, 1}


def test_like_listings_are_stars(spark):
    row = {"title": "Broens store lopper i Odense", "street": None, "city": None, "lat": 55.0, "lng": 10.0, "geocode_quality": "P", "category": "loppemarked"}
    day = lambda k: [D1 + datetime.timedelta(days=k)]
    for code, links in ((None, R._bare_box_links), ("5000", R._code_links)):
        table = R.prepared_table(spark.createDataFrame([row | {"k": k, "postcode": code, "dates": day(k)} for k in range(100)], SCHEMA))
        found = links(table, R.TILE).distinct()
        assert found.count() <= 3 * 100
        assert {r.cluster for r in R.clusters(table, found).collect()} == {0}


def test_a_table_of_listings_is_what_is_read_of_each(spark):
    rows = [{"k": k, "title": t, "street": s, "city": c, "postcode": None, "lat": 55.0, "lng": None, "geocode_quality": "A", "category": None, "dates": None} for k, (t, s, c) in enumerate([("Ærø Lopper", "Vej 1", "Odense"), (None, None, None), ("Ærø Lopper", "Odense", "odense"), ("", "", None), (None, "Vej 1", "Odense")])]
    listings = spark.createDataFrame(rows, SCHEMA)
    told, table = R.prepared(listings), R.prepared_table(listings)
    assert told.columns == table.columns and sorted(map(repr, told.collect())) == sorted(map(repr, table.collect()))
