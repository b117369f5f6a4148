"""Landed side files with malformed rows; nearest rows against all pairs."""

import math
import random

from localmarkets.operators import listing as Q
from localmarkets.sources import feeds


def test_side_files(spark):
    maps = spark.createDataFrame([('{"a": "3.7", "b": "x", "c": "", "d": null}',), ("no json",), (None,)], "line string")
    assert {tuple(r) for r in feeds.curated_counts(maps).collect()} == {("a", 3)}
    arrays = spark.createDataFrame([('[{"slug": "a", "name": "A"}, {"slug": "", "name": "B"}, {"name": "C"}]',), ("{",), (None,)], "line string")
    assert [r.kept for r in feeds.vetted_places(arrays).collect()].count(True) == 1


def test_stores(spark):
    shops = '{"stores": [%s]}' % ", ".join(
        f'{{"no": {n}, "address": "Vej {v}, 5000 Odense", "kind": "{kind}"}}' for n, v, kind in ((2, 1, "shop"), (1, 1, "shop"), (3, 2, "office"), (4, 3, "shop"))
    )
    rows = feeds.store_locator_to_venues(spark.createDataFrame([(shops,), ("nonsense",), (None,)], "line string"), "chain")
    assert {(r.shop, r.street, r.postcode, r.city) for r in rows.collect()} == {(1, "Vej 1", "5000", "Odense"), (4, "Vej 3", "5000", "Odense")}


def km(a, b):
    x, y = math.radians(b[0] - a[0]), math.radians(b[1] - a[1])
    h = math.sin(x / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(y / 2) ** 2
    return round(2 * 6371 * math.asin(math.sqrt(h)), 6)


def test_nearest(spark):
    random.seed(3)
    places = [(55 + random.random() * 2, 9 + random.random() * 3) for _ in range(60)] + [(55.5, 10.5)] * 6 + [(55.5 + i / 1000, 10.5) for i in range(8)] + [(57.9, 8.0)]
    rows = [(i, *p) for i, p in enumerate(places)] + [(900, None, 10.0), (901, 55.0, None)]
    df = spark.createDataFrame(rows, "id long, lat double, lng double")
    expected = set()
    for i, a in enumerate(places):
        near = sorted((km(a, b), j) for j, b in enumerate(places) if j != i and km(a, b) <= 40)[:3]
        expected |= {(i, j, d, n + 1) for n, (d, j) in enumerate(near)}
    assert {tuple(r) for r in Q.nearest(df, df, 3, 40.0).collect()} == expected
    assert Q.nearest(df.limit(0), df, 3, 40.0).count() == 0
