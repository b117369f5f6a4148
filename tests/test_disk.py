"""What a job leaves in the shared folder, and links that grow no faster than the listings."""

import datetime
import hashlib
import os

from pyspark.sql import functions as F

from localmarkets.operators import resolve as R
from localmarkets.plans.publishing import BASE, PRODUCT, published, today
from localmarkets.plans.registry import QUERIES
from localmarkets.shared import cut, scratch, shared_dir
from localmarkets.sources import publish as P
from localmarkets.sources.publish import Published, text_digests
from localmarkets.views import view

SCHEMA = "k long, title string, street string, city string, postcode string, lat double, lng double, geocode_quality string, category string, dates array<date>"
D1 = datetime.date(2026, 7, 5)


def tables(spark):
    return set(os.listdir(shared_dir(spark)))


def test_scratch_tables_go_and_kept_ones_stay(spark):
    before = tables(spark)
    with scratch(spark) as own:
        first = cut(spark.range(5), "first")
        with scratch(spark) as inner:
            second = inner.keep(cut(first, "inner").where("id > 1"), "second")
        out = own.keep(second.where("id > 2"), "out")
    assert sorted(r.id for r in out.collect()) == [3, 4]
    assert {n.split("-")[0] for n in tables(spark) - before} == {"out"}


def test_a_written_table_leaves_no_shuffle_files(spark):
    shuffles = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    before = shuffles.getAllFiles().size()
    cut(spark.range(10000).groupBy("id").count().repartition(7), "shuffled")
    assert shuffles.getAllFiles().size() <= before


def test_clusters_leave_one_table(spark):
    row = {"title": "Broens Lopper", "street": "Vej 1", "city": None, "postcode": "5000", "lat": 55.0, "lng": 10.0, "geocode_quality": "A", "category": None, "dates": [D1]}
    before = tables(spark)
    found = R.same_market(spark.createDataFrame([row | {"k": k} for k in range(3)], SCHEMA))
    assert {r.cluster for r in found.collect()} == {0}
    # The components' last table stays with the clusters that are read from it only until they are written.
    assert {n.split("-")[0] for n in tables(spark) - before} == {"clusters"}


def test_listings_of_a_street_are_a_star(spark):
    """Precise places of one street and title that lie apart: all match, and none is judged with each of the others."""
    row = {"title": "Broens Lopper", "city": None, "postcode": "5000", "lng": 10.0, "geocode_quality": "A", "category": "loppemarked"}
    day = lambda k: [D1 + datetime.timedelta(days=k % 7)]
    table = R.prepared_table(spark.createDataFrame([row | {"k": k, "street": f"Vej {k % 3}", "lat": 50.0 + k, "dates": day(k)} for k in range(150)], SCHEMA))
    found = R._code_links(table, R.TILE).distinct()
    assert found.count() <= 2 * 150
    assert sorted({r.cluster for r in R.clusters(table, found).collect()}) == [0, 1, 2]


def test_places_are_not_broadcast(spark, sf):
    plan = QUERIES["J13_place_pairs"](spark, sf)._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan
    # What is broadcast are the keys with more rows than a tile, counted before.
    assert not any(n in line for line in plan.split("\n") if "BroadcastHashJoin" in line and "Inner" in line for n in ("key#", "street#", "y#"))


def test_files_of_calendars_are_compressed_and_read_in_order(spark, sf, tmp_path):
    folder = Published(spark, str(tmp_path / "texts"))
    rows = spark.range(3000).select(F.concat(F.lit("city"), F.col("id") % 3).alias("city"), "id", F.concat(F.lit("BEGIN:VEVENT line "), "id").alias("text"))
    folder.texts(rows, "city", ["id"], line_end="\r\n")
    own = [p for p in (tmp_path / "texts").rglob("city=*/part*")]
    plain = {f"city{i}": "".join(f"BEGIN:VEVENT line {k}\r\n" for k in range(i, 3000, 3)).encode() for i in range(3)}
    assert len(own) == 3 and sum(p.stat().st_size for p in own) < sum(map(len, plain.values())) / 3
    found = text_digests(spark, folder.current(), "city", "\r\n")
    assert {r.city: r.text for r in found.collect()} == {n: hashlib.md5(t).hexdigest() for n, t in plain.items()}
    assert "Exchange" not in found._jdf.queryExecution().sparkPlan().toString() and "Repartition" not in found._jdf.queryExecution().optimizedPlan().toString()
    # A market's days are told after the rows are dealt to files.
    assert "DTSTART" not in city_markets_plan(spark, sf)


def city_markets_plan(spark, sf):
    return P.city_markets(published(spark, sf), view(spark, sf, "v_occ"), today(), BASE, PRODUCT)._jdf.queryExecution().optimizedPlan().toString()
