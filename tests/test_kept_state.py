"""What is kept between runs: partial snapshots, incremental resolution, the search index, published folders; and blocks cut into tiles."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from localmarkets.operators import postings as X
from localmarkets.operators import resolve as R
from localmarkets.operators.incremental import Resolution
from localmarkets.operators.snapshot import Snapshot
from localmarkets.plans.resolve import listings
from localmarkets.shared import cut
from localmarkets.sources import publish as P


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_snapshot_rewrites_what_a_batch_touches(spark, tmp_path):
    table = Snapshot(spark, str(tmp_path / "t"), ["k"], parts=16)
    rows = spark.range(200).select(F.col("id").alias("k"), F.lit("old").alias("v"))
    table.apply(0, rows)
    fresh = spark.createDataFrame([(3, "new"), (500, "new")], "k long, v string")
    gone = spark.createDataFrame([(7,), (999,)], "k long")
    table.apply(1, fresh, gone)
    parts = table.touched(fresh.select("k"), gone)
    assert len(parts) <= 4 and {p for p, e in table.versions().items() if e == 1} == set(parts)
    want = sorted([(k, "old") for k in range(200) if k not in (3, 7)] + [(3, "new"), (500, "new")])
    assert rows_of(table.read().select("k", "v")) == want
    table.apply(1, fresh, gone)  # a batch that runs again
    assert rows_of(table.read().select("k", "v")) == want and len(rows_of(table.read(before=1))) == 200
    table.apply(2, fresh.limit(0), spark.range(600).select(F.col("id").alias("k")))
    assert rows_of(table.read().select("k")) == []
    table.apply(3, fresh)
    table.prune()
    assert rows_of(table.read().select("k", "v")) == [(3, "new"), (500, "new")]


def test_failed_epoch_does_not_count(spark, tmp_path):
    table = Snapshot(spark, str(tmp_path / "t"), ["k"], parts=4)
    table.apply(0, spark.range(10).select(F.col("id").alias("k")))
    with pytest.raises(PySparkException):
        table.apply(1, spark.range(20).select((F.col("id") + F.when(F.col("id") == 19, F.raise_error(F.lit("no")).cast("long")).otherwise(0)).alias("k")))
    assert len(rows_of(table.read())) == 10


@pytest.mark.parametrize("search", [True, False])
def test_incremental_resolution_is_a_rebuild(spark, sf, tmp_path, search):
    rows = cut(listings(spark, sf).where("k < 900"), "listings")
    base = rows.where("k % 20 <> 3")
    kept, anew = Resolution.at(spark, str(tmp_path / "kept"), 8), Resolution.at(spark, str(tmp_path / "anew"), 8)
    kept.rebuild(base, search)
    changed = rows.where("k % 20 = 3 or k % 50 = 9").withColumn("title", F.when(F.col("k") % 50 == 9, F.concat("title", F.lit(" ved havnen"))).otherwise(F.col("title")))
    removed = base.where("k % 41 = 1 and k % 50 <> 9").select("k")
    kept.update(changed, removed, search)
    now = base.join(changed.select("k"), "k", "left_anti").unionByName(changed).join(removed, "k", "left_anti")
    anew.rebuild(now, search)
    before = rows_of(kept.clusters())
    assert before == rows_of(anew.clusters())
    kept.update(changed, None, search)  # nothing new
    assert rows_of(kept.clusters()) == before


def test_tiles_keep_every_pair_once(spark):
    hot = spark.range(400).select("id", F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("p"), (F.col("id") % 30).cast("string"))).alias("code"))
    side = lambda p: hot.select(F.col("id").alias(f"{p}_k"), "code")
    met = R.tiled_join(side("a"), side("b"), ["code"], F.col("a_k") < F.col("b_k"), tile=20).select("a_k", "b_k")
    plain = side("a").join(side("b"), "code").where("a_k < b_k").select("a_k", "b_k")
    assert rows_of(met) == rows_of(plain)


def test_search_finds_what_pairs_by_place_miss(spark):
    schema = "k long, title string, venue_name string, description string, street string, city string, postcode string, lat double, lng double, geocode_quality string, category string, dates array<date>"
    day = [F.to_date(F.lit("2026-07-05"))]
    base = [("Loppemarked på Vanløse Torv", "2720"), ("Vanløse Torv loppemarked", None), ("Loppemarked Vanloese torv", "9000"), ("Andet marked", None)]
    rows = spark.createDataFrame([(k, t, None, None, None, None, code, None, None, None, "loppemarked", None) for k, (t, code) in enumerate(base)], schema).withColumn("dates", F.array(*day))
    made = R.prepared_table(rows)
    assert rows_of(R.candidate_pairs(made)) == [(0, 1), (1, 2)]


def test_index_updates_and_reads_ranges(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"marked nummer{i} ved Ørbæk søndag") for i in range(30)], "id long, text string")
    own = X.event_words("text")
    index = X.build_index(docs.where("id < 20"), "id", own, str(tmp_path / "index"))
    index.update(docs.where("id >= 20 or id = 3").withColumn("text", F.concat("text", F.lit(" ny"))), "id", own, docs.where("id = 5"))
    now = docs.where("id <> 5").withColumn("text", F.when((F.col("id") >= 20) | (F.col("id") == 3), F.concat("text", F.lit(" ny"))).otherwise(F.col("text")))
    whole = X.build_index(now, "id", own)
    small = index.compact()
    assert len(index.segments()) == 2 and len(small.segments()) == 1
    for made in (index, small):
        assert rows_of(made.postings()) == rows_of(whole.postings()) and rows_of(made.totals()) == rows_of(whole.totals())
    groups = [["ørb", "oerb", "orb"], ["ny"]]
    want = rows_of(X.search(whole.postings(), whole.totals(), groups))
    assert len(want) == 11 and want == rows_of(X.search(index.postings(), index.totals(), groups))
    plan = small.postings().where(F.col("token").startswith("ny"))._jdf.queryExecution().toString()
    assert "StringStartsWith(token,ny)" in plan.replace(" ", "")


def test_search_of_all_titles_is_the_search_of_each(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["stort marked i by", "marked i byen", "by marked", "marked", "markedet i by i dag", "stort marked i by", "nyt"] * 3)], "id long, text string")
    rows = cut(X.posting_rows(docs, "id", X.event_words("text")), "postings")
    totals = docs.agg(F.count("*").alias("docs"), F.avg(F.size(X.event_words("text"))).alias("mean"))
    asked = ["marked by", "i", "stort marked i by", "nyt marked", "byen"]
    found = X.search_all(spark.createDataFrame([(q,) for q in asked], "q string"), rows, totals, 4)
    told = sorted((r.q, r.id, r.score) for r in found.collect())
    assert told == sorted((q, r.id, r.score) for q in asked for r in X.search(rows, totals, [[w] for w in q.split()], 4).collect())


def test_published_folder_switches_as_a_whole(spark, tmp_path):
    folder = P.Published(spark, str(tmp_path / "site"))
    assert folder.current() is None
    folder.lines(spark.createDataFrame([("one",), ("two",)], "text string"))
    first = folder.current()
    with pytest.raises(PySparkException):
        folder.lines(spark.range(5).select(F.raise_error(F.lit("no")).cast("string").alias("text")))
    assert folder.current() == first and rows_of(spark.read.text(first)) == [("one",), ("two",)]
    folder.texts(spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), ("b", 1, "z")], "name string, n int, text string"), "name", ["n"], line_end=P.CRLF)
    back = spark.read.schema("value string, name string").text(folder.current(), wholetext=True)
    assert rows_of(back.select("name", "value")) == [("a", "x\r\ny\r\n"), ("b", "z\r\n")]
    assert not (tmp_path / "site" / first.rsplit("/", 1)[1]).exists()


def test_calendar_lines_fold_between_characters(spark):
    line = "SUMMARY:" + "æøå漢🎪 " * 30
    told = spark.createDataFrame([(line,), ("short",)], "t string").select(P.folded(F.col("t"))).collect()
    parts = told[0][0].split("\r\n")
    assert all(len(p.encode()) <= 75 for p in parts) and len(parts) > 5
    assert parts[0] + "".join(p[1:] for p in parts[1:]) == line and told[1][0] == "short"
    assert spark.range(1).select(P.ical_text(F.lit("a\\b;c,d\r\ne\rf\ng"))).first()[0] == "a\\\\b\;c\\,d\\ne\\nf\\ng"


def test_digests_of_published_files(spark, tmp_path):
    """A file is read in pieces; the digest is that of the whole, whatever the pieces."""
    folder = P.Published(spark, str(tmp_path / "site"))
    rows = spark.range(3000).select((F.col("id") % 3).cast("string").alias("name"), "id", F.concat_ws(P.CRLF, F.lit("æ"), F.col("id"), F.lit(""), F.when(F.col("id") % 7 == 0, "\n x\r")).alias("text"))
    folder.texts(rows, "name", ["id"], line_end=P.CRLF)
    want = rows_of(spark.read.schema("value string, name string").text(folder.current(), wholetext=True).select("name", F.md5("value")))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
        assert rows_of(P.text_digests(spark, folder.current(), "name", P.CRLF)) == want and len(want) == 3
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
