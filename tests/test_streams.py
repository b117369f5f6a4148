"""Streams over several files: updates, late rows, a restart between batches."""

import datetime

import pytest
from pyspark.sql import functions as F

from localmarkets.streaming import events as R

FILES = [
    [(1, 1, 7, "view", "a"), (2, 2, 7, "view", "b"), (3, 1, 8, "cart", "c")],
    [(4, 9, 7, "view", "d"), (5, 5, 9, "view", "e")],
    [(6, 3, 7, "view", "late"), (7, 30, 8, "cart", "f"), (7, 30, 8, "cart", "f")],
]


def day(n):
    return datetime.datetime(2026, 6, n, 12)


@pytest.fixture
def add(spark, tmp_path):
    """Adds the nth file of events to the folder that the streams read."""

    def one(n):
        rows = [(i, day(d), u, kind, 1.0, p) for i, d, u, kind, p in FILES[n]]
        spark.createDataFrame(rows, R.SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"new{n}"))
        (tmp_path / "in").mkdir(exist_ok=True)
        next((tmp_path / f"new{n}").glob("part-*.parquet")).rename(tmp_path / "in" / f"events{n}.parquet")
        return R.read_events(spark, str(tmp_path / "in"))

    return one


def test_partials_over_restarts(spark, add, tmp_path):
    path, days = str(tmp_path / "seen"), str(tmp_path / "days")
    for n in range(3):  # each round starts the queries anew from their checkpoints
        rows = add(n)
        R.write_partials(rows.withColumnRenamed("ts", "last_seen"), R.last_seen, path, path + "-checkpoint", R.last_seen, every=2).awaitTermination()
        R.write_partials(rows, R.seen_days, days, days + "-checkpoint").awaitTermination()
    assert {(r.user_id, r.event_type, r.last_seen.day) for r in R.last_seen(R.read_partials(spark, path)).collect()} == {(7, "view", 9), (8, "cart", 30), (9, "view", 5)}
    assert {tuple(r) for r in R.recurrence(R.read_partials(spark, days)).collect()} == {(7, 4, 8), (8, 2, 29), (9, 1, 0)}


def test_upserts_over_restarts(spark, add, tmp_path):
    path = str(tmp_path / "raw")
    shown = []
    for n in range(3):
        rows = add(n).selectExpr("user_id", "props as payload", "ts as last_seen")
        R.upsert_stream(rows, ["user_id"], path, path + "-checkpoint").awaitTermination()
        shown.append({(r.user_id, r.payload, r.last_seen.day, r.change) for r in R.snapshot(spark, path).collect()})
    assert shown[0] == {(7, "b", 2, "new"), (8, "c", 1, "new")}
    assert shown[1] == {(7, "d", 9, "changed"), (8, "c", 1, "kept"), (9, "e", 5, "new")}
    # The late row of 7 is older than its last sighting.
    assert {x for x in shown[2] if x[0] == 7} == {(7, "d", 9, "kept")}
    assert {x for x in shown[2] if x[0] == 8} == {(8, "f", 30, "changed")}
    written = [len(list(e.glob("part=*"))) for e in (tmp_path / "raw").glob("epoch=*")]
    assert 0 < max(written) <= 2  # a file has two keys


def test_partials_stay_as_many_as_their_keys(spark, tmp_path):
    (tmp_path / "in").mkdir()
    path, sizes = str(tmp_path / "seen"), []
    keep = F.col("last_seen") >= F.lit("2026-06-02").cast("timestamp")
    for n in range(8):
        rows = [(n, day(n + 1), n % 3, "view", 1.0, "p"), (n + 100, day(1), 50 + n, "view", 1.0, "old")]
        spark.createDataFrame(rows, R.SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"new{n}"))
        next((tmp_path / f"new{n}").glob("part-*.parquet")).rename(tmp_path / "in" / f"events{n}.parquet")
        stream = R.read_events(spark, str(tmp_path / "in")).withColumnRenamed("ts", "last_seen")
        R.write_partials(stream, R.last_seen, path, path + "-checkpoint", R.last_seen, keep, every=2).awaitTermination()
        sizes.append((len(list((tmp_path / "seen").glob("*=*"))), R.read_partials(spark, path).count()))
    assert {s for s in sizes[1::2]} <= {(1, 1), (1, 2), (1, 3)} and sizes[-1] == (1, 3)
    assert {(r.user_id, r.last_seen.day) for r in R.last_seen(R.read_partials(spark, path)).collect()} == {(0, 7), (1, 8), (2, 6)}
