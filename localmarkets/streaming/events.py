"""Structured Streaming forms: upserts, last sightings, recurrence, windowed counts. State is bounded by watermarks or kept in tables; a batch rebuild stays the truth."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from localmarkets.operators.lifecycle import upsert_raw
from localmarkets.operators.snapshot import PARTS, Snapshot
from localmarkets.shared import remove

#: Batches of partial results that are folded into one.
FOLDED = 16
SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet event files as a stream."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "events*.parquet").parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def source_counts(stream: DataFrame, size: str = "1 day", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Rows and sum of values per source and tumbling or sliding window."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return stream.withWatermark("ts", late).groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def session_counts(stream: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    return stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "n")


def _numbered(spark: SparkSession, path: str, name: str) -> list[int]:
    """Numbers of the finished folders ``name=N`` below ``path``."""
    jvm = spark._jvm.org.apache.hadoop.fs
    files = jvm.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(jvm.Path(f"{path}/{name}=*/_SUCCESS"))
    return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in files or [])


def _parts(spark: SparkSession, path: str, before: int | None = None) -> list[str]:
    """The newest base and the batches after it."""
    batches, bases = ([n for n in _numbered(spark, path, name) if before is None or n <= before] for name in ("batch", "base"))
    last = bases[-1] if bases else -1
    return [f"{path}/base={n}" for n in bases[-1:]] + [f"{path}/batch={n}" for n in batches if n > last]


def read_partials(spark: SparkSession, path: str) -> DataFrame:
    """The partial results that count, to be combined."""
    return spark.read.parquet(*_parts(spark, path))


def write_partials(stream: DataFrame, partial: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, combine: Callable[[DataFrame], DataFrame] | None = None, keep: Column | None = None, every: int = FOLDED):
    """Writes each batch's own aggregate as ``path/batch=N``: no state is held between batches, a batch that runs again replaces itself, and late rows count.

    With ``combine`` (partial results to partial results, repeatable) each ``every`` batches are folded into ``path/base=N``, without the rows for which
    ``keep`` fails (the state's expiry), and removed: files and rows stay those of the live keys, however many batches there were. What
    a failed fold leaves isn't read; a batch that runs again after its fold counts twice, which maxima and sets don't show.
    """

    def batch(rows: DataFrame, epoch: int) -> None:
        spark = rows.sparkSession
        partial(rows).write.mode("overwrite").parquet(f"{path}/batch={epoch}")
        if combine and (epoch + 1) % every == 0:
            held = combine(spark.read.parquet(*_parts(spark, path, epoch)))
            held = held if keep is None else held.where(keep)
            held.write.mode("overwrite").parquet(f"{path}/base={epoch}")
            for name in ("batch", "base"):
                for n in _numbered(spark, path, name):
                    if n < epoch or (name == "batch" and n == epoch):
                        remove(spark, f"{path}/{name}={n}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def last_seen(rows: DataFrame) -> DataFrame:
    """Newest sighting of each source and id; of partial results too."""
    return rows.groupBy("user_id", "event_type").agg(F.max("last_seen").alias("last_seen"))


def seen_days(rows: DataFrame) -> DataFrame:
    """The distinct days of each place in a batch."""
    return rows.select("user_id", F.to_date("ts").alias("day")).distinct()


def recurrence(days: DataFrame) -> DataFrame:
    """Distinct days and span of each place, over the partial results of all batches."""
    return days.groupBy("user_id").agg(F.count_distinct("day").alias("days"), F.datediff(F.max("day"), F.min("day")).cast("long").alias("span"))


def snapshot(spark: SparkSession, path: str) -> DataFrame | None:
    """What ``upsert_stream`` has finished, if there is something; ``change`` is what the newest batch did to a row."""
    table = Snapshot(spark, path, [])
    rows = table.read()
    return None if rows is None else rows.withColumn("change", F.when(F.col("epoch") == table.epochs()[-1], F.col("change")).otherwise("kept")).drop("epoch")


def upsert_stream(stream: DataFrame, key: list[str], path: str, checkpoint: str, late: str = "2 days", parts: int = PARTS):
    """Keeps a ``Snapshot`` (key, payload, hash, last_seen, change) of a deduplicated stream; a batch rewrites the partitions of its keys only.

    ``stream`` has key, payload, last_seen. State is what the watermark keeps of the deduplication; the snapshot is a table. A batch that
    runs again reads what was before it and replaces its own; one without rows writes none. Rows older than a key's last sighting
    change nothing.
    """

    def batch(rows: DataFrame, epoch: int) -> None:
        table = Snapshot(rows.sparkSession, path, key, parts=parts)
        newest = rows.groupBy(*key).agg(F.max_by("payload", "last_seen").alias("payload"), F.max("last_seen").alias("last_seen")).persist()
        if touched := table.touched(newest):
            old = table.read(epoch, touched)
            old = (newest.limit(0) if old is None else old).select(*key, "payload", "last_seen")
            later = newest.join(old.select(*key, F.col("last_seen").alias("held")), key, "left").where("held is null or last_seen >= held").drop("held")
            table.write(epoch, upsert_raw(old, later, key))
            table.prune()
        newest.unpersist()

    deduped = stream.withWatermark("last_seen", late).dropDuplicatesWithinWatermark([*key, "payload", "last_seen"])
    return deduped.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_table(stream: DataFrame, mode: str, path: str, checkpoint: str) -> None:
    """Runs an append stream over what is there now into Parquet files."""
    stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
