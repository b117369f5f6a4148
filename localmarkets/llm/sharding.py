"""Two-pass external shuffle into shards (native DataFrame code).

Pass 1 scatters whole records uniformly into buckets, sized so that a bucket's records and the list
of their places fit in memory, by a seeded hash. Pass 2 brings each bucket into one array and Fisher-
Yates shuffles it: from the last place to the second, each is swapped with one at or before it that
a hash of seed, bucket and place names. The buckets laid one after another give each record its place
in the whole order; seed, records and the number of buckets decide it, not how Spark deals the rows.
The shards are written from the buckets, and what ``assign_shards`` tells is of the records read back.

Equal records are numbered, so that a record that a third of all rows repeat is scattered like others.

Defined results: a null text has no bytes (size 1); null ids are hashed like any other value;
repeated rows are separate records; an empty table gives an empty result. ``assign_shards`` keeps
records apart from its own columns, so other columns may have any name; ``write_shards`` adds an
underscore to its columns ``shard`` and ``slot`` where the records have these. Records hold no maps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from localmarkets.shared import cut, shared_path

#: Bytes and records that one bucket holds on average.
BUCKET_BYTES, BUCKET_ROWS = 16 << 20, 1024
#: Bytes that a record takes in a bucket besides its values.
ROW_BYTES = 64


def key_shard(key: Column, shards: int, seed: int) -> Column:
    """Highest seeded hash wins: one more shard takes rows only into itself."""
    scores = F.array(*[F.struct(F.xxhash64(key, F.lit(seed), F.lit(s)).alias("score"), F.lit(s).alias("shard")) for s in range(shards)])
    return F.array_max(scores)["shard"]


def _record_bytes(docs: DataFrame) -> Column:
    """Bytes of a record: its strings and binaries, 8 for each other plain value, nested values as JSON."""
    size = F.lit(ROW_BYTES).cast("long")
    for name, kind in docs.dtypes:
        column = F.col(f"`{name}`")
        if kind in ("string", "binary"):
            size += F.coalesce(F.octet_length(column), F.lit(0))
        elif "<" in kind:
            size += F.coalesce(F.octet_length(F.to_json(F.struct(column))), F.lit(0))
        else:
            size += F.lit(8)
    return size


def permutation(n: Column, seed: int, bucket: Column) -> Column:
    """Fisher-Yates: 0 to n - 1 in an order that seed and bucket decide."""

    def swap(order: Column, i: Column) -> Column:
        j = F.pmod(F.xxhash64(F.lit(seed), bucket, i), i + 1).cast("int")
        parts = [F.slice(order, F.lit(1), j), F.array(order[i]), F.slice(order, j + 2, i - j - 1), F.array(order[j]), F.slice(order, i + 2, n - i - 1)]
        return F.when(j == i, order).otherwise(F.concat(*parts))

    return F.when(n > 1, F.aggregate(F.sequence(n - 1, F.lit(1), F.lit(-1)), F.sequence(F.lit(0), n - 1), swap)).otherwise(F.array(F.lit(0)))


def _numbered(docs: DataFrame) -> DataFrame:
    """record, copy: equal records are told apart by a number where there are too many for one bucket."""
    records = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record")).withColumn("h", F.xxhash64("record"))
    often = cut(records.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > BUCKET_ROWS).select(F.col("h").alias("often")), "often")
    plain = F.lit(0).cast("long").alias("copy")
    if often.isEmpty():
        return records.select("record", plain)
    # Counted in the map tasks before they meet; numbers in runs, so that no array is long.
    same = records.join(often, F.col("h") == F.col("often"), "left_semi").groupBy("record").agg(F.count("*").alias("n"))
    runs = same.select("record", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / BUCKET_ROWS).cast("long"))).alias("run"))
    number = F.explode(F.sequence(F.col("run") * BUCKET_ROWS, F.least(F.col("n"), (F.col("run") + 1) * BUCKET_ROWS) - 1)).alias("copy")
    return records.join(often, F.col("h") == F.col("often"), "left_anti").select("record", plain).unionByName(runs.select("record", number))


def shuffled(docs: DataFrame, seed: int, buckets: int) -> DataFrame:
    """bucket, position, record: all records in a random order, from 0 without gaps."""
    bucket = F.pmod(F.xxhash64(F.lit(seed), "record", "copy"), F.lit(buckets)).alias("bucket")
    numbered = _numbered(docs)
    # Sorted before the shuffle, so that the order in which records arrive decides nothing.
    scattered = numbered.select(bucket, F.struct(F.xxhash64("record").alias("h"), "record").alias("r"))
    gathered = scattered.groupBy("bucket").agg(F.array_sort(F.collect_list("r")).alias("records"))
    ordered = gathered.select("bucket", "records", permutation(F.size("records"), seed, F.col("bucket")).alias("order"))
    placed = ordered.join(_before(numbered.select(bucket), [], F.lit(1)), "bucket").select("bucket", "before", "records", F.posexplode("order").alias("i", "k"))
    return placed.select("bucket", (F.col("before") + F.col("i")).cast("long").alias("position"), F.col("records")[F.col("k")]["record"].alias("record"))


def _before(rows: DataFrame, by: list[str], amount: Column) -> DataFrame:
    """bucket, ``by``, before: the sum of ``amount`` over the earlier buckets. One row a bucket, not a record, meets in the window."""
    sums = rows.groupBy("bucket", *by).agg(F.sum(amount).cast("long").alias("n"))
    earlier = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return sums.select("bucket", *by, (F.sum("n").over(earlier) - F.col("n")).alias("before"))


def _placed(docs: DataFrame, shards: int, law: str, seed: int, id_col: str, text_col: str, bucket_bytes: int) -> DataFrame:
    """record, shard, slot, grown_shard: the one way from records to their places, for each law."""
    if law not in ("rows", "bytes", "key"):
        raise ValueError(f"unknown law {law!r}")
    size = _text(F.col(f"`{text_col}`"))[0]
    total = docs.agg(F.count("*").alias("rows"), F.sum(_record_bytes(docs)).alias("held"), F.sum(size).alias("bytes")).first()
    rows = shuffled(docs, seed, max(1, -(-(total.held or 0) // bucket_bytes), -(-total.rows // BUCKET_ROWS)))
    if law == "rows":
        return rows.select("record", F.pmod("position", F.lit(shards)).cast("int").alias("shard"), F.floor(F.col("position") / shards).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    # The order is read twice, so it is kept.
    rows, none = cut(rows, "shard-order"), F.lit(None).cast("int")
    facts = rows.select("bucket", "position", F.col("record")[id_col].alias("id"), _text(F.col("record")[text_col])[0].alias("size"))
    own = Window.partitionBy("bucket").orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if law == "bytes":
        running = facts.join(_before(facts, [], F.col("size")), "bucket").withColumn("total", F.col("before") + F.sum("size").over(own) - F.col("size"))
        middle = F.col("total") + F.col("size") / 2
        dealt = running.select("bucket", "position", F.least(F.lit(shards - 1), F.floor(middle * shards / F.lit(max(1, total.bytes or 0)))).cast("int").alias("shard"), none.alias("grown_shard"))
    else:
        dealt = facts.select("bucket", "position", key_shard(F.col("id"), shards, seed).alias("shard"), key_shard(F.col("id"), shards + 1, seed).cast("int").alias("grown_shard"))
    within = Window.partitionBy("bucket", "shard").orderBy("position")
    numbered = dealt.join(_before(dealt, ["shard"], F.lit(1)), ["bucket", "shard"])
    numbered = numbered.select("position", "shard", (F.col("before") + F.row_number().over(within) - 1).cast("long").alias("slot"), "grown_shard")
    return rows.join(numbered, "position").select("record", "shard", "slot", "grown_shard")


def _text(text: Column) -> tuple[Column, Column]:
    """(bytes and one more, CRC-32) of a text."""
    text = F.coalesce(text, F.lit(""))
    return (F.octet_length(text) + 1).cast("long"), F.crc32(text.cast("binary"))


def assign_shards(docs: DataFrame, shards: int = 8, law: str = "rows", seed: int = 7, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Writes the shards to the shared folder and tells of each record read back: id, size, text_crc32, law, shard, slot, grown_shard.

    ``rows``: counts at most one apart. ``bytes``: the shuffled order is cut where the running size
    passes each next part of the total, so sizes differ by a record at most. ``key``: id and shard
    count decide.
    """
    path = shared_path(docs.sparkSession, "shards")
    placed = _placed(docs, shards, law, seed, id_col, text_col, bucket_bytes).select("record", "slot", "grown_shard", "shard")
    _write(placed, path, "shard", "slot")
    back = docs.sparkSession.read.schema(placed.schema).parquet(path)
    size, crc = _text(F.col("record")[text_col])
    return back.select(F.col("record")[id_col].alias("id"), size.alias("size"), crc.alias("text_crc32"), F.lit(law).alias("law"), "shard", "slot", "grown_shard")


def _write(placed: DataFrame, path: str, shard: str, slot: str) -> None:
    """One folder a shard; each task writes its buckets' part of it, rows in slot order within a file."""
    placed.sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)


def _free(name: str, columns: list[str]) -> str:
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


def write_shards(docs: DataFrame, path: str, shards: int = 8, seed: int = 7, bucket_bytes: int = BUCKET_BYTES, law: str = "rows", id_col: str = "doc_id", text_col: str = "text") -> None:
    """Shuffle whole records and write them as Parquet, one folder a shard, with the records' own columns and their slot."""
    placed = _placed(docs, shards, law, seed, id_col, text_col, bucket_bytes)
    shard, slot = (_free(name, docs.columns) for name in ("shard", "slot"))
    _write(placed.select("record.*", F.col("shard").alias(shard), F.col("slot").alias(slot)), path, shard, slot)
