"""Exact dedup with an extendible-hash index kept on shared files (native DataFrame code).

1. The hashes of all normalised texts are counted, with their bytes, and kept as a shared table.
2. From their sums by leading hash bits the directory is made: at depth 0 it is one bucket; it doubles
   wherever a bucket holds more than its capacity, and each leading-bits entry names its bucket.
   Capacity grows with the whole only so far that the directory stays under 2**MAX_DEPTH entries.
3. The directory deals the records: a bucket is a range of hashes, and its records meet in the task
   that owns the bucket. There the records of one hash are a chain, parted by the bytes of their texts.
4. A hash that holds very many rows or bytes can't be split by more bits. Its texts don't move: their
   bytes are compared and counted in the map tasks first, what meets is one row a text and map task.
   There are at most 2 * 2**HOT_BITS such hashes, as each holds over 2**-HOT_BITS of all rows or bytes.

Defined results: a null text counts as empty; empty texts are equal to each other; null ids are
ignored when the smallest id of a group is taken (a group with null ids only has a null keep_id and
keeps all its rows); repeated rows count as members; an empty table gives an empty result.
``exact_dedup`` keeps records apart from its own columns, so other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from localmarkets.shared import cut

#: Leading hash bits that the directory may use: it has at most 2**18 entries, about 5 MB, which are broadcast.
MAX_DEPTH = 18
#: Bytes of texts that one bucket may hold before it is split, and what a row takes besides its text.
BUCKET_BYTES, ROW_BYTES = 32 << 20, 64
#: A hash with more than 2**-HOT_BITS of all rows or bytes, and more than HOT_ROWS rows, is counted in the map tasks.
HOT_BITS, HOT_ROWS = 14, 1024


def normalized(text: Column) -> Column:
    """Null as empty; each run of ASCII white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def directory(hashes: DataFrame, total: int, capacity: int = BUCKET_BYTES, max_depth: int = MAX_DEPTH) -> DataFrame:
    """prefix, bucket, depth for each occurring prefix of ``max_depth`` leading bits.

    ``hashes`` (h, bytes) with ``total`` bytes. A bucket is named by its first prefix, and its depth is
    how often it was split: once for each of its ancestors that holds more than the capacity.
    """
    capacity = max(capacity, total >> (max_depth - 1))
    prefix = F.shiftrightunsigned("h", 64 - max_depth).cast("int")
    sizes = hashes.groupBy(prefix.alias("prefix")).agg(F.sum("bytes").alias("bytes"))
    up = sizes.select("prefix", "bytes", F.explode(F.sequence(F.lit(0), F.lit(max_depth - 1))).alias("d"))
    up = up.select("prefix", "bytes", "d", F.expr(f"shiftright(prefix, {max_depth} - d)").alias("ancestor"))
    full = up.groupBy("d", "ancestor").agg(F.sum("bytes").alias("held")).where(F.col("held") > capacity).select("d", "ancestor", F.lit(1).alias("split"))
    # There are 2**d ancestors at depth d, so fewer than 2**max_depth in all.
    depths = up.join(F.broadcast(full), ["d", "ancestor"], "left").groupBy("prefix").agg(F.count("split").cast("int").alias("depth"))
    return depths.select("prefix", F.expr(f"shiftleft(shiftright(prefix, {max_depth} - depth), {max_depth} - depth)").alias("bucket"), "depth")


class Index:
    """The shared tables over one set of records, and what each record's place in them tells."""

    def __init__(self, docs: DataFrame, columns: list[str], id_col: str, text_col: str, capacity: int = BUCKET_BYTES, hot_rows: int = HOT_ROWS):
        self.id_col, self.text_col = id_col, text_col
        record = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("record")
        text = normalized(F.col(f"`{text_col}`"))
        hashed = docs.select(text.alias("text")).select(F.xxhash64("text").alias("h"), (F.octet_length("text") + ROW_BYTES).cast("long").alias("n"))
        self.hashes = cut(hashed.groupBy("h").agg(F.count("*").alias("rows"), F.sum("n").alias("bytes")), "dedup-hashes")
        total = self.hashes.agg(F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes")).first()
        rows, size = total.rows or 0, total.bytes or 0
        hot = (F.col("rows") > max(hot_rows, rows >> HOT_BITS)) | ((F.col("bytes") > max(capacity // 4, size >> HOT_BITS)) & (F.col("rows") > 1))
        self.hot = F.broadcast(cut(self.hashes.where(hot).select(F.col("h").alias("hot")), "dedup-hot"))
        self.directory = cut(directory(self.hashes.where(~hot), size, capacity), "dedup-directory")
        self.records = docs.select(record, text.alias("text")).select("record", "text", F.xxhash64("text").alias("h"))

    def owned(self) -> DataFrame:
        """record, text, keep_id, group_size, nth: of the records that their buckets' owners compare."""
        prefix = F.shiftrightunsigned("h", 64 - MAX_DEPTH).cast("int")
        cold = self.records.join(self.hot, F.col("h") == F.col("hot"), "left_anti").select("record", "h", prefix.alias("prefix"))
        dealt = cold.join(F.broadcast(self.directory.select("prefix", "bucket")), "prefix").select("bucket", "h", "record").repartition("bucket")
        # The text is made anew where it is compared, so that it does not travel beside the record.
        chained = dealt.select("bucket", "h", "record", normalized(F.col(f"record.`{self.text_col}`")).alias("text"), F.col(f"record.`{self.id_col}`").alias("id"))
        chain = Window.partitionBy("bucket", "h", "text")
        first = chain.orderBy(F.col("id").asc_nulls_last())
        return chained.select("record", "text", "id", F.min("id").over(chain).alias("keep_id"), F.count("*").over(chain).alias("group_size"), F.row_number().over(first).alias("nth"))

    def counted(self) -> DataFrame:
        """record, text, h: of the records with a hot hash."""
        return self.records.join(self.hot, F.col("h") == F.col("hot"), "left_semi")


def dedup_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = BUCKET_BYTES, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256."""
    index = Index(docs, [id_col, text_col], id_col, text_col, capacity, hot_rows)
    own = F.col("id").eqNullSafe(F.col("keep_id")).alias("kept")
    sha = F.sha2("text", 256)
    cold = index.owned().select("id", "keep_id", "group_size", own, sha.alias("text_sha256"))
    counted = index.counted().select(F.col(f"record.`{id_col}`").alias("id"), "h", "text")
    groups = cut(counted.groupBy("h", "text").agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size")).select(F.col("h").alias("of"), sha.alias("sha"), "keep_id", "group_size"), "dedup-hot-groups")
    hot = counted.select("id", "h", sha.alias("text_sha256")).join(F.broadcast(groups), (F.col("h") == F.col("of")) & (F.col("text_sha256") == F.col("sha")))
    return cold.unionByName(hot.select("id", "keep_id", "group_size", own, "text_sha256"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = BUCKET_BYTES, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Of the rows with equal texts the one with the smallest id, all columns as they were.

    A kept id that occurs on several equal rows is kept once.
    """
    index = Index(docs, docs.columns, id_col, text_col, capacity, hot_rows)
    cold = index.owned().where("nth = 1 OR keep_id IS NULL").select("record")
    identity = F.col(f"record.`{id_col}`")
    # Of a hot text one record stays: the map tasks keep the least of theirs. Those without any id stay all.
    known = index.counted().where(identity.isNotNull()).groupBy("h", "text").agg(F.min_by("record", identity).alias("record"))
    firsts = cut(known.select("h", F.sha2("text", 256).alias("sha"), "record"), "dedup-hot-firsts")
    nameless = index.counted().where(identity.isNull()).select("record", "h", F.sha2("text", 256).alias("sha"))
    named = F.broadcast(firsts.select(F.col("h").alias("of"), F.col("sha").alias("as")))
    nameless = nameless.join(named, (F.col("h") == F.col("of")) & (F.col("sha") == F.col("as")), "left_anti")
    kept = cold.unionByName(firsts.select("record")).unionByName(nameless.select("record"))
    return kept.select(*[F.col(f"record.`{c}`").alias(c) for c in docs.columns])
