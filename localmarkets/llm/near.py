"""Near-dedup by exact shingle similarity, on top of the SimHash index.

Two texts are near copies when the sets of their shingles have a Jaccard similarity of at least
``least``, or when their fingerprints differ in at most ``most`` bits. The second are found by
``simhash.link_edges``. For the first, ``BANDS`` keys of ``ROWS`` minima each are taken over a
text's shingles; texts with a key in common are compared by their exact sets. Similarity s gives a
common key with probability 1 - (1 - s ** ROWS) ** BANDS: 0.9999 at 0.8, 0.99999 at 0.85.

In a bucket (texts with one key) each text is compared with the bucket's leader, which differs from
bucket to bucket. After that, each text outside the leader's component is compared with all texts
of the bucket that are not of its own component. So each two texts of a bucket are compared or
already joined, and a large group of near copies costs its size, not the square of it; only texts
that share a key with a large group and join none of it are each held against all of it. That is done
by sketches inside the join, so that only pairs which are near by their sketches leave it: the sketch
of a set of at most ``SKETCH`` shingles is the whole set, so nothing else passes and nothing is lost;
of a larger set it is the shingles under a bound of the hash, more than SKETCH / 2 on average, and the
similarity that they must show is ``SLACK`` lower (over four standard deviations).

Defined results: texts without a word have no shingles and are joined by their fingerprint only;
null ids take part in nothing; texts with equal sets of shingles are joined without a comparison.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from localmarkets.llm.encoding import slices
from localmarkets.llm.simhash import SEED, bit_majority, link_edges, shingle_hashes
from localmarkets.operators.components import connected_components
from localmarkets.shared import cut

BANDS, ROWS = 24, 5
#: Shingles whose values under all functions are held at a time.
HELD = 256
#: Shingles of a sketch at most, on average, and by how much a sampled sketch may fall short of the similarity.
SKETCH, SLACK = 512, 0.12
#: Sets of shingles that a task remembers while it compares pairs.
REMEMBERED = 64

_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TURNS = np.random.default_rng(SEED + 1).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def band_keys(shingles: np.ndarray) -> list[int]:
    """A key for each band, of a set of shingle hashes that isn't empty."""
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), HELD):
        np.minimum(least, ((shingles[at : at + HELD, None] ^ _TURNS) * _FACTORS).min(axis=0), out=least)
    return [xxhash.xxh64_intdigest(row.tobytes(), k) - (1 << 63) for k, row in enumerate(least.reshape(BANDS, ROWS))]


def sketch(shingles: np.ndarray) -> tuple[int, np.ndarray]:
    """(level, low halves of the hashes under 2 ** (64 - level)) of a set of shingle hashes."""
    level = max(0, int(np.ceil(np.log2(max(len(shingles), 1) / SKETCH))))
    own = shingles if not level else shingles[shingles < np.uint64(1 << (64 - level))]
    return level, (own & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)


def _marks(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """id, fp, own (hash of the set of shingles; null without shingles), keys; rows with an id only."""

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fps, own, keys = [], [], []
            for t in b.column(1).to_pylist():
                hashes = shingle_hashes(t or "", words)
                fps.append(bit_majority(hashes))
                some = np.unique(hashes)
                own.append(xxhash.xxh64_intdigest(some.tobytes(), SEED) - (1 << 63) if len(some) else None)
                keys.append(band_keys(some) if len(some) else [])
            columns = [b.column(0), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(own, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "fp", "own", "keys"])

    return _texts(docs, id_col, text_col).mapInArrow(marked, "id long, fp long, own long, keys array<long>")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))


def _sketches(texts: DataFrame, words: int) -> DataFrame:
    """id, level, sketch of each of ``texts`` (id, text)."""

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            made = [sketch(np.unique(shingle_hashes(t or "", words))) for t in b.column(1).to_pylist()]
            columns = [b.column(0), pa.array([level for level, _ in made], pa.int32()), pa.array([values for _, values in made], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "level", "sketch"])

    return texts.mapInArrow(sketched, "id long, level int, sketch array<int>")


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 0.0


def verified(pairs: DataFrame, texts: DataFrame, words: int, least: float) -> DataFrame:
    """The pairs (u, v) whose texts (id, text) have a similarity of ``least`` or more."""
    texts = texts.withColumnRenamed("id", "i")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: OrderedDict[str, np.ndarray] = OrderedDict()

        def shingles(text: str) -> np.ndarray:
            if text not in known:
                known[text] = np.unique(shingle_hashes(text, words))
                if len(known) > REMEMBERED:
                    known.popitem(last=False)
            known.move_to_end(text)
            return known[text]

        for b in slices(batches, 2):
            ok = pa.array([jaccard(shingles(s or ""), shingles(t or "")) >= least for s, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)], pa.bool_())
            yield b.select(["u", "v"]).filter(ok)

    told = pairs.join(texts, F.col("u") == F.col("i")).select("u", "v", F.col("text").alias("text_u"))
    told = told.join(texts, F.col("v") == F.col("i")).select("u", "v", "text_u", F.col("text").alias("text_v"))
    return told.mapInArrow(compared, "u long, v long").distinct()  # an id that occurs twice has its pairs twice


def _ordered(u, v) -> list:
    return [F.greatest(u, v).alias("u"), F.least(u, v).alias("v")]


def near_components(docs: DataFrame, words: int = 5, most: int = 4, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """node, component (smallest id) of each id that is joined to another."""
    return _components(cut(_marks(docs, words, id_col, text_col), "near-marks"), docs, words, most, least, id_col, text_col)


def _components(marked: DataFrame, docs: DataFrame, words: int, most: int, least: float, id_col: str, text_col: str) -> DataFrame:
    prints = marked.groupBy("fp").agg(F.min("id").alias("id"))
    sets = marked.where("own is not null").groupBy("own").agg(F.min("id").alias("id"))
    joined = marked.join(prints.withColumnRenamed("id", "first"), "fp").where("id > first").select(F.col("id").alias("u"), F.col("first").alias("v"))
    joined = joined.unionByName(marked.join(sets.withColumnRenamed("id", "first"), "own").where("id > first").select(F.col("id").alias("u"), F.col("first").alias("v")))
    joined = joined.unionByName(link_edges(prints, most))

    # One text of each set goes to the buckets; those that are alone there leave.
    chosen = marked.join(sets.select("id", "own"), ["id", "own"]).dropDuplicates(["id", "own"])
    dealt = chosen.select("id", F.explode("keys").alias("key"))
    # The leader has the least id after a turn by the key, so that buckets have different ones.
    leaders = dealt.groupBy("key").agg(F.count("*").alias("n"), F.min(F.col("id").bitwiseXOR(F.col("key"))).alias("leader"))
    leaders = leaders.where("n > 1").select("key", F.col("leader").bitwiseXOR(F.col("key")).alias("leader"))
    buckets = cut(dealt.join(leaders, "key").select("key", "id", "leader"), "near-buckets")

    # Only the texts of documents that share a key are looked at again.
    texts = cut(_texts(docs, id_col, text_col).join(buckets.select("id").distinct(), "id", "left_semi"), "near-texts")

    stars = buckets.where("id <> leader").select(*_ordered(F.col("id"), F.col("leader"))).distinct()
    edges = cut(joined.unionByName(verified(stars, texts, words, least)), "near-edges")
    found = connected_components(edges)

    named = found.select(F.col("node").alias("id"), "component")
    labelled = buckets.join(named, "id", "left").select("key", "id", "leader", F.coalesce("component", "id").alias("c"))
    heads = named.select(F.col("id").alias("leader"), F.col("component").alias("head"))
    labelled = cut(labelled.join(heads, "leader", "left").select("key", "id", "c", F.coalesce("head", "leader").alias("head")), "near-labels")
    # Buckets that hold more than one component, with the sketches of their texts.
    open_ = labelled.join(labelled.where("c <> head").select("key").distinct(), "key", "left_semi")
    sketches = _sketches(texts.join(open_.select("id").distinct(), "id", "left_semi"), words)
    open_ = cut(open_.join(sketches, "id"), "near-open")
    other = open_.select("key", *[F.col(c).alias(f"{c}2") for c in ("id", "c", "level", "sketch")])
    pair = "c <> head AND c <> c2 AND (c2 = head OR id < id2) AND (level <> level2 OR size(array_intersect(sketch, sketch2)) + 1 >= (size(sketch) + size(sketch2)) * IF(level = 0, {}, {}))"
    shares = [x / (1 + x) for x in (least, least - SLACK)]  # of both sizes, that two sets of this similarity have in common
    rest = open_.join(other, "key").where(pair.format(*shares))
    rest = cut(rest.select(*_ordered(F.col("id"), F.col("id2"))).distinct().join(stars, ["u", "v"], "left_anti"), "near-rest")
    more = cut(verified(rest, texts, words, least), "near-more")
    if not more.head(1):
        return found
    return connected_components(found.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more))


def keep_one(docs: DataFrame, words: int = 5, most: int = 4, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each component the document with the smallest id, all columns as they were; rows with a null id stay.

    Rows that repeat a kept id stay, and so do the rows of an id that stands on unlike texts: ids
    tell documents apart, and no text may go for another's sake.
    """
    marked = cut(_marks(docs, words, id_col, text_col), "near-marks")
    found = _components(marked, docs, words, most, least, id_col, text_col).where("node <> component").select("node").distinct()
    unlike = marked.groupBy("id").agg(F.countDistinct("fp", F.coalesce("own", F.lit(0))).alias("n")).where("n > 1").select("id")
    gone = found.join(unlike, found["node"] == unlike["id"], "left_anti")
    return docs.join(gone, docs[id_col] == gone["node"], "left_anti")
